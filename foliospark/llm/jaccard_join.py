"""N-gram Jaccard join by vertical partitioning, and the classes of documents that it links.

A document's set has its distinct shingles of WORDS words. Sets are ordered by how often a shingle occurs in the corpus
(rarest first), that global order is cut into fragments, and a node's set becomes a row a fragment. Candidate pairs meet
these rows fragment by fragment; each meeting emits a partial overlap, partial overlaps are summed by pair, and a pair
links when 100 * overlap >= 80 * union.

Candidates share a shingle of their prefixes, the rarest ones, of which a linked pair must share one. Some things
keep their number linear in groups of copies without losing a link between classes:

* equal sets are one node;
* a node whose shingles mostly occur nowhere else has no partner and goes at once; what occurs elsewhere (`common`)
  bounds the size of any partner: 0.8 / 1.8 * (n + m) <= common, for both sides;
* bitmaps of the shingles bound how many two nodes can share, before their sets meet;
* links only matter between classes: nodes of one prefix list are first compared with one leader a node, the classes
  so found join, and only pairs of different classes go on to the last, complete round.

Shingles are 64-bit hashes, nodes 128-bit ones. Counts come from ``keyed``, so no shingle's list is ever one task's: the
count of a shingle, which each row of its list knows, says into how many salts the list is dealt (`SALT`), and what is
found out about a list goes to all of its salts. In the last round a list meets itself in cells of two salts.

Defined results: a null text, or one without words, has an empty set and is a class of its own; a text under WORDS
words is one shingle of all; repeated rows share a node; a null doc_id joins its class and names it only if no other
member has an id. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import keyed
from .common import discard, spill
from .shards import open_shard, text_shards
from .textbytes import NOT_SPACE, chain, mix, row_runs, word_hashes, words

WORDS, PERCENT = 5, 80
#: The global order's fragments, by how many documents have a shingle: 2, 3-4, 5-16, 17 and more.
CUTS = (3, 5, 17)
STARS = 2
#: Rows of a list in one salt, and in one side of a cell of the last round.
SALT, CELL = 512, 4096
_SETS = "doc_id long, n_shingles long, node binary, common long, blob binary"


def _sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    out = []
    for a, b in row_runs(offsets):
        text, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        begins, ends, count = words(text, at, NOT_SPACE)
        h = word_hashes(text, begins, ends)
        grams = h[: max(len(h) - WORDS + 1, 0)]
        for k in range(1, WORDS):
            grams = chain(grams, h[k : len(h) - WORDS + 1 + k])
        first = np.cumsum(count) - count
        for f, n in zip(first.tolist(), count.tolist(), strict=True):
            if n >= WORDS:
                out.append(np.unique(grams[f : f + n - WORDS + 1]))
            elif n:
                whole = mix(np.array([n], np.uint64))
                for x in h[f : f + n]:
                    whole = chain(whole, np.array([x]))
                out.append(whole)
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _numbered(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All distinct shingles, sorted, and the number of each of the sets' entries."""
    codes, unique = pd.factorize(np.concatenate(sets) if sets else np.empty(0, np.uint64))
    order = np.argsort(unique)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return unique[order], rank[codes]


def _ask(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    _, _, data, offsets = open_shard(payload)
    unique, number = _numbered(_sets(data, offsets))
    return unique, np.bincount(number, minlength=len(unique)).astype(np.uint32)


def _told(columns: list[np.ndarray]) -> tuple[list[np.ndarray], int, int]:
    return [np.minimum(columns[1], 0xFFFFFFFF).astype(np.uint32)], 0, 0


def _kept(left: pa.Table, right: pa.Table) -> pa.Table:
    """A row for each document; nodes that may have partners have what is common, rarest first."""
    ids, known, data, offsets = open_shard(left.column("payload")[0].as_py())
    sets = _sets(data, offsets)
    _, number = _numbered(sets)
    answers = keyed.in_order(right.to_pylist())
    times = (np.concatenate([a[0] for a in answers]) if answers else np.empty(0, np.uint32))[number]
    rows, at = [], 0
    for doc, has_id, s in zip(ids.tolist(), known.tolist(), sets, strict=True):
        n, t = len(s), times[at : at + len(s)]
        at += n
        row = {"doc_id": doc if has_id else None, "n_shingles": n, "node": None, "common": None, "blob": None}
        shared = t > 1
        common = int(shared.sum())
        if n and 100 * common >= PERCENT * n:
            order = np.lexsort((s[shared], t[shared]))
            row |= {"node": hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "common": common, "blob": keyed.pack(s[shared][order], t[shared][order])}
        rows.append(row)
    return pa.Table.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("common", pa.int64()), ("blob", pa.binary())]))


_PREFIX = pa.schema([("node", pa.binary()), ("n", pa.int64()), ("common", pa.int64()), ("token", pa.int64()), ("rank", pa.int32()), ("times", pa.int64())])
#: So many of a node's first prefix shingles tell apart the first list that a pair shares.
HEAD = 32


def _prefix(blob: bytes, n: int, common: int) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles and how many documents have each."""
    order, times = keyed.unpack(blob)
    k = n - -(-PERCENT * n // 100) + 1 - (n - common)
    return order[:k].view(np.int64), times[:k].astype(np.int64)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a node's prefix, with its rank there."""
    for batch in batches:
        for node, n, common, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            prefix, times = _prefix(blob, n, common)
            k = len(prefix)
            yield pa.RecordBatch.from_arrays([pa.array([node] * k, pa.binary()), np.full(k, n), np.full(k, common), prefix, np.arange(k, dtype=np.int32), times], schema=_PREFIX)


#: 64-bit words of a node's bitmap.
BITS = 8


def _bitmap(shingles: np.ndarray) -> list[int]:
    """Shingles by the low bits of their hash; bits that differ show shingles that aren't shared."""
    bits = np.zeros(64 * BITS, np.uint8)
    np.bitwise_xor.at(bits, (mix(shingles) % np.uint64(64 * BITS)).astype(np.int64), 1)
    return np.packbits(bits).view(np.int64).tolist()


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wide = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        heads = [_prefix(blob, n, common)[0][:HEAD].tolist() for _, n, common, blob in wide]
        bits = [_bitmap(keyed.unpack(blob)[0]) for *_, blob in wide]
        yield pa.RecordBatch.from_pydict({"node": batch.column(0), "head": pa.array(heads, pa.list_(pa.int64())), "bits": pa.array(bits, pa.list_(pa.int64()))})


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each fragment of the order in which a node has shingles."""
    for batch in batches:
        nodes, numbers, parts = [], [], []
        for node, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            order, times = keyed.unpack(blob.as_py())
            at = [0, *np.searchsorted(times, CUTS).tolist(), len(order)]
            for i in range(len(at) - 1):
                if at[i] < at[i + 1]:
                    nodes.append(node)
                    numbers.append(i)
                    parts.append(order[at[i] : at[i + 1]].view(np.int64))
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.binary()), "fragment": pa.array(numbers, pa.int32()), "part": pa.array(parts, pa.list_(pa.int64()))})


def _fits(n: str, m: str, common_n: str, common_m: str) -> Column:
    """Whether sets of n and m shingles can link, by what each has in common with anything."""
    need = F.lit(PERCENT) * (F.col(n) + F.col(m))
    return (need <= (100 + PERCENT) * F.col(common_n)) & (need <= (100 + PERCENT) * F.col(common_m)) & (100 * F.col(n) >= PERCENT * F.col(m)) & (100 * F.col(m) >= PERCENT * F.col(n))


def links(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """a, b: the classes of those pairs (a, b, na, nb, ra, rb) that link, by the sum of each pair's partial overlaps."""
    x = fragments.select(F.col("node").alias("a"), "fragment", F.col("part").alias("p"))
    y = fragments.select(F.col("node").alias("b"), "fragment", F.col("part").alias("q"))
    partial = pairs.join(x, "a").join(y, ["b", "fragment"]).select("a", "b", "na", "nb", "ra", "rb", "fragment", F.size(F.array_intersect("p", "q")).alias("both"))
    summed = partial.groupBy("a", "b", "na", "nb", "ra", "rb").agg(F.sum("both").alias("overlap"))
    return summed.where((100 + PERCENT) * F.col("overlap") >= PERCENT * (F.col("na") + F.col("nb"))).select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of all nodes of edges (a, b), by rounds of large and small stars."""
    edges = spill(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, spill(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(before)
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def _counted(docs: DataFrame) -> DataFrame:
    """Rows as in _SETS."""
    shards = spill(docs.mapInArrow(text_shards, "shard string, payload binary"), "none")
    counts, n = keyed.exchange(shards, _ask, _told, keyed.buckets(docs)), shards.count()
    rows = spill(keyed.dealt(shards, n, "shard").groupBy("shard").cogroup(keyed.dealt(counts.answers.select("shard", "bucket", "payload"), n, "shard").groupBy("shard")).applyInArrow(_kept, _SETS), "none")
    discard(shards, *counts.spilled)
    return rows


def _salted(summary: DataFrame) -> DataFrame:
    """What is known of a list, for each of its salts; salts: their number."""
    return summary.withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)"))).drop("salts")


def _lists(wide: DataFrame) -> DataFrame:
    """Rows (token, salt, salts, cells, node, n, common, rank, root) of the prefix lists of two nodes and more."""
    rows = wide.mapInArrow(_prefixes, "node binary, n long, common long, token long, rank int, times long")
    rows = rows.select("*", F.expr(f"1 + times div {SALT}").alias("salts"), F.expr(f"1 + times div {CELL}").alias("cells"))
    every = spill(rows.select("*", F.expr("pmod(xxhash64(node), salts)").alias("salt"), F.col("node").alias("root")).drop("times"))
    some = every.groupBy("token").agg(F.count("*").alias("k"), F.max("salts").alias("salts")).where("k > 1").select("token", "salts")
    lists = spill(every.join(_salted(some), ["token", "salt"], "left_semi"))
    discard(every)
    return lists


def classes(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. doc_id, n_shingles, component_id for each row."""
    spark = docs.sparkSession
    rows = _counted(docs.select("doc_id", "text"))
    some = rows.where("node is not null")
    nodes = spill(some.select("node", F.col("n_shingles").alias("n"), "common", "blob").dropDuplicates(["node"]), "none")
    wide = nodes.select("node", "n", "common", "blob")
    lists = _lists(wide)
    heads = wide.mapInArrow(_heads, "node binary, head array<long>, bits array<long>")
    fragments = spill(nodes.select("node", "blob").mapInArrow(_fragments, "node binary, fragment int, part array<long>"), "none")
    member = spill(some.groupBy("node").agg(F.min("doc_id").alias("first")).withColumn("root", F.col("node")))

    for turn in range(STARS + 1):
        if turn < STARS:
            # each node goes to the leader with which it shares most lists; leaders have most in common with others
            leader = lists.groupBy("token").agg(F.max("salts").alias("salts"), F.max(F.struct((F.col("common") * 1000 / F.col("n")).cast("long").alias("rank"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "common", "root")).alias("l"))
            leader = _salted(leader.select("token", "salts", F.col("l.node").alias("b"), F.col("l.n").alias("nb"), F.col("l.common").alias("cb"), F.col("l.root").alias("rb")))
            met = lists.join(leader, ["token", "salt"]).where((F.col("root") != F.col("rb")) & _fits("n", "nb", "common", "cb"))
            best = met.groupBy(F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), "b", "nb", "rb").count().groupBy("a", "na", "ra").agg(F.max(F.struct("count", "b", "nb", "rb")).alias("x"))
            pairs = best.select("a", "na", "ra", "x.b", "x.nb", "x.rb")
        else:
            left = spill(lists.join(heads, "node").withColumn("earlier", F.expr("slice(head, 1, rank)")).withColumn("cell", F.expr("pmod(xxhash64(node, 1), cells)")).drop("head"))
            other = F.explode(F.expr("sequence(0L, cells - 1)"))
            right = left.select("token", other.alias("cell_a"), F.col("cell").alias("cell_b"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("common").alias("cb"), F.col("root").alias("rb"), F.col("earlier").alias("eb"), F.col("bits").alias("bb"))
            # shingles in one of the two only: at least those that occur nowhere else, and the bits that differ
            apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bb")[i])) for i in range(BITS)), F.col("n") - F.col("common") + F.col("nb") - F.col("cb"))
            near = apart * (100 + PERCENT) <= (F.col("n") + F.col("nb")) * (100 - PERCENT)
            # a pair of different classes' nodes is met in the first list that both are in
            met = left.select("*", F.col("cell").alias("cell_a"), other.alias("cell_b")).join(right, ["token", "cell_a", "cell_b"])
            condition = (F.col("root") < F.col("rb")) & _fits("n", "nb", "common", "cb") & near & ~F.arrays_overlap("earlier", "eb")
            pairs = met.where(condition).select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), "b", "nb", "rb").distinct()
        pairs = spill(pairs)
        new = spill(links(pairs, fragments))
        discard(pairs)
        if turn == STARS:
            discard(left)
        if new.isEmpty():
            discard(new)
            continue
        moved = components(new).select(F.col("node").alias("root"), F.col("root").alias("_to"))
        was, member = member, spill(member.join(moved, "root", "left").select("node", "first", F.coalesce("_to", "root").alias("root")))
        discard(was, new)
        if turn < STARS:  # only lists that still hold different classes go on
            renamed = spill(lists.join(moved, "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to"))
            mixed = renamed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("salts").alias("salts")).where("lo != hi").select("token", "salts")
            was, lists = lists, spill(renamed.join(_salted(mixed), ["token", "salt"], "left_semi"))
            discard(was, renamed)

    root = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = member.select("node", "root").join(root, "root").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    out = spill(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    discard(rows, nodes, lists, fragments, member)
    return out


def sql() -> str:
    """The same in DuckDB's SQL, every pair that shares a shingle compared."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY ALL"""
