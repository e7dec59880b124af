"""Language-model scoring with a weighted backoff automaton.

States are histories of up to ORDER - 1 words that training saw; an arc of a state is a word that training saw after it,
with the log-probability of that word there, and leads to the longest state that ends with that word. Where a state has
no arc for a word, its failure arc leads to the history without its first word, at the price of the backoff weight. One
pass from left to right carries the state over the tokens of a text and adds up the weights that it meets (`walk`). The
n-grams are smoothed by Dirichlet priors: with h' for h without its first word,

    P(w | h) = (c(h, w) + MU * P(w | h')) / (c(h) + MU),   P(w) = (c(w) + 1) / (N + V + 1)

so the failure weight of h is MU / (c(h) + MU), and all words, with one unknown, sum to 1 after every history. MU falls
with the order: long histories say more.

Counts cover every training document and never stand in one place: shards of documents ask the buckets of ``keyed`` for
the sums of their own distinct words, pairs and triples, and build the part of the automaton that their texts can reach.
What is gathered grows with the input; a task holds a shard or a bucket, both bounded.

Defined results: a null or empty text is the end token alone; a null doc_id counts as the id ''; repeated rows are
scored, and learnt, as often as they occur; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import keyed
from .common import discard, spill
from .textbytes import NOT_SPACE, chain, column_bytes, row_runs, word_hashes, words

ORDER = 3
#: The priors of pairs and triples, chosen on held-out texts.
MU = (0.0, 1000.0, 8.0)
FOLDS, HELD_OUT = 7, 2
SHARD_TOKENS = 1_000_000
BUCKET_BYTES = 4 << 20
#: Tokens that one lane of the walk scores.
LANE = 256
START, END = np.uint64(0x5BD1E995A5A5A5A5), np.uint64(0x1B873593C3C3C3C3)
#: The lowest bit of a key tells words from longer n-grams.
_WORD = np.uint64(1)
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_backoffs long"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as numbers of words: ids, lengths, word numbers, and the sorted hashes that they number."""
    from pyspark import TaskContext

    part, n, ids, sizes, hashes, held = TaskContext.get().partitionId(), 0, [], [], [], 0

    def row() -> pa.RecordBatch:
        every = np.concatenate(hashes)
        codes, unique = pd.factorize(every)
        order = np.argsort(unique)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        known = np.array([i is not None for i in ids], np.uint8)
        payload = keyed.pack(np.array([i or 0 for i in ids], np.int64), known, np.concatenate(sizes).astype(np.uint32), rank[codes], unique[order])
        return pa.RecordBatch.from_pydict({"shard": [f"{part}-{n}"], "payload": [payload]})

    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        doc_ids = batch.column(0).to_pylist()
        for a, b in row_runs(offsets):
            text, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            begins, ends, count = words(text, at, NOT_SPACE)
            tokens = np.full(len(begins) + b - a, END, np.uint64)
            last = np.cumsum(count + 1) - 1
            spot = np.ones(len(tokens), bool)
            spot[last] = False
            tokens[spot] = word_hashes(text, begins, ends) | _WORD
            ids += doc_ids[a:b]
            sizes.append(count + 1)
            hashes.append(tokens)
            held += len(tokens)
            if held >= SHARD_TOKENS:
                yield row()
                n, ids, sizes, hashes, held = n + 1, [], [], [], 0
    if ids:
        yield row()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the number of each, and where each occurs."""
    codes, unique = pd.factorize(keys)
    order = np.argsort(unique)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    number = rank[codes]
    place = np.empty(len(unique), np.int64)
    place[number] = np.arange(len(number))
    return unique[order], number, place


class Shard:
    """A shard's tokens, and the n-grams that it asks for."""

    def __init__(self, payload: bytes) -> None:
        ids, known, self.sizes, word, self.words = keyed.unpack(payload)
        self.ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.out = np.array([held_out(i) for i in self.ids], bool)
        self.word = word.astype(np.int64)
        self.first = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.train = np.repeat(~self.out, self.sizes)
        here = self.words[self.word]
        before = np.empty_like(here)
        before[1:] = here[:-1]
        before[self.first] = START
        both = chain(before, here)
        self.pairs, self.pair, self.pair_at = _distinct(both & ~_WORD)
        #: Places of triples: all but each text's first.
        inner = np.ones(len(here), bool)
        inner[self.first] = False
        self.inner = np.flatnonzero(inner)
        self.triples, self.triple, at = _distinct(chain(both[self.inner - 1], here[self.inner] ^ _WORD) & ~_WORD)
        self.triple_at = self.inner[at]
        self.keys = np.concatenate([self.words, self.pairs, self.triples])

    def request(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys, sorted, and how often training tokens of this shard are each of them."""
        counts = [np.bincount(n[t], minlength=len(k)) for n, t, k in ((self.word, self.train, self.words), (self.pair, self.train, self.pairs), (self.triple, self.train[self.inner], self.triples))]
        order = np.argsort(self.keys, kind="stable")
        return self.keys[order], np.concatenate(counts)[order].astype(np.uint32)

    def counts(self, answers: list[list[np.ndarray]]) -> list[np.ndarray]:
        """The corpus' counts of this shard's words, pairs and triples."""
        out = np.empty(len(self.keys), np.int64)
        out[np.argsort(self.keys, kind="stable")] = np.concatenate([a[0] for a in answers])
        return np.split(out, [len(self.words), len(self.words) + len(self.pairs)])

    def automaton(self, words_: np.ndarray, pairs: np.ndarray, triples: np.ndarray, starts: int, tokens: int, types: int) -> Automaton:
        """Of the shard's n-grams with those counts."""
        w = len(words_)
        last = self.word[self.pair_at]
        opens = np.zeros(len(self.word), bool)
        opens[self.first] = True
        # the pair's history: a word, or the start
        ahead = np.where(opens[self.pair_at], w, self.word[self.pair_at - 1])
        third = self.triple_at
        return Automaton(words_, (ahead, last, pairs), (self.pair[third - 1], self.pair[third], self.word[third], triples), starts, tokens, types)


class Automaton:
    """States: 0 has no history, then a word each, the start of a text, and a pair of words each."""

    def __init__(self, words_: np.ndarray, pairs: tuple[np.ndarray, ...], triples: tuple[np.ndarray, ...], starts: int, tokens: int, types: int) -> None:
        """words_: counts by number; pairs: history's word (their number: the start), word, count; triples: history's pair, the pair that it ends with, word, count; starts: training texts."""
        w, (ahead, last, two), (of, to, third, three) = len(words_), pairs, triples
        self.start, first_pair = w + 1, w + 2
        history = np.concatenate([[0], words_, [starts], two]).astype(float)
        price = np.where(np.arange(len(history)) < first_pair, MU[1], MU[2])
        self.backoff = np.log10(price / (history + price))
        self.fail = np.concatenate([np.zeros(w + 2, np.int64), last + 1])
        one = (words_ + 1.0) / (tokens + types + 1.0)
        chance2 = (two + MU[1] * one[last]) / (history[ahead + 1] + MU[1])
        chance3 = (three + MU[2] * chance2[to]) / (two[of] + MU[2])
        self.root, self.after_root = np.log10(one), np.where(words_ > 0, np.arange(w) + 1, 0)
        some2, some3 = two > 0, three > 0
        key = np.concatenate([(ahead[some2] + 1) << 32 | last[some2], (of[some3] + first_pair) << 32 | third[some3]])
        order = np.argsort(key)
        self.arc = key[order]
        self.weight = np.log10(np.concatenate([chance2[some2], chance3[some3]]))[order]
        self.next = np.concatenate([np.flatnonzero(some2), to[some3]])[order] + first_pair

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states after a word each, the weights on the way, and the failure arcs taken."""
        state, weight, failed = state.copy(), np.zeros(len(word)), np.zeros(len(word), np.int64)
        todo = np.flatnonzero(state)
        done = np.zeros(len(word), bool)
        while len(todo):
            key = state[todo] << 32 | word[todo]
            at = np.searchsorted(self.arc, key)
            found = np.zeros(len(todo), bool)
            inside = at < len(self.arc)
            found[inside] = self.arc[at[inside]] == key[inside]
            hit, at, miss = todo[found], at[found], todo[~found]
            weight[hit] += self.weight[at]
            state[hit], done[hit] = self.next[at], True
            weight[miss] += self.backoff[state[miss]]
            failed[miss] += 1
            state[miss] = self.fail[state[miss]]
            todo = miss[state[miss] > 0]
        rest = np.flatnonzero(~done)
        weight[rest] += self.root[word[rest]]
        state[rest] = self.after_root[word[rest]]
        return state, weight, failed

    def walk(self, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of each token, and its failure arcs; first: where texts begin. Lanes of LANE tokens go side by side.

        A lane within a text reads the ORDER - 1 words before it from the state without history, which leads to the
        state that the words from the text's start would: a state is the longest known history.
        """
        size = np.diff(np.append(first, len(word)))
        lanes = -(-size // LANE)
        k = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = np.repeat(first, lanes) + k * LANE
        end = np.minimum(begin + LANE, np.repeat(first + size, lanes))
        state = np.where(k == 0, self.start, 0)
        for back in range(ORDER - 1, 0, -1):
            inner = np.flatnonzero(k)
            state[inner] = self.step(state[inner], word[begin[inner] - back])[0]
        weight, failed = np.zeros(len(word)), np.zeros(len(word), np.int64)
        order = np.argsort(begin - end, kind="stable")  # longest first
        begin, state, length = begin[order], state[order], (end - begin)[order]
        for t in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -t, "left"))  # lanes that still have a token
            here = begin[:n] + t
            state[:n], weight[here], failed[here] = self.step(state[:n], word[here])
        return weight, failed


def _total(columns: list[np.ndarray]) -> tuple[list[np.ndarray], int, int]:
    """A bucket's counts; how many tokens its words are, and how many words training has."""
    words_ = columns[1][(columns[0] & _WORD) > 0]
    return [columns[1]], int(words_.sum()), int((words_ > 0).sum())


def _scored(tokens: int, types: int, starts: int):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = Shard(left.column("payload")[0].as_py())
        words_, pairs, triples = shard.counts(keyed.in_order(right.to_pylist()))
        model = shard.automaton(words_, pairs, triples, starts, tokens, types)
        weight, failed = model.walk(shard.word, shard.first)
        each = lambda x: np.add.reduceat(x, shard.first)
        return pa.table({"doc_id": pa.array(shard.ids, pa.int64()), "held_out": shard.out, "n_tokens": shard.sizes.astype(np.int64), "n_known": each((words_ > 0)[shard.word].astype(np.int64)), "train_tokens": np.full(len(shard.ids), tokens, np.int64), "base_score": each(model.root[shard.word]), "score": each(weight), "n_backoffs": each(failed)})

    return score


def score(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. A row for each document, as in SCORES."""
    docs = docs.select("doc_id", "text")
    shards = spill(docs.mapInArrow(_shards, "shard string, payload binary"), "none")
    found = keyed.exchange(shards, lambda payload: Shard(payload).request(), _total, keyed.buckets(docs, limit=BUCKET_BYTES))
    answers = spill(found.answers, "none")
    tokens, types = (answers if len(found.spilled) == 0 else found.totals).agg(F.sum("a"), F.sum("b")).first()
    discard(*found.spilled)
    starts = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD_OUT).count()
    n = shards.count()
    out = keyed.dealt(shards, n, "shard").groupBy("shard").cogroup(keyed.dealt(answers.select("shard", "bucket", "payload"), n, "shard").groupBy("shard")).applyInArrow(_scored(int(tokens or 0), int(types or 0), starts), SCORES)
    out = spill(out)
    discard(shards, answers)
    return out
