import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliospark.llm import packing, token_codec
from foliospark.llm.token_ids import Encoder

ODD = ["", None, "a  b", " x ", "\n\n", "don't stop, now. É é.", "<|endoftext|> x<|endoftext|>", "a  b \x85 c", "\x1c d", "w" * 3000, "1 2 3 " * 700, "日本 語。 x", "a\x0bb,"]
SCHEMA = "doc_id long, text string, start string, n_tokens int"
crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())


@given(st.lists(st.text(alphabet=st.sampled_from("ab.,! \n\t é<|>'s1"), max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_the_librarys(name, spaces, texts):
    path = public_tokenizers.path(name)
    texts = [*texts, *ODD]
    ids, n = Encoder(path, spaces)(pa.array(texts, pa.string()), 7)
    want = [e.ids + [7] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert n.tolist() == list(map(len, want))
    assert ids.tolist() == [i for w in want for i in w]


class Counted:
    """A tokenizer that knows how many texts it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **how)


@pytest.mark.parametrize("known", [True, False])
def test_new_stretches_go_to_the_library_together(known):
    """One by one they cost most of op4's time. A vocabulary whose bytes don't add up has them go one by one, with the same ids."""
    rng = np.random.default_rng(3)
    texts = ["".join(f"{gap}{w:x}{stop}" for gap, w, stop in zip(rng.choice([" ", "  ", "\n\n", "\t ", "\r\x0b"], 3000), rng.integers(0, 1 << 40, 3000), rng.choice(["", ",", ".", "é", "'s", "<|endoftext|>"], 3000), strict=True)) + " " for _ in range(2)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = Encoder(path, True)
    encoder.tokenizer = Counted(encoder.tokenizer)
    if not known:
        encoder.bytes[::2] += 1
    ids, n = encoder(pa.array(texts), 7)
    want = [e.ids + [7] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert (encoder.tokenizer.texts < 50) == known and encoder.n > 5000


@given(st.lists(st.integers(1, 5000), min_size=1, max_size=300), st.integers(1, 1000))
@settings(max_examples=40, deadline=None)
def test_ids_are_found_by_their_intervals(sizes, times):
    model = token_codec.Model(len(sizes))
    model.single = np.array(sizes, np.int64) * times
    model._sum()
    v = np.unique(np.concatenate([model.upto[:-1], model.upto[1:] - np.uint64(1), np.random.default_rng(0).integers(0, int(model.upto[-1]), 99).astype(np.uint64)]))
    assert (model.find(v) == np.searchsorted(model.upto, v, "right") - 1).all()


@given(st.integers(0, 3000), st.integers(1, 60000), st.integers(0, 9))
@settings(max_examples=25, deadline=None)
def test_round_trip(n, top, seed):
    ids = (np.random.default_rng(seed).zipf(1.3, n) % top).astype(np.uint32)
    assert (token_codec.decode(token_codec.encode(ids)) == ids).all()


def test_copies_cost_little_and_damage_is_found():
    ids = np.tile(np.random.default_rng(1).integers(0, 50000, 300), 300).astype(np.uint32)
    block = token_codec.encode(ids)
    assert len(block) < 2 * len(ids)
    with pytest.raises(ValueError):
        token_codec.decode(block[:-3] + b"abc")


def encoded(rows, name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [end]) for i, x in rows]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("empty", "group"), [(False, 4096), (False, 2), (True, 2)])
def test_file(spark, sf_dir, empty, group, monkeypatch):
    rows = [] if empty else [*((5, f"hot {k}") for k in range(300)), *((None, f"{k}") for k in range(99)), *enumerate(ODD, 10**6), (None, "n"), (5, "b c"), (5, "a"), *map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id > 5").select("doc_id", "text").collect())]
    monkeypatch.setattr(token_codec, "GROUP", group)
    got = sorted(map(tuple, token_codec.digest(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect()), key=lambda r: r[1])
    ids = [(i, len(x), crc(x)) for i, x in encoded(rows, "byte_bpe_50k.json", 2)]
    assert sorted(((r[0], *r[2:]) for r in got), key=str) == sorted(ids, key=str)
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]


@pytest.mark.parametrize("empty", [False, True])
def test_packing(spark, sf_dir, empty):
    rows = [] if empty else [*enumerate(ODD, 10**6), (None, "n"), (10**7, "a b " * 9000), *map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())]
    got = packing.pack(frame(spark, rows), public_tokenizers.path("word_bpe_49k.json")).collect()
    docs, bins = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    want = dict(encoded(rows, "word_bpe_49k.json", 1))
    assert docs.keys() == want.keys()
    for i, ids in want.items():
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    short = 0
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.CAPACITY
        short += at < packing.CAPACITY
    assert short <= 1


@given(st.lists(st.integers(1, 6000), max_size=300), st.integers(0, 9))
@settings(max_examples=40, deadline=None)
def test_classes_bins(sizes, base):
    """Every id once; a bin of class k begins with k whole documents of the class, and documents up to the capacity stay whole but for those that close a bin."""
    packer = packing.Packer(base)
    for d, n in enumerate(sizes):
        packer.add(d, 0, np.arange(n, dtype="<u4").tobytes(), n)
        assert len(packer.waiting) <= packing.WAITING and all(len(b.pieces) < k for k, b in packer.open.items())
        assert all(b.pieces and packing.CAPACITY // (len(b.pieces[0][2]) // 4) <= len(b.pieces) for b in packer.waiting)
    closed = list(packer.rows)
    for seq in {r[5] for r in closed}:
        pieces = [r for r in closed if r[5] == seq]
        k = packing.CAPACITY // pieces[0][2]
        assert sum(r[2] for r in pieces) == packing.CAPACITY and all(packing.CAPACITY // r[2] == k for r in pieces[:k])
    packer.string_together()
    length = defaultdict(int)
    for r in sorted(packer.rows, key=lambda r: (r[0], r[1])):
        assert r[1] == length[r[0]]
        length[r[0]] += r[2]
    assert dict(length) == dict(enumerate(sizes)) and packer.next - base == -(-sum(sizes) // packing.CAPACITY)


def test_pieces_are_long(spark, sf_dir):
    got = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert np.median([r.length for r in got]) > 256 and np.mean([r.length <= 16 for r in got]) < 0.06


def test_repeated_rows_are_packed_twice(spark):
    got = packing.pack(frame(spark, [(1, "a b"), (1, "a b")]), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(r.length for r in got) == 2 * got[0].doc_tokens
