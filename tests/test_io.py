import json

import numpy as np
import pytest

from foliospark.operators import images
from foliospark.sources import ocr, readers, writers
from foliospark.streaming import queue


def test_queue_states():
    events = [(1, "new", "BERHASIL", "u"), (2, "new", "BERHASIL", "u"), (3, "save", None, None), (4, "reset", None, None), (5, "new", "RUSAK", "u"), (6, "new", "BERHASIL", " ")]
    assert list(queue.fold(events)) == [(1, "process", "PENDING"), (2, "none", "PENDING"), (3, "ack", "ACKED"), (4, "reset", "NEW"), (5, "ack", "ACKED"), (6, "none", "ACKED")]
    assert [queue.step("NEW", "new", o, u) for o, u in (("GAGAL", "u"), ("DIHENTIKAN", "u"), ("BERHASIL", ""))] == [("NEW", "ack"), ("NEW", "none"), ("SKIPPED", "skip")]


def test_stream(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 9)), i, str(rng.choice(["new", "new", "save", "reset"])), str(rng.choice(["BERHASIL", "RUSAK"])), str(rng.choice(["u", " "]))) for i in range(120)]
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], queue.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        queue.drain(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    done = spark.read.parquet(str(tmp_path / "out")).select("id", "seq", "action", "state")
    want = sorted((i, *f) for i in {r[0] for r in rows} for f in queue.fold([r[1:] for r in rows if r[0] == i]))
    assert sorted(map(tuple, done.collect())) == want
    assert queue.counters(done).first().fetched == 120


def test_readers(spark, tmp_path):
    (tmp_path / "links.json").write_text('[{"id":"1","url":"u","nama":"n"}]')
    assert readers.links(spark, str(tmp_path / "links.json")).first().nama == "n"
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 /Type /Page /Type /Page (hello) TJ /XObject")
    r = readers.pdfs(spark, str(tmp_path)).first()
    assert (r.version, r.pages, r.image_score) == ("1.4", 2, 1 - 1 - 5)
    for name, text in (("d.txt", "h"), ("d.gt.txt", "r"), ("e.txt", "x")):
        (tmp_path / name).write_text(text)
    assert [tuple(x) for x in readers.pairs(spark, str(tmp_path)).collect()] == [("d", "h", "r")]
    item = {"id": 1, "url": " ", "file_url": "/x.pdf"}
    for payload, n in ((json.dumps([item]), 1), (json.dumps({"data": [item]}), 1), (json.dumps({"result": [item, item]}), 2), ("{}", 0), ("oops", 0)):
        df = spark.createDataFrame([(payload,)], "p string")
        assert len(df.select(readers.items(df.p).alias("i")).first().i) == n
    got = spark.range(1).select(readers.items(readers.F.lit(json.dumps([item]))).alias("i")).selectExpr("inline(i)").select(readers.address("https://b/").alias("a")).first()
    assert got.a == "https://b/x.pdf"


def test_retry():
    tries, waits = [], []

    def f():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("x")
        return 7

    assert readers.with_retry(f, 3, 2, waits.append) == 7 and waits == [2, 4]
    with pytest.raises(OSError):
        readers.with_retry(lambda: (_ for _ in ()).throw(OSError("y")), 2, 0, waits.append)


def test_ledger_and_sinks(spark, tmp_path):
    ledger = spark.createDataFrame([(1, "h1", "BERHASIL", "t"), (2, "h2", "GAGAL", None)], "id int, file_hash string, status string, output_text string")
    new = spark.createDataFrame([("h1", "BERHASIL", "t"), ("h2", "BERHASIL", "t"), ("h3", "BERHASIL", "t"), ("h3", "BERHASIL", "t")], "file_hash string, status string, output_text string")
    out = writers.saved(ledger, new)
    assert sorted((r.id, r.file_hash) for r in out.collect())[:2] == [(1, "h1"), (2, "h2")]
    assert sorted(r.id for r in out.collect()) == [1, 2, 3, 4]
    assert writers.deleted(ledger, spark.createDataFrame([(1,)], "id int")).count() == 1
    writers.csv_report(spark.createDataFrame([(1, "b"), (0, "a")], "place int, value string"), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text(encoding="utf-8")
    assert text == "﻿a\nb\n"
    writers.text_cache(spark.createDataFrame([("f", "x"), ("g", " ")], "file_name string, text string"), str(tmp_path / "cache"))
    assert [p.name for p in (tmp_path / "cache").iterdir() if p.is_dir()] == ["file_name=f"]


class Fake:
    def __init__(self, word, confidence):
        self.word, self.confidence = word, confidence

    def recognise(self, image, width, height):
        if image == b"bad":
            raise ValueError("broken page")
        return [{"text": self.word, "confidence": self.confidence, "x": 0.0, "y": 0.0, "w": 1.0, "h": 1.0}]


def test_engines(spark):
    ocr.register("paddle", lambda: Fake("p", 0.5))
    ocr.register("surya", lambda: Fake("s", 0.2))
    assert ocr.candidates() == ["surya", "paddle"] and ocr.candidates("paddle") == ["paddle", "surya"]
    with pytest.raises(ValueError):
        ocr.candidates("tesseract", fallback=False)
    pages = spark.createDataFrame([(1, 0, b"ok", 1, 1), (1, 1, b"bad", 1, 1)], "doc_id long, page int, image binary, width int, height int")
    cls = type("Local", (), {k: v for k, v in Fake.__dict__.items() if k in ("__init__", "recognise")})
    got = ocr.blocks(pages, [lambda: cls("s", 0.2), lambda: cls("p", 0.5)], lambda b: bool(b) and b[0]["confidence"] > 0.9).collect()
    assert sorted((r.page, r.text, r.error) for r in got) == [(0, "p", None), (1, None, "broken page")]


def test_images():
    assert images.regions(images.drawn(1)) and images.regions(images.drawn(1), wired=True)
    assert images.regions(images.drawn(0)) == [] and images.regions(images.drawn(2), wired=True) == []
    assert images.regions(images.drawn(3)) and images.regions(images.drawn(3), wired=True) == []
    assert abs(images.hough_skew(images.drawn(4)) - 3) < 0.6 and images.hough_skew(images.drawn(0)) is None
    assert images.projection_skew(images.drawn(0)) is None
    page = np.full((20, 20), 255, np.uint8)
    page[5] = 0
    assert images.otsu(page) >= 0 and (images.mirrored(page) == page).all() and (images.rotated(page, 0) == page).all()
    page[10, 10] = 0
    assert images.median(page)[10, 10] == 255 and images.gray(np.full((2, 2, 3), 255))[0, 0] == 255


@pytest.fixture(scope="module")
def drawn_pages():
    r = np.random.default_rng(2)
    texts = [["".join(r.choice(list("abc xyzé. "), int(n))) for n in r.integers(0, 200, 9)] for _ in range(12)]
    return [images.page(t) for t in [*texts, [], [""]]]


def test_pages_show_every_character():
    a, b = images.page(["x" * 300 + "a"]), images.page(["x" * 300 + "b"])
    assert a.shape == b.shape and (a != b).any()
    assert images.page([]).min() == 255 or images.page([]).shape == (80, 160)


def test_kernels_against_brute_force(drawn_pages):
    for p in drawn_pages:
        h, w = p.shape
        t = images.tinted(p)
        assert images.gray(t)[3, 5] == round(0.299 * t[3, 5, 0] + 0.587 * t[3, 5, 1] + 0.114 * t[3, 5, 2])
        best, at = -1.0, 128
        flat = p.ravel().astype(float)
        for k in range(256):
            low, high = flat[flat <= k], flat[flat > k]
            if len(low) and len(high):
                v = len(low) * len(high) * (low.mean() - high.mean()) ** 2
                best, at = (v, k) if v > best * (1 + 1e-12) or abs(v - best) <= 1e-9 * max(v, 1) else (best, at)
        assert images.otsu(p) == at
        m, up = images.median(p), images.upscaled(p, 2)
        for y, x in np.random.default_rng(1).integers(1, [h - 1, w - 1], (40, 2)):
            assert m[y, x] == sorted(p[y - 1 : y + 2, x - 1 : x + 2].ravel())[4]
            near = lambda v, n: (int(np.floor(max((v + 0.5) / 2 - 0.5, 0))), min(int(np.floor(max((v + 0.5) / 2 - 0.5, 0))) + 1, n - 1), max((v + 0.5) / 2 - 0.5, 0) % 1)
            (a, b, f), (c, d, g) = near(y, h), near(x, w)
            want = (p[a, c] * (1.0 - g) + p[a, d] * g) * (1 - f) + (p[b, c] * (1.0 - g) + p[b, d] * g) * f
            assert abs(float(up[y, x]) - want) <= 0.5 + 1e-9
        assert (images.mirrored(p) == np.array([row[::-1] for row in p])).all()
        assert (images.rotated(p, 180) == p[::-1, ::-1]).mean() > 0.99
        dark = [y for y in range(h) if (p[y] < min(images.otsu(p) + 1, 255)).mean() > 0.6]
        assert all(y in dark for y in images.lines(p, 1))
        assert len(images.lines(p, 1)) == sum(y - 1 not in dark for y in dark)


def test_deskew_router():
    ruled = np.full((300, 300), 255, np.uint8)
    for y in range(20, 290, 30):
        ruled[y : y + 4, 10:290] = 0
    tilted = images.rotated(ruled, 4.0)
    assert abs(images.hough_skew(tilted) - 4) < 1 and abs(images.projection_skew(tilted) - 4) < 1
    assert images.deskewed(tilted, osd=lambda p: (90, 0.9))[1] == "osd"
    straight, by = images.deskewed(tilted, osd=lambda p: (90, 0.1))
    assert by == "hough" and abs(images.hough_skew(straight) or 0) < 1
    assert images.deskewed(tilted, "tesseract", osd=lambda p: None)[1] == "none"
    assert images.deskewed(images.drawn(0), "hough", sidecar=lambda p: (12.0, 0.5))[1] == "sidecar"
    assert images.deskewed(images.drawn(0))[1] == "none"
    assert images.deskewed(images.rotated(ruled, -3.0), "projection")[1] == "projection"
    assert images.hough(images.drawn(4))[1] > 0
