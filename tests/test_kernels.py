import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.operators import kernels as k


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("T E SALINAN L R 3 1 E 5. E BUPATI DAIRI", "SALINAN BUPATI DAIRI"),
        ("kota kecil Kota 1 1 T T 1 1 Dinas Lingkungan", "kota kecil Kota Dinas Lingkungan"),
        ("b. I Kelurahan Batang Beruh", "b. Kelurahan Batang Beruh"),
        ("NOMOR20 TAHUN2020", "NOMOR 20 TAHUN 2020"),
        ("NOMOR4TAHUN 2020", "NOMOR 4 TAHUN 2020"),
        ("BABI KETENTUAN", "BAB I KETENTUAN"),
        ("BABINSA desa", "BABINSA desa"),
        ("L SAL.INAN T BUPATI DAIRI", "L SALINAN T BUPATI DAIRI"),
        ("bcdfg hjklm npqrs tvwxz bcdfg", ""),
        ("", ""),
    ],
)
def test_clean_line(line, want):
    assert k.clean_line(line) == want


def test_clean_text_and_garbage():
    assert k.clean_text("Bupati menetapkan\n国 国 ∪\nkota kecil Kota 1 1").split("\n")[1] == ""
    assert sum(map(k.is_garbage, "Bupati 国 ∪ menetapkan ν1".split())) == 3
    assert not any(map(k.is_garbage, ["desa", "2020", "Rp5.000", "1.000", "tahun2020", ""]))


@pytest.mark.parametrize(("line", "want"), [("Dala m", "Dalam"), ("kerjasa ma", "kerjasama"), ("Ta mbahan", "Tambahan"), ("di mana", "di mana"), ("peraturan daerah", "peraturan daerah"), ("pa jak retribu si hu kum alo kasi", "pajak retribusi hukum alokasi")])
def test_merge(line, want):
    assert k.merged_line(line) == want


def test_merge_with_document():
    assert k.merged_line("kerja sama", {"kerjasama"}) == "kerjasama"
    assert k.split_words("Dala m kerjasa ma") == 2


@pytest.mark.parametrize(("line", "want"), [("se:besar-besarnyva", "sebesar-besarnya"), ("¿udalah", "sudah"), ("lkegiatan", "kegiatan"), ("YANCMAHA ESA", "YANG MAHA ESA"), ("Fasal 5", "Pasal 5")])
def test_typos(line, want):
    assert k.fixed_typos(line) == want


def test_layout():
    a, b = {"page": 0, "x": 0, "y": 50, "w": 10, "h": 10}, {"page": 0, "x": 0, "y": 10, "w": 10, "h": 10}
    assert k.reading_order([a, b]) == [b, a]
    assert [len(r) for r in k.grid_rows([a, {**a, "x": 30}, b])] == [1, 2]
    row = lambda y: [{"x": x, "y": y, "w": 20, "h": 10} for x in (0, 50)]
    assert k.geometric_tables([row(y) for y in range(5)]) == [[1, 2, 3, 4]]
    assert k.box([1.5, 2.5, 10, 20], 100, 100) == (1, 2, 9, 18) and k.box(None, 7, 8) == (0, 0, 7, 8)
    assert k.box({"left": 1, "top": 1, "width": 5, "height": 5}, 4, 9) == (1, 1, 3, 5) and k.box([[0, 0], [5, 0], [5, 6], [0, 6]], 9, 9) == (0, 0, 5, 6)


def test_tree_and_structure():
    assert k.parents(["title", "bab", "pasal", "ayat", "pasal", "table", "bab", "pasal"]) == [None, None, 1, 2, 1, None, None, 6]
    assert k.hierarchy([1, 3, 9, 3]) == [None, 0, 1, 0]
    assert k.serialised(["BAB", "PASAL", "AYAT"], ["BAB I", "Pasal 1", "(1) a"]) == "\nBAB I\n=====\n\nPasal 1\n\n  (1) a\n\n"
    tree = json.loads(k.nested("t", ["bab", "pasal"], ["I", "1"], ["BAB I", "Pasal 1"]))
    assert tree["version"] == "1.0" and tree["children"][0]["children"][0]["number"] == "1"
    assert [k.roman(x) for x in ("IV", "XC", "12", "ABC", "")] == [4, 90, 12, None, None]


def test_tables():
    assert k.ascii_grid([["a", "bb"], ["c"]]) == "+---+----+\n| a | bb |\n+---+----+\n| c |    |\n+---+----+"
    assert len(k.ascii_grid([["x" * 80]]).split("\n")[1]) <= 62
    assert k.table_wins("NO URAIAN JUMLAH 1 pajak 2.000", []) and not k.table_wins("None None None a", []) and not k.table_wins("a b", [])


def test_truncated_rows():
    long_ = "satu dua tiga empat lima enam tujuh delapan sembilan sepuluh"
    assert k.without_truncated([long_, "satu dua tiga empat lima", "lain saja"]) == [long_, "lain saja"]


@given(st.text(alphabet="abc", max_size=8), st.text(alphabet="abc", max_size=8))
@settings(max_examples=80, deadline=None)
def test_edits(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            rows[i].append(min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y)))
    assert k.edits(list(a), list(b)) == rows[-1][-1]
    assert np.isclose(k.wer("a b", "a c"), 0.5)


def test_queries_run(spark, sf_dir):
    for name, q in k.queries().items():
        assert q(spark, sf_dir).limit(3).collect(), name


def test_flattened_walks_the_tree():
    import random

    r = random.Random(4)
    for _ in range(60):
        kinds = [r.choice(["title", "bab", "bagian", "pasal", "ayat", "huruf", "angka", "table", "paragraph"]) for _ in range(r.randrange(14))]
        up = k.parents(kinds)

        def walk(node):
            return [n for i, p in enumerate(up) if p == node for n in [i, *walk(i)]]  # noqa: B023

        assert k.flattened(kinds) == walk(None)
