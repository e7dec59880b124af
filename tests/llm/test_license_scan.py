import pytest

from foliospark.llm import license_scan as s


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, labels string")
    return [r.asDict() for r in s.scan(docs.coalesce(1)).collect()]


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this {} to deal in the Software without restriction"


@pytest.mark.parametrize(
    ("text", "base", "labels"),
    [
        ("CC-BY. cc by", 2, "cc-by"),
        ("acc by ccby cc\x00by", 1, "cc-by"),
        ("GNU General Public License, General Public Licenses", 1, "gpl"),
        ("All rights reserved. Copyright (c) 2020 Some One, all rights reserved", 2, "copyright,reserved"),
        ("This work is licensed under the GNU General Public License, version 3.", 1, "gpl,gpl-notice"),
        ("Licensed under CC BY-NC 4.0.", 1, "cc-by,cc-by-nc"),
        ("licensed under cc by 4.0", 1, "cc-by,cc-by-4.0"),
        (MIT.format("software and associated documentation files"), 0, "mit"),
        (MIT.format("software").replace("hereby ", ""), 0, ""),
        (MIT.format("a " * 13), 0, ""),
        ("ééé all rights reserved", 1, "reserved"),
    ],
)
def test_texts(spark, text, base, labels):
    (r,) = run(spark, [(1, text)])
    assert (r["n_base"], r["labels"]) == (base, labels)


def test_places_and_odd_rows(spark):
    got = run(spark, [(1, None), (2, ""), (None, "x y, cc by; cc by"), (3, "all rights"), (4, "reserved all rights reserved"), (4, "cc"), (5, "by " + "w " * 60000 + "cc-by")])
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"]) for r in got] == [(0, 0, None, None), (0, 0, None, None), (6, 2, 2, 4), (2, 0, None, None), (4, 1, 1, 1), (1, 0, None, None), (60003, 1, 60001, 60001)]
    assert run(spark, []) == []


def test_automaton():
    a = s.TokenAutomaton("a [ b ] {2} c [ d [ e ] f ]")
    for text, ok in (("a x c", 1), ("a b x y c d f", 1), ("a b x y c d e f", 1), ("a c", 0), ("a b b b c", 1), ("a x y z c", 0), ("b x c", 0)):
        assert a.accepts(text.split(), 0) == bool(ok), text
