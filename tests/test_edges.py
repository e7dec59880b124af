"""Spark's short ways to the token rules against the patterns that define them."""

import random

import pytest

from foliospark.functions import text
from foliospark.plans.dialect import DUCK, EDGE_A, EDGE_B, SPARK


def defined(x, rule):
    """The rules by the patterns that the oracle has, on Spark."""
    d = SPARK
    if rule == "number":
        out = d.sub(x, rf"(?i){EDGE_A}(NOMOR)([0-9]{{1,4}})(TAHUN){EDGE_B}", "$1$2 $3 $4$5")
        for _ in range(2):
            out = d.sub(out, rf"{EDGE_A}([A-Za-z]{{3,}})([0-9]{{2,4}}){EDGE_B}", "$1$2 $3$4")
        return out
    if rule == "bab":
        for _ in range(2):
            x = d.sub(x, rf"{EDGE_A}(BAB)([IVXLCDM]+){EDGE_B}", "$1$2 $3$4")
        return x
    if rule == "dots":
        return d.sub(x, rf"{EDGE_A}([A-Za-z]{{2,}})\.([A-Za-z]{{2,}}){EDGE_B}", "$1$2$3$4")
    if rule == "garbage":
        return text.output_garbage(d, x, True)
    if rule == "run":
        return f"(length({text.core(d, x)}) = 1 AND NOT {text.list_marker(d, x)})"
    return d.match(text.core(d, x), "^[A-Za-z]$")


RULES = {"number": text.glued_number, "bab": text.glued_bab, "dots": text.inner_dots, "garbage": text.output_garbage, "run": text.run_token, "letter": text.single_letter}


def test_short_ways_are_the_rules(spark):
    rng = random.Random(8)
    parts = ["NOMOR", "nomor", "TAHUN", "Tahun", "BAB", "IV", "abc", "de", "f", "1", "23", "4567", " ", " ", ".", ",", "_", "\n", "é", "国", "²", "Rp", " ", "\u0085", "(", "ν", "-", "𝒜"]
    made = ["", "NOMOR1TAHUN NOMOR2TAHUN nomor3tahun", "abc12 abc34,abc56 abc78\n", "BABI BABV BABX.BABI", "ab.cd ef.gh ij.kl.mn", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(6000))]
    df = spark.createDataFrame([(t,) for t in made], "t string")
    both = df.selectExpr("t", *(f"{f(SPARK, 't')} AS {n}_now" for n, f in RULES.items()), *(f"{defined('t', n)} AS {n}_was" for n in RULES)).collect()
    for r in both:
        for n in RULES:
            assert r[f"{n}_now"] == r[f"{n}_was"], (n, r.t)


@pytest.mark.parametrize("f", [text.glued_number, text.glued_bab, text.inner_dots])
def test_no_group_at_a_patterns_start(f):
    assert EDGE_A not in f(SPARK, "t") and EDGE_A in f(DUCK, "t")
