"""What is kept of tokens is what the rules say of them."""

import random

from foliospark.operators import kernels as k


def test_facts_are_the_rules():
    rng = random.Random(3)
    for t in ["", "a", "1", "a.", "(12)", "___", "Rp1", "bo20202", "1234a", *("".join(rng.choice("aAbzlL.:1²国ν¿-E)(50_é١٣tu") for _ in range(rng.randint(1, 40))) for _ in range(5000))]:
        c = k.core(t)
        letters = [x for x in c if x.isascii() and x.isalpha()]
        share = sum(x.lower() not in "aeiou" for x in letters) / len(letters) if letters else None
        assert k._facts(t) == (k.is_garbage(t), k.in_run(t), len(c) == 1 and c.isascii() and c.isalpha(), k.is_marker(t), share, bool(k._CJK.search(t))), t


def test_kept_facts_are_bounded():
    for i in range(70_000):
        k._facts(f"w{i}")
    k._facts("x" * 1000)
    assert k._kept_facts.cache_info().currsize <= k.KEPT
