"""Distances of long sequences, by bands."""

import random
import time

import pytest

from foliospark.operators import kernels as k


def plain(a, b):
    """A column at a time over all rows, as one number's bits."""
    places = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, last, distance = (1 << len(a)) - 1, len(a) - 1, len(a)
    up, down = every, 0
    for y in b:
        same = places.get(y, 0)
        level = (((same & up) + up) ^ up) | same
        rise, fall = down | (every & ~(level | up)), up & level
        distance += (rise >> last & 1) - (fall >> last & 1)
        rise, fall, level = rise << 1 | 1, fall << 1, same | down
        up, down = (fall | ~(level | rise)) & every, rise & level & every
    return distance


@pytest.mark.parametrize("size", [4095, 4096, 5000, 9000])
@pytest.mark.parametrize("share", [0.003, 0.1, 0.4, 0.95])
def test_bands_find_the_shortest(size, share):
    rng = random.Random(size)
    for letters in ("ab", "aeo é国xyz"):
        a = "".join(rng.choice(letters) for _ in range(size))
        b = "".join(rng.choice(letters) if rng.random() < share else c for c in a if rng.random() > share / 3)
        for p, q in ((a, b), (a[size // 3 :] + a[: size // 3], b), (a[: size // 2], b), ("x" + a, a + "y")):
            assert k.edits(p, q) == k.edits(q, p) == plain(p, q)
    words = [rng.choice(letters) + rng.choice(letters) for _ in range(13_000)]
    other = [w for w in words if rng.random() > share / 3][: 12_000 if size % 2 else None]
    if size == 5000:
        assert k.edits(words, other) == plain(words, other)


def test_every_band_is_exact_or_unknown():
    rng = random.Random(9)
    for _ in range(40):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(600, 900)))
        b = "".join(rng.choice("abc") if rng.random() < 0.2 else c for c in a if rng.random() > 0.05)
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        for side in (1, 8, 64, 1000):
            assert k._banded(*k._codes(a, b), side) in ({None, plain(a, b)} if side < 1000 else {plain(a, b)})


def test_long_readings_take_less_than_all_rows():
    rng = random.Random(4)
    a = "".join(rng.choice("abcdefghijklmnop qrstu") for _ in range(40_000))
    b = a.translate(str.maketrans("aeo", "eoa"))
    spent = []
    for f in (plain, k.edits):
        began = time.process_time()
        found = f(a, b)
        spent.append(time.process_time() - began)
    assert found == plain(a[:40_000], b) and spent[0] > 2 * spent[1]
