from foliospark.operators import kernels as k


def block(x, y, text="a", h=12):
    return {"x": x, "y": y, "w": 50, "h": h, "text": text}


def test_rows_by_centres_below_the_limit():
    tall, short = block(0, 0, "tall", 40), block(0, 10, "short", 4)  # centres 20 and 12, limit 17.6
    assert k.grid_rows([tall, short]) == [[tall, short]]
    assert len(k.grid_rows([block(0, 0, h=10), block(0, 8, h=10)])) == 2  # just the limit is another row
    a, b = block(0, 0, "a", 80), block(0, 2, "b", 2)  # the lower top has the higher centre
    assert [r[0]["text"] for r in k.grid_rows([a, b])] == ["b", "a"]


def test_tables_of_two_rows_with_symbols():
    assert k.rebuilt([]) is None and k.rebuilt([block(0, 0), block(60, 1)]) is None
    found = k.rebuilt([block(0, 0, "v"), block(60, 0, " [x] "), block(0, 20, "desa"), block(60, 20, "")], lambda b: "0")
    assert found == k.ascii_grid([["✓", "☑"], ["desa", "☐"]], 5)
    assert k.rebuilt([block(0, 0, "v"), block(60, 0, "*"), block(0, 20, "x")]) == k.ascii_grid([["✓", "•"], ["×", ""]], 5)
    assert [k.cell_symbol(t) for t in ("[ ]", "\\/", "->", "(v)", "abcd", "", "1")] == ["☐", "✓", "→", "✓", "abcd", "", "1"]
