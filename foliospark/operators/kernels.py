"""Sequential kernels, plain functions on one line, page or document, and the queries that run them over Arrow batches.

Each needs what a column expression has not: a greedy pass, a stack, or a comparison that isn't transitive. Documents
are grouped by an ordered aggregate of their own lines only, so a task never holds more than a document at a time.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import cmp_to_key, lru_cache
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.lexicon import DICTIONARY, STOP
from foliospark.functions.text import TYPOS
from foliospark.operators import images
from foliospark.plans.dialect import SPARK
from foliospark.plans.views import compiled
from foliospark.sources import ocr, readers, writers
from foliospark.streaming import queue

_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]")
_SYMBOL = re.compile(r"[Ͱ-Ͽ∀-⋿⌀-⏿─-╿⁰-₟²³¹¼-¾]")
_SUPERSCRIPT = re.compile(r"[⁰-₟²³¹]")
_LATIN = re.compile(r"[a-zA-ZÀ-ɏ]")


# words


def merged_word(a: str, b: str, document: frozenset[str] | set[str] = frozenset(), words: frozenset[str] = DICTIONARY) -> str | None:
    """WRD-01: two fragments as one word, or None."""
    if len(a) < 2 or len(a) + len(b) < 5:
        return None
    x, y = a.lower(), b.lower()
    both = x + y
    if not (both in words or both in document) or not (a.isascii() and b.isascii() and a.isalpha() and b.isalpha()) or x in STOP or y in STOP:
        return None
    if x in words and y in words and both not in document:
        return None
    return a + b


def merged_line(line: str, document: frozenset[str] | set[str] = frozenset(), words: frozenset[str] = DICTIONARY) -> str:
    """WRD-02: pairs from left to right, none used twice."""
    parts = line.split()
    if len(parts) < 2:
        return line
    low = [p.lower() for p in parts]
    out, i = [], 0
    while i < len(parts):
        whole = None
        if i + 1 < len(parts) and ((both := low[i] + low[i + 1]) in words or both in document):
            whole = merged_word(parts[i], parts[i + 1], document, words)
        out.append(whole or parts[i])
        i += 2 if whole else 1
    return " ".join(out)


def split_words(line: str) -> int:
    """WRD-03."""
    parts = line.split()
    return sum(merged_word(a, b) is not None for a, b in zip(parts, parts[1:], strict=False))


def document_words(text: str) -> set[str]:
    """TXT-15: words of a document that fragments may form."""
    return {w.lower() for w in re.findall(r"[A-Za-z]+", text) if len(w) >= 4}


# typos


def _cased(token: str, by: str) -> str:
    return by.upper() if token.isupper() and len(token) > 1 else by[:1].upper() + by[1:] if token[:1].isupper() else by


def _fixed(w: str, words: frozenset[str]) -> str:
    if w.lower() in TYPOS:
        return _cased(w, TYPOS[w.lower()])
    if len(w) >= 5 and w[0] in "lL" and w[1].lower() not in "aeiou" and w[1:].lower() in words:
        return w[1].upper() + w[2:] if w[0] == "L" else w[1:]
    return w


#: Words that may be typos.
_ODD = re.compile(r"(?<![A-Za-z])(?:[lL](?![aeiouAEIOU])[A-Za-z]{4,}|(?ai:" + "|".join(TYPOS) + r"))(?![A-Za-z])")


def fixed_typos(line: str, words: frozenset[str] = DICTIONARY) -> str:
    """TYP-01, with TYP-02 as its last step."""
    if "¿" in line:
        line = re.sub(r"¿(?=[A-Za-z])", "", line)
    if ":" in line:
        line = re.sub(r"([A-Za-z]):([A-Za-z])", r"\1\2", line)
    if "nyva" in line:
        line = re.sub(r"(?<![A-Za-z0-9_])([A-Za-z]{3,})nyva(?![A-Za-z0-9_])", r"\1nya", line)
    return _ODD.sub(lambda m: _fixed(m[0], words), line)


# garbage


def is_garbage(w: str) -> bool:
    """TOK-01."""
    latin = bool(_LATIN.search(w))
    if _CJK.search(w) and not latin and len(w) <= 8:
        return True
    if len(w) == 1:
        return bool(_SYMBOL.match(w)) and not latin
    if w and (len(_SYMBOL.findall(w)) >= 0.4 * len(w) and not latin or len(_SUPERSCRIPT.findall(w)) >= 2):
        return True
    digits = sum(c in "0123456789" for c in w)
    return len(w) >= 5 and latin and 2 * digits > len(w) and sum(c.isascii() and c.isalpha() for c in w) <= 2 and not w.lower().startswith("rp")


def core(w: str) -> str:
    """TOK-02."""
    return re.sub(r"^[\W_]+|[\W_]+$", "", w)


def is_marker(w: str) -> bool:
    """TOK-03."""
    return bool(re.fullmatch(r"[A-Za-z][.)]|\(\d+\)", w))


def in_run(w: str) -> bool:
    """TOK-04."""
    return len(core(w)) == 1 and not is_marker(w)


#: What core takes off ASCII tokens.
_MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def _token_facts(t: str) -> tuple[bool, bool, bool, bool, float | None, bool]:
    """Of a token: garbage, in a run, a single letter, a marker, its share of consonants, with a CJK character."""
    if t.isascii():  # no symbol, no CJK character
        c = t if t.isalnum() else t.strip(_MARKS)
        letters, low, marker = c if c.isalpha() else [x for x in c if x.isalpha()], t.lower(), not t.isalnum() and is_marker(t)
        garbage = len(t) >= 5 and not t.isalpha() and is_garbage(t)
        share = (len(letters) - sum(map(low.count, "aeiou"))) / len(letters) if letters else None
        return garbage, len(c) == 1 and not marker, len(c) == 1 and c.isalpha(), marker, share, False
    c = core(t)
    letters = [x for x in c if x.isascii() and x.isalpha()]
    share = sum(x.lower() not in "aeiou" for x in letters) / len(letters) if letters else None
    return is_garbage(t), in_run(t), len(c) == 1 and c.isascii() and c.isalpha(), is_marker(t), share, bool(_CJK.search(t))


#: Longer tokens are not kept, so that what is kept of them stays small.
SHORT, KEPT = 32, 1 << 16
_kept_facts = lru_cache(KEPT)(_token_facts)
_DIGIT = re.compile(r"\d")


def _facts(t: str) -> tuple[bool, bool, bool, bool, float | None, bool]:
    return _kept_facts(t) if len(t) <= SHORT else _token_facts(t)


def clean_line(line: str, document: frozenset[str] | set[str] = frozenset()) -> str:
    """TOK-12."""
    tokens = line.split()
    facts = [_facts(t) for t in tokens]
    drop, i = [f[0] for f in facts], 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and facts[j][1]:
            j += 1
        if j - i >= 2 and any(f[2] for f in facts[i:j]):
            drop[i:j] = [True] * (j - i)
        i = max(j, i + 1)
    for k in range(1, len(tokens)):
        if facts[k - 1][3] and facts[k][2] and not facts[k][3]:
            drop[k] = True
    text = " ".join(t for t, d in zip(tokens, drop, strict=True) if not d)
    if _DIGIT.search(text):
        text = re.sub(r"(?i)(?<![A-Za-z0-9_])(NOMOR)(\d{1,4})(TAHUN)(?![A-Za-z0-9_])", r"\1 \2 \3", text)
        text = re.sub(r"(?<![A-Za-z0-9_])([A-Za-z]{3,})(\d{2,4})(?![A-Za-z0-9_])", r"\1 \2", text)
        text = re.sub(r"(?<![A-Za-z0-9_])(NOMOR)(\d{1,4})(?=TAHUN)", r"\1 \2", text)
    if "BAB" in text:
        text = re.sub(r"(?<![A-Za-z0-9_])(BAB)([IVXLCDM]+)(?![A-Za-z0-9_])", r"\1 \2", text)
    if "." in text:
        text = re.sub(r"(?<![A-Za-z0-9_])([A-Za-z]{2,})\.([A-Za-z]{2,})(?![A-Za-z0-9_])", r"\1\2", text)
    text = fixed_typos(merged_line(text, document))
    ratios, tokens, low = [], text.split(), 0
    for t in tokens:
        r = _facts(t)[4]
        if r is not None:
            ratios.append(r)
            low += r < 0.7
            if low > 0.3 * len(tokens) + 1:  # whatever the rest is
                return text
    return "" if len(ratios) >= 5 and sum(r >= 0.7 for r in ratios) >= 0.7 * len(ratios) else text


def clean_text(text: str) -> str:
    """TOK-13."""
    return "\n".join(map(clean_line, text.split("\n")))


def without_truncated(lines: list[str]) -> list[str]:
    """TOK-18: lines that repeat the head of an earlier, longer one go."""
    kept: list[tuple[str, list[str]]] = []
    for line in lines:
        b = [w.lower() for w in re.findall(r"[^\W_]{3,}", line)]
        if len(b) >= 5 and any(len(b) <= int(0.85 * len(a)) and a[:3] == b[:3] and len(set(b) & set(a)) >= 0.6 * len(set(b)) for _, a in kept):
            continue
        kept.append((line, b))
    return [k for k, _ in kept]


# layout


def reading_order(blocks: list[dict]) -> list[dict]:
    """LAY-02: by page, then a comparison of centres that isn't transitive, so the sort itself is part of the rule."""

    def compare(a: dict, b: dict) -> float:
        ya, yb = a["y"] + a["h"] / 2, b["y"] + b["h"] / 2
        return ya - yb if abs(ya - yb) > 10 else a["x"] - b["x"]

    pages: dict[int, list[dict]] = {}
    for b in blocks:
        pages.setdefault(b["page"], []).append(b)
    return [b for p in sorted(pages) for b in sorted(pages[p], key=cmp_to_key(compare))]


def grid_rows(blocks: list[dict]) -> list[list[dict]]:
    """LAY-08: rows by the first block's centre, the first that fits wins; by boxes of whole pixels, a missing height as 15."""
    if not blocks:
        return []
    low = [max(0, int(np.floor(b["y"]))) for b in blocks]
    high = [max(0, int(np.ceil(b["y"] + b["h"])) - y) for b, y in zip(blocks, low, strict=True)]
    limit = max(8, 0.8 * sum(h or 15 for h in high) / len(blocks))
    rows: dict[float, list[dict]] = {}
    for b, y, h in zip(blocks, low, high, strict=True):
        centre = y + h / 2
        rows.setdefault(next((r for r in rows if abs(centre - r) < limit), centre), []).append(b)
    return [sorted(rows[r], key=lambda b: max(0, int(np.floor(b["x"])))) for r in sorted(rows)]


_CELL_SYMBOLS = [(re.compile(p), s) for p, s in (("[vV]", "✓"), (r"\\/", "✓"), ("[oO0]", "☐"), (r"\[\s*\]", "☐"), (r"\[[vVxX]\]", "☑"), ("[oO0][vx]", "☑"), ("->", "→"), ("=>", "⇒"), (r"[oO*]", "•"), (r"[xX*]", "×"), (r"\(?v\)?", "✓"))]


def cell_symbol(text: str) -> str:
    """TBL-08: a short cell's misread symbol."""
    t = text.strip(_BLANK)
    return next((s for p, s in _CELL_SYMBOLS if p.fullmatch(t)), text) if 0 < len(t) <= 3 else text


def rebuilt(blocks: list[dict], read: Callable[[dict], str] | None = None) -> str | None:
    """TBL-09: blocks as a drawn table, symbols mended, rows filled up; None under two rows. read stands for an engine that reads an empty cell's box."""
    rows = grid_rows(blocks)
    if len(rows) < 2:
        return None
    text = lambda b: cell_symbol(b["text"] or (read(b) if read else "")).strip(_BLANK)
    widest = max(map(len, rows))
    return ascii_grid([[text(b) for b in r] + [""] * (widest - len(r)) for r in rows], 5)


def columns_match(a: list[dict], b: list[dict]) -> bool:
    """LAY-09."""
    if len(a) != len(b) or len(a) < 2:
        return False
    near = sum(abs(p["x"] + p["w"] / 2 - q["x"] - q["w"] / 2) < 0.6 * max(p["w"], q["w"]) for p, q in zip(a, b, strict=True))
    return near >= 0.6 * len(a)


def geometric_tables(lines: list[list[dict]]) -> list[list[int]]:
    """LAY-10: runs of three or more lines whose columns match the line before."""
    out, run = [], []
    for i in range(1, len(lines)):
        if columns_match(lines[i], lines[i - 1]):
            run.append(i)
            continue
        out += [run] if len(run) >= 3 else []
        run = []
    return out + ([run] if len(run) >= 3 else [])


def looks_tabular(lines: list[str]) -> bool:
    """LAY-11."""
    if len(lines) < 3:
        return False
    tokens = [x.split() for x in lines]
    numeric = [bool(t) and sum(bool(re.fullmatch(r"[\d.,%Rp]+", w)) for w in t) > 0.4 * len(t) for t in tokens]
    steady = all(abs(len(a) - len(b)) <= 2 for a, b in zip(tokens, tokens[1:], strict=False))
    return sum(numeric) > 0.3 * len(lines) and steady or any(w in x for x in lines for w in ("No.", "DESA", "JUMLAH"))


def box(value: Any, width: float, height: float) -> tuple[int, int, int, int]:
    """LAY-06: any of five shapes as x, y, w, h inside the page."""
    corners = None
    if isinstance(value, dict):
        if "x" in value:
            corners = (value["x"], value["y"], value["x"] + value["w"], value["y"] + value["h"])
        elif "right" in value:
            corners = (value["left"], value["top"], value["right"], value["bottom"])
        elif "left" in value:
            corners = (value["left"], value["top"], value["left"] + value["width"], value["top"] + value["height"])
    elif isinstance(value, (list, tuple)) and len(value) in (4, 8):
        flat = [c for p in value for c in (p if isinstance(p, (list, tuple)) else [p])]
        corners = tuple(flat) if len(flat) == 4 else (min(flat[::2]), min(flat[1::2]), max(flat[::2]), max(flat[1::2]))
    a, b, c, d = corners or (0, 0, width, height)
    a, b = max(0, int(np.floor(a))), max(0, int(np.floor(b)))
    c, d = min(width, int(np.ceil(c))), min(height, int(np.ceil(d)))
    return a, b, int(max(0, c - a)), int(max(0, d - b))


# tables


def ascii_grid(rows: list[list[str]], low: int = 3, pad: int = 2, widest: int = 60) -> str:
    """TBL-06 and, with low 5, TBL-07: cells wrapped into a drawn grid."""
    n = max(map(len, rows), default=0)
    rows = [r + [""] * (n - len(r)) for r in rows]
    width = [min(widest, max(low, max(max(map(len, r[c].split("\n"))) for r in rows) + pad)) for c in range(n)]

    def wrapped(cell: str, w: int) -> list[str]:
        out = []
        for line in cell.split("\n"):
            now = ""
            for word in line.split(" "):
                while len(word) > w:
                    out += [now] if now else []
                    now, word = "", word
                    out.append(word[:w])
                    word = word[w:]
                if now and len(now) + 1 + len(word) > w:
                    out.append(now)
                    now = word
                else:
                    now = f"{now} {word}" if now else word
            out.append(now)
        return out

    rule = "+" + "+".join("-" * w for w in width) + "+"
    text = [rule]
    for r in rows:
        cells = [wrapped(c, w - 2) for c, w in zip(r, width, strict=True)]
        for k in range(max(map(len, cells), default=0)):
            text.append("|" + "|".join(" " + (c[k] if k < len(c) else "").ljust(w - 1) for c, w in zip(cells, width, strict=True)) + "|")
        text.append(rule)
    return "\n".join(text)


def is_index_row(cells: list[str]) -> bool:
    """TBL-03."""
    full = [c for c in cells if c.strip()]
    return bool(full) and all(re.fullmatch(r"[0-9]{1,3}|(?i:col)[0-9]+", c.strip()) for c in full)


def grid_usable(rows: list[list[str]]) -> bool:
    """TBL-04."""
    full = [c for r in rows for c in r if c.strip()]
    widths = [len(r) for r in rows]
    if not full or max(widths) > 20 or len(set(widths)) >= 3 or (1 in widths and max(widths) >= 4):
        return False
    return sum(bool(re.search(r"[|]{2,}|[+]{2,}|[=-]{4,}", c)) for c in full) < 0.1 * len(full)


def table_text(rows: list[dict], plain: str) -> str:
    """TBL-06: a drawn grid; rows of cells joined by bars if the grid is unusable; the bare text if no row is left. rows: header, cells."""
    rows = list(rows)
    while rows and rows[0]["header"] and is_index_row(rows[0]["cells"]):
        rows.pop(0)
    cells = [r["cells"] for r in rows if any(r["cells"])]
    if not cells:
        return plain
    return ascii_grid(cells) if grid_usable(cells) else "\n".join(" | ".join([*(c.strip() for c in r), *[""] * (max(map(len, cells)) - len(r))]) for r in cells)


def table_wins(table: str, ocr: list[str]) -> bool:
    """TBL-13: whether a table's text replaces the recognised one."""
    words = table.split()
    if len(words) < 3 or sum(w == "None" for w in words) > 0.25 * len(words):
        return False

    def odd(tokens: list[str]) -> tuple[int, int]:
        facts = [_facts(t) for t in tokens if not (t.isascii() and t.isalpha())]
        return sum(f[0] for f in facts), sum(f[5] for f in facts)

    def score(tokens: list[str], garbage: int, cjk: int) -> float:
        return 1 - 0.7 * garbage / len(tokens) - 1.5 * cjk / len(tokens) if tokens else -1.2

    garbage, cjk = odd(words)
    if cjk > 0.15 * len(words):
        return False
    have = {w.lower() for w in words}
    for line in ocr:
        long_ = [w.lower() for w in line.split() if len(w) >= 4]
        if len(long_) >= 3 and sum(w not in have for w in long_) >= 0.5 * len(long_):
            return False
    mine, read = score(words, garbage, cjk), [w for x in ocr for w in x.split()]
    return mine >= score(read, *odd(read)) - 0.05 and mine > 0.25


# trees

_LEVEL = {"bab": 1, "lampiran": 1, "bagian": 2, "paragraf": 3, "pasal": 4}


def parents(kinds: list[str]) -> list[int | None]:
    """TRE-07: each node's parent by the stack of open headings; tables and titles hang from the root."""
    stack: list[int] = []
    out: list[int | None] = []
    for i, k in enumerate(kinds):
        if k in _LEVEL:
            while stack and _LEVEL[kinds[stack[-1]]] >= _LEVEL[k]:
                stack.pop()
        out.append(None if k in ("title", "table") or not stack else stack[-1])
        if k in _LEVEL:
            stack.append(i)
    return out


def flattened(kinds: list[str]) -> list[int]:
    """TRE-10: all nodes, each before its children, by walking down the tree; their number is the node count."""
    below: dict[int | None, list[int]] = {}
    for i, p in enumerate(parents(kinds)):
        below.setdefault(p, []).append(i)
    out: list[int] = []
    todo = below.get(None, [])[::-1]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += below.get(node, [])[::-1]
    return out


def hierarchy(levels: list[int]) -> list[int | None]:
    """STR-04: each line's nearest earlier line of a lower level."""
    stack: list[int] = []
    out: list[int | None] = []
    for i, v in enumerate(levels):
        while stack and levels[stack[-1]] >= v:
            stack.pop()
        out.append(stack[-1] if stack else None)
        stack.append(i)
    return out


_INDENT = {"AYAT_HEADER": 2, "AYAT": 2, "HURUF": 4, "NOMOR": 4, "BULLET": 4}


def serialised(kinds: list[str], texts: list[str]) -> str:
    """STR-05: chapters underlined, headings between blank lines, items indented."""
    out = []
    for k, t in zip(kinds, texts, strict=True):
        if k == "BAB":
            out.append(f"\n{t}\n{'=' * len(t)}\n")
        elif k in ("BAGIAN", "PARAGRAF", "PASAL", "LEGAL_PREAMBLE", "LEGAL_AUTHORITY"):
            out.append(f"\n{t}\n")
        else:
            out.append(" " * _INDENT.get(k, 0) + t + "\n")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)) + "\n"


def nested(title: str, kinds: list[str], numbers: list[str], texts: list[str]) -> str:
    """OUT-04: the tree as JSON."""
    nodes = [{"type": k, "number": n or None, "title": t, "text": t, "children": []} for k, n, t in zip(kinds, numbers, texts, strict=True)]
    top: list[dict] = []
    for node, p in zip(nodes, parents(kinds), strict=True):
        (top if p is None else nodes[p]["children"]).append(node)
    return json.dumps({"version": "1.0", "title": title, "children": top}, ensure_ascii=False, separators=(",", ":"))


def roman(s: str) -> int | None:
    """REV-09: a roman or plain number, else None."""
    if re.fullmatch(r"\d+", s):
        return int(s)
    value = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    digits = [value.get(c) for c in s.upper()]
    if not digits or None in digits:
        return None
    return sum(-a if a < b else a for a, b in zip(digits, [*digits[1:], 0], strict=True))


# metrics


def _codes(*sequences: Sequence) -> list[np.ndarray]:
    if all(isinstance(s, str) for s in sequences):
        return [np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") for s in sequences]
    number: dict[Any, int] = {}
    return [np.array([number.setdefault(x, len(number)) for x in s], np.int64) for s in sequences]


def _places(window: np.ndarray, wanted: list[int]) -> dict[int, int]:
    """Where each wanted code stands in a window, as bits of a number."""
    if len(wanted) <= 256:
        return {c: int.from_bytes(np.packbits(window == c, bitorder="little").tobytes(), "little") for c in wanted}
    order = np.argsort(window, kind="stable")
    first, last = (np.searchsorted(window[order], wanted, side).tolist() for side in ("left", "right"))
    return {c: sum(1 << i for i in order[f:t].tolist()) for c, f, t in zip(wanted, first, last, strict=True) if f < t}


def _whole(a: Sequence, b: Sequence) -> int:
    """The distance of two sequences, the first no shorter: a column of differences at a time, as bits of two numbers."""
    places: dict[Any, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    up, down = every, 0
    for y in b:
        same = places.get(y, 0)
        level = (((same & up) + up) ^ up) | same
        rise, fall = (down | every ^ ((level | up) & every)) << 1 & every | 1, (up & level) << 1 & every
        level = same | down
        up, down = fall | every ^ (level | rise), rise & level
    return len(b) + up.bit_count() - down.bit_count()


def _banded(a: np.ndarray, b: np.ndarray, side: int) -> int | None:
    """The distance of two sequences, the first no shorter, over alignments at most ``side`` off the corners' diagonals; None if it can't be known from these. A column of differences at a time, as bits of two numbers; rows that leave the band go and others come some columns at a time."""
    n, m = len(a), len(b)
    limit = n - m + 2 * side + 1  # an alignment that leaves the band costs more
    step = max(256, side // 2)
    top, bottom, value, up, down = 0, 0, 0, 0, 0  # rows of the window, the value above it, and its differences
    for first in range(0, m, step):
        chunk = b[first : first + step]
        lost, new = max(0, first - side) - top, min(n, first + len(chunk) + n - m + side)
        gone = (1 << lost) - 1
        value += (up & gone).bit_count() - (down & gone).bit_count()
        up, down = up >> lost | ((1 << new - bottom) - 1) << bottom - top - lost, down >> lost
        top, bottom = top + lost, new
        every, places = (1 << bottom - top) - 1, _places(a[top:bottom], np.unique(chunk).tolist())
        for y in chunk.tolist():
            same = places.get(y, 0)
            level = (((same & up) + up) ^ up) | same
            rise, fall = (down | every ^ ((level | up) & every)) << 1 & every | 1, (up & level) << 1 & every
            level = same | down
            up, down = fall | every ^ (level | rise), rise & level
        value += len(chunk)
        done, size = first + len(chunk), (bottom - top + 7) // 8
        if done < m:  # the least that an alignment of this column may still come to
            bits = [np.unpackbits(np.frombuffer(v.to_bytes(size, "little"), np.uint8), count=bottom - top, bitorder="little").astype(np.int32) for v in (up, down)]
            column = value + np.concatenate([[0], np.cumsum(bits[0] - bits[1])])
            if (column + np.abs(n - m + done - np.arange(top, bottom + 1))).min() > limit:
                return None
    value += up.bit_count() - down.bit_count()
    return value if value <= limit else None


def edits(a: Sequence, b: Sequence) -> int:
    """MET-03: Levenshtein's distance of two sequences: equal ends go, then bands of doubled width until one holds all alignments that could be as short. Differing places of the sequences laid on each other bound the distance, so also the widest band."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    if len(a) < (4096 if isinstance(a, str) else 12_288):
        return _whole(a, b)
    x, y = _codes(a, b)
    n, m = len(x), len(y)
    most = min(int((x[:m] != y).sum()), int((x[n - m :] != y).sum()))
    widest, side = most // 2 + 1, 64
    while 2 * side < widest:
        found = _banded(x, y, side)
        if found is not None:
            return found
        side *= 2
    return _banded(x, y, widest)


#: What JavaScript's trim takes off.
_BLANK = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def cer(hyp: str, ref: str) -> float:
    """MET-01."""
    if not ref or not hyp:
        return 1.0 if ref or hyp else 0.0
    h, r = hyp.lower().strip(_BLANK), ref.lower().strip(_BLANK)
    return edits(h, r) / max(len(r), 1)


def wer(hyp: str, ref: str) -> float:
    """MET-02."""
    h, r = hyp.split(), ref.split()
    return (1.0 if h else 0.0) if not r else edits(h, r) / len(r)


# over tables


#: What a Python worker holds of a column that it makes, before it hands it on.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 512


def _weight(value: Any) -> int:
    """About the bytes of a value of a column."""
    return len(value) if isinstance(value, (str, bytes)) else sum(map(_weight, value)) if isinstance(value, (list, tuple)) else 8


_KINDS = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _kind(name: str) -> pa.DataType:
    return pa.list_(_kind(name[len("array<") : -1])) if name.startswith("array<") else _KINDS[name]


def _mapped(df: DataFrame, schema: str, f: Callable[..., Any], keys: list[str], inputs: list[str], out: str) -> DataFrame:
    """A column from others, by a plain function, a row at a time: a batch may hold 10,000 pages, so no more than one is a Python object at once, and results leave as they come."""
    kind = _kind(dict(c.split(" ") for c in schema.split(", "))[out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c) for c in inputs]
            first, values, held = 0, [], 0
            for i in range(b.num_rows):
                values.append(f(*(c[i].as_py() for c in columns)))
                held += _weight(values[-1])
                if held >= BATCH_BYTES or len(values) >= BATCH_ROWS or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_pydict({k: b.column(k).slice(first, len(values)) for k in keys} | {out: pa.array(values, kind)})
                    first, values, held = i + 1, [], 0

    return df.select(*keys, *(c for c in inputs if c not in keys)).mapInArrow(run, schema)


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(compiled(SPARK, f"SELECT * FROM {name}", (name,), sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, with its lines in order."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return _view(spark, sf_dir, "noisy").groupBy("doc_id").agg(lines.alias("lines"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TBL-13: each page's cleaned lines, as its table's text, against all lines that were read."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    pages = _view(spark, sf_dir, "noisy").groupBy("doc_id", "page").agg(lines.alias("lines"))
    return _mapped(pages, "doc_id long, page long, value boolean", lambda x: table_wins(" ".join(map(clean_line, x)), x), ["doc_id", "page"], ["lines"], "value")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, with the kinds and texts of its lines."""
    from foliospark import queries as q

    each = F.sort_array(F.collect_list(F.struct("line_no", "kind", "number", "t")))
    rows = spark.sql(compiled(SPARK, q._nodes(SPARK), ("noisy",), sf_dir)).groupBy("doc_id").agg(each.alias("n"))
    return rows.select("doc_id", *(F.col(f"n.{c}").alias(c) for c in ("line_no", "kind", "number", "t")))


def _line(f: Callable[[str], Any], kind: str = "string") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _mapped(_view(spark, sf_dir, "noisy"), f"doc_id long, line_no long, value {kind}", f, ["doc_id", "line_no"], ["text"], "value")


def _document(f: Callable[[list[str]], Any], kind: str = "string") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _mapped(_documents(spark, sf_dir), f"doc_id long, value {kind}", f, ["doc_id"], ["lines"], "value")


def _with_document_words(lines: list[str]) -> str:
    words = document_words("\n".join(lines))
    return "\n".join(merged_line(clean_line(x), words) for x in lines)


def _by_page(f: Callable[[list[dict]], Any], kind: str, *fields: str) -> Callable[[SparkSession, str], DataFrame]:
    """A kernel over each page's blocks, which have these fields beside their ordinal."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = F.sort_array(F.collect_list(F.struct("ord", *fields)))
        return _mapped(_view(spark, sf_dir, "blocks").groupBy("doc_id", "page").agg(rows.alias("b")), f"doc_id long, page long, value {kind}", f, ["doc_id", "page"], ["b"], "value")

    return run


def _tree(f: Callable[..., Any], kind: str, *inputs: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _mapped(_nodes(spark, sf_dir), f"doc_id long, value {kind}", f, ["doc_id"], list(inputs), "value")


def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark import queries as q

    rows = spark.sql(compiled(SPARK, q.DECLARED["STR-03"][1](SPARK), ("noisy",), sf_dir))
    each = F.sort_array(F.collect_list(F.struct("line_no", "kind", "text")))
    docs = rows.groupBy("doc_id").agg(each.alias("n")).select("doc_id", F.col("n.kind").alias("kinds"), F.col("n.text").alias("texts"))
    return _mapped(docs, "doc_id long, value string", serialised, ["doc_id"], ["kinds", "texts"], "value")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses and references, dealt out: a pair's work grows with the square of its length."""
    return _view(spark, sf_dir, "hyp_ref").repartition(8 * spark.sparkContext.defaultParallelism, "doc_id", "engine")


def _wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(_pairs(spark, sf_dir), "doc_id long, engine string, wer double", wer, ["doc_id", "engine"], ["hyp", "ref"], "wer")


def _cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    return _mapped(rows, "doc_id long, engine string, pages long, duration_ms long, cer double", cer, ["doc_id", "engine", "pages", "duration_ms"], ["hyp", "ref"], "cer")


def _averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cer(spark, sf_dir).groupBy("engine").agg(F.count("*").alias("n"), F.round(F.avg("cer"), 5).alias("avg_cer"), F.sum("pages").alias("pages"), F.sum("duration_ms").alias("duration_ms"))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _cer(spark, sf_dir).groupBy("engine").agg(F.avg("cer").alias("c"))
    return means.orderBy("c", "engine").limit(1).select(F.col("engine").alias("best"), F.round("c", 5).alias("avg_cer"))


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TBL-07: every grid drawn, without header logic."""
    from foliospark import queries as q

    rows = spark.sql(compiled(SPARK, q._grid(SPARK), ("html_tables",), sf_dir))
    each = F.sort_array(F.collect_list(F.struct("r", "cells")))
    tables = rows.groupBy("table_id").agg(F.transform(each, lambda x: x["cells"]).alias("rows"))
    return _mapped(tables, "table_id long, value string", lambda rows: ascii_grid(rows, 5), ["table_id"], ["rows"], "value")


def _table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark import queries as q

    rows = spark.sql(compiled(SPARK, q._grid(SPARK), ("html_tables",), sf_dir)).where("size(cells) > 0")
    grids = rows.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("r", "header", "cells"))).alias("rows"))
    plain = spark.sql(compiled(SPARK, f"SELECT table_id, {q._cell(SPARK, 'html')} AS plain FROM html_tables", ("html_tables",), sf_dir))
    tables = plain.join(grids, "table_id", "left").withColumn("rows", F.coalesce("rows", F.array().cast(grids.schema["rows"].dataType)))
    return _mapped(tables, "table_id long, value string", table_text, ["table_id"], ["rows", "plain"], "value")


def _page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a page, with its lines in order."""
    each = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return _view(spark, sf_dir, "lines").groupBy("doc_id", "page").agg(each.alias("lines"))


def _pages(f: Callable[[np.ndarray], Any], kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """A pixel kernel over each page, its lines drawn as ink."""
    return lambda spark, sf_dir: _mapped(_page_lines(spark, sf_dir), f"doc_id long, page long, value {kind}", lambda x: f(images.page(x)), ["doc_id", "page"], ["lines"], "value")


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JQ-01: the queue's table as a drained stream."""
    events = _view(spark, sf_dir, "queue").select("id", "seq", "op", "outcome", F.coalesce(F.when(F.trim("url") != "", F.trim("url")), F.trim("file_url")).alias("url"))
    root = _folder(spark)
    events.write.parquet(f"{root}/in")
    queue.drain(spark, f"{root}/in", f"{root}/out", f"{root}/check", 1000)
    return spark.read.schema(queue.ACTIONS + ", batch int").parquet(f"{root}/out").select("id", "seq", "action", "state")


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/folio-{uuid.uuid4().hex}"


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    return _mapped(rows, "doc_id long, engine string, distance long", edits, ["doc_id", "engine"], ["hyp", "ref"], "distance")


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written by file name and read back."""
    path = _folder(spark)
    docs = spark.sql(compiled(SPARK, "SELECT 'doc_' || doc_id % 20 AS file_name, replace(text, '\n', ' ') AS text FROM documents", (), sf_dir))
    writers.text_cache(docs, path)
    return spark.read.text(path).select("file_name", "value")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    rows = _view(spark, sf_dir, "queue").select(F.col("seq").cast("string").alias("id"), F.coalesce(F.trim("file_url"), F.lit("")).alias("url"), F.concat(F.lit("nama "), F.col("id").cast("string")).alias("nama"))
    rows.write.json(path)
    return spark.read.schema("id string, url string, nama string").json(path)


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue rows wrapped in the three shapes of a payload, and taken out again."""
    item = F.to_json(F.struct(F.col("seq").alias("id"), "url", "file_url"))
    shape = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("["), item, F.lit("]"))).when(F.col("seq") % 3 == 1, F.concat(F.lit('{"data":['), item, F.lit("]}"))).otherwise(F.concat(F.lit('{"result":['), item, F.lit("]}")))
    rows = _view(spark, sf_dir, "queue").select(shape.alias("payload"))
    return rows.select(F.explode(readers.items(F.col("payload"))).alias("i")).select("i.*").select("id", readers.address("https://api.example.com").alias("url"))


class _Ruler:
    """An engine that reads a drawn page's lines, for want of a model."""

    def recognise(self, image: bytes, width: int, height: int) -> list[dict]:
        page = np.frombuffer(image, np.uint8).reshape(height, width)
        return [{"text": f"line {y}", "confidence": 0.9, "x": 0.0, "y": float(y), "w": float(width), "h": 1.0} for y in images.lines(page, 1)]


def _recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for i in range(b.num_rows):
                page = images.page(b.column("lines")[i].as_py())
                yield b.column("doc_id")[i].as_py(), b.column("page")[i].as_py(), page.tobytes(), page.shape[1], page.shape[0]

    return _page_lines(spark, sf_dir).mapInArrow(lambda batches: ocr.read(drawn(batches), [_Ruler], bool), ocr.BLOCKS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "IMG-01": _pages(lambda p: images.gray(images.tinted(p)).tobytes(), "binary"),
        "IMG-02": _pages(images.otsu, "long"),
        "IMG-04": _pages(lambda p: images.upscaled(p, 2).tobytes(), "binary"),
        "IMG-05": _pages(lambda p: images.prepared(images.tinted(p), "grayscale,upscale,denoise,threshold,deskew,deskew-adaptive,perspective,rotate", 2 if images.regions(p, True) else 0).tobytes(), "binary"),
        "IMG-10": _pages(images.upright, "string"),
        "MET-01": lambda spark, sf_dir: _cer(spark, sf_dir).select("doc_id", "engine", F.round("cer", 6).alias("cer")),
        "MET-03": _edits,
        "MET-09": _averages,
        "SNK-01": _cached,
        "SNK-11": _best,
        "SRC-01": _links,
        "SRC-04": _payloads,
        "SRC-16": _pages(lambda p: 3.0 if images.regions(p) else 2.0, "double"),
        "UDF-01": _recognised,
        "IMG-03": _pages(lambda p: images.median(p).tobytes(), "binary"),
        "IMG-08": _pages(lambda p: images.deskewed(p)[1], "string"),
        "IMG-06": _pages(images.projection_skew, "double"),
        "IMG-07": _pages(images.hough_skew, "double"),
        "IMG-09": _pages(lambda p: images.rotated(images.mirrored(p), 2).tobytes(), "binary"),
        "IMG-11": _pages(lambda p: images.lines(p, 1), "array<long>"),
        "IMG-12": _pages(lambda p: [list(map(int, r)) for r in images.regions(p)], "array<array<long>>"),
        "IMG-13": _pages(lambda p: [list(map(int, r)) for r in images.regions(p, True)], "array<array<long>>"),
        "JQ-01": _queue,
        "LAY-06": _by_page(lambda b: [list(box({k: x[k] for k in "xywh"}, 150, 200)) for x in b], "array<array<long>>", "x", "y", "w", "h"),
        "LAY-09": _by_page(lambda b: [columns_match(p, q) for p, q in pairwise(grid_rows(b))], "array<boolean>", "x", "y", "w", "h"),
        "REV-09": _tree(lambda n: [roman(x) if x else None for x in n], "array<long>", "number"),
        "TBL-07": _grids,
        "TRE-09": _tree(lambda kinds: [[i, -1 if p is None else p] for i, p in enumerate(parents(kinds))], "array<array<long>>", "kind"),
        "WRD-01": _line(lambda x: [w for a, b in zip(x.split(), x.split()[1:], strict=False) if (w := merged_word(a, b))], "array<string>"),
        "TOK-12": _line(clean_line),
        "TOK-13": _document(lambda lines: clean_text("\n".join(lines))),
        "TOK-14": _document(_with_document_words),
        "TOK-18": _document(without_truncated, "array<string>"),
        "WRD-02": _line(merged_line),
        "WRD-03": _line(split_words, "long"),
        "TYP-01": _line(fixed_typos),
        "TXT-08": _document(lambda lines: fixed_typos("\n".join(lines))),
        "TXT-15": _document(lambda lines: "\n".join(merged_line(x, document_words("\n".join(lines))) for x in lines)),
        "LAY-02": _by_page(lambda b: [x["ord"] for x in reading_order(b)], "array<long>", "page", "x", "y", "h"),
        "LAY-08": _by_page(lambda b: [[x["ord"] for x in r] for r in grid_rows(b)], "array<array<long>>", "x", "y", "h"),
        "LAY-10": _by_page(lambda b: geometric_tables(grid_rows(b)), "array<array<long>>", "x", "y", "w", "h"),
        "LAY-11": _document(looks_tabular, "boolean"),
        "TBL-06": _table_texts,
        "TBL-09": _by_page(rebuilt, "string", "x", "y", "h", "text"),
        "TBL-13": _verdicts,
        "TRE-07": _tree(parents, "array<long>", "kind"),
        "TRE-10": _tree(flattened, "array<long>", "kind"),
        "STR-04": _tree(lambda kinds: hierarchy([_LEVEL.get(k, 9) for k in kinds]), "array<long>", "kind"),
        "STR-05": _structure,
        "OUT-04": _tree(lambda kinds, numbers, texts: nested(next((t for k, t in zip(kinds, texts, strict=True) if k == "title"), ""), kinds, numbers, texts), "string", "kind", "number", "t"),
        "MET-02": _wer,
    }
