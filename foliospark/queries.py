"""The registered queries of the document operators and the ledger, and their SQL.

Most are declarative: one description gives Spark's SQL and DuckDB's (``plans``). Those with sequential logic run the
kernels of ``operators`` over Arrow batches and are held against brute force and golden cases in tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.functions import legal, text
from foliospark.operators import kernels
from foliospark.plans.dialect import DUCK, EDGE_A, EDGE_B, SPARK, Dialect, S
from foliospark.plans.views import compiled

Select = Callable[[Dialect], str]
DECLARED: dict[str, tuple[tuple[str, ...], Select]] = {}


def declared(name: str, *views: str) -> Callable[[Select], Select]:
    def add(f: Select) -> Select:
        DECLARED[name] = (views, f)
        return f

    return add


def _simple(name: str, view: str, keys: str, **columns: Callable[[Dialect], str]) -> None:
    """A query of expressions over the rows of a view."""
    DECLARED[name] = ((view,), lambda d: f"SELECT {keys}, " + ", ".join(f"{e(d)} AS {c}" for c, e in columns.items()) + f" FROM {view}")


# text normalisation
for _name, _f in {"TXT-01": text.newlines, "TXT-02": text.dehyphenated, "TXT-03": text.bullets, "TXT-04": text.quotes, "TXT-05": text.controls, "TXT-06": text.charset, "TXT-07": text.spaces, "TXT-10": text.headings, "TXT-11": text.sentences, "TXT-12": text.blank_lines}.items():
    _simple(_name, "rough", "doc_id", text=lambda d, f=_f: f(d, "text"))
_simple("TXT-13", "noisy", "doc_id, line_no", garbage=lambda d: text.garbage_line(d, "text"))
_simple("TXT-16", "rough", "doc_id", text=lambda d: d.trim("text"))


@declared("TXT-09", "noisy")
def _(d: Dialect) -> str:
    key = f"lower({d.trim('text')})"
    keep = f"(NOT {text.chrome_line(d, d.trim('text'))} AND (NOT {d.match(d.trim('text'), text.PREAMBLE)} OR n = 1))"
    return f"SELECT doc_id, {d.listed('text', 'line_no')} AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {key} ORDER BY line_no) AS n FROM noisy) t WHERE {keep} GROUP BY doc_id"


@declared("TXT-14", "noisy")
def _(d: Dialect) -> str:
    return f"SELECT doc_id, line_no, text FROM (SELECT *, max(CASE WHEN g THEN line_no END) OVER (PARTITION BY doc_id) AS last FROM (SELECT doc_id, line_no, text, {text.garbage_line(d, 'text')} AS g FROM noisy) a) b WHERE last IS NULL OR (line_no < last AND NOT g)"


# token rules
_simple("TOK-01", "words", "doc_id, line_no, tok_no, word", garbage=lambda d: text.output_garbage(d, "word"))
_simple("TOK-02", "words", "doc_id, line_no, tok_no", core=lambda d: text.core(d, "word"))
_simple("TOK-03", "words", "doc_id, line_no, tok_no", marker=lambda d: text.list_marker(d, "word"))
_simple("TOK-04", "words", "doc_id, line_no, tok_no", run=lambda d: text.run_token(d, "word"))
_simple("TOK-07", "noisy", "doc_id, line_no", text=lambda d: text.glued_number(d, "text"))
_simple("TOK-08", "noisy", "doc_id, line_no", text=lambda d: text.glued_bab(d, "text"))
_simple("TOK-09", "noisy", "doc_id, line_no", text=lambda d: text.inner_dots(d, "text"))
_simple("TOK-10", "words", "doc_id, line_no, tok_no", ratio=lambda d: text.consonants(d, "word"))
_simple("TOK-15", "noisy", "doc_id, line_no", n=lambda d: d.size(d.keep(d.words("text"), "u", text.output_garbage(d, "u"))))
_simple("TOK-16", "noisy", "doc_id, line_no", page_number=lambda d: d.match(d.trim("text"), text.PAGE_NUMBER), salinan=lambda d: d.match(d.trim("text"), text.SALINAN), stamp=lambda d: d.match(d.trim("text"), text.STAMP), nip=lambda d: d.match(d.trim("text"), text.NIP), preamble=lambda d: d.match(d.trim("text"), text.PREAMBLE))


@declared("TOK-05", "words")
def _(d: Dialect) -> str:
    part = "PARTITION BY doc_id, line_no"
    runs = f"SELECT *, tok_no - row_number() OVER ({part}, run ORDER BY tok_no) AS island FROM (SELECT *, {text.run_token(d, 'word')} AS run, {text.single_letter(d, 'word')} AS letter FROM words) a"
    return f"SELECT doc_id, line_no, tok_no, word FROM (SELECT *, count(*) OVER ({part}, run, island) AS n, max(CASE WHEN letter THEN 1 ELSE 0 END) OVER ({part}, run, island) AS any_letter FROM ({runs}) b) c WHERE NOT (run AND n >= 2 AND any_letter = 1)"


@declared("TOK-06", "words")
def _(d: Dialect) -> str:
    marker = text.list_marker(d, "word")
    return f"SELECT doc_id, line_no, tok_no, word FROM (SELECT *, {marker} AS m, coalesce(lag({marker}) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no), false) AS after FROM words) a WHERE NOT (after AND NOT m AND {d.match(text.core(d, 'word'), '^[A-Za-z]$')})"


@declared("TOK-11", "words")
def _(d: Dialect) -> str:
    return f"SELECT doc_id, line_no, count(r) >= 5 AND sum(CASE WHEN r >= 0.7 THEN 1 ELSE 0 END) >= 0.7 * count(r) AS mirror FROM (SELECT doc_id, line_no, {text.consonants(d, 'word')} AS r FROM words) a GROUP BY doc_id, line_no"


@declared("TOK-17", "noisy")
def _(d: Dialect) -> str:
    edge = f"(top < 2 OR bottom < 2) AND ({' OR '.join(d.match('t', p) for p in text.EDGE_CHROME)})"
    foot = f"bottom < 4 AND ({' OR '.join(d.match('t', p) for p in text.FOOTER)})"
    seen = f"SELECT *, lower({d.trim('text')}) AS k, {d.trim('text')} AS t, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) - 1 AS top, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no DESC) - 1 AS bottom FROM noisy"
    pages = "SELECT doc_id AS d, count(DISTINCT page) AS pages FROM noisy GROUP BY doc_id"
    counted = f"SELECT s.*, p.pages, count(CASE WHEN top < 2 THEN 1 END) OVER (PARTITION BY doc_id, k) AS heads, count(CASE WHEN bottom < 2 THEN 1 END) OVER (PARTITION BY doc_id, k) AS feet, row_number() OVER (PARTITION BY doc_id, k ORDER BY line_no) AS nth FROM ({seen}) s JOIN ({pages}) p ON s.doc_id = p.d"
    need = "greatest(2, CAST(ceil(pages * 0.5) AS BIGINT))"
    return f"SELECT doc_id, line_no, page, text FROM ({counted}) c WHERE NOT ({edge}) AND NOT (t <> '' AND ((top < 2 AND heads >= {need}) OR (bottom < 2 AND feet >= {need}))) AND NOT ({foot}) AND NOT ({d.match('t', text.PREAMBLE)} AND nth > 1)"


# layout
@declared("LAY-01", "blocks")
def _(d: Dialect) -> str:
    return "SELECT doc_id, ord, text, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS place FROM blocks"


@declared("LAY-03", "rough")
def _(d: Dialect) -> str:
    return f"SELECT doc_id, CAST(k AS BIGINT) AS k, {d.trim('line')} AS text, CAST(10 + 24 * k AS DOUBLE) AS y FROM ({d.exploded('(SELECT doc_id, text AS body FROM rough) _r', 'doc_id', d.lines('body'), 'line', 'k')}) a"


@declared("LAY-04", "blocks")
def _(d: Dialect) -> str:
    part = "PARTITION BY doc_id, page ORDER BY y + h / 2, x, ord"
    flag = f"SELECT *, CASE WHEN abs(y + h / 2 - lag(y + h / 2) OVER ({part})) < 12 THEN 0 ELSE 1 END AS opens FROM blocks"
    line = f"SELECT *, sum(opens) OVER ({part} ROWS UNBOUNDED PRECEDING) AS line FROM ({flag}) a"
    return f"SELECT doc_id, page, CAST(line AS BIGINT) AS line, {d.listed('text', 'y + h / 2, x, ord', ' ')} AS text, min(x) AS x, min(y) AS y, max(x + w) AS x2 FROM ({line}) b GROUP BY doc_id, page, line"


@declared("LAY-05", "blocks")
def _(d: Dialect) -> str:
    # the second box moved by 45, so that neighbours overlap
    both = "greatest(0, least(a.x + a.w, b.x - 45 + b.w) - greatest(a.x, b.x - 45)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
    union = f"(a.w * a.h + b.w * b.h - {both})"
    iou = f"SELECT a.doc_id, a.ord, b.ord AS other, round({both} / {union}, 6) AS iou"
    if d.spark:  # by position, in cells of 400 by 96: boxes of 50 by 12 that overlap begin within that of each other, so a box meets those of one cell, and is sent to 1.6 on average
        span = lambda x, near, cell: f"sequence(CAST(floor(({x} - {near}) / {cell}) AS BIGINT), CAST(floor(({x} + {near}) / {cell}) AS BIGINT))"
        cells = f"SELECT * FROM blocks LATERAL VIEW explode({span('(x - 45)', 50, 400)}) _i AS cx LATERAL VIEW explode({span('y', 12, 96)}) _j AS cy"
        return f"{iou} FROM blocks a JOIN ({cells}) b ON a.doc_id = b.doc_id AND a.page = b.page AND CAST(floor(a.x / 400) AS BIGINT) = b.cx AND CAST(floor(a.y / 96) AS BIGINT) = b.cy AND a.ord < b.ord WHERE {both} > 0.3 * {union}"
    return f"{iou} FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.page = b.page AND a.ord < b.ord WHERE {both} > 0.3 * {union}"


@declared("LAY-07", "blocks")
def _(d: Dialect) -> str:
    regions = "SELECT doc_id, page, min(x) + 30 AS rx, min(y) + 30 AS ry, 150.0 AS rw, 60.0 AS rh FROM blocks GROUP BY doc_id, page"
    return f"SELECT b.doc_id, b.page, b.ord FROM blocks b JOIN ({regions}) r ON b.doc_id = r.doc_id AND b.page = r.page AND b.x + b.w / 2 > rx - 12 AND b.x + b.w / 2 < rx + rw + 12 AND b.y + b.h / 2 > ry - 12 AND b.y + b.h / 2 < ry + rh + 12"


@declared("LAY-12", "blocks")
def _(d: Dialect) -> str:
    return "SELECT doc_id, page, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, (min(x) + max(x + w)) / 2 AS cx, (min(y) + max(y + h)) / 2 AS cy FROM blocks GROUP BY doc_id, page"


# tables
def _cell(d: Dialect, x: str) -> str:
    """TBL-01."""
    nl = "\n"
    return d.trim(d.subs(x, (r"<[^>]*>", ""), (r"\\n|&#10;|&#13;", nl), (r"(^|[^A-Za-z0-9_])None($|[^A-Za-z0-9_])", "$1$2"), (rf"(?m)^[= \t-]+$", ""), (rf"^[= \t\r\n-]+", ""), (r"\n{2,}", nl)))


def _grid(d: Dialect) -> str:
    rows = d.extract_all("html", r"(?is)<tr[^>]*>.*?</tr>")
    return f"SELECT table_id, CAST(r AS BIGINT) AS r, {d.match('row', '(?i)<th')} AS header, {d.map(d.extract_all('row', r'(?is)<t[dh][^>]*>.*?</t[dh]>'), 'c', _cell(d, 'c'))} AS cells FROM ({d.exploded('html_tables', 'table_id', rows, 'row', 'r')}) a"


def _index_row(d: Dialect) -> str:
    """TBL-03."""
    full = d.keep("cells", "c", "c <> ''")
    odd = d.keep("cells", "c", f"c <> '' AND NOT {d.match('c', '(?i)^([0-9]{1,3}|col[0-9]+)$')}")
    return f"({d.size(full)} > 0 AND {d.size(odd)} = 0)"


@declared("TBL-02", "html_tables")
def _(d: Dialect) -> str:
    return f"SELECT table_id, r, header, {d.join('cells', '|')} AS cells FROM ({_grid(d)}) g WHERE {d.size(d.keep('cells', 'c', chr(99) + chr(32) + '<> ' + chr(39) * 2))} > 0 AND NOT (header AND r = 0 AND {_index_row(d)})"


@declared("TBL-03", "html_tables")
def _(d: Dialect) -> str:
    return f"SELECT table_id, r, {_index_row(d)} AS index_row FROM ({_grid(d)}) g"


@declared("TBL-04", "html_tables")
def _(d: Dialect) -> str:
    full = d.size(d.keep("cells", "c", "c <> ''"))
    bad = d.size(d.keep("cells", "c", d.match("c", r"[|]{2,}|[+]{2,}|[=-]{4,}")))
    width = d.size("cells")
    return f"SELECT table_id, max(w) <= 20 AND sum(f) > 0 AND sum(b) < 0.1 * sum(w) AND count(DISTINCT w) < 3 AND max(jump) = 0 AS usable FROM (SELECT table_id, {width} AS w, {full} AS f, {bad} AS b, CASE WHEN ({width} = 1 AND coalesce(lag({width}) OVER (PARTITION BY table_id ORDER BY r), 0) >= 4) OR (coalesce(lag({width}) OVER (PARTITION BY table_id ORDER BY r), 0) = 1 AND {width} >= 4) THEN 1 ELSE 0 END AS jump FROM ({_grid(d)}) g) a GROUP BY table_id"


@declared("TBL-05", "html_tables")
def _(d: Dialect) -> str:
    line = d.join("cells", " | ")
    return f"SELECT table_id, {d.listed('line', 'r')} AS text FROM (SELECT table_id, r, {line} AS line FROM ({_grid(d)}) g WHERE {d.size(d.keep('cells', 'c', 'c <> ' + chr(39) * 2))} > 0) a GROUP BY table_id"


_simple("TBL-10", "noisy", "doc_id, line_no", cells=lambda d: d.join(d.map(d.split(d.sub("replace(text, '. ', ' | ')", r"^[|+]+|[|+]+$"), rf"{S}*[|+]{S}*"), "c", d.trim("c")), "¦"))
_simple("TBL-08", "words", "doc_id, line_no, tok_no", cell=lambda d: "CASE WHEN length(word) > 3 THEN word WHEN lower(word) = 'v' THEN '✓' WHEN word IN ('o', 'O', '0') THEN '☐' WHEN lower(word) IN ('[v]', '[x]', 'ov', 'ox') THEN '☑' WHEN word = '->' THEN '→' WHEN word = '=>' THEN '⇒' WHEN word = '*' THEN '•' WHEN lower(word) = 'x' THEN '×' WHEN lower(word) = '(v)' THEN '✓' ELSE word END")


@declared("TBL-12", "html_tables")
def _(d: Dialect) -> str:
    nl = d.newline()
    return f"SELECT table_id, 'page' || {nl} || {nl} || '[TABEL]' || {nl} || {d.listed('line', 'r')} || {nl} || '[/TABEL]' AS text FROM (SELECT table_id, r, {d.join('cells', ' | ')} AS line FROM ({_grid(d)}) g) a GROUP BY table_id"


@declared("TBL-11", "html_tables")
def _(d: Dialect) -> str:
    rule = d.join(d.map("cells", "c", "'---'"), " | ")
    nl = d.newline()
    line = f"'| ' || {d.join('cells', ' | ')} || ' |' || CASE WHEN r = 0 THEN {nl} || '| ' || {rule} || ' |' ELSE '' END"
    return f"SELECT table_id, {d.listed('line', 'r')} AS markdown FROM (SELECT table_id, r, {line} AS line FROM ({_grid(d)}) g) a GROUP BY table_id"


# tree and legal structure
_simple("TRE-01", "noisy", "doc_id, line_no", heading=lambda d: legal.heading(d, "text"))
_simple("TRE-05", "noisy", "doc_id, line_no", kind=lambda d: legal.node_type(d, d.trim("text")))
_simple("LEG-02", "noisy", "doc_id, line_no", component=lambda d: legal.component(d, "text"))
_simple("STR-01", "noisy", "doc_id, line_no", kind=lambda d: legal.kind(d, "text"))
_simple("STR-02", "noisy", "doc_id, line_no", level=lambda d: legal.kind_level(legal.kind(d, "text")))


def _nodes(d: Dialect) -> str:
    return f"SELECT *, {legal.level('kind')} AS level, {legal.number(d, 'kind', 't')} AS number FROM (SELECT doc_id, line_no, page, t, {legal.node_type(d, 't')} AS kind FROM (SELECT doc_id, line_no, page, {d.trim('text')} AS t FROM noisy) a WHERE t <> '') b"


@declared("TRE-02", "rough")
def _(d: Dialect) -> str:
    nl, words = "\n", "Menimbang|Mengingat|Memutuskan|Menetapkan"
    split = d.subs("text", (rf"(?i):{S}+((?:{words}){S}*:)", ":" + nl + "$1"), (rf"(?i);{S}+((?:{words}){S}*:)", nl + "$1"), (rf"(?im)^(Menimbang|Mengingat){S}*:{S}*", "$1 :" + nl), (rf"(?i);{S}+((?:[a-z][.)]|[0-9]{{1,2}}[.)]){S})", nl + "$1"))
    pieces = d.keep(d.map(d.lines(split), "p", d.trim("p")), "p", "p <> ''")
    return d.exploded("(SELECT doc_id, text FROM rough) _r", "doc_id", pieces, "piece", "place").replace("SELECT doc_id, place,", "SELECT doc_id, CAST(place AS BIGINT) AS place,", 1)


@declared("TRE-03", "noisy")
def _(d: Dialect) -> str:
    t = d.trim("text")
    alone = f"({legal.heading(d, t)} OR {d.match(t, r'^\([0-9]+\) ')} OR {d.match(t, '^[a-z][.)] ')} OR {d.match(t, legal.TABLE_ROW)})"
    a = f"SELECT doc_id, line_no, page, {t} AS t, {alone} AS alone FROM noisy"
    b = f"SELECT *, CASE WHEN alone OR t = '' OR coalesce(lag(alone OR t = '') OVER w, true) OR page <> coalesce(lag(page) OVER w, page) THEN 1 ELSE 0 END AS opens FROM ({a}) a WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)"
    c = f"SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM ({b}) b"
    return f"SELECT doc_id, min(line_no) AS line_no, {d.listed('t', 'line_no', ' ')} AS text FROM ({c}) c WHERE t <> '' GROUP BY doc_id, island"


@declared("TRE-06", "noisy")
def _(d: Dialect) -> str:
    return f"SELECT doc_id, line_no, {d.sub(d.trim(legal.body(d, 'kind', 't')), f'{S}+', ' ')} AS body FROM ({_nodes(d)}) n"


@declared("TRE-08", "noisy")
def _(d: Dialect) -> str:
    """Parents by the nearest earlier line of a higher rank, without a stack."""
    part = "PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    last = lambda ranks: f"max(CASE WHEN level IN ({ranks}) THEN line_no END) OVER ({part})"
    return f"SELECT doc_id, line_no, kind, CASE level WHEN 1 THEN CAST(NULL AS BIGINT) WHEN 0 THEN CAST(NULL AS BIGINT) WHEN 2 THEN {last('1')} WHEN 3 THEN {last('1, 2')} WHEN 4 THEN {last('1, 2, 3')} ELSE {last('1, 2, 3, 4')} END AS parent FROM ({_nodes(d)}) n"


@declared("LEG-01", "noisy")
def _(d: Dialect) -> str:
    """Each line as the start of a collected text."""
    return f"SELECT doc_id, line_no, {legal.document_type(d, 'text')} AS types FROM noisy"


@declared("LEG-03", "noisy")
def _(d: Dialect) -> str:
    return f"SELECT doc_id, sum(CASE WHEN kind = 'pasal' AND number <> '' THEN 1 ELSE 0 END) AS pasal, sum(CASE WHEN kind = 'bab' THEN 1 ELSE 0 END) AS bab FROM ({_nodes(d)}) n GROUP BY doc_id"


@declared("STR-03", "noisy")
def _(d: Dialect) -> str:
    a = f"SELECT doc_id, line_no, {d.trim('text')} AS t, {legal.kind(d, d.trim('text'))} AS kind FROM noisy"
    b = f"SELECT *, CASE WHEN kind <> 'BODY' OR t = '' OR coalesce(lag(kind <> 'BODY' OR t = '') OVER w, true) THEN 1 ELSE 0 END AS opens FROM ({a}) a WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)"
    c = f"SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM ({b}) b"
    return f"SELECT doc_id, min(line_no) AS line_no, max(kind) AS kind, {d.listed('t', 'line_no', ' ')} AS text FROM ({c}) c WHERE t <> '' GROUP BY doc_id, island"


# review
def _roman(d: Dialect, x: str) -> str:
    """REV-09: a roman or plain number; a numeral before a larger one counts against."""
    x, digits = f"upper({x})", "IVXLCDM"
    value = dict(zip(digits, (1, 5, 10, 50, 100, 500, 1000), strict=True))
    terms = [f"{v} * {d.count(x, c)}" for c, v in value.items()] + [f"-{2 * value[c]} * {d.count(x, f'{c}[{digits[i + 1 :]}]')}" for i, c in enumerate(digits[:-1])]
    return f"CASE WHEN {d.match(x, '^[0-9]+$')} THEN CAST(nullif({d.extract(x, '^[0-9]+$')}, '') AS BIGINT) WHEN {d.match(x, f'^[{digits}]+$')} THEN {' + '.join(f'({t})' for t in terms)} END"


@declared("REV-01", "noisy")
def _(d: Dialect) -> str:
    n = f"SELECT *, {_roman(d, 'number')} AS num FROM ({_nodes(d)}) n WHERE kind IN ('bab', 'lampiran', 'pasal')"
    g = f"SELECT *, sum(CASE WHEN kind IN ('bab', 'lampiran') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS chapter FROM ({n}) m"
    p = f"SELECT *, CASE WHEN kind = 'bab' THEN lag(num) OVER (PARTITION BY doc_id, kind ORDER BY line_no) ELSE lag(num) OVER (PARTITION BY doc_id, kind, chapter ORDER BY line_no) END AS prev FROM ({g}) g"
    return f"SELECT doc_id, line_no, CASE WHEN num = prev THEN kind || '-duplicate' ELSE kind || '-order' END AS type, CASE WHEN kind = 'pasal' AND num < prev THEN 'error' ELSE 'warning' END AS severity FROM ({p}) p WHERE num <= prev"


@declared("REV-02", "noisy")
def _(d: Dialect) -> str:
    n = f"SELECT *, sum(CASE WHEN kind = 'pasal' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS article FROM ({_nodes(d)}) n"
    a = f"SELECT *, CAST(number AS INT) AS num, lag(CAST(number AS INT)) OVER (PARTITION BY doc_id, article ORDER BY line_no) AS prev, count(*) OVER (PARTITION BY doc_id, article) AS times FROM ({n}) m WHERE kind = 'ayat' AND article > 0"
    return f"SELECT doc_id, line_no, CASE WHEN prev IS NULL THEN 'ayat-start' ELSE 'ayat-order' END AS type, times FROM ({a}) a WHERE (prev IS NULL AND num <> 1) OR num <= prev"


@declared("REV-03", "noisy")
def _(d: Dialect) -> str:
    part = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)"
    s = f"SELECT *, max(CASE WHEN kind = 'bab' THEN 1 ELSE 0 END) {part} AS has_bab, max(CASE WHEN kind = 'pasal' THEN 1 ELSE 0 END) {part} AS has_pasal FROM ({_nodes(d)}) n"
    return f"SELECT doc_id, line_no, CASE WHEN kind = 'ayat' THEN 'orphan-ayat' WHEN kind IN ('huruf', 'angka') THEN 'orphan-item' ELSE 'heading-parent' END AS type FROM ({s}) s WHERE (kind IN ('ayat', 'huruf', 'angka') AND has_pasal = 0) OR (kind IN ('pasal', 'bagian', 'paragraf') AND has_bab = 0)"


@declared("REV-05", "noisy")
def _(d: Dialect) -> str:
    return f"SELECT doc_id, max(CASE WHEN kind = 'title' THEN 0 ELSE 1 END) = 1 AND max(CASE WHEN kind = 'title' THEN 1 ELSE 0 END) = 0 AS title_missing, max(CASE WHEN {legal.component(d, 't')} IS NOT NULL THEN 1 ELSE 0 END) = 0 AS preamble_missing FROM ({_nodes(d)}) n GROUP BY doc_id HAVING max(CASE WHEN kind = 'bab' THEN 1 ELSE 0 END) = 1"


@declared("REV-06", "noisy")
def _(d: Dialect) -> str:
    return "SELECT doc_id, line_no FROM (SELECT doc_id, line_no, p, lag(p) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM (SELECT doc_id, line_no, CASE WHEN line_no % 37 = 36 THEN page - 1 ELSE page END AS p FROM noisy) a) b WHERE p < prev"


@declared("REV-07", "words")
def _(d: Dialect) -> str:
    return "SELECT doc_id, page, sum(CASE WHEN confidence < 0.3 THEN 1 ELSE 0 END) AS low FROM words GROUP BY doc_id, page HAVING avg(confidence) < 0.3"


@declared("REV-08", "noisy")
def _(d: Dialect) -> str:
    one = DECLARED["REV-01"][1](d)
    three = DECLARED["REV-03"][1](d)
    every = f"SELECT doc_id, line_no, type, CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END AS weight FROM ({one}) a UNION ALL SELECT doc_id, line_no, type, CASE WHEN type = 'orphan-item' THEN 1 ELSE 2 END FROM ({three}) b"
    top = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, line_no, type) AS n FROM ({every}) e"
    return f"SELECT doc_id, count(*) AS issues, round(greatest(0, 1 - sum(CASE weight WHEN 3 THEN 0.25 WHEN 2 THEN 0.1 ELSE 0.03 END)), 3) + CAST(0 AS DOUBLE) AS score FROM ({top}) t WHERE n <= 50 GROUP BY doc_id"


# quality
_simple("QM-01", "words", "doc_id, line_no, tok_no, word", garbage=lambda d: text.garbage_word(d, "word"))
_simple("QM-09", "documents_", "doc_id", ratio=lambda d: text.common_ratio(d, "replace(text, ' the ', ' dan ')"))
_simple("QM-10", "documents_", "doc_id", trustworthy=lambda d: text.trustworthy(d, "replace(text, ' the ', ' dan ')"))
_simple("QM-11", "noisy", "doc_id, line_no", mirror=lambda d: f"({d.match('text', text.CJK)} OR {d.match('text', text.SYMBOL)} OR coalesce({text.common_ratio(d, 'text')} = 0, false))")
_simple("QM-08", "attempts", "doc_id, page, retry", dpi=lambda d: "CASE least(retry, 2) WHEN 0 THEN 1.5 WHEN 1 THEN 2.0 ELSE 2.5 END + CAST(0 AS DOUBLE)", steps=lambda d: "CASE least(retry, 2) WHEN 0 THEN 'enhanced' WHEN 1 THEN 'light' ELSE 'aggressive' END")
_SCALE = "2.0 * CASE WHEN has_table THEN CASE least(retry, 2) WHEN 0 THEN 1.5 WHEN 1 THEN 2.0 ELSE 2.5 END ELSE CASE least(retry, 2) WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 ELSE 2.0 END END + CAST(0 AS DOUBLE)"
DECLARED["SRC-14"] = (("attempts",), lambda d: f"SELECT doc_id, page, retry, scale, row_number() OVER (PARTITION BY doc_id, page, scale ORDER BY retry) > 1 AS cached FROM (SELECT doc_id, page, retry, {_SCALE} AS scale FROM attempts) s")
_simple("SRC-17", "documents_", "doc_id", file_hash=lambda d: d.sha("text"))


def _verified(d: Dialect) -> str:
    """QM-15. Engines differ in word edges, so edges are written twice and each match takes its own."""
    edges = d.sub("text", "[^A-Za-z0-9_]", "  ")
    dotted = d.sub(d.sub("text", "[^A-Za-z0-9_.]", "  "), "[.]", "..")
    apart = d.sub("text", "[^A-Za-z0-9_ ]", " - ")
    counts = {"chars": "CAST(length(text) AS BIGINT)", "cjk": d.count("text", text.CJK), "symbols": d.count("text", text.SYMBOL), "glued": d.count(edges, EDGE_A + "[A-Za-z]{3,}[0-9]{2,4}" + EDGE_B), "dots": d.count(dotted, EDGE_A + "[A-Za-z]{2,}[.][.][A-Za-z]{2,}" + EDGE_B), "mirror_runs": d.count(apart, EDGE_A + "[A-Za-z]( [A-Za-z0-9]{1,2})+" + EDGE_B)}
    return f"SELECT *, cjk + symbols + mirror_runs AS anomalies FROM (SELECT doc_id, line_no, {', '.join(f'{e} AS {c}' for c, e in counts.items())} FROM noisy) v"


DECLARED["QM-15"] = (("noisy",), _verified)


def _pages(d: Dialect) -> str:
    """QM-02."""
    return f"SELECT doc_id, page, sum(CAST(round(confidence * 1000000) AS BIGINT)) / CAST(count(*) * 1000000 AS DOUBLE) AS confidence, count(*) AS word_count, sum(g) / CAST(count(*) AS DOUBLE) AS garbage_ratio, avg(CAST(length(word) AS DOUBLE)) AS avg_word_length, sum(c) AS cjk_words FROM (SELECT *, CASE WHEN {text.garbage_word(d, 'word')} THEN 1 ELSE 0 END AS g, CASE WHEN {d.match('word', text.CJK)} AND NOT {d.match('word', text.ALPHA)} THEN 1 ELSE 0 END AS c FROM words) w GROUP BY doc_id, page"


def _scored(d: Dialect) -> str:
    """QM-05 as written: a garbage ratio of nought counts as one."""
    g = "CASE WHEN garbage_ratio = 0 THEN 1 ELSE garbage_ratio END"
    return f"SELECT *, floor((0.5 * confidence + 0.35 * (1 - {g}) + 0.15 * least(word_count / CAST(20 AS DOUBLE), 1)) * 10000 + 0.5) / CAST(10000 AS DOUBLE) AS score, {g} AS strict_ratio FROM ({_pages(d)}) p"


DECLARED["QM-02"] = (("words",), lambda d: f"SELECT doc_id, page, round(confidence, 6) AS confidence, word_count, round(garbage_ratio, 6) AS garbage_ratio, round(avg_word_length, 6) AS avg_word_length, cjk_words FROM ({_pages(d)}) q")
DECLARED["QM-05"] = (("words",), lambda d: f"SELECT doc_id, page, score FROM ({_scored(d)}) q")
DECLARED["QM-06"] = (("words",), lambda d: f"SELECT doc_id, page, word_count >= 5 AND confidence >= 0.3 AND strict_ratio <= 0.4 AND score >= 0.3 AS accepted FROM ({_scored(d)}) q")
DECLARED["QM-07"] = (("words",), lambda d: f"SELECT doc_id, page, word_count < 5 OR (confidence < 0.3 AND word_count > 0) OR (garbage_ratio > 0.4 AND word_count >= 5) AS retry FROM ({_pages(d)}) q")


@declared("QM-03", "noisy")
def _(d: Dialect) -> str:
    t, w = "t", "ws"
    bad = f"({d.size(d.keep(w, 'u', d.match('u', '^[0-9]{1,2}$')))} > 0.6 * {d.size(w)} AND {d.size(d.keep(w, 'u', 'length(u) <= 2'))} > 0.6 * {d.size(w)} AND NOT {d.match(t, text.LATIN)} AND length(t) > 3)"
    return f"SELECT doc_id, count(*) AS line_count, round(avg(CAST(length(t) AS DOUBLE)), 6) AS avg_line_length, round(1 - 0.8 * avg(CASE WHEN {bad} THEN 1.0 ELSE 0.0 END) + CAST(0 AS DOUBLE), 6) AS score FROM (SELECT doc_id, {d.trim('text')} AS t, {d.words('text')} AS ws FROM noisy) a WHERE t <> '' GROUP BY doc_id"


@declared("QM-04", "blocks")
def _(d: Dialect) -> str:
    return f"SELECT doc_id, page, count(*) >= 3 AND avg(CASE WHEN {d.match('text', '^[0-9.,%]+$')} THEN 1.0 ELSE 0.0 END) > 0.3 AS has_table, round(avg(confidence), 6) AS quality FROM blocks GROUP BY doc_id, page"


_LINE_SCORE = lambda d: f"(10 * coalesce({text.common_ratio(d, 'text')}, 0) + {d.count('text', '[A-Za-z]{3,}')} / CAST(60 AS DOUBLE) - 1.5 * {d.count('text', text.CJK)} - 2 * {d.size(d.keep(d.words('text'), 'u', text.garbage_word(d, 'u')))} / greatest(CAST({d.size(d.words('text'))} AS DOUBLE), 1))"
_simple("QM-12", "noisy", "doc_id, line_no", readability=lambda d: f"round({_LINE_SCORE(d)}, 6)")
_simple("QM-13", "noisy", "doc_id, line_no", readability=lambda d: f"round(10 * coalesce({text.common_ratio(d, 'text')}, 0) + 0.5 * least({d.count('text', '[A-Za-z]')} / CAST(80 AS DOUBLE), 1) + 0.3 * least({d.count('text', '[0-9]')} / CAST(150 AS DOUBLE), 1) - 1.5 * least({d.count('text', text.CJK)} / CAST(300 AS DOUBLE), 1), 6)")
DECLARED["QM-14"] = (("noisy",), lambda d: f"SELECT doc_id, line_no, text FROM noisy WHERE NOT {d.match('text', text.CJK)} AND {_LINE_SCORE(d)} >= -0.5")


def _table_score(d: Dialect) -> str:
    """MET-07: drawn rules, and whether all body lines have as many bars."""
    rules = d.count("text", r"\+[-+]+\+")
    body = d.keep(d.lines("text"), "l", "substr(l, 1, 1) = '|'")
    bars = d.map(body, "l", d.count("l", "[|]"))
    low, high = ("array_min", "array_max") if d.spark else ("list_min", "list_max")
    base = f"least(1, {rules} / CAST(10 AS DOUBLE))"
    return f"round(CASE WHEN {rules} = 0 THEN 0 WHEN {rules} < 2 OR {d.size(body)} < 2 THEN 0.1 WHEN {low}({bars}) = {high}({bars}) THEN least(1, {base} + 0.3) ELSE {base} END + CAST(0 AS DOUBLE), 6)"


_simple("MET-07", "documents_", "doc_id", score=_table_score)
_simple("MET-08", "rough", "doc_id", score=lambda d: f"round(CASE WHEN {d.match('text', rf'(?i)(^|[^A-Za-z0-9_])BAB{S}+([IVXLCDM]+($|[^A-Za-z0-9_])|[0-9]+)')} THEN 0.3 ELSE 0.0 END + CASE WHEN {d.match('text', rf'(?i)(^|[^A-Za-z0-9_])Pasal{S}+[0-9]+')} THEN 0.3 ELSE 0.0 END + CASE WHEN {d.match('text', r'\([0-9]+[a-z]?\)')} OR {d.match('text', rf'(?i)(^|[^A-Za-z0-9_])Ayat{S}+')} THEN 0.2 ELSE 0.0 END + CASE WHEN {d.match('text', rf'(?i)(^|[^A-Za-z0-9_])Bagian{S}+(Kesatu|Kedua|Ketiga)')} THEN 0.2 ELSE 0.0 END + CAST(0 AS DOUBLE), 3)")


# benchmark metrics
DECLARED["MET-04"] = (("words",), lambda d: "SELECT doc_id, round(coalesce(avg(CASE WHEN confidence > 0 THEN confidence END), 0), 6) AS confidence FROM words GROUP BY doc_id")
DECLARED["MET-05"] = (("hyp_ref",), lambda d: "SELECT doc_id, engine, round(CASE WHEN duration_ms > 0 THEN pages * 1000 / CAST(duration_ms AS DOUBLE) ELSE 0 END, 6) AS speed FROM hyp_ref")


@declared("MET-06", "lines")
def _(d: Dialect) -> str:
    def breaks(cut: str) -> str:
        kept = f"SELECT doc_id, line_no, {d.trim('text')} AS t FROM lines WHERE {cut}"
        prev = f"SELECT doc_id, t, lag(t) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM ({kept}) a"
        return f"SELECT doc_id, sum(CASE WHEN t <> '' AND {d.match('p', r'[.:\x22]$')} THEN 1 ELSE 0 END) AS n FROM ({prev}) b GROUP BY doc_id"

    return f"SELECT r.doc_id, round(CASE WHEN r.n = 0 AND coalesce(h.n, 0) = 0 THEN 1 WHEN r.n = 0 OR coalesce(h.n, 0) = 0 THEN 0 ELSE least(h.n / CAST(r.n AS DOUBLE), r.n / CAST(h.n AS DOUBLE)) END, 6) AS layout FROM ({breaks('true')}) r LEFT JOIN ({breaks('line_no % 3 <> 1')}) h ON r.doc_id = h.doc_id"


# outputs
DECLARED["OUT-01"] = (("noisy",), lambda d: f"SELECT doc_id, {d.listed(d.sub('text', f'{S}+$'), 'line_no')} AS text FROM noisy GROUP BY doc_id")


@declared("OUT-02", "noisy")
def _(d: Dialect) -> str:
    nl = d.newline()
    line = f"CASE kind WHEN 'bab' THEN '## ' || t WHEN 'title' THEN '**' || t || '**' WHEN 'bagian' THEN '### ' || t WHEN 'paragraf' THEN '#### ' || t WHEN 'pasal' THEN '**Pasal ' || number || '**' || {nl} || {legal.body(d, 'kind', 't')} WHEN 'ayat' THEN '(' || number || ') ' || {legal.body(d, 'kind', 't')} WHEN 'huruf' THEN '  ' || number || '. ' || {legal.body(d, 'kind', 't')} WHEN 'angka' THEN '  ' || number || '. ' || {legal.body(d, 'kind', 't')} ELSE CASE WHEN {legal.component(d, 't')} IS NOT NULL THEN '**' || {d.extract('t', '^[A-Za-z]+')} || ':**' || {d.sub('t', f'^[A-Za-z]+{S}*:')} ELSE t END END"
    return f"SELECT doc_id, {d.listed('line', 'line_no')} AS markdown FROM (SELECT doc_id, line_no, {line} AS line FROM ({_nodes(d)}) n) m GROUP BY doc_id"


@declared("OUT-03", "noisy")
def _(d: Dialect) -> str:
    esc = "replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    line = f"CASE kind WHEN 'pasal' THEN '<div class=\"pasal\"><strong>' || {esc} || '</strong></div>' WHEN 'title' THEN '<h1>' || {esc} || '</h1>' WHEN 'bab' THEN '<h2>' || {esc} || '</h2>' ELSE '<p>' || {esc} || '</p>' END"
    return f"SELECT doc_id, '<!DOCTYPE html><html><body>' || {d.listed('line', 'line_no', '')} || '</body></html>' AS html FROM (SELECT doc_id, line_no, {line} AS line FROM ({_nodes(d)}) n) m GROUP BY doc_id"


@declared("OUT-05")
def _(d: Dialect) -> str:
    last = d.div("greatest(length(text) - 1, 0)", "800")
    seq = f"sequence(0, CAST({last} AS INT))" if d.spark else f"range(0, CAST({last} AS BIGINT) + 1)"
    return f"SELECT doc_id, CAST(k AS BIGINT) AS chunk, substr(text, CAST(k * 800 + 1 AS INT), 1000) AS text FROM (SELECT doc_id, text, {'explode' if d.spark else 'unnest'}({seq}) AS k FROM documents WHERE text <> '') a"


DECLARED["OUT-06"] = ((), lambda d: f"SELECT doc_id || ':' || chunk AS id, text FROM ({DECLARED['OUT-05'][1](d)}) c")
# sources
_simple("SRC-05", "queue", "seq", url=lambda d: "CASE WHEN substr(coalesce(nullif(trim(url), ''), nullif(trim(file_url), '')), 1, 1) = '/' THEN 'https://api.example.com' || coalesce(nullif(trim(url), ''), nullif(trim(file_url), '')) ELSE coalesce(nullif(trim(url), ''), nullif(trim(file_url), '')) END")
_simple("SRC-02", "queue", "seq", url=lambda d: d.sub("trim(file_url)", r"\s", "%20"))
_simple("JQ-08", "queue", "seq", same_host=lambda d: f"coalesce({d.extract('trim(file_url)', '^https?://([^/]+)', 1)} = 'h.example.com', false)")
_simple("JQ-09", "queue", "seq", file_name=lambda d: f"substr({d.subs(d.extract('trim(file_url)', '([^/]*)$', 1), (r'(?i)\.pdf$', ''), ('[^a-zA-Z0-9 _-]', '_'))}, 1, 200)")
_IMAGE_SCORE = lambda d: f"greatest({d.count('body', '/XObject')}, {d.count('body', '/Subtype /Image')}) - ({d.count('body', r'\([^)]{4,}\)')} + 5 * {d.count('body', 'TJ')})"
_simple("SRC-09", "pdfs", "doc_id", score=_IMAGE_SCORE)
_simple("SRC-10", "pdfs", "doc_id", version=lambda d: d.extract("body", "%PDF-([0-9]+[.][0-9]+)", 1), pages=lambda d: f"CASE WHEN {d.count('body', '/Type */Page[^s]')} > 0 THEN {d.count('body', '/Type */Page[^s]')} ELSE greatest({d.count('body', r'/Pages \[')}, 1) END")


def _digital(d: Dialect) -> str:
    score = f"({d.count('body', r'\([^)]{3,}\)')} + 5 * {d.count('body', 'TJ')})"
    pages = d.count("body", "/Type */Page[^s]")
    return f"CASE WHEN has_blocks THEN true WHEN length(body) < 100 THEN false WHEN {pages} > 0 AND {score} > 3 * {pages} THEN true ELSE {score} > 20 END"


def _pdf_kind(d: Dialect) -> str:
    size, good = f"length({d.trim('layer')})", text.trustworthy(d, "layer")
    return f"CASE WHEN corrupt THEN 'SCAN' WHEN {size} >= 200 AND {size} >= 15 * page_count AND {good} THEN 'TEXT' WHEN {_IMAGE_SCORE(d)} > 10 THEN 'SCAN' WHEN {size} >= 200 AND {good} THEN 'TEXT' ELSE 'SCAN' END"


_simple("SRC-11", "pdfs", "doc_id", digital=_digital)
_simple("SRC-08", "pdfs", "doc_id", kind=_pdf_kind, pages=lambda d: "CASE WHEN corrupt THEN 0 ELSE page_count END")
DECLARED["SRC-12"] = (("figures",), lambda d: f"SELECT doc_id, page, sum({d.size('ws')}) AS words, count(*) AS blocks, max(CASE WHEN {d.size('ws')} > 3 AND {d.size(d.keep('ws', 'u', d.match('u', '^[0-9]+$')))} = {d.size('ws')} THEN 1 ELSE 0 END) AS has_tables FROM (SELECT doc_id, page, {d.words('text')} AS ws FROM figures) w GROUP BY doc_id, page")
DECLARED["SRC-07"] = ((), lambda d: d.exploded("(SELECT doc_id, text FROM documents) _d", "doc_id", d.split("replace(text, '. ', chr(12))", r"\f"), "part", "page").replace("SELECT doc_id, page,", "SELECT doc_id, CAST(page AS BIGINT) AS page,", 1))
DECLARED["SRC-15"] = (("hyp_ref",), lambda d: "SELECT a.doc_id, a.hyp, b.ref FROM (SELECT doc_id, hyp FROM hyp_ref WHERE engine = 'paddle') a JOIN (SELECT doc_id, ref FROM hyp_ref WHERE engine = 'surya') b ON a.doc_id = b.doc_id")

# the ledger
_OK = "status = 'BERHASIL'"
_SUMS = f"count(*) AS total, sum(CASE WHEN {_OK} THEN 1 ELSE 0 END) AS berhasil, sum(CASE WHEN status = 'GAGAL' THEN 1 ELSE 0 END) AS gagal, sum(CASE WHEN status = 'RUSAK' THEN 1 ELSE 0 END) AS rusak, sum(CASE WHEN status = 'KOSONG' THEN 1 ELSE 0 END) AS kosong, sum(CASE WHEN text_uploaded = 1 THEN 1 ELSE 0 END) AS uploaded, round(avg(CAST(duration_seconds AS DOUBLE)), 1) AS avg_duration"
_FIRST = lambda key, ok: f"(SELECT {key}, min(id) AS first FROM activities WHERE {ok} GROUP BY {key})"
_STORED = f"{_OK} AND output_text IS NOT NULL"
_LEDGER = {
    "ACT-01": lambda d: "SELECT id, file_name, status, created_at FROM activities WHERE output_text IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 200",
    "ACT-02": lambda d: "SELECT id, file_name, status, file_hash FROM activities WHERE id = 17",
    "ACT-03": lambda d: "SELECT id, file_name, status FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY id DESC) AS n FROM activities) a WHERE n = 1",
    "ACT-04": lambda d: f"SELECT {_SUMS} FROM activities WHERE output_text IS NOT NULL",
    "ACT-05": lambda d: f"SELECT {d.date_text('created_at')} AS date, count(*) AS total FROM activities WHERE output_text IS NOT NULL AND created_at >= {d.day(chr(39) + '2024-01-23' + chr(39))} GROUP BY {d.date_text('created_at')}",
    "ACT-06": lambda d: f"SELECT DISTINCT q.source_url FROM activities q JOIN {_FIRST('source_url', _OK)} a ON a.source_url = q.source_url AND a.first < q.id",
    "ACT-07": lambda d: f"SELECT q.id FROM activities q JOIN {_FIRST('file_hash', _STORED)} a ON a.file_hash = q.file_hash AND a.first < q.id",
    "ACT-08": lambda d: f"SELECT {_SUMS}, sum(CASE WHEN text_uploaded = 0 AND {_OK} THEN 1 ELSE 0 END) AS belum_uploaded FROM activities WHERE {d.day('created_at')} BETWEEN {d.day(chr(39) + '2024-01-05' + chr(39))} AND {d.day(chr(39) + '2024-01-20' + chr(39))}",
    "ACT-09": lambda d: f"SELECT {d.date_text('created_at')} AS date, count(*) AS total, sum(text_uploaded) AS uploaded FROM activities GROUP BY {d.date_text('created_at')}",
    "ACT-10": lambda d: "SELECT id, file_name, source_type, source_url, file_hash, status, error_message, page_count, file_size_bytes, CAST(duration_seconds AS DOUBLE) AS duration_seconds, text_uploaded, created_at FROM activities",
    "ACT-12": lambda d: f"SELECT q.id, q.file_hash FROM activities q LEFT JOIN {_FIRST('file_hash', _STORED)} a ON a.file_hash = q.file_hash WHERE q.id <= coalesce(a.first, q.id)",
    "ACT-14": lambda d: "SELECT status, source_type, count(*) AS n, max(id) AS last_id FROM activities GROUP BY status, source_type",
    "RPT-01": lambda d: "SELECT id, CASE status WHEN 'BERHASIL' THEN 'File berhasil dikonversi menjadi teks' WHEN 'GAGAL' THEN coalesce('Gagal: ' || error_message, 'Terjadi kesalahan saat pemrosesan') WHEN 'RUSAK' THEN coalesce('File rusak: ' || error_message, 'File PDF corrupt atau tidak bisa dibaca') WHEN 'KOSONG' THEN 'File 0 byte atau hasil konversi tidak menghasilkan teks' ELSE '-' END AS description FROM activities",
    "RPT-02": lambda d: f"SELECT id, CASE {'dayofweek(created_at) - 1' if d.spark else 'dayofweek(created_at)'} WHEN 0 THEN 'Minggu' WHEN 1 THEN 'Senin' WHEN 2 THEN 'Selasa' WHEN 3 THEN 'Rabu' WHEN 4 THEN 'Kamis' WHEN 5 THEN 'Jumat' ELSE 'Sabtu' END AS day FROM activities",
    "RPT-03": lambda d: "SELECT status, round(100.0 * n / CAST(sum(n) OVER () AS DOUBLE), 1) AS share FROM (SELECT status, count(*) AS n FROM activities GROUP BY status) a",
    "RPT-04": lambda d: f"SELECT date, total, uploaded, greatest(total, uploaded) AS top FROM (SELECT {d.date_text('created_at')} AS date, count(*) AS total, sum(text_uploaded) AS uploaded FROM activities GROUP BY {d.date_text('created_at')}) a ORDER BY date LIMIT 14",
    "SRC-06": lambda d: "SELECT id, file_name, status FROM activities WHERE output_text IS NOT NULL",
    "SNK-04": lambda d: f"SELECT count(*) AS total, sum(CASE WHEN {_OK} THEN 1 ELSE 0 END) AS berhasil, sum(CASE WHEN {_OK} THEN 0 ELSE 1 END) AS gagal FROM activities",
    "SNK-05": lambda d: f"SELECT id, concat_ws(';', CAST(id AS {'STRING' if d.spark else 'VARCHAR'}), file_name, status, replace(CAST(duration_seconds AS {'STRING' if d.spark else 'VARCHAR'}), '.', ','), {'date_format(created_at, ' + chr(39) + 'dd-MM-yyyy' + chr(39) + ')' if d.spark else 'strftime(created_at, ' + chr(39) + '%d-%m-%Y' + chr(39) + ')'}) AS line FROM activities",
    "SNK-09": lambda d: "SELECT name, text, CASE WHEN text IS NULL THEN 404 ELSE 200 END AS status FROM (SELECT q.name, coalesce('file ' || f.base, a.output_text) AS text FROM (SELECT base AS name FROM files UNION SELECT file_name FROM activities) q LEFT JOIN (SELECT DISTINCT base FROM files WHERE extension = '.txt') f ON q.name = f.base LEFT JOIN (SELECT file_name, max(output_text) AS output_text FROM activities GROUP BY file_name) a ON q.name = a.file_name) d",
    "SNK-10": lambda d: f"SELECT f.file_id, f.base || f.extension AS name, {d.match('f.extension', '(?i)^[.](txt|md)$')} AND f.age_minutes >= 10 AND (l.file_name IS NOT NULL OR f.age_minutes > 43200) AS removed FROM files f LEFT JOIN (SELECT DISTINCT file_name FROM activities) l ON f.base = l.file_name",
    "SNK-02": lambda d: "SELECT id, file_name, coalesce(page_count, 0) AS page_count, nullif(error_message, '') AS error_message, 1 AS text_uploaded FROM activities WHERE output_text IS NOT NULL",
    "SNK-03": lambda d: "SELECT id, status, NOT delete_asked AS kept, CASE WHEN delete_asked THEN file_name || '.txt' END AS removed_file, CASE WHEN delete_asked AND source_type = 'url' THEN source_url END AS queued_again FROM activities",
}
for _name, _f in _LEDGER.items():
    DECLARED[_name] = (("activities", "files") if _name in ("SNK-09", "SNK-10") else ("activities",), _f)


@declared("JQ-04", "queue")
def _(d: Dialect) -> str:
    u = "coalesce(nullif(trim(url), ''), nullif(trim(file_url), ''))"
    return f"SELECT seq, id, CASE WHEN op <> 'new' THEN op WHEN {u} IS NULL THEN 'SKIPPED' WHEN outcome = 'BERHASIL' THEN 'PENDING' ELSE 'ACKED' END AS action FROM queue"


@declared("JQ-03", "queue")
def _(d: Dialect) -> str:
    """State of each id after its last event, the machine's transitions folded by what came last."""
    a = DECLARED["JQ-04"][1](d)
    marks = f"SELECT id, coalesce(max(CASE WHEN action = 'reset' THEN seq END), -1) AS r FROM ({a}) a GROUP BY id"
    live = f"SELECT a.id, a.seq, a.action, m.r FROM ({a}) a JOIN ({marks}) m ON a.id = m.id WHERE a.seq > m.r"
    firsts = f"SELECT id, min(CASE WHEN action IN ('PENDING', 'ACKED') THEN seq END) AS f, max(CASE WHEN action = 'SKIPPED' THEN 1 ELSE 0 END) AS skipped FROM ({live}) l GROUP BY id"
    saved = f"SELECT l.id, min(CASE WHEN l.seq = f.f THEN l.action END) AS first_action, max(CASE WHEN l.action = 'save' AND l.seq > f.f THEN 1 ELSE 0 END) AS saved FROM ({live}) l JOIN ({firsts}) f ON l.id = f.id GROUP BY l.id"
    return f"SELECT m.id, CASE WHEN s.first_action = 'PENDING' AND s.saved = 1 THEN 'ACKED' WHEN s.first_action IS NOT NULL THEN s.first_action WHEN f.skipped = 1 THEN 'SKIPPED' ELSE 'NEW' END AS state FROM ({marks}) m LEFT JOIN ({firsts}) f ON m.id = f.id LEFT JOIN ({saved}) s ON m.id = s.id"


DECLARED["JQ-06"] = (("queue",), lambda d: f"SELECT count(*) AS fetched, sum(CASE WHEN action = 'SKIPPED' THEN 1 ELSE 0 END) AS skipped, sum(CASE WHEN action = 'PENDING' THEN 1 ELSE 0 END) AS pending, sum(CASE WHEN action = 'ACKED' THEN 1 ELSE 0 END) AS acked FROM ({DECLARED['JQ-04'][1](d)}) a")
DECLARED["JQ-10"] = (("queue",), lambda d: "SELECT seq, round(10 + 20 * (0.15 + 0.85 * (seq % 101) / CAST(100 AS DOUBLE)), 6) AS pct FROM queue")


DECLARED["TBL-01"] = (("html_tables",), lambda d: f"SELECT table_id, r, {d.join('cells', '¦')} AS cells FROM ({_grid(d)}) g")
DECLARED["TBL-15"] = (("html_tables",), lambda d: f"SELECT table_id, sum({d.size(d.keep('cells', 'c', 'c <> ' + chr(39) * 2))}) >= 4 AND max(CASE WHEN {d.match(d.join('cells', ' '), '[0-9]')} THEN 1 ELSE 0 END) = 1 AS usable FROM ({_grid(d)}) g GROUP BY table_id")
DECLARED["REV-04"] = (("html_tables",), lambda d: f"SELECT table_id FROM ({_grid(d)}) g GROUP BY table_id HAVING sum(CASE WHEN NOT header AND {d.size(d.keep('cells', 'c', 'c <> ' + chr(39) * 2))} >= 2 THEN 1 ELSE 0 END) < 2")
DECLARED["TRE-04"] = (("noisy",), lambda d: f"SELECT doc_id, line_no FROM noisy WHERE {d.match('text', legal.TABLE_ROW)} OR {d.match('text', legal.TABLE_SEPARATOR)} OR (length(text) > 20 AND {d.match('text', '[|+]')})")
DECLARED["TRE-11"] = (("noisy",), lambda d: f"SELECT doc_id, line_no, kind, number, level, page, t AS title, {d.sub(d.trim(legal.body(d, 'kind', 't')), f'{S}+', ' ')} AS text FROM ({_nodes(d)}) n")
DECLARED["SRC-18"] = (("pdfs",), lambda d: f"SELECT doc_id, CASE WHEN unreachable THEN 'GAGAL' WHEN n_bytes = 0 THEN 'KOSONG' WHEN corrupt THEN 'RUSAK' WHEN {d.trim('layer')} = '' THEN 'KOSONG' ELSE 'BERHASIL' END AS status FROM pdfs")
DECLARED["ACT-11"] = (("activities",), lambda d: "SELECT id, coalesce(nullif(file_name, ''), 'doc') AS file_name, CASE WHEN output_text IS NOT NULL THEN 1 ELSE text_uploaded END AS text_uploaded FROM activities WHERE NOT delete_asked")
DECLARED["ACT-13"] = (("activities",), lambda d: "SELECT id, file_name, source_type IN ('url', 'upload') AS source_ok, status IN ('BERHASIL', 'GAGAL', 'RUSAK', 'KOSONG') AS status_ok FROM activities")
DECLARED["SNK-12"] = (("blocks",), lambda d: "SELECT doc_id, ord, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM blocks) b WHERE n <= 500")
DECLARED["JQ-05"] = (("queue",), lambda d: "SELECT id, max(seq) AS last_reset FROM queue WHERE op = 'reset' GROUP BY id")
DECLARED["JQ-02"] = (("queue",), lambda d: "SELECT q.id, min(q.seq) AS first_seen FROM queue q LEFT JOIN (SELECT id, max(seq) AS r FROM queue WHERE op = 'reset' GROUP BY id) m ON q.id = m.id WHERE q.op = 'new' AND q.seq > coalesce(m.r, -1) GROUP BY q.id")


@declared("WRD-04", "words")
def _(d: Dialect) -> str:
    """Words of each document that the dictionary has, the dictionary as a table."""
    from foliospark.functions.lexicon import DICTIONARY

    rows = ", ".join(f"('{w}')" for w in sorted(DICTIONARY))
    return f"SELECT w.doc_id, count(*) AS n FROM words w JOIN (SELECT * FROM (VALUES {rows}) AS v(word)) x ON lower(w.word) = x.word GROUP BY w.doc_id"


@declared("TYP-02", "words")
def _(d: Dialect) -> str:
    rows = ", ".join(f"('{a}', '{b}')" for a, b in text.TYPOS.items())
    return f"SELECT w.doc_id, w.line_no, w.tok_no, CASE WHEN upper(w.word) = w.word THEN upper(x.fix) WHEN upper(substr(w.word, 1, 1)) = substr(w.word, 1, 1) THEN upper(substr(x.fix, 1, 1)) || substr(x.fix, 2) ELSE x.fix END AS word FROM words w JOIN (SELECT * FROM (VALUES {rows}) AS v(bad, fix)) x ON lower(w.word) = x.bad"


@declared("TBL-14", "blocks")
def _(d: Dialect) -> str:
    """Blocks outside a page's table region, then the table's own."""
    if d.spark:  # the region beside each block, by one exchange; no second reading of the blocks to match them
        page = "OVER (PARTITION BY doc_id, page)"
        placed = f"SELECT doc_id, page, ord, x + w / 2 AS cx, y + h / 2 AS cy, min(x) {page} AS tx, min(y) {page} AS ty, 100.0 AS tw, 60.0 AS th FROM blocks"
        return f"SELECT doc_id, page, ord FROM ({placed}) p WHERE NOT (cx BETWEEN tx AND tx + tw AND cy BETWEEN ty AND ty + th) UNION ALL SELECT DISTINCT doc_id, page, -1 AS ord FROM blocks"
    table = "SELECT doc_id, page, min(x) AS tx, min(y) AS ty, 100.0 AS tw, 60.0 AS th, count(*) AS n FROM blocks GROUP BY doc_id, page"
    kept = f"SELECT b.doc_id, b.page, b.ord FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM ({table}) t WHERE t.doc_id = b.doc_id AND t.page = b.page AND b.x + b.w / 2 BETWEEN tx AND tx + tw AND b.y + b.h / 2 BETWEEN ty AND ty + th)"
    return f"{kept} UNION ALL SELECT doc_id, page, -1 AS ord FROM ({table}) u"


DECLARED["SNK-07"] = (("queue",), lambda d: f"SELECT seq, id, CASE action WHEN 'reset' THEN 0 ELSE 1 END AS converted FROM ({DECLARED['JQ-04'][1](d)}) a WHERE action IN ('reset', 'ACKED', 'save')")
DECLARED["SNK-08"] = (("queue",), lambda d: f"SELECT seq, CASE action WHEN 'SKIPPED' THEN 'skip' WHEN 'ACKED' THEN 'error' ELSE 'result' END AS event, id FROM ({DECLARED['JQ-04'][1](d)}) a WHERE action IN ('SKIPPED', 'ACKED', 'PENDING')")
DECLARED["JQ-11"] = (("settings", "queue"), lambda d: f"SELECT s.id, s.flag AND s.base_url IS NOT NULL AS enabled, coalesce(s.base_url <> '' AND s.user_name <> '' AND s.password <> '', false) AS configured, CASE WHEN coalesce(s.base_url <> '' AND s.user_name <> '' AND s.password <> '', false) THEN q.ids ELSE 'not configured' END AS sample FROM settings s CROSS JOIN (SELECT {d.listed('CAST(seq AS STRING)' if d.spark else 'CAST(seq AS VARCHAR)', 'seq', ',')} AS ids FROM (SELECT seq FROM queue ORDER BY seq LIMIT 3) t) q")


def _spark(name: str) -> Callable[[SparkSession, str], DataFrame]:
    views, select = DECLARED[name]
    views = tuple(v for v in views if v != "documents_")
    return lambda spark, sf_dir: spark.sql(compiled(SPARK, select(SPARK).replace("documents_", "documents"), views, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"flagship": flagship} | {n: _spark(n) for n in sorted(DECLARED)} | kernels.queries()


def oracle_sql() -> dict[str, str]:
    return {n: compiled(DUCK, f(DUCK).replace("documents_", "documents"), tuple(v for v in views if v != "documents_")) for n, (views, f) in DECLARED.items()} | {"flagship": _flagship_sql(DUCK)} | _kernels_sql()


def _kernels_sql() -> dict[str, str]:
    """Kernels that SQL can express in another way."""
    d = DUCK
    address = "coalesce(nullif(trim(url), ''), nullif(trim(file_url), ''))"
    return {
        "SNK-01": "SELECT 'doc_' || CAST(doc_id % 20 AS VARCHAR) AS file_name, replace(text, chr(10), ' ') AS value FROM documents WHERE trim(replace(text, chr(10), ' ')) <> ''",
        "SRC-01": compiled(d, "SELECT CAST(seq AS VARCHAR) AS id, coalesce(trim(file_url), '') AS url, 'nama ' || CAST(id AS VARCHAR) AS nama FROM queue", ("queue",)),
        "SRC-04": compiled(d, f"SELECT seq AS id, CASE WHEN substr({address}, 1, 1) = '/' THEN 'https://api.example.com' || {address} ELSE {address} END AS url FROM queue", ("queue",)),
    }


def _flagship_sql(d: Dialect, sf_dir: str = "") -> str:
    """Page furniture and garbage tokens out of the lines, the rest as one text with its pages' mean score."""
    cleaned = d.join(d.keep(d.words("text"), "u", f"NOT {text.output_garbage(d, 'u')}"), " ")
    kept = DECLARED["TOK-17"][1](d)
    body = f"SELECT doc_id, {d.listed('t', 'line_no')} AS text FROM (SELECT doc_id, line_no, {text.inner_dots(d, text.glued_bab(d, text.glued_number(d, cleaned)))} AS t FROM ({kept}) k) c GROUP BY doc_id"
    score = f"SELECT doc_id, sum(CAST(round(score * 10000) AS BIGINT)) / CAST(count(*) * 10000 AS DOUBLE) AS score, count(*) AS pages FROM ({_scored(d)}) s GROUP BY doc_id"
    return compiled(d, f"SELECT b.doc_id, b.text, s.score, s.pages FROM ({body}) b JOIN ({score}) s ON b.doc_id = s.doc_id", ("noisy", "words"), sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_flagship_sql(SPARK, sf_dir))
