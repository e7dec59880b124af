"""Views that turn the driver's tables into inputs of the document operators, in both dialects.

The tables' prose has no legal markers, no misreadings and no page furniture, so ``noisy`` puts some in, by line number.
"""

from __future__ import annotations

from .dialect import Dialect

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _lines(d: Dialect) -> str:
    return f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST({d.div('line_no', '20')} AS BIGINT) AS page, text FROM ({d.exploded('(SELECT doc_id, text AS body FROM documents) _d', 'doc_id', d.lines('body'), 'text', 'line_no')}) _l"


def _noisy(d: Dialect) -> str:
    """Furniture as lines of its own beside the text's: line n of a document is 2n, or 2n and 2n + 1 with a furniture line."""
    n = "line_no"
    cast = lambda x: f"CAST({x} AS STRING)" if d.spark else f"CAST({x} AS VARCHAR)"
    furniture = f"""CASE WHEN {n} % 20 = 0 THEN 'PEMERINTAH KABUPATEN' WHEN {n} % 20 = 19 THEN '- ' || {cast('page + 1')} || ' -'
  WHEN {n} % 20 = 18 THEN 'NIP. 19701022 1998031006' WHEN {n} % 23 = 5 THEN 'Menimbang :' WHEN {n} % 29 = 9 THEN 'SALINAN E3' WHEN {n} % 31 = 3 THEN 'PERATURAN BUPATI DAIRI NOMOR 20 TAHUN 2020'
  WHEN {n} % 15 = 12 THEN 'BAB ' || CASE ({d.div(n, '15')}) % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'IV' WHEN 3 THEN 'III' ELSE 'III' END || ' KETENTUAN' END"""
    body = f"""CASE WHEN {n} % 7 = 1 THEN 'Pasal ' || {cast(f'{n} * 5 % 17 + 1')} || ' ' || text WHEN {n} % 7 = 2 THEN '(' || {cast(f'{n} % 9 + 1')} || ') ' || text WHEN {n} % 7 = 3 THEN chr(CAST(97 + {n} % 26 AS INT)) || '. ' || text
  WHEN {n} % 11 = 4 THEN 'TAHUN2020 ' || text WHEN {n} % 11 = 5 THEN 'T E ' || text WHEN {n} % 11 = 6 THEN '国 ' || text || ' ν1' WHEN {n} % 11 = 7 THEN 'Dala m SAL.INAN ' || text WHEN {n} % 11 = 8 THEN 'BABIII Fasal 5 ' || text ELSE text END"""
    array = lambda *x: f"array({', '.join(x)})" if d.spark else f"[{', '.join(x)}]"
    both = f"CASE WHEN furniture IS NULL THEN {array('body')} WHEN n % 20 IN (18, 19) THEN {array('body', 'furniture')} ELSE {array('furniture', 'body')} END"
    source = f"(SELECT doc_id, {n} AS n, page, {furniture} AS furniture, {body} AS body FROM lines) _f"
    return f"SELECT doc_id, CAST(2 * n + place AS BIGINT) AS line_no, page, text FROM ({d.exploded(source, 'doc_id, n, page', both, 'text', 'place')}) _n"


def _rough(d: Dialect) -> str:
    """Whole documents with breaks inside words, curly signs, bullets, control characters and legal words."""
    nl = "'\\n'" if d.spark else "chr(10)"
    return f"SELECT doc_id, replace(replace(replace(replace(replace(text, ', ', '-' || {nl} || ' '), ' the ', ' “the” ' || chr(1) || {nl} || 'Pasal 3 '), ' de ', ' …' || chr(9) || '• ’ – '), '. ', '; a. Menimbang : '), ' en ', {nl} || {nl} || {nl} || {nl} || 'BAB  II' || {nl}) AS text FROM documents"


def _words(d: Dialect) -> str:
    return f"SELECT doc_id, page, line_no, CAST(tok_no AS BIGINT) AS tok_no, word, CAST((doc_id * 7 + line_no * 13) % 100 AS DOUBLE) / 100 AS confidence FROM ({d.exploded('noisy', 'doc_id, page, line_no', d.words('text'), 'word', 'tok_no')}) _w"


def _blocks(d: Dialect) -> str:
    """A block a word, by position."""
    return "SELECT doc_id, page, line_no * 1000000 + tok_no AS ord, word AS text, confidence, CAST(tok_no * 60 AS DOUBLE) AS x, CAST(line_no % 40 * 20 + (tok_no * 7) % 5 AS DOUBLE) AS y, CAST(50 AS DOUBLE) AS w, CAST(12 AS DOUBLE) AS h FROM words"


def _activities(d: Dialect) -> str:
    cast = "STRING" if d.spark else "VARCHAR"
    return f"""SELECT CAST(event_id AS BIGINT) AS id, 'file_' || CAST(user_id AS {cast}) AS file_name, CASE WHEN event_id % 3 = 0 THEN 'upload' ELSE 'url' END AS source_type,
  'https://host' || CAST(user_id % 7 AS {cast}) || '.example.com/f' || CAST(user_id AS {cast}) || '.pdf' AS source_url, {d.sha(f'CAST(user_id AS {cast})')} AS file_hash,
  CASE event_type WHEN 'click' THEN 'BERHASIL' WHEN 'view' THEN 'BERHASIL' WHEN 'error' THEN 'GAGAL' WHEN 'signup' THEN 'RUSAK' ELSE 'KOSONG' END AS status,
  CASE WHEN event_id % 4 = 0 THEN 'kode ' || CAST(event_id % 10 AS {cast}) END AS error_message, CAST(event_id % 40 AS BIGINT) AS page_count, CAST(event_id * 37 % 100000 AS BIGINT) AS file_size_bytes,
  CAST(value AS DECIMAL(10,1)) AS duration_seconds, CAST(event_id % 2 AS BIGINT) AS text_uploaded, CASE WHEN event_id % 5 <> 0 THEN event_type || ' text' END AS output_text, event_id % 10 = 3 AS delete_asked, ts AS created_at FROM events"""


def _html_tables(d: Dialect) -> str:
    cast = "STRING" if d.spark else "VARCHAR"
    return f"SELECT CAST(p_partkey AS BIGINT) AS table_id, '<table><tr><th>' || CASE WHEN p_partkey % 5 = 0 THEN '0' ELSE 'NO' END || '</th><th>' || CASE WHEN p_partkey % 5 = 0 THEN '1' ELSE 'URAIAN' END || '</th></tr><tr><td>' || CAST(p_partkey AS {cast}) || '</td><td> ' || p_name || '&#10;None =' || '</td></tr><tr><td></td><td></td></tr><tr><td><b>' || p_brand || '</b></td>' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '<td>== ' || p_type || '</td>' END || '</tr></table>' AS html FROM part"


def _hyp_ref(d: Dialect) -> str:
    """Three engines' readings of each whole text: swapped vowels, an end of ten characters lost, a lower case without its first two characters."""
    return "SELECT doc_id, engine, text AS ref, CASE engine WHEN 'paddle' THEN translate(text, 'aeo', 'eoa') WHEN 'surya' THEN substr(text, 1, CAST(greatest(length(text) - 10, 0) AS INT)) ELSE lower(substr(text, 3)) END AS hyp, CAST(1000 + doc_id % 700 AS BIGINT) AS duration_ms, CAST(1 + doc_id % 5 AS BIGINT) AS pages FROM documents CROSS JOIN (SELECT 'paddle' AS engine UNION ALL SELECT 'surya' UNION ALL SELECT 'tesseract') e"


def _queue(d: Dialect) -> str:
    cast = "STRING" if d.spark else "VARCHAR"
    return f"SELECT CAST(user_id AS BIGINT) AS id, CAST(event_id AS BIGINT) AS seq, CASE event_type WHEN 'signup' THEN 'reset' WHEN 'purchase' THEN 'save' ELSE 'new' END AS op, CASE event_type WHEN 'error' THEN 'RUSAK' ELSE 'BERHASIL' END AS outcome, CASE WHEN event_id % 4 = 0 THEN '  ' WHEN event_id % 4 = 1 THEN '/dok/' || CAST(event_id AS {cast}) || '.pdf' END AS url, CASE WHEN event_id % 3 = 0 THEN ' https://h.example.com/a b@' || CAST(event_id AS {cast}) || '.pdf ' END AS file_url FROM events"


def _pdfs(d: Dialect) -> str:
    """Documents as files: the text layer, the raw content with its operators, pages, and what went wrong. A quarter each are digital, scanned, both at once, and digital without page marks."""
    cast = "STRING" if d.spark else "VARCHAR"
    layer = "replace(text, ' the ', ' dan ')"
    shown = "'(' || replace(text, ' ', ') TJ (') || ')'"
    images = "repeat('/XObject /Subtype /Image ', CAST(1 + doc_id % 30 AS INT))"
    return f"""SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN '' ELSE {layer} END AS layer, '%PDF-1.' || CAST(doc_id % 8 AS {cast}) || ' ' || CASE WHEN doc_id % 4 = 3 THEN CASE WHEN doc_id % 8 = 3 THEN '/Pages [' ELSE '' END ELSE repeat('/Type /Page ', CAST(1 + doc_id % 9 AS INT)) END
  || CASE doc_id % 4 WHEN 0 THEN {shown} WHEN 1 THEN {images} WHEN 2 THEN {images} || substr({shown}, 1, CAST(doc_id % 150 AS INT)) ELSE {shown} END AS body,
  CAST(CASE WHEN doc_id % 4 = 2 THEN 1 + doc_id * 7 % 400 ELSE 1 + doc_id % 9 END AS BIGINT) AS page_count, doc_id % 10 = 0 AS has_blocks, doc_id % 11 = 3 AS corrupt, doc_id % 13 = 5 AS unreachable, CASE WHEN doc_id % 17 = 4 THEN 0 ELSE length(text) END AS n_bytes FROM documents"""


def _attempts(d: Dialect) -> str:
    """Renderings of pages: up to five for each, with whether the page holds a table."""
    source = "(SELECT doc_id, page, (doc_id * 3 + page) % 2 = 0 AS has_table, (doc_id + page) % 5 AS last FROM (SELECT DISTINCT doc_id, page FROM lines) _p) _a"
    tries = "sequence(0, CAST(last AS INT))" if d.spark else "range(0, CAST(last AS BIGINT) + 1)"
    return f"SELECT doc_id, page, has_table, CAST(retry AS BIGINT) AS retry FROM ({d.exploded(source, 'doc_id, page, has_table', tries, 'retry', 'place')}) _t"


def _figures(d: Dialect) -> str:
    """Lines as blocks, with rows of figures between them."""
    cast = lambda x: f"CAST({x} AS {'STRING' if d.spark else 'VARCHAR'})"
    return f"SELECT doc_id, page, line_no, CASE WHEN (doc_id * 5 + line_no) % 41 = 7 THEN {cast('line_no')} || ' ' || {cast('page + 1')} || ' 2020 ' || {cast('length(text)')} ELSE text END AS text FROM noisy"


def _files(d: Dialect) -> str:
    """What the output folder holds."""
    cast = "STRING" if d.spark else "VARCHAR"
    return f"SELECT CAST(event_id AS BIGINT) AS file_id, 'file_' || CAST(user_id + CASE WHEN event_id % 3 = 0 THEN 1000000 + event_id ELSE 0 END AS {cast}) AS base, CASE event_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.md' ELSE '.pdf' END AS extension, CAST(event_id * 17 % 60000 AS BIGINT) AS age_minutes FROM events"


def _settings(d: Dialect) -> str:
    """Configurations of the queue's service, some incomplete."""
    return "SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey % 4 <> 1 AS flag, CASE WHEN n_nationkey % 3 <> 2 THEN 'https://h.example.com' END AS base_url, CASE WHEN n_nationkey % 5 <> 3 THEN n_name END AS user_name, CASE WHEN n_nationkey % 7 <> 6 THEN 'secret' ELSE '' END AS password FROM nation"


VIEWS = {"lines": ((), _lines), "noisy": (("lines",), _noisy), "rough": ((), _rough), "words": (("noisy",), _words), "blocks": (("words",), _blocks), "activities": ((), _activities), "html_tables": ((), _html_tables), "hyp_ref": ((), _hyp_ref), "queue": ((), _queue), "pdfs": ((), _pdfs), "attempts": (("lines",), _attempts), "figures": (("noisy",), _figures), "files": ((), _files), "settings": ((), _settings)}


def compiled(d: Dialect, select: str, views: tuple[str, ...], sf_dir: str = "") -> str:
    """A query with the views and tables that it needs."""
    order: list[str] = []

    def add(v: str) -> None:
        for w in VIEWS[v][0]:
            add(w)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    parts = [f"{v} AS ({VIEWS[v][1](d)})" for v in order]
    body = " ".join([select, *parts])
    tables = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES if d.spark and f" {t}" in body.replace("(", " ").replace(",", " ")]
    head = ", ".join(tables + parts)
    return f"WITH {head} {select}" if head else select
