"""Legal structure: headings, node types, document types and levels, as column expressions."""

from __future__ import annotations

from foliospark.plans.dialect import EDGE_B, Dialect, S

# Patterns of headings and markers.
BAB = rf"(?i)^BAB{S}+([IVXLCDM]+|[0-9]+)"
BAGIAN = rf"(?i)^BAGIAN{S}+(PERTAMA|KEDUA|KETIGA|KEEMPAT|KELIMA|KEENAM|KETUJUH|KEDELAPAN|KESEMBILAN|KESEPULUH|[I VXLCDM]+|[0-9]+)"
PARAGRAF = rf"(?i)^(\x{{00A7}}{S}*|Paragraf{S}+)([0-9]+|[IVXLCDM]+)"
PASAL = rf"(?i)^Pasal{S}+([0-9]+|[IVXLCDM]+)"
LAMPIRAN = rf"(?i)^Lampiran{S}+([IVXLCDM]+|[0-9]+)"
ANY_HEADING = rf"(?i)^(BAB|BAGIAN|PARAGRAF){S}+"
TITLE = rf"(?i)^(PERATURAN|KEPUTUSAN|UNDANG-UNDANG|INSTRUKSI|NOTA KESEPAHAMAN|MEMORANDUM){EDGE_B}"
TITLE_WORD = r"(?i)(^|[^A-Za-z0-9_])(NOMOR|TAHUN|TENTANG)($|[^A-Za-z0-9_])"
AYAT, HURUF, ANGKA = rf"^\(([0-9]+)\){S}*(.+)", rf"(?i)^([a-z])[.)]{S}*(.+)", rf"^([0-9]+)[.)]{S}*(.+)"
TABLE_ROW, TABLE_SEPARATOR = r"^[|+].*[|+]$", rf"^[|+][-+=: \t]+[|+]$"
# Document types, in the order in which they are tried.
TYPES = (
    ("UNDANG_UNDANG", rf"(?i)^UNDANG-UNDANG{S}+(REPUBLIK{S}+)?INDONESIA"),
    ("PERPU", rf"(?i)^PERATURAN{S}+ PEMERINTAH{S}+PENGGANTI{S}+UNDANG-UNDANG"),
    ("PERATURAN", rf"(?i)^PERATURAN{S}+(PRESIDEN|GUBERNUR|BUPATI|WALIKOT|MENTERI|DAERAH|PEMERINTAH)"),
    ("KEPUTUSAN", rf"(?i)^KEPUTUSAN{S}+(PRESIDEN|GUBERNUR|BUPATI|WALIKOT|MENTERI|KEPALA)"),
    ("INSTRUKSI", rf"(?i)^INSTRUKSI{S}+(PRESIDEN|GUBERNUR|BUPATI|WALIKOT|MENTERI)"),
    ("SURAT_EDARAN", rf"(?i)^SURAT{S}+EDARAN"),
    ("PENETAPAN", rf"(?i)^PENETAPAN{S}+(PRESIDEN|GUBERNUR|BUPATI|WALIKOT|MENTERI)"),
    ("PERDES", rf"(?i)^PERATURAN{S}+DESA"),
    ("PERKADES", rf"(?i)^PERATURAN{S}+KEPALA{S}+DESA"),
)
COMPONENTS = tuple((w.lower(), rf"(?i)^{w}{S}*:") for w in ("Menimbang", "Mengingat", "Memutuskan", "Menetapkan"))
# Line kinds of the older structure and their levels.
KINDS = (
    ("BAB", rf"(?i)^BAB{S}+([IVXLCDM]+($|[^A-Za-z0-9_])|[0-9]+)", 3),
    ("BAGIAN", rf"(?i)^Bagian{S}+(Kesatu|Kedua|Ketiga|Keempat|Kelima|Keenam|Ketujuh|Kedelapan|Kesembilan|Kesepuluh)", 4),
    ("PARAGRAF", rf"(?i)^Paragraf{S}+[0-9]+", 5),
    ("PASAL", rf"(?i)^Pasal{S}+[0-9]+", 6),
    ("AYAT_HEADER", rf"(?i)^Ayat{S}+", 7),
    ("AYAT", r"^\([0-9]+[a-z]?\)", 7),
    ("HURUF", rf"^[a-z][.)]{S}", 8),
    ("NOMOR", rf"^[0-9]+[.)]{S}", 8),
    ("BULLET", rf"^[-•▪➢]{S}", 8),
    ("LEGAL_PREAMBLE", rf"^(Menimbang|Mengingat|Memutuskan|Menetapkan|MEMUTUSKAN|MENETAPKAN){S}*:", 2),
    ("LEGAL_AUTHORITY", rf"^(PEMERINTAH|MENTERI|BUPATI|WALIKOTA|GUBERNUR){S}+", 1),
)


def heading(d: Dialect, x: str) -> str:
    """TRE-01: whether a text is any heading."""
    return "(" + " OR ".join(d.match(x, p) for p in (BAB, BAGIAN, PARAGRAF, PASAL, LAMPIRAN, ANY_HEADING)) + ")"


def node_type(d: Dialect, x: str) -> str:
    """TRE-05."""
    m = d.match
    return f"CASE WHEN {m(x, BAB)} THEN 'bab' WHEN {m(x, LAMPIRAN)} THEN 'lampiran' WHEN {m(x, TITLE)} AND (length({x}) >= 25 OR {m(x, TITLE_WORD)}) THEN 'title' WHEN {m(x, BAGIAN)} THEN 'bagian' WHEN {m(x, PARAGRAF)} THEN 'paragraf' WHEN {m(x, PASAL)} THEN 'pasal' WHEN {m(x, AYAT)} THEN 'ayat' WHEN {m(x, HURUF)} AND length({x}) < 100 THEN 'huruf' WHEN {m(x, ANGKA)} AND length({x}) < 100 THEN 'angka' ELSE 'paragraph' END"


def level(kind: str) -> str:
    return f"CASE {kind} WHEN 'title' THEN 0 WHEN 'bab' THEN 1 WHEN 'lampiran' THEN 1 WHEN 'bagian' THEN 2 WHEN 'paragraf' THEN 3 WHEN 'pasal' THEN 4 WHEN 'ayat' THEN 5 ELSE 6 END"


def number(d: Dialect, kind: str, x: str) -> str:
    """A node's number as text, '' if none."""
    return f"CASE {kind} WHEN 'bab' THEN {d.extract(x, BAB, 1)} WHEN 'pasal' THEN {d.extract(x, PASAL, 1)} WHEN 'ayat' THEN {d.extract(x, AYAT, 1)} WHEN 'huruf' THEN {d.extract(x, HURUF, 1)} WHEN 'angka' THEN {d.extract(x, ANGKA, 1)} ELSE '' END"


def body(d: Dialect, kind: str, x: str) -> str:
    """TRE-06 of a single line: the text without its marker, or what is glued to a pasal's title."""
    pasal = rf"(?i)^Pasal{S}+(?:[0-9]+|[IVXLCDM]+){S}+(.+)$"
    return f"CASE {kind} WHEN 'ayat' THEN {d.sub(x, rf'^\([0-9]+\){S}*')} WHEN 'huruf' THEN {d.sub(x, rf'(?i)^[a-z0-9][.)]{S}*')} WHEN 'angka' THEN {d.sub(x, rf'(?i)^[a-z0-9][.)]{S}*')} WHEN 'pasal' THEN CASE WHEN {d.match(x, pasal)} THEN {d.extract(x, pasal, 1)} ELSE {x} END ELSE {x} END"


def document_type(d: Dialect, x: str) -> str:
    """LEG-01: the types that fit, in order, comma-joined."""
    return d.join(d.keep("array(" + ", ".join(f"CASE WHEN {d.match(x, p)} THEN '{n}' END" for n, p in TYPES) + ")" if d.spark else "[" + ", ".join(f"CASE WHEN {d.match(x, p)} THEN '{n}' END" for n, p in TYPES) + "]", "t", "t IS NOT NULL"), ",")


def component(d: Dialect, x: str) -> str:
    """LEG-02."""
    return "CASE " + " ".join(f"WHEN {d.match(x, p)} THEN '{n}'" for n, p in COMPONENTS) + " END"


def kind(d: Dialect, x: str) -> str:
    """STR-01."""
    return "CASE " + " ".join(f"WHEN {d.match(x, p)} THEN '{n}'" for n, p, _ in KINDS) + " ELSE 'BODY' END"


def kind_level(k: str) -> str:
    """STR-02."""
    return f"CASE {k} " + " ".join(f"WHEN '{n}' THEN {v}" for n, _, v in KINDS) + " ELSE 9 END"
