"""Text normalisation and token rules as column expressions, in either dialect of ``plans.dialect``."""

from __future__ import annotations

from foliospark.plans.dialect import EDGE_A, EDGE_B, Dialect, S

# Character classes of the garbage rules.
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"
SYMBOL = r"[\x{0370}-\x{03FF}\x{2200}-\x{22FF}\x{2300}-\x{23FF}\x{2500}-\x{257F}\x{2070}-\x{209F}\x{00B2}\x{00B3}\x{00B9}\x{00BC}-\x{00BE}]"
SUPERSCRIPT = r"[\x{2070}-\x{209F}\x{00B2}\x{00B3}\x{00B9}]"
NOT_PLAIN = r"[0-9\x{80}-\x{10FFFF}]"
LATIN = r"[a-zA-Z\x{00C0}-\x{024F}]"
ALPHA = r"[a-zA-Z\x{00C0}-\x{024F}\x{0400}-\x{04FF}]"
WHITELIST = r"[^\x20-\x7E\n\r\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}\x{0400}-\x{04FF}\x{2190}-\x{21FF}\x{2600}-\x{27BF}]"
# Page furniture.
PAGE_NUMBER = rf"^[-–—·•]?{S}*[0-9]{{1,3}}{S}*[-–—·•]?$"
SALINAN = rf"(?i)^SALINAN({S}+[A-Z0-9]{{1,6}})?$"
STAMP = r"^[A-Z][0-9]{1,2}$"
NIP = rf"(?i)^NIP\.?{S}*[:.-]?{S}*[0-9][0-9 \t\n.-]{{7,}}$"
TTD = rf"(?i)^ttd\.?{S}*:?$"
SESUAI = r"(?i)^salinan sesuai dengan aslinya($|[^A-Za-z0-9_])"
KEPALA = r"(?i)^kepala bagian hukum$"
PREAMBLE = rf"(?i)^(menimbang|mengingat|memutuskan|menetapkan){S}*:{S}*$"
EDGE_CHROME, FOOTER = (PAGE_NUMBER, SALINAN, STAMP), (NIP, TTD, SESUAI, KEPALA)
# Frequent words of a trustworthy text layer.
COMMON = "yang dan dalam pada dengan tahun ayat pasal tentang atau untuk dari ini di ke adalah sebagaimana dimaksud peraturan daerah pemerintah".split()
# Misread words, and what they stand for.
TYPOS = {"bae": "bab", "fasal": "pasal", "daiei": "dairi", "yancmaha": "yang maha", "avat": "ayat", "nonor": "nomor", "nornor": "nomor", "kepaca": "kepada", "cengan": "dengan", "euvati": "bupati", "memutuiskan": "memutuskan", "udalah": "sudah"}


def newlines(d: Dialect, x: str) -> str:
    """TXT-01."""
    return d.subs(x, (r"\r\n", r"\n" if d.spark else "\n"), (r"\r", r"\n" if d.spark else "\n")) if not d.spark else f"replace(replace({x}, '\\r\\n', '\\n'), '\\r', '\\n')"


def dehyphenated(d: Dialect, x: str) -> str:
    """TXT-02."""
    return d.sub(x, rf"(\p{{Ll}})-{S}*\n{S}*", "$1")


def bullets(d: Dialect, x: str) -> str:
    """TXT-03."""
    return f"translate({x}, '•●▪→➢❖▶', '-------')"


def quotes(d: Dialect, x: str) -> str:
    """TXT-04."""
    quote = "\\'" if d.spark else "''"
    return f"replace(translate({x}, '“”‘’–—─', '\"\"{quote}{quote}---'), '…', '...')"


def controls(d: Dialect, x: str) -> str:
    """TXT-05."""
    return d.sub(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def charset(d: Dialect, x: str) -> str:
    """TXT-06."""
    return d.sub(x, WHITELIST)


def spaces(d: Dialect, x: str) -> str:
    """TXT-07."""
    nl = "\n"
    return d.subs(x, (r"[ \t]+", " "), (rf" +\n", nl), (rf"\n +", nl))


def headings(d: Dialect, x: str) -> str:
    """TXT-10; alternatives to look-ahead keep it alike in every engine: what follows is captured and put back."""
    nl = "\n"
    words = "Menimbang|Mengingat|Memutuskan|Menetapkan"
    return d.subs(
        x,
        (rf"(?im)^(BAB){S}+", nl * 2 + "$1 "),
        (rf"(?im)^(Pasal){S}+", nl * 2 + "$1 "),
        (rf"(?im)^(Ayat){S}+", nl * 2 + "$1 "),
        (rf"(?im)^(Pasal{S}+[0-9]+)", nl * 2 + "$1"),
        (rf"(?im)^(Bagian{S}+(?:Kesatu|Kedua|Ketiga|Keempat|Kelima))", nl * 2 + "$1"),
        (rf"(?im)^(Paragraf{S}+[0-9]+)", nl * 2 + "$1"),
        (rf"(?im)^({words}){S}*:", nl * 2 + "$1:"),
        (rf"(?i):{S}*((?:{words}){S}*:)", ":" + nl + "$1"),
        (rf"(?i);{S}*((?:{words}){S}*:)", nl + "$1"),
        (rf"(?im)^((?:{words}){S}*:){S}*", "$1" + nl),
        (rf"(?i);{S}+((?:[a-z][.)]|[0-9]{{1,2}}[.)]){S})", nl + "$1"),
    )


def sentences(d: Dialect, x: str) -> str:
    """TXT-11, the letters on both sides captured and put back."""
    return d.sub(x, r"(\p{Ll})\.?[ \t\f\r\x0B]*\n[ \t\f\r\x0B]*(\p{Lu})", "$1. $2")


def blank_lines(d: Dialect, x: str) -> str:
    """TXT-12."""
    return d.subs(x, (r"\n{4,}", "\n\n\n"), (r"\n{3,}", "\n\n"))


def garbage_line(d: Dialect, x: str) -> str:
    """TXT-13."""
    t = d.trim(x)
    w = d.words(t)
    n, short = d.size(w), d.size(d.keep(w, "u", "length(u) <= 2"))
    longest = d.size(d.keep(w, "u", "length(u) >= 6"))
    digits, letters = d.count(t, "[0-9]"), d.count(t, "[A-Za-z]")
    return f"(length({t}) >= 5 AND {n} > 3 AND {longest} = 0 AND ({short} > 0.8 * {n} OR ({short} > 0.6 * {n} AND {digits} > 0.25 * length({t}) AND {letters} < {digits})))"


def chrome_line(d: Dialect, x: str) -> str:
    """Page furniture of TXT-09 and TOK-16, wherever it stands."""
    return "(" + " OR ".join(d.match(x, p) for p in (*EDGE_CHROME, *FOOTER)) + ")"


def output_garbage(d: Dialect, w: str, whole: bool = False) -> str:
    """TOK-01."""
    n, cjk, latin = f"length({w})", d.match(w, CJK), d.match(w, LATIN)
    symbols, digits, letters = d.count(w, SYMBOL), d.count(w, "[0-9]"), d.count(w, "[a-zA-Z]")
    if d.spark and not whole:  # most words have neither a digit nor a character beyond ASCII, and so none of these
        full = output_garbage(d, w, True)
        return f"CASE WHEN NOT (({w}) RLIKE {d.lit(NOT_PLAIN)}) THEN false ELSE {full} END"
    return f"(({cjk} AND NOT {latin} AND {n} <= 8) OR ({n} >= 2 AND (({symbols} >= 0.4 * {n} AND NOT {latin}) OR {d.count(w, SUPERSCRIPT)} >= 2)) OR ({n} = 1 AND {symbols} = 1 AND NOT {latin}) OR ({n} >= 5 AND {latin} AND 2 * {digits} > {n} AND {letters} <= 2 AND NOT {d.match(w, '(?i)^Rp')}))"


def garbage_word(d: Dialect, w: str) -> str:
    """QM-01."""
    n, cjk, latin, alpha = f"length({w})", d.match(w, CJK), d.match(w, LATIN), d.match(w, ALPHA)
    symbols, digits, letters = d.count(w, SYMBOL), d.count(w, "[0-9]"), d.count(w, "[a-zA-Z]")
    return f"((NOT {alpha} AND 2 * {digits} > {n} AND {n} <= 3) OR ({cjk} AND {digits} = 0 AND {n} <= 4) OR (NOT {alpha} AND {cjk} AND {digits} > 0 AND {n} <= 6) OR ({n} >= 2 AND (({symbols} >= 0.4 * {n} AND NOT {latin}) OR {d.count(w, SUPERSCRIPT)} >= 2)) OR ({n} = 1 AND {symbols} = 1 AND NOT {latin}) OR ({n} >= 5 AND {letters} > 0 AND 2 * {digits} > {n} AND {letters} <= 2 AND NOT {d.match(w, '(?i)^Rp')}) OR ({d.match(w, '^[a-zA-Z]$')} AND NOT {d.match(w, '^[aiAI]$')} AND NOT {cjk}))"


def core(d: Dialect, w: str) -> str:
    """TOK-02."""
    return d.sub(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def list_marker(d: Dialect, w: str) -> str:
    """TOK-03."""
    return d.match(w, r"^([A-Za-z][.)]|\([0-9]+\))$")


def run_token(d: Dialect, w: str) -> str:
    """TOK-04."""
    if d.spark:
        return f"({d.match(w, _alone(r'[\p{L}\p{N}]'))} AND NOT {list_marker(d, w)})"
    return f"(length({core(d, w)}) = 1 AND NOT {list_marker(d, w)})"


def _alone(one: str) -> str:
    """Words whose core is one such character, without taking the core out."""
    return rf"^[^\p{{L}}\p{{N}}]*{one}[^\p{{L}}\p{{N}}]*\z"


def single_letter(d: Dialect, w: str) -> str:
    return d.match(w, _alone("[A-Za-z]")) if d.spark else d.match(core(d, w), "^[A-Za-z]$")


#: For Java, which is five to ten times slower with an edge as a group: a word's start, which is not where the last match took the edge.
_START = r"(?<![A-Za-z0-9_])(?!\G(?!^))"


def glued_number(d: Dialect, x: str) -> str:
    """TOK-07; the second pass takes neighbours that shared an edge with the first, which looking at edges instead of taking them does at once."""
    if d.spark:
        out = d.sub(x, rf"(?i){_START}(NOMOR)([0-9]{{1,4}})(TAHUN){EDGE_B}", "$1 $2 $3$4")
        return d.sub(out, r"(?<![A-Za-z0-9_])([A-Za-z]{3,})([0-9]{2,4})(?![A-Za-z0-9_])", "$1 $2")
    out = d.sub(x, rf"(?i){EDGE_A}(NOMOR)([0-9]{{1,4}})(TAHUN){EDGE_B}", "$1$2 $3 $4$5")
    for _ in range(2):
        out = d.sub(out, rf"{EDGE_A}([A-Za-z]{{3,}})([0-9]{{2,4}}){EDGE_B}", "$1$2 $3$4")
    return out


def glued_bab(d: Dialect, x: str) -> str:
    """TOK-08."""
    if d.spark:
        return d.sub(x, "(?<![A-Za-z0-9_])(BAB)([IVXLCDM]+)(?![A-Za-z0-9_])", "$1 $2")
    for _ in range(2):
        x = d.sub(x, rf"{EDGE_A}(BAB)([IVXLCDM]+){EDGE_B}", "$1$2 $3$4")
    return x


def inner_dots(d: Dialect, x: str) -> str:
    """TOK-09."""
    if d.spark:
        return d.sub(x, rf"{_START}([A-Za-z]{{2,}})\.([A-Za-z]{{2,}}){EDGE_B}", "$1$2$3")
    return d.sub(x, rf"{EDGE_A}([A-Za-z]{{2,}})\.([A-Za-z]{{2,}}){EDGE_B}", "$1$2$3$4")


def consonants(d: Dialect, w: str) -> str:
    """TOK-10; null without letters."""
    c = core(d, w)
    letters = d.count(c, "[A-Za-z]")
    return f"CASE WHEN {letters} > 0 THEN ({letters} - {d.count(c, '[AEIOUaeiou]')}) / CAST({letters} AS DOUBLE) END"


def common_ratio(d: Dialect, x: str) -> str:
    """QM-09; null under 15 words."""
    words = d.extract_all(f"lower({x})", "[a-z]+")
    hits = d.keep(words, "w", "w IN (" + ", ".join(f"'{c}'" for c in COMMON) + ")")
    return f"CASE WHEN {d.size(words)} >= 15 THEN {d.size(hits)} / CAST({d.size(words)} AS DOUBLE) END"


def trustworthy(d: Dialect, x: str) -> str:
    """QM-10."""
    return f"(length({d.trim(x)}) >= 40 AND coalesce({common_ratio(d, x)} >= 0.05, true))"
