"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes a row of leaf blocks (stretches of text between block-level tags) with the tags, classes, ids and roles
of their ancestors. Each block's features are such ancestors and a few figures of its text; the chain's weights, two
labels with transitions, are trained by gradient ascent on labelled pages, and Viterbi's algorithm labels a page. The
labelled pages are written by `labelled_page`, whose templates mix menus, headers, footers, sidebars, notices, adverts,
forms and comments with articles in many wrappers; their number and seed are parameters.

White space inside a block (Unicode's) becomes one space, a line break element counts as one; character references are
decoded once, as browsers do; scripts, styles, comments and form fields are no blocks.

Defined results: null or empty html, or html without text, gives ''; broken or cut html is read as far as it goes;
repeated rows are each extracted; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PAGES, SEED, STEPS, RATE, DECAY = 1200, 7, 280, 0.15, 5e-6
MAIN = "page_id long, url string, text string, n_chars long"
#: An attribute: a quote opens a value only after "=", and a value without quotes ends at white space or ">". A quote that
#: nothing closes is part of a name, so its tag ends at the next ">".
_NAME, _VALUE = r"[^\s/>][^\s/>=]*+", r"(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)"
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE})?)?")
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
_TAG = re.compile(rf"{_COMMENT}|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE}?)?)*+)(?:>|\Z)", re.S)
#: Elements whose content is skipped; that of the first ones is no markup, so they last to the page's end if nothing closes them.
_RAW_TEXT = frozenset(("script", "style", "textarea", "title", "iframe"))
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in (*_RAW_TEXT, "noscript", "template", "svg", "select", "button")}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the first kind closes open ones of the second, up to the third.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NOT_IN_P = _BLOCK - {"body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "option"} | {"li"}
_SECTION = frozenset("article main section aside nav header footer form dialog".split())
_WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[tuple[str, ...], ...], linked: int) -> None:
        self.text, self.path, self.linked = text, path, linked  # path: each open element's name and its marks


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, ...]] = []
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0
    endless: set[str] = set()  # skipped elements that nothing further on closes

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, tuple(stack), min(linked, len(text))))
        parts.clear()
        linked = 0

    def pop(n: int) -> None:
        nonlocal in_link
        in_link -= sum(s[0] == "a" for s in stack[n:])
        del stack[n:]

    while at < len(page):
        m = _TAG.search(page, at)
        raw = page[at : m.start() if m else len(page)]
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in _RAW and not m[1]:
            end = None if name in endless else _RAW[name].search(page, at)
            if end:
                at = end.end()
            elif name in _RAW_TEXT:
                at = len(page)
            else:
                endless.add(name)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
            continue
        if name in _VOID:
            continue
        if name in _NOT_IN_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in _BLOCK:
                    break
        if name in _CLOSES:
            shut, upto = _CLOSES[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    pop(i)
                    break
                if stack[i][0] in upto:
                    break
        marks = sorted({f"{k[0].lower()}:{w}" for k, v in _ATTRIBUTE.findall(m[3]) if k.lower() in ("class", "id", "role") for w in re.split(r"[^a-z]+", v.lower()) if w}) if m[3] else []
        if not m[3].rstrip().endswith("/"):
            stack.append((name, *marks))
            in_link += name == "a"
    flush()
    return out


def features(row: list[Block]) -> list[list[str]]:
    """Names of each block's features."""
    out = []
    for b in row:
        names = [s[0] for s in b.path]
        f = {"bias", *("in:" + n for n in names if n in _BLOCK and n not in ("html", "body"))}
        f |= {"has:" + m.split(":", 1)[1] for s in b.path for m in s[1:]}
        own = [s for s in b.path if s[0] in _BLOCK]
        if own:
            f.add("tag:" + own[-1][0])
            f |= {"own:" + m.split(":", 1)[1] for m in own[-1][1:]}
            if len(own) > 1:
                f.add(f"tag:{own[-2][0]}>{own[-1][0]}")
        # the nearest sectioning element, and whether nothing from there down has a class, id or role
        near = next((j for j in range(len(names) - 1, -1, -1) if names[j] in _SECTION), None)
        if near is None:
            f.add("near:none")
        else:
            plain = all(len(s) == 1 for s in b.path[near + 1 :])
            f |= {"near:" + names[near], f"near:{names[near]}:{own[-1][0]}:{plain}"}
        n = len(b.text.split())
        f.add(f"words:{min(n.bit_length(), 7)}")
        f.add(f"links:{4 * b.linked // len(b.text)}")
        if b.text[-1] in ".!?:;\"”»。":
            f.add("stops")
        if any(c in b.text for c in "©·»›"):
            f.add("sign")
        if n <= 12:
            f |= {"w:" + w for w in _WORD.findall(b.text.lower())}
        out.append(sorted(f))
    return out


class Chain:
    """Weights of features and transitions; label 1 is main text."""

    def __init__(self, names: list[str]) -> None:
        self.number = {n: i for i, n in enumerate(names)}
        self.weight = np.zeros(len(names))  # of label 1 against 0
        self.step = np.zeros((2, 2))
        self.begin = np.zeros(2)

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        a0, a1 = self.begin.tolist()
        (t00, t01), (t10, t11) = self.step.tolist()
        number, weight, back = self.number, self._list, []
        for i, names in enumerate(rows):
            s = sum(weight[number[n]] for n in names if n in number)
            if i:
                from0, from1 = a1 + t10 > a0 + t00, a1 + t11 > a0 + t01
                back.append((from0, from1))
                a0, a1 = max(a0 + t00, a1 + t10), max(a0 + t01, a1 + t11)
            a1 += s
        label, out = int(a1 > a0), []
        for from0, from1 in reversed(back):
            out.append(label)
            label = int(from1 if label else from0)
        out.append(label)
        return out[::-1] if rows else []

    def freeze(self) -> Chain:
        self._list = self.weight.tolist()
        return self


def train(pages: list[tuple[list[list[str]], list[int]]]) -> Chain:
    """Gradient ascent on the likelihood of the labels, all pages at once; the same pages give the same weights."""
    chain = Chain(sorted({n for rows, _ in pages for r in rows for n in r}))
    longest, count = max(len(r) for r, _ in pages), len(pages)
    where = np.concatenate([np.full(len(r), p * longest + i) for p, (rows, _) in enumerate(pages) for i, r in enumerate(rows)])
    feature = np.array([chain.number[n] for rows, _ in pages for r in rows for n in r])
    size = np.array([len(r) for r, _ in pages])
    label = np.zeros((count, longest), int)
    for p, (_, y) in enumerate(pages):
        label[p, : len(y)] = y
    real = np.arange(longest) < size[:, None]
    total, pages_ = real.sum(), np.arange(count)
    theta = np.zeros(len(chain.number) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    want_step = np.zeros((2, 2))
    both = real[:, 1:]
    np.add.at(want_step, (label[:, :-1][both], label[:, 1:][both]), 1)
    want_begin = np.bincount(label[:, 0], minlength=2)
    for t in range(1, STEPS + 1):
        w, step, begin = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        score = np.zeros((count, longest, 2))
        score[..., 1] = np.bincount(where, w[feature], count * longest).reshape(count, longest)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = begin + score[:, 0]
        for i in range(1, longest):
            ahead[:, i] = np.logaddexp.reduce(ahead[:, i - 1, :, None] + step, 1) + score[:, i]
        for i in range(longest - 2, -1, -1):
            on = np.logaddexp.reduce(step + (score[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
            behind[:, i] = np.where((i + 1 < size)[:, None], on, 0)
        z = np.logaddexp.reduce(ahead[pages_, size - 1], 1)
        chance = np.exp(ahead + behind - z[:, None, None])
        pair = np.exp(ahead[:, :-1, :, None] + step + (score + behind)[:, 1:, None, :] - z[:, None, None, None])[both].sum(0)
        error = ((label - chance[..., 1]) * real).reshape(-1)
        grad = np.concatenate([np.bincount(feature, error[where], len(w)), (want_step - pair).ravel(), want_begin - chance[:, 0].sum(0)]) / total - DECAY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    chain.weight, chain.step, chain.begin = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
    return chain.freeze()


_YES, _NO = "\x01", "\x02"
#: Names that authors give to what isn't the article, and to what is; and short texts of the former.
_ASIDE = {
    "nav": ["nav", "menu", "navbar", "navigation", "topbar", "breadcrumb", "breadcrumbs", "site nav", "main menu", "toc", "pagination", "tabs"],
    "header": ["header", "site header", "masthead", "logo", "branding", "top", "banner", "page head"],
    "footer": ["footer", "site footer", "copyright", "bottom", "legal", "colophon", "page footer"],
    "aside": ["sidebar", "side", "widget", "related", "recommended", "popular", "trending", "archive", "tags", "share", "social", "follow", "author box", "promo box", "more", "teaser", "right", "rail"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "adsense", "promo", "banner ad", "dfp", "promoted"],
    "notice": ["notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall", "message", "warning", "toast", "disclaimer", "cookie banner"],
    "comments": ["comments", "comment", "comment list", "respond", "replies", "reply", "discussion", "disqus", "comment body", "feedback", "reviews", "thread", "user comments"],
    "form": ["search", "login", "signup", "contact", "form", "subscribe form"],
}
_CONTENT = ["content", "main content", "article", "article body", "post", "post content", "entry", "entry content", "story", "body", "text", "main", "page content", "article text", "prose"]
_SHORT = "home|about us|contact|log in|sign up|read more|share|tweet|subscribe|newsletter|accept cookies|we use cookies to improve your experience.|all rights reserved|privacy policy|terms of use|cookie policy|leave a comment|reply|posted by|related articles|most read|advertisement|sponsored content|follow us|search|next|previous|back to top|accueil|contactez nous|mentions légales|startseite|impressum|datenschutz|inicio|contacto|aviso legal|© 2024|copyright".split("|")


def labelled_page(rng: np.random.Generator) -> str:
    """A page whose texts begin with a mark of their label."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    maybe = lambda p: rng.random() < p
    syllables = ["ta", "re", "on", "éi", "sch", "en", "lo", "mi", "ka", "tion", "ü", "es", "ar", "the", "ent", "ñá"]
    frequent = "the of and is to in with for this that we you your it on a de la le und die der mit el en que los".split()
    word = lambda: pick(frequent) if maybe(0.3) else "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))

    def prose(a: int, b: int) -> str:
        n, out, odd = int(rng.integers(a, b)), [], pick([" |", "%%%", "!!", " ·", " ©"]) if maybe(0.12) else ""
        for i in range(n):
            out.append(word() + odd + ("." if i == n - 1 and maybe(0.75) or maybe(0.1) else "," if maybe(0.05) else ""))
        return " ".join(out).capitalize()

    def sign(kind: str | None) -> str:
        if kind is None or maybe(0.15):
            return ""
        return f' {pick(["class", "class", "id"])}="{pick(_CONTENT if kind == "content" else _ASIDE[kind])}"'

    def no(tag: str = "", text: str | None = None) -> str:
        text = text if text is not None else pick(_SHORT).capitalize() if maybe(0.5) else prose(1, 25) if maybe(0.6) else prose(2, 60)
        if maybe(0.3):
            text = f'<a href="/x">{_NO}{text}</a>'
            return f"<{tag}>{text}</{tag}>" if tag else text
        return f"<{tag}>{_NO}{text}</{tag}>" if tag else _NO + text

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{_NO}{word()}</a></li>' for i in range(int(rng.integers(2, 9)))) + "</ul>" if maybe(0.7) else " ".join(f'<a href="/{i}">{_NO}{word()}</a>' for i in range(int(rng.integers(2, 7))))

    def other(kind: str) -> str:
        tag = {"nav": ["nav", "div", "ul", "div"], "header": ["header", "div", "header"], "footer": ["footer", "footer", "div"], "aside": ["aside", "div", "section"], "ad": ["div", "aside", "div", "ins"], "notice": ["div", "section", "dialog", "p"], "comments": ["section", "div", "div"], "form": ["form", "form", "div"]}[kind]
        tag = pick(tag)
        mark = sign(kind) if tag not in ("div", "section", "p", "ins") else f' {pick(["class", "id"])}="{pick(_ASIDE[kind])}"'
        inner = {"nav": lambda: links(), "header": lambda: no("div") + (links() if maybe(0.5) else "") if maybe(0.5) else no(), "footer": lambda: no(text=f"© {word()}.com · {prose(1, 9)}") if maybe(0.5) else no("p") + links(), "aside": lambda: no("h3") + (links() if maybe(0.6) else no("p") + no("p")), "ad": lambda: no() if maybe(0.6) else no("p"), "notice": lambda: no("p") if maybe(0.5) else no(text=prose(5, 30)), "form": lambda: f"<label>{no()}</label><input type=text>" + (no("p") if maybe(0.5) else ""), "comments": lambda: no("h3") + "".join(f'<{c}{sign("comments") or (" class=comment" if c == "article" else "")}>' + (no("p", prose(4, 50)) if maybe(0.6) else no(text=prose(4, 50))) + f"</{c}>" for c in [pick(["div", "li", "div", "div", "li", "article"])] for _ in range(int(rng.integers(1, 5))))}[kind]()
        return f"<{tag}{mark}>{inner}</{tag}>"

    def article() -> str:
        out = []
        if maybe(0.85):
            head = f"<h1>{_YES}{prose(1, 12)}</h1>"
            out.append(f"<header>{head}</header>" if maybe(0.15) else head)
        for _ in range(int(rng.integers(1, 12))):
            r = rng.random()
            if r < 0.60:
                out.append(f"<p>{_YES}{pick(_SHORT).capitalize() + pick(["", "."]) if maybe(0.12) else prose(1, 4) if maybe(0.2) else prose(1, 90)}</p>" if maybe(0.85) else f"<p><b>{_YES}{prose(1, 12)}<br>")
            elif r < 0.67:
                out.append(f"<h2>{_YES}{prose(1, 7)}</h2>")
            elif r < 0.73:
                t = pick(["ul", "ol"])
                out.append(f"<{t}>" + "".join(f"<li>{_YES}{prose(1, 20)}</li>" for _ in range(int(rng.integers(2, 6)))) + f"</{t}>")
            elif r < 0.77:
                out.append(f"<blockquote>{_YES}{prose(4, 40)}</blockquote>")
            elif r < 0.80:
                out.append("<table>" + "".join(f"<tr><td>{_YES}{word()}</td><td>{_YES}{prose(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif r < 0.83:
                out.append(f"<div>{_YES}{prose(8, 60)}</div>")
            elif r < 0.85:
                out.append(f"<pre>{_YES}{prose(4, 30)}</pre>")
            else:
                out.append(other(pick(["ad", "aside", "notice", "form", "ad"])))
        body = "".join(out)
        tag = pick(["article", "article", "main", "div", "section", "div", "none"])
        if tag == "none":
            return body
        body = f"<{tag}{sign('content') if tag in ('article', 'main') else f' class={chr(34)}{pick(_CONTENT)}{chr(34)}'}>{body}</{tag}>"
        return f"<main>{body}</main>" if tag == "article" and maybe(0.3) else f'<div class="{pick(["wrapper", "container", "row", "page"])}">{body}</div>' if maybe(0.3) else body

    top = [other(k) for k in ("notice", "header", "nav", "form", "ad", "aside") if maybe(0.4)]
    end = [other(k) for k in ("comments", "aside", "ad", "nav", "notice", "footer") if maybe(0.45)]
    rng.shuffle(top)
    page = "".join(top) + article() + "".join(end)
    page = f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>"
    return page[: int(rng.integers(len(page) // 2, len(page)))] if maybe(0.1) else page


@cache
def labelled(pages: int, seed: int) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of that many pages."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < pages:
        row = [b for b in blocks(labelled_page(rng)) if _YES in b.text or _NO in b.text]
        y = [int(_YES in b.text) for b in row]
        for b in row:
            b.text = b.text.replace(_YES, "").replace(_NO, "").strip() or "x"
        if row:
            out.append((features(row), y))
    return out


@cache
def model(pages: int = PAGES, seed: int = SEED) -> Chain:
    return train(labelled(pages, seed))


def main_text(chain: Chain, page: str | None) -> str:
    row = blocks(page or "")
    return "\n".join(b.text for b, y in zip(row, chain.viterbi(features(row)), strict=True) if y) if row else ""


def _extractor(chain: Chain):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(chain, page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    return extract


def extract(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html. A row for each page, as in MAIN."""
    return pages.select("page_id", "url", "html").mapInArrow(_extractor(model()), MAIN)
