import re

import numpy as np
import pytest

from foliospark.llm import html_crf as h


def rule(page):
    """What the tables' one template calls its article, read another way."""
    import html

    m = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1|h2|article)>", m[1].replace("<br>", " ")) if m else []
    return "\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if t)


def test_tables_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: rule(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in h.extract(pages).collect()}
    assert got.keys() == want.keys()
    assert [k for k in want if got[k].text != want[k]] == []
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_held_out_accuracy():
    chain = h.model()
    right = total = 0
    for rows, y in h.labelled(200, 99):
        got = chain.viterbi(rows)
        right += sum(a == b for a, b in zip(got, y, strict=True))
        total += len(y)
    assert right / total > 0.97


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    chain = h.Chain(list("abcd"))
    chain.weight, chain.step, chain.begin = rng.normal(size=4), rng.normal(size=(2, 2)), rng.normal(size=2)
    chain.freeze()
    for _ in range(40):
        rows = [[c for c in "abcdz" if rng.random() < 0.5] for _ in range(6)]
        score = lambda y: chain.begin[y[0]] + sum(chain.step[a, b] for a, b in zip(y, y[1:], strict=False)) + sum(chain.weight[chain.number[n]] for r, k in zip(rows, y, strict=True) if k for n in r if n in chain.number)  # noqa: E731, B023
        best = max(([i >> k & 1 for k in range(6)] for i in range(64)), key=score)
        assert abs(score(best) - score(chain.viterbi(rows))) < 1e-9


HARD = '<html><body><div id="cookie-notice"><p>We use cookies.</p></div><header class="site-header"><a href="/">Site</a></header><ul class="menu"><li><a href="/a">A</a></li></ul><main><article><h1>Title &amp; more</h1><p>First  paragraph with\n a few words, and &lt;more&gt; of them.</p><div class="advert">Buy now.</div><p>Second one is here as well, with words.</p><form><input><p>Sign up for news</p></form></article><section class="comments"><h3>Comments</h3><div class="comment"><p>Nice article, I liked it a lot, really.</p></div></section></main><aside class="sidebar"><h3>Related</h3><ul><li><a href="/b">Other</a></li></ul></aside><footer><p>© 2024 Site</p></footer><script>x("<p>")</script></body></html>'


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p", ""), ("<script>a", ""), (HARD, "Title & more\nFirst paragraph with a few words, and <more> of them.\nSecond one is here as well, with words."), (HARD.replace("<main><article>", '<div class="post-content">').replace("</article>", "</div>").replace("</main>", ""), "Title & more\nFirst paragraph with a few words, and <more> of them.\nSecond one is here as well, with words.")])
def test_pages(page, text):
    assert h.main_text(h.model(), page) == text


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, None, None, "x", "y"), (None, "u", "", "x", "y"), (2, "u", "<article><p>" + "word " * 50000 + "end.</p></article>", "x", "y"), (2, "u", "<article><p>" + "word " * 50000 + "end.</p></article>", "x", "y")]
    got = sorted(h.extract(spark.createDataFrame(rows, schema)).collect(), key=lambda r: r.n_chars)
    assert [r.n_chars for r in got] == [0, 0, 250004, 250004]
    assert h.extract(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p title=don't>Hello world</p><p>second, it's here</p>", ["Hello world", "second, it's here"]),
        ('<p class="x>Hello world</p>', ["Hello world"]),
        ("<script>var a = 1</script x><p>Rest of it</p>", ["Rest of it"]),
        ("<style>p > a</style/><p>a</p><title>t</title\n>b", ["a", "b"]),
        ("<script>'</scripted>'</script>x", ["x"]),
        ("<p a='>' b=\">\" c=d'e\"f>x</p>", ["x"]),
        ("a <!--> b <!---> c <!-- > --!> d </> e </ 3> f <? g > h", ["a b c d e f h"]),
        ("<button>open <svg>and on<p>more", ["open and on", "more"]),
        ("1 < 2 & 3 > 2 &amp;lt; &#x41;", ["1 < 2 & 3 > 2 &lt; A"]),
    ],
)
def test_markup(page, texts):
    assert [b.text for b in h.blocks(page)] == texts


def test_attributes():
    (b,) = h.blocks("<div CLASS = 'a b' id=c-d role=\"main\" data-class=no title='class=no'>x")
    assert b.path == (("div", "c:a", "c:b", "i:c", "i:d", "r:main"),)


@pytest.mark.parametrize("piece", ['<p class="x>', "<p title='", "<svg>", "<a b=", "<p a a ", "<!--", "</script", "<", "<p a='\"", "&#"])
def test_broken_markup_takes_linear_time(piece):
    import time

    took = []
    for n in (20_000, 80_000):
        begin = time.perf_counter()
        h.blocks(piece * n)
        took.append(time.perf_counter() - begin)
    assert took[1] < 9 * took[0] + 0.5


#: Pages by hand, not by the generator; lines of the article begin with a plus, of all else with a minus.
BY_HAND = [
    '<body><div id=top><a href=/>-The Daily Post</a><a href=/n>-News</a></div><div class="story-body"><h1>+Town opens its new library</h1><p>+The town opened a library on Monday, after four years of work and two of delays.</p><div class="ad-slot"><p>-Buy shoes today</p></div><p>+Its three floors hold some forty thousand books, and a hall for concerts.</p></div><div class="related-links"><h3>-More news</h3><ul><li><a href=/1>-Bridge closed</a><li><a href=/2>-School prize</a></ul></div><div id=footer>-Copyright The Daily Post</div>',
    '<body><nav><ul><li><a href=/a>-Docs</a></li><li><a href=/b>-Blog</a></li></ul></nav><main><h1>+Installing the tool</h1><p>+First get the archive and unpack it in a folder of your own.</p><pre>+tar xf tool.tar</pre><h2>+Next steps</h2><ol><li>+Read the guide about the settings.</li><li>+Write a first file and run it.</li></ol></main><aside class=toc><a href=#a>-Installing</a> <a href=#b>-Next</a></aside><footer><p>-Terms</p></footer>',
    '<body><div class="cookie-banner"><p>-We use cookies on this site, to make it better.</p><button>-OK</button></div><header><a href=/>-Garden blog</a></header><article class="post"><h1>+Roses in winter</h1><p>+Cover the roots with leaves before the first frost comes, and leave them alone.</p><blockquote>+A rose forgives much, but not wet feet.</blockquote><p>+In March, cut back to three buds.</p></article><section id="comments"><h2>-2 comments</h2><div class="comment"><p>-Thanks, this helped me a lot with my old climbing roses.</p></div><div class="comment"><p>-What about potted ones?</p></div></section>',
    '<table><tr><td class=menu><a href=/1>-Start</a><br><a href=/2>-Kontakt</a></td><td class=content><h2>+Der alte Bahnhof</h2><p>+Im Jahr 1872 fuhr hier der erste Zug, und viele Leute kamen, um ihn zu sehen.<p>+Heute ist im Haus ein Café.</td></tr></table><div class=footer>-Impressum</div>',
]


def test_pages_by_hand():
    """Not one page must be perfect, but nearly all blocks must be right."""
    chain, right, total = h.model(), 0, 0
    for page in BY_HAND:
        row = h.blocks(page)
        want = [b.text.startswith("+") for b in row]
        for b in row:
            b.text = re.sub(r"(^| )[+-](?=\S)", r"\1", b.text)
        got = chain.viterbi(h.features(row))
        right += sum(a == b for a, b in zip(got, want, strict=True))
        total += len(row)
        print([(b.text, a) for a, b, c in zip(got, row, want, strict=True) if a != c])
    assert right / total >= 0.9
