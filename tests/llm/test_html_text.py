import random
import time
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import html_text as H


@pytest.fixture(scope="module")
def trees():
    return H.trained()


def texts(trees, *sources):
    return H.main_texts(list(sources), trees)


def test_held_out_pages(trees):
    x, y, pages = H.examples(1234, 200)
    odds = trees.log_odds(x)
    assert ((odds > 0) == (y > 0)).mean() > 0.98
    at = right = chars = wrong = 0
    for page in pages:
        n = len(page.parent)
        keep, truth = H.kept(page, odds[at : at + n]), y[at : at + n] > 0
        at += n
        right += all(keep[i] == truth[i] for i, _, _ in page.runs)
        chars += sum(len(t) for _, t, _ in page.runs)
        wrong += sum(len(t) for i, t, _ in page.runs if keep[i] != truth[i])
    assert right >= 180 and wrong < 0.03 * chars


def test_decoding_is_the_best_consistent_labelling():
    rnd = random.Random(3)
    for _ in range(40):
        page = H.Page("")
        for _ in range(rnd.randint(0, 8)):
            page._node(rnd.randrange(len(page.parent)), 0, 0, False)
        n = len(page.parent)
        odds = np.array([rnd.uniform(-4, 4) for _ in range(n)])
        best, most = None, -1e9
        for code in range(1 << (n - 1)):
            keep = [True] + [bool(code >> i & 1) for i in range(n - 1)]
            if all(keep[page.parent[i]] or not keep[i] for i in range(1, n)):
                total = sum(-np.logaddexp(0, -o if k else o) for o, k in zip(odds, keep))
                if total > most:
                    best, most = keep, total
        assert H.kept(page, odds) == best


LONG = "Some words of prose, long enough to look like an article. They go on for a while, and then they stop."


def test_boilerplate_goes(trees):
    page = f"""<html><head><title>no</title><style>p{{}}</style></head><body><header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav></header>
    <div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div><article><h1>A title here</h1><p>{LONG}</p><script>var x = "</p>";</script><p>Fish &amp; chips&nbsp;&lt;3</p></article>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=/x>Other story</a></li></ul></aside><section id="comments"><h3>Comments</h3><div class=comment><p>Nice one, thanks!</p></div></section>
    <form class="search-form"><label>Find <input name=q></label></form><footer>&copy; 2020 Company</footer></body></html>"""
    assert texts(trees, page) == [f"A title here {LONG} Fish & chips <3"]


def test_broken_markup_and_white_space(trees):
    assert texts(trees, f"<article><h1>T &amp\n x</h2><p><b>{LONG}<br><p>two\t <i>a</i>b<br>c <!-- no --><p>{LONG}</article") == [f"T & x {LONG} two ab c {LONG}"]
    assert texts(trees, "", "   ", "<script>x", "<!-- x") == ["", "", "", ""]
    assert texts(trees, LONG) == [LONG]
    assert texts(trees, f'<article title="a>b"><p>{LONG}</p></article>') == [LONG]


def test_query_rows(spark, trees):
    page = f"<body><nav><a href=/>x</a></nav><article><p>{LONG} é😀</p></article></body>"
    df = spark.createDataFrame([(1, "u", page, 7), (1, "u", page, 7), (None, None, None, 8), (2, "v", "", 9)], "page_id long, url string, html string, n_chars long")
    got = sorted((tuple(r) for r in H.extract(df, trees=trees).collect()), key=str)
    assert got == sorted([(1, "u", f"{LONG} é😀", len(LONG) + 3)] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert H.extract(df.limit(0), trees=trees).count() == 0


def test_very_long_and_deep_pages(trees):
    assert len(texts(trees, "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>")[0]) > 400_000
    assert isinstance(texts(trees, "<div>" * 3000 + LONG)[0], str)


def test_head_that_is_not_ended(trees):
    article = "".join(f"<p>Sentence {i} of a long article that says a good deal about the river and its town.</p>" for i in range(8))
    head = "<head><title>x <p> y</title><script>document.write('<p>no</p>')</script><template><p>hidden</p></template><meta charset=utf-8>"
    open_, closed = texts(trees, f"<html>{head}{article}", f"<html>{head}</head><body>{article}")
    assert open_ == closed and "Sentence 0" in open_ and "Sentence 7" in open_
    assert not any(x in open_ for x in ("hidden", "no</p>", "x <p>"))


def test_broken_markup_takes_linear_time():
    shapes = ["<a" * 200_000, "<a" * 100_000 + ">", "<div>" * 20_000 + "</p>" * 50_000, "<div>" * 20_000 + "<li>x" * 30_000, "<li><ul>" + "<div>" * 20_000 + "<li>x</div>" * 20_000, '<a ">"' * 60_000, "<a '" * 60_000 + ">" * 60_000]
    shapes += ["<!--" * 100_000 + ">", "<svg>" * 60_000 + "</svg>", "<script>" * 60_000, "<svg></svg>" * 60_000, "<" * 300_000, "&amp" * 100_000, "<h1>" * 30_000 + "</h2>" * 30_000, "<p>" * 60_000]
    for source in shapes:
        began = time.process_time()
        H.Page(source)
        assert time.process_time() - began < 2, source[:20]


def test_elements_that_nothing_ends(trees):
    article = f"<article><h1>On rivers</h1><p>{LONG}</p><svg viewBox=x><path d=y><p>After {LONG}</p><p>Last {LONG}</p></article>"
    assert texts(trees, article)[0].endswith(f"After {LONG} Last {LONG}")
    assert texts(trees, f"<article><p>{LONG}</p><svg><svg><text>no</text></svg><p>{LONG}</p></article>") == [f"{LONG} {LONG}"]
    assert texts(trees, f"<article><p>{LONG} <svg><text>no</text></svg></p><p>x<sup>2</sup> is <math><mi>y</mi><mo>+</mo><mn>1</mn><annotation>no</annotation></math>. {LONG}</p></article>") == [f"{LONG} x2 is y+1. {LONG}"]


def test_a_script_does_not_swallow_what_follows(trees):
    page = f"""<article><p>{LONG}</p><script>var a = b<c ? "it's" : 1;</script><p>Don't {LONG}</p><p title="x">Can't {LONG}</p></article>"""
    assert texts(trees, page) == [f"{LONG} Don't {LONG} Can't {LONG}"]


#: Pages written by hand, with the article that each holds.
BY_HAND = [
    (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>Bridge reopens - Valley Herald</title><link rel=stylesheet href=a.css></head><body>
<a class="skip-link" href="#c">Skip to content</a><header class="site-header"><div class=logo>Valley Herald</div><nav><a href=/>Home</a> <a href=/sport>Sport</a></nav></header>
<main id=c><article><header><h1>Bridge reopens after eight months</h1><p>By a staff writer, Monday</p></header>
<p>The old stone bridge at Lower Mill opened to traffic again this morning, eight months after a flood took away two of its piers.</p>
<p>Engineers said that the new piers stand on rock, and that the road surface was laid twice because of the frost in March.</p>
<div class="ad-slot">Advertisement</div>
<blockquote><p>We drove nine miles round every day, said the baker, and the bread was cold when it came.</p></blockquote>
<p>Lorries of more than twelve tonnes still have to use the bypass until the autumn, the county said.</p></article></main>
<aside class="related"><h2>More on this</h2><ul><li><a href=/1>Flood money runs out</a></li><li><a href=/2>Mill for sale</a></li></ul></aside>
<section class="comments"><h2>2 comments</h2><div class=comment><p>About time!</p></div><div class=comment><p>It was the council's fault.</p></div></section>
<footer><p>&copy; Valley Herald. All rights reserved.</p></footer></body></html>""",
        "Bridge reopens after eight months By a staff writer, Monday The old stone bridge at Lower Mill opened to traffic again this morning, eight months after a flood took away two of its piers. Engineers said that the new piers stand on rock, and that the road surface was laid twice because of the frost in March. We drove nine miles round every day, said the baker, and the bread was cold when it came. Lorries of more than twelve tonnes still have to use the bypass until the autumn, the county said.",
    ),
    (
        """<HTML><HEAD><TITLE>Sourdough</TITLE></HEAD><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD CLASS=nav><A HREF=i.html>Index</A> | <A HREF=b.html>Breads</A> | <A HREF=c.html>Cakes</A></TD></TR></TABLE>
<DIV ID=content><H1>Sourdough, slowly</H1><P>Feed the starter the evening before you mean to bake, with as much flour as water by weight.<P>In the morning it should have doubled. Mix it with the rest of the flour, the water and the salt, and leave the dough alone for an hour.
<OL><LI>Fold the dough four times in two hours.<LI>Shape it and put it in a basket.<LI>Bake it in a closed pot for forty minutes.</OL><P>Let the loaf cool down before you cut it, however hard that is.</DIV>
<FORM ACTION=/search CLASS=search><INPUT NAME=q><INPUT TYPE=submit VALUE=Search></FORM><DIV CLASS=footer>Copyright Aunt Mary</DIV></BODY></HTML>""",
        "Sourdough, slowly Feed the starter the evening before you mean to bake, with as much flour as water by weight. In the morning it should have doubled. Mix it with the rest of the flour, the water and the salt, and leave the dough alone for an hour. Fold the dough four times in two hours. Shape it and put it in a basket. Bake it in a closed pot for forty minutes. Let the loaf cool down before you cut it, however hard that is.",
    ),
    (
        """<body><div id="cookie-banner"><p>This site uses cookies to count visits.</p><button>Fine</button><button>No</button></div><div class="navbar"><ul><li><a href="/">Start</a></li><li><a href="/docs">Docs</a></li><li><a href="/blog">Blog</a></li></ul></div>
<div class="post"><h1>Why the build was slow</h1><p>For three weeks our builds took twice as long as before, and nobody could say why.</p><p>It turned out that a cache was keyed by the name of the machine, which changes with every run.</p><pre>cache-key: $(hostname)-deps</pre><p>With the lock file as the key, the builds are back at four minutes.</p><div class="share-buttons"><a href=#>Share</a> <a href=#>Post</a></div></div>
<div class="sidebar"><h3>Popular</h3><p><a href=/p1>Ten tips</a></p><p><a href=/p2>Our stack</a></p></div><div id="footer">Made with care &middot; <a href=/imprint>Imprint</a></div></body>""",
        "Why the build was slow For three weeks our builds took twice as long as before, and nobody could say why. It turned out that a cache was keyed by the name of the machine, which changes with every run. cache-key: $(hostname)-deps With the lock file as the key, the builds are back at four minutes.",
    ),
]


def test_pages_written_by_hand(trees):
    for source, article in BY_HAND:
        got, want = Counter(texts(trees, source)[0].split()), Counter(article.split())
        both = sum((got & want).values())
        assert both >= 0.95 * sum(want.values()) and both >= 0.95 * sum(got.values()), texts(trees, source)
    exact = sum(texts(trees, source) == [article] for source, article in BY_HAND)
    assert exact >= 2
