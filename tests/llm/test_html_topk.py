"""HTML extraction and exact top-k."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from careops.llm import html_text, topk

MEDIUM = "/root/testdata/sf0.01"
SENTENCE = "The quick summary of a long story is told in many plain words here"


def texts(spark, htmls):
    df = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    df = df.withColumns({c: F.lit("clash") for c in ("text", "n_blocks", "words", "n_main")})
    return {r.page_id: r.text for r in html_text.extract(df).collect()}


def test_tree_learns_its_table():
    x, y = html_text.labelled_blocks()
    tree = html_text.trained_tree()
    assert (html_text.classify(tree, x) == y).mean() > 0.99
    used = set()

    def walk(n):
        if n.low:
            used.add(html_text.FEATURES[n.feature])
            walk(n.low)
            walk(n.high)
    walk(tree)
    assert {"frame", "link_density"} <= used and used & {"words", "words_before", "words_after"}


def test_grow_splits_where_the_impurity_is_least():
    x = np.array([[0, 5], [1, 6], [2, 1], [3, 2]], float)
    tree = html_text.grow(x, np.array([True, True, False, False]), least=1)
    assert html_text.classify(tree, x).tolist() == [True, True, False, False] and tree.low.low is None


def test_pages_of_several_makes(spark):
    s, t = SENTENCE + ".", SENTENCE.upper() + "!"
    pages = [
        f"<html><head><title>no</title></head><body><nav><a href=1>Home</a></nav><article><h1>Head</h1><p>{s}</p><p>ok</p></article><footer>(c) us</footer></body>",
        f"<div class='site-header'>Site</div><div id=content><p>{s}<p><b>{t}</b></div><div class=sidebar><p>{s}</p></div>",
        f"<main><p>{s}</p><form><input><p>{t}</p></form><section class='comments'><p>{t}</p></section></main>",
        f"<ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>{s} {s}</p><p>{t} {t}</p><p><a href=3>next page</a></p>",
        f"<article><p>{s}</p><script>var x='<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> --><div class=ad>{t}</div><p>{t}</p></article>",
        f"<article><p>A &amp; B &lt;i&gt; &eacute;&#233;&#x1F642;&nbsp;x\n\t y</p><p>{s}",
        f"<article><p>{s}</p><p>cut <b>of",
        f"<article><p title='a > b' data-x=\"<p>\">{s}</p></article>",
        f"<article><p>wo<b>r</b>d {s}</p></article><div hidden>{t}</div><div style='display: none'>{t}</div><div class=cookie-banner>{t}</div>",
    ]
    got = texts(spark, pages)
    assert got == {0: f"Head {s} ok", 1: f"{s} {t}", 2: s, 3: f"{s} {s} {t} {t}", 4: f"{s} {t}",
                   5: f"A & B <i> éé🙂 x y {s}", 6: f"{s} cut of", 7: s, 8: f"word {s}"}


def test_deep_and_omitted_end_tags():
    """A menu or table of any depth ends where it is closed; the article after it is not in it."""
    for inside in ("<table>" + "<tr><td>a<td>b" * 1000 + "</table>", "<dl>" + "<dt>a<dd>b" * 1000 + "</dl>", "<div>x" * 1000):
        for tag in ("nav", "div class=sidebar"):
            found = html_text.blocks(f"<{tag}>{inside}</{tag.split()[0]}>" * (1 if inside[1:4] != "div" or tag == "nav" else 0)
                                     + f"<article><p>{SENTENCE}</p></article><p>after")
            assert [(b.text, b.frame, b.main) for b in found[-2:]] == [(SENTENCE, False, True), ("after", False, False)]
            assert all(b.frame and not b.main for b in found[:-2])
    p = html_text._Parser()
    p.open("table", "")
    for _ in range(1000):
        for tag in ("tr", "td", "td"):
            p.open(tag, "")
    assert [o.tag for o in p.stack] == ["table", "tr", "td"]
    p.open("table", "")  # a table in a cell closes nothing outside
    p.open("tr", "")
    assert [o.tag for o in p.stack] == ["table", "tr", "td", "table", "tr"]


def test_frame_names_around_the_whole_page(spark):
    s, t = SENTENCE + ".", SENTENCE.upper() + "!"
    article, side = f"<article><h1>Head</h1><p>{s}</p><p>ok</p></article>", f"<div class=sidebar><p>{t}</p></div>"
    pages = [
        f"<html class=navbar><body class='has-sidebar'>{article}{side}</body></html>",
        f"<div class='content-with-sidebar'>{article}{side}</div>",
        f"<body id='search-page'><div id='search-page'><main><h1>Head</h1><p>{s}</p><p>ok</p></main></div>",
        f"<form method=post action=x><nav><a href=1>Home</a></nav>{article}<div id=footer>{t}</div></form>",
        f"<form><div class=header>Site</div><div id=content><h1>Head</h1><p>{s}</p><p>ok</p></div></form>",
        f"<div class=has-sidebar>{article}<div class=comments><article><p>{t}</p></article></div></div>",
        f"{article}<div class=comments><article><p>{t}</p></article></div><aside><article><p>{t}</p></article></aside>",
        f"<div id=widgets><article><h1>Head</h1><p>{s}</p><div class=ad>{t}</div><p>ok</p></article></div>",
    ]
    assert texts(spark, pages) == dict.fromkeys(range(len(pages)), f"Head {s} ok")
    long = f"<p>{s} {s}</p><p>{t} {t}</p>"
    assert texts(spark, [f"<form>{long}</form>", f"<article><p>{s}</p></article><form>{long}</form>"]) == {
        0: f"{s} {s} {t} {t}", 1: s}


def test_odd_pages(spark):
    odd = [None, "", "   ", "<", "<p", "</p></p>", "<!-- never closed <p>x", "<script>x", "&#0;&#xD800;&bogus;",
           "<p>" * 30_000, "<div>" * 20_000 + SENTENCE, "<a href='", "<p " + "a='" * 5000 + ">x", "x" * 3_000_000]
    got = texts(spark, odd)
    assert len(got) == len(odd) and all(got[i] == "" for i in (0, 1, 2, 5, 6, 7, 9))
    rows = spark.createDataFrame([(None, None, f"<article><p>{SENTENCE}</p></article>")] * 2, "page_id long, url string, html string")
    assert [r.text for r in html_text.extract(rows).collect()] == [SENTENCE] * 2
    assert html_text.extract(rows.limit(0)).count() == 0


def test_given_pages_match_their_article(spark):
    import html
    import re
    from careops.llm.queries import QUERIES
    got = {r.page_id: r for r in QUERIES["op3_html_text"](spark, MEDIUM).collect()}
    for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1].replace("<b>", "").replace("</b>", "")
        expected = " ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", inner)).split())
        assert got[r.page_id].text == expected and got[r.page_id].n_chars == len(expected)


# --------------------------------------------------------------------- top k

def brute(vectors, every, k):
    rows = sorted({(i, tuple(v)) for i, v in vectors})
    width = max((len(v) for _, v in rows), default=0)
    pad = {r: np.array(list(r[1]) + [0] * (width - len(r[1])), dtype=object) for r in rows}
    out = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        found = {(int((pad[a] * pad[b]).sum()) if width else 0, b[0]) for a in rows if a[0] == q for b in rows if b[0] != q}
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:k])]
    return out


@pytest.mark.parametrize("slices,blocks", [(2, (4096, 16384)), (1, (3, 7)), (3, (2, 5)), (8, (100, 40))])
@pytest.mark.parametrize("kind", ["normal", "ties", "positive", "large"])
def test_top_k_matches_brute_force(spark, slices, blocks, kind):
    rng = random.Random(kind)
    make = {"normal": lambda: [round(rng.gauss(0, 300)) for _ in range(8)], "ties": lambda: [rng.randint(-1, 1) for _ in range(8)],
            "positive": lambda: [rng.randint(0, 50) for _ in range(8)], "large": lambda: [rng.randint(-2**29, 2**29) for _ in range(8)]}[kind]
    vectors = [(i, make()) for i in range(150)]
    if kind == "ties":
        vectors += [(1000 + i, vectors[0][1]) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, vec array<long>")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, 5, slices, *blocks)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == sorted(brute(vectors, 10, 5))


def test_top_k_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]), (5, []),
            (6, [0.5]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (10, [-0.0005, 0.0]), (10, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vec", F.lit("clash"))
    vectors = topk.integer_vectors(df)
    ints = [(0, [1024, 2048]), (5, []), (6, [512]), (7, [1024, 1024]), (10, [-1, 0]), (10, [3072, 0])]
    got = topk.top_k(vectors, F.col("vec_id") % 10 == 0, 3)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == sorted(brute(ints, 10, 3))
    assert topk.top_k(vectors.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(vectors, F.lit(False)).count() == 0
    assert topk.top_k(vectors.where("vec_id = 6"), F.lit(True)).count() == 0
