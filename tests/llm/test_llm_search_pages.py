"""Vector search against brute force; pages made from known articles."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.llm import tables, vector_search
from gistmill.llm.main_text import main_text, page_text
from gistmill.llm.vector_search import top_k

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("size", T.StringType()),
    T.StructField("score", T.StringType()),
])


def brute(rows, step, k):
    usable = sorted({
        (i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    })
    out = []
    for q in sorted({i for i, _ in usable if i % step == 0}):
        best = set()
        for i, v in usable:
            if i == q:
                best |= {(-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != q and len(w) == len(v)}
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(sorted(best)[:k])]
    return out


@pytest.mark.parametrize("blocks", [(4096, 512), (16, 3)])
def test_top_k(spark, blocks):
    rng = np.random.default_rng(2)
    common = rng.normal(0, 0.3, 8).tolist()
    rows = [(i, common if i % 3 == 0 else rng.normal(0, 0.3, 8).tolist()) for i in range(200)]
    rows += [(300, None), (None, common), (301, [1.0, None] + [0.0] * 6), (302, [math.inf] + [0.0] * 7), (303, [math.nan] * 8), (304, []), (310, [])]
    rows += [(311, [1.0, 2.0]), (320, [2.0, -1.0]), (5, rows[5][1]), (330, [0.0] * 8), (340, [1e9] * 8), (341, [-1e9] * 8)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    found = top_k(df, F.col("vec_id") % 10 == 0, 7, block_rows=blocks[0], query_rows=blocks[1])
    assert sorted(map(tuple, found.collect())) == brute(rows, 10, 7)
    assert top_k(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_top_k_with_ties_repeats_and_stripes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-2, 3, 4) / 64).tolist()) for i in range(150)]
    rows += [(i, [0.0] * 4) for i in (0, 10, 20, 151, 152)] + [(7, [0.5, 0.0, 0.0, 0.0]), (7, [0.0, 0.5, 0.0, 0.0]), (30, [0.25] * 4), (30, [-0.25] * 4)]
    rows += [(40, [0.25] * 4)] * 30 + rows * 2
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(4)
    found = top_k(df, F.col("vec_id") % 10 == 0, 6, block_rows=12, query_rows=3, stripe_blocks=3, group_blocks=2)
    assert sorted(map(tuple, found.collect())) == brute(rows, 10, 6)


def test_exact_vectors_are_read_late(spark, monkeypatch):
    """Cells alone are scanned, and few of the exact vectors leave their blocks."""
    scans, reads = [], []
    stored, read = tables.stored, vector_search._read

    def watched(df, **options):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, **options)

    def reading(files, asked, wanted, k):
        reads.append(wanted.select("block", "slot"))
        return read(files, asked, wanted, k)

    monkeypatch.setattr(tables, "stored", watched)
    monkeypatch.setattr(vector_search, "_read", reading)
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, rng.normal(0, 0.1, 16).tolist(), "x", "y") for i in range(6000)], SCHEMA)
    assert top_k(df, F.col("vec_id") % 500 == 0, 5, block_rows=512).count() == 12 * 5
    scan, = (x for x in scans if "FlatMapCoGroupsInArrow" in x)
    assert "cells" in scan and "exact" not in scan.split("FlatMapCoGroupsInArrow")[1].split("Relation")[0]
    assert reads[0].union(reads[1]).distinct().count() < 12 * 5 * 2


WRAP = """<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>if (a</b/.test(x)) document.write("<p>no</p>")</script></head>
<body class="home"><header><a href="/">Site</a><p>Slogan of the site</p></header><nav><ul><li><a href="/a">A menu item</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice"><p>We use cookies and so on, please agree to all of them now.</p><button>OK</button></div>
<div id="sidebar"><h3>Popular</h3><p>Some long teaser text that isn't the article at all, however long.</p></div>
{article}
<section id="comments"><h2>Comments</h2><article class="comment"><p>First! {noise}</p></article><form action="/c"><textarea>Say</textarea><p>Post it</p></form></section>
<div class="ad">Buy this now</div><aside><p>{noise}</p></aside><footer><p>&copy; 2020 Site, all rights reserved</p></footer></body></html>"""


def sentence(rng):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 40)))


@pytest.mark.parametrize("shape", ["article", "div", "broken"])
def test_articles_come_back(shape):
    rng = random.Random(len(shape))
    for _ in range(40):
        blocks = [sentence(rng) for _ in range(rng.randint(2, 9))]
        head, rest = blocks[0], blocks[1:]
        if shape == "article":
            inner = f"<article><h1>{head}</h1>" + "".join(f"<p>{x.replace(' ', chr(10) + '  ', 1)} <b>&amp; &eacute;</b></p>" for x in rest) + "</article>"
            expected = [head] + [f"{x} & é" for x in rest]
        elif shape == "div":
            inner = f'<div class="content"><div class="story"><h1>{head}</h1>' + "".join(f"<p>{x}, <a href='/x'>link</a></p>" for x in rest) + "</div></div>"
            expected = [head] + [f"{x}, link" for x in rest]
        else:
            inner = f"<article><h1>{head}</h1><p><b>" + "<br><p>".join(rest) + "<!-- a <p> --></article>"
            expected = [head, *rest]
        page = WRAP.format(article=inner, noise=sentence(rng) if shape != "div" else "short")
        assert page_text(page) == "\n".join(expected)


def test_names_that_only_look_like_furniture():
    body = '<div class="elementor-widget-container has-sidebar"><div class="entry-header"><h1>Head line</h1></div><p>Some words, and more of them.</p></div>'
    assert page_text(WRAP.format(article=body, noise="x")) == "Head line\nSome words, and more of them."
    assert page_text(f"<body><form id=f>{body}</form></body>") == "Head line\nSome words, and more of them."


def test_awkward_pages(spark):
    pages = [
        (1, "u", None, "t"), (2, None, "", "t"), (3, "u", "plain text &lt;3", "t"), (4, "u", "<p>unclosed <b>bold", "t"), (5, "u", "<div>" * 5000 + "deep", "t"),
        (6, "u", "<script>never closed <p>x", "t"), (7, "u", "<<<>>> < p > a<b", "t"), (8, "u", "<ul><li>one<li>two</ul>", "t"), (8, "u", "<ul><li>one<li>two</ul>", "t"),
        (9, "u", "<nav>only a menu</nav>", "t"), (10, "u", "<p>" + "word " * 50000 + "</p>", "t"), (None, "u", "<!-- open", "t"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, TEXT string")
    found = main_text(df)
    assert sorted(found.columns) == ["n_chars", "page_id", "text", "url"]
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in found.collect()))
    assert all(n == len(t) for _, t, n in got)
    texts = {i: t for i, t, _ in got}
    assert texts[0] == texts[1] == texts[2] == texts[6] == texts[9] == ""
    assert (texts[3], texts[4], texts[5], texts[8]) == ("plain text <3", "unclosed bold", "deep", "one\ntwo")
    assert texts[10] == ("word " * 50000).strip() and len(got) == len(pages)
    assert main_text(df.limit(0)).collect() == []


def test_head_without_an_end():
    body, expected = "<article><h1>Head line</h1><p>Some words, and more of them.</p></article>", "Head line\nSome words, and more of them."
    for start in ("<html><head><title>T</title><meta charset=x><body>", "<head><title>T</title></head>", "<head><title>T</title>", "<html><head><link rel=x>"):
        assert page_text(start + body) == expected


def test_icons_and_custom_elements():
    body, expected = "<article><h1>Head line</h1><p>Some words, and more of them.</p></article>", "Head line\nSome words, and more of them."
    for icon in ('<svg class="icon"/>', '<svg class="icon">', "<select>", "<object data=x>", "<noscript>", "<template>", "<math>"):
        assert page_text(f"<body>{icon}{body}<footer><svg><path d=x></svg></footer></body>") == expected
    assert page_text(f"<body><noscript><div>Please turn on scripts</div></noscript>{body}") == expected
    assert page_text("<article><p>One <svg><path/></svg> line</p><title-bar><p>Two</p></title-bar></article>") == "One line\nTwo"


def test_wrappers_with_a_block_beside_them():
    words = "Some words, and more of them, for as long as it takes to tell a story. " * 5
    inner, expected = f"<h1>Head line</h1><p>{words}</p><p>{words}</p>", f"Head line\n{words.strip()}\n{words.strip()}"
    for open_tag, end in (("<form id=f>", "</form>"), ('<div class="sidebar-right">', "</div>"), ('<div class="main-content no-js form-page">', "</div>")):
        for body in (inner, f"<article>{inner}</article>"):
            assert page_text(f"<body><div>Skip to content</div>{open_tag}{body}{end}</body>").endswith(expected)
    assert page_text(f'<article><h1>A</h1><p>Short.</p></article><div class="sidebar">{inner}</div>') == "A\nShort."


@pytest.mark.parametrize("block, expected", [
    ('<p class="comment-on-policy">Kept</p>', "Kept"), ('<p class="share-price">Kept</p>', "Kept"), ('<p class="intro promo">Kept</p>', "Kept"),
    ('<section class="reply-to-critics"><p>Kept</p></section>', "Kept"), ('<div class="table ad-hoc">Kept</div>', "Kept"),
    ('<ul class="menu"><li>Kept</ul>', "Kept"), ('<p>AT&<b>amp;</b>T &amp;lt;</p>', "AT&amp;T &lt;"),
    ('<ul class="menu"><li><a href="/">Home</a></ul>', ""), ('<ul class="comments"><li>First!</ul>', ""), ('<div class="ad-slot">Buy</div>', ""),
    ('<div class="share-buttons">Tell others</div>', ""), ('<div id="comments-2"><p>First!</p></div>', ""), ('<aside>More</aside>', ""),
])
def test_names_within_an_article(block, expected):
    text = [f"Sentence {k} of the article goes on for some time." for k in range(6)]
    body = "".join(f"<p>{x}</p>" for x in text)
    for outer in ("<main><article>{}</article></main>", "<article>{}</article>"):
        page = WRAP.format(article=outer.format(f"<h1>Head</h1>{body}{block}<p>The end.</p>"), noise="x")
        assert page_text(page) == "\n".join(["Head", *text, *([expected] if expected else []), "The end."])


@pytest.mark.parametrize("page", [
    "<div class=sidebar>" * 30000 + "x", "<div>" * 30000 + "</span>" * 30000, "<object>" * 30000, "<span>" * 30000 + "<p>x" * 30000,
    "<a " * 30000, "<article>" + "<ul class=menu><li>x" * 30000, "<form>" * 30000 + "<p>x</p>" * 30000,
])
def test_odd_pages_take_linear_time(page):
    """Seconds each; a walk up the tree for every tag would take an hour."""
    begin = time.monotonic()
    page_text(page)
    assert time.monotonic() - begin < 30


def slow_text(tree):
    """Composite text density by its definition, each node's counts taken afresh from its whole subtree."""

    def inside(node):
        return [y for x in node[1] if isinstance(x, tuple) for y in [x, *inside(x)]]

    def chars(node):
        return sum(chars(x) if isinstance(x, tuple) else len(x.replace(" ", "")) for x in node[1])

    def link_chars(node):
        return chars(node) if node[0] == "a" else sum(link_chars(x) for x in node[1] if isinstance(x, tuple))

    def links(node):
        return len(inside(node)) if node[0] == "a" else sum(links(x) + (x[0] == "a") for x in node[1] if isinstance(x, tuple))

    share = link_chars(tree) / max(chars(tree), 1)

    def density(node):
        c, t, lc, lt = chars(node), len(inside(node)), link_chars(node), links(node)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / max(t, 1) * max(math.log(max(c / max(lc, 1) * (max(t, 1) / max(lt, 1)), 1)), 0) / math.log(base + 1)

    def total(node):
        return sum(density(x) for x in node[1] if isinstance(x, tuple))

    def path_to(node, wanted):
        if node is wanted:
            return [node]
        for x in node[1]:
            below = path_to(x, wanted) if isinstance(x, tuple) else None
            if below:
                return [*below, node]

    core = max([tree, *inside(tree)], key=total)
    path = path_to(tree, core)
    least, chosen = min(map(density, path)), core
    for lower, node in zip(path, path[1:]):
        if any(isinstance(x, tuple) and x is not lower and chars(x) and density(x) >= least for x in node[1]):
            chosen = node
    return " ".join(" ".join(x for y in [chosen, *inside(chosen)] for x in y[1] if isinstance(x, str)).split())


def made_tree(rng, depth=0):
    if depth and rng.random() < 0.3:
        return (rng.choice(["p", "span"]), [sentence(rng)])
    children = []
    for _ in range(rng.randint(1, 4)):
        if depth < 4 and rng.random() < 0.7:
            children.append(made_tree(rng, depth + 1))
        else:
            children.append(rng.choice([(rng.choice(["p", "b", "h2"]), [sentence(rng)]), ("a", [sentence(rng)[:30]]), ("ul", [("li", [("a", ["one"])])])]))
    return ("div", children)


def test_density_is_as_defined():
    rng = random.Random(11)

    def markup(node):
        return f"<{node[0]}>{''.join(markup(x) if isinstance(x, tuple) else x for x in node[1])}</{node[0]}>"

    for _ in range(200):
        tree = made_tree(rng)
        found = page_text(markup(tree)).replace("\n", " ")
        # inline neighbours join without a space, and a block's own text may stand between its children
        assert sorted(found.replace(" ", "")) == sorted(slow_text(("#root", [tree])).replace(" ", ""))
