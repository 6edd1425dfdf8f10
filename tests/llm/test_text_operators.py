"""HTML extraction, line dedup and decontamination on small fixtures and against brute force."""

import hashlib
import random
import re
import time

import pytest

from almenara.llm import decontamination, lines, pages
from almenara.llm.pages import Page


@pytest.mark.parametrize("html, text", [
    ("<p>A &amp; B &eacute;&#33;</p>", "A & B é!"),
    ("<article><h1>T</h1><p><b>x<br>y<p>z</p></article><footer>f</footer>", "T\n\nx y\n\nz"),
    ("<nav>menu</nav><div class='side-bar'>s</div><div id=content><p>k</div>", "k"),
    ("<body><header>site</header><article><header><h1>T</h1></header>p</article></body>", "T\n\np"),
    ("<article>a<div class='cookieNotice'>n</div>b<form>f</form><section id=comments>c</section></article>", "a\n\nb"),
    ("<script>var t='</p>';</script><style>p{}</style><p>x</p><!-- c -->", "x"),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\n\nb\n\n1\n\n2\n\n3"),
    ("<a title='x>y'>link</a> tail", "link tail"),
    ("<article class='comment'>no</article><main>yes</main>", "yes"),
    ("", ""), ("<", "<"), ("a < b", "a < b"), ("<p hidden>x</p>", ""), ("<div style='display: none'>x</div>y", "y"),
    ("<div>" * 3000 + "deep", "deep"),
])
def test_main_text(html, text):
    assert Page(html).main_text() == text


def article(inner):
    return f"<nav>menu</nav><article><h1>Title</h1><p>Body text.</p>{inner}</article><footer>f</footer>"


@pytest.mark.parametrize("inner, text", [
    ("<h2 id='related-work'>Related work</h2>", "Related work"), ("<h2 id='forms-of-government'>Forms</h2>", "Forms"),
    ("<section id='search-algorithms'><h2>Search algorithms</h2><p>Binary.</p></section>", "Search algorithms\n\nBinary."),
    ("<section id='search-in-trees'><h2>Looking</h2></section>", "Looking"), ("<table class='form'><tr><td>cell</table>", "cell"),
    ("<p><span aria-hidden='true'>O</span>nce upon</p>", "Once upon"), ("<p>so <math><mi>a</mi><annotation>x</annotation></math> holds</p>", "so a holds"),
    ("<section id='comments'><h2>Comments</h2><p>c</p></section>", ""), ("<div id='related-articles'><h3>Related articles</h3><a>m</a></div>", ""),
    ("<p class='advert'>buy</p>", ""), ("<div aria-hidden='true' class='modal'>m</div>", ""),
])
def test_names_inside_an_article(inner, text):
    assert Page(article(inner)).main_text() == "\n\n".join(filter(None, ["Title", "Body text.", text]))


def test_teasers_beside_main():
    teasers = "<article><h3>Other</h3><p>a much longer teaser text</p></article>" * 3
    assert Page(f"<main><h1>T</h1><p>Body.</p></main>{teasers}").main_text() == "T\n\nBody."


@pytest.mark.parametrize("unit", ["<svg/ ", "<!", "<a \"'>", "</svg", "<!-- ", "<p "])
def test_unclosed_tags_take_linear_time(unit):
    started = time.process_time()
    Page(unit * (1_000_000 // len(unit))).main_text()
    assert time.process_time() - started < 10


@pytest.mark.parametrize("html, text", [
    ("<h1 class='entry-title'>T</h1><div class='text'><p>long body</p></div>", "T\n\nlong body"),
    ("<div class='content'>first part</div><div class='content'>second</div>", "first part\n\nsecond"),
    ("<main><p>The long body of the page</p></main><article class='card'>teaser</article>", "The long body of the page\n\nteaser"),
])
def test_roots_hold_most_of_the_text(html, text):
    assert Page(html).main_text() == text


@pytest.mark.parametrize("html", [
    "<div class='wrapper no-sidebar'><p>body</p></div>x", "<div id='page' class='has-sidebar'><p>body</p></div>x",
    "<div class='content-with-sidebar'><p>body</p></div>x", "<article class='post has-comments'><p>body</p></article>x",
    "<div class='sidebar-layout'><h1>body</h1></div>x", "<div class='sidebar layout'><main>body</main></div>x", "<div class='widget'>body</div>",
])
def test_names_of_wrappers_take_no_article_along(html):
    assert "body" in Page(html).main_text()


def test_equal_subtrees_have_equal_hashes():
    a, b = Page("<div><p>x  y</p></div>").hashes(), Page("<section><div>\n<p>x y</p></div></section>").hashes()
    assert set(a) - {0} <= set(b)
    assert set(Page("<p>x</p>").hashes()) & set(Page("<h1>x</h1>").hashes()) == {0}


def test_site_templates_go_and_copies_stay(spark):
    rows = [(i, f"https://a.org/{i}", f"<body><div>Follow us today</div><div><p>Article {i} body</p></div></body>") for i in range(8)]
    rows += [(100 + i, f"https://b.org/{i}", "<body><div>Same article</div></body>") for i in range(9)]  # copies of one page
    rows += [(200, None, "<p>no site</p>"), (201, "https://a.org/x", None), (202, "not a url", "<p>Follow us today</p>"), (203, "https://c.org", "")]
    rows += rows[:1]
    df = spark.createDataFrame([(*r, "old", 1) for r in rows], "page_id long, url string, html string, text string, hashes int")
    out = pages.extract(df)
    assert out.columns == ["page_id", "url", "html", "hashes", "text", "n_chars"] and out.count() == len(rows)
    by = {r["page_id"]: r["text"] for r in out.collect()}
    assert all(by[i] == f"Article {i} body" for i in range(8))
    assert all(by[100 + i] == "Same article" for i in range(9))
    assert (by[200], by[201], by[202], by[203]) == ("no site", "", "Follow us today", "")
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert pages.extract(df.limit(0)).count() == 0


def keep_lines(docs):
    """The contract of line dedup, plainly."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip("\t\n\x0b\x0c\r "))
    holders = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in docs:
        parts = (text or "").split("\n")
        kept = [p for p in parts if len(holders.get(key(p), ())) < 3 or max(holders[key(p)], key=lambda d: (d is not None, d)) == doc]
        out.append((doc, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_lines_match_the_plain_rule(spark, parts):
    rng = random.Random(parts)
    pool = [f"Shared line number {k:04d} of the pool" for k in range(12)] + ["  Shared LINE number 0001 of the pool\t", "short", "", "É" * 20, "é" * 20]
    docs = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for k in range(120)]
    docs += [(200 + k, "One very common line in a third of all\nown line of document %d here" % k) for k in range(90)]
    docs += [(500, None), (501, ""), (None, "One very common line in a third of all"), (502, "\n\n"), (503, "One very common line in a third of all\n" * 70)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, kept int, words int")
    words = lines.drop_words(df, parts=parts)
    assert words.columns == ["id", "print", "n_dropped", "words"]
    before = lines.drop_words
    lines.drop_words = lambda *a, **b: before(*a, **b, parts=parts)
    try:
        got = lines.dedup(df)
        rows = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"] or "") for r in got.collect()), key=str)
    finally:
        lines.drop_words = before
    assert got.columns == ["doc_id", "text", "words", "n_lines", "n_dropped", "kept"]
    assert rows == keep_lines(docs)


def test_lines_of_repeated_rows_and_no_rows(spark):
    text = "a line that stands in one document\nanother line of that document"
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (3, text)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_dropped"]) for r in lines.dedup(df).collect()) == [(1, 2), (1, 2), (2, 2), (3, 0)]
    assert lines.dedup(df.limit(0)).count() == 0


def hit_places(text, items):
    """Hit words and items of a text, plainly."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, names = cut(text), set(), set()
    for name, item in items:
        w = cut(item)
        n = min(13, len(w))
        runs = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i:i + n]) in runs:
                hit |= set(range(i, i + n))
                names.add(str(name))
    return len(words), len(hit), sorted(names)


def test_decontamination_matches_the_plain_rule(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(9)] + ["É", "é", "x1"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 12, 13, 14, 30, 30, 40])]
    items += [(20, None), (21, "..."), (22, items[9][1].upper()), (9, items[9][1])]
    docs = []
    for k in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if k % 3:
            source = (items[rng.randrange(14)][1]).split()
            at = rng.randint(0, len(words))
            words[at:at] = source[rng.randint(0, len(source) - 1):][: rng.randint(1, 20)]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(words)))
    docs += [(None, items[12][1]), (900, None), (901, ""), (902, "?!"), (903, "plain " * 3000 + items[13][1]), docs[1]]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.judge(df, bench)
    assert got.columns == ["doc_id", "text", "n_words", "n_hit", "n_items", "items", "spans", "contaminated"]
    rows = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got.collect()), key=str)
    want = []
    for doc, text in docs:
        n, hit, names = hit_places(text, items)
        want.append((doc, n, hit, names, hit > 0 and 20 * hit >= n))
    assert rows == sorted(want, key=str)
    clean = decontamination.clean(df, bench)
    assert sorted((str(r["doc_id"]) for r in clean.collect())) == sorted(str(w[0]) for w in want if not w[4])
    small = decontamination.BROADCAST_WINDOWS
    decontamination.BROADCAST_WINDOWS = -1  # the way without a broadcast
    try:
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontamination.judge(df, bench).collect()), key=str) == rows
    finally:
        decontamination.BROADCAST_WINDOWS = small


def test_decontamination_without_items_or_documents(spark):
    df = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in decontamination.judge(df, none).collect()] == [0, 0]
    assert decontamination.clean(df, none).count() == 2
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontamination.judge(df.limit(0), bench).count() == 0
    assert hashlib.sha256(b"1").hexdigest() in {hashlib.sha256(",".join(r["items"]).encode()).hexdigest() for r in decontamination.judge(df, bench).collect()}
