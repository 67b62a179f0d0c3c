"""Main text of pages."""

import pytest

from basketry.llm import htmltext

ARTICLE = "<article><h1>Title &amp; more</h1><p><b>First part.<br><p>Second,\n  part &lt;3&gt; here.</p><p>Ok.</p></article>"
TEXT = "Title & more\nFirst part.\nSecond, part <3> here.\nOk."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain text, no markup", "plain text, no markup"),
        (f"<html><head><title>t</title><script>var x='</p>';</script></head><body><nav><ul><li><a>Menu</a></ul></nav>{ARTICLE}<footer>&copy; x</footer>", TEXT),
        (f"<body><div class='cookie-notice'>We use cookies, really.</div><div id=main>{ARTICLE}</div><aside>More, links.</aside></body>", TEXT),
        (f"<body>{ARTICLE}<section id='comments'><p>Nice post, thanks, a lot, really!</p></section></body>", TEXT),
        (f"<body><form><p>Sign up, now.</p><input></form><!-- <p>hidden, text</p> -->{ARTICLE}", TEXT),
        ("<div class='side-bar sidebar'><p>a, b</p></div><div class=post><p>Real text, of some length, here.<p>Yes.<ul><li>one<li>two</ul></div>", "Real text, of some length, here.\nYes.\none\ntwo"),
        ("<p>cut off, in the mid", "cut off, in the mid"),
        ("<p>a &am b &unknown; &#65; &#x42;</p>", "a &am b &unknown; A B"),
        ("<nav>only, a menu</nav><footer>and, more</footer>", ""),
    ],
)
def test_pages(page, text):
    assert htmltext.main_text(page) == text


def test_rows_are_kept(spark):
    rows = [(1, "u", None, "x"), (2, "u", f"<body>{ARTICLE}", "y"), (2, "u", f"<body>{ARTICLE}", "y"), (3, None, "<p>" + "word, " * 50000, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, main_text string")
    got = htmltext.extract_main_text(pages).collect()
    assert sorted((r["page_id"], len(r["main_text"])) for r in got) == [(1, 0), (2, len(TEXT)), (2, len(TEXT)), (3, 299999)]
    assert htmltext.extract_main_text(pages.limit(0)).count() == 0


LONG = "".join(f"<p>Sentence number {i}, with some words, and an end.</p>" for i in range(40))


def test_title_and_lead_beside_a_long_section_stay():
    got = htmltext.main_text(f"<body><div><h1>Title</h1><p>The lead, in short.</p><section>{LONG}</section></div></body>")
    assert got.startswith("Title\nThe lead, in short.\nSentence number 0,") and got.count("\n") == 41


@pytest.mark.parametrize("name", ["overflow-hidden", "has-sidebar", "post-header"])
def test_a_class_word_does_not_drop_the_page(name):
    page = f"<body><div class='{name}'><div class='ad'>Buy, now!</div>{LONG}</div></body>"
    got = htmltext.main_text(page)
    assert got.count("\n") == 39 and "Buy" not in got


NEUTRAL = [
    # class words and the article element taken away, in several ways
    lambda p: p.replace('class="ad"', 'class="x1"'),
    lambda p: p.replace('class="ad"', 'class="x1"').replace("<article>", "<div>").replace("</article>", "</div>"),
    lambda p: p.replace(' class="ad"', "").replace("<article>", "").replace("</article>", ""),
    lambda p: p.replace('<div class="ad">', '<div class="x1"><p>').replace("<nav>", '<div class="x2">').replace("</nav>", "</div>")
    .replace("<article>", '<section class="x3">').replace("</article>", "</section>"),
]


@pytest.mark.parametrize("neutral", range(len(NEUTRAL)))
def test_the_threshold_finds_the_article_without_telling_names(spark, neutral, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    want = [htmltext.main_text(p) for p in pages]
    changed = [NEUTRAL[neutral](p or "") for p in pages]
    assert sum(htmltext.main_text(p) == w for p, w in zip(changed, want, strict=True)) >= 0.9 * len(pages)
    # with the threshold off, the adverts get in
    monkeypatch.setattr(htmltext, "content_paths", lambda tree: set(tree.path))
    assert sum(htmltext.main_text(p) == w for p, w in zip(changed, want, strict=True)) <= 0.1 * len(pages)


def test_given_pages_are_as_their_article(spark):
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = re.search("<article>(.*?)(</article>|$)", r["html"] or "", re.S)
        assert htmltext.main_text(r["html"]) == htmltext.main_text(f"<article>{body[1]}</article>" if body else "")


def test_what_stays_by_its_place():
    # a titled element around the content, a title alone before it, a list that isn't a menu
    page = f"<body><div class=a><h1>Title</h1></div><div class=b>Buy now</div><div class=c>{LONG}<ul><li>one<li>two</ul><ul><li><a href=x>More</a></ul></div>"
    assert htmltext.main_text(page).split("\n")[-2:] == ["one", "two"]
    assert htmltext.main_text(page).startswith("Sentence") and "Buy" not in htmltext.main_text(page)
    page = f"<body><div class=b>Buy now</div><div class=a><h1>Title</h1></div><div class=c>{LONG}</div>"
    assert htmltext.main_text(page).startswith("Title\nSentence")
    page = f"<body><div class=b>Buy now</div><article><div class=d>Short</div><div class=c>{LONG}</div><ul><li><a href=x>Source</a></ul></article>"
    got = htmltext.main_text(page)
    assert got.startswith("Short\n") and got.endswith("\nSource") and "Buy" not in got


@pytest.mark.parametrize(
    "page,text",
    [
        ("<a title=\"x>y<p>One, two.</p>", "y\nOne, two."),  # a quote without an end
        ("<p title='a>b'>One, two.</p>", "One, two."),
        ("<p>1 < 2, and 3 > 2.</p>", "1 < 2, and 3 > 2."),
        ("<a href=it's>One, two.</a> <b class=x'y>Three.</b>", "One, two. Three."),
        ("<p>One, two.<!-- three", "One, two."),
        ("<table><tr><td>One, two.<td>Three, four.<tr><td>Five, six.</table>", "One, two.\nThree, four.\nFive, six."),
    ],
)
def test_broken_markup(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize(
    "unit,tail,text",
    [("<a ", '"', ""), ("<div>", "x, y", "x, y"), ("<li><span>", "x, y", "x, y"), ("<p><b x='>", "", ""), ('<a title="x>', "x", None),
     ("<", "", None), ("<td>", "x, y", "x, y"), ("<script>", "x", "")],
)
def test_parsing_takes_linear_time(unit, tail, text):
    import time

    def seconds(n):
        start = time.perf_counter()
        got = htmltext.main_text(unit * n + tail)
        assert text is None or got == text
        return time.perf_counter() - start

    seconds(10)
    assert seconds(80_000) < 20 * seconds(10_000) + 1
