"""One text or page of a megabyte must not stall its task: every generator and every tag class on runs that invite second looks."""

import time

import pytest
from pyspark.sql import functions as F

from tendon.llm import html_text, pii

LONG = 1_000_000
RUNS = ["1.2 " + "7" * LONG, "1." * (LONG // 2), "+1" + " " * LONG, "+" * LONG, "+1(" * (LONG // 3), "a@" * (LONG // 2), "a" * LONG + "@", "a@b" + ".c" * (LONG // 2) + ".", "4 " * (LONG // 2), "4-" * (LONG // 2), "a [at] " * (LONG // 7), "a at b dot " * (LONG // 11)]


@pytest.mark.parametrize("name", list(pii.GENERATORS))
def test_generators_take_time_in_proportion(spark, name):
    _, _, _, pattern = pii.GENERATORS[name]
    rows = spark.createDataFrame([(t,) for t in RUNS], "text string").repartition(1)
    found = rows.select(F.sum(F.regexp_count("text", F.lit(pattern))).alias("n"))
    began = time.time()
    found.collect()
    assert time.time() - began < 5 * len(RUNS)


PAGES = [
    '<div class="share">' * 50_000 + "x" + "</div>" * 50_000, "<script>" + "</script " * 110_000, "<style>" + "</style" * 140_000, "<!--" * 250_000, "<" * LONG, "</" * (LONG // 2), "<a " + "b=" * 480_000, '<p title="' + "x" * LONG,
    "<ul>" + "<li>x" * 200_000, "<table>" + "<tr><td>x" * 100_000, "<b>" * 300_000 + "y", "<article>" + "<p>word</p>" * 90_000 + "</article>", "&amp" * 200_000 + "&#x" * 60_000,
]


@pytest.mark.parametrize("i", range(len(PAGES)))
def test_pages_take_time_in_proportion(i):
    began = time.time()
    root = html_text.parse(PAGES[i])
    for node in [root, *(k for k in root.kids if not isinstance(k, str))]:
        html_text.words_in(node)
        html_text.excluded(node, False)
    assert time.time() - began < 8


def test_counts_of_words_and_links():
    root = html_text.parse('<div>one <a href="/">two<b>three</b></a><p>four</p></div>')
    assert html_text.words_in(root) == (len("one") + len("two") + len("three") + len("four"), len("two") + len("three"))
    assert html_text.words_in(root) == html_text.words_in(html_text.parse('<div>one <a href="/">two<b>three</b></a><p>four</p></div>'))


def test_scripts_end_where_their_tag_does():
    page = "<script>a</scripty>b</SCRIPT >c"
    at = page.index(">") + 1
    assert page[html_text.raw_end(page, at, "script") :] == "c"
    assert html_text.raw_end("<script>a</script", 8, "script") == len("<script>a</script")


def test_words_of_a_sentence_stay_whatever_their_name(spark):
    html = [
        '<article><p>The review of the <span class="banner">Star Spangled</span> song</p></article>', '<article><p>kept</p><p><span class="ad">Buy now</span></p></article>',
        '<article><p>See <em class="notice">this</em> and <a class="menu" href="/">that</a>.</p><div class="ad">Buy <b>now</b></div></article>',
    ]
    pages = spark.createDataFrame([(i, f"https://h{i}.example/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(pages).collect()}
    assert got == {0: "The review of the Star Spangled song", 1: "kept", 2: "See this and that."}
