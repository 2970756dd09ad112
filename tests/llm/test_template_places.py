"""Extraction by what pages repeat, without the names of elements."""

import json
import os

from tendon.llm import html_text

SF = os.path.join(os.environ.get("TENDON_TESTDATA", "/root/testdata"), "sf0.01")
SCHEMA = "page_id long, url string, html string"


def lone(i):
    """A page of a host of its own: a banner out of five, a story, a closing line out of four."""
    story = "".join(f"<p>Story {i} tells in part {k} of {i * k} things.</p>" for k in range(3))
    return (
        f"<body><div class=x1>Banner {i % 5} of our partners and of all their friends in town</div><h2>Summary</h2>{story}<p>In short</p><p>The end of {i}.</p>"
        f"<div class=x3>Line {i % 4} at the bottom</div></body>"
    )


def want(i):
    return "\n".join(["Summary", *(f"Story {i} tells in part {k} of {i * k} things." for k in range(3)), "In short", f"The end of {i}."])


def test_places_that_all_hosts_repeat_are_cut_off(spark):
    """No host has two pages, and no name tells: only the counts over all pages do."""
    rows = [(i, f"https://h{i}.example/", lone(i)) for i in range(120)]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(pages).collect()}
    assert got == {i: want(i) for i in range(120)}
    assert all("Banner" in html_text.extracted(lone(i), None) for i in range(5))  # the page alone keeps it
    few = spark.createDataFrame(rows[:8], SCHEMA)
    assert all("Banner" in r["text"] for r in html_text.main_texts(few).collect())  # too few to tell


def test_template_places_by_brute_force(spark):
    pages = [lone(i) for i in range(60)] + [None, ""]
    seen = {}
    for page in pages:
        for place, text in {(p, html_text._own_text(n)[0]) for n, p in html_text.placed(html_text.parse(page or ""))}:
            if text:
                seen.setdefault(place, []).append(text)
    mass = {p: sum(map(len, t)) for p, t in seen.items()}
    single = {p: sum(len(x) for x in t if t.count(x) < html_text.REPEATED) for p, t in seen.items()}
    assert sum(single.values()) >= html_text.ALL_APART * sum(mass.values())
    brute = {p for p, t in seen.items() if len(t) >= html_text.PLACE_SEEN and single[p] <= (1 - html_text.PLACE_SHARE) * mass[p]}
    frame = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], SCHEMA).repartition(5)
    assert {r["place"] for r in html_text.template_places(frame).collect()} == brute and len(brute) == 3


def test_copies_of_whole_pages_are_no_template(spark):
    copies = spark.createDataFrame([(i, f"https://h{i}.example/", lone(7)) for i in range(60)], SCHEMA)
    assert html_text.template_places(copies).count() == 0
    assert all(want(7) in r["text"] for r in html_text.main_texts(copies).collect())
    assert html_text.template_places(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_method_alone_gives_what_it_gives_with_names(spark):
    """On the given pages menus, adverts and footers go without any name of an element or class."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    by_names, alone = html_text.main_texts(pages), html_text.main_texts(pages, names=False)
    n = by_names.count()
    assert by_names.exceptAll(alone).count() <= n // 50


def test_wrappers_are_counted_over_all_pages_of_a_host(spark):
    """A line on 22 pages of 40 is no template, one on 30 is; copies of a page count once, and ids of single pages are no nodes."""
    page = lambda i: f"<body><div id=a>{'Half of the pages say so' if i < 22 else f'Said by {i}'}</div><div id=b>{'Most of the pages say so' if i >= 10 else f'Told by {i}'}</div><div id=post-{i}><p>Story {i} and nothing else.</p></div></body>"
    rows = [(i, "https://one.example/x", page(i)) for i in range(40)] + [(100 + i, "https://one.example/y", page(39)) for i in range(30)]
    rows += [(200 + i, "https://many.example/", page(40 + i)) for i in range(200)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(5)
    made = {r["host"]: (r["n"], html_text.Shape.unpacked(json.loads(r["wrapper"]))) for r in html_text.wrappers(pages, html_text.seen_rows(pages)).collect()}
    n, top = made["one.example"]
    body = top.kids[0]
    have = {k.label: k for k in body.kids}
    assert (n, top.seen, body.seen) == (70, 40, 40)
    assert have["div.a"].template() == set() and have["div.b"].template() == {html_text.text_hash("Most of the pages say so")}
    many = made["many.example"][1].kids[0]
    assert (many.seen, [k.label for k in many.kids]) == (200, ["div.a", "div.b"])
    stories = sum(len(f"Story {40 + i} and nothing else.") for i in range(200))
    assert sum(n * size for n, size in many.texts.values()) == stories
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(pages, names=False).collect()}
    assert len(got) == 270 and all(f"Story {i} and nothing else." in got[i] for i in range(39)) and all("Half of the pages say so" in got[i] for i in range(22))
