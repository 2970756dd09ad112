import random
import re
from collections import Counter

import numpy as np
import pytest

from tendon.llm import factorisation_machine as fm
from tendon.llm import html_text, mixing, quality_rules
from tendon.llm.words import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_rule_measures_match_brute_force(spark, docs_of, prose):
    rng = random.Random(6)
    texts = [None, "", " ", "a b c a b c", "x\nx\n \nx y\nx y ", "é 日本 \x1c \x85 #|", "w " * 5000, prose(20_000, 3)]
    texts += ["".join(rng.choice("ab# \n\té!A") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    rows = quality_rules.ledger(docs_of(texts)).collect()
    got = {r["doc_id"]: tuple(r[m] for m in quality_rules.MEASURES[:5]) for r in rows}
    assert got == {i: brute_measures(t) for i, t in enumerate(texts)}
    assert quality_rules.ledger(docs_of([])).collect() == []
    kept = quality_rules.accepted(docs_of(texts))
    assert kept.columns == docs_of([]).columns
    mask = quality_rules.policy_mask()
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if not r["rule_bits"] & mask}
    parts = {r["rule"]: r for r in quality_rules.ablations(quality_rules.ledger(docs_of(texts)), mask).collect()}
    for i, (name, _) in enumerate(quality_rules.rules()):
        if mask >> i & 1:
            bits = [r["rule_bits"] & mask for r in rows]
            want = (sum(b >> i & 1 for b in bits), sum(b == 1 << i for b in bits), sum(not b & ~(1 << i) for b in bits))
            assert (parts[name]["n_failed"], parts[name]["n_only"], parts[name]["n_kept_without"]) == want


def water(sizes, weights, passes=3):
    full, total = set(), sum(sizes)
    while True:
        level = (total - sum(passes * sizes[i] for i in full)) / (sum(w for i, w in enumerate(weights) if i not in full) or 1)
        more = {i for i in range(len(sizes)) if i not in full and passes * sizes[i] < level * weights[i]}
        if not more:
            return [passes * s if i in full else level * weights[i] for i, s in enumerate(sizes)]
        full |= more


def test_mix_targets_and_takes(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 3_000)
    rng = random.Random(8)
    names = ["a", "B", "", None, "z", "é"]
    texts, sources = [], []
    for k, (name, n) in enumerate(zip(names, (4, 60, 40, 90, 1, 10))):
        for i in range(n):
            texts.append(prose(rng.randint(0, 400), 1000 * k + i))
            sources.append(name)
    texts += [None, "", texts[0], texts[0]]
    sources += ["a", None, "a", "a"]
    docs = docs_of(texts, sources=sources)
    rows = {r["doc_id"]: r for r in mixing.taken(docs).collect()}
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    order = sorted((s for s in set(sources) if s is not None)) + [None]
    sums = [sum(size[i] for i, s in enumerate(sources) if s == name) for name in order]
    want = dict(zip(order, water(sums, [(5, 2, 1)[i % 3] for i in range(len(order))])))
    for i, s in enumerate(sources):
        assert rows[i]["size"] == size[i] and rows[i]["source_size"] == sums[order.index(s)]
        assert rows[i]["target"] == pytest.approx(want[s]) and 0 <= rows[i]["taken"] <= 3 * size[i]
    for name in order:
        got = sum(rows[i]["taken"] for i, s in enumerate(sources) if s == name)
        assert abs(got - want[name]) <= 2 * mixing.BLOCK * (1 + sums[order.index(name)] // 3_000)
    again = {r["doc_id"]: r["taken"] for r in mixing.taken(docs.repartition(3)).collect()}
    assert again == {i: r["taken"] for i, r in rows.items()}
    assert mixing.taken(docs_of([])).collect() == []
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    taken = {i: r["taken"] for i, r in rows.items() if r["taken"]}
    copies = {i for i, t in enumerate(texts) if texts.count(t) > 1}
    assert {i: n for i, n in words.items() if i not in copies} == {i: n for i, n in taken.items() if i not in copies}


def test_quotas_are_sainte_lague(spark):
    rng = random.Random(2)
    rows = []
    for g in range(12):
        n, seats = rng.randint(1, 9), rng.choice([0, 1, 3, 17, 200])
        rows += [(f"g{g}", k, rng.choice([0, 1, 50, rng.randint(1, 10_000)]), seats) for k in range(n)]
    got = mixing.quotas(spark.createDataFrame(rows, "g string, shard long, votes long, seats long"), "seats", "votes", ["g"]).collect()
    have = {(r["g"], r["shard"]): r["quota"] for r in got}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        want = dict.fromkeys((r[1] for r in own), 0)
        for _ in range(own[0][3] if any(r[2] for r in own) else 0):
            top = max((r for r in own if r[2]), key=lambda r: (r[2] / (2 * want[r[1]] + 1), -r[1]))
            want[top[1]] += 1
        assert {s: have[g, s] for s in want} == want, (g, own)


PAGES = [
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>T&amp;x</h1><p>One  two\n three<p><b>Bold<br><p>Last &eacute; &#233; &lt;p&gt;</article><footer>F</footer>", "T&x\nOne two three\nBold\nLast é é <p>"),
    ("<body><div class='ad'>Buy</div><main><h2>A</h2><ul><li>x<li>y</ul><form><input><label>Name</label></form><div id=comments><p>First!</p></div><script>var a='</p>'</script></main>", "A\nx\ny"),
    ("<!-- c --><article>only <i>inline</i> text<!-- gone --></article><aside>side</aside>", "only inline text"),
    ("", ""), (None, ""), ("<nav>menu</nav>", ""), ("<article>cut &am", "cut &am"), ("<article><p>a<div hidden>b</div><p>c <di", "a\nc"),
]


def test_pages_by_hand(spark):
    rows = [(i, f"https://h{i}.example/x", h) for i, (h, _) in enumerate(PAGES)] + [(99, None, "<article>no host</article>")]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: t for i, (_, t) in enumerate(PAGES)}, 99: "no host"}


def test_template_nodes_go_where_no_article_is_marked(spark):
    page = lambda i: f"<body><div class=top>Our site</div><div class=text><p>Story {i} begins.</p><p>And {i * 7} ends.</p></div><div class=low>All rights</div></body>"
    rows = [(i, "https://one.example/a", page(i)) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} begins.\nAnd {i * 7} ends." for i in range(30)}
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_machine_equals_pairwise_sums_and_learns(spark, docs_of, prose):
    import pyarrow as pa

    f, x, first = fm.features(words_of(pa.array(["one two two", "", "three ONE one"])))
    rng = np.random.default_rng(0)
    line, low = rng.normal(size=fm.WIDTH), rng.normal(size=(fm.WIDTH, fm.RANK))
    got = fm.logits(f, x, first, 0.5, line, low)
    for d in range(3):
        i = range(first[d], first[d + 1])
        pairs = sum(low[f[a]] @ low[f[b]] * x[a] * x[b] for a in i for b in i if a < b)
        assert got[d] == pytest.approx(0.5 + sum(line[f[a]] * x[a] for a in i) + pairs)
    texts = [prose(120, i) if i % 4 else " ".join(w + "###" for w in prose(120, i).split()) for i in range(300)] + [None, ""]
    docs = docs_of(texts)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(3, None), (None, 1)], "doc_id long, label int")
    rows = fm.scored(docs, fm.fitted(docs, labels, ~fm.held_out())).join(docs.select("doc_id", fm.held_out().alias("held")), "doc_id").collect()
    held = [r for r in rows if r["held"] and r["doc_id"] < 300]
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 4 > 0) for r in held) and len(held) > 20
    assert len(rows) == 302 and all(0 <= r["score"] <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, label int")
    assert len(fm.scored(docs, fm.fitted(docs, none, ~fm.held_out())).collect()) == 302


#: Two words of 1,024 letters that a polynomial hash modulo a power of two can't tell apart.
THUE = "".join("ab"[i.bit_count() % 2] for i in range(1024))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


def test_words_that_a_polynomial_confuses_stay_apart(spark, docs_of, monkeypatch):
    import pyarrow as pa

    from tendon.llm import kneser_ney

    texts = [f"x {THUE} y z x {MORSE} y", f"{THUE} {THUE}", "a" * 700 + " " + "a" * 701]
    rows = {r["doc_id"]: r for r in quality_rules.ledger(docs_of(texts)).collect()}
    assert [rows[i]["n_repeat_words"] for i in range(3)] == [brute_measures(t)[4] for t in texts] == [0, 0, 0]
    w = words_of(pa.array(texts))
    assert len(set(w.hashes().tolist())) == 7 and len(set(w.codes().tolist())) == 7
    number, _, first = fm.features(words_of(pa.array([THUE, MORSE])))
    assert set(number[: first[1]].tolist()) != set(number[first[1] :].tolist())
    from pyspark.sql import functions as F

    scores = kneser_ney.held_out_scores(docs_of([f"{THUE} b", f"{MORSE} c"], [None, None]), F.lit(False)).collect()
    assert [r["n_known"] for r in scores] == [3, 3]
    # whatever the hashes, words with other bytes have other numbers
    monkeypatch.setattr(type(w), "hashes", lambda self, table=None: np.array([len(self.starts) % 2] * len(self.starts), np.uint64))
    odd = words_of(pa.array(["a b a ab B", "b ba", "é e é"]))
    names = [odd.data[s:e].tobytes() for s, e in zip(odd.starts, odd.ends)]
    codes = odd.codes().tolist()
    assert len(set(zip(names, codes))) == len(set(names)) == len(set(codes))


def test_rows_that_repeat_take_their_own_runs(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 700)
    texts = [prose(150, i % 3) for i in range(30)] + [None] * 40 + [""] * 40 + [prose(90, 9)] * 4
    ids = [i % 5 for i in range(30)] + [None] * 80 + [None, None, 7, 7]
    docs = docs_of(texts, ids, [["a", "b", None][i % 3] for i in range(len(texts))])
    one = Counter(tuple(r) for r in mixing.taken(docs).collect())
    assert one == Counter(tuple(r) for r in mixing.taken(docs.repartition(5)).collect()) and sum(one.values()) == len(texts)
    assert all(r[4] <= 3 * r[1] for r in one)
    want = Counter()
    for r, n in one.items():
        want[r[0], r[8] if r[9] else None] += r[4] * n
    for _ in range(2):
        got = Counter()
        for r in mixing.mixed(docs.repartition(3)).collect():
            got[r["doc_id"], r["source"]] += len(WORD.findall(r["text"]))
        assert got == +want


def test_sources_take_blocks_by_highest_quotients(spark):
    rng = random.Random(4)
    for n, seats in ((1, 7), (5, 0), (40, 333), (40, 3)):
        votes = {i: rng.choice([0.0, 1.5, rng.uniform(0, 900)]) for i in range(n)}
        votes[0] = 10.0
        rows = spark.createDataFrame(list(votes.items()), "name long, votes double")
        got = {r["name"]: r["quota"] for r in mixing.seated(rows, seats, "votes", "name").collect()}
        want = dict.fromkeys(votes, 0)
        for _ in range(seats):
            want[max((i for i in votes if votes[i]), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert got == want, (n, seats)


def test_many_sources_are_numbered_and_levelled(spark):
    rng = random.Random(5)
    names = sorted({rng.choice("aBzé_") + str(rng.randint(0, 9_999)) for _ in range(300)}) + [None]
    sizes = [rng.choice([0, 1, rng.randint(0, 10_000), 10**6]) for _ in names]
    rows = spark.createDataFrame([(n or "", n is not None, s) for n, s in zip(names, sizes)], "source string, has_source boolean, source_size long").repartition(7)
    got = {r["source"] if r["has_source"] else None: r["target"] for r in mixing.targets(rows).collect()}
    want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert all(got[n] == pytest.approx(x) for n, x in zip(names, want)) and len(got) == len(names)


def test_template_texts_go_inside_the_article_and_copies_stay(spark):
    def page(i, same="Read our other stories for free."):
        body = "".join(f"<p>Paragraph {k} of story {i} says {i * k}.</p>" for k in range(1, 4))
        return f"<html><body><div class=top>Our site</div><article><h1>Story {i}</h1>{body}<p>{same}</p></article><div class=low>All rights</div></body></html>"

    text = lambda i, end="": "\n".join([f"Story {i}", *(f"Paragraph {k} of story {i} says {i * k}." for k in range(1, 4)), *([end] if end else [])])
    rows = [(i, "https://one.example/a", page(i)) for i in range(40)]
    rows += [(100 + i, "https://two.example/a", page(7)) for i in range(9)]  # copies of one page
    rows += [(200, "https://lone.example/", page(3)), (None, None, page(5)), (200, "https://lone.example/", page(3))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", html_text.F.lit("clash"))
    got = [(r["page_id"], r["text"]) for r in html_text.main_texts(frame).collect()]
    assert len(got) == len(rows)
    end = "Read our other stories for free."
    want = {i: text(i) for i in range(40)} | {100 + i: text(7, end) for i in range(9)} | {200: text(3, end), None: text(5, end)}
    assert dict(got) == want
    assert all(html_text.extracted(page(i), None) == text(i, end) for i in range(3))  # without a wrapper the repeat stays


def test_alignment_is_simple_tree_matching():
    rng = random.Random(3)

    def tree(depth):
        names = rng.sample("abcdef", rng.randint(0, 4)) if depth else []
        return html_text.Shape("r" if depth == 3 else "", [], {}), [(n, tree(depth - 1)) for n in names]

    def built(spec, label):
        node = html_text.Shape(label, [], {})
        node.kids = [built(s, n) for n, s in spec[1]]
        return node

    def brute(a, b):
        """The recursion of simple tree matching over all pairs of children."""
        if a.label != b.label:
            return 0
        best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids, 1):
            for j, y in enumerate(b.kids, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + brute(x, y))
        return best[-1][-1] + 1

    for _ in range(300):
        a, b = built(tree(3), "r"), built(tree(3), "r")
        n, pairs = html_text.matched(a, b)
        assert n == brute(a, b) == len(pairs) and all(x.label == y.label for x, y in pairs)


def test_no_page_stops_a_task(spark):
    import time

    deep = 100_000
    pages = ["<div>" * deep + "x", "<b>" * deep + "y", "<" + "a" * 1_000_000, "<a href=\"" * deep, "<!--" * deep, "<li>" * deep + "z",
             "<div>" * deep + "t" + "</span>" * deep + "</div>" * deep, "<p><b>" * deep + "w", "".join(f"<div class=c{i}>t{i}</div>" for i in range(5_000))]
    began = time.time()
    rows = spark.createDataFrame([(i, "https://h.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(rows).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 6, 7)] == ["x", "y", "", "", "", "t", "w"] and got[8].count("\n") == 4_999
    assert time.time() - began < 120


def test_references_and_spaces(spark):
    page = "<article><p>A​B &<b>amp;</b> &#233;&nbsp;x y<!-- c -->z</p><div class=share><p>Market share grew</p></div><div class=share><a href=x>Share this</a></div></article>"
    rows = spark.createDataFrame([(1, "https://h.example/", page)], "page_id long, url string, html string")
    assert html_text.main_texts(rows).first()["text"] == "A​B &amp; é x yz\nMarket share grew"
