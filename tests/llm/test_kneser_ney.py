import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tendon.llm import kneser_ney
from tendon.llm.words import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, train):
    """Scores by the textbook formulas over dictionaries."""
    pairs, words = Counter(), Counter()
    for t in train:
        tokens = [*words_of(t), "</s>"]
        words.update(tokens)
        pairs.update(zip(["<s>", *tokens], tokens))
    n, v = sum(words.values()), len(words)
    before = Counter(w for _, w in pairs)
    begins = {}
    for (u, _), c in pairs.items():
        begins.setdefault(u, []).append(c)
    d = kneser_ney.discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    e = kneser_ney.discounts([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)])
    total = len(pairs)
    back = sum(e[min(c, 3) - 1] for c in before.values()) / total if total else 1.0

    def low(w):
        c = before[w]
        return (max(c - e[min(c, 3) - 1], 0) / total if c else 0) + back / (v + 1)

    def p(u, w):
        if u not in begins:
            return low(w)
        s, c = sum(begins[u]), pairs[u, w]
        gamma = sum(d[min(x, 3) - 1] for x in begins[u]) / s
        return (max(c - d[min(c, 3) - 1], 0) / s if c else 0) + gamma * low(w)

    out = []
    for t in texts:
        tokens = [*words_of(t), "</s>"]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        score = sum(math.log10(p(u, w)) for u, w in zip(["<s>", *tokens], tokens))
        out.append((len(tokens), sum(words[w] > 0 for w in tokens), n, base, score))
    return out, p, words


def run(spark, docs):
    from tendon.llm.shared import id_crc

    return {r["doc_id"]: r for r in kneser_ney.held_out_scores(docs, id_crc() % 10 == 0).collect()}


def test_scores_match_brute_force(spark, docs_of, prose):
    texts = [prose(n, i) for i, n in enumerate([0, 1, 2, 5, 40, 300, 3000] * 6)]
    texts += [None, "", "  \n\t ", "unheard-of wörds Only here", "THE Of"] + [texts[5]] * 3
    got = run(spark, docs_of(texts))
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    assert any(held)
    want, _, _ = brute(texts, [t for t, h in zip(texts, held) if not h])
    for i, (n, known, train, base, score) in enumerate(want):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-9)


def test_probabilities_add_up(prose):
    _, p, words = brute([], [prose(500, i) for i in range(5)])
    for u in ("<s>", "the", "never seen"):
        assert sum(p(u, w) for w in words) + p(u, "unknown word") == pytest.approx(1)


def test_empty_table_and_nulls(spark, docs_of):
    assert run(spark, docs_of([])) == {}
    got = kneser_ney.held_out_scores(docs_of(["a b", None, "a b"], [None, None, None]), kneser_ney.F.lit(True)).collect()
    assert [r["n_tokens"] for r in got] == [3, 1, 3] and all(r["train_tokens"] == 0 and r["score"] == 0 for r in got)


def test_unmix():
    x = np.random.default_rng(1).integers(0, 2**64 - 1, 1000, dtype=np.uint64)
    assert (kneser_ney.unmix(mix(x)) == x).all()
