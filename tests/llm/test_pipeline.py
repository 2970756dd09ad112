"""The pipeline against a brute-force version of each stage, on its predecessor's rows."""

import hashlib
import random
import re
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tendon.llm import bpe, mixing, quality_rules  # noqa: E402
from tendon.llm.shared import saved  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text):
    words = text.lower().split()
    return {tuple(words[i : i + pipeline.SHINGLE]) for i in range(max(1, len(words) - pipeline.SHINGLE + 1))}


def test_stages(spark, docs_of, prose):
    rng = random.Random(11)
    texts = [prose(rng.randint(60, 250), i) for i in range(90)]
    texts += texts[:10] + [t.replace("the", "thee", 1) for t in texts[10:20]] + ["short", None, "w### " * 80] + ["same words again " * 60]
    docs = docs_of(texts, sources=[f"s{i % 3}" for i in range(len(texts))])
    kept = [docs]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], "")
        assert out.columns == docs.columns, name
        kept.append(saved(out, "test-stage"))
    rows = [[r.asDict() for r in k.collect()] for k in kept]
    mask = quality_rules.policy_mask()
    good = {r["doc_id"] for r in quality_rules.ledger(docs).collect() if not r["rule_bits"] & mask}
    assert {r["doc_id"] for r in rows[1]} == good and len(good) < len(texts)
    best = {}
    for r in rows[1]:
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in rows[2]} == set(best.values())
    sets = {r["doc_id"]: sets_of(r["text"]) for r in rows[2]}
    group = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= pipeline.SIMILARITY * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    assert {r["doc_id"] for r in rows[3]} == set(group.values())
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(kept[3]).collect() if r["taken"]}
    words = Counter()
    for r in rows[4]:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert dict(words) == taken
    encoding = bpe.encoding(bpe.RANKS)
    got = Counter((r["doc_id"], bytes(r["ids"]), r["decoded_sha256"]) for r in pipeline.STAGES[-1][1](spark, kept[4], "").collect())
    want = Counter((r["doc_id"], b"".join(i.to_bytes(4, "little") for i in encoding.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows[4])
    assert got == want


def test_empty(spark, docs_of):
    out = docs_of([])
    for _, stage in pipeline.STAGES:
        out = saved(stage(spark, out, ""), "test-empty")
    assert out.collect() == []
