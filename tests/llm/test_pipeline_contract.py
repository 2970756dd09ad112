"""The pipeline against a brute-force version, with near copies by five words and a similarity of 0.8."""

import hashlib
import random
import re
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tendon.llm import bpe, mixing, quality_rules  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def test_run(spark, docs_of, prose, tmp_path):
    rng = random.Random(12)
    texts = [prose(rng.randint(70, 250), i) for i in range(60)]
    texts += texts[:8] + [t.replace("the", "thee", 1) for t in texts[8:20]] + ["short", None, "", "w### " * 80, "same words again " * 60, texts[0]]
    ids = [*range(len(texts) - 1), 0]  # the last row repeats the first
    docs = docs_of(texts, ids, [f"s{i % 3}" if i % 7 else None for i in ids])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    mask = quality_rules.policy_mask()
    good = {r["doc_id"] for r in quality_rules.ledger(docs).collect() if not r["rule_bits"] & mask}
    best = {}
    for i, t in zip(ids, texts):
        if i in good:
            best[t] = max(best.get(t, -1), i)
    kept = {i: t for t, i in best.items()}
    sets = {i: sets_of(t) for i, t in kept.items()}
    least = {i: i for i in kept}
    links = [(i, j) for i in kept for j in kept if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in kept:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert 3 < len(kept) - len(set(least.values()))
    left = docs.where("doc_id in (" + ",".join(map(str, set(least.values()))) + ")").dropDuplicates(["doc_id"])
    encoding = bpe.encoding(bpe.RANKS)
    want = Counter()
    for r in mixing.mixed(left).collect():
        ids_of = encoding.encode_ordinary(r["text"])
        want[r["doc_id"], len(ids_of), b"".join(x.to_bytes(4, "little") for x in ids_of), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in pipeline.run(spark, str(tmp_path)).collect())
    assert got == want


def test_run_on_nothing(spark, docs_of, tmp_path):
    docs_of([None, "", "few words"], [None, 1, 1]).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
