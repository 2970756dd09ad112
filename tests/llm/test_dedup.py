import hashlib
import random

import numpy as np
import pytest

from tendon.llm import exact_dedup, simhash


def test_exact_groups(spark, docs_of, prose):
    texts = ["a", "a", None, "", "b ", "b", "é", prose(50, 1), prose(50, 1), "a"] + ["hot"] * 300
    ids = [5, 9, 3, 4, 7, 8, None, 1, 2, 9] + list(range(100, 400))
    rows = exact_dedup.groups(docs_of(texts, ids)).collect()
    assert len(rows) == len(texts)
    by = {}
    for i, t in zip(ids, texts):
        by.setdefault(t or "", []).append(i)
    want = sorted((i if i is not None else -1, max((x for x in by[t or ""] if x is not None), default=-1), len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in zip(ids, texts))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["keep_id"] is None else r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows)
    assert got == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in rows)
    kept = exact_dedup.deduplicated(docs_of(texts, ids))
    assert kept.columns == docs_of([]).columns
    assert sorted((r["text"] or "") for r in kept.collect()) == sorted(by)
    assert exact_dedup.groups(docs_of([])).collect() == [] and exact_dedup.deduplicated(docs_of([])).collect() == []
    small = {r["doc_id"]: r["keep_id"] for r in exact_dedup.groups(docs_of(["x", "x"], [1, 2]), keep="min").collect()}
    assert small == {1: 1, 2: 1}


def test_large_groups_go_by_the_shuffled_path(spark, docs_of, monkeypatch):
    from tendon.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared, "HOT_PARTS", 4)
    texts = ["hot"] * 60 + ["warm"] * 5 + [f"t{i}" for i in range(40)]
    rows = exact_dedup.groups(docs_of(texts)).collect()
    assert sorted(r["group_size"] for r in rows) == sorted([60] * 60 + [5] * 5 + [1] * 40)
    assert sum(r["kept"] for r in rows) == 42


def brute_components(ids, prints, radius):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= radius) + i + 1:
            parent[find(int(j))] = find(i)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_components(spark, docs_of, prose):
    rng = random.Random(4)
    texts = [prose(rng.randint(0, 120), i) for i in range(150)]
    for i in range(120):
        words = texts[rng.randrange(100)].split()
        if words:
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", " \n", "one", "ONE", "two words", texts[3], texts[3]]
    rows = simhash.components(docs_of(texts)).collect()
    prints = {r["doc_id"]: np.uint64(r["fp"] % 2**64) for r in rows}
    assert all(int(prints[i]) == simhash.fingerprint((t or "").encode()) for i, t in enumerate(texts))
    ids = list(range(len(texts)))
    want = brute_components(ids, np.array([prints[i] for i in ids], np.uint64), simhash.RADIUS)
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(zip(ids, want))
    kept = simhash.one_of_each(docs_of(texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want))
    assert simhash.components(docs_of([])).collect() == [] and simhash.one_of_each(docs_of([])).collect() == []


@pytest.mark.parametrize("block", [4096, 3])
def test_links_connect_dense_and_planted_prints(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**64 - 1, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base for n in (1, 2, 3, 4)]
    dense = [base[0] ^ np.uint64(sum(1 << int(k) for k in rng.choice(12, n, replace=False))) for n in (1, 2, 3, 5) for _ in range(40)]
    prints = np.unique(np.concatenate([base, np.array(near, np.uint64), np.array(dense, np.uint64)]))
    distinct = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    found = [(np.uint64(r["a"] % 2**64), np.uint64(r["b"] % 2**64)) for r in simhash.links(distinct).collect()]
    assert all(int(a ^ b).bit_count() <= 3 for a, b in found)
    where = {int(p): i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[find(where[int(a)])] = find(where[int(b)])
    want = brute_components(list(range(len(prints))), prints, 3)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_thresholds_add_up():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**64 - 1, 200, dtype=np.uint64)
    groups = [list(range(g * 16, g * 16 + 16)) for g in range(4)]
    values = simhash.part_values(prints, groups)
    counts = np.zeros((4, 1 << 16), np.int64)
    for g in range(4):
        np.add.at(counts[g], values[:, g], 1)
    counts[0, values[0, 0]] += 100_000  # a crowded value is skipped
    taus = simhash.allot(values, simhash.ball_counts(counts, 3), 3)
    assert (taus.sum(axis=1) == 3 - 4 + 1).all() and taus.min() >= -1 and taus[0, 0] == -1
