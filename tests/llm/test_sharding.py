import random
import zlib
from collections import Counter, defaultdict

import pytest

from tendon.llm import sharding


def units(docs):
    """Bytes per unit of equal texts by its place in the order, as the plan places them."""
    rows = sharding.units_of(docs)
    plan = sharding.planned(rows)
    placed = sharding.assigned(rows, plan).collect()
    sums = Counter()
    for r in placed:
        sums[r["place"]] += r["size"]
    return plan, sums, placed


def feasible(sizes, capacity, shards):
    used, at = 1, 0
    for s in sizes:
        if s > capacity:
            return False
        if at + s > capacity:
            used, at = used + 1, 0
        at += s
    return used <= shards


def smallest(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(sizes, mid, shards) else (mid + 1, high)
    return low


def check_rows(docs, texts, ids, shards=8):
    rows = sharding.sharded(docs, shards).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    for r in rows:
        where[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    return Counter({k: sum(r["size"] for r in rows if r["shard"] == k) for k in range(shards)})


@pytest.mark.parametrize("bins", [1 << 14, 8])
def test_capacity_is_the_smallest(spark, docs_of, prose, monkeypatch, bins):
    monkeypatch.setattr(sharding, "BINS", bins)
    rng = random.Random(bins)
    texts = [prose(int(rng.expovariate(0.02)) + 1, i) for i in range(400)] + ["twice", "twice", None, ""]
    plan, sums, placed = units(docs_of(texts))
    sizes = [sums[p] for p in sorted(sums)]
    assert plan.giants == 0 and plan.capacity == smallest(sizes, 8)
    by = Counter()
    for r in placed:
        by[r["shard"]] += r["size"]
    assert len(by) == 8 and max(by.values()) <= plan.capacity
    # places in the order and shards rise together
    last = {s: max(r["place"] for r in placed if r["shard"] == s) for s in by}
    first = {s: min(r["place"] for r in placed if r["shard"] == s) for s in by}
    assert all(last[s] < first[s + 1] for s in range(7))


def test_search_with_few_bins_finds_what_plain_search_finds():
    rng = random.Random(3)
    for _ in range(200):
        sizes = {rng.randrange(1 << 12): rng.choice([1, 2, 3, 50, 400]) for _ in range(rng.randint(1, 60))}
        shards = rng.randint(1, 9)
        order = [sizes[p] for p in sorted(sizes)]
        shift = 9
        leaf = lambda ps, s: [(b << s, s, sum(sizes[p] for p in ps if p >> s == b), sum(p >> s == b for p in ps)) for b in sorted({p >> s for p in ps})]
        bins, low = sharding.Bins(leaf(sizes, shift)), max(max(order), -(-sum(order) // shards))
        while True:
            low, high = bins.smallest(shards, low, True), bins.smallest(shards, low, False)
            if low == high:
                break
            unclear = [bins.leaves[i] for i in bins.unclear(shards, low, high)]
            split = [x for u in unclear for x in leaf([p for p in sizes if p >> u[1] == u[0] >> u[1]], max(0, u[1] - 2))]
            bins = sharding.Bins([*(set(bins.leaves) - set(unclear)), *split])
        assert high == smallest(order, shards)
        cuts = bins.cuts(shards, high)
        assert cuts == sorted(cuts) and len(cuts) == shards - 1
        by = Counter()
        for p, s in sizes.items():
            by[sum(p >= c for c in cuts)] += s
        assert max(by.values()) <= high


def test_shards_are_near_equal_and_units_whole(spark, docs_of, prose):
    rng = random.Random(5)
    texts = [prose(int(rng.expovariate(0.01)) + 1, i) for i in range(1500)]
    texts += [texts[k % 40] for k in range(300)] + [prose(4000, 1)] * 2 + [None, ""]
    ids = [*range(len(texts) - 3), None, None, 4]
    sizes = check_rows(docs_of(texts, ids), texts, ids)
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 8


def test_one_group_with_most_rows(spark, docs_of, prose):
    texts = ["the same words " * 20] * 700 + [prose(30, i) for i in range(700)]
    ids = [None] * 350 + list(range(1050))
    sizes = check_rows(docs_of(texts, ids), texts, ids)
    hot = 700 * len(b"the same words " * 20) + 700
    others = [s for s in sizes.values() if s != hot]
    assert sizes[0] == hot and len(others) == 7 and max(others) - min(others) <= 0.05 * max(others)


@pytest.mark.parametrize("texts", [[], [None], ["a"] * 5, ["a", "b", "c"]])
def test_few_texts(spark, docs_of, texts):
    sizes = check_rows(docs_of(texts), texts, range(len(texts)))
    assert sum(s > 0 for s in sizes.values()) == len({t or "" for t in texts})
    check_rows(docs_of(texts), texts, range(len(texts)), shards=1)


def test_written_shards(spark, docs_of, prose, tmp_path):
    texts = [prose(40, i % 150) for i in range(200)]
    docs = docs_of(texts)
    sharding.write_shards(docs, f"{tmp_path}/out", 4, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, back.select(docs.columns).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    where = {r["doc_id"]: r["shard"] for r in sharding.sharded(docs, 4).collect()}
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == where
    with pytest.raises(ValueError):
        sharding.write_shards(back, f"{tmp_path}/again")
