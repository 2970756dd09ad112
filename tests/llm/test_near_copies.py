"""The near-copy stage against all pairs of sets of five words."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tendon.llm import simhash  # noqa: E402


def sets_of(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


@pytest.mark.parametrize("block", [simhash.SETS, 3])
def test_near_copies_by_five_words(spark, docs_of, prose, monkeypatch, block):
    monkeypatch.setattr(simhash, "SETS", block)
    rng = random.Random(8)
    texts = [prose(rng.randint(60, 250), i) for i in range(60)]
    for i in range(60):  # some of these are beyond 3 bits, some are below the similarity
        words = texts[i % 30].split()
        for _ in range(1 + i % 4):
            words[rng.randrange(len(words))] = f"new{i}"
        texts.append(" ".join(words))
    texts += [None, "", "one", "ONE", texts[3]]
    sets = [sets_of(t) for t in texts]
    least = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    prints = [simhash.fingerprint((t or "").encode()) for t in texts]
    assert any((prints[i] ^ prints[j]).bit_count() > simhash.RADIUS for i, j in links)
    kept = pipeline.near(spark, docs_of(texts), "")
    assert kept.columns == docs_of([]).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least))
    assert pipeline.near(spark, docs_of([]), "").collect() == []


def edited(rng, words, goal):
    """The words with one after another exchanged, until the sets of five words are just above the similarity."""
    first, out = sets_of(" ".join(words)), list(words)
    for at in rng.sample(range(len(words)), len(words)):
        new = [*out[:at], f"x{rng.random()}", *out[at + 1 :]]
        other = sets_of(" ".join(new))
        if len(first & other) < goal * len(first | other):
            return out
        out = new


@pytest.mark.parametrize("goal", [0.8, 0.85, 0.9, 0.95])
def test_recall_of_bands_by_similarity(goal):
    rng = random.Random(int(goal * 100))
    pairs = found = 0
    for _ in range(400):
        words = [f"w{rng.randrange(5_000)}" for _ in range(rng.randint(60, 400))]
        other = edited(rng, words, goal)
        if other != words:
            a, b = (simhash.bands(simhash.shingles(" ".join(t).encode(), 5)) for t in (words, other))
            pairs += 1
            found += bool((a == b).any())
    assert pairs > 200 and found >= 0.99 * pairs


def test_texts_with_a_common_passage_share_few_bands(prose):
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([*(f"w{i}-{k}" for k in range(140)), *passage]) for i in range(200)]  # similarity 0.16
    bands = [simhash.bands(simhash.shingles(t.encode(), 5)) for t in texts]
    pairs = [(i, j) for i in range(200) for j in range(i)]
    assert sum((bands[i] == bands[j]).any() for i, j in pairs) <= 0.002 * len(pairs)


def test_blocks_are_bounded_in_hashes(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(simhash, "SET_HASHES", 500)
    words = prose(200, 1).split()
    texts = [" ".join([*words[:i], f"new{i}", *words[i + 1 :]]) for i in range(0, 200, 10)] + [prose(80, 2)] * 2
    assert len(pipeline.near(spark, docs_of(texts), "").collect()) == 2


def test_equal_and_long_texts_repeated_ids_and_nulls(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(120_000))
    texts = [long, long + " end", long, None, "", " \n", "a", "A", None]
    ids = [5, 3, 3, None, 7, 8, 9, 1, None]
    rows = pipeline.near(spark, docs_of(texts, ids), "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 1), (False, 3), (False, 7), (True, 0), (True, 0)]
