import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tendon.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth string, a int, n_turns int"


def brute(turns):
    """The trie by dictionaries of whole beginnings."""
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(rows)] for c, rows in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(own.get(c - c % 20, [])[:h] + rows[h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, ms in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(ms) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return Counter((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), kids[p], leaves[p], saved[p], sha(p)) for p, ms in members.items())


def found(spark, turns):
    rows = [(*t, "clash", 1, 2) for t in turns]
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    return Counter(map(tuple, got.collect()))


def test_against_dictionaries(spark):
    rng = random.Random(1)
    turns = []
    for c in range(150):
        start = rng.choice([[], ["hello there"], ["hello there", "good day"], ["x"]])
        texts = start + [rng.choice(["yes", "no no", "a b c", f"own {c}", None, ""]) for _ in range(rng.randint(0, 6))]
        turns += [(c, k, rng.choice(["user", "user", None]) if k > 1 else "user", t) for k, t in enumerate(texts)]
    turns = [t for t in turns if t[0] != 40]  # a family without its first
    turns += [(None, 1, "user", "nobody"), (7, None, "system", "first of all"), (7, None, "system", "first of all")]
    rng.shuffle(turns)
    assert found(spark, turns) == brute(turns)


def test_hot_first_turn_and_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN_BYTES", 40)
    turns = [(c, k, "user", t) for c in range(400) for k, t in enumerate(["hi all", "same", "end"] if c % 3 else ["hi all", f"own {c}"])]
    assert found(spark, turns) == brute(turns)


def test_one_long_conversation(spark):
    turns = [(20, k, "user", f"turn {k % 7}") for k in range(900)] + [(c, k, "user", f"turn {k % 7}") for c in (21, 22, 39) for k in range(5 * (c - 19))]
    assert found(spark, turns) == brute(turns)


@pytest.mark.parametrize("turns", [[], [(None, 0, "user", "x")], [(5, None, None, None)], [(3, 0, "user", "a"), (3, 0, "user", "a")]])
def test_few_turns(spark, turns):
    assert found(spark, turns) == brute(turns)


def test_turnless_rebuilt_conversations_end_at_the_root(spark):
    short = [c for c in range(21, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:5]
    turns = [(c, 0, "user", "gone") for c in short]
    got = found(spark, turns)
    assert got == brute(turns) and sum(got.values()) == 1


def test_totals_of_random_trees(spark):
    rng = random.Random(4)
    parent, depth = {0: None}, {0: 0}
    for i in range(1, 600):
        parent[i] = i - 1 if rng.random() < 0.8 else rng.randrange(i)
        depth[i] = depth[parent[i]] + 1
    for i in range(600, 640):
        parent[i], depth[i] = 0, 1
    kids, total = Counter(p for p in parent.values() if p is not None), {i: i + 1 for i in parent}
    for i in sorted(parent, key=lambda i: -depth[i]):
        if parent[i] is not None:
            total[parent[i]] += total[i]
    rows = [(i, -i, p, None if p is None else -p, depth[i], kids[i], i + 1) for i, p in parent.items()]
    nodes = spark.createDataFrame(rows, "a long, b long, pa long, pb long, depth long, n_children long, v long")
    assert {r["a"]: r["v"] for r in prefix_trie.subtree_totals(nodes, ("v",)).collect()} == total


def test_running_values_cross_ranges(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.getrandbits(60)) for k in (1, 2, 3) for i in range(300 if k == 2 else 4)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = prefix_trie.running(spark.createDataFrame(rows, "k long, i long, x long").withColumn("one", F.lit(1).cast("long")), "k", ["i"], ("one",), ("x",)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    acc = Counter()
    want = {}
    for k, i, x in sorted(rows):
        acc[k] ^= x
        want[k, i] = (i + 1, acc[k])
    assert {(r["k"], r["i"]): (r["one_run"], r["x_run"]) for r in got} == want
