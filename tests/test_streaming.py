import random
import tempfile

import pytest

from tendon.streaming import recorder

SCHEMA = "episode_id long, key string, vals array<double>, closes boolean"


def test_episode_log_closes_and_flags(spark):
    at, check = tempfile.mkdtemp(prefix="spark-in-"), tempfile.mkdtemp(prefix="spark-check-")
    rows = [(1, "k", [1.0, float("nan")], False), (1, "k", [1.0, 2.0], True), (2, "k", [1.0], False), (2, "k", [1.0, 2.0], False), (2, "k", [0.0] * 20, True)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(at)
    log = recorder.episode_log(spark.readStream.schema(SCHEMA).parquet(at), cap=100, idle_ms=None)
    query = log.writeStream.format("memory").queryName("episode_log").outputMode("append").option("checkpointLocation", check).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(100)
        got = {(r["episode_id"], r["n_steps"], r["problem"]) for r in spark.table("episode_log").collect()}
    finally:
        query.stop()
    assert {(1, 2, ""), (2, 1, "shape_changed"), (2, 3, "over_cap"), (2, 3, "")} <= got


def test_listing_keeps_the_newest(spark):
    at = tempfile.mkdtemp(prefix="spark-listing-") + "/l"
    make = lambda rows: spark.createDataFrame(rows, "path string, size long, mtime long")
    recorder.upsert_listing(make([("a", 1, 1), ("b", 1, 1)]), at)
    recorder.upsert_listing(make([("a", 5, 2), ("b", 1, 1)]), at)
    assert {tuple(r) for r in recorder.listing(spark, at).collect()} == {("a", 5, 2), ("b", 1, 1)}


def test_steps_are_rejected_by_both_arms_and_declarations(spark):
    good, bad = [0.0] * 3 + [0.0, 0.0, 0.0, 1.0], [0.0] * 3 + [0.5, 0.0, 0.0, 0.0]
    rows = [(1, "cartesian_position", v) for v in (good, bad, good + good, good + bad, bad + good, good[:6], None, [])] + [(1, "gripper_binary", [0.5]), (2, "gripper_binary", [1.0]), (1, "joint_position", [float("inf")])]
    steps = spark.createDataFrame([(*r, t) for t, r in enumerate(rows)], "episode_id long, key string, vals array<double>, t long")
    want = [None, "unit_quaternion", None, "unit_quaternion", "unit_quaternion", "cartesian_width", "empty", "empty", "gripper_binary", None, "not_finite"]
    assert [r["problem"] for r in recorder.step_problems(steps).orderBy("t").collect()] == want
    declared = spark.createDataFrame([(1, "cartesian_position"), (1, "gripper_binary")], "episode_id long, key string")
    kept, rejected = recorder.accepted_and_rejected(steps, declared)
    assert sorted(r["t"] for r in kept.collect()) == [0, 2] and kept.columns.count("problem") == 0
    assert {r["t"]: r["problem"] for r in rejected.collect()} == {t: p for t, p in enumerate(want) if p} | {9: "not_declared", 10: "not_declared"}


class State:
    """What the engine hands to a stateful function."""

    def __init__(self, value=None, timed_out=False):
        self.value, self.hasTimedOut, self.timeout = value, timed_out, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_idle_episodes_close_and_late_rows_go_by_step():
    import pandas as pd

    run = recorder._close(100, 500)
    state = State()
    rows = pd.DataFrame({"vals": [[1.0, 2.0], [1.0], [float("nan")]], "closes": [False] * 3, "t": [2, 0, 1]})
    out = pd.concat(run((7, "k"), iter([rows]), state))
    assert out["problem"].tolist() == ["shape_changed"] and state.value == (1, 3, 1, 32) and state.timeout == 500
    idle = State(state.value, True)
    closed = pd.concat(run((7, "k"), iter([]), idle))
    assert closed.iloc[0].tolist() == [7, "k", 3, 1, 32, ""] and not idle.exists


def test_a_stream_of_files_keeps_the_newest(spark):
    at, came, check = (tempfile.mkdtemp(prefix=f"spark-{x}-") for x in ("log", "came", "check"))
    schema = "path string, size long, mtime long"
    for rows in ([("a", 1, 1), ("b", 1, 1)], [("a", 5, 2), ("a", 4, 1)], []):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(came)
        query = recorder.follow_listing(spark.readStream.schema(schema).parquet(came), at, check)
        assert query.awaitTermination(100)
    assert {tuple(r) for r in recorder.listing(spark, at).collect()} == {("a", 5, 2), ("b", 1, 1)}


def test_policies_for_nan():
    import pandas as pd

    nan = float("nan")
    rows = pd.DataFrame({"vals": [[1.0, 2.0], [nan, 2.0], None, [nan, nan], [1.0, 3.0]], "closes": [False, False, False, False, True]})
    want = {
        "ignore": [(4, 2, 64, "")], "warn": [(2, 1, 32, "nan"), (4, 2, 64, "")],
        "error": [(1, 0, 16, "nan_rejected"), (1, 0, 16, "nan_rejected"), (2, 0, 32, "")],
    }
    for policy, told in want.items():
        out = pd.concat(recorder._close(100, None, policy)((7, "k"), iter([rows]), State()))
        assert [tuple(r)[2:] for r in out.itertuples(index=False)] == told
    with pytest.raises(ValueError):
        recorder._known("loud")


def test_vectorised_counts_match_a_loop():
    import pandas as pd

    rng = random.Random(3)
    for _ in range(60):
        vals = [rng.choice([None, [], [1.0], [1.0, 2.0], [float("nan")], [1.0, float("nan")]]) for _ in range(rng.randint(1, 12))]
        closes = [rng.random() < 0.2 for _ in vals]
        width, n, nan, size, want = -1, 0, 0, 0, []
        for v, end in zip(vals, closes):
            if v:
                width = len(v) if width < 0 else width
                if len(v) != width:
                    want.append((n, nan, size, "shape_changed"))
                before, size = size, size + 8 * len(v)
                n, nan = n + 1, nan + any(x != x for x in v)
                if before <= 30 < size:
                    want.append((n, nan, size, "over_cap"))
            if end:
                want.append((n, nan, size, ""))
                width, n, nan, size = -1, 0, 0, 0
        got = list(recorder._close(30, None)((1, "k"), iter([pd.DataFrame({"vals": vals, "closes": closes})]), State()))
        assert [tuple(r)[2:] for r in pd.concat(got).itertuples(index=False)] == want if got else not want


def test_event_time_closes_after_a_restart_and_leaves_late_and_repeated_steps_out(spark):
    from datetime import datetime, timedelta

    came, out, check = (tempfile.mkdtemp(prefix=f"spark-{x}-") for x in ("came", "out", "check"))
    schema = "episode_id long, key string, t long, ts timestamp, vals array<double>, closes boolean"
    noon = datetime(2024, 5, 1, 12)
    at = lambda e, t, s: (e, "k", t, noon + timedelta(seconds=s), [1.0, 2.0], False)
    # the third batch has a late step of the first episode, which a restarted query has closed by then
    for rows in ([at(1, 0, 0), at(1, 1, 1), at(1, 1, 1), at(2, 0, 2)], [at(1, 2, 3), at(1, 0, 0), at(3, 0, 7200)], [at(1, 9, 4), at(3, 1, 7201), at(4, 0, 20000)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(came)
        log = recorder.event_log(spark.readStream.schema(schema).parquet(came), idle_ms=60_000, delay="10 seconds")
        query = log.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", check).trigger(availableNow=True).start()
        assert query.awaitTermination(200)
    got = sorted((r["episode_id"], r["n_steps"], r["n_bytes"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 3, 48), (2, 1, 16), (3, 2, 32)]


def test_a_log_is_compacted_while_it_is_read(spark):
    at = tempfile.mkdtemp(prefix="spark-log-") + "/labels"
    keys, newest = ("episode_id", "annotator"), "at"
    make = lambda rows: spark.createDataFrame(rows, "episode_id long, annotator string, at long, success string")
    read = lambda: {tuple(r) for r in recorder.latest(spark, at, keys, newest).collect()}
    recorder.upsert(make([(1, "a", 1, "no"), (1, "b", 1, "yes"), (2, "a", 3, "no")]), at, keys, newest, 0)
    recorder.upsert(make([(1, "a", 2, "yes"), (2, "a", 1, "yes")]), at, keys, newest, 1)
    want = {(1, "a", 2, "yes"), (1, "b", 1, "yes"), (2, "a", 3, "no")}
    before = recorder.latest(spark, at, keys, newest)
    assert read() == want and recorder.compacted(spark, at, keys, newest) and read() == want
    assert {tuple(r) for r in before.collect()} == want  # a reader that began before sees its version
    assert not recorder.compacted(spark, at, keys, newest)
    recorder.upsert(make([(3, "c", 1, "no"), (1, "b", 5, "no")]), at, keys, newest, 2)
    want = {(1, "a", 2, "yes"), (1, "b", 5, "no"), (2, "a", 3, "no"), (3, "c", 1, "no")}
    assert read() == want and recorder.compacted(spark, at, keys, newest) and read() == want
    assert recorder.cleared(spark, at) == 5 and read() == want  # three changes, a table and a manifest
    recorder.upsert(make([(3, "c", 1, "no"), (1, "b", 5, "no")]), at, keys, newest, 2)  # a batch that comes again
    assert read() == want
