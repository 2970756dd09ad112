"""Metrics of actions from arrays of whole episodes, and what the ledger makes once."""

import os

import pyarrow as pa
import pytest

from tendon.functions import series
from tendon.jobs import validation_queries
from tendon.operators import motion, poses, quality
from tendon.sources import tables

SF = "/root/testdata/sf0.001"
STEPS = "episode_id long, grp string, key string, t long, vals array<double>"
EPISODES = "episode_id long, control_freq double"
NAN = float("nan")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cells_with_nulls_repeats_and_gaps(spark):
    rows = [(1, "action", "joint_position", t, [v]) for t, v in ((0, 1.0), (1, 3.0), (1, 2.0), (2, None), (3, 4.0), (5, 8.0))]
    rows += [(1, "state", "joint_position", t, [v]) for t, v in ((0, 0.5), (1, 1.0), (2, 2.0), (3, None), (5, 6.0))]
    rows += [(2, "action", "joint_position", 0, [NAN]), (2, "action", "joint_position", 1, []), (2, "action", "joint_position", 2, None), (None, "action", "joint_position", None, [7.0])]
    cell = motion.cell_metrics(spark.createDataFrame(rows, STEPS), spark.createDataFrame([(1, 10.0), (2, None)], EPISODES), medians=True, flips=True)
    by = {r["episode_id"]: r for r in cell.collect()}
    one, two, none = by[1], by[2], by[None]
    assert (one["n"], one["n_state"], one["n_next"], one["n_bad"], one["hz"]) == (5, 4, 3, 0, 10.0)
    assert (one["low"], one["high"], one["first"], one["top_jump"]) == (1.0, 8.0, 1.0, 4.0)  # a null entry is next to nothing
    assert (one["to_next"], one["median"]) == (0.0 + 1.0 + 4.0, 1.0)
    assert (one["period"], one["held"], one["holds"]) == (1, 1, 2)  # changes at 1 and 5
    assert (two["n"], two["n_bad"], two["hz"], two["n_state"]) == (1, 1, None, 0) and two["aa"] is None
    assert (none["n"], none["top"], none["first"]) == (1, 7.0, None)


def test_equal_arrays_are_found_whatever_their_sums(spark):
    same, near, nulls = [0.1, -0.1], [0.1 + 5e-10, -0.1], [None, -0.1]
    made = {1: (same, near), 2: (same, [0.1, -0.2]), 3: (same, nulls), 4: ([NAN], [NAN]), 5: ([0.1], same)}
    rows = [(e, "action", k, t, v) for e, pair in made.items() for k, v in zip(("a", "b"), pair) for t in range(3)]
    rows += [(6, "action", "a", t, same) for t in range(3)] + [(6, "action", "b", t, same) for t in range(4)]
    assert {r["episode_id"] for r in motion.duplicate_pairs(spark.createDataFrame(rows, STEPS)).collect()} == {1, 3}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_actions_are_aligned_and_profiles_parsed_once_for_the_ledger(spark):
    tables = validation_queries._tables(spark, SF)
    keys = quality.keys(tables)
    assert "from_json" not in plan(keys) and "MapInArrow" not in plan(keys)
    assert not [x for x in plan(motion.cell_metrics(tables.steps(motion.GENERAL_KEYS), tables.episodes, tables.parsed, motion.GENERAL_KEYS)).splitlines() if "posexplode" in x]
    assert "from_json" not in plan(quality.cartesian_velocity(tables))


def test_pairs_of_velocities_and_motion_are_no_rows(spark):
    rows = [(1, g, k, t, [0.1 * t] * n) for t in range(6) for g, k, n in (("action", "cartesian_velocity", 6), ("state", "cartesian_position", 3))]
    steps, episodes = spark.createDataFrame(rows, STEPS), spark.createDataFrame([(1, 10.0, False)], EPISODES + ", is_biarm boolean")
    each = poses.velocity_integrations(steps, episodes)
    assert "swapped_linear" not in plan(each)
    # without an orientation only the base's linear motion is there, for velocities in either place
    assert sorted((r["frame"], r["part"], r["moves"]) for r in each.collect()) == [("base", "linear", True), ("base", "swapped_linear", True)]


def test_keys_are_put_together_as_the_cells_would_be(spark):
    rows = [(1, "action", "joint_position", t, v) for t, v in ((0, [1.0, 2.0]), (1, [3.0, None]), (2, [2.0, -7.0]), (3, [NAN, 1.0]))] + [(1, "state", "joint_position", t, [0.5 * t, 1.0]) for t in range(4)]
    rows += [(2, "action", "joint_position", t, [0.3, 0.1 * t, 0.2][: 1 + t]) for t in range(3)] + [(2, "action", "wings", 0, [None]), (None, "action", "joint_velocity", None, [7.0])]
    profiles = spark.createDataFrame([(1, {"action_joint_names": ["a", "gripper"], "robot_state_joint_names": ["a", "gripper"]})], "episode_id long, p struct<action_joint_names:array<string>,robot_state_joint_names:array<string>>")
    args = (spark.createDataFrame(rows, STEPS), spark.createDataFrame([(1, 10.0), (2, None)], EPISODES), profiles)
    for more in ({}, {"medians": True, "flips": True}):
        keys, cells = motion.whole_keys(*args, **more), motion.key_metrics(motion.cell_metrics(*args, **more))
        assert keys.dtypes == cells.dtypes and "Aggregate" not in plan(keys)
        told = lambda df: sorted(repr([float("%.12g" % v) if isinstance(v, float) else v for v in r]) for r in df.collect())
        assert told(keys) == told(cells) and len(told(keys)) == 4


def test_what_is_told_of_an_episode_is_one_column_of_its_steps(spark):
    steps, info = spark.createDataFrame([(1, "action", "joint_position", 0, [1.0])], STEPS), spark.createDataFrame([(1, (10.0, None)), (2, (None, [None, 1]))], "episode_id long, info struct<hz:double,pairs:array<int>>")
    rows = series.dealt(steps, info)
    assert dict(rows.dtypes)["info"] == "string"
    told = series.steps_of(pa.concat_batches(rows.toArrow().to_batches())).info
    assert told == {1: {"hz": 10.0, "pairs": None}, 2: {"hz": None, "pairs": [None, 1]}}


@pytest.mark.parametrize("before", [None, "1000000"])
def test_batches_by_rows_leave_the_setting_as_it_was(spark, before):
    if before:
        spark.conf.set(tables.BYTES_PER_BATCH, before)
    try:
        seen = spark.range(3).mapInArrow(lambda batches: batches, "id long")
        assert tables.saved(seen, "x", by_rows=True).count() == 3 and spark.conf.get(tables.BYTES_PER_BATCH, None) == before
    finally:
        spark.conf.unset(tables.BYTES_PER_BATCH)
