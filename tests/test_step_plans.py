"""What queries over steps make of each event: no more than they need, and not once more for a filter."""

import os

import pytest

from tendon.jobs import registry
from tendon.operators import video_motion
from tendon.sources import episodes as src
from tendon.sources import filmed
from tendon.sources import recordings as rec

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_arrays_of_a_step_are_made_once_and_outside_of_lambdas(spark):
    lines = plan(src.steps(spark, SF)).splitlines()
    assert not [x for x in lines if "Filter" in x and "named_struct" in x]
    assert not [x for x in lines if "Generate" in x and "named_struct" in x]


def test_declared_keys_make_no_values(spark):
    assert "vals" not in plan(registry.QUERIES["declared_keys"](spark, SF))


def test_state_jumps_make_no_actions(spark):
    assert "joint_velocity" not in plan(registry.QUERIES["state_jumps"](spark, SF))


def test_reasons_of_skipped_keys_are_in_no_lambda(spark):
    lines = plan(registry.QUERIES["skipped_keys"](spark, SF)).splitlines()
    assert not [x for x in lines if "too_short" in x and "lambda" in x]


def test_arrays_of_all_keys_come_from_one_scan(spark):
    assert plan(rec.arrays(spark, SF)).count("Relation") == 1


def test_sizes_of_steps_are_made_once_and_without_windows_over_cells(spark):
    lines = plan(registry.QUERIES["hand_skips"](spark, SF)).splitlines()
    assert sum("MapInArrow" in x for x in lines) == 1
    assert not [x for x in lines if "Window" in x and "stddev_pop" in x]


def test_filmed_motion_comes_from_one_scan(spark):
    assert plan(filmed.motion(spark, SF)).count("Relation") == 1


def test_batches_cut_no_episode_in_two(spark):
    steps = filmed.motion(spark, SF)
    rows = lambda: sorted((r["episode_id"], r["step"]) for r in video_motion.state_motion(steps).collect())
    whole = rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows() == whole and len({e for e, _ in whole}) == len(whole)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_medians_around_an_entry(spark):
    rows = spark.createDataFrame([([3.0, 1.0, 2.0, 9.0],), ([None, 1.0, 2.0],), ([],)], "x array<double>")
    got = [r["m"] for r in rows.select(video_motion.rolling_median(rows.x, 1).alias("m")).collect()]
    assert got == [[3.0, 2.0, 2.0, 9.0], [None, 2.0, 2.0], []]
