"""Poses and velocities of each arm from arrays of whole episodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendon.functions.rotations import EULER_ORDERS, to_quaternion
from tendon.operators import arms, poses

STEPS = "episode_id long, grp string, key string, t long, vals array<double>"
EPISODES = "episode_id long, control_freq double, is_biarm boolean"
NAN = float("nan")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_steps_of_arms_are_no_windows(spark):
    steps, episodes = spark.createDataFrame([], STEPS), spark.createDataFrame([], EPISODES)
    for df in (poses.pose_metrics(steps, episodes), poses.velocity_rows(steps, episodes), poses.biarm_ordering(steps, episodes)):
        assert "lead(" not in plan(df) and plan(df).count("MapInArrow") == 1 and df.collect() == []


@pytest.mark.parametrize("kind", ["quat", "matrix", "rot6d", "rotvec", *(f"euler_{o}" for o in EULER_ORDERS)])
def test_orientations_are_those_of_the_expressions(spark, kind):
    width = {"quat": 4, "matrix": 9, "rot6d": 6}.get(kind, 3)
    x = np.random.default_rng(1).normal(size=(20, width))
    x[0] = 0.0
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, x array<double>")
    made = {r["i"]: r["q"] for r in rows.select("i", to_quaternion(F.col("x"), kind).alias("q")).collect()}
    wide = np.full((20, 9), np.nan)
    wide[:, :width] = x
    q, has = arms.quaternions(wide, np.full(20, width), np.full(20, kind, object))
    for i in range(20):
        assert has[i] == (sum(v * v for v in made[i]) > 0) and (not has[i] or np.allclose(q[i], made[i], atol=1e-12))
    assert not arms.quaternions(wide, np.full(20, width), np.full(20, "other", object))[1].any() or width == 4


def test_arms_with_nulls_gaps_and_other_widths(spark):
    pose = lambda x: [x, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    rows = [(1, "action", "cartesian_position", t, pose(0.1 * t)) for t in (0, 1, 3)] + [(1, "state", "cartesian_position", t, pose(0.1 * t)) for t in (0, 1, 2, 3)]
    rows += [(2, "action", "cartesian_position", t, [NAN if t else 0.0] * 7) for t in (0, 1)] + [(3, "action", "cartesian_position", 0, [1.0] * 6), (3, "action", "cartesian_position", 1, None)]
    rows += [(4, g, "cartesian_position", t, pose(0.1 * t + k) + pose(0.1 * t + 1 - k)) for t in (0, 1, 2) for g, k in (("action", 1), ("state", 0))] + [(9, "action", "cartesian_position", 0, pose(0.0))]
    episodes = spark.createDataFrame([(1, 10.0, False), (2, None, None), (3, 10.0, False), (4, 10.0, True)], EPISODES)
    got = {(r["episode_id"], r["arm"]): r for r in poses.pose_metrics(spark.createDataFrame(rows, STEPS), episodes).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 0), (4, 0), (4, 1)}  # the episode that isn't listed is left out
    one = got[1, 0]
    # the state after the action of step 1 doesn't count, as the action has a gap there
    assert (one["steps"], one["n_state"], one["n_next"], one["fits"], one["bad"]) == (3, 3, 1, True, False) and abs(one["median_far"] - 0.1) < 1e-12 and one["median_turned"] == 0.0
    assert (got[2, 0]["bad"], got[2, 0]["steps"], got[2, 0]["hz"], got[2, 0]["arms"]) == (True, 0, None, 1) and got[2, 0]["median_far"] is None
    assert (got[3, 0]["bad"], got[3, 0]["fits"], got[3, 0]["width"]) == (False, False, 6)
    assert abs(got[4, 0]["same"] - 2 * (0.9**2 + 1.1**2)) < 1e-9 and abs(got[4, 0]["swapped"] - 4 * 0.1**2) < 1e-9 and abs(got[4, 1]["top"] - 0.2) < 1e-9
