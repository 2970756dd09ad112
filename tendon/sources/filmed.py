"""Motion and cameras of filmed episodes, derived from ``events``: each rule on video and motion has episodes that break it.

One episode per user, one step per event, one frame per step. Joints move evenly but for planted jumps; a third joint
goes round and round, a quaternion changes its sign, cameras freeze, stutter, jump or glitch by the episode's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendon.functions.columns import split
from tendon.sources.episodes import by_user, for_engine

_BASE = (
    "WITH b0 AS (SELECT user_id AS e, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t FROM {events}),"
    " b AS (SELECT e, t, count(*) OVER (PARTITION BY e) AS n FROM b0)"
)
_JUMP = "CASE WHEN e % 8 IN (5, 6) AND t >= 26 THEN 1e0 WHEN e % 8 = 7 THEN 0.06e0 * (t // 5) ELSE 0e0 END"
_TURN = "((t * 3) % 20) * 0.3141592653589793e0 - 3.1e0"


def _motion_parts() -> list[tuple[str, str, str, str]]:
    """Group, key, values and condition of each array that an episode may have."""
    jump, whole = _JUMP.replace("(t // 5)", "floor(t / 5e0)"), "0.01e0 * t + 0.0004e0 * ((t * 7) % 3)"
    state = f"ARR({whole} + {jump}, 0.02e0 * t + 0.5e0 * ({jump}), CASE WHEN e % 3 = 1 THEN {_TURN} ELSE 0.4e0 END)"
    command = f"ARR({whole} + CASE WHEN e % 16 = 15 THEN 5e0 * ({jump}) ELSE 0e0 END, 0.02e0 * t, 0e0)"
    sign = "CASE WHEN e % 3 = 0 AND (t // 4) % 2 = 1 THEN -1e0 ELSE 1e0 END".replace("(t // 4)", "CAST(floor(t / 4e0) AS BIGINT)")
    u = "(0.002e0 * t)"
    pose = f"ARR(0.003e0 * t, 0.001e0 * t, 0.2e0, 0e0, 0e0, ({sign}) * 2e0 * {u} / (1e0 + {u} * {u}), ({sign}) * (1e0 - {u} * {u}) / (1e0 + {u} * {u}))"
    return [("state", "joint_position", state, "true"), ("state", "cartesian_position", pose, "e % 2 = 0"), ("state", "gripper_position", "ARR(1e0 * (t % 2))", "true"), ("action", "joint_position", command, "true")]


def motion_sql() -> str:
    """``motion(episode_id, grp, key, t, vals)``: states and commands."""
    every = " UNION ALL ".join(f"SELECT e AS episode_id, '{g}' AS grp, '{k}' AS key, t, {v} AS vals FROM b WHERE {w}" for g, k, v, w in _motion_parts())
    return f"SELECT * FROM ({_BASE} {every}) AS derived"


def frames_sql() -> str:
    """``frames(episode_id, camera, frame_idx, luma, diff, skip_diff)``: what is left of gray frames, two cameras each."""
    plain = "2e0 + 0.25e0 * ((t * 7 + e + 3 * c) % 5)"
    diff = f"""CASE WHEN e % 8 = 1 AND c = 0 AND t BETWEEN 8 AND 8 + 12 * (1 + e % 3) THEN 0.02e0 WHEN e % 8 = 2 AND c = 0 AND t % 3 = 0 THEN 0.004e0 WHEN e % 8 = 3 AND t = 20 THEN 95e0
      WHEN e % 8 = 4 AND c = 0 AND t IN (14, 15) THEN 90e0 WHEN e % 8 = 5 AND c = e % 16 // 8 AND t = 25 THEN 60e0 WHEN e % 8 = 0 AND t = 30 THEN 90e0 WHEN e % 8 = 7 AND t % 5 = 4 THEN 11e0 ELSE {plain} END""".replace("e % 16 // 8", "CAST(floor((e % 16) / 8e0) AS BIGINT)")
    return f"""SELECT * FROM ({_BASE}, k AS (SELECT 0 AS c, 'front' AS camera UNION ALL SELECT 1, 'Tactile'), f AS (SELECT e, t, n, c, camera FROM b CROSS JOIN k)
      SELECT e AS episode_id, camera, t AS frame_idx, 100e0 + t % 7 AS luma, CASE WHEN t < n - 1 THEN {diff} END AS diff, CASE WHEN t < n - 2 THEN CASE WHEN e % 8 = 4 AND t = 14 THEN 1e0 ELSE 3e0 END END AS skip_diff FROM f) AS derived"""


def rates_sql() -> str:
    """``rates(episode_id, control_freq)`` and the cameras' own rates; some episodes have none."""
    return """SELECT * FROM (WITH u AS (SELECT user_id AS e FROM {events} GROUP BY user_id)
      SELECT e AS episode_id, CASE WHEN e % 29 = 5 THEN 0e0 WHEN e % 29 = 6 THEN CAST(NULL AS DOUBLE) ELSE 10e0 * (1 + e % 3) END AS control_freq,
        CASE WHEN e % 29 IN (5, 7) THEN 0e0 ELSE 10e0 * (1 + e % 3) END AS fps FROM u) AS derived"""


def _table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(for_engine(sql, "array"), events=by_user(spark.read.parquet(f"{sf_dir}/events.parquet")))


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from one scan and one window: each event gives the arrays of its step."""
    base = spark.sql(f"{_BASE} SELECT * FROM b", events=by_user(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")))
    rows = {f"{g}_{k}": F.expr(f"IF({w}, named_struct('grp', '{g}', 'key', '{k}', 'vals', {for_engine(v, 'array')}), NULL)") for g, k, v, w in _motion_parts()}
    return split(base.withColumn("episode_id", F.col("e")), rows).select("episode_id", "x.grp", "x.key", "t", "x.vals")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, frames_sql())


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, rates_sql())


def as_cte(*names: str) -> str:
    made = {"motion": motion_sql, "frames": frames_sql, "rates": rates_sql}
    return "WITH " + ", ".join(f"{n} AS (" + for_engine(made[n](), "list_value").replace("{events}", "events") + ")" for n in names)
