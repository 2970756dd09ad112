"""Registered queries of the streaming checks, run over the stored steps as bounded streams or plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendon.jobs import profile_queries
from tendon.operators import profiles
from tendon.sources import episodes as src
from tendon.sources import recordings as rec
from tendon.streaming import recorder


def step_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recorder.step_problems(src.steps(spark, sf_dir)).where("problem is not null")
    return rows.groupBy("key", "problem").count().withColumnRenamed("count", "n")


def rejected_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that break a rule, or whose key the profile of their episode doesn't declare."""
    declared = profiles.declared(rec.parsed(rec.profiles(spark, sf_dir))).where("grp = 'action'")
    _, rejected = recorder.accepted_and_rejected(src.steps(spark, sf_dir).where("grp = 'action'"), declared)
    return rejected.groupBy("episode_id", "key", "problem").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"))


def running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorder.running_counts(src.steps(spark, sf_dir).where("grp = 'action'"))


QUERIES = {"step_problems": step_problems, "rejected_steps": rejected_steps, "running_counts": running_counts}
ORACLE_SQL = {
    "step_problems": src.as_cte("steps") + """, p AS (SELECT key, CASE WHEN len(list_filter(vals, lambda v: NOT isfinite(v))) > 0 THEN 'not_finite' WHEN key = 'cartesian_position' AND len(vals) NOT IN (7, 14) THEN 'cartesian_width'
        WHEN key = 'cartesian_position' AND abs(sqrt(vals[4] ** 2 + vals[5] ** 2 + vals[6] ** 2 + vals[7] ** 2) - 1) > 1e-2 THEN 'unit_quaternion' WHEN key = 'gripper_binary' AND vals[1] NOT IN (0, 1) THEN 'gripper_binary' END AS problem FROM steps)
      SELECT key, problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY ALL""",
    "rejected_steps": rec.as_cte("profiles", "steps") + profile_queries._J + """, w AS (SELECT episode_id, unnest(space) AS key FROM q WHERE p IS NOT NULL),
      r AS (SELECT s.episode_id, s.key, s.t, CASE WHEN (s.episode_id, s.key) NOT IN (SELECT (episode_id, key) FROM w) THEN 'not_declared' WHEN len(list_filter(vals, lambda v: NOT isfinite(v))) > 0 THEN 'not_finite' WHEN key = 'cartesian_position' AND len(vals) NOT IN (7, 14) THEN 'cartesian_width'
        WHEN key = 'cartesian_position' AND abs(sqrt(vals[4] ** 2 + vals[5] ** 2 + vals[6] ** 2 + vals[7] ** 2) - 1) > 1e-2 THEN 'unit_quaternion' WHEN key = 'gripper_binary' AND vals[1] NOT IN (0, 1) THEN 'gripper_binary' END AS problem FROM steps s WHERE grp = 'action')
      SELECT episode_id, key, problem, count(*) AS n, min(t) AS first_t FROM r WHERE problem IS NOT NULL GROUP BY episode_id, key, problem""",
    "running_counts": src.as_cte("steps") + """ SELECT episode_id, key, count(*) AS n_steps, count(*) FILTER (len(list_filter(vals, lambda v: isnan(v))) > 0) AS nan_steps, sum(8 * len(vals))::BIGINT AS n_bytes,
      min(len(vals))::INT AS least_width, max(len(vals))::INT AS most_width FROM steps WHERE grp = 'action' GROUP BY ALL""",
}
