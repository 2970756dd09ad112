"""Registered queries of names, roles, sizes and listings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendon.jobs.dataset_queries import _A, annotation_ticks, other_annotators
from tendon.operators import curation
from tendon.sources import episodes as src

_NAMES = """CASE e % 6 WHEN 0 THEN ARR('joint1', 'joint2', 'joint3', 'joint4') WHEN 1 THEN ARR('joint2', 'joint1', ' ', 'Joint3') WHEN 2 THEN ARR('left_joint_1', 'right_joint_1', 'left_joint_3', 'left_joint_2')
    WHEN 3 THEN ARR('j1', 'J1', 'j1', 'j2') WHEN 4 THEN ARR('base', 'elbow', 'wrist', 'gripper_joint') ELSE ARR('j10', 'j9', '', '') END"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.episodes(spark, sf_dir).select("episode_id", F.col("episode_id").alias("e")).select("episode_id", F.expr(src.for_engine(_NAMES, "array")).alias("names"))


def joint_name_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.joint_name_problems(_profiles(spark, sf_dir))


def camera_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.camera_roles(src.videos(spark, sf_dir))


def upload_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.upload_sizes(src.episodes(spark, sf_dir), src.steps(spark, sf_dir), src.videos(spark, sf_dir), 200_000_000)


def nan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.nan_summary(src.steps(spark, sf_dir))


def episode_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.structure(src.steps(spark, sf_dir))


def episode_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the first annotator sees it."""
    return curation.listing(src.episodes(spark, sf_dir), annotation_ticks(spark, sf_dir), other_annotators(spark, sf_dir).where("annotator = 'a0'"))


def bimanual_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curation.bimanual(src.steps(spark, sf_dir).where("grp = 'action' and key = 'joint_velocity'"), (0, 1, 2, 4, 5), (3, 6))
    return rows.select("episode_id", "t", F.round(F.aggregate("joints", F.lit(0.0), lambda a, v: a + v), 6).alias("joint_sum"), *(F.round(F.col("grippers")[i], 6).alias(f"gripper_{i}") for i in (0, 1)))


_TICK = """CASE WHEN outcome IS NULL THEN 0 WHEN outcome = 'success' OR (outcome = 'success_suboptimal' AND description IS NOT NULL) OR (description IS NOT NULL AND len(cats) > 0 AND severity IS NOT NULL) THEN 2 ELSE 1 END"""
QUERIES = {f.__name__: f for f in (joint_name_problems, camera_roles, upload_sizes, nan_summary, episode_structure, episode_listing, bimanual_split)}
ORACLE_SQL = {
    "joint_name_problems": src.as_cte("episodes") + f""", p AS (SELECT episode_id, {src.for_engine(_NAMES, "list_value").replace("e % 6", "episode_id % 6")} AS names FROM episodes),
      r AS (SELECT episode_id, i, names[i] AS name, lower(trim(names[i])) AS low FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM p)),
      n AS (SELECT *, try_cast(regexp_extract(low, '([0-9]+)[^0-9]*$', 1) AS INT) AS number, regexp_replace(low, '[0-9]+([^0-9]*)$', '#\\1') AS pat FROM r),
      w AS (SELECT *, lag(number) OVER (PARTITION BY episode_id, pat ORDER BY i) AS before, row_number() OVER (PARTITION BY episode_id, low ORDER BY i) AS seen FROM n)
      SELECT episode_id, 'blank' AS problem, name AS subject FROM w WHERE low = '' UNION ALL SELECT episode_id, 'duplicate', name FROM w WHERE low <> '' AND seen = 2
      UNION ALL SELECT episode_id, 'order', name FROM w WHERE number < before UNION ALL SELECT episode_id, 'gripper_in_joints', name FROM w WHERE low LIKE '%gripper%'""",
    "camera_roles": src.as_cte("videos") + """, r AS (SELECT episode_id, min(name) FILTER (lower(name) LIKE '%wrist%') AS wrist,
        list(name ORDER BY CASE WHEN lower(name) LIKE '%left%' THEN 0 WHEN lower(name) LIKE '%right%' THEN 1 ELSE 2 END, name) FILTER (lower(name) NOT LIKE '%wrist%') AS x FROM videos GROUP BY episode_id)
      SELECT episode_id, wrist, x[1] AS exterior_1, coalesce(x[2], x[1]) AS exterior_2 FROM r""",
    "upload_sizes": src.as_cte("episodes", "steps", "videos") + """, f AS (SELECT lab_id, sum(size_bytes)::BIGINT AS episode_bytes FROM episodes GROUP BY lab_id),
      a AS (SELECT lab_id, sum(8 * len(vals))::BIGINT AS array_bytes FROM steps JOIN episodes USING (episode_id) GROUP BY lab_id),
      v AS (SELECT lab_id, sum(b)::BIGINT AS video_bytes FROM (SELECT lab_id, stored_path, max(v.size_bytes) AS b FROM videos v JOIN episodes USING (episode_id) GROUP BY ALL) GROUP BY lab_id)
      SELECT lab_id, episode_bytes, array_bytes, video_bytes, episode_bytes + coalesce(video_bytes, 0) > 200000000 AS warn FROM f LEFT JOIN a USING (lab_id) LEFT JOIN v USING (lab_id)""",
    "nan_summary": src.as_cte("steps") + " SELECT grp, key, sum(len(list_filter(vals, lambda v: isnan(v))))::BIGINT AS nan_values, count(*) FILTER (len(list_filter(vals, lambda v: isnan(v))) > 0) AS nan_steps, count(*) AS n_steps FROM steps GROUP BY ALL",
    "episode_structure": src.as_cte("steps") + " SELECT episode_id, grp, key, count(*) AS n, max(len(vals))::INT AS width, sum(8 * len(vals))::BIGINT AS n_bytes FROM steps GROUP BY ALL",
    "episode_listing": _A + f""", eps AS ({src.for_engine(src.episodes_sql(), 'list_value').replace('{events}', 'events')}), b AS (SELECT episode_id, max({_TICK}) AS tick FROM up GROUP BY ALL)
      SELECT replace(rel_path, '/', '__') AS id, rel_path, mtime, coalesce(tick, 0) AS tick, eps.episode_id IN (SELECT episode_id FROM an WHERE annotator <> 'a0' AND trim(coalesce(source, '')) IN ('', 'human')) AND eps.episode_id IN (SELECT episode_id FROM an WHERE annotator = 'a0') AS others
      FROM eps LEFT JOIN b USING (episode_id)""",
    "bimanual_split": src.as_cte("steps") + " SELECT episode_id, t, round(vals[1] + vals[2] + vals[3] + vals[5] + vals[6], 6) AS joint_sum, round(vals[4], 6) AS gripper_0, round(vals[7], 6) AS gripper_1 FROM steps WHERE grp = 'action' AND key = 'joint_velocity'",
}
