"""Registered queries of conversions, names, copies and exports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendon.jobs import dataset_queries
from tendon.operators import annotations as ann
from tendon.operators import collections_ as col
from tendon.operators import conversion as conv
from tendon.sources import episodes as src
from tendon.sources.episodes import for_engine

_PATH = "concat('robot', CAST(e % 3 AS VARCHAR(9)), '/Pick UP, it!/', CASE e % 4 WHEN 0 THEN 'octo' ELSE 'my-policy' END, '/day', CAST(e % 5 AS VARCHAR(9)), CASE WHEN e % 2 = 0 THEN '/success/traj' ELSE '/failure/traj' END, CAST(e AS VARCHAR(20)))"
_TRAJ = f"""SELECT * FROM (WITH u AS (SELECT user_id AS e, count(*) AS k FROM {{events}} GROUP BY user_id) SELECT CASE WHEN e % 17 = 3 THEN concat('robot1/traj', CAST(e AS VARCHAR(20))) ELSE {_PATH} END AS path,
    CASE WHEN e % 13 = 4 THEN 9 ELSE k END AS n, CASE WHEN e % 2 = 0 THEN ' True ' ELSE 'false' END AS success_text, ' do it ' AS instruction, e FROM u) AS derived"""
_POSES = """SELECT * FROM (WITH b AS (SELECT user_id AS e, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t FROM {events})
    SELECT CAST(e AS VARCHAR(20)) AS path, t, ARR(0.01e0 * t, 0.02e0 * t, 0.3e0, 0.1e0 * (t % 7), -0.05e0 * (t % 5), 0.03e0 * (e % 9), 1e0 * (t % 2)) AS pose, ARR(0.001e0, 0.002e0, 0e0, 0.01e0, 0e0, 0e0, 9e0) AS delta FROM b) AS derived"""
_SESSIONS = """SELECT * FROM (SELECT conv_id AS session, concat('LEFT"language_instruction": "task ', CAST(conv_id % 7 AS VARCHAR(9)), '", "policies": LEFT"B": LEFT"policy_name": "p', CAST(conv_id % 3 AS VARCHAR(9)), '", "binary_success": ',
      CASE WHEN conv_id % 2 = 0 THEN '1' ELSE '0' END, 'RIGHT', CASE WHEN conv_id % 4 = 1 THEN ', "A": LEFT"policy_name": "first", "binary_success": 0.5RIGHT' ELSE '' END, 'RIGHTRIGHT') AS metadata FROM {conversations} GROUP BY conv_id) AS derived"""
_FILES = """SELECT * FROM (SELECT conv_id AS session, CASE WHEN turn % 2 = 0 THEN 'A' ELSE 'B' END AS letter, CASE turn % 4 WHEN 0 THEN 'wrist' WHEN 1 THEN 'left' WHEN 2 THEN 'left' ELSE 'wrist' END AS camera FROM {conversations} WHERE conv_id % 5 <> 2) AS derived"""
_ITEMS = """SELECT * FROM (WITH u AS (SELECT user_id AS e FROM {events} GROUP BY user_id) SELECT concat('t', CAST(e AS VARCHAR(20))) AS path, CASE WHEN e % 7 = 3 THEN 'exists' WHEN e % 11 = 5 THEN 'failed' WHEN e % 5 = 1 THEN 'skipped' ELSE 'written' END AS outcome FROM u) AS derived"""
_LISTED = """SELECT * FROM (WITH u AS (SELECT user_id AS e FROM {events} GROUP BY user_id) SELECT concat('lab', CAST(e % 5 AS VARCHAR(9)), '/ep', CAST(e AS VARCHAR(20)), CASE e % 5 WHEN 0 THEN '.h5' WHEN 1 THEN '.H5' WHEN 2 THEN '.hdf5' WHEN 3 THEN '.mp4' ELSE '.h5.tmp' END) AS path FROM u) AS derived"""


def _spark(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    for t in tables:
        sql = sql.replace("{" + t + "}", f"\0{t}\1")
    sql = sql.replace("{", "{{").replace("}", "}}").replace("\0", "{").replace("\1", "}").replace("LEFT", "{{").replace("RIGHT", "}}")
    return spark.sql(for_engine(sql, "array"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def _duck(sql: str) -> str:
    for t in ("events", "conversations"):
        sql = sql.replace("{" + t + "}", t)
    return for_engine(sql, "list_value").replace("LEFT", "{").replace("RIGHT", "}")


def converted_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.trajectories(_spark(spark, sf_dir, _TRAJ, "events"), 15.0, "robot1")


def converted_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conv.converted_steps(_spark(spark, sf_dir, _POSES, "events"))
    at = lambda x, i: F.round(F.get(x, F.lit(i)), 6)
    return rows.select("path", "t", *(at("target", i).alias(a) for i, a in enumerate(("x", "y", "z", "qx", "qy", "qz", "qw"))), at("state", 3).alias("state_qx"), at("held", 0).alias("held"), at("grip", 0).alias("grip"))


def policy_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.policy_episodes(_spark(spark, sf_dir, _SESSIONS, "conversations"), _spark(spark, sf_dir, _FILES, "conversations"))


def step_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from the numbers of embeddings."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    part = lambda at, n: F.slice("embedding", at, n)
    rows = conv.step_arrays(e.select("vec_id", part(1, 7).alias("joint_position"), part(8, 1).alias("gripper_position"), part(9, 6).alias("cartesian_position"), part(15, 8).alias("action")))
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6).alias(x)
    return rows.select("vec_id", *(total(x) for x in ("joint_position", "gripper_position", "cartesian_position", "joint_velocity", "gripper_action")), F.size("joint_velocity").alias("width"))


def conversion_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.batch(_spark(spark, sf_dir, _ITEMS, "events"), 100, 60)


def conversion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.batch_counts(conversion_batch(spark, sf_dir))


def resized_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.resized(src.videos(spark, sf_dir))


def recording_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings begin with events; a hundred seconds count as one here, so that names meet."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return conv.second_names(e.select((F.col("user_id") % 5).alias("session"), F.col("event_id").alias("event"), F.date_trunc("minute", "ts").alias("ts")))


_VIDEOS = "SELECT episode_id, name, concat('lab', CAST(episode_id % 5 AS VARCHAR(9))) AS dir, concat('ep', CAST(episode_id % 4 AS VARCHAR(9)), CASE WHEN episode_id % 9 = 5 THEN '_front_2' ELSE '' END) AS stem, concat(CAST(episode_id % 6 AS VARCHAR(9)), '/', name) AS source, episode_id AS place FROM {videos}"


def video_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.video_names(spark.sql(_VIDEOS, videos=src.videos(spark, sf_dir)))


def split_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.split_references(src.episodes(spark, sf_dir), src.videos(spark, sf_dir), 4)


def copy_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.copy_sizes(src.episodes(spark, sf_dir), src.videos(spark, sf_dir))


def submission_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.submissions(src.episodes(spark, sf_dir), src.videos(spark, sf_dir))


def inventory_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.episodes(spark, sf_dir)
    return conv.inventory_difference(e.where("episode_id % 7 <> 3"), e.where("episode_id % 5 <> 1"))


def discovered_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.discovered(_spark(spark, sf_dir, _LISTED, "events"))


def video_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.videos(spark, sf_dir).select("episode_id", "ref_group", "name", conv.reference(F.col("stored_path")).alias("reference"))


def annotation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_queries._rows(spark, sf_dir)


def training_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested episodes, told by sums over their steps; annotators are those of the documents with the episodes' numbers."""
    rows = conv.training_episodes(src.steps(spark, sf_dir).where("key in ('joint_position', 'gripper_position')"), src.episodes(spark, sf_dir), ann.consensus(dataset_queries._rows(spark, sf_dir)))
    total = lambda f: F.round(F.aggregate("steps", F.lit(0.0), lambda a, s: a + F.aggregate(s[f], F.lit(0.0), lambda x, v: x + v)), 4).alias(f)
    flags = F.size(F.filter("steps", lambda s: s["is_first"] | s["is_last"])).alias("ends")
    return rows.select("episode_id", "path", "n", "problem", *(F.when(F.col("steps").isNotNull(), x).alias(n) for n, x in (("joints", total("joints")), ("command", total("command")), ("ends", flags))))


def rollout_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dataset_queries._rollouts(spark, sf_dir)
    return conv.rollout_results(col.evaluation(rows), rows.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n")), 10.0)


def rollout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.rollout_summary(col.evaluation(dataset_queries._rollouts(spark, sf_dir)), 4)


_SLUG = lambda x: f"CASE WHEN trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'x' ELSE trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_') END"
_H = lambda f, a: f"{f}({a} / 2)"
_EULER = lambda p: [  # noqa: E731  extrinsic x, y, z
    f"(sin({p}[4] / 2) * cos({p}[5] / 2) * cos({p}[6] / 2) - cos({p}[4] / 2) * sin({p}[5] / 2) * sin({p}[6] / 2))", f"(cos({p}[4] / 2) * sin({p}[5] / 2) * cos({p}[6] / 2) + sin({p}[4] / 2) * cos({p}[5] / 2) * sin({p}[6] / 2))",
    f"(cos({p}[4] / 2) * cos({p}[5] / 2) * sin({p}[6] / 2) - sin({p}[4] / 2) * sin({p}[5] / 2) * cos({p}[6] / 2))", f"(cos({p}[4] / 2) * cos({p}[5] / 2) * cos({p}[6] / 2) + sin({p}[4] / 2) * sin({p}[5] / 2) * sin({p}[6] / 2))"]
_Q = _EULER("g")
_BATCH = f"WITH i AS ({_duck(_ITEMS)}), b AS (SELECT *, row_number() OVER (ORDER BY path) - 1 + 100 AS k, coalesce(sum((outcome = 'written')::INT) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i)"

QUERIES = {f.__name__: f for f in (
    converted_trajectories, converted_steps, policy_episodes, step_arrays, conversion_batch, conversion_counts, resized_videos, recording_names, video_names, split_references, copy_sizes, submission_inventory,
    inventory_difference, discovered_episodes, video_references, annotation_rows, training_episodes, rollout_results, rollout_summary,
)}
ORACLE_SQL = {
    "converted_trajectories": f"""WITH s AS ({_duck(_TRAJ)}), f AS (SELECT *, string_split(path, '/') AS parts FROM s WHERE list_contains(string_split(path, '/'), 'robot1'))
      SELECT path, concat('soar_', lpad((row_number() OVER (ORDER BY path) - 1)::VARCHAR, 6, '0'), '_', array_to_string(list_transform(parts, lambda x: {_SLUG("x")}), '_')) AS episode_id, CASE WHEN len(parts) >= 5 THEN parts[3] ELSE 'soar' END AS policy,
        CASE WHEN lower(trim(success_text)) = 'true' THEN 1e0 ELSE 0e0 END AS success, 'do it' AS instruction, CASE WHEN n / 15 < 1 OR n / 15 > 600 THEN 'skipped' ELSE 'written' END AS status FROM f""",
    "converted_steps": f"""WITH p AS ({_duck(_POSES)}), n AS (SELECT *, lead(pose) OVER (PARTITION BY path ORDER BY t) AS nx FROM p), g AS (SELECT path, t, pose, coalesce(nx[1:6], list_transform(list_zip(pose[1:6], delta[1:6]), lambda z: z[1] + z[2])) AS g, coalesce(nx, pose)[7] AS grip FROM n)
      SELECT path, t, round(g[1], 6) AS x, round(g[2], 6) AS y, round(g[3], 6) AS z, {", ".join(f"round({q}, 6) AS {a}" for q, a in zip(_Q, ("qx", "qy", "qz", "qw")))}, round({_EULER("pose")[0]}, 6) AS state_qx, round(pose[7], 6) AS held, round(grip, 6) AS grip FROM g""",
    "policy_episodes": f"""WITH s AS ({_duck(_SESSIONS)}), f AS ({_duck(_FILES)}), p AS (SELECT session, metadata::JSON AS m, unnest(json_keys(metadata::JSON->'$.policies')) AS letter FROM s),
      c AS (SELECT session, letter, array_to_string(list_filter(['left', 'right', 'wrist'], lambda x: list_contains(list(camera), x)), ',') AS cameras FROM f GROUP BY ALL)
      SELECT session, letter, m->>('$.policies.' || letter || '.policy_name') AS policy_name, CAST(m->>('$.policies.' || letter || '.binary_success') AS DOUBLE) AS success, m->>'$.language_instruction' AS instruction, coalesce(cameras, '') AS cameras,
        CASE WHEN coalesce(cameras, '') = '' THEN 'skipped' ELSE 'written' END AS status FROM p LEFT JOIN c USING (session, letter)""",
    "step_arrays": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings) SELECT vec_id, round(list_sum(e[1:7]), 6) AS joint_position, round(e[8], 6) AS gripper_position, round(list_sum(e[9:14]), 6) AS cartesian_position,
      round(list_sum(e[15:21]), 6) AS joint_velocity, round(e[22], 6) AS gripper_action, 7::INT AS width FROM e""",
    "conversion_batch": _BATCH + " SELECT path, concat('episode_', lpad(k::VARCHAR, 6, '0')) AS episode_id, outcome AS status FROM b WHERE before < 60",
    "conversion_counts": _BATCH + " SELECT outcome AS status, count(*) AS n FROM b WHERE before < 60 GROUP BY outcome",
    "resized_videos": src.as_cte("videos") + """, r AS (SELECT episode_id, name, CASE WHEN greatest(width, height) <= 1280 THEN width ELSE floor(width * (1280e0 / greatest(width, height)))::INT END AS new_width,
      CASE WHEN greatest(width, height) <= 1280 THEN height ELSE floor(height * (1280e0 / greatest(width, height)))::INT END AS new_height FROM videos) SELECT *, CASE WHEN least(new_width, new_height) < 180 THEN 'too_small' ELSE '' END AS problem FROM r""",
    "recording_names": """WITH r AS (SELECT user_id % 5 AS session, event_id AS event, strftime(date_trunc('minute', ts), '%Y%m%d_%H%M%S') AS s, row_number() OVER (PARTITION BY user_id % 5, date_trunc('minute', ts) ORDER BY event_id) AS k FROM events)
      SELECT session, event, CASE WHEN k > 1 THEN concat(s, '_', k) ELSE s END AS name FROM r""",
    "video_names": src.as_cte("videos") + f""", v AS ({_VIDEOS.replace("{videos}", "videos")}), o AS (SELECT dir, concat(stem, '_', name) AS base, source, min(place) AS first FROM v GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY dir, base ORDER BY first, source) AS k FROM o), n AS (SELECT dir, source, concat(base, CASE WHEN k > 1 THEN concat('_', k) ELSE '' END, '.mp4') AS new_name FROM k)
      SELECT *, count(*) OVER (PARTITION BY dir, new_name) > 1 AS collides FROM n""",
    "split_references": src.as_cte("episodes", "videos") + """, d AS (SELECT episode_id, rel_path, regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(rel_path, '([^/]*)$', 1) AS file FROM episodes),
      k AS (SELECT *, count(*) OVER (PARTITION BY dir) AS n, (((row_number() OVER (PARTITION BY dir ORDER BY rel_path) - 1) // 4) * 4)::VARCHAR AS k FROM d)
      SELECT rel_path, CASE WHEN n > 4 THEN concat(dir, '/', CASE WHEN length(k) >= 3 THEN k ELSE lpad(k, 3, '0') END, '/', file) ELSE rel_path END AS new_path, name,
        CASE WHEN n > 4 AND trim(stored_path) <> '' AND NOT starts_with(trim(stored_path), '/') THEN concat('../', trim(stored_path)) ELSE trim(stored_path) END AS new_reference FROM k JOIN videos USING (episode_id)""",
    "copy_sizes": src.as_cte("episodes", "videos") + """, t AS (SELECT lab_id, sum(size_bytes)::BIGINT AS tree_bytes FROM episodes GROUP BY lab_id),
      o AS (SELECT lab_id, sum(b)::BIGINT AS outside_bytes FROM (SELECT lab_id, trim(stored_path) AS p, max(v.size_bytes) AS b FROM videos v JOIN episodes USING (episode_id) WHERE stored_path LIKE '/%' OR stored_path LIKE '../../../%' GROUP BY ALL) GROUP BY lab_id)
      SELECT lab_id, tree_bytes, coalesce(outside_bytes, 0) AS outside_bytes FROM t LEFT JOIN o USING (lab_id)""",
    "submission_inventory": src.as_cte("episodes", "videos") + """, e AS (SELECT *, split_part(rel_path, '/', 1) AS folder FROM episodes), o AS (SELECT folder, count(*) AS episodes, sum(size_bytes) AS b FROM e GROUP BY folder),
      s AS (SELECT folder, count(*) AS videos, sum(s) AS v FROM (SELECT folder, stored_path, max(videos.size_bytes) AS s FROM videos JOIN e USING (episode_id) WHERE trim(stored_path) <> '' GROUP BY ALL) GROUP BY folder)
      SELECT folder, episodes, coalesce(videos, 0) AS videos, (b + coalesce(v, 0))::BIGINT AS bytes FROM o LEFT JOIN s USING (folder)""",
    "inventory_difference": src.as_cte("episodes") + """ SELECT split_part(rel_path, '/', 1) AS folder, count(*) FILTER (episode_id % 7 <> 3) AS local, count(*) FILTER (episode_id % 5 <> 1) AS remote, count(*) FILTER (episode_id % 7 <> 3 AND episode_id % 5 = 1) AS missing
      FROM episodes WHERE episode_id % 7 <> 3 OR episode_id % 5 <> 1 GROUP BY 1""",
    "discovered_episodes": f"WITH f AS ({_duck(_LISTED)}) SELECT path FROM f WHERE regexp_matches(lower(path), '\\.(h5|hdf5)$') ORDER BY path",
    "video_references": src.as_cte("videos") + " SELECT episode_id, ref_group, name, CASE WHEN trim(stored_path) <> '' THEN trim(stored_path) END AS reference FROM videos",
    "annotation_rows": dataset_queries._A + " SELECT * FROM an",
    "training_episodes": dataset_queries._A + ", " + src.as_cte("steps", "episodes").removeprefix("WITH ") + """, g AS (SELECT episode_id, count(success) AS n, count(*) FILTER (success IS NOT NULL AND NOT coalesce(v IN (0, 1), false)) AS bad, min(v) AS lo, max(v) AS hi FROM j GROUP BY ALL),
      lb AS (SELECT episode_id, CASE WHEN n = 0 THEN 'none' WHEN bad > 0 THEN 'invalid' WHEN lo <> hi THEN 'conflict' WHEN lo = 1 THEN '1' ELSE '0' END AS verdict FROM g),
      s AS (SELECT * FROM steps WHERE key IN ('joint_position', 'gripper_position')), ct AS (SELECT episode_id, min(k) <> max(k) AS uneven FROM (SELECT episode_id, grp, key, count(*) AS k FROM s GROUP BY ALL) GROUP BY episode_id),
      o AS (SELECT episode_id, count(DISTINCT t) AS n, sum(list_sum(vals)) FILTER (grp = 'state' AND key = 'joint_position') AS joints, sum(list_sum(vals)) FILTER (grp = 'action' AND key = 'joint_position') AS command FROM s GROUP BY episode_id),
      r AS (SELECT *, CASE WHEN uneven THEN 'lengths' WHEN verdict IS NULL OR verdict NOT IN ('0', '1') THEN 'no_consensus' ELSE '' END AS problem FROM o JOIN ct USING (episode_id) JOIN episodes USING (episode_id) LEFT JOIN lb USING (episode_id))
      SELECT episode_id, concat_ws('/', CASE verdict WHEN '1' THEN 'success' WHEN '0' THEN 'failure' END, rel_path) AS path, n, problem, CASE WHEN problem = '' THEN round(joints, 4) END AS joints, CASE WHEN problem = '' THEN round(command, 4) END AS command,
        CASE WHEN problem = '' THEN 2 END AS ends FROM r""",
    "rollout_results": dataset_queries._ROLL + ", n AS (SELECT episode_id, count(*) AS n FROM r GROUP BY ALL) SELECT coalesce(highest, 0) >= 4 AS success, round(n / 10e0, 6) AS duration, concat('rollout_', episode_id, '.mp4') AS video_filename FROM p JOIN n USING (episode_id)",
    "rollout_summary": dataset_queries._ROLL + " SELECT count(*) AS n, round(avg(CASE WHEN highest = 4 THEN 1e0 ELSE 0e0 END), 6) AS success_rate, round(avg(total), 6) AS average_return FROM p",
}
