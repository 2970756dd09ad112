"""Registered queries of the video checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendon.operators import video
from tendon.sources import episodes as src


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 64 pixels: the embeddings of a label in order are one camera's frames, every seventh one is scrambled."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    base = F.transform("embedding", lambda v: F.round(v.cast("double") * 20 + 128 + F.when(F.col("vec_id") % 7 == 3, 90.0).otherwise(0.0), 3))
    return rows.select(F.col("label").cast("long").alias("episode_id"), F.lit("front").alias("camera"), F.col("vec_id").alias("frame_idx"), base.alias("pixels"))


def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = video.frame_stats(_frames(spark, sf_dir))
    return rows.select("episode_id", "camera", "frame_idx", *(F.round(x, 9).alias(x) for x in ("luma", "diff", "skip_diff")))


def corrupted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.corrupted_frames(video.frame_stats(_frames(spark, sf_dir)), least=20.0, ratio=2.0)


def video_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.video_jumps(video.frame_stats(_frames(spark, sf_dir)), window=5, ratio=1.5)


def frame_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = video.frame_stats(_frames(spark, sf_dir)).withColumn("still", F.coalesce(F.col("diff") < 60, F.lit(False)))
    return video.longest_run(rows, ["episode_id", "camera"], "frame_idx", "still")


def brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frames(spark, sf_dir).withColumn("pixels", F.transform("pixels", lambda v: v * F.when(F.col("episode_id") % 3 == 0, 0.1).when(F.col("episode_id") % 3 == 1, 1.9).otherwise(1.0)))
    return video.brightness(video.frame_stats(rows))


def video_container_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.containers(src.videos(spark, sf_dir), src.episodes(spark, sf_dir))


def camera_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.camera_durations(src.videos(spark, sf_dir))


def state_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.state_steps(src.steps(spark, sf_dir, groups=("state",)))


def state_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.state_jumps(video.state_steps(src.steps(spark, sf_dir, groups=("state",))), factor=1.6)


_S = """WITH f AS (SELECT label::BIGINT AS e, vec_id AS i, list_transform(embedding, lambda v: round(v::DOUBLE * 20 + 128 + CASE WHEN vec_id % 7 = 3 THEN 90 ELSE 0 END, 3)) AS p FROM embeddings),
  g AS (SELECT e, i, p, lead(p) OVER w AS n1, lead(p, 2) OVER w AS n2 FROM f WINDOW w AS (PARTITION BY e ORDER BY i)),
  s AS (SELECT e AS episode_id, 'front' AS camera, i AS frame_idx, list_avg(p) AS luma, CASE WHEN n1 IS NOT NULL THEN list_avg(list_transform(list_zip(p, n1), lambda z: abs(z[1] - z[2]))) END AS diff,
    CASE WHEN n2 IS NOT NULL THEN list_avg(list_transform(list_zip(p, n2), lambda z: abs(z[1] - z[2]))) END AS skip_diff FROM g)"""
_M = src.as_cte("steps") + """, c AS (SELECT episode_id, key, t, unnest(range(1, len(vals) + 1)) AS d, vals FROM steps WHERE grp = 'state' AND key NOT LIKE 'gripper%'),
  m AS (SELECT episode_id, key, d, t, vals[d] AS v, stddev_pop(vals[d]) OVER (PARTITION BY episode_id, key, d) AS sd, vals[d] - lag(vals[d]) OVER (PARTITION BY episode_id, key, d ORDER BY t) AS mv FROM c),
  p AS (SELECT episode_id, t, sqrt(sum((mv / CASE WHEN sd > 1e-9 THEN sd ELSE 1 END) ** 2)) AS step FROM m WHERE mv IS NOT NULL GROUP BY ALL),
  q AS (SELECT episode_id, quantile_cont(step, 0.95) AS p95 FROM p GROUP BY ALL),
  r AS (SELECT episode_id, t, round(step, 6) AS step, p95 > 0 AND step > 0.1e0 * p95 AS moving FROM p JOIN q USING (episode_id))"""
_C = src.as_cte("episodes", "videos") + """, v AS (SELECT v.*, trajectory_length AS n, control_freq AS r, NOT isnan(control_freq) AND control_freq > 0 AS good, decoded_frames / fps AS s,
    CASE WHEN control_freq > 0 THEN trajectory_length / control_freq ELSE 'inf'::DOUBLE END AS w FROM videos v JOIN episodes USING (episode_id))"""

QUERIES = {f.__name__: f for f in (frame_stats, corrupted_frames, video_jumps, frame_runs, brightness, video_container_checks, camera_durations, state_steps, state_jumps)}
ORACLE_SQL = {
    "frame_stats": _S + " SELECT episode_id, camera, frame_idx, round(luma, 9) AS luma, round(diff, 9) AS diff, round(skip_diff, 9) AS skip_diff FROM s",
    "corrupted_frames": _S + """, l AS (SELECT *, lag(diff) OVER w AS before, lag(skip_diff) OVER w AS around FROM s WINDOW w AS (PARTITION BY episode_id, camera ORDER BY frame_idx))
      SELECT episode_id, camera, frame_idx FROM l WHERE before >= 20 AND diff >= 20 AND least(before, diff) >= 2 * (around + 1)""",
    "video_jumps": _S + """, l AS (SELECT *, list_concat(coalesce(list(diff) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []), coalesce(list(diff) OVER (PARTITION BY episode_id ORDER BY frame_idx
        ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), [])) AS a FROM s) SELECT episode_id, camera, frame_idx FROM l WHERE diff >= 40 AND diff >= 1.5e0 * (list_median(list_filter(a, lambda x: x IS NOT NULL)) + 1)""",
    "frame_runs": _S + """, b AS (SELECT *, coalesce(diff < 60, false) AS still FROM s), h AS (SELECT *, sum((NOT still)::INT) OVER (PARTITION BY episode_id, camera ORDER BY frame_idx) AS g FROM b),
      k AS (SELECT episode_id, camera, g, count(*) FILTER (still) AS k FROM h GROUP BY ALL) SELECT episode_id, camera, max(k) AS longest FROM k GROUP BY ALL""",
    "brightness": _S + """, b AS (SELECT episode_id, camera, luma * CASE episode_id % 3 WHEN 0 THEN 0.1e0 WHEN 1 THEN 1.9e0 ELSE 1e0 END AS luma FROM s),
      p AS (SELECT episode_id, camera, quantile_cont(luma, 0.5) AS m, avg((luma < 15 OR luma > 240)::INT) AS x FROM b GROUP BY ALL),
      q AS (SELECT episode_id, camera, round(m, 6) AS median, round(x, 6) AS share_extreme, CASE WHEN m < 30 THEN 'dark' WHEN m > 225 THEN 'bright' WHEN x >= 0.1e0 THEN 'extremes' END AS problem FROM p) SELECT * FROM q WHERE problem IS NOT NULL""",
    "video_container_checks": _C + " " + " UNION ALL ".join(f"SELECT episode_id, '{n}' AS check_name, name AS key, round({m}::DOUBLE, 6) AS metric FROM v WHERE {w}" for n, w, m in [
        ("decoding", "NOT file_exists OR decoded_frames = 0 OR returncode <> 0 OR abs(decoded_frames - frame_count) > 1", "decoded_frames"), ("resolution", "least(width, height) > 0 AND least(width, height) < 360", "least(width, height)"),
        ("fps", "good AND abs(fps - r) > 0.05e0 * r", "fps"), ("duration", "good AND abs(s - w) > greatest(0.5e0, 0.05e0 * w)", "s")]),
    "camera_durations": src.as_cte("videos") + " SELECT episode_id, round(max(decoded_frames / fps) - min(decoded_frames / fps), 6) AS gap FROM videos GROUP BY ALL HAVING count(*) > 1 AND max(decoded_frames / fps) - min(decoded_frames / fps) > 0.5e0",
    "state_steps": _M + " SELECT * FROM r",
    "state_jumps": _M + """, a AS (SELECT *, sum(step) OVER w1 AS s1, sum(step) OVER w2 AS s2, count(*) OVER w1 + count(*) OVER w2 AS k FROM r WINDOW w1 AS (PARTITION BY episode_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
        w2 AS (PARTITION BY episode_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)), j AS (SELECT *, step >= 1.6e0 * ((coalesce(s1, 0) + coalesce(s2, 0)) / greatest(k, 1)) AS jump FROM a),
      l AS (SELECT *, coalesce(lag(jump) OVER w, false) AS b, coalesce(lead(jump) OVER w, false) AS f FROM j WINDOW w AS (PARTITION BY episode_id ORDER BY t)) SELECT episode_id, t FROM l WHERE jump AND NOT b AND NOT f""",
}
