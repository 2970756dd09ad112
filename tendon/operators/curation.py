"""Joint names, camera roles, sizes, listings and source layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def joint_name_problems(profiles: DataFrame) -> DataFrame:
    """``(episode_id, problem, subject)`` from ``(episode_id, names)``: blank and repeated names, numbers that fall
    within one pattern of names, and grippers among the joints."""
    rows = profiles.select("episode_id", F.posexplode("names").alias("place", "name")).withColumn("low", F.lower(F.trim("name")))
    number = F.regexp_extract("low", r"([0-9]+)[^0-9]*$", 1).try_cast("int")
    rows = rows.withColumn("number", number).withColumn("pattern", F.regexp_replace("low", r"[0-9]+([^0-9]*)$", "#$1"))
    before = F.lag("number").over(Window.partitionBy("episode_id", "pattern").orderBy("place"))
    first = F.row_number().over(Window.partitionBy("episode_id", "low").orderBy("place"))
    rows = rows.withColumn("before", before).withColumn("seen", first)
    problem = F.filter(F.array(
        F.when(c("low") == "", "blank"), F.when((c("low") != "") & (c("seen") == 2), "duplicate"), F.when(c("number") < c("before"), "order"), F.when(c("low").contains("gripper"), "gripper_in_joints"),
    ), lambda x: x.isNotNull())
    return rows.select("episode_id", F.explode(problem).alias("problem"), c("name").alias("subject"))


def camera_roles(videos: DataFrame) -> DataFrame:
    """``(episode_id, wrist, exterior_1, exterior_2)``: the first wrist camera by name; the others left, right, then by
    name; the second falls back to the first."""
    wrist = F.lower("name").contains("wrist")
    side = F.when(F.lower("name").contains("left"), 0).when(F.lower("name").contains("right"), 1).otherwise(2)
    per = videos.groupBy("episode_id").agg(F.min(F.when(wrist, c("name"))).alias("wrist"), F.array_sort(F.collect_list(F.when(~wrist, F.struct(side.alias("s"), "name")))).alias("x"))
    at = lambda i: F.get("x", F.lit(i))["name"]
    return per.select("episode_id", "wrist", at(0).alias("exterior_1"), F.coalesce(at(1), at(0)).alias("exterior_2"))


def upload_sizes(episodes: DataFrame, steps: DataFrame, videos: DataFrame, most: int) -> DataFrame:
    """``(lab_id, episode_bytes, array_bytes, video_bytes, warn)``: a video file counts once, whoever refers to it."""
    lab = episodes.select("episode_id", "lab_id")
    files = episodes.groupBy("lab_id").agg(F.sum("size_bytes").alias("episode_bytes"))
    arrays = steps.groupBy("episode_id").agg(F.sum(8 * F.size("vals")).alias("b")).join(lab, "episode_id").groupBy("lab_id").agg(F.sum("b").alias("array_bytes"))
    once = videos.join(lab, "episode_id").groupBy("lab_id", "stored_path").agg(F.max("size_bytes").alias("b")).groupBy("lab_id").agg(F.sum("b").alias("video_bytes"))
    rows = files.join(arrays, "lab_id", "left").join(once, "lab_id", "left")
    total = c("episode_bytes") + F.coalesce("video_bytes", F.lit(0))
    return rows.select("lab_id", "episode_bytes", "array_bytes", "video_bytes", (total > most).alias("warn"))


def nan_summary(steps: DataFrame) -> DataFrame:
    """``(grp, key, nan_values, nan_steps, n_steps)`` over all episodes."""
    nans = F.size(F.filter("vals", F.isnan))
    return steps.groupBy("grp", "key").agg(F.sum(nans).cast("long").alias("nan_values"), F.count_if(nans > 0).alias("nan_steps"), F.count(F.lit(1)).alias("n_steps"))


def structure(steps: DataFrame) -> DataFrame:
    """``(episode_id, grp, key, n, width, n_bytes)``: what each episode holds."""
    return steps.groupBy("episode_id", "grp", "key").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vals")).alias("width"), F.sum(8 * F.size("vals")).cast("long").alias("n_bytes"))


def listing(episodes: DataFrame, ticks: DataFrame, others: DataFrame) -> DataFrame:
    """``(id, rel_path, mtime, tick, others)`` of all episodes by path; the id is the path with its slashes doubled into
    underscores. ``others`` has the episodes that somebody else annotated."""
    best = ticks.groupBy("episode_id").agg(F.max("tick").alias("tick"))
    seen = others.where("others").select("episode_id").distinct().withColumn("others", F.lit(True))
    rows = episodes.join(best, "episode_id", "left").join(seen, "episode_id", "left")
    rows = rows.select(F.regexp_replace("rel_path", "/", "__").alias("id"), "rel_path", "mtime", F.coalesce("tick", F.lit(0)).alias("tick"), F.coalesce("others", F.lit(False)).alias("others"))
    return rows.orderBy("rel_path")


def bimanual(steps: DataFrame, joints: tuple[int, ...], grippers: tuple[int, ...]) -> DataFrame:
    """``(episode_id, t, joints, grippers)``: one vector per step taken apart by place."""
    pick = lambda at: F.array(*(F.get("vals", F.lit(i)) for i in at))
    return steps.select("episode_id", "t", pick(joints).alias("joints"), pick(grippers).alias("grippers"))


def unwrapped(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds ``unwrapped``: angles without the jumps of a whole turn between neighbours."""
    import math

    w = Window.partitionBy(*keys).orderBy(order)
    step = c(value) - F.lag(value).over(w)
    turns = F.when(F.abs(step) > math.pi, -F.signum(step) * F.ceil((F.abs(step) - math.pi) / (2 * math.pi))).otherwise(0.0)
    rows = rows.withColumn("__turns", F.coalesce(turns, F.lit(0.0)))
    return rows.withColumn("unwrapped", c(value) + 2 * math.pi * F.sum("__turns").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__turns")
