"""Checks of camera frames and of the motion beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendon.functions.columns import safe_div
from tendon.operators.config import DEFAULTS, Config
from tendon.operators.motion import metrics_of

c = F.col


def frame_stats(frames: DataFrame) -> DataFrame:
    """``(episode_id, camera, frame_idx, luma, diff, skip_diff)`` from gray pixels; frames are reduced before any join."""
    w = Window.partitionBy("episode_id", "camera").orderBy("frame_idx")
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    gap = lambda k: mean(F.zip_with(F.lead("pixels", k).over(w), c("pixels"), lambda a, b: F.abs(a - b)))
    return frames.select("episode_id", "camera", "frame_idx", mean(c("pixels")).alias("luma"), gap(1).alias("diff"), gap(2).alias("skip_diff"))


def corrupted_frames(stats: DataFrame, least: float = 20.0, ratio: float = 4.0) -> DataFrame:
    """``(episode_id, camera, frame_idx)``: frames unlike both neighbours, which are like each other."""
    w = Window.partitionBy("episode_id", "camera").orderBy("frame_idx")
    low = F.least(F.lag("diff").over(w), c("diff"))
    rows = stats.select("episode_id", "camera", "frame_idx", F.when(F.lag("diff").over(w).isNotNull() & c("diff").isNotNull(), low).alias("low"), F.lag("skip_diff").over(w).alias("around"))
    return rows.where((c("low") >= least) & (c("low") >= ratio * (c("around") + 1))).select("episode_id", "camera", "frame_idx")


def video_jumps(stats: DataFrame, window: int = 10, least: float = 40.0, ratio: float = 20.0) -> DataFrame:
    """``(episode_id, camera, frame_idx)``: frames that differ from the last by far more than those around."""
    w = Window.partitionBy("episode_id", "camera").orderBy("frame_idx")
    around = F.concat(F.collect_list("diff").over(w.rowsBetween(-window, -1)), F.collect_list("diff").over(w.rowsBetween(1, window)))
    rows = stats.withColumn("s", F.array_sort(around)).withColumn("n", F.size("s"))
    middle = (F.expr("get(s, int((n - 1) / 2))") + F.expr("get(s, int(n / 2))")) / 2
    return rows.where((c("n") > 0) & (c("diff") >= least) & (c("diff") >= ratio * (middle + 1))).select("episode_id", "camera", "frame_idx")


def longest_run(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """``(keys, longest)``: the longest run of rows for which the flag holds; 0 without any."""
    w = Window.partitionBy(*keys).orderBy(order)
    runs = rows.withColumn("__g", F.sum(F.when(~c(flag), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = runs.groupBy(*keys, "__g").agg(F.count_if(c(flag)).alias("k"))
    return per.groupBy(*keys).agg(F.max("k").alias("longest"))


def brightness(stats: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """``(episode_id, camera, median, share_extreme, problem)`` of cameras that are dark, bright or often either."""
    own = config["video"]["brightness"]
    extreme = (c("luma") < own["dark_frame"]) | (c("luma") > own["bright_frame"])
    per = stats.groupBy("episode_id", "camera").agg(F.percentile("luma", F.lit(0.5)).alias("m"), F.avg(extreme.cast("double")).alias("x"))
    problem = F.when(c("m") < own["dark_median"], "dark").when(c("m") > own["bright_median"], "bright").when(c("x") >= own["extreme_frame_fraction"], "extremes")
    return per.select("episode_id", "camera", F.round("m", 6).alias("median"), F.round("x", 6).alias("share_extreme"), problem.alias("problem")).where("problem is not null")


def containers(videos: DataFrame, episodes: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Findings on decoding, resolution, rate and duration, by camera."""
    own = config["video"]
    rows = videos.join(episodes.select("episode_id", "trajectory_length", "control_freq"), "episode_id").withColumn("key", c("name"))
    rate = c("control_freq")
    good = ~F.isnan(rate) & (rate > 0)
    wanted = safe_div(c("trajectory_length").cast("double"), rate)
    seconds = c("decoded_frames") / c("fps")
    short = F.least("width", "height")
    lost = F.abs(c("decoded_frames") - c("frame_count")) > own["decoding"]["max_frame_count_diff"]
    return metrics_of(rows, [
        ("decoding", ~c("file_exists") | (c("decoded_frames") == 0) | (c("returncode") != 0) | lost, c("decoded_frames")),
        ("resolution", (short > 0) & (short < own["resolution"]["min_short_side"]), short),
        ("fps", good & (F.abs(c("fps") - rate) > own["fps"]["fps_rel_tol"] * rate), c("fps")),
        ("duration", good & (F.abs(seconds - wanted) > F.greatest(F.lit(own["duration"]["duration_tol_s"]), own["duration"]["duration_rel_tol"] * wanted)), seconds),
    ])


def camera_durations(videos: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """``(episode_id, gap)`` of episodes whose cameras last differently by more than the tolerance."""
    seconds = c("decoded_frames") / c("fps")
    per = videos.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"), (F.max(seconds) - F.min(seconds)).alias("gap"))
    return per.where((c("n") > 1) & (c("gap") > config["video"]["camera_duration_mismatch"]["duration_tol_s"])).select("episode_id", F.round("gap", 6).alias("gap"))


def state_steps(steps: DataFrame) -> DataFrame:
    """``(episode_id, t, step, moving)``: how far all states but the gripper's went, each in its own spread.

    Changes are arrays, one window per key; only the spreads are aggregated by dimension.
    """
    rows = steps.where("grp = 'state' and key not like 'gripper%'").select("episode_id", "key", "t", "vals").repartition("episode_id", "key")
    cells = rows.select("episode_id", "key", F.posexplode("vals").alias("d", "v"))
    spread = cells.groupBy("episode_id", "key", "d").agg(F.stddev_pop("v").alias("sd"))
    spread = spread.groupBy("episode_id", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "sd"))), lambda x: x["sd"]).alias("sds"))
    before = F.lag("vals").over(Window.partitionBy("episode_id", "key").orderBy("t"))
    moved = rows.withColumn("move", F.zip_with("vals", before, lambda a, b: a - b)).where("move is not null").join(spread, ["episode_id", "key"])
    scaled = F.zip_with("move", "sds", lambda m, sd: m / F.when(sd > 1e-9, sd).otherwise(1.0))
    sq = F.aggregate(scaled, F.lit(0.0), lambda a, v: a + v * v)
    per = moved.select("episode_id", "t", sq.alias("sq")).repartition("episode_id").groupBy("episode_id", "t").agg(F.sqrt(F.sum("sq")).alias("step"))
    top = per.groupBy("episode_id").agg(F.percentile("step", F.lit(0.95)).alias("p95"))
    rows = per.join(top, "episode_id")
    return rows.select("episode_id", "t", F.round("step", 6).alias("step"), ((c("p95") > 0) & (c("step") > 0.1 * c("p95"))).alias("moving"))


def state_jumps(moves: DataFrame, around: int = 10, factor: float = 4.0) -> DataFrame:
    """``(episode_id, t)``: single steps far above the mean of those within ``around``, with no such step beside them."""
    w = Window.partitionBy("episode_id").orderBy("t")
    sums = lambda x: F.coalesce(F.sum(x).over(w.rowsBetween(-around, -1)), F.lit(0.0)) + F.coalesce(F.sum(x).over(w.rowsBetween(1, around)), F.lit(0.0))
    rows = moves.withColumn("mean", sums(c("step")) / F.greatest(sums(F.lit(1.0)), F.lit(1.0)))
    rows = rows.withColumn("jump", c("step") >= factor * c("mean"))
    alone = ~F.coalesce(F.lag("jump").over(w), F.lit(False)) & ~F.coalesce(F.lead("jump").over(w), F.lit(False))
    return rows.withColumn("alone", alone).where("jump and alone").select("episode_id", "t")
