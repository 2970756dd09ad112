"""Validation rules over the tables of a data set: every violation with its place in the order of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendon.functions.columns import finite, norm, resolved_path, safe_div
from tendon.operators.motion import union_all

c = F.col

# Limits of the rules.
SCHEMA = "episode_format_v1"
MIN_SECONDS, MAX_SECONDS = 1.0, 600.0
MIN_SIDE, MAX_SIDE = 180, 1280
MAX_DRIFT_SECONDS = 0.5
MAX_CRF = 19.0


def _of(rows: DataFrame, rules: list[tuple[int, str, Column]], subject: Column) -> DataFrame:
    found = F.filter(F.array(*(F.when(cond, F.struct(F.lit(n).alias("rule_order"), F.lit(rule).alias("rule"))) for n, rule, cond in rules)), lambda x: x.isNotNull())
    return rows.select("episode_id", subject.alias("subject"), F.explode(found).alias("x")).select("episode_id", "x.rule_order", "x.rule", "subject")


def metadata(episodes: DataFrame) -> DataFrame:
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    rate, seconds = c("control_freq"), safe_div(c("trajectory_length").cast("double"), c("control_freq"))
    good = finite(rate) & (rate > 0)
    return _of(episodes, [
        (1, "schema", c("schema") != SCHEMA),
        (9, "language_instruction", blank(c("language_instruction"))),
        (10, "lab_id", blank(c("lab_id")) | (c("lab_id") == "your_lab_id")),
        (11, "operator_name", blank(c("operator_name"))),
        (12, "control_freq", ~F.coalesce(good, F.lit(False))),
        (13, "duration", good & ((seconds < MIN_SECONDS) | (seconds > MAX_SECONDS))),
    ], F.lit(""))


def values(steps: DataFrame, episodes: DataFrame) -> DataFrame:
    """Rules on arrays: lengths, widths, numbers, unit quaternions, gripper values; one aggregation by episode and key."""
    bad = F.exists("vals", lambda v: ~finite(v))
    arms = F.sequence(F.lit(4), F.greatest(F.size("vals"), F.lit(4)), F.lit(7))  # where each arm's quaternion begins
    off = (c("key") == "cartesian_position") & (F.size("vals") % 7 == 0) & F.exists(arms, lambda at: F.abs(norm(F.slice("vals", at, 4)) - 1) > 1e-2)
    per = steps.groupBy("episode_id", "grp", "key").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vals")).alias("width"), F.min(F.when(bad, c("t"))).alias("first_bad"), F.count_if(off).alias("n_off"),
        F.count_if((c("key") == "gripper_binary") & F.exists("vals", lambda v: ~v.isin(0.0, 1.0))).alias("n_grip"),
    )
    arms = F.when(c("is_biarm"), 2).otherwise(1) if "is_biarm" in episodes.columns else F.lit(None).cast("int")
    per = per.join(episodes.select("episode_id", "trajectory_length", arms.alias("arms")), "episode_id")
    wrong = F.when(c("arms").isNull(), ~c("width").isin(7, 14)).otherwise(c("width") != 7 * c("arms"))
    return _of(per, [
        (14, "cartesian_width", (c("key") == "cartesian_position") & wrong),
        (16, "length", c("n") != c("trajectory_length")),
        (17, "not_finite", c("first_bad").isNotNull()),
        (18, "unit_quaternion", c("n_off") > 0),
        (19, "gripper_binary", (c("n_grip") > 0) | F.coalesce((c("key") == "gripper_binary") & (c("width") != c("arms")), F.lit(False))),
    ], F.concat_ws("/", "grp", "key"))


def bad_values(steps: DataFrame) -> DataFrame:
    """``(episode_id, grp, key, n_values, first_t, first_d, value)``: how many values aren't finite, and the first of them as text."""
    each = F.filter(F.transform("vals", lambda v, d: F.struct(d.alias("d"), v.alias("v"))), lambda x: ~finite(x["v"]))
    rows = steps.withColumn("bad", each).where(F.size("bad") > 0)
    per = rows.groupBy("episode_id", "grp", "key").agg(F.sum(F.size("bad")).alias("n_values"), F.min(F.struct("t", F.get("bad", F.lit(0)).alias("x"))).alias("first"))
    v = c("first.x.v")
    value = F.when(F.isnan(v), "nan").when(v > 0, "inf").otherwise("-inf")
    return per.select("episode_id", "grp", "key", "n_values", c("first.t").alias("first_t"), c("first.x.d").cast("long").alias("first_d"), value.alias("value"))


def bad_quaternions(steps: DataFrame, atol: float = 1e-2) -> DataFrame:
    """``(episode_id, grp, key, arm, n, first_t, norm)`` of arms whose quaternions aren't of length one, and the first such length."""
    rows = steps.where("key = 'cartesian_position' and size(vals) % 7 = 0 and size(vals) > 0")
    rows = rows.withColumn("arm", F.explode(F.sequence(F.lit(1), (F.size("vals") / 7).cast("int"))))
    rows = rows.withColumn("norm", norm(F.slice("vals", c("arm") * 7 - 3, F.lit(4)))).where(finite(c("norm")) & (F.abs(c("norm") - 1) > atol))
    per = rows.groupBy("episode_id", "grp", "key", "arm").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "norm")).alias("first"))
    return per.select("episode_id", "grp", "key", c("arm").cast("long").alias("arm"), "n", c("first.t").alias("first_t"), F.round("first.norm", 6).alias("norm"))


def declared(steps: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keys that are declared but not there, and there but not declared; ``wanted`` has ``(episode_id, grp, key)``."""
    have = steps.select("episode_id", "grp", "key").distinct()
    on = ["episode_id", "grp", "key"]
    subject = F.concat_ws("/", "grp", "key").alias("subject")
    missing = wanted.join(have, on, "left_anti").select("episode_id", F.lit(20).alias("rule_order"), F.lit("declared_missing").alias("rule"), subject)
    return missing.unionByName(have.join(wanted, on, "left_anti").select("episode_id", F.lit(21).alias("rule_order"), F.lit("not_declared").alias("rule"), subject))


def video(videos: DataFrame, episodes: DataFrame) -> DataFrame:
    """Rules on video references, sizes, frame counts and quality."""
    rows = videos.join(episodes.select("episode_id", "rel_path", "trajectory_length", "control_freq"), "episode_id")
    folder = F.regexp_replace("rel_path", "/[^/]*$", "")
    path = F.trim("stored_path")
    t = c("trajectory_length")
    drift = F.abs(c("frame_count") / F.when(c("fps") > 0, c("fps")) - safe_div(t.cast("double"), c("control_freq")))
    sides = F.least("width", "height"), F.greatest("width", "height")
    per = _of(rows, [
        (30, "video_reference_empty", path == ""),
        (31, "video_reference_absolute", path.startswith("/")),
        (32, "video_reference_escapes", (path != "") & ~path.startswith("/") & resolved_path(folder, path).isNull()),
        (33, "video_missing", ~c("file_exists")),
        (33, "video_header", ~F.coalesce((c("width") > 0) & (c("height") > 0) & (c("fps") > 0) & (c("frame_count") > 0), F.lit(False))),
        (34, "video_side", (sides[0] < MIN_SIDE) | (sides[1] > MAX_SIDE)),
        (35, "video_frames", F.abs(c("frame_count") - t) > F.greatest(F.lit(5), F.floor(0.1 * t))),
        (36, "video_duration", finite(c("control_freq")) & (c("control_freq") > 0) & (drift > MAX_DRIFT_SECONDS)),
        (38, "video_crf", c("crf").isNull() | (c("crf") > MAX_CRF)),
    ], c("name"))
    spread = videos.groupBy("episode_id").agg((F.max("frame_count") - F.min("frame_count")).alias("gap")).where("gap > 1")
    none = episodes.join(videos.select("episode_id"), "episode_id", "left_anti").select("episode_id", F.lit(29).alias("rule_order"), F.lit("no_video").alias("rule"), F.lit("").alias("subject"))
    return per.unionByName(none).unionByName(spread.select("episode_id", F.lit(37).alias("rule_order"), F.lit("video_lengths").alias("rule"), F.lit("").alias("subject")))


ADVISORY = ("video_crf",)


def violations(episodes: DataFrame, steps: DataFrame, videos: DataFrame) -> DataFrame:
    """``(episode_id, rule_order, rule, subject)`` of all rules."""
    return union_all(metadata(episodes), values(steps, episodes), video(videos, episodes))


def totals(results: DataFrame) -> DataFrame:
    """``(n, passed, failed)`` of verdicts; one row."""
    n = F.count(F.lit(1))
    return results.agg(n.alias("n"), F.count_if("passed").alias("passed"), (n - F.count_if("passed")).alias("failed"))


def write_results(results: DataFrame, at: str) -> None:
    """Verdicts as JSON lines; a folder that is there is refused."""
    results.write.mode("errorifexists").json(at)


def verdicts(found: DataFrame, episodes: DataFrame) -> DataFrame:
    """``(episode_id, passed, n_violations, first_rule)``; advice doesn't fail an episode."""
    own = found.where(~c("rule").isin(*ADVISORY)).groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("n_violations"), F.min(F.struct("rule_order", "rule", "subject")).alias("first")
    )
    rows = episodes.select("episode_id").join(own, "episode_id", "left")
    return rows.select("episode_id", c("n_violations").isNull().alias("passed"), F.coalesce("n_violations", F.lit(0)).alias("n_violations"), c("first.rule").alias("first_rule"))
