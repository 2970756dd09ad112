"""Conversion of recordings from other layouts, batches of conversions, names, copies and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendon.functions.columns import resolved_path, slug
from tendon.functions.numbering import running
from tendon.functions.rotations import to_quaternion

c = F.col

# Limits of episodes and images.
MIN_SECONDS, MAX_SECONDS = 1.0, 600.0
MAX_SIDE, MIN_SIDE = 1280, 180
CAMERAS = ("left", "right", "wrist")
SESSION = "language_instruction string, policies map<string, struct<policy_name: string, binary_success: double>>"


def trajectories(sources: DataFrame, control_freq: float, robot: str | None = None, outcome: str = "all", prefix: str = "soar") -> DataFrame:
    """``(path, episode_id, policy, success, instruction, status)`` of trajectories ``(path, n, success_text, instruction)``.

    Paths are robot/task/policy/date/outcome/name; robot and outcome choose among them. Trajectories are numbered by
    path, skipped ones too, so that ids stay when filters change; those of a wrong duration are skipped.
    """
    parts = F.split("path", "/")
    rows = sources
    if robot is not None:
        rows = rows.where(F.array_contains(parts, robot))
    if outcome != "all":
        rows = rows.where(F.array_contains(parts, outcome))
    rows = running(rows, ["path"], {"number": F.lit(1)})
    parts, number = F.split("path", "/"), c("number")
    name = F.array_join(F.transform(parts, slug), "_")
    seconds = c("n") / control_freq
    status = F.when((seconds < MIN_SECONDS) | (seconds > MAX_SECONDS), "skipped").otherwise("written")
    return rows.select(
        "path", F.concat_ws("_", F.lit(prefix), F.lpad(number.cast("string"), 6, "0"), name).alias("episode_id"), F.when(F.size(parts) >= 5, F.get(parts, F.lit(2))).otherwise(F.lit("soar")).alias("policy"),
        F.when(F.lower(F.trim("success_text")) == "true", 1.0).otherwise(0.0).alias("success"), F.trim("instruction").alias("instruction"), status.alias("status"),
    )


def converted_steps(poses: DataFrame) -> DataFrame:
    """``(path, t, state, held, target, grip)``: seven-wide poses and grippers from ``(path, t, pose, delta)`` with Euler angles.

    The target of a step is the next state; at the end it is the last state and its own change, and the gripper stays.
    """
    w = Window.partitionBy("path").orderBy("t")
    ahead = F.lead("pose").over(w)
    target = F.coalesce(F.slice(ahead, 1, 6), F.zip_with(F.slice("pose", 1, 6), F.slice("delta", 1, 6), lambda a, b: a + b))
    turned = lambda p: F.concat(F.slice(p, 1, 3), to_quaternion(F.slice(p, 4, 3), "euler_xyz"))
    rows = poses.select("path", "t", "pose", target.alias("target"), F.get(F.coalesce(ahead, c("pose")), F.lit(6)).alias("grip"))
    return rows.select("path", "t", turned(c("pose")).alias("state"), F.array(F.get("pose", F.lit(6))).alias("held"), turned(c("target")).alias("target"), F.array("grip").alias("grip"))


def policy_episodes(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """``(session, letter, policy_name, success, instruction, cameras, status)``: each policy of a session is an episode.

    ``sessions`` has ``(session, metadata)`` as JSON, ``files`` ``(session, letter, camera)``. Cameras are those that are
    there, in their usual order; an episode without any is skipped.
    """
    meta = F.from_json("metadata", SESSION)
    rows = sessions.withColumn("meta", meta).select("session", c("meta.language_instruction").alias("instruction"), F.explode(F.map_entries("meta.policies")).alias("entry"))
    rows = rows.select("session", c("entry.key").alias("letter"), c("entry.value.policy_name").alias("policy_name"), c("entry.value.binary_success").alias("success"), "instruction")
    seen = files.groupBy("session", "letter").agg(F.collect_set("camera").alias("there"))
    rows = rows.join(seen, ["session", "letter"], "left")
    cameras = F.array_join(F.filter(F.array(*map(F.lit, CAMERAS)), lambda x: F.array_contains("there", x)), ",")
    return rows.select("session", "letter", "policy_name", "success", "instruction", F.coalesce(cameras, F.lit("")).alias("cameras")).withColumn("status", F.when(c("cameras") == "", "skipped").otherwise("written"))


def step_arrays(records: DataFrame) -> DataFrame:
    """Typed arrays of per-step records ``(joint_position, gripper_position, cartesian_position, action)``: seven joints,
    one gripper, six numbers of the pose; the action is seven velocities and a gripper. Single numbers become columns of one."""
    number = lambda x: F.array(F.get(x, F.lit(0)).cast("double"))
    wide = lambda x, n: F.transform(F.slice(x, 1, n), lambda v: v.cast("double"))
    keep = [x for x in records.columns if x not in ("joint_position", "gripper_position", "cartesian_position", "action")]
    return records.select(
        *keep, wide("joint_position", 7).alias("joint_position"), number("gripper_position").alias("gripper_position"), wide("cartesian_position", 6).alias("cartesian_position"),
        wide("action", 7).alias("joint_velocity"), F.array(F.get("action", F.lit(7)).cast("double")).alias("gripper_action"),
    )


def batch(items: DataFrame, start: int = 0, most: int | None = None) -> DataFrame:
    """``(path, episode_id, status)`` of items ``(path, outcome)`` in order of their paths: numbered from ``start``, skipped ones too;
    the batch ends before the item that comes after ``most`` written ones."""
    rows = running(items, ["path"], {"number": F.lit(1), "before": F.when(c("outcome") == "written", 1).otherwise(0)})
    rows = rows.withColumn("number", c("number") + start)
    rows = rows if most is None else rows.where(c("before") < most)
    return rows.select("path", F.concat(F.lit("episode_"), F.lpad(c("number").cast("string"), 6, "0")).alias("episode_id"), c("outcome").alias("status"))


def batch_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def resized(videos: DataFrame) -> DataFrame:
    """``(episode_id, name, new_width, new_height, problem)``: sides scaled down to the largest allowed, cut to whole pixels."""
    longest = F.greatest("width", "height")
    scale = F.lit(float(MAX_SIDE)) / longest
    side = lambda x: F.when(longest <= MAX_SIDE, c(x)).otherwise(F.floor(c(x) * scale).cast("int"))
    rows = videos.select("episode_id", "name", side("width").alias("new_width"), side("height").alias("new_height"))
    return rows.withColumn("problem", F.when(F.least("new_width", "new_height") < MIN_SIDE, "too_small").otherwise(""))


def second_names(rows: DataFrame) -> DataFrame:
    """``(session, event, name)``: names by the second of ``ts``; within a session, those of one second get _2, _3 and so on."""
    second = F.date_format("ts", "yyyyMMdd_HHmmss")
    k = F.row_number().over(Window.partitionBy("session", second).orderBy("ts", "event"))
    return rows.select("session", "event", F.when(k > 1, F.concat_ws("_", second, k.cast("string"))).otherwise(second).alias("name"))


def video_names(videos: DataFrame) -> DataFrame:
    """``(dir, source, new_name, collides)`` of videos ``(dir, stem, name, source, place)``: ``stem_name.mp4``; other sources with
    that name get _2, _3 by their first place, a source keeps its name. ``collides`` marks names that two sources share after all."""
    base = F.concat_ws("_", "stem", "name")
    one = videos.groupBy("dir", base.alias("base"), "source").agg(F.min("place").alias("first"))
    k = F.row_number().over(Window.partitionBy("dir", "base").orderBy("first", "source"))
    rows = one.withColumn("new_name", F.concat("base", F.when(k > 1, F.concat(F.lit("_"), k.cast("string"))).otherwise(""), F.lit(".mp4")))
    shared = F.count(F.lit(1)).over(Window.partitionBy("dir", "new_name")) > 1
    return rows.select("dir", "source", "new_name", shared.alias("collides"))


def split_references(episodes: DataFrame, videos: DataFrame, size: int) -> DataFrame:
    """``(rel_path, new_path, name, new_reference)``: where the episodes of a crowded directory go, in numbered folders of
    ``size`` by path, and how their references to videos read from there; others stay as they are."""
    folder = F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1)
    rows = episodes.select("episode_id", "rel_path", folder.alias("dir"))
    rows = running(rows, ["rel_path"], {"place": F.lit(1)}, ("dir",), ("place",)).withColumn("k", (F.floor(c("place") / size) * size).cast("string"))
    moved = c("place_total") > size
    number = F.when(F.length("k") >= 3, c("k")).otherwise(F.lpad("k", 3, "0"))
    new = F.when(moved, F.concat_ws("/", "dir", number, F.regexp_extract("rel_path", "([^/]*)$", 1))).otherwise(c("rel_path"))
    rows = rows.withColumn("new_path", new).withColumn("moved", moved).join(videos.select("episode_id", "name", F.trim("stored_path").alias("stored")), "episode_id")
    away = c("moved") & (c("stored") != "") & ~c("stored").startswith("/")
    return rows.select("rel_path", "new_path", "name", F.when(away, F.concat(F.lit("../"), c("stored"))).otherwise(c("stored")).alias("new_reference"))


def copy_sizes(episodes: DataFrame, videos: DataFrame) -> DataFrame:
    """``(lab_id, tree_bytes, outside_bytes)``: what a copy of a lab takes: its files, and each video outside its folder once."""
    tree = episodes.groupBy("lab_id").agg(F.sum("size_bytes").alias("tree_bytes"))
    folder = F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1)
    rows = videos.join(episodes.select("episode_id", "lab_id", folder.alias("dir")), "episode_id").withColumn("stored", F.trim("stored_path")).where("stored <> ''")
    inside = resolved_path(c("dir"), c("stored"))
    out = rows.where(c("stored").startswith("/") | inside.isNull()).groupBy("lab_id", "stored").agg(F.max("size_bytes").alias("b")).groupBy("lab_id").agg(F.sum("b").alias("outside_bytes"))
    return tree.join(out, "lab_id", "left").withColumn("outside_bytes", F.coalesce("outside_bytes", F.lit(0)))


def submissions(episodes: DataFrame, videos: DataFrame) -> DataFrame:
    """``(folder, episodes, videos, bytes)`` by the top-level folder of the episodes' paths; a referenced video counts once."""
    top = F.when(F.instr("rel_path", "/") > 0, F.substring_index("rel_path", "/", 1)).otherwise("(root)")
    rows = episodes.withColumn("folder", top)
    own = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("episodes"), F.sum("size_bytes").alias("b"))
    once = videos.join(rows.select("episode_id", "folder"), "episode_id").where("trim(stored_path) <> ''").groupBy("folder", "stored_path").agg(F.max("size_bytes").alias("s"))
    seen = once.groupBy("folder").agg(F.count(F.lit(1)).alias("videos"), F.sum("s").alias("v"))
    rows = own.join(seen, "folder", "left")
    return rows.select("folder", "episodes", F.coalesce("videos", F.lit(0)).alias("videos"), (c("b") + F.coalesce("v", F.lit(0))).alias("bytes"))


def inventory_difference(local: DataFrame, remote: DataFrame) -> DataFrame:
    """``(folder, local, remote, missing)``: episodes here and there, and how many of those here aren't there, by top-level folder."""
    top = F.substring_index("rel_path", "/", 1).alias("folder")
    both = local.select("rel_path", F.lit(1).alias("l")).join(remote.select("rel_path", F.lit(1).alias("r")), "rel_path", "full")
    return both.groupBy(top).agg(F.count("l").alias("local"), F.count("r").alias("remote"), F.count_if(c("l").isNotNull() & c("r").isNull()).alias("missing"))


def discovered(files: DataFrame) -> DataFrame:
    """The paths of episode files, whatever the case of their endings, in order."""
    return files.where(F.lower("path").rlike(r"\.(h5|hdf5)$")).select("path").orderBy("path")


def training_episodes(steps: DataFrame, episodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``(episode_id, path, n, problem, steps)``: nested steps for training of episodes whose annotators agree.

    ``labels`` has ``(episode_id, verdict)``, "1", "0" or why there is none. Arrays that an episode lacks are zeros; other
    widths, or arrays of different lengths, are a ``problem`` and give no steps. The path begins with the outcome.
    """
    wants = {"joints": ("state", "joint_position", 7), "gripper": ("state", "gripper_position", 1), "command": ("action", "joint_position", 7), "grip": ("action", "gripper_position", 1)}
    pick = lambda g, k, n: F.coalesce(F.max(F.when((c("grp") == g) & (c("key") == k), c("vals"))), F.array_repeat(F.lit(0.0), n))
    one = steps.repartition("episode_id").groupBy("episode_id", "t").agg(*(pick(*v).alias(x) for x, v in wants.items()))
    sizes = [F.size(x) != n for x, (_, _, n) in wants.items()]
    wrong = sizes[0] | sizes[1] | sizes[2] | sizes[3]
    last = Window.partitionBy("episode_id")
    one = one.withColumn("wrong", wrong).withColumn("end", F.max("t").over(last))
    entry = F.struct("t", (c("t") == 0).alias("is_first"), (c("t") == c("end")).alias("is_last"), F.when(c("t") == c("end"), 1.0).otherwise(0.0).alias("reward"), *wants)
    per = one.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"), F.max("wrong").alias("wrong"), F.sort_array(F.collect_list(entry)).alias("steps"))
    counts = steps.groupBy("episode_id", "grp", "key").agg(F.count(F.lit(1)).alias("k")).groupBy("episode_id").agg((F.min("k") != F.max("k")).alias("uneven"))
    rows = per.join(counts, "episode_id").join(episodes.select("episode_id", "rel_path"), "episode_id").join(labels, "episode_id", "left")
    problem = F.when(c("wrong"), "width").when(c("uneven"), "lengths").when(~F.coalesce(c("verdict").isin("0", "1"), F.lit(False)), "no_consensus").otherwise("")
    path = F.concat_ws("/", F.when(c("verdict") == "1", "success").when(c("verdict") == "0", "failure"), "rel_path")
    return rows.withColumn("problem", problem).select("episode_id", path.alias("path"), "n", "problem", F.when(c("problem") == "", c("steps")).alias("steps"))


def write_training(rows: DataFrame, at: str, shards: int | None = None, seed: int = 0) -> None:
    """Nested episodes in the split ``train``, in so many shards by a seeded hash of the path, the same whenever a task runs
    again; a folder that is there is refused."""
    rows = rows.where("problem = ''").drop("problem")
    (rows if shards is None else rows.repartition(shards, F.xxhash64(F.lit(seed), "path"))).write.mode("errorifexists").parquet(f"{at}/train")


def write_rollouts(rows: DataFrame, at: str) -> None:
    """Rollout results ``(success, duration, video_filename)`` as CSV with a header."""
    rows.select("success", "duration", "video_filename").write.mode("errorifexists").option("header", True).csv(at)


def rollout_results(per: DataFrame, lengths: DataFrame, rate: float) -> DataFrame:
    """``(success, duration, video_filename)`` of rollouts ``(episode_id, highest)`` and their steps ``(episode_id, n)``."""
    rows = per.join(lengths, "episode_id")
    return rows.select((F.coalesce("highest", F.lit(0)) >= 4).alias("success"), F.round(c("n") / rate, 6).alias("duration"), F.concat(F.lit("rollout_"), c("episode_id").cast("string"), F.lit(".mp4")).alias("video_filename"))


def rollout_summary(per: DataFrame, top: int) -> DataFrame:
    """``(n, success_rate, average_return)``: the share of rollouts that reach the top reward, and the mean of their totals."""
    return per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(c("highest") == top, 1.0).otherwise(0.0)), 6).alias("success_rate"), F.round(F.avg("total"), 6).alias("average_return"))


def reference(x: Column) -> Column:
    """A stored reference without white space around it; null if there is none."""
    return F.when(F.trim(x) != "", F.trim(x))
