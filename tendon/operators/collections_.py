"""Layout, size and evaluation of a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendon.functions.numbering import running

c = F.col


def files_of(pages: DataFrame) -> DataFrame:
    """``(path, dir, name, size)`` from addresses and their contents."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    rows = pages.select(path.alias("path"), F.length("html").cast("long").alias("size"))
    return rows.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "size")


def directory_counts(files: DataFrame, most: int) -> DataFrame:
    """``(dir, n_files, n_episodes, verdict)`` of directories with more than ``most`` files."""
    per = files.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.lower("name").rlike(r"\.(html|h5|hdf5)$")).alias("n_episodes")).where(c("n_files") > most)
    return per.withColumn("verdict", F.when(c("n_episodes") > 0, "splittable").otherwise("unfixable"))


def inventory(files: DataFrame) -> DataFrame:
    """``(folder, n_files, n_bytes)`` by top-level folder; a path counts once, with its largest size."""
    one = files.groupBy("path").agg(F.max("size").alias("size"))
    folder = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise("(root)")
    return one.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))


def split_plan(files: DataFrame, batch: int) -> DataFrame:
    """``(path, new_path)``: files of a directory in numbered folders of ``batch``, in order of their names."""
    rows = running(files.select("path", "dir", "name").distinct(), ["path"], {"place": F.lit(1)}, ("dir",), ("place",))
    number = F.floor(c("place") / batch).cast("string")
    folder = F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0"))
    return rows.select("path", F.when(c("place_total") > batch, F.concat_ws("/", "dir", folder, "name")).otherwise(c("path")).alias("new_path"))


def unique_names(files: DataFrame) -> DataFrame:
    """``(dir, path, unique_name)``: equal names in a directory get _2, _3 and so on by path."""
    w = Window.partitionBy("dir", "name").orderBy("path")
    rows = files.select("dir", "name", "path").distinct().withColumn("k", F.row_number().over(w))
    return rows.select("dir", "path", F.when(c("k") > 1, F.concat_ws("_", "name", c("k").cast("string"))).otherwise(c("name")).alias("unique_name"))


def rollouts(events: DataFrame) -> DataFrame:
    """``(episode_id, t, reward)``: rewards 0 to 4 by value, null for some."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    reward = F.when(c("event_id") % 10 != 0, F.least(F.lit(4), F.floor(F.abs("value") / 10)).cast("int"))
    return events.select(c("user_id").alias("episode_id"), (F.row_number().over(w) - 1).cast("long").alias("t"), reward.alias("reward"))


def evaluation(rows: DataFrame) -> DataFrame:
    """``(episode_id, total, highest, last)`` of each rollout; nulls count for the total only."""
    return rows.groupBy("episode_id").agg(F.coalesce(F.sum("reward"), F.lit(0)).cast("long").alias("total"), F.max("reward").alias("highest"), F.max_by("reward", "t").alias("last"))


def success_curve(per: DataFrame, top: int) -> DataFrame:
    """``(reward, share)``: the share of rollouts whose highest reward is at least each level up to ``top``."""
    levels = per.select("highest", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("reward"))
    share = F.avg(F.when(c("highest") >= c("reward"), 1.0).otherwise(0.0))
    return levels.groupBy("reward").agg(F.round(share, 6).alias("share"))


def training_steps(steps: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row per step for training: joints, gripper, flags of the first and last step, and the reward at the end.

    Keys that an episode lacks are filled with zeros of their width.
    """
    pick = lambda g, k, n: F.coalesce(F.max(F.when((c("grp") == g) & (c("key") == k), c("vals"))), F.array_repeat(F.lit(0.0), n))
    rows = steps.repartition("episode_id").groupBy("episode_id", "t").agg(pick("state", "joint_position", 7).alias("joints"), pick("action", "gripper_position", 1).alias("grip"), pick("state", "gripper_position", 1).alias("held"))
    rows = rows.join(episodes.select("episode_id", "trajectory_length", "language_instruction"), "episode_id")
    last = c("t") == c("trajectory_length") - 1
    total = F.aggregate("joints", F.lit(0.0), lambda a, v: a + v)
    return rows.select("episode_id", "t", F.round(total, 6).alias("joint_sum"), c("grip")[0].alias("grip"), c("held")[0].alias("held"), (c("t") == 0).alias("is_first"), last.alias("is_last"), last.cast("int").alias("reward"), "language_instruction")


def absolute_actions(steps: DataFrame) -> DataFrame:
    """``(episode_id, t, x, y, z)``: the target of each step, the next state; at the end the last state and its last change."""
    w = Window.partitionBy("episode_id").orderBy("t")
    rows = steps.where("grp = 'state' and key = 'cartesian_position'").withColumn("next", F.lead("vals").over(w)).withColumn("last", F.lag("vals").over(w))
    pose = F.coalesce("next", F.zip_with("vals", F.coalesce("last", "vals"), lambda a, b: a + (a - b)))
    return rows.select("episode_id", "t", *(F.round(F.element_at(pose, i + 1), 6).alias(a) for i, a in enumerate("xyz")))
