"""Rules on robot profiles, on the parts a recording must have, and on what its arrays must look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendon.operators.motion import union_all
from tendon.sources.recordings import SENSOR, names_or_none, parsed

c = F.col

# What profiles and recordings must have.
HEADER = ("schema", "name", "language_instruction", "lab_id", "operator_name", "profile")
REQUIRED = ("action_space", "camera_names", "control_freq", "gripper_name", "is_biarm", "policy_name", "robot_name", "robot_state_keys", "uses_mobile_base")
ARM_ACTIONS = ("cartesian_position", "cartesian_velocity", "joint_position", "joint_velocity")
GRIPPER_ACTIONS = ("gripper_binary", "gripper_position", "gripper_velocity")
BASE_ACTIONS = ("base_position", "base_velocity")
SENSOR_FIELDS = ("format", "sensor", "sensor_info")
FORMATS = ("array", "video")
KEY_PATTERN = "^[A-Za-z0-9_-]+$"
MAX_ADDITIONAL_BYTES = 100 * 1024 * 1024


def _strings(xs: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, xs))


def _emit(rows: DataFrame, rules: list[tuple[int, str, Column, Column]]) -> DataFrame:
    """``(episode_id, rule_order, rule, subject)`` of the rules ``(order, name, condition, subject)`` that hold."""
    each = [F.when(cond, F.struct(F.lit(n).alias("rule_order"), F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))) for n, rule, cond, subject in rules]
    return rows.select("episode_id", F.explode_outer(F.array(*each)).alias("x")).where("x is not null").select("episode_id", "x.*")


def header_violations(headers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Attributes that are missing, and an empty name."""
    rows = headers.join(profiles, "episode_id", "left")
    missing = F.explode(F.filter(F.array(*(F.when(c(x).isNull(), F.lit(x)) for x in HEADER)), lambda x: x.isNotNull())).alias("subject")
    gone = rows.select("episode_id", F.lit(2).alias("rule_order"), F.lit("missing_attribute").alias("rule"), missing)
    return gone.unionByName(_emit(rows, [(9, "empty_name", F.trim("name") == "", F.lit(""))]))


def profile_violations(profiles: DataFrame) -> DataFrame:
    """Rules on the profile itself; a profile that is no JSON object breaks the first one only."""
    rows = parsed(profiles)
    space, states = names_or_none(c("p.action_space")), names_or_none(c("p.robot_state_keys"))
    arms, grips, bases = (F.array_intersect(space, _strings(x)) for x in (ARM_ACTIONS, GRIPPER_ACTIONS, BASE_ACTIONS))
    extra = F.array_except(space, _strings(ARM_ACTIONS + GRIPPER_ACTIONS + BASE_ACTIONS))
    fits = (F.size(arms) >= 1) & (F.size(grips) >= 1) & (F.size(bases) <= 1) & (F.size(extra) == 0)
    kind = lambda x: F.array_compact(F.array(F.when(F.exists(space, lambda k: k.startswith(f"{x}_")), F.lit(f"{x}_position"))))
    needed = F.array_except(F.concat(_strings(("gripper_position",)), kind("joint"), kind("cartesian")), states)
    missing = F.array_except(_strings(REQUIRED), c("keys"))
    has = F.size(missing) == 0
    joints = F.arrays_overlap(space, _strings(("joint_position", "joint_velocity")))
    own = _emit(rows.where("p is null"), [(5, "profile_json", F.lit(True), F.lit(""))])
    of_keys = _emit(rows.where("p is not null"), [
        (5, "profile_keys", ~has, F.array_join(F.array_sort(missing), ",")),
        (5, "action_space", has & ~fits, F.array_join(space, ",")),
        (5, "required_states", has & (F.size(needed) > 0), F.array_join(F.array_sort(needed), ",")),
        (5, "state_joint_names", has & F.array_contains(states, "joint_position") & (F.size(names_or_none(c("p.robot_state_joint_names"))) == 0), F.lit("")),
        (5, "action_joint_names", has & joints & (F.size(names_or_none(c("p.action_joint_names"))) == 0), F.lit("")),
        (5, "mobile_base", has & c("p.uses_mobile_base") & (F.size(bases) == 0), F.lit("")),
    ])
    return union_all(own, of_keys, sensor_violations(rows))


def sensors(rows: DataFrame) -> DataFrame:
    """``(episode_id, place, key, entry, fields, format, sensor)`` of the additional sensors of parsed profiles."""
    each = rows.where("p.additional_data is not null").select("episode_id", c("p.camera_names").alias("cameras"), F.posexplode(F.map_entries("p.additional_data")).alias("place", "x"))
    s = F.from_json("x.value", SENSOR)
    return each.select("episode_id", "cameras", "place", c("x.key").alias("key"), F.json_object_keys("x.value").alias("fields"), s["sensor"].alias("sensor"), F.coalesce(F.when(s["format"] != "", s["format"]), F.lit("array")).alias("format"))


def sensor_violations(rows: DataFrame) -> DataFrame:
    """Rules on the declarations of additional sensors; names are compared without regard to case."""
    each = sensors(rows)
    before = F.count(F.lit(1)).over(Window.partitionBy("episode_id", F.lower("key")).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("taken", (before > 0) | F.exists(names_or_none(c("cameras")), lambda x: F.lower(x) == F.lower("key")))
    unknown = F.array_except("fields", _strings(SENSOR_FIELDS))
    return _emit(each, [
        (6, "sensor_key", ~c("key").rlike(KEY_PATTERN), c("key")),
        (6, "sensor_collision", c("taken"), c("key")),
        (6, "sensor_fields", F.size(unknown) > 0, c("key")),
        (6, "sensor_name", F.trim(F.coalesce("sensor", F.lit(""))) == "", c("key")),
        (6, "sensor_format", ~c("format").isin(*FORMATS), c("key")),
    ])


def declared(rows: DataFrame) -> DataFrame:
    """``(episode_id, grp, key, format)`` of what parsed profiles declare: states, actions, cameras and sensors."""
    def each(grp: str, field: str, kind: str) -> Column:
        return F.transform(names_or_none(c(f"p.{field}")), lambda k: F.struct(F.lit(grp).alias("grp"), k.alias("key"), F.lit(kind).alias("format")))

    fields = (("state", "robot_state_keys", "array"), ("action", "action_space", "array"), ("camera", "camera_names", "video"))
    keys = F.explode(F.concat(*(each(*x) for x in fields))).alias("x")
    own = rows.where("p is not null").select("episode_id", keys).select("episode_id", "x.*")
    return own.unionByName(sensors(rows).select("episode_id", F.lit("additional").alias("grp"), "key", "format")).distinct()


def content_violations(profiles: DataFrame, arrays: DataFrame, videos: DataFrame) -> DataFrame:
    """Rules on what is stored against what the profile declares; ``arrays`` has one row per stored key.

    Episodes whose profile can't be read have no declarations and only the rules that need none.
    """
    rows = parsed(profiles)
    wanted = declared(rows)
    on = ["episode_id", "grp", "key"]
    cameras = videos.select("episode_id", F.lit("camera").alias("grp"), c("name").alias("key")).distinct()
    have = arrays.select(*on).unionByName(cameras)
    groups = profiles.select("episode_id", F.explode(_strings(("state", "action", "camera"))).alias("grp")).join(have.select("episode_id", "grp").distinct(), ["episode_id", "grp"], "left_anti")
    row = lambda df, n, rule: df.select("episode_id", F.lit(n).alias("rule_order"), F.lit(rule).alias("rule"), F.concat_ws("/", "grp", "key").alias("subject"))
    readable = rows.where("p is not null").select("episode_id")
    there = have.where("grp <> 'camera'").join(readable, "episode_id", "left_semi")
    first = arrays.where("grp = 'state'").groupBy("episode_id").agg(F.min_by("n", "key").alias("t"))
    p = rows.select("episode_id", c("p.is_biarm").alias("is_biarm"), c("p.action_joint_names").alias("action_names"), c("p.robot_state_joint_names").alias("state_names"))
    fit = arrays.join(wanted, on, "left").join(p, "episode_id", "left").join(first, "episode_id", "left")
    arms = F.when(c("is_biarm"), 2).otherwise(1)
    filled, motion = ~c("is_empty"), c("grp").isin("state", "action")
    subject = F.concat_ws("/", "grp", "key")
    names = F.when(c("grp") == "state", F.size(names_or_none(c("state_names")))).otherwise(F.size(names_or_none(c("action_names"))))
    named = ((c("grp") == "state") & (c("key") == "joint_position")) | ((c("grp") == "action") & c("key").isin("joint_position", "joint_velocity") & (F.size(names_or_none(c("action_names"))) > 0))
    text = c("dtype") == "text"
    of_arrays = _emit(fit, [
        (4, "declared_empty", (c("grp") == "action") & c("is_empty") & c("format").isNotNull(), subject),
        (8, "additional_empty", (c("grp") == "additional") & c("is_empty"), subject),
        (8, "additional_reference", (c("grp") == "additional") & filled & (c("format") == "video") & ~text, subject),
        (14, "cartesian_width", motion & filled & (c("key") == "cartesian_position") & (c("ndim") >= 2) & c("is_biarm").isNotNull() & (c("width") != 7 * arms), subject),
        (15, "joint_names", filled & named & c("is_biarm").isNotNull() & (names != c("width")), subject),
        (16, "length", motion & filled & (c("n") != c("t")), subject),
        (19, "gripper_channels", motion & filled & (c("key") == "gripper_binary") & c("is_biarm").isNotNull() & (~c("ndim").isin(1, 2) | (c("width") != arms)), subject),
        (20, "additional_infinite", (c("grp") == "additional") & filled & ~text & (c("n_inf") > 0), subject),
        (20, "additional_length", (c("grp") == "additional") & filled & ~text & (c("format") != "video") & ((c("ndim") == 0) | (c("n") != c("t"))), subject),
    ])
    entry = F.struct((-c("n_bytes")).alias("b"), "key")
    sizes = arrays.where("grp = 'additional' and not is_empty and dtype <> 'text'").groupBy("episode_id").agg(F.sum("n_bytes").alias("total"), F.array_sort(F.collect_list(entry)).alias("parts"))
    parts = F.array_join(F.transform("parts", lambda x: F.format_string("%s=%.1f MiB", x["key"], F.bround(-x["b"] / 1024**2, 1))), ", ")
    too_large = sizes.where(c("total") > MAX_ADDITIONAL_BYTES).select("episode_id", F.lit(21).alias("rule_order"), F.lit("additional_bytes").alias("rule"), parts.alias("subject"))
    return union_all(
        groups.select("episode_id", F.lit(3).alias("rule_order"), F.lit("missing_group").alias("rule"), c("grp").alias("subject")),
        row(wanted.select(*on).join(have, on, "left_anti"), 12, "declared_missing"), row(there.join(wanted, on, "left_anti"), 13, "not_declared"), of_arrays, too_large,
    )


def key_sets(profiles: DataFrame, arrays: DataFrame) -> DataFrame:
    """``(episode_id, grp, missing, extra)`` of the groups whose stored keys aren't those declared; a writer refuses them."""
    rows = parsed(profiles).where("p is not null")
    wanted = declared(rows).where("grp <> 'camera'").groupBy("episode_id", "grp").agg(F.collect_set("key").alias("wanted"))
    have = arrays.groupBy("episode_id", "grp").agg(F.collect_set("key").alias("have"))
    both = wanted.join(have.join(rows.select("episode_id"), "episode_id", "left_semi"), ["episode_id", "grp"], "full")
    diff = lambda a, b: F.array_join(F.array_sort(F.array_except(names_or_none(c(a)), names_or_none(c(b)))), ",")
    return both.select("episode_id", "grp", diff("wanted", "have").alias("missing"), diff("have", "wanted").alias("extra")).where("missing <> '' or extra <> ''")


# Where a joint stands in the chain from the base to the wrist, by the first of these that its name has.
CHAIN = {
    "shoulder_pan": 0, "waist": 0, "shoulder_lift": 1, "forearm_roll": 3, "wrist_angle": 4, "wrist_flex": 4, "wrist_1": 4, "wrist_2": 5, "wrist_rotate": 6, "wrist_roll": 6,
    "wrist_3": 6, "shoulder": 1, "elbow": 2,
}
LEFT, RIGHT = "(^|[^a-z])(left|l)([^a-z]|$)", "(^|[^a-z])(right|r)([^a-z]|$)"


def joint_names(rows: DataFrame, states: DataFrame) -> DataFrame:
    """``(episode_id, problem)``: whether the names of an arm's joints are there and plausible.

    ``rows`` are parsed profiles; ``states`` has the ``episode_id`` of those with a joint state.
    """
    base = rows.select("episode_id", c("p.is_biarm").alias("is_biarm"), names_or_none(c("p.action_joint_names")).alias("action"), names_or_none(c("p.robot_state_joint_names")).alias("state"))
    each = base.select("episode_id", F.explode(F.array(*(F.struct(F.lit(s).alias("list"), c(s).alias("names")) for s in ("action", "state")))).alias("x"))
    each = each.select("episode_id", "x.list", F.size("x.names").alias("n"), F.posexplode("x.names").alias("at", "name")).withColumn("low", F.lower("name"))
    side = F.when(c("low").rlike(LEFT), "left").when(c("low").rlike(RIGHT), "right").otherwise("")
    rank = F.coalesce(*(F.when(c("low").contains(k), r) for k, r in CHAIN.items()))
    number = F.regexp_extract("name", r"([0-9]+)[^0-9]*$", 1)
    each = each.withColumn("side", side).withColumn("rank", rank).withColumn("number", F.when(number != "", number.cast("long"))).withColumn("pattern", F.regexp_replace("name", r"[0-9]+([^0-9]*)$", "#$1"))
    w = lambda *by: Window.partitionBy("episode_id", "list", *by).orderBy("at")
    numbered = c("number").isNotNull()
    each = each.withColumn("before", F.when(numbered, F.lag("number").over(w("side", "pattern", numbered)))).withColumn("last_rank", F.last("rank", True).over(w("side").rowsBetween(Window.unboundedPreceding, -1)))
    per = each.groupBy("episode_id", "list").agg(
        F.bool_or(F.trim("name") == "").alias("blank_names"), (F.count_distinct("name") < F.count(F.lit(1))).alias("duplicate_names"),
        F.bool_or(F.coalesce(c("number") <= c("before"), F.lit(False))).alias("numbering_out_of_order"), F.bool_or(F.coalesce(c("rank") < c("last_rank"), F.lit(False))).alias("chain_out_of_order"),
        F.collect_set("side").alias("sides"),
    )
    kinds = ("blank_names", "duplicate_names", "numbering_out_of_order", "chain_out_of_order")
    listed = per.select("episode_id", F.explode(F.array_compact(F.array(*(F.when(c(k), F.concat_ws("_", "list", F.lit(k))) for k in kinds)))).alias("problem"))
    named = per.where("list = 'action'").select("episode_id", "sides")
    whole = base.join(named, "episode_id", "left").join(states.select("episode_id").distinct().withColumn("seen", F.lit(True)), "episode_id", "left")
    both = (F.size("action") > 0) & (F.size("state") > 0)
    covered = F.size(F.array_except("action", "state")) == 0
    kept = F.filter("state", lambda n: F.array_contains("action", n))
    two = F.array_contains("sides", "left") & F.array_contains("sides", "right")
    found = F.array_compact(F.array(
        F.when(F.size("action") == 0, F.lit("missing_action_names")), F.when(c("seen") & (F.size("state") == 0), F.lit("missing_state_names")),
        F.when(both & ~covered, F.lit("action_names_not_in_state")), F.when(both & covered & (kept != c("action")), F.lit("reordered_vs_state")),
        F.when(c("is_biarm") & (F.size("action") > 0) & ~two, F.lit("biarm_sides_not_named")),
    ))
    return listed.unionByName(whole.select("episode_id", F.explode(found).alias("problem")))


def joint_pairs(action: Column, state: Column, action_width: Column, state_width: Column) -> Column:
    """The state's column for each column of an action: by name where the names of both fit, else by place; null if neither does."""
    fits = (F.size(action) == action_width) & (F.size(state) == state_width) & (F.size(F.array_distinct(state)) == F.size(state)) & (F.size(F.array_except(action, state)) == 0)
    by_name = F.transform(action, lambda n: (F.array_position(state, n) - 1).cast("int"))
    by_place = F.transform(F.sequence(F.lit(1), action_width), lambda i: (i - 1).cast("int"))
    return F.when(fits & (action_width > 0), by_name).when((action_width == state_width) & (action_width > 0), by_place)
