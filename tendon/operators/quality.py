"""The checks of all categories over an episode's tables, with what each passes over, for the ledger."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendon.operators import ledger, motion, poses, profiles, reporting, video
from tendon.operators import video_motion as vm
from tendon.operators.config import DEFAULTS, Config
from tendon.operators.ledger import Coverage, found_rows, outcomes, outcomes_of
from tendon.sources import recordings as rec
from tendon.sources.tables import saved

c = F.col
CATEGORIES = ("keys", "cartesian_position", "cartesian_velocity", "video")


@dataclass(frozen=True)
class Tables:
    """What the checks read. ``steps`` of actions and states, ``arrays`` as they are stored, ``profiles`` as JSON; ``motion``,
    ``frames`` and ``rates`` are states, frame statistics and rates of filmed episodes."""

    episodes: DataFrame
    profiles: DataFrame
    arrays: DataFrame
    steps: Callable[[tuple[str, ...] | None], DataFrame]
    poses: Callable[[str], DataFrame]
    videos: DataFrame
    motion: DataFrame
    frames: DataFrame
    rates: DataFrame

    @cached_property
    def parsed(self) -> DataFrame:
        """The profiles as structs, parsed once for all passes, by as many tasks as shuffles have: they are small, but dear to parse."""
        parts = int(self.profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return saved(rec.tolerant(self.profiles.repartition(parts, "episode_id")).select("episode_id", "p"), "profiles")


def declared_keys(profiles: DataFrame) -> DataFrame:
    """``(episode_id, key)``: the action space of each parsed profile."""
    return profiles.select("episode_id", F.explode(F.array_distinct("p.action_space")).alias("key"))


_ARM = "key IN ('joint_position', 'joint_velocity', 'cartesian_position', 'cartesian_velocity')"
_BAD = "n_bad > 0"


def general_coverage(config: Config) -> list[Coverage]:
    """Over declared keys with their metrics, which are null where the key isn't recorded."""
    own = config["general"]
    short = f"CASE WHEN n < 2 THEN 'too_short' WHEN {_BAD} THEN 'non_finite_values'"
    both = "(n_bad > 0 OR state.bad > 0)"
    empty = "CASE WHEN n IS NULL THEN 'declared_but_empty'"
    pair = f"{empty} WHEN state IS NULL THEN 'no_matching_state' WHEN s_dim IS NULL OR dim <> s_dim THEN 'feature_dim_mismatch' WHEN {both} THEN 'non_finite_values' WHEN n_state < 2 THEN 'too_short' END"
    return [
        ("constant_action", f"{_ARM} AND n IS NOT NULL", f"{short} END"),
        ("command_rate", f"{_ARM} AND n IS NOT NULL", f"{short} WHEN changes < {own['command_rate']['min_holds']} THEN 'too_few_changes' END"),
        ("length_mismatch", "n IS NOT NULL AND state IS NOT NULL", "NULL"),
        ("action_copies_state", "key IN ('joint_position', 'cartesian_position') AND n IS NOT NULL AND state IS NOT NULL",
         f"CASE WHEN s_dim IS NULL OR dim <> s_dim THEN 'feature_dim_mismatch' WHEN {both} THEN 'non_finite_values' WHEN coalesce(state_range, 0) <= {own['action_copies_state']['atol']} THEN 'state_static' END"),
        ("gripper_range", "key = 'gripper_binary'", f"{empty} WHEN {_BAD} THEN 'non_finite_values' END"),
        ("gripper_command_range", "key = 'gripper_position'", f"{empty} WHEN state IS NULL THEN 'no_matching_state' WHEN {both} THEN 'non_finite_values' END"),
        *((x, "key = 'gripper_position'", pair) for x in ("scale_consistency", "tracking_residual", "delta_detection")),
    ]


def _joint_state(least: int) -> str:
    return f"WHEN state IS NULL THEN 'no_matching_state' WHEN state.bad > 0 THEN 'non_finite_state' WHEN n_state = 0 THEN 'no_joint_pairing' WHEN n_state < {least} THEN 'too_short'"


def joint_position_coverage(config: Config) -> list[Coverage]:
    own = config["joint_position"]["radians"]
    mine = "key = 'joint_position'"
    radians = f"top > {own['max_abs_rad']}" if own["enabled"] else "false"
    usable = f"CASE WHEN n IS NULL THEN 'declared_but_empty' WHEN {_BAD} THEN 'non_finite_values'"
    some = f"{usable} WHEN columns = 0 THEN 'only_gripper_columns'"
    return [
        ("joint_names", mine, "NULL"), ("dof", mine, f"{usable} END"), ("gripper_in_joints", mine, f"{usable} WHEN an <> dim THEN 'no_usable_joint_names' END"),
        ("normalized_range", mine, f"{some} END"), ("radians", mine, f"{some} END"),
        ("step_jump", mine, f"{some} WHEN {radians} THEN 'not_radians' WHEN hz IS NULL THEN 'no_control_freq' WHEN n < 2 THEN 'too_short' END"),
        ("delta_detection", mine, f"{some} {_joint_state(2)} END"), ("tracking", mine, f"{some} {_joint_state(2)} WHEN {radians} THEN 'not_radians' END"),
    ]


def joint_velocity_coverage(config: Config) -> list[Coverage]:
    least = config["joint_velocity"]["tracking"]["min_motion_rad"]
    mine = "key = 'joint_velocity'"
    usable = f"CASE WHEN n IS NULL THEN 'declared_but_empty' WHEN {_BAD} THEN 'non_finite_values'"
    return [
        *((x, mine, f"{usable} END") for x in ("dof", "speed_limit", "normalized_range", "smoothness")),
        ("looks_like_position", mine, f"{usable} {_joint_state(3)} END"),
        ("tracking", mine, f"{usable} {_joint_state(3)} WHEN hz IS NULL THEN 'no_control_freq' WHEN coalesce(span, 0) < {least} THEN 'too_little_motion' END"),
    ]


def keys(t: Tables, config: Config = DEFAULTS) -> DataFrame:
    """Outcomes of general checks, joint positions and joint velocities: one pass over the declared keys, and one over
    what is declared, stored and named for each episode."""
    parsed = t.parsed
    declared = declared_keys(parsed)
    # a few rows per episode, which the rules and the rates of commands read
    metrics = saved(motion.whole_keys(t.steps(motion.GENERAL_KEYS), t.episodes, parsed, motion.GENERAL_KEYS, config, medians=True, flips=True), "key-metrics", by_rows=True)
    rows = declared.join(motion.with_states(metrics, motion.state_lengths(t.steps(motion.GENERAL_KEYS), motion.GENERAL_KEYS)), ["episode_id", "key"], "left")
    rows = motion.integration(rows, c("columns"), config["joint_velocity"]["tracking"])
    made = {"general": (general_coverage, motion.general_rules), "joint_position": (joint_position_coverage, motion.joint_position_rules), "joint_velocity": (joint_velocity_coverage, motion.joint_velocity_rules)}
    parts = [outcomes_of(rows, {k: (cover(config), rules(config)) for k, (cover, rules) in made.items()}, config)]
    mine = lambda found, key="key": found.join(declared.withColumnRenamed("key", key), ["episode_id", key], "left_semi")
    rate = mine(motion.held_commands(metrics, config))
    parts.append(found_rows(rate, "general", config, "command_rate", metric="period", other="effective_hz", n="n_holds"))
    pairs = mine(mine(motion.duplicate_pairs(t.steps(None)), "key_a"), "key_b")
    parts.append(found_rows(pairs, "general", config, "duplicate_pairs", "concat(key_a, '+', key_b)", metric="max_abs_diff"))
    have = t.steps(None).select("episode_id", "grp", "key").distinct()
    parts.append(required(parsed, have, config))
    stored = t.arrays.where("grp = 'action' AND NOT is_empty AND " + _ARM)
    chunked = mine(stored)
    parts.append(outcomes(chunked, "general", [("action_chunk_shape", "true", "NULL")], config, [("action_chunk_shape", c("ndim") > 2, {"n": c("ndim")})]))
    names = t.episodes.select("episode_id", "operator_name").join(parsed.select("episode_id", "p.policy_name", "p.robot_name", "p.gripper_name"), "episode_id", "left")
    parts.append(found_rows(reporting.placeholder_metadata(names, config), "general", config, "placeholder_metadata", "field", note="problem"))
    parts.append(outcomes(t.episodes, "general", [("placeholder_metadata", "true", "NULL")], config, key="'all'"))
    jointed = t.arrays.where("grp = 'state' and key = 'joint_position' and not is_empty")
    named = profiles.joint_names(parsed, jointed).join(declared.where("key = 'joint_position'"), "episode_id", "left_semi")
    parts.append(found_rows(named, "joint_position", config, "joint_names", "'joint_position'", note="problem"))
    return motion.union_all(*parts)


def required(parsed: DataFrame, have: DataFrame, config: Config) -> DataFrame:
    """States that the declared actions need, and whether there is a binary gripper action; ``note`` has the actions that
    need the state, or the gripper actions declared and recorded. Also which checks on pairs and keys run."""
    names = have.groupBy("episode_id").agg(F.expr("sort_array(collect_set(CASE WHEN grp = 'state' THEN key END)) AS states"), F.expr("sort_array(collect_set(CASE WHEN grp = 'action' THEN key END)) AS actions"))
    rows = parsed.select("episode_id", F.array_distinct("p.action_space").alias("space")).where("size(space) > 0").join(names, "episode_id", "left")
    rows = rows.withColumns({x: F.expr(f"coalesce({x}, CAST(array() AS array<string>))") for x in ("states", "actions")})
    of = lambda *keys: "filter(space, k -> k IN (" + ", ".join(f"'{k}'" for k in keys) + "))"
    by = [("cartesian_position", of("cartesian_position", "cartesian_velocity"), False), ("gripper_position", "CAST(array() AS array<string>)", True), ("joint_position", of("joint_position", "joint_velocity"), False)]
    rules = [
        ("required_state_keys", F.expr(f"NOT array_contains(states, '{k}') AND ({str(always).lower()} OR size({who}) > 0)"), {"key": F.lit(k), "note": F.expr(f"CASE WHEN size({who}) > 0 THEN array_join({who}, ',') ELSE 'always required' END")})
        for k, who, always in by
    ]
    grips = "concat_ws(';', array_join(filter(space, k -> k LIKE 'gripper%'), ','), array_join(filter(actions, k -> k LIKE 'gripper%'), ','))"
    rules.append(("gripper_binary_present", F.expr("NOT array_contains(actions, 'gripper_binary')"), {"key": F.lit("gripper_binary"), "note": F.expr(grips)}))
    cover: list[Coverage] = [("duplicate_pairs", "size(space) >= 2", "NULL"), ("required_state_keys", "true", "NULL"), ("gripper_binary_present", "true", "NULL")]
    return outcomes(rows, "general", cover, config, rules, key="'all'")


def _of_episodes(t: Tables, key: str, arms: DataFrame) -> DataFrame:
    """Arms of the episodes that declare the key; one row without metrics where it isn't recorded."""
    mine = declared_keys(t.parsed).where(c("key") == key).select("episode_id")
    return mine.join(arms, "episode_id", "left").withColumn("arm", F.coalesce("arm", F.lit(0)))


def cartesian_position(t: Tables, config: Config = DEFAULTS) -> DataFrame:
    """Outcomes of poses, with orientations of states as the profile declares them."""
    said = poses.declared_orientations(t.parsed)
    steps = t.poses(poses.POSE)
    metrics = saved(poses.pose_metrics(steps, t.episodes, said, config), "poses", by_rows=True)
    arms = poses.over_arms(metrics, ("pp", "ss", "aa_next", "to_next", "to_move", "n_next", "vague"), ("top", "s_top", "steps", "bad", "width", "n_state"))
    states = steps.where(f"grp = 'state' AND key = '{poses.POSE}'").groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_seen"))
    rows = _of_episodes(t, poses.POSE, arms).join(states, "episode_id", "left")
    usable = "CASE WHEN all_bad IS NULL THEN 'declared_but_empty' WHEN all_bad THEN 'non_finite_values'"
    wide = f"{usable} WHEN NOT all_fits THEN 'wrong_action_dim' WHEN all_steps < 2 THEN 'too_short'"
    turned = f"{wide} WHEN zero THEN 'zero_quaternion'"
    seen = "WHEN n_seen IS NULL THEN 'no_matching_state' WHEN NOT placed THEN 'unexpected_state_dim' WHEN bad_state THEN 'non_finite_state' WHEN all_n_state < 2 THEN 'too_short' END"
    first = "arm = 0"
    cover: list[Coverage] = [
        ("quaternion_shape", first, f"{usable} END"), ("normalized_range", first, f"{wide} END"), ("position_units", first, f"{wide} END"),
        ("quaternion_sign_flip", first, f"{turned} END"), ("quaternion_scalar_order", first, f"{turned} END"), ("rotation_jump", first, f"{turned} WHEN hz IS NULL THEN 'no_control_freq' END"),
        ("pose_tracking", first, f"{turned} {seen}"), ("delta_detection", first, f"{wide} {seen}"), ("biarm_ordering", f"{first} AND coalesce(arms, 2) = 2", f"{wide} {seen}"),
        ("pose_tracking", f"{first} AND all_vague > 0 AND all_fits AND NOT all_bad AND NOT zero AND all_steps >= 2 AND all_n_state >= 2", "'unknown_state_orientation'"),
    ]
    rules = [(n, cond & c("all_bad").isNotNull(), {"key": (c("arm") + 1).cast("string"), **told}) for n, cond, told in poses.position_rules(config)]
    swapped = poses.swapped_arms(metrics, config).join(declared_keys(t.parsed).where(f"key = '{poses.POSE}'"), "episode_id", "left_semi")
    out = outcomes(rows, "cartesian_position", cover, config, rules, key=f"'{poses.POSE}'")
    return out.unionByName(found_rows(swapped, "cartesian_position", config, "biarm_ordering", f"'{poses.POSE}'", metric="ratio"))


def cartesian_velocity(t: Tables, config: Config = DEFAULTS) -> DataFrame:
    """Outcomes of cartesian velocities, tracking included."""
    said = poses.declared_orientations(t.parsed)
    steps = t.poses(poses.VELOCITY)
    parts = saved(poses.velocity_rows(steps, t.episodes, said), "velocities", by_rows=True)
    arms = poses.over_arms(poses.velocity_metrics(parts), ("pairs", "flips", "to_next", "nn", "n_state", "vague"), ("linear", "angular", "top", "bad", "width", "steps"))
    states = steps.where(f"grp = 'state' AND key = '{poses.POSE}'").groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_seen"))
    followed = poses.tracked(poses.integrations_of(parts, config)).drop("key", "rank")
    rows = _of_episodes(t, poses.VELOCITY, arms).where("arm = 0").join(states, "episode_id", "left").join(followed, "episode_id", "left")
    usable = "CASE WHEN all_bad IS NULL THEN 'declared_but_empty' WHEN all_bad THEN 'non_finite_values'"
    wide = f"{usable} WHEN NOT all_fits THEN 'wrong_action_dim'"
    seen = "WHEN n_seen IS NULL THEN 'no_matching_state' WHEN NOT placed OR bad_state THEN 'unusable_state' WHEN all_n_state < 3 * arms THEN 'too_short'"
    moves, turns = "coalesce(linear_moves, false)", "coalesce(angular_moves, false)"
    cover: list[Coverage] = [
        ("shape", "true", f"{usable} END"), *((x, "true", f"{wide} END") for x in ("speed_limit", "normalized_range", "smoothness")), ("looks_like_position", "true", f"{wide} {seen} END"),
        ("tracking", "true", f"{wide} {seen} WHEN hz IS NULL THEN 'no_control_freq' WHEN NOT {moves} AND NOT {turns} THEN 'too_little_motion' END"),
        ("tracking", f"all_vague > 0 AND hz IS NOT NULL AND {moves}", "'unknown_state_orientation'"),
        ("linear_angular_order", "true", f"{wide} {seen} WHEN hz IS NULL THEN 'no_control_freq' WHEN all_vague > 0 THEN 'unknown_state_orientation' WHEN NOT ({moves} AND {turns}) THEN 'too_little_motion' END"),
    ]
    rules = [(n, cond & c("all_bad").isNotNull(), told) for n, cond, told in poses.velocity_rules(config)] + poses.tracking_rules(config)
    return outcomes(rows, "cartesian_velocity", cover, config, rules, key=f"'{poses.VELOCITY}'")


def cameras(t: Tables, config: Config = DEFAULTS, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Outcomes of videos, alone and against motion; ignored cameras are passed over by all checks."""
    enabled = [k for k, v in config["video"].items() if v["enabled"]]
    videos, left = vm.without_ignored(t.videos, ignored, "name")
    frames, left_frames = vm.without_ignored(t.frames, ignored)
    state = vm.state_motion(t.motion)
    named = frames.select("episode_id", F.col("camera").alias("name")).distinct().join(t.rates.select("episode_id", "fps"), "episode_id")
    # one small array per episode or camera, which most checks read
    moved, diffs = saved(vm.motion_of(state, t.rates), "motion", by_rows=True), saved(vm.diffs_of(frames, named), "diffs")
    per = videos.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_videos"), F.count_if(c("file_exists") & (c("fps") > 0)).alias("n_durations"))
    positions = t.motion.where("grp = 'state'").groupBy("episode_id").agg(F.max(c("key").isin("joint_position", "cartesian_position")).alias("placed"), F.max(c("key") != "gripper_position").alias("moves"))
    rows = t.episodes.select("episode_id").join(per, "episode_id", "left").join(positions, "episode_id", "left")
    none = "CASE WHEN coalesce(n_videos, 0) = 0 THEN 'no_video_files'"
    by_state = ("state_jump", "recording_gap", "periodic_skips", "choppy", "frozen")
    cover: list[Coverage] = [(x, "true", f"{none} WHEN coalesce(n_durations, 0) < 2 THEN 'fewer_than_two_cameras' END" if x == "camera_duration_mismatch" else f"{none} END") for x in enabled]
    cover += [(x, "n_videos > 0 AND NOT coalesce(moves, false)", "'no_robot_state'") for x in by_state]
    cover.append(("periodic_skips", "n_videos > 0 AND moves AND NOT coalesce(placed, false)", "'no_position_state'"))
    all_of = "'all'"
    parts = [outcomes(rows, "video", cover, config, key=all_of)]
    out = left.select("episode_id", "camera").unionByName(left_frames.select("episode_id", "camera")).distinct()
    if ignored:
        parts.append(outcomes(out, "video", [(x, "true", "'ignored_camera'") for x in enabled], config, key="camera"))
    find = lambda rows, check=None, key="camera", **told: parts.append(found_rows(rows, "video", config, check, key, **told))
    find(video.containers(videos, t.episodes, config), key="key", metric="metric")
    find(video.camera_durations(videos, config), "camera_duration_mismatch", all_of, metric="gap")
    find(vm.corrupted(diffs, config), "corrupted_frames", at="frame")
    find(vm.jumps_and_gaps(vm.state_jumps(moved, config), diffs, config), key=all_of, at="t", note="nullif(cameras, '')")
    find(vm.video_jumps(diffs, moved, config), "video_jump", metric="time_s", at="frame")
    find(vm.still_frames(diffs, moved, config), metric="metric")
    find(vm.periodic_skips(moved, vm.position_motion(t.motion), diffs, config), "periodic_skips", all_of, metric="confirmed", n="jumps", at="period")
    bright = video.brightness(frames, config)
    find(bright, "brightness", metric="median", other="share_extreme", note="problem")
    return motion.union_all(*parts)


PASSES: dict[str, Callable[..., DataFrame]] = {"keys": keys, "cartesian_position": cartesian_position, "cartesian_velocity": cartesian_velocity, "video": cameras}


def run(t: Tables, at: str, config: Config = DEFAULTS, passes: tuple[str, ...] = CATEGORIES, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Run these passes and put their outcomes into the ledger at ``at``; each replaces its own categories alone."""
    for name in passes:
        ledger.write(PASSES[name](t, config, ignored) if name == "video" else PASSES[name](t, config), at)
    return ledger.read(t.episodes.sparkSession, at)
