"""Checks of cartesian poses and velocities, of one arm or two.

Poses have seven numbers per arm, velocities six; ``episodes`` says whether there are two arms (``is_biarm``), and gives
the control rate. Arrays of another width, or with values that aren't finite, break the rule on shape and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendon.functions import series
from tendon.functions.alignment import kept, rated
from tendon.functions.columns import rms
from tendon.operators import arms, pursuit
from tendon.operators.config import DEFAULTS, Config
from tendon.operators.motion import MATCH, Rule, findings_of, integration, ratio_of

c = F.col
POSE, VELOCITY = "cartesian_position", "cartesian_velocity"


def declared_orientations(profiles: DataFrame) -> DataFrame:
    """``(episode_id, declared)``: how the states write orientations, from parsed profiles."""
    return profiles.select("episode_id", c("p.robot_state_orientation_representation").alias("declared"))


def arm_info(episodes: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """``(episode_id, info)``: the number of arms, the rate (``hz``), and how states write orientations if that is told."""
    own = rated(episodes.select("episode_id", F.when(c("is_biarm"), 2).otherwise(1).alias("arms")), episodes)
    if declared is not None:
        own = own.join(declared, "episode_id", "left")
    return own.select("episode_id", F.struct(*own.columns[1:]).alias("info"))


def pose_metrics(steps: DataFrame, episodes: DataFrame, declared: DataFrame | None = None, config: Config = DEFAULTS) -> DataFrame:
    """One row per episode and arm; angles are null without unit-like quaternions on both sides. ``same`` and ``swapped`` of two arms
    say how far commands lie from the next states of their own arm and of the other."""
    own = config["cartesian_position"]
    make = arms.pose_maker(own["quaternion_shape"]["norm_atol"], own["rotation_jump"]["max_angular_speed_deg_s"])
    return series.dealt(steps.where(kept((POSE,))), arm_info(episodes, declared)).mapInArrow(make, arms.POSES)


def _reach_unit(top: Column, own: dict[str, object]) -> Column:
    """The unit that puts a distance into an arm's reach; of two, the one nearer to its middle."""
    lo, hi = own["typical_reach_min_m"], own["typical_reach_max_m"]
    fits = lambda f: (top / f >= lo) & (top / f <= hi)
    off = lambda f: F.abs(F.ln(top / f / (lo * hi) ** 0.5))
    return F.when(fits(100.0) & (~fits(1000.0) | (off(100.0) <= off(1000.0))), "cm").when(fits(1000.0), "mm").otherwise("unknown")


def over_arms(rows: DataFrame, sums: tuple[str, ...], tops: tuple[str, ...]) -> DataFrame:
    """Adds ``all_<column>``, the sum or the largest over the arms of an episode; rows stay where they are."""
    whole = Window.partitionBy("episode_id")
    return rows.withColumns({f"all_{x}": F.sum(x).over(whole) for x in sums} | {f"all_{x}": F.max(x).over(whole) for x in tops} | {"all_fits": F.min("fits").over(whole)})


def cartesian_position(steps: DataFrame, episodes: DataFrame, config: Config = DEFAULTS, declared: DataFrame | None = None) -> DataFrame:
    """Findings of poses from one pass: those of an arm have its number as ``key``, from 1; those of the whole episode the action's key."""
    rows = over_arms(pose_metrics(steps, episodes, declared, config), ("pp", "ss", "aa_next", "to_next", "to_move", "n_next"), ("top", "s_top", "steps", "bad", "width"))
    return findings_of(rows.withColumn("key", (c("arm") + 1).cast("string")), position_rules(config), "cartesian_position", config)


def position_rules(config: Config) -> list[Rule]:
    """Rules over arms; those of the whole episode are told by its first arm."""
    own = config["cartesian_position"]
    some, limits = c("steps") >= 2, own["pose_tracking"]
    once, key = c("arm") == 0, {"key": F.lit(POSE)}
    long = once & (c("all_steps") >= 2)
    unit = own["position_units"]
    most = unit["max_abs_position_m"]
    ratio = F.when(c("all_ss") > 0, F.sqrt(c("all_pp") / F.when(c("all_ss") > 0, c("all_ss"))))
    far, s_far, scale = (F.coalesce(x, F.lit(False)) for x in (c("all_top") > most, c("all_s_top") > most, ratio > unit["max_action_state_ratio"]))
    by_ratio = F.when(F.abs(F.log10(ratio / 100.0)) < 0.5, "cm").when(F.abs(F.log10(ratio / 1000.0)) < 0.5, "mm").otherwise("unknown")
    guess = F.when(far | scale, F.when(~s_far & ratio.isNotNull(), by_ratio).otherwise(_reach_unit(c("all_top"), unit)))
    note = F.concat_ws(";", F.concat_ws(",", F.when(far, "action_out_of_range"), F.when(s_far, "state_out_of_range"), F.when(scale, "action_state_scale_mismatch")), guess, F.when(s_far, _reach_unit(c("all_s_top"), unit)))
    delta = ratio_of(c("all_to_move"), c("all_to_next"))
    return [
        ("quaternion_shape", once & ~c("all_bad") & ~c("all_fits"), {"metric": c("all_width"), "other": 7 * c("arms"), "note": F.lit("wrong_dim"), **key}),
        ("quaternion_shape", c("n_off") > 0, {"metric": c("least"), "other": c("most"), "n": c("n_off"), "note": F.lit("bad_quaternion_norm")}),
        ("quaternion_sign_flip", some & (c("flips") > 0), {"n": c("flips"), "at": c("first_flip")}),
        ("rotation_jump", some & (c("n_jumps") > 0), {"metric": c("top_angle"), "other": c("hz"), "n": c("n_jumps"), "at": c("first_jump")}),
        ("quaternion_scalar_order", some & ~c("zero") & (c("first_steady") > c("last_steady")), {"metric": c("first_steady"), "other": c("last_steady")}),
        ("pose_tracking", some & ~c("zero") & ((c("median_far") > limits["max_median_position_error_m"]) | (c("median_turned") > limits["max_median_orientation_error_deg"])), {"metric": c("median_far"), "other": c("median_turned")}),
        ("normalized_range", long & (F.abs(c("all_top") - 1) <= MATCH), {"metric": c("all_top"), **key}),
        ("position_units", long & (far | s_far | scale), {"metric": c("all_top"), "other": ratio, "note": note, **key}),
        ("delta_detection", long & (c("all_n_next") >= 1) & (c("all_aa_next") > 0) & (delta < own["delta_detection"]["ratio_threshold"]), {"metric": delta, "other": rms(c("all_aa_next"), 3 * c("all_n_next")), **key}),
    ]


def pose_errors(steps: DataFrame, episodes: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """``(episode_id, arm, ...)``: median, mean and largest distance and angle between a command and the next state.

    Angles are null where a state's orientation can't be read by its width and what is ``declared``."""
    names = [f"{k}_{x}" for x in ("far", "turned") for k in ("median", "mean", "most")]
    return pose_metrics(steps, episodes, declared).where("steps > 0").select("episode_id", (c("arm") + 1).cast("long").alias("arm"), *(F.round(n, 6).alias(n) for n in names))


def biarm_ordering(steps: DataFrame, episodes: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """``(episode_id, ratio)`` of two-armed episodes whose positions fit the other arm's states better."""
    return swapped_arms(pose_metrics(steps, episodes, None, config), config)


def swapped_arms(metrics: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """As ``biarm_ordering``, from ``pose_metrics``."""
    sums = metrics.where("arm = 0 and arms = 2 and steps > 0")
    ratio = ratio_of(c("swapped"), c("same"))
    return sums.where(ratio < config["cartesian_position"]["biarm_ordering"]["max_swap_ratio"]).select("episode_id", F.round(ratio, 6).alias("ratio"))


def velocity_rows(steps: DataFrame, episodes: DataFrame, declared: DataFrame | None = None, speeds: bool = True, moved: bool = True) -> DataFrame:
    """Speeds of each arm (``velocity_metrics``) and sums of velocities and motion (``integrations_of``), from one pass."""
    return series.dealt(steps.where(kept((VELOCITY,))), arm_info(episodes, declared)).mapInArrow(arms.velocity_maker(speeds, moved), arms.BOTH)


def velocity_metrics(rows: DataFrame) -> DataFrame:
    """One row per episode and arm: speeds, sign flips of dimensions that are large for their own scale, and likeness to the next state."""
    return rows.where("frame is null").select(*(x.split()[0] for x in arms.VELOCITIES.split(", ")))


def velocity_rules(config: Config) -> list[Rule]:
    """Rules over the whole episode, told by its first arm."""
    own = config["cartesian_velocity"]
    once, some = c("arm") == 0, (c("arm") == 0) & (c("all_steps") > 0)
    rate, match = c("all_flips") / F.when(c("all_pairs") > 0, c("all_pairs")), ratio_of(c("all_to_next"), c("all_nn"))
    speed = own["speed_limit"]
    return [
        ("shape", once & ~c("all_bad") & ~c("all_fits"), {"metric": c("all_width"), "other": 6 * c("arms")}),
        ("speed_limit", some & ((c("all_linear") > speed["max_linear_m_s"]) | (c("all_angular") > speed["max_angular_rad_s"])), {"metric": c("all_linear"), "other": c("all_angular")}),
        ("normalized_range", some & (F.abs(c("all_top") - 1) <= MATCH), {"metric": c("all_top")}),
        ("smoothness", some & (rate > own["smoothness"]["max_sign_flip_rate"]), {"metric": rate, "n": c("all_flips")}),
        ("looks_like_position", some & (c("all_n_state") >= 3 * c("arms")) & (match < own["looks_like_position"]["max_position_match"]), {"metric": match}),
    ]


def cartesian_velocity(steps: DataFrame, episodes: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Findings on shape, speed, range, smoothness and likeness to positions of cartesian velocities, from one pass."""
    rows = over_arms(velocity_metrics(velocity_rows(steps, episodes, moved=False)), ("pairs", "flips", "to_next", "nn", "n_state"), ("linear", "angular", "top", "bad", "width", "steps"))
    return findings_of(rows.withColumn("key", F.lit(VELOCITY)), velocity_rules(config), "cartesian_velocity", config)


def velocity_integrations(steps: DataFrame, episodes: DataFrame, config: Config = DEFAULTS, declared: DataFrame | None = None) -> DataFrame:
    return integrations_of(velocity_rows(steps, episodes, declared, speeds=False), config)


def integrations_of(rows: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """``(episode_id, frame, part, lag, r, ratio, reasons, suspected, moves)``: how velocities follow the motion that results.

    All axes of all arms are pooled, in the base's and the hand's frame; ``part`` is linear or angular, as given or
    ``swapped_``. Without a known orientation of the state only the base's linear part is there. ``moves`` says whether the robot went far enough from its start for the part to be judged.
    """
    own = config["cartesian_velocity"]["tracking"]
    per = rows.where("frame is not null").select(*(x.split()[0] for x in pursuit.SHAPE.split(", ")))
    per = integration(per, 3 * c("arms"), own).where("usable")
    moves = F.when(c("part").endswith("linear"), c("gone") >= own["min_translation_m"]).otherwise(c("rotated") >= own["min_rotation_deg"])
    return per.select("episode_id", "frame", "part", "lag", "r", F.when(c("ratio") < float("inf"), c("ratio")).alias("ratio"), "reasons", "suspected", moves.alias("moves"))


def tracked(each: DataFrame) -> DataFrame:
    """One row per episode of ``velocity_integrations``, in the frame that fits better, the base's at a tie."""
    of = lambda part, x: F.max(F.when(c("part") == part, c(x))).alias(f"{part}_{x}")
    names = ("linear", "angular", "swapped_linear", "swapped_angular")
    per = each.groupBy("episode_id", "frame").agg(*(of(p, x) for p in names for x in ("r", "ratio", "lag", "reasons", "suspected", "moves")))
    score = F.coalesce("linear_r", F.lit(-1.0)) + F.coalesce("angular_r", F.lit(-1.0))
    best = Window.partitionBy("episode_id").orderBy(F.round(score, 9).desc(), "frame")
    return per.withColumn("rank", F.row_number().over(best)).where("rank = 1").withColumn("key", F.lit(VELOCITY))


def tracking_rules(config: Config) -> list[Rule]:
    """Rules over ``tracked`` episodes."""
    own = config["cartesian_velocity"]
    listed = lambda p: F.when(c(f"{p}_moves"), F.array_join(F.transform(F.filter(F.split(f"{p}_reasons", ","), lambda x: x != ""), lambda x: F.concat(F.lit(f"{p}_"), x)), ","))
    reasons = F.array_join(F.filter(F.array(listed("linear"), listed("angular")), lambda x: x != ""), ",")
    given, swapped = (c("linear_r") + c("angular_r")) / 2, (c("swapped_linear_r") + c("swapped_angular_r")) / 2
    both = c("linear_moves") & c("angular_moves")
    return [
        ("tracking", (c("linear_moves") | c("angular_moves")) & (reasons != ""), {"metric": F.when(c("linear_moves"), c("linear_ratio")), "other": F.when(c("angular_moves"), c("angular_ratio")), "note": F.concat_ws(";", "frame", reasons, F.when(c("linear_moves"), c("linear_suspected")), F.when(c("angular_moves"), c("angular_suspected")))}),
        ("linear_angular_order", both & swapped.isNotNull() & (given.isNull() | (swapped > given + own["linear_angular_order"]["min_improvement"])), {"metric": given, "other": swapped, "note": c("frame")}),
    ]


def velocity_tracking(steps: DataFrame, episodes: DataFrame, config: Config = DEFAULTS, declared: DataFrame | None = None) -> DataFrame:
    """Findings of ``tracking`` and ``linear_angular_order``."""
    return findings_of(tracked(velocity_integrations(steps, episodes, config, declared)), tracking_rules(config), "cartesian_velocity", config)
