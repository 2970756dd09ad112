"""Checks of actions against states.

``cell_metrics`` has one row per episode, key and dimension; ``key_metrics`` one per episode and key. Every check is a
projection of these, so one exchange on the episode serves all of them. A query names the keys it needs, and others
are left out before anything is aligned. Thresholds come from a configuration (``config.with_overrides``).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendon.functions import series
from tendon.functions.alignment import kept, rated, state_key
from tendon.functions.columns import finite, rms
from tendon.operators import cells
from tendon.operators.config import DEFAULTS, Config

c = F.col
INF = float("inf")
ARM_KEYS = ("joint_position", "joint_velocity", "cartesian_position", "cartesian_velocity")
GENERAL_KEYS = (*ARM_KEYS, "gripper_position", "gripper_binary")
COPY_KEYS = ("joint_position", "cartesian_position")
MATCH = 1e-6
#: Digits at which ratios of sums are compared with limits: the last bits of a sum depend on the order of its terms.
TIE_DIGITS = 9


def series_info(episodes: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """``(episode_id, info)``: the rate (``hz``), the numbers of joint names of actions and states (``an``, ``sn``), the state's
    column for each column of the action if names tell it (``pairs``), and which columns of the action are grippers by name.

    Joints are paired by name where the names of both fit, else by place; ``profiles`` are parsed.
    """
    from tendon.operators.profiles import joint_pairs
    from tendon.sources.recordings import names_or_none

    none = F.array().cast("array<string>")
    rows = rated(episodes.select("episode_id"), episodes)
    if profiles is None:
        rows = rows.withColumn("an", none).withColumn("sn", none)
    else:
        names = profiles.select("episode_id", names_or_none(c("p.action_joint_names")).alias("an"), names_or_none(c("p.robot_state_joint_names")).alias("sn"))
        rows = rows.join(names, "episode_id", "left").withColumns({x: F.coalesce(x, none) for x in ("an", "sn")})
    by_name = F.when(F.size(F.array_except("an", "sn")) == 0, joint_pairs(c("an"), c("sn"), F.size("an"), F.size("sn")))
    told = F.struct("hz", F.size("an").alias("an"), F.size("sn").alias("sn"), by_name.alias("pairs"), F.transform("an", lambda n: F.lower(n).contains("gripper")).alias("grips"))
    return rows.select("episode_id", told.alias("info"))


def cell_metrics(
    steps: DataFrame, episodes: DataFrame, profiles: DataFrame | None = None, keys: tuple[str, ...] | None = None, config: Config = DEFAULTS, medians: bool = False, flips: bool = False
) -> DataFrame:
    """Sums, extremes and jumps of each dimension of each action key; medians and sign flips on request.

    ``out`` marks columns that are grippers; ``period``, ``held`` and ``holds``, of the first dimension alone, say how long commands
    are mostly held, how often, and how many runs there are. Spark deals the steps by episode; a task makes the cells of whole episodes.
    """
    return _made(steps, episodes, profiles, keys, config, medians, flips, False)


def whole_keys(
    steps: DataFrame, episodes: DataFrame, profiles: DataFrame | None = None, keys: tuple[str, ...] | None = None, config: Config = DEFAULTS, medians: bool = False, flips: bool = False
) -> DataFrame:
    """``key_metrics`` of the cells, which are put together where they are made: no row per dimension leaves a task."""
    return _made(steps, episodes, profiles, keys, config, medians, flips, True)


def _made(steps: DataFrame, episodes: DataFrame, profiles: DataFrame | None, keys: tuple[str, ...] | None, config: Config, medians: bool, flips: bool, whole: bool) -> DataFrame:
    make = cells.maker(medians, flips, config["joint_position"]["step_jump"]["max_joint_speed_rad_s"], MATCH, config["general"]["command_rate"]["atol"], whole)
    shape = ", ".join(f"{n} {t}" for n, t in (cells.key_fields if whole else cells.fields)(medians, flips))
    rows = series.dealt(steps.where(kept(keys)), series_info(episodes, profiles)).mapInArrow(make, shape)
    return rows.withColumn("episode_id", F.nullif("episode_id", F.lit(series.NONE)))


def key_metrics(cell: DataFrame) -> DataFrame:
    """The cells' metrics of all dimensions together; grippers among joints count for what isn't finite, widths and changes alone."""
    own = lambda x: F.when(~c("out"), c(x))
    have = set(cell.columns)
    return cell.groupBy("episode_id", "key").agg(
        *(F.max(x).alias(x) for x in ("dim", "s_dim", "hz", "an", "sn", "n", "n_state", "n_next", "n_bad_state", "s_top", "changes", "copies", "period", "held", "holds")), F.max(c("s_high") - c("s_low")).alias("state_range"),
        *((F.sum(x) if x == "n_bad" else F.sum(own(x))).alias(x) for x in cells.SUMS if x in have), *(F.max(own(x)).alias(x) for x in ("top", "high", "top_jump", "s_high", *(["median"] if "median" in have else []))),
        *(F.min(own(x)).alias(x) for x in ("low", "s_low", "first_jump")), F.max(own("s_high") - own("s_low")).alias("span"), F.max(F.when(c("d") == 0, c("first"))).alias("first"),
        F.count_if("out").alias("grippers"), F.count_if(~c("out")).alias("columns"), F.sum(own("n_next")).alias("next_values"), F.sum(own("n_state")).alias("state_values"),
    )


def state_lengths(steps: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """``(episode_id, lengths)``: a map from each state key to its number of steps and its lowest and highest value."""
    per = steps.where(kept(keys)).where("grp = 'state'").groupBy("episode_id", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.array_min("vals")).alias("low"), F.max(F.array_max("vals")).alias("high"), F.count_if(F.exists("vals", lambda v: ~finite(v))).alias("bad")
    )
    return per.groupBy("episode_id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("n", "low", "high", "bad")))).alias("lengths"))


def with_states(keys: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds ``state``, the length and range of the whole state that observes the key; null without one."""
    return keys.join(lengths, "episode_id", "left").withColumn("state", F.element_at("lengths", state_key(c("key")))).drop("lengths")


FINDING = "metric double, other double, n bigint, at bigint, note string"
Rule = tuple[str, Column, dict[str, Column]]


def findings_of(rows: DataFrame, rules: list[Rule], category: str | None = None, config: Config = DEFAULTS) -> DataFrame:
    """``(episode_id, check_name, key, metric, other, n, at, note)`` of the rules that hold, from one pass over ``rows``.

    A rule is a name, a condition and what is told about it, another key among it. Rules that the configuration of the category turns off are left out.
    """
    if category is not None:
        rules = [r for r in rules if config[category][r[0]]["enabled"]]
    kinds = [x.split() for x in FINDING.split(", ")]

    def entry(name: str, told: dict[str, Column]) -> Column:
        values = [told[f].cast(t) if f in told else F.lit(None).cast(t) for f, t in kinds]
        values = [F.round(v, 6) if t == "double" else v for v, (_, t) in zip(values, kinds)]
        return F.struct(F.lit(name).alias("check_name"), told.get("key", c("key")).alias("key"), *(v.alias(f) for v, (f, _) in zip(values, kinds)))

    none = F.array().cast(f"array<struct<check_name:string,key:string,{','.join(f'{f}:{t}' for f, t in kinds)}>>")
    every = F.array(*(F.when(cond, entry(name, told)) for name, cond, told in rules)) if rules else none
    found = rows.select("episode_id", F.explode_outer(every).alias("found")).where("found is not null")
    return found.select("episode_id", "found.check_name", "found.key", *(c(f"found.{f}") for f, _ in kinds))


def metrics_of(rows: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """``(episode_id, check_name, key, metric)`` of rules that tell one number."""
    return findings_of(rows, [(name, cond, {"metric": metric}) for name, cond, metric in rules]).select("episode_id", "check_name", "key", "metric")


def ratio_of(a: Column, b: Column, none: float = INF) -> Column:
    return F.when(b > 0, F.sqrt(a / F.when(b > 0, b))).otherwise(F.lit(none))


def delta_rule(threshold: float, values: Column) -> tuple[Column, dict[str, Column]]:
    """Actions that fit the change to the next state better than the next state itself; over steps that have one."""
    ratio = ratio_of(c("to_move"), c("to_next"))
    return (c("n_next") >= 1) & (c("aa_next") > 0) & (ratio < threshold), {"metric": ratio, "other": rms(c("aa_next"), values)}


def general_rules(config: Config) -> list[Rule]:
    own = config["general"]
    ok, arm = c("n_bad") == 0, c("key").isin(*ARM_KEYS)
    sound = ok & (c("n_bad_state") == 0)
    copies, span = c("copies") / F.when(c("n_state") > 0, c("n_state")), c("state_range")
    slack = own["gripper_range"]["atol"]
    lo, hi = c("state.low"), c("state.high")
    scale = F.greatest(hi - lo, F.abs(lo), F.abs(hi))
    outside = F.greatest(lo - c("low"), c("high") - hi, F.lit(0.0))
    margin = F.greatest(own["gripper_command_range"]["max_fraction"] * scale, F.lit(own["gripper_command_range"]["min_margin"]))
    grip = sound & (c("key") == "gripper_position") & (c("dim") == c("s_dim")) & (c("n_state") >= 2)
    both = ratio_of(c("aa"), c("ss"))
    residual = ratio_of(c("to_next"), c("aa_next"))
    is_delta, told = delta_rule(own["delta_detection"]["ratio_threshold"], c("next_values"))
    is_delta = is_delta & (F.round(told["metric"], TIE_DIGITS) < own["delta_detection"]["ratio_threshold"])
    told_both, told_residual = F.round(both, TIE_DIGITS), F.round(residual, TIE_DIGITS)
    return [
        ("constant_action", ok & arm & (c("n") >= 2) & (c("changes") == 0), {"metric": c("first"), "other": span, "n": c("n"), "note": state_key(c("key"))}),
        ("length_mismatch", c("state").isNotNull() & (c("n") != c("state.n")), {"metric": c("n") - c("state.n"), "n": c("n"), "note": state_key(c("key"))}),
        ("action_copies_state", sound & c("key").isin(*COPY_KEYS) & (c("dim") == c("s_dim")) & (span > own["action_copies_state"]["atol"]) & (copies >= own["action_copies_state"]["min_fraction"]), {"metric": copies, "n": c("n_state")}),
        ("gripper_range", ok & (c("key") == "gripper_binary") & ((c("low") < -slack) | (c("high") > 1 + slack)), {"metric": c("low"), "other": c("high")}),
        ("gripper_command_range", ok & (c("key") == "gripper_position") & (c("state.bad") == 0) & (outside > margin), {"metric": outside, "other": margin}),
        ("scale_consistency", grip & ((told_both > own["scale_consistency"]["max_ratio"]) | (told_both < own["scale_consistency"]["min_ratio"])), {"metric": both}),
        ("tracking_residual", grip & (c("aa_next") > 0) & (told_residual > own["tracking_residual"]["max_normalized_rms"]), {"metric": residual}),
        ("delta_detection", grip & is_delta, told),
    ]


def general(keys: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Findings of the checks that hold for any action key; ``keys`` come with their states (``with_states``)."""
    return findings_of(keys, general_rules(config), "general", config)


def joint_position_rules(config: Config) -> list[Rule]:
    own = config["joint_position"]
    mine = c("key") == "joint_position"
    ok = mine & (c("n_bad") == 0)
    some = ok & (c("columns") > 0)
    limit = own["radians"]["max_abs_rad"]
    state_ok = (c("n_bad_state") == 0) & c("s_top").isNotNull()
    radians = (c("top") <= limit) if own["radians"]["enabled"] else F.lit(True)
    unit = lambda x: F.when(x <= limit, "").when(x <= 100.5, "degrees_or_normalized_100").when(x <= 400, "degrees").otherwise("unknown")
    wrong = F.concat_ws(",", F.when((c("an") > 0) & (c("an") != c("dim")), "action"), F.when((c("sn") > 0) & (c("s_dim") > 0) & (c("sn") != c("s_dim")), "state"),
                        F.when((c("an") == 0) & (c("sn") == 0) & (c("s_dim") > 0) & (c("s_dim") != c("dim")), "action_vs_state"))
    tracked = some & (c("n_bad_state") == 0) & (c("n_next") >= 1)
    is_delta, told = delta_rule(own["delta_detection"]["ratio_threshold"], c("next_values"))
    return [
        ("dof", ok & (wrong != ""), {"metric": c("dim"), "other": c("s_dim"), "n": c("an"), "note": wrong}),
        ("gripper_in_joints", ok & (c("an") == c("dim")) & (c("grippers") > 0), {"n": c("grippers")}),
        ("normalized_range", some & (F.abs(c("top") - 1) <= MATCH), {"metric": c("top")}),
        ("radians", some & ((c("top") > limit) | (state_ok & (c("s_top") > limit))), {"metric": c("top"), "other": F.when(state_ok, c("s_top")), "note": F.concat_ws("/", unit(c("top")), F.when(state_ok, unit(c("s_top"))))}),
        ("step_jump", some & radians & (c("n") >= 2) & (c("n_jumps") > 0), {"metric": c("top_jump"), "other": c("hz"), "n": c("n_jumps"), "at": c("first_jump")}),
        ("delta_detection", tracked & is_delta, told),
        ("tracking", tracked & radians & (c("median") > own["tracking"]["max_median_error_rad"]), {"metric": c("median")}),
    ]


def joint_position(keys: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Findings of joint positions; widths are compared with the names if there are any."""
    return findings_of(keys, joint_position_rules(config), "joint_position", config)


def jumping_joints(cell: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """``(episode_id, d, n, first_step, top)`` of joints that move too far in a step, where the joints are in radians."""
    own = config["joint_position"]
    rows = cell.where("key = 'joint_position' and not out")
    whole = Window.partitionBy("episode_id")
    rows = rows.withColumn("bad", F.sum("n_bad").over(whole)).withColumn("all_top", F.max("top").over(whole))
    rows = rows.where((c("bad") == 0) & (c("all_top") <= own["radians"]["max_abs_rad"]) & (c("n_jumps") > 0))
    return rows.select("episode_id", c("d").cast("long").alias("d"), c("n_jumps").alias("n"), c("first_jump").alias("first_step"), F.round("top_jump", 6).alias("top"))


def worst_joints(cell: DataFrame, most: int = 3) -> DataFrame:
    """``(episode_id, rank, d, median)``: the joints that follow worst; of equal ones the higher joint first."""
    w = Window.partitionBy("episode_id").orderBy(c("median").desc(), c("d").desc())
    rows = cell.where("key = 'joint_position' and n_bad = 0 and n_next > 0 and not out").withColumn("rank", F.row_number().over(w)).where(c("rank") <= most)
    return rows.select("episode_id", "rank", c("d").cast("long").alias("d"), F.round("median", 6).alias("median"))


def correlation(k: int) -> Column:
    """Correlation from the pooled sums of a lag; null of fewer than two pairs or where a side is constant."""
    n = c(f"n{k}")
    vx, vy = n * c(f"xx{k}") - c(f"x{k}") * c(f"x{k}"), n * c(f"yy{k}") - c(f"y{k}") * c(f"y{k}")
    moves = (vx > 1e-12 * n * c(f"xx{k}")) & (vy > 1e-12 * n * c(f"yy{k}"))
    return F.when((n >= 2) & moves, (n * c(f"xy{k}") - c(f"x{k}") * c(f"y{k}")) / F.sqrt(F.when(moves, vx) * F.when(moves, vy)))


def integration(rows: DataFrame, columns: Column, own: dict[str, object]) -> DataFrame:
    """Adds ``lag``, ``r``, ``ratio``, ``exact``, ``reasons`` and ``suspected``: how commanded motion per step fits the state's motion.

    ``rows`` have pooled sums of no lag and of one step over so many ``columns``; the lag with the higher correlation
    counts, no lag at a tie.
    """
    rows = rows.withColumn("r_0", correlation(0)).withColumn("r_1", correlation(1))
    usable = lambda k: c(f"n{k}") >= 2 * columns
    later = usable(1) & (~F.coalesce(usable(0), F.lit(False)) | (F.coalesce("r_1", F.lit(-2.0)) > F.coalesce("r_0", F.lit(-2.0))))
    pick = lambda x: F.when(c("lag") == 1, c(f"{x}1")).otherwise(c(f"{x}0"))
    rows = rows.withColumn("lag", F.when(later, 1).otherwise(0)).withColumn("r", F.when(c("lag") == 1, c("r_1")).otherwise(c("r_0")))
    rows = rows.withColumn("ratio", ratio_of(pick("xx"), pick("yy"))).withColumn("exact", (pick("yy") > 0) & (pick("dd") <= MATCH**2 * pick("yy")))
    known = c("ratio") < INF
    reasons = F.concat_ws(",", F.when(c("exact"), "copies_state_motion"), F.when(known & (c("ratio") > own["max_ratio"]), "too_large"), F.when(known & (c("ratio") < own["min_ratio"]), "too_small"),
                          F.when(~c("exact") & ~F.coalesce(c("r") >= own["min_correlation"], F.lit(False)), "doesnt_match_state_motion"))
    guess = F.when(known & (c("ratio") > 0), F.when(F.abs(F.ln(c("ratio") / math.degrees(1.0))) < math.log(2), "deg_per_s").when(F.abs(F.ln(c("ratio") * c("hz"))) < math.log(2), "per_step_delta"))
    return rows.withColumn("reasons", reasons).withColumn("suspected", guess).withColumn("usable", F.coalesce(usable(0) | usable(1), F.lit(False)))


def joint_velocity_rules(config: Config) -> list[Rule]:
    """Over keys with their integration."""
    own = config["joint_velocity"]
    ok = (c("key") == "joint_velocity") & (c("n_bad") == 0)
    state = ok & (c("n_bad_state") == 0) & (c("n_state") >= 3)
    rate, match = c("flips") / F.when(c("pairs") > 0, c("pairs")), ratio_of(c("to_next"), c("nn"))
    return [
        ("dof", ok & (c("an") > 0) & (c("an") != c("dim")), {"metric": c("dim"), "n": c("an")}),
        ("speed_limit", ok & (c("top") > own["speed_limit"]["max_joint_speed_rad_s"]), {"metric": c("top")}),
        ("normalized_range", ok & (F.abs(c("top") - 1) <= MATCH), {"metric": c("top")}),
        ("smoothness", ok & (rate > own["smoothness"]["max_sign_flip_rate"]), {"metric": rate, "n": c("flips")}),
        ("looks_like_position", state & (match < own["looks_like_position"]["max_position_match"]), {"metric": match}),
        ("tracking", state & c("hz").isNotNull() & (c("span") >= own["tracking"]["min_motion_rad"]) & (c("reasons") != ""), {"metric": F.when(c("ratio") < INF, c("ratio")), "other": c("r"), "n": c("lag"), "note": F.concat_ws(";", "reasons", "suspected")}),
    ]


def joint_velocity(keys: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Findings of joint velocities; what needs a rate is left out without one."""
    rows = integration(keys, c("columns"), config["joint_velocity"]["tracking"])
    return findings_of(rows, joint_velocity_rules(config), "joint_velocity", config)


def every_key(keys: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Findings of general checks, joint positions and joint velocities from one pass, with their ``category``.

    ``keys`` come with their states, medians and sign flips.
    """
    rows = integration(keys, c("columns"), config["joint_velocity"]["tracking"])
    made = {"general": general_rules, "joint_position": joint_position_rules, "joint_velocity": joint_velocity_rules}
    rules = [(f"{k}.{r[0]}", *r[1:]) for k, of in made.items() for r in of(config) if config[k][r[0]]["enabled"]]
    found = findings_of(rows, rules)
    return found.withColumn("category", F.substring_index("check_name", ".", 1)).withColumn("check_name", F.substring_index("check_name", ".", -1))


def command_rate(steps: DataFrame, episodes: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    return held_commands(whole_keys(steps, episodes, None, ARM_KEYS, config), config)


def held_commands(keys: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """``(episode_id, key, period, share, n_holds, effective_hz)`` of keys whose commands are mostly held for several steps.

    Runs between changes count, the first from step 0, the last not at all; of equally frequent lengths the smallest.
    The rate is null where the episode has none.
    """
    own = config["general"]["command_rate"]
    modal = keys.where(c("key").isin(*ARM_KEYS) & (c("n_bad") == 0) & (c("holds") >= own["min_holds"]) & (c("period") >= 2) & (c("held") >= own["min_fraction"] * c("holds")))
    return modal.select("episode_id", "key", "period", F.round(c("held") / c("holds"), 6).alias("share"), c("holds").alias("n_holds"), F.round(c("hz") / c("period"), 6).alias("effective_hz"))


def duplicate_pairs(steps: DataFrame, atol: float = 1e-9) -> DataFrame:
    """``(episode_id, key_a, key_b, max_abs_diff)`` of pairs of equal action arrays; what isn't a number equals nothing.

    Keys with as many arrays and entries, and with as large a sum of first entries as equal ones may have, are compared step by step.
    """
    acts = steps.where("grp = 'action'")
    one = F.get("vals", F.lit(0))
    sums = acts.groupBy("episode_id", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("vals")).alias("entries"), F.count(one).alias("firsts"), F.sum(one).alias("total"), F.sum(F.abs(one)).alias("size"))
    x, y = (sums.select("episode_id", *(c(v).alias(f"{v}_{k}") for v in ("key", "n", "entries", "firsts", "total", "size"))) for k in ("a", "b"))
    # first entries that are null are equal to anything, so that their sums tell nothing
    near = (c("firsts_a") < c("n_a")) | (c("firsts_b") < c("n_b")) | (F.abs(c("total_a") - c("total_b")) <= atol * c("n_a") + 1e-9 * (c("size_a") + c("size_b")))
    maybe = x.join(y, "episode_id").where((c("key_a") < c("key_b")) & (c("n_a") == c("n_b")) & F.equal_null("entries_a", "entries_b") & near).select("episode_id", "key_a", "key_b", "n_a")
    named = maybe.groupBy("episode_id").agg(F.collect_list(F.struct("key_a", "key_b", "n_a")).alias("maybe"))
    named = named.withColumn("wanted", F.array_union("maybe.key_a", "maybe.key_b"))
    rows = acts.join(named, "episode_id").where(F.array_contains("wanted", c("key"))).repartition("episode_id").groupBy("episode_id", "t").agg(F.first("maybe").alias("maybe"), F.collect_list(F.struct("key", "vals")).alias("own"))
    rows = rows.select("episode_id", "own", F.explode("maybe").alias("m")).select("episode_id", "m", "own", F.explode("own").alias("x")).where("x.key = m.key_a")
    pairs = rows.select("episode_id", "m", "x", F.explode("own").alias("y")).where("y.key = m.key_b and size(x.vals) = size(y.vals)")
    gap = F.array_max(F.transform(F.arrays_zip(c("x.vals").alias("a"), c("y.vals").alias("b")), lambda v: F.abs(v["a"] - v["b"])))
    same = pairs.select("episode_id", "m.*", gap.alias("gap")).groupBy("episode_id", "key_a", "key_b", "n_a").agg(F.count(F.lit(1)).alias("n_pairs"), F.max("gap").alias("max_abs_diff"))
    return same.where((c("max_abs_diff") <= atol) & (c("n_pairs") == c("n_a"))).select("episode_id", "key_a", "key_b", F.round("max_abs_diff", 6).alias("max_abs_diff"))


def missing_keys(steps: DataFrame) -> DataFrame:
    """``(episode_id, check_name, key)``: states that recorded actions need, and episodes without gripper_binary."""
    have = steps.groupBy("episode_id").agg(
        F.collect_set(F.when(c("grp") == "state", c("key"))).alias("states"), F.collect_set(F.when(c("grp") == "action", c("key"))).alias("actions")
    )
    need = F.array_distinct(F.concat(
        F.array(F.lit("gripper_position")),
        F.when(F.arrays_overlap("actions", F.array(F.lit("joint_position"), F.lit("joint_velocity"))), F.array(F.lit("joint_position"))).otherwise(F.array().cast("array<string>")),
        F.when(F.arrays_overlap("actions", F.array(F.lit("cartesian_position"), F.lit("cartesian_velocity"))), F.array(F.lit("cartesian_position"))).otherwise(F.array().cast("array<string>")),
    ))
    states = have.select("episode_id", F.lit("required_state_keys").alias("check_name"), F.explode(F.array_except(need, c("states"))).alias("key"))
    binary = have.where(~F.array_contains("actions", "gripper_binary")).select("episode_id", F.lit("gripper_binary_present").alias("check_name"), F.lit("gripper_binary").alias("key"))
    return states.unionByName(binary)


def skips(keys: DataFrame) -> DataFrame:
    """``(episode_id, key, reason)`` of action keys that checks pass over."""
    reason = [
        F.when(c("n_bad") > 0, F.lit("non_finite_values")), F.when(c("n") < 2, F.lit("too_short")), F.when(c("state").isNull(), F.lit("no_matching_state")),
        F.when(c("state").isNotNull() & (c("dim") != c("s_dim")), F.lit("feature_dim_mismatch")), F.when(c("state_range") <= 1e-6, F.lit("state_static")), F.when(c("hz").isNull(), F.lit("no_control_freq")),
    ]
    return keys.select("episode_id", "key", F.explode_outer(F.array(*reason)).alias("reason")).where("reason is not null")


def union_all(*found: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
