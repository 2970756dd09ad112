"""Camera frames against the robot's motion.

A camera's differences of frames and an episode's sizes of state steps are small arrays, one number per frame or step;
they are gathered once per episode, and each rule is an expression over them. Windows are one second wide, so their
width depends on the episode's rate, which frames of window functions can't express.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendon.functions.columns import once
from tendon.functions.rotations import let
from tendon.functions.series import gathered
from tendon.operators.config import DEFAULTS, Config

c = F.col

#: How far a step must be above nothing, in shares of the 95th percentile, to count as moving.
MOVING_SHARE_OF_P95 = 0.1
SKIP_WINDOW, MIN_PERIOD, MAX_PERIOD, DIFF_FLOOR = 8, 3, 30, 0.05


def continuous(rows: DataFrame, keys: list[str], order: str, quaternion: str) -> DataFrame:
    """Adds ``sign``: -1 where a quaternion must be turned over to lie on the side of the (turned) one before it.

    Quaternions at a right angle start anew, as do those after them.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    dot = F.aggregate(F.zip_with(c(quaternion), F.lag(quaternion).over(w), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumn("__dot", dot)
    rows = rows.withColumn("__island", F.sum(F.when(c("__dot") == 0, 1).otherwise(0)).over(w))
    turns = F.sum(F.when(c("__dot") < 0, 1).otherwise(0)).over(Window.partitionBy(*keys, "__island").orderBy(order))
    return rows.withColumn("sign", F.when(turns % 2 == 1, -1.0).otherwise(1.0)).drop("__dot", "__island")


def unwrap(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Adds the values without jumps of a whole turn, for columns that look like radians: all within pi + 0.1."""
    w = Window.partitionBy(*keys).orderBy(order)
    fits = F.max(F.abs(value)).over(Window.partitionBy(*keys)) <= math.pi + 0.1
    step = c(value) - F.lag(value).over(w)
    turns = F.when(F.abs(step) > math.pi, -F.signum(step) * F.ceil((F.abs(step) - math.pi) / (2 * math.pi))).otherwise(0.0)
    rows = rows.withColumn("__fits", fits).withColumn("__turns", F.coalesce(turns, F.lit(0.0)))
    rows = rows.withColumn(out, c(value) + F.when(c("__fits"), 2 * math.pi * F.sum("__turns").over(w.rowsBetween(Window.unboundedPreceding, 0))).otherwise(0.0))
    return rows.drop("__fits", "__turns")


def _signs(x: np.ndarray, none: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The sign of each entry of a key's rows: -1 in quaternions that ``continuous`` turns over."""
    sign = np.ones(x.shape)
    for arm in range(x.shape[1] // 7):
        own = np.flatnonzero((width > 7 * arm) & ((width % 7 == 0) | (arm == 0)))
        q = slice(7 * arm + 3, 7 * arm + 7)
        pose = (width[own] % 7 == 0) & ~none[own, q].any(axis=1)
        dot = np.where(pose[1:] & pose[:-1], (x[own[1:], q] * x[own[:-1], q]).sum(axis=1), np.nan)
        turns = np.cumsum(np.concatenate([[0], dot < 0]))
        starts = np.maximum.accumulate(np.concatenate([[0], np.where(dot == 0, np.arange(1, len(own)), 0)]))
        odd = (turns - turns[starts]) % 2 == 1
        sign[own[odd & (width[own] % 7 == 0)], q] = -1
    return sign


def _flat(key: str, x: np.ndarray, none: np.ndarray, width: np.ndarray) -> np.ndarray:
    """A key's rows, by step and column, with continuous quaternions and unwrapped angles."""
    if key == "cartesian_position":
        x = x * _signs(x, none, width)
    elif key != "joint_position":
        return x
    out = x.copy()
    for d in range(x.shape[1]):
        own = np.flatnonzero(width > d)
        angle = np.full(len(own), True) if key == "joint_position" else (width[own] % 7 != 0) & (width[own] % 6 == 0) & (d % 6 >= 3)
        v, known = x[own, d], ~none[own, d]
        if angle.any() and np.all(np.abs(v[known]) <= math.pi + 0.1):
            step = np.where(known[1:] & known[:-1], np.diff(v), 0.0)
            turns = np.where(np.abs(step) > math.pi, -np.sign(step) * np.ceil((np.abs(step) - math.pi) / (2 * math.pi)), 0.0)
            out[own, d] = np.where(angle, v + 2 * math.pi * np.concatenate([[0.0], np.cumsum(turns)]), v)
    return out


def _step_sizes(keys: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sizes of an episode's steps from ``(key, t, values, which are null, widths)`` of its states."""
    end = min(t[width > d].max() for _, t, x, _, width in keys for d in range(x.shape[1]))
    at = np.unique(np.concatenate([t[(t > 0) & (t <= end)] for _, t, *_ in keys]))
    total = np.zeros(len(at))
    for key, t, x, none, width in keys:
        flat, known = _flat(key, x, none, width), ~none
        for lo, hi in zip([0, *np.unique(width)], np.unique(width)):  # columns that the same rows have
            own = np.flatnonzero((width >= hi) & (t <= end))
            v, k = np.where(known[own, lo:hi], flat[own, lo:hi], 0.0), known[own, lo:hi]
            n = np.maximum(k.sum(axis=0), 1)
            mean = v.sum(axis=0) / n
            sd = np.sqrt((np.where(k, v - mean, 0.0) ** 2).sum(axis=0) / n)
            move = np.where(k[1:] & k[:-1], np.diff(v, axis=0), 0.0) / np.where(np.isfinite(sd) & (sd > 1e-12), sd, 1.0)
            late = t[own[1:]] > 0
            np.add.at(total, np.searchsorted(at, t[own[1:]][late]), (move**2).sum(axis=1)[late])
    return np.where(np.isfinite(total), np.sqrt(total), 0.0)


def _motion(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches):
        ids, t, vals = batch.column("episode_id").to_numpy(), batch.column("t").to_numpy(), batch.column("vals")
        code = pc.dictionary_encode(batch.column("key"))
        keys, code = code.dictionary.to_pylist(), code.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(vals).to_numpy())])
        entries = vals.flatten()
        none, entries = entries.is_null().to_numpy(zero_copy_only=False), entries.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(ids) != 0) | (np.diff(code) != 0), [True]]))
        per: dict[int, list] = {}
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            width = np.diff(ends[lo : hi + 1])
            there = np.arange(width.max()) < width[:, None]
            x, gone = np.full(there.shape, np.nan), np.ones(there.shape, bool)
            x[there], gone[there] = entries[ends[lo] : ends[hi]], none[ends[lo] : ends[hi]]
            per.setdefault(int(ids[lo]), []).append((keys[code[lo]], t[lo:hi], x, gone, width))
        with np.errstate(all="ignore"):
            made = {e: s for e, x in per.items() if len(s := _step_sizes(x))}
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array(list(made.values()), pa.list_(pa.float64()))], ["episode_id", "step"])


def state_motion(steps: DataFrame) -> DataFrame:
    """``(episode_id, step)``: an array with the size of each step of all states but the gripper's, each column in its spread.

    Quaternions of seven-wide poses are made continuous; joints and the angles of six-wide poses are unwrapped where
    they look like radians. Only steps that all states have count; what isn't a number moves nothing. Spark deals and sorts
    the steps by episode; an episode's own steps, which the result has in one row, are an array in its task.
    """
    rows = steps.where("grp = 'state' and key <> 'gripper_position' and size(vals) > 0 and episode_id is not null and t is not null")
    rows = rows.select(c("episode_id").cast("long").alias("episode_id"), "key", c("t").cast("long").alias("t"), c("vals").cast("array<double>").alias("vals"))
    return rows.repartition("episode_id").sortWithinPartitions("episode_id", "key", "t").mapInArrow(_motion, "episode_id long, step array<double>")


def percentile_of(xs: Column, share: float) -> Column:
    """The percentile of an array, between neighbours in proportion; null of nothing."""
    s = F.array_sort(xs)
    at = (F.size(xs) - 1) * share
    lo = F.floor(at).cast("int")
    a, b = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(xs) - 1))
    return a + (b - a) * (at - lo)


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, v: a + v) / F.when(F.size(xs) > 0, F.size(xs))


def _sides(xs: Column, lo: Column, hi: Column, window: Column) -> Column:
    """``window`` entries on either side of the places from lo to hi, both left out."""
    start = F.greatest(F.lit(0), lo - window)
    return F.concat(F.slice(xs, start + 1, F.greatest(F.lit(0), F.least(lo, F.size(xs)) - start)), F.slice(xs, F.least(hi, F.size(xs)) + 2, F.greatest(F.lit(0), window)))


def _window(rate: Column) -> Column:
    return F.greatest(F.lit(2), F.bround(rate).cast("int"))


def motion_of(state: DataFrame, episodes: DataFrame, share: float = MOVING_SHARE_OF_P95) -> DataFrame:
    """``(episode_id, step, p95, moving, hz)``: sizes of steps, whether each counts as moving, and the rate; null or no rate is 0."""
    rows = state.join(episodes.select("episode_id", "control_freq"), "episode_id")
    good = c("control_freq").isNotNull() & ~F.isnan("control_freq") & (c("control_freq") > 0)
    rows = rows.withColumn("p95", once(percentile_of(c("step"), 0.95))).withColumn("hz", F.when(good, c("control_freq")).otherwise(0.0))
    return rows.select("episode_id", "step", "p95", F.transform("step", lambda x: (c("p95") > 0) & (x > share * c("p95"))).alias("moving"), "hz")


def state_jumps(motion: DataFrame, config: Config = DEFAULTS, share: float = MOVING_SHARE_OF_P95) -> DataFrame:
    """``(episode_id, t, ratio, hz)``: single steps far above the mean of the second around them, while the robot moves."""
    own = config["video"]["state_jump"]
    window = _window(F.when(c("hz") > 0, c("hz")).otherwise(10.0))
    rows = motion.where(F.size("step") >= 5).withColumn("w", window)

    def entry(x: Column, t: Column) -> Column:
        return F.struct(x.alias("v"), _sides(c("step"), t, t, c("w")).alias("near"))

    rows = rows.withColumn("x", once(F.transform("step", entry)))
    ratio = lambda x: F.when(_mean(x["near"]) > 0, x["v"] / _mean(x["near"])).otherwise(float("inf"))
    busy = lambda x: 2 * F.size(F.filter(x["near"], lambda v: v > share * c("p95"))) >= F.size(x["near"])
    flag = lambda x: (ratio(x) >= own["jump_ratio"]) & (x["v"] >= own["min_fraction_of_p95"] * c("p95")) & (x["v"] > 0) & (F.size(x["near"]) > 0) & busy(x)
    rows = rows.select("episode_id", "hz", once(F.transform("x", lambda x: F.struct(flag(x).alias("jump"), ratio(x).alias("ratio")))).alias("x"))
    at = F.transform("x", lambda x, t: F.struct(t.alias("t"), x["ratio"].alias("ratio"), (x["jump"] & ~F.coalesce(F.get("x", t - 1)["jump"], F.lit(False)) & ~F.coalesce(F.get("x", t + 1)["jump"], F.lit(False))).alias("alone")))
    rows = rows.select("episode_id", "hz", F.explode(F.filter(at, lambda x: x["alone"])).alias("x"))
    return rows.select("episode_id", c("x.t").cast("long").alias("t"), "x.ratio", "hz")


def diffs_of(stats: DataFrame, videos: DataFrame) -> DataFrame:
    """``(episode_id, camera, diff, skip, fps)``: a camera's differences of neighbouring frames and of those two apart."""
    return camera_diffs(stats).join(videos.select("episode_id", c("name").alias("camera"), "fps"), ["episode_id", "camera"], "left")


def camera_diffs(stats: DataFrame) -> DataFrame:
    """The same without the rates."""
    per = stats.groupBy("episode_id", "camera").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "diff", "skip_diff"))).alias("x"))
    return per.select("episode_id", "camera", F.array_compact(F.transform("x", lambda x: x["diff"])).alias("diff"), F.array_compact(F.transform("x", lambda x: x["skip_diff"])).alias("skip"))


def corrupted_at(config: Config = DEFAULTS) -> Column:
    """Frames unlike both neighbours, which are like each other."""
    own = config["video"]["corrupted_frames"]
    each = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("diff") - 1))
    low = lambda t: F.least(F.get("diff", t - 1), F.get("diff", t))
    return F.filter(each, lambda t: (t < F.size("diff")) & (low(t) >= own["glitch_diff"]) & (low(t) / (F.get("skip", t - 1) + 1.0) >= own["glitch_ratio"]))


def corrupted(cameras: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """``(episode_id, camera, frame)`` of corrupted frames, from arrays of differences."""
    rows = cameras.where(F.size("diff") > 1).select("episode_id", "camera", F.explode(corrupted_at(config)).alias("frame"))
    return rows.select("episode_id", "camera", c("frame").cast("long").alias("frame"))


def _state_jumps_then(time: Column, ratio: float) -> Column:
    """Whether a step within one of the time is above so many times the mean of the second around."""
    k = F.bround(time * c("hz")).cast("int") - 1
    lo, hi = F.greatest(F.lit(0), k - 1), F.least(F.size("step") - 1, k + 1)
    near = F.slice("step", lo + 1, F.greatest(F.lit(0), hi - lo + 1))
    around = F.coalesce(_mean(_sides(c("step"), lo, hi, _window(c("hz")))), F.lit(0.0))
    usable = (c("hz") > 0) & (F.size("step") >= 3) & (hi >= lo)
    return F.coalesce(usable & (F.array_max(near) > ratio * around), F.lit(False))


def video_jumps(cameras: DataFrame, motion: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """``(episode_id, camera, frame, time_s)``: frames that jump away from the second around them while the robot's state
    changes smoothly; differences beside a corrupted frame don't count."""
    own = config["video"]["video_jump"]
    rows = cameras.join(motion.select("episode_id", "step", "hz"), "episode_id", "left")
    rate = F.coalesce(F.when(c("fps") > 0, c("fps")), F.when(c("hz") > 0, c("hz")), F.lit(1.0))
    rows = rows.withColumn("bad", once(corrupted_at(config))).withColumn("rate", rate).withColumn("w", _window(c("rate")))
    out = lambda t: F.exists("bad", lambda b: (b == t) | (b - 1 == t))
    jump = lambda t: (F.get("diff", t) >= own["jump_diff"]) & ~out(t) & (F.get("diff", t) >= own["jump_ratio"] * (percentile_of(_sides(c("diff"), t, t, c("w")), 0.5) + 1.0))
    rows = rows.where(F.size("diff") > 0).withColumn("t", F.explode(F.filter(F.sequence(F.lit(0), F.size("diff") - 1), jump)))
    rows = rows.withColumn("time", (c("t") + 1) / c("rate"))
    shared = F.when(c("step").isNull(), False).otherwise(_state_jumps_then(c("time"), own["state_jump_ratio"]))
    return rows.where(~shared).select("episode_id", "camera", c("t").cast("long").alias("frame"), F.round("time", 6).alias("time_s"))


def jumps_and_gaps(jumps: DataFrame, cameras: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """``(episode_id, check_name, t, cameras)``: a jump of the state that cameras share is a gap in the recording."""
    time = F.when(c("hz") > 0, (c("t") + 1) / c("hz")).otherwise((c("t") + 1).cast("double"))
    rows = jumps.withColumn("time", time).join(cameras, "episode_id", "left")
    rate = F.coalesce(F.when(c("fps") > 0, c("fps")), F.when(c("hz") > 0, c("hz")), F.lit(0.0))
    k = F.bround(c("time") * rate).cast("int") - 1
    lo, hi = F.greatest(F.lit(0), k - 1), F.least(F.size("diff") - 1, k + 1)
    base = F.coalesce(percentile_of(_sides(c("diff"), F.greatest(F.lit(0), k - 1), k + 1, _window(rate)), 0.5), F.lit(0.0))
    near = F.slice("diff", lo + 1, F.greatest(F.lit(0), hi - lo + 1))
    shares = F.coalesce((rate > 0) & (F.size("diff") >= 3) & (hi >= lo) & (F.array_max(near) / (base + 1.0) >= config["video"]["recording_gap"]["video_jump_ratio"]), F.lit(False))
    per = rows.withColumn("shares", shares).groupBy("episode_id", "t").agg(F.array_join(F.array_sort(F.collect_set(F.when(c("shares"), c("camera")))), ",").alias("cameras"))
    return per.select("episode_id", F.when(c("cameras") != "", "recording_gap").otherwise("state_jump").alias("check_name"), "t", "cameras")


def on_frames(mask: Column, n: Column) -> Column:
    """A mask of steps for n frames: each frame takes the step at the same share of the way."""
    last = F.size(mask) - 1
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(mask, F.bround(i * last / F.greatest(n - 1, F.lit(1))).cast("int")))
    return F.when(n < 1, F.slice(mask, 1, 0)).when((F.size(mask) == n) | (F.size(mask) == 0), F.slice(mask, 1, n)).otherwise(each)


def still_frames(cameras: DataFrame, motion: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """``(episode_id, check_name, camera, metric)``: cameras that stand still (``frozen``, seconds) or stutter (``choppy``,
    share of equal frames) while the robot moves."""
    frozen, choppy = config["video"]["frozen"], config["video"]["choppy"]
    rows = cameras.join(motion.select("episode_id", "moving", "hz"), "episode_id").where((F.size("diff") >= 3) & F.exists("moving", lambda x: x))
    rate = F.coalesce(F.when(c("fps") > 0, c("fps")), F.when(c("hz") > 0, c("hz")), F.lit(1.0))
    rows = rows.withColumn("mov", once(on_frames(c("moving"), F.size("diff")))).withColumn("rate", rate)
    still = F.zip_with("diff", "mov", lambda d, m: (d < frozen["static_diff"]) & m)
    run = F.aggregate(still, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), lambda a, x: F.struct(F.when(x, a["now"] + 1).otherwise(0).alias("now"), F.greatest(a["best"], F.when(x, a["now"] + 1).otherwise(0)).alias("best")))
    same = F.size(F.filter(F.zip_with("diff", "mov", lambda d, m: (d < choppy["duplicate_diff"]) & m), lambda x: x))
    moved = F.size(F.filter("mov", lambda x: x))
    rows = rows.withColumn("seconds", run["best"] / c("rate")).withColumn("share", same / F.when(moved > 0, moved))
    found = F.array_compact(F.array(
        F.when(c("seconds") >= frozen["frozen_s"], F.struct(F.lit("frozen").alias("check_name"), c("seconds").alias("metric"))), F.when(c("share") >= choppy["choppy_fraction"], F.struct(F.lit("choppy").alias("check_name"), c("share").alias("metric"))),
    ))
    return rows.select("episode_id", "camera", F.explode(found).alias("x")).select("episode_id", "x.check_name", "camera", F.round("x.metric", 6).alias("metric"))


def rolling_median(xs: Column, half: int = SKIP_WINDOW) -> Column:
    """The median of each entry and ``half`` on either side, nulls above all; the ends are repeated beyond the array."""
    padded = F.concat(F.array_repeat(F.get(xs, F.lit(0)), half), xs, F.array_repeat(F.get(xs, F.size(xs) - 1), half))
    # sort_array is compiled and puts nulls first, so that so many of the lower places are theirs
    near = lambda p, t: F.sort_array(F.slice(p, t + 1, F.lit(2 * half + 1)))
    middle = lambda near: F.get(near, half + F.size(F.filter(near, lambda v: v.isNull())))
    return let(padded, lambda p: F.when(F.exists(p, lambda v: v.isNull()), F.transform(xs, lambda _, t: let(near(p, t), middle))).otherwise(F.transform(xs, lambda _, t: F.get(near(p, t), F.lit(half)))))


def position_motion(steps: DataFrame) -> DataFrame:
    """``(episode_id, jump, in_cm, da, ds)``: how far each step goes by the joints, or by the hand where no joint is recorded.

    ``jump`` has the largest change of a joint (in its own unit) or the longest way of an arm's hand (in centimetres,
    ``in_cm``); ``da`` and ``ds`` the lengths of the changes of commands and states in the first space that has both,
    joints before positions of hands, and are empty without one. Episodes without a state of position have no row.
    """
    rows = steps.where("key in ('joint_position', 'cartesian_position') and grp in ('state', 'action')").repartition("episode_id")
    flat = """transform(CASE WHEN key = 'cartesian_position' AND size(vals) % 7 = 0 THEN flatten(transform(sequence(0, int(size(vals) / 7) - 1), k -> slice(vals, 7 * k + 1, 3))) ELSE vals END, v -> nanvl(v, 0D))"""
    w = Window.partitionBy("episode_id", "grp", "key").orderBy("t")
    rows = rows.withColumn("flat", F.expr(flat)).withColumn("before", F.lag("flat").over(w)).withColumn("move", F.expr("zip_with(flat, before, (a, b) -> a - b)")).where("t > 0")
    length = "sqrt(aggregate({}, 0D, (a, v) -> a + v * v))".format
    way = f"""CASE WHEN key = 'joint_position' THEN array_max(transform(move, v -> abs(v))) WHEN size(vals) % 7 = 0 THEN 100 * array_max(transform(sequence(0, int(size(vals) / 7) - 1), k -> {length("slice(move, 3 * k + 1, 3)")}))
      ELSE 100 * {length("slice(move, 1, 3)")} END"""
    one = lambda g, k, x: f"transform(sort_array(collect_list(CASE WHEN grp = '{g}' AND key = '{k}' THEN named_struct('t', t, 'x', {x}) END)), y -> y.x)"
    rows = rows.withColumn("way", F.expr(way)).withColumn("len", F.expr(length("move"))).groupBy("episode_id").agg(
        *(F.expr(one("state", k, "way")).alias(f"way_{k[0]}") for k in ("joint_position", "cartesian_position")), *(F.expr(one(g, k, "len")).alias(f"{g[0]}_{k[0]}") for g in ("state", "action") for k in ("joint_position", "cartesian_position"))
    ).where("size(way_j) > 0 or size(way_c) > 0")
    pick = lambda g: F.expr(f"CASE WHEN size(s_j) > 0 AND size(a_j) > 0 THEN {g}_j WHEN size(s_c) > 0 AND size(a_c) > 0 THEN {g}_c ELSE slice(s_j, 1, 0) END")
    return rows.select("episode_id", F.expr("CASE WHEN size(way_j) > 0 THEN way_j ELSE way_c END").alias("jump"), F.expr("size(way_j) = 0").alias("in_cm"), pick("a").alias("da"), pick("s").alias("ds"))


def scored_periods(gaps: Column) -> Column:
    """``(exact, p, near)`` of each period, p negative: the share of gaps that are multiples of it, and the share within
    one step of a multiple less what chance gives."""
    n = F.size(gaps).cast("double")

    def scored(p: Column) -> Column:
        near = F.size(F.filter(gaps, lambda g: F.least(g % p, p - g % p) <= 1)) / n - 3.0 / p
        return F.struct((F.size(F.filter(gaps, lambda g: g % p == 0)) / n).alias("exact"), (-p).alias("p"), near.alias("near"))

    return F.transform(F.sequence(F.lit(MIN_PERIOD), F.lit(MAX_PERIOD)), scored)


def periodic_skips(motion: DataFrame, positions: DataFrame, cameras: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """``(episode_id, period, jumps, confirmed)``: gaps of the recording at a regular period.

    Single steps that jump away from the median around them while the robot moves, that no command explains, that are
    regular and cover the motion, and that the joints (the hand where there are none) and a camera confirm.
    """
    own = config["video"]["periodic_skips"]
    rows = motion.where(F.size("step") >= 2 * SKIP_WINDOW + 1).join(positions, "episode_id").withColumn("med", once(rolling_median(c("step"))))
    rows = rows.withColumn("hit", once(F.transform("step", lambda x, t: (x > own["jump_ratio"] * F.get("med", t)) & F.get("moving", t))))
    alone = lambda x, t: x & ~F.coalesce(F.get("hit", t - 1), F.lit(False)) & ~F.coalesce(F.get("hit", t + 1), F.lit(False))
    idx = F.array_compact(F.transform("hit", lambda x, t: F.when(alone(x, t), t)))
    top = lambda i: F.array_max(F.slice("da", F.greatest(F.lit(0), i - 2) + 1, F.least(i, F.lit(2)) + 1))
    shared = F.least(F.size("da"), F.size("ds"))
    explained = lambda i: F.coalesce((i < shared) & (F.get("ds", i) > 0) & (top(i) >= own["command_explains_ratio"] * F.get("ds", i)), F.lit(False))
    rows = rows.withColumn("idx", once(F.filter(idx, lambda i: ~explained(i)))).where(F.size("idx") >= own["min_jumps"])
    gaps = F.transform(F.slice("idx", 2, F.size("idx")), lambda i, k: i - F.get("idx", k))
    rows = rows.withColumn("gaps", once(gaps)).withColumn("every", once(scored_periods(c("gaps"))))
    rows = rows.withColumn("top", once(F.array_max(F.transform("every", lambda x: x["near"])))).where("top > 0")
    # of the periods within 0.05 of the best, the one with the most exact multiples, the smaller of equals
    best = F.array_max(F.filter("every", lambda x: x["near"] >= c("top") - 0.05))
    rows = rows.withColumn("best", once(best)).where(c("best.near") >= own["min_period_score"])
    moved = F.size(F.filter("moving", lambda x: x))
    rows = rows.where(F.size("idx") * -c("best.p") >= own["min_coverage"] * moved)
    rows = rows.withColumn("jmed", once(rolling_median(c("jump")))).withColumn("extra", F.transform("idx", lambda i: F.get("jump", F.least(i, F.size("jump") - 1)) - F.get("jmed", F.least(i, F.size("jump") - 1))))
    # an episode's cameras come to it in one row, so that what is above is made once, and medians of frames for what is left of it
    seen = cameras.groupBy("episode_id").agg(F.collect_list(F.struct("diff")).alias("seen"))
    rows = rows.join(seen, "episode_id").withColumn("seen", once(F.transform("seen", lambda x: F.struct(x["diff"].alias("diff"), rolling_median(x["diff"]).alias("dmed")))))
    frame = lambda x, i: F.bround(i * (F.size(x["diff"]) - 1) / F.greatest(F.size("step"), F.lit(1))).cast("int")
    peak = lambda x, f: F.array_max(F.slice(x["diff"], F.greatest(F.lit(0), f - 1) + 1, F.least(f, F.lit(1)) + 2))
    spike = lambda x, i: F.when(F.size(x["diff"]) >= 2 * SKIP_WINDOW + 1, let(frame(x, i), lambda f: peak(x, f) / (F.get(x["dmed"], f) + DIFF_FLOOR))).otherwise(0.0)
    rows = rows.withColumn("video", once(F.transform("idx", lambda i: F.array_max(F.transform("seen", lambda x: spike(x, i))))))
    least = F.when(c("in_cm"), own["min_ee_jump_cm"]).otherwise(own["min_joint_jump_rad"])
    sure = F.size(F.filter(F.zip_with("extra", "video", lambda e, v: (e >= least) & (v >= own["min_video_jump"])), lambda x: x)) / F.size("idx")
    return rows.withColumn("sure", sure).where(c("sure") >= own["min_confirmed_fraction"]).select("episode_id", (-c("best.p")).cast("long").alias("period"), F.size("idx").cast("long").alias("jumps"), F.round("sure", 6).alias("confirmed"))


def without_ignored(cameras: DataFrame, ignored: tuple[str, ...], name: str = "camera") -> tuple[DataFrame, DataFrame]:
    """Cameras that are checked, and skips ``(episode_id, camera, reason)`` of those that aren't, whatever their case."""
    out = F.lower(c(name)).isin(*(x.strip().lower() for x in ignored)) if ignored else F.lit(False)
    return cameras.where(~out), cameras.where(out).select("episode_id", c(name).alias("camera"), F.lit("ignored_camera").alias("reason"))
