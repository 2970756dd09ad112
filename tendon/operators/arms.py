"""Poses and velocities of each arm beside the state's, as sums and extremes over arrays of whole episodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tendon.functions.rotations import EULER_ORDERS
from tendon.functions.series import NONE, Runs, Series, Steps, batch_of, gathered, steps_of
from tendon.operators import pursuit
from tendon.operators.pursuit import angle, dot, norm, product

POSE = "cartesian_position"
_TYPES = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_SHAPE = "episode_id bigint, arm int, bad boolean, fits boolean, width int, arms int, hz double, bad_state boolean, placed boolean, steps bigint, "
POSES = _SHAPE + (
    "zero boolean, n_off bigint, least double, most double, flips bigint, first_flip bigint, n_jumps bigint, first_jump bigint, top_angle double, first_steady double, last_steady double, median_far double, mean_far double, most_far double,"
    " median_turned double, mean_turned double, most_turned double, vague bigint, top double, s_top double, pp double, ss double, aa_next double, to_next double, to_move double, n_next bigint, n_state bigint, same double, swapped double"
)
VELOCITIES = _SHAPE + "pairs bigint, flips bigint, linear double, angular double, top double, to_next double, nn double, n_state bigint, vague bigint"
#: Arms, and rows of ``pursuit`` under their frames; each has nulls for what the other tells.
BOTH = VELOCITIES + ", " + ", ".join(x for x in pursuit.SHAPE.split(", ") if x.split()[0] not in ("episode_id", "arms", "hz"))


def schema(fields: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in fields.split(", "))])


def sum_sq(x: np.ndarray) -> np.ndarray:
    return dot(x, x)


def _unit(q: np.ndarray) -> np.ndarray:
    """Rows of length one; zeros where there is no direction."""
    n = norm(q)[:, None]
    return np.where(n > 0, q / np.where(n > 0, n, 1.0), 0.0)


def _from_matrix(m: np.ndarray) -> np.ndarray:
    m00, m01, m02, m10, m11, m12, m20, m21, m22 = m.T
    t = m00 + m11 + m22
    quads = np.stack([
        np.stack([m21 - m12, m02 - m20, m10 - m01, 1 + t], axis=1), np.stack([1 + m00 - m11 - m22, m01 + m10, m02 + m20, m21 - m12], axis=1),
        np.stack([m01 + m10, 1 - m00 + m11 - m22, m12 + m21, m02 - m20], axis=1), np.stack([m02 + m20, m12 + m21, 1 - m00 - m11 + m22, m10 - m01], axis=1),
    ])
    return _unit(quads[np.argmax(np.stack([t, m00, m11, m22]), axis=0), np.arange(len(m))])


def _from_rot6d(r: np.ndarray) -> np.ndarray:
    x, b = _unit(r[:, :3]), r[:, 3:]
    y = _unit(b - dot(x, b)[:, None] * x)
    return _from_matrix(np.stack([x, y, np.cross(x, y)], axis=2).reshape(-1, 9))


def _from_rotation_vector(v: np.ndarray) -> np.ndarray:
    a = norm(v)
    k = np.where(a > 1e-12, np.sin(a / 2) / np.where(a > 1e-12, a, 1.0), 0.5)
    return np.concatenate([v * k[:, None], np.cos(a / 2)[:, None]], axis=1)


def _from_euler(angles: np.ndarray, order: str) -> np.ndarray:
    half = angles / 2
    q = [np.stack([*(np.sin(half[:, i]) if x == axis.lower() else np.zeros(len(half)) for x in "xyz"), np.cos(half[:, i])], axis=1) for i, axis in enumerate(order)]
    return product(q[2], product(q[1], q[0])) if order.islower() else product(q[0], product(q[1], q[2]))


def quaternions(x: np.ndarray, size: np.ndarray, declared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orientations of so many numbers as unit quaternions: as declared if the size is its own, four numbers else as a
    quaternion; and which there are. Those without direction or with nulls are none."""
    made = {"matrix": (9, _from_matrix), "rot6d": (6, _from_rot6d), "rotvec": (3, _from_rotation_vector), **{f"euler_{o}": (3, lambda v, o=o: _from_euler(v, o)) for o in EULER_ORDERS}}
    out = np.full((len(x), 4), np.nan)
    out[size == 4] = _unit(x[size == 4, :4])
    for kind, (width, of) in made.items():
        own = (size == width) & (declared == kind)
        if own.any():
            out[own] = of(x[own, :width])
    return out, sum_sq(out) > 0


class Arms(NamedTuple):
    """A row per step and arm, by episode, arm and step; actions that aren't usable are one row of arm 0. ``own`` and ``prev`` are the arm's
    parts of the action and of the one before, with how many numbers the latter has."""

    episode: np.ndarray
    arm: np.ndarray
    t: np.ndarray
    runs: Runs
    shape: dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]]
    usable: np.ndarray
    own: np.ndarray
    prev: np.ndarray
    n_prev: np.ndarray
    place: tuple[np.ndarray, np.ndarray]
    turn: tuple[np.ndarray, np.ndarray]
    place_next: tuple[np.ndarray, np.ndarray, np.ndarray]
    turn_next: tuple[np.ndarray, np.ndarray]
    crossed: tuple[np.ndarray, np.ndarray]


def _slice(s: Series, row: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """So many numbers of each row from a place on, and which lie within its array; NaN for nulls and beyond."""
    col = start[:, None] + np.arange(n)
    there = (row >= 0)[:, None] & (col < s.width[row][:, None])
    return np.where(there, s.x[row[:, None], np.where(there, col, 0)], np.nan), there


def each_arm(steps: Steps, key: str, width: int) -> Arms | None:
    """The action's steps of the episodes that are told of, by arm, beside the state then and next, while the action goes on."""
    a, s = steps["action", key], steps["state", POSE]
    if a is None:
        return None
    known = np.isin(steps.episode[a.step], np.array([i for i, told in steps.info.items() if told], np.int64)) & (steps.episode[a.step] != NONE)
    if not known.any():
        return None
    if s is None or not len(s.step):
        s = Series(np.array([], int), np.full((1, 1), np.nan), np.zeros((1, 1), bool), np.zeros(1, np.int64))
    more, row, row_next = steps.later(a, a.step, 1) >= 0, steps.later(s, a.step, 0), steps.later(s, a.step, 1)
    before = steps.later(a, a.step, -1)[known]
    row, row_next = row[known], np.where(more, row_next, -1)[known]
    x, x_known, a_width = a.x[known], a.known[known], a.width[known]
    step = a.step[known]
    e = steps.episode[step]
    runs = Runs(e)
    told = [steps.info[int(i)] for i in e[runs.starts]]
    arms = np.array([i["arms"] for i in told])[runs.of]
    hz = np.array([np.nan if i["hz"] is None else i["hz"] for i in told])
    declared = np.array([i.get("declared") for i in told], object)[runs.of]

    nan = (x_known & ~np.isfinite(x)).any(axis=1)
    null = ~nan & ((np.arange(x.shape[1]) < a_width[:, None]) & ~x_known).any(axis=1)
    bad, bad_known = runs.count(nan) > 0, runs.count(~null) > 0
    bad_state = runs.count((row >= 0) & (s.known[row] & ~np.isfinite(s.x[row])).any(axis=1)) > 0
    s_width = np.where(row >= 0, s.width[row], 0)
    placed = (s_width % arms == 0) & (s_width >= 3 * arms)
    stride = np.where((row >= 0) & placed & ~bad_state[runs.of], s_width // arms, 0)
    fits = a_width == width * arms
    usable = fits & (bad_known & ~bad)[runs.of]

    # by arm
    n = np.where(usable, arms, 1)
    i = np.repeat(np.arange(len(n)), n)
    arm = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((arm, runs.of[i]))
    i, arm = i[order], arm[order]
    of_arm = Runs(runs.of[i] * (arms.max() + 1) + arm)
    usable, stride, row, row_next, declared, arms_of = usable[i], stride[i], row[i], row_next[i], declared[i], arms[i]
    mine = Series(step, a.x, a.known, a.width)
    at = np.flatnonzero(known)[i]
    own, _ = _slice(mine, np.where(usable, at, -1), arm * width, width)
    prev, prev_there = _slice(mine, np.where(usable, before[i], -1), arm * width, width)
    placed_arm = usable & (stride > 0)
    now, then = np.where(placed_arm, row, -1), np.where(placed_arm, row_next, -1)

    def seen(r: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        p, p_there = _slice(s, r, arm * stride, 3)
        q, q_there = _slice(s, r, arm * stride + 3, 9)
        size = np.minimum(np.maximum(s.width[r] - (arm * stride + 3), 0), stride - 3)
        q, has = quaternions(np.where(np.arange(9) < size[:, None], q, np.nan), np.where(r >= 0, size, -1), declared)
        return (p, r >= 0, p_there), (q, has)

    (sp, has_sp, _), turn = seen(now)
    place_next, turn_next = seen(then)
    # how far the other arm's state is, where there are two
    two = (arms_of == 2) & (then >= 0)
    other, _ = _slice(s, np.where(two, then, -1), (1 - arm) * stride, 3)
    first = of_arm.starts
    shape = {
        "episode_id": e[i][first], "arm": arm[first], "bad": (bad[runs.of[i]][first], bad_known[runs.of[i]][first]), "fits": of_arm.count(~fits[i]) == 0, "width": of_arm.max(a_width[i], np.ones(len(i), bool)), "arms": arms_of[first],
        "hz": (hz[runs.of[i]][first], ~np.isnan(hz[runs.of[i]][first])), "bad_state": bad_state[runs.of[i]][first],
        "placed": (of_arm.count((row >= 0) & ~placed[i]) == 0, of_arm.count(row >= 0) > 0), "steps": of_arm.count(usable),
    }
    return Arms(e[i], arm, steps.t[step][i], of_arm, shape, usable, own, prev, prev_there.sum(axis=1), (sp, has_sp), turn, place_next, turn_next, (other, two))


def _top(x: np.ndarray) -> np.ndarray:
    """The largest absolute number of each row, NaN without any."""
    top = np.where(np.isnan(x), -np.inf, np.abs(x)).max(axis=1)
    return np.where(top == -np.inf, np.nan, top)


def _mean(runs: Runs, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total, some = runs.sum(x, ~np.isnan(x))
    return total / np.maximum(runs.count(~np.isnan(x)), 1), some


def _steady(runs: Runs, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean size less the standard deviation."""
    there = ~np.isnan(x)
    mean, some = _mean(runs, x)
    spread = np.sqrt(runs.sum((x - mean[runs.of]) ** 2, there)[0] / np.maximum(runs.count(there), 1))
    return _mean(runs, np.abs(x))[0] - spread, some


def _turned(a: np.ndarray, b: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Degrees between quaternions, 0 where one has nulls; NaN where one isn't there."""
    return np.where(there, np.nan_to_num(angle(a, b), nan=0.0), np.nan)


def pose_rows(steps: Steps, norm_atol: float, fastest: float) -> dict | None:
    rows = each_arm(steps, POSE, 7)
    if rows is None:
        return None
    runs, usable, t = rows.runs, rows.usable, rows.t
    p, q, q_prev = rows.own[:, :3], rows.own[:, 3:], rows.prev[:, 3:]
    (sp, has_sp), (_, has_sq), (nxt, has_next, _), (nq, has_nq) = rows.place, rows.turn, rows.place_next, rows.turn_next
    n = norm(q)
    whole = Runs(rows.episode)
    zero = (whole.count(n == 0) > 0)[whole.of]
    has_prev = usable & (rows.n_prev == 7)
    turned_by = _turned(q_prev, q, ~zero & has_prev)
    far, turned = norm(p - nxt), _turned(q, nq, ~zero & usable & has_nq)
    off = np.abs(n - 1) > norm_atol
    flip = ~zero & has_prev & (dot(q_prev, q) < 0)
    hz = rows.shape["hz"]
    jump = turned_by > fastest / np.where(hz[1], hz[0], np.nan)[runs.of]
    by_length = lambda v: np.where(n > 0, v / np.where(n > 0, n, 1.0), np.nan)
    vague = runs.count(has_sp & ~has_sq)
    if_known = lambda x: (x[0], x[1] & (vague == 0))
    some = lambda f, x, where=True: f(x, ~np.isnan(x) & where)
    timed = t != NONE
    median = lambda x: tuple(v[:, 0] for v in runs.median(x[:, None], ~np.isnan(x)[:, None]))
    pp = sum_sq(p)
    other, two = rows.crossed
    at = whole.of[runs.starts]
    both = lambda x: tuple(v[at] for v in some(whole.sum, x, two))
    return rows.shape | {
        "zero": zero[runs.starts], "n_off": runs.count(off), "least": some(runs.min, n, off), "most": some(runs.max, n, off), "flips": runs.count(flip), "first_flip": runs.first(t - 1, flip & timed), "n_jumps": runs.count(jump),
        "first_jump": runs.first(t - 1, jump & timed), "top_angle": some(runs.max, turned_by), "first_steady": _steady(runs, by_length(q[:, 0])), "last_steady": _steady(runs, by_length(q[:, 3])),
        "median_far": median(far), "mean_far": _mean(runs, far), "most_far": some(runs.max, far), "median_turned": if_known(median(turned)), "mean_turned": if_known(_mean(runs, turned)), "most_turned": if_known(some(runs.max, turned)),
        "vague": vague, "top": some(runs.max, _top(p)), "s_top": some(runs.max, _top(sp)), "pp": some(runs.sum, pp, has_sp), "ss": some(runs.sum, sum_sq(sp)), "aa_next": some(runs.sum, pp, has_next), "to_next": some(runs.sum, far**2),
        "to_move": some(runs.sum, sum_sq(p - (nxt - sp))), "n_next": runs.count(~np.isnan(far)), "n_state": runs.count(has_sp), "same": both(sum_sq(p - nxt)), "swapped": both(sum_sq(p - other)),
    }


def _speeds(rows: Arms) -> dict:
    runs, own, prev = rows.runs, rows.own, rows.prev
    lin, ang = own[:, :3], own[:, 3:]
    (_, has_sp), (_, has_sq), (nxt, has_next, next_there) = rows.place, rows.turn, rows.place_next
    there = ~np.isnan(own)
    scale = 0.1 * np.sqrt(runs.sum(own * own, there)[0] / np.maximum(runs.count(there), 1))[runs.of]
    large = (np.abs(own) > scale) & (np.abs(prev) > scale)
    flip = large & (np.sign(own) != np.sign(prev))
    some = lambda f, x, where=True: f(x, ~np.isnan(x) & where)
    return rows.shape | {
        "pairs": runs.count(large.sum(axis=1)), "flips": runs.count(flip.sum(axis=1)), "linear": some(runs.max, norm(lin)), "angular": some(runs.max, norm(ang)), "top": some(runs.max, _top(own)),
        "to_next": some(runs.sum, sum_sq(lin - nxt)), "nn": some(runs.sum, sum_sq(np.where(next_there, nxt, 0.0)), has_next), "n_state": runs.count(has_sp), "vague": runs.count(has_sp & ~has_sq),
    }


def pose_maker(norm_atol: float, fastest: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from batches of ``series.dealt`` rows to rows of ``POSES``."""
    shape = schema(POSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            with np.errstate(all="ignore"):
                if out := pose_rows(steps_of(batch), norm_atol, fastest):
                    yield batch_of(shape, out, np.arange(len(out["arm"])))

    return run


def velocity_maker(speeds: bool, moved: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from batches of ``series.dealt`` rows to rows of ``BOTH``: of arms, and of the motion that results."""
    shape = schema(BOTH)

    def whole(out: dict) -> pa.RecordBatch:
        n = len(out["episode_id"])
        none = {f.name: (np.full(n, None, object) if f.type == pa.string() else np.zeros(n), np.zeros(n, bool)) for f in shape if f.name not in out}
        return batch_of(shape, none | out, np.arange(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            with np.errstate(all="ignore"):
                rows = each_arm(steps_of(batch), "cartesian_velocity", 6)
                if rows is None:
                    continue
                if speeds:
                    yield whole(_speeds(rows))
                hz = np.where(rows.shape["hz"][1], rows.shape["hz"][0], np.nan)[rows.runs.of]
                use = ~np.isnan(hz) & rows.place[1]
                if moved and use.any():
                    (sp, _), (sq, has_q), (nxt, has_next, _), (nq, has_nq) = rows.place, rows.turn, rows.place_next, rows.turn_next
                    arms = rows.shape["arms"][rows.runs.of]
                    for out in pursuit.sums(*(v[use] for v in (rows.episode, rows.arm, arms, hz, rows.own, sp, sq, has_q, nxt, has_next, nq, has_nq))):
                        yield whole(out)

    return run
