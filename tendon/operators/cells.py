"""Sums, extremes and jumps of each dimension of an action beside the state that observes it, over arrays of whole episodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from tendon.functions.series import NONE, Runs, Series, Steps, above, batch_of, finite, gathered, steps_of
from tendon.sources.episodes import STATE_KEY_FOR_ACTION

_LONGS = ("dim", "s_dim", "an", "sn", "n", "n_state", "n_next", "n_bad", "n_bad_state", "n_jumps", "first_jump", "changes", "copies", "period", "held", "holds")
_LAGS = tuple(f"{x}{k}" for k in (0, 1) for x in ("n", "x", "y", "xx", "yy", "xy", "dd"))
_DOUBLES = ("hz", "top", "low", "high", "s_top", "s_low", "s_high", "aa", "ss", "aa_next", "to_next", "to_move", "nn", "first", "top_jump")
_NAMED = ("joint_position", "joint_velocity")


def fields(medians: bool, flips: bool) -> list[tuple[str, str]]:
    kinds = [(x, "bigint") for x in _LONGS] + [(x, "double") for x in _DOUBLES] + [(x, "bigint" if x[0] == "n" else "double") for x in _LAGS]
    more = ([("median", "double")] if medians else []) + ([("pairs", "bigint"), ("flips", "bigint")] if flips else [])
    return [("episode_id", "bigint"), ("key", "string"), ("d", "int"), ("out", "boolean"), *kinds, *more]


_WHOLE = ("dim", "s_dim", "hz", "an", "sn", "n", "n_state", "n_next", "n_bad_state", "s_top", "changes", "copies", "period", "held", "holds")
SUMS = ("n_bad", "aa", "ss", "aa_next", "to_next", "to_move", "nn", "n_jumps", *(f"{x}{k}" for k in (0, 1) for x in ("n", "x", "y", "xx", "yy", "xy", "dd")), "pairs", "flips")
_TOPS, _LEAST = ("top", "high", "top_jump", "s_high", "median"), ("low", "s_low", "first_jump")


def key_fields(medians: bool, flips: bool) -> list[tuple[str, str]]:
    """The columns of ``motion.key_metrics``."""
    kinds = dict(fields(medians, flips))
    own = [x for x in (*_WHOLE, "state_range", *SUMS, *_TOPS, *_LEAST, "span", "first", "grippers", "columns", "next_values", "state_values") if x in kinds or x not in (*SUMS, *_TOPS)]
    more = {"state_range": "double", "span": "double"}
    return [("episode_id", "bigint"), ("key", "string"), *((x, kinds.get(x) or more.get(x, "bigint")) for x in own)]


def _together(out: dict, there: np.ndarray) -> dict:
    """As ``motion.key_metrics``: a row per episode of the cells of all dimensions, which are columns here."""
    of = lambda x: out[x] if isinstance(out[x], tuple) else (out[x], np.ones(there.shape, bool))
    own = there & ~out["out"]

    def most(v: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.iinfo(np.int64).min if np.issubdtype(v.dtype, np.integer) else -np.inf
        return np.where(where, v, low).max(axis=1), where.any(axis=1)

    def least(v: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if np.issubdtype(v.dtype, np.integer):
            return np.where(where, v, np.iinfo(np.int64).max).min(axis=1), where.any(axis=1)
        return np.fmin.reduce(np.where(where, v, np.nan), axis=1), where.any(axis=1)

    total = lambda v, where: (np.where(where, v, 0).sum(axis=1), where.any(axis=1))
    by = lambda f, x, cells: f(of(x)[0], of(x)[1] & cells)
    (high, has_high), (low, has_low) = of("s_high"), of("s_low")
    reach = high - low, has_high & has_low
    made = {"episode_id": out["episode_id"][:, 0], "key": out["key"][:, 0], "state_range": most(reach[0], reach[1] & there), "span": most(reach[0], reach[1] & own), "first": by(most, "first", there & (np.arange(there.shape[1]) == 0))}
    made |= {x: by(most, x, there) for x in _WHOLE} | {x: by(total, x, there if x == "n_bad" else own) for x in SUMS if x in out} | {x: by(most, x, own) for x in _TOPS if x in out} | {x: by(least, x, own) for x in _LEAST}
    return made | {"grippers": (there & out["out"]).sum(axis=1), "columns": own.sum(axis=1), "next_values": by(total, "n_next", own), "state_values": by(total, "n_state", own)}


def maker(medians: bool, flips: bool, speed: float, match: float, held_atol: float, whole: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from batches of ``series.dealt`` rows to cells of all action keys, or to the metrics of ``whole`` keys."""
    types = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    shape = pa.schema([(n, types[t]) for n, t in (key_fields if whole else fields)(medians, flips)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            steps = steps_of(batch)
            for grp, key in steps.series:
                if grp == "action" and len(steps[grp, key].step):
                    with np.errstate(all="ignore"):
                        yield _cells(steps, key, shape, medians, flips, speed, match, held_atol, whole)

    return run


def _beside(steps: Steps, key: str, a: Series, e: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], Series | None, np.ndarray, np.ndarray]:
    """The state then and at the next two steps in the columns that belong to the action's, each ``(values, known)``; the whole
    state, its row at each step, and which columns are grippers. The states ahead count while the action itself goes on."""
    s = steps["state", STATE_KEY_FOR_ACTION[key]] if key in STATE_KEY_FOR_ACTION else None
    w = a.x.shape[1]
    rows = [steps.later(s, a.step, k) for k in (0, 1, 2)]
    s_width = np.where(rows[0] >= 0, s.width[rows[0]], -1) if s is not None else np.full(len(a.step), -1)
    columns = np.where((s_width == a.width)[:, None], np.arange(w), -1)
    grips = np.zeros(a.x.shape, bool)
    if key in _NAMED:
        for i in np.unique(e):
            if told := steps.info.get(int(i)):
                own = e == i
                if told["grips"] is not None:
                    grips[np.ix_(own & (a.width == told["an"]), range(min(w, told["an"])))] = told["grips"][:w]
                if told["pairs"] and len(told["pairs"]) <= w:
                    named = own & (a.width == told["an"]) & (s_width == told["sn"])
                    columns[named, : told["an"]] = told["pairs"]
    columns = np.where(np.arange(w) < a.width[:, None], columns, -1)
    beside = []
    for k, row in enumerate(rows):
        if s is None:
            beside.append((np.full(a.x.shape, np.nan), np.zeros(a.x.shape, bool)))
            continue
        goes_on = steps.later(a, a.step, k) >= 0
        there = (row >= 0)[:, None] & goes_on[:, None] & (columns >= 0) & (columns < s.x.shape[1])
        r, col = np.where(there, row[:, None], 0), np.where(there, columns, 0)
        beside.append((s.x[r, col] if len(s.step) else np.full(a.x.shape, np.nan), there & (s.known[r, col] if len(s.step) else False)))
    return beside, s, rows[0], grips


def _holds(t: np.ndarray, e: np.ndarray, changed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The commonest length of the runs between changes, the smallest of equals, how often it occurs, and the number of runs; the first begins at step 0."""
    at, own = t[changed], e[changed]
    period = np.diff(at, prepend=0)
    begins = np.flatnonzero(np.diff(own, prepend=-1))
    period[begins] = at[begins]
    order = np.lexsort((period, own))
    own, period = own[order], period[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(period) != 0)])) if len(own) else np.array([], int)
    k = np.diff(np.concatenate([new, [len(own)]]))
    best = np.lexsort((period[new], -k, own[new]))
    best = best[np.flatnonzero(np.diff(own[new][best], prepend=-1))]
    out = np.zeros((3, n), np.int64)
    out[0, own[new][best]], out[1, own[new][best]] = period[new][best], k[best]
    out[2] = np.bincount(own, minlength=n)
    return out[0], out[1], out[2]


def _cells(steps: Steps, key: str, shape: pa.Schema, medians: bool, flips: bool, speed: float, match: float, held_atol: float, whole: bool) -> pa.RecordBatch:
    a = steps["action", key]
    e, t = steps.episode[a.step], steps.t[a.step]
    runs = Runs(e)
    w = a.x.shape[1]
    there, x, known = np.arange(w) < a.width[:, None], a.x, a.known
    [(s, has_s), (nxt, has_nxt), (nxt2, has_nxt2)], state, row, grips = _beside(steps, key, a, e)
    told = [steps.info.get(int(i)) or {"hz": None, "an": 0, "sn": 0} for i in e[runs.starts]]
    rate = np.array([np.nan if i["hz"] is None else i["hz"] for i in told])
    hz = np.broadcast_to(rate[runs.of][:, None], x.shape)
    rated = ~np.isnan(hz)

    before = steps.later(a, a.step, -1)
    prev, has_prev = np.where((before >= 0)[:, None], x[before], np.nan), (before >= 0)[:, None] & known[before]
    both = known & has_prev
    gap = np.abs(x - prev)
    changed = (both & above(gap, 1e-9)).any(axis=1)
    moved = (both & above(gap, held_atol)).any(axis=1) & (t != NONE)
    if state is not None and len(state.step):
        all_of, all_known = np.abs(state.x[row]), state.known[row] & (row >= 0)[:, None]
        s_max, seen = np.where(all_known, all_of, -np.inf).max(axis=1), all_known.any(axis=1)
        s_width = np.where(row >= 0, state.width[row], -1)
        n = min(w, state.x.shape[1])
        off = np.abs(x[:, :n] - state.x[row][:, :n])
        pair = known[:, :n] & all_known[:, :n]
        copied = (row >= 0) & (a.width == s_width) & pair.any(axis=1) & ~(pair & ~(off <= match)).any(axis=1)
    else:
        s_max, seen, s_width, copied = np.full(len(e), np.nan), np.zeros(len(e), bool), np.full(len(e), -1), np.zeros(len(e), bool)
    wide = lambda v: np.broadcast_to(v[:, None], x.shape)
    full = lambda v: wide(v) & there
    first = np.broadcast_to(np.arange(w) == 0, x.shape)

    over = both & rated & above(gap, speed / hz)
    move, has_move, per = nxt - s, has_nxt & has_s, x / hz
    move2, has_move2 = nxt2 - nxt, has_nxt2 & has_nxt
    n_cells = runs.count(there)
    timed = there & wide(t != NONE)
    start = np.minimum(runs.first(np.broadcast_to(np.arange(len(e))[:, None], x.shape), timed)[0], len(e) - 1)
    col = np.arange(w)
    period, held, holds = _holds(t, runs.of, moved, len(runs.starts))
    at_first = lambda v: (np.broadcast_to(v[:, None], n_cells.shape), np.broadcast_to(col == 0, n_cells.shape))
    each = lambda v: np.broadcast_to(np.asarray(v)[:, None], n_cells.shape)
    out = {
        "episode_id": each(e[runs.starts]), "key": np.full(n_cells.shape, key, object), "d": np.broadcast_to(col, n_cells.shape), "out": runs.count(grips & there) > 0,
        "dim": runs.first(-wide(a.width), there)[0] * -1, "s_dim": tuple(f(v) for f, v in zip((np.negative, np.asarray), runs.first(-wide(s_width), full(s_width >= 0)))),
        "hz": (each(rate), ~np.isnan(each(rate))), "an": each([i["an"] if key in _NAMED else 0 for i in told]), "sn": each([i["sn"] if key in _NAMED else 0 for i in told]),
        "n": n_cells, "n_state": runs.count(has_s), "n_next": runs.count(has_nxt), "n_bad": runs.count(known & ~finite(x)), "n_bad_state": runs.count(full(seen & ~finite(s_max))),
        "top": runs.max(np.abs(x), known), "low": runs.min(x, known), "high": runs.max(x, known), "s_top": runs.max(wide(s_max), full(seen)), "s_low": runs.min(s, has_s), "s_high": runs.max(s, has_s),
        "aa": runs.sum(x * x, known & has_s), "ss": runs.sum(s * s, has_s), "aa_next": runs.sum(x * x, known & has_nxt), "to_next": runs.sum((x - nxt) ** 2, known & has_nxt),
        "to_move": runs.sum((x - move) ** 2, known & has_move), "nn": runs.sum(nxt * nxt, has_nxt), "first": (x[start, col], known[start, col] & (runs.count(timed) > 0)),
        "n_jumps": runs.count(over), "first_jump": runs.first(wide(t) - 1, over & timed), "top_jump": runs.max(gap, both), "changes": runs.count(full(changed) & first), "copies": runs.count(full(copied) & first),
        "period": at_first(period), "held": at_first(held), "holds": at_first(holds),
    }
    for k, (y, has) in enumerate(((move, has_move), (move2, has_move2))):
        m = known & rated & has
        out |= {f"n{k}": runs.count(m), **{f"{n}{k}": runs.sum(v, m) for n, v in (("x", per), ("y", y), ("xx", per * per), ("yy", y * y), ("xy", per * y), ("dd", (per - y) ** 2))}}
    if medians:
        out["median"] = runs.median(np.abs(x - nxt), known & has_nxt)
    if flips:
        total, n = runs.sum(x * x, known)[0], runs.count(known)
        scale = 0.1 * np.sqrt(total / np.maximum(n, 1))[runs.of]
        large = both & above(np.abs(x), scale) & above(np.abs(prev), scale)
        out |= {"pairs": runs.count(large), "flips": runs.count(large & (np.sign(x) != np.sign(prev)))}
    if whole:
        return batch_of(shape, _together(out, n_cells > 0), np.flatnonzero((n_cells > 0).any(axis=1)))
    flat = {n: tuple(np.ravel(p) for p in v) if isinstance(v, tuple) else np.ravel(v) for n, v in out.items()}
    return batch_of(shape, flat, np.flatnonzero(n_cells.ravel() > 0))
