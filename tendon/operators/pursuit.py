"""How commanded velocities go with the motion of the state: sums over the steps of whole episodes, as arrays of three or four columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tendon.functions.series import Runs

PARTS = (("linear", "linear", "linear"), ("angular", "angular", "angular"), ("swapped_linear", "angular", "linear"), ("swapped_angular", "linear", "angular"))
_SUMS = [f"{x}{k}" for k in (0, 1) for x in ("x", "y", "xx", "yy", "xy", "dd")]
SHAPE = "episode_id bigint, frame string, part string, arms int, hz double, gone double, rotated double, n0 bigint, n1 bigint, " + ", ".join(f"{x} double" for x in _SUMS)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (ax, ay, az, aw), (bx, by, bz, bw) = a.T, b.T
    return np.stack([aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz], axis=1)


def _rotation_vector(q: np.ndarray) -> np.ndarray:
    """Axis times angle, the shorter way round."""
    s = np.sqrt(q[:, 0] * q[:, 0] + q[:, 1] * q[:, 1] + q[:, 2] * q[:, 2])
    k = np.where(s > 1e-12, 2 * np.arctan2(s, np.abs(q[:, 3])) / np.where(s > 1e-12, s, 1.0), 2.0) * np.where(q[:, 3] < 0, -1.0, 1.0)
    return q[:, :3] * k[:, None]


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of products of each row, term after term."""
    out = a[:, 0] * b[:, 0]
    for i in range(1, a.shape[1]):
        out = out + a[:, i] * b[:, i]
    return out


def norm(a: np.ndarray) -> np.ndarray:
    return np.sqrt(dot(a, a))


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Degrees between quaternions of any length, 0 where one has none."""
    size = norm(a) * norm(b)
    cos = np.where(size > 0, np.abs(dot(a, b)) / np.where(size > 0, size, 1.0), 1.0)
    return np.where(np.isnan(size), np.nan, np.degrees(2 * np.arccos(np.clip(cos, -1.0, 1.0))))


def sums(e: np.ndarray, arm: np.ndarray, arms: np.ndarray, hz: np.ndarray, own: np.ndarray, sp: np.ndarray, sq: np.ndarray, has_q: np.ndarray, nxt: np.ndarray, has_next: np.ndarray, nq: np.ndarray, has_nq: np.ndarray) -> Iterator[dict]:
    """Columns of ``SHAPE`` for each frame and part, from rows by episode, arm and step: the rate, the velocity, position and
    orientation of the state then and next, and which of these there are."""
    runs, first = Runs(e), np.concatenate([[True], (np.diff(e) != 0) | (np.diff(arm) != 0)])
    start = np.maximum.accumulate(np.where(first, np.arange(len(e)), 0))
    away = sp - sp[start]
    gone, rotated = norm(away), angle(sq, sq[start])
    back = sq * [-1.0, -1.0, -1.0, 1.0]
    gap = nxt - sp
    flat = np.concatenate([gap, np.zeros((len(e), 1))], axis=1)
    moved = {
        "base_linear": (gap, has_next), "base_angular": (_rotation_vector(product(nq, back)), has_next & has_q & has_nq),
        "ee_linear": (product(product(back, flat), sq)[:, :3], has_next & has_q), "ee_angular": (_rotation_vector(product(back, nq)), has_next & has_q & has_nq),
    }
    follows = np.append(~first[1:], False)
    later = lambda v, there: (np.roll(v, -1, axis=0), np.roll(there, -1) & follows)
    said = {"linear": own[:, :3] / hz[:, None], "angular": own[:, 3:] / hz[:, None]}
    whole = lambda v: runs.max(v, ~np.isnan(v))
    arms = arms[runs.starts]
    for frame in ("base", "ee"):
        for part, x, y in PARTS:
            out = {"episode_id": e[runs.starts], "frame": np.full(len(arms), frame, object), "part": np.full(len(arms), part, object), "arms": arms, "hz": hz[runs.starts], "gone": whole(gone), "rotated": whole(rotated)}
            x = said[x]
            for k, (v, there) in enumerate((moved[f"{frame}_{y}"], later(*moved[f"{frame}_{y}"]))):
                some = lambda z, there=there: runs.sum(z.sum(axis=1), there & ~np.isnan(z.sum(axis=1)))
                out |= {f"n{k}": 3 * runs.count(there), f"x{k}": some(x), f"y{k}": some(v), f"xx{k}": some(x * x), f"yy{k}": some(v * v), f"xy{k}": some(x * v), f"dd{k}": some((x - v) ** 2)}
            yield out
