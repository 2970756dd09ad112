"""Steps of whole episodes as arrays: Spark deals and sorts the steps by episode, and a task reads several episodes at once.

Nulls are told apart from numbers by masks; sums and extremes of an episode follow its steps in their order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for an episode or a time that is null.
NONE = -(2**63)


def dealt(steps: DataFrame, info: DataFrame) -> DataFrame:
    """Steps ``(episode_id, name, t, vals, info)`` by episode, with ``(episode_id, info)`` of each episode as a row among its own.

    ``info`` goes as JSON: all fields of a struct would be written for each step, and measured for each row of a batch."""
    none = F.lit(NONE)
    rows = steps.select(F.coalesce(F.col("episode_id").cast("long"), none).alias("episode_id"), F.concat_ws("/", "grp", "key").alias("name"), F.coalesce(F.col("t").cast("long"), none).alias("t"), F.col("vals").cast("array<double>").alias("vals"))
    told = info.where("episode_id is not null").select(F.col("episode_id").cast("long").alias("episode_id"), F.to_json("info", {"ignoreNullFields": "false"}).alias("info"))
    return rows.unionByName(told, allowMissingColumns=True).repartition("episode_id").sortWithinPartitions("episode_id")


def whole_episodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``episode_id`` in batches that cut no episode in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("episode_id")
        cut = int(np.searchsorted(ids.to_numpy(zero_copy_only=False), ids[-1].as_py()))
        if held and (cut or held[-1].column("episode_id")[-1] != ids[-1]):
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def gathered(batches: Iterator[pa.RecordBatch], least: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches of ``whole_episodes`` put together until they have so many rows, as arrays of few steps cost as much as those of many."""
    held: list[pa.RecordBatch] = []
    for batch in whole_episodes(batches):
        held.append(batch)
        if sum(x.num_rows for x in held) >= least:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class Series(NamedTuple):
    """One key's arrays in the order of episodes and steps: number of the step, values, which entries are known, widths."""

    step: np.ndarray
    x: np.ndarray
    known: np.ndarray
    width: np.ndarray


class Steps(NamedTuple):
    """The steps of several episodes: episode and time of each, the keys' series by group and key, and what is told of an episode."""

    episode: np.ndarray
    t: np.ndarray
    series: dict[tuple[str, str], Series]
    info: dict[int, dict]

    def __getitem__(self, name: tuple[str, str]) -> Series | None:
        return self.series.get(name)

    def later(self, of: Series | None, step: np.ndarray, k: int) -> np.ndarray:
        """The row of ``of`` at so many steps after each step, or before it; -1 where its episode has none there."""
        if of is None or not len(of.step):
            return np.full(len(step), -1)
        row = np.full(len(self.t), -1)
        row[of.step] = np.arange(len(of.step))
        at = step + k
        inside = (at >= 0) & (at < len(self.t))
        at = np.where(inside, at, 0)
        return np.where(inside & (self.episode[at] == self.episode[step]), row[at], -1)


def steps_of(batch: pa.RecordBatch) -> Steps:
    """The steps in a batch of ``dealt`` rows. Of several arrays under one key at one step, the largest counts."""
    told = pc.is_valid(batch.column("info"))
    info = dict(zip(batch.column("episode_id").filter(told).to_pylist(), map(json.loads, batch.column("info").filter(told).to_pylist())))
    rows = batch.filter(pc.invert(told))
    ids, t, vals = rows.column("episode_id").to_numpy(), rows.column("t").to_numpy(), rows.column("vals")
    order = np.lexsort((t, ids))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(ids[order]) != 0) | (np.diff(t[order]) != 0)
    step = np.empty(len(order), np.int64)
    step[order] = np.cumsum(new) - 1
    code = pc.dictionary_encode(rows.column("name"))
    names, code = code.dictionary.to_pylist(), code.indices.to_numpy()
    width = pc.fill_null(pc.list_value_length(vals), -1).to_numpy()
    ends = np.concatenate([[0], np.cumsum(np.maximum(width, 0))])
    entries = vals.flatten()
    none, entries = entries.is_null().to_numpy(zero_copy_only=False), entries.to_numpy(zero_copy_only=False)
    series = {}
    for i, name in enumerate(names):
        own = order[(code[order] == i) & (width[order] >= 0)]
        same = np.flatnonzero(np.diff(step[own]) == 0)
        if len(same):
            largest: dict[int, int] = {}
            for r in own:
                if (o := largest.get(step[r])) is None or _rank(vals[r]) >= _rank(vals[o]):
                    largest[step[r]] = r
            own = np.array(list(largest.values()))
        place = ends[own][:, None] + np.arange(max(1, width[own].max(initial=0)))
        there = place < ends[own + 1][:, None]
        place = np.where(there, place, 0)
        known = there & ~none[place] if len(entries) else there
        x = np.where(known, entries[place], np.nan) if len(entries) else np.full(there.shape, np.nan)
        series[tuple(name.split("/", 1))] = Series(step[own], x, known, width[own])
    return Steps(ids[order][new], t[order][new], series, info)


def _rank(vals: pa.Scalar) -> list[tuple[int, float]]:
    """Arrays in Spark's order: nulls first, what isn't a number last."""
    return [(0, 0.0) if v is None else (2, 0.0) if v != v else (1, v) for v in vals.as_py()]


def above(x: np.ndarray, y: np.ndarray | float) -> np.ndarray:
    """x > y, what isn't a number above all."""
    return (x > y) | (np.isnan(x) & ~np.isnan(y))


def finite(x: np.ndarray) -> np.ndarray:
    return np.isfinite(x)


class Runs:
    """Rows that lie together by episode, and what is gathered of each: ``(values, which are known)``, an entry per run."""

    def __init__(self, groups: np.ndarray):
        self.starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        self.of = np.cumsum(np.concatenate([[0], groups[1:] != groups[:-1]]))

    def count(self, where: np.ndarray) -> np.ndarray:
        return np.add.reduceat(where.astype(np.int64), self.starts, axis=0)

    def sum(self, x: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.add.reduceat(np.where(where, x, 0.0), self.starts, axis=0), self.count(where) > 0

    def max(self, x: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum.reduceat(np.where(where, x, -np.inf), self.starts, axis=0), self.count(where) > 0

    def min(self, x: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.fmin.reduceat(np.where(where, x, np.nan), self.starts, axis=0), self.count(where) > 0

    def first(self, x: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By whole numbers: the least."""
        return np.minimum.reduceat(np.where(where, x, np.iinfo(np.int64).max), self.starts, axis=0), self.count(where) > 0

    def median(self, x: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each column, in the middle between two."""
        n = self.count(where)
        out = np.full(n.shape, np.nan)
        for d in range(x.shape[1]):
            v, own = x[where[:, d], d], self.of[where[:, d]]
            v = v[np.lexsort((v, own))]
            begin = np.cumsum(n[:, d]) - n[:, d]
            some = n[:, d] > 0
            lo, hi = (v[begin[some] + k] for k in ((n[some, d] - 1) // 2, n[some, d] // 2))
            out[some, d] = np.where(lo == hi, lo, 0.5 * lo + 0.5 * hi)
        return out, n > 0


def batch_of(shape: pa.Schema, columns: dict[str, tuple[np.ndarray, np.ndarray] | np.ndarray], rows: np.ndarray) -> pa.RecordBatch:
    """These rows of columns, which are arrays or arrays with a mask of what is known."""
    made = []
    for field in shape:
        v, known = columns[field.name] if isinstance(columns[field.name], tuple) else (columns[field.name], None)
        made.append(pa.array(np.asarray(v)[rows], mask=None if known is None else ~np.asarray(known)[rows], from_pandas=False).cast(field.type))
    return pa.RecordBatch.from_arrays(made, schema=shape)
