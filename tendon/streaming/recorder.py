"""Checks of steps as they arrive, with Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tendon.functions.columns import all_finite, norm

c = F.col

STATE = "width int, steps long, nan_steps long, bytes long"
CLOSED = "episode_id long, key string, n_steps long, nan_steps long, n_bytes long, problem string"


def step_problems(steps: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Adds ``problem`` to each step on its own: what isn't finite, gripper values, width and length of each arm's quaternion; null if sound.

    With ``declared``, a table ``(episode_id, key)``, keys that an episode doesn't declare are a problem too; a stream is
    joined with the table as it is.
    """
    pose, grip = c("key") == "cartesian_position", c("key") == "gripper_binary"
    arms = F.sequence(F.lit(4), F.greatest(F.size("vals"), F.lit(4)), F.lit(7))
    problem = (
        F.when(c("vals").isNull() | (F.size("vals") == 0), "empty").when(~all_finite(c("vals")), "not_finite").when(pose & ~F.size("vals").isin(7, 14), "cartesian_width")
        .when(pose & F.exists(arms, lambda at: F.abs(norm(F.slice("vals", at, 4)) - 1) > 1e-2), "unit_quaternion").when(grip & F.exists("vals", lambda v: ~v.isin(0.0, 1.0)), "gripper_binary")
    )
    if declared is None:
        return steps.withColumn("problem", problem)
    known = declared.select("episode_id", "key").distinct().withColumn("__known", F.lit(True))
    rows = steps.join(known, ["episode_id", "key"], "left")
    return rows.withColumn("problem", F.when(c("__known").isNull(), "not_declared").otherwise(problem)).drop("__known")


def accepted_and_rejected(steps: DataFrame, declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Steps without a problem, and those with one."""
    rows = step_problems(steps, declared)
    return rows.where("problem is null").drop("problem"), rows.where("problem is not null")


def running_counts(steps: DataFrame) -> DataFrame:
    """``(episode_id, key, n_steps, nan_steps, n_bytes, widths)`` so far, for update mode: map-side sums, small state."""
    return steps.groupBy("episode_id", "key").agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if(F.exists("vals", F.isnan)).alias("nan_steps"), F.sum(8 * F.size("vals")).alias("n_bytes"),
        F.min(F.size("vals")).alias("least_width"), F.max(F.size("vals")).alias("most_width"),
    )


def _events(key: tuple, lens: np.ndarray, nans: np.ndarray, state: tuple, cap: int, policy: str) -> tuple[list[tuple], tuple]:
    """What is told about steps of one open episode, from their widths and numbers of NaN, and the state after them."""
    width, n0, nan0, size0 = state
    bad = (nans > 0) & (lens > 0)
    take = (lens > 0) & ~bad if policy == "error" else lens > 0
    if width < 0 and take.any():
        width = int(lens[take.argmax()])
    n, nan, size = n0 + np.cumsum(take), nan0 + np.cumsum(take & bad), size0 + np.cumsum(np.where(take, 8 * lens, 0))
    told = [(i, int(n[i]) - 1, int(nan[i]) - int(bad[i]), int(size[i] - 8 * lens[i]), "shape_changed") for i in np.flatnonzero(take & (lens != width))]
    if policy == "error":
        told += [(i, int(n[i]), int(nan[i]), int(size[i]), "nan_rejected") for i in np.flatnonzero(bad)]
    if policy == "warn" and nan0 == 0 and bad.any():
        told += [(i, int(n[i]), int(nan[i]), int(size[i]), "nan") for i in [int(bad.argmax())]]
    if size0 <= cap and len(size) and size[-1] > cap:
        told += [(i, int(n[i]), int(nan[i]), int(size[i]), "over_cap") for i in [int(np.searchsorted(size, cap, side="right"))]]
    after = (width, int(n[-1]), int(nan[-1]), int(size[-1])) if len(n) else state
    return [(*key, *x[1:]) for x in sorted(told, key=lambda x: x[0])], after


_NEW = (-1, 0, 0, 0)
_NAMES = ["episode_id", "key", "n_steps", "nan_steps", "n_bytes", "problem"]


def _close(cap: int, idle_ms: int | None, policy: str = "ignore", by_event: bool = False):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, last = (state.get[:4], state.get[4:]) if state.exists else (_NEW, ())
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, *now[1:], "over_cap" if now[3] > cap else "")], columns=_NAMES)
            return
        out = []
        for rows in batches:
            rows = rows.sort_values("t", kind="stable") if "t" in rows else rows
            vals = rows["vals"].tolist()
            lens = np.array([0 if v is None else len(v) for v in vals], dtype=np.int64)
            flat = np.concatenate([np.asarray(v, dtype=np.float64) for v in vals if v is not None and len(v)] or [np.zeros(0)])
            ends = np.concatenate([[0], np.cumsum(np.isnan(flat))])[np.cumsum(lens)]
            nans = np.diff(np.concatenate([[0], ends]))
            start = 0
            for stop in [*(np.flatnonzero(rows["closes"].to_numpy(dtype=bool)) + 1), len(lens)]:
                told, now = _events(key, lens[start:stop], nans[start:stop], now, cap, policy)
                out += told
                if stop > start and bool(rows["closes"].iloc[stop - 1]):
                    out.append((*key, *now[1:], ""))
                    now = _NEW
                start = stop
            if by_event:
                last = (max(int(rows["ts"].max().value // 1_000_000), *last),) if last else (int(rows["ts"].max().value // 1_000_000),)
        if now[0] < 0:
            if state.exists:
                state.remove()
        else:
            state.update((*now, *last) if by_event else now)
            if by_event:
                state.setTimeoutTimestamp(max(last[0] + idle_ms, state.getCurrentWatermarkMs() + 1))
            elif idle_ms:
                state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    return run


def episode_log(steps: DataFrame, cap: int = 100 * 1024 * 1024, idle_ms: int | None = 600_000, nan_policy: str = "ignore") -> DataFrame:
    """A stream of ``CLOSED`` rows: one when an episode's key closes (a step with ``closes``, or ``idle_ms`` without
    steps), and one at the step that changes the shape or crosses the cap of bytes.

    ``nan_policy``: ``ignore`` counts steps with NaN, ``warn`` also tells the first one of an episode (``nan``), ``error``
    tells each (``nan_rejected``) and leaves it out of all counts. Steps of one Arrow batch go by their column ``t`` if
    there is one. State is four numbers per open key. Without ``idle_ms`` keys that never close stay, and a run over what
    is available ends; with it Spark goes on to look for idle keys.
    """
    _known(nan_policy)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return steps.groupBy("episode_id", "key").applyInPandasWithState(_close(cap, idle_ms, nan_policy), CLOSED, STATE, "append", timeout)


def _known(policy: str) -> None:
    if policy not in ("ignore", "warn", "error"):
        raise ValueError(f"unknown policy for NaN: {policy}")


def event_log(steps: DataFrame, cap: int = 100 * 1024 * 1024, idle_ms: int = 600_000, delay: str = "1 minute", nan_policy: str = "ignore") -> DataFrame:
    """As ``episode_log``, by the time ``ts`` at which steps were taken and not by that at which they arrive.

    A key closes when the watermark, ``delay`` behind the newest step, is ``idle_ms`` past its own newest step. A step
    ``(episode_id, key, t)`` that comes again within the delay counts once; one that comes later than the watermark
    counts for nothing, so the result is the same however steps are dealt to batches that keep the delay.
    """
    _known(nan_policy)
    rows = steps.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["episode_id", "key", "t"])
    run = _close(cap, idle_ms, nan_policy, by_event=True)
    return rows.groupBy("episode_id", "key").applyInPandasWithState(run, CLOSED, f"{STATE}, last long", "append", GroupStateTimeout.EventTimeTimeout)


def _files(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _version(spark: SparkSession, at: str) -> tuple[int, str | None, set[str], list[str]]:
    """Number of the newest manifest (0 for none), its table, the changes that it holds, and the changes that are there."""
    fs, path = _files(spark, at)
    names = [f.getPath().getName() for f in fs.listStatus(path(at))] if fs.exists(path(at)) else []
    changes = sorted(n for n in names if n.startswith("changes-"))
    number = max((int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-")), default=0)
    if not number:
        return 0, None, set(), changes
    first, *held = (r["value"] for r in spark.read.text(f"{at}/manifest-{number}").collect())  # one line per change that it holds
    return number, first, set(held), changes


def upsert(batch: DataFrame, at: str, keys: tuple[str, ...], newest: str, batch_id: int | None = None) -> None:
    """Adds a micro-batch to the log of changes at ``at``: the row with the largest ``newest`` per key.

    The log is only added to and never read here. With the number of the batch, as ``foreachBatch`` gives it, a batch
    that comes again replaces itself.
    """
    name = f"changes-{batch_id}" if batch_id is not None else f"changes-at-{uuid.uuid4().hex}"
    _newest(batch, keys, newest).write.mode("overwrite").parquet(f"{at}/{name}")


def _newest(rows: DataFrame, keys: tuple[str, ...], newest: str) -> DataFrame:
    rest = [x for x in rows.columns if x not in keys and x != newest]
    per = rows.groupBy(*keys).agg(F.max(F.struct(newest, *rest)).alias("__row"))
    return per.select(*(c(x) if x in keys else c(f"__row.{x}") for x in rows.columns))


def latest(spark: SparkSession, at: str, keys: tuple[str, ...], newest: str) -> DataFrame:
    """The newest row per key: the newest table that ``compacted`` made and the changes that it doesn't hold."""
    _, base, held, changes = _version(spark, at)
    paths = ([base] if base else []) + [f"{at}/{n}" for n in changes if n not in held]
    return _newest(spark.read.parquet(*paths), keys, newest)


def compacted(spark: SparkSession, at: str, keys: tuple[str, ...], newest: str) -> bool:
    """Fold the changes into a new table and make it the one that readers take; whether there was anything to fold.

    A manifest names the table and the changes that it holds, and takes its place by one rename that fails where another
    writer was first; until then, and where it fails, readers see the version before. Changes that come meanwhile
    are read beside it. Tables and changes of older versions stay for readers that have begun; ``cleared`` removes them.
    """
    number, _, held, changes = _version(spark, at)
    new = [n for n in changes if n not in held]
    if not new:
        return False
    fs, path = _files(spark, at)
    table, draft = f"{at}/table-{uuid.uuid4().hex}", f"{at}/draft-{uuid.uuid4().hex}"
    latest(spark, at, keys, newest).write.parquet(table)
    lines = [table, *sorted(held | set(new))]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(draft)
    if fs.exists(path(f"{at}/manifest-{number + 1}")) or not fs.rename(path(draft), path(f"{at}/manifest-{number + 1}")):
        fs.delete(path(draft), True)
        fs.delete(path(table), True)
        return False
    return True


def cleared(spark: SparkSession, at: str) -> int:
    """Remove changes that the newest table holds, and older tables and manifests; how many folders went. Readers must have ended."""
    number, base, held, _ = _version(spark, at)
    fs, path = _files(spark, at)
    old = [f.getPath().getName() for f in fs.listStatus(path(at))]
    gone = [n for n in old if n in held or (n.startswith("table-") and f"{at}/{n}" != base) or (n.startswith("manifest-") and n != f"manifest-{number}")]
    for n in gone if number else []:
        fs.delete(path(f"{at}/{n}"), True)
    return len(gone) if number else 0


def upsert_listing(batch: DataFrame, at: str, batch_id: int | None = None) -> None:
    """Adds a micro-batch of file rows ``(path, size, mtime)`` to the log of changes at ``at``."""
    upsert(batch.select("path", "size", "mtime"), at, ("path",), "mtime", batch_id)


def listing(spark: SparkSession, at: str) -> DataFrame:
    """The newest row of each path in a log of changes; of several with one time, the one of the largest size."""
    return latest(spark, at, ("path",), "mtime")


def follow_listing(files: DataFrame, at: str, checkpoint: str):
    """A stream of file rows kept in the log of changes at ``at``; ends when all that is there was read."""
    return files.writeStream.foreachBatch(lambda batch, n: upsert_listing(batch, at, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
