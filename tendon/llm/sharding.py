"""Shards of near equal bytes by minimax contiguous partition, with DataFrame operations only.

Equal texts are one unit and stay together. Units have an order: 60 bits of a hash of the text, but the few large ones
(at most ``LARGE`` a shard) are dealt in turns among the shards' shares of the order and lie in the middle of them, so
that cuts fall among small units. A unit larger than an even share is a shard of its own. The capacity of the others
is the smallest with which the shards, filled one after the other, hold all units; it is found by binary search.

The search needs sums at few places of the order: it starts from sums of ``BINS`` bins of the order and halves the
bracket of the capacity as far as these can tell, then splits only the bins in which a cut may lie. Units are never
sorted or collected, and rows find their shard by comparing their place in the order with the cuts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendon.llm.shared import saved, text_of

KEY_BITS = 60
#: Units larger than this part of a shard's even share are placed by hand; there are at most so many of them a shard.
LARGE = 256
#: Bins that one round of the search asks for at most.
BINS = 1 << 14


def key_of(text: Column) -> Column:
    """The first 60 bits of the text's MD5, from 0 up; texts that collide are one unit."""
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def units_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32, key)`` per row: size is the text's UTF-8 bytes plus 1; a null text counts as empty."""
    text = text_of()
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key_of(text).alias("key"))


class Bins:
    """Sums of the units in ranges of the order: from ``start`` on, 2 to the ``shift`` places wide."""

    def __init__(self, leaves: list[tuple[int, int, int, int]]):
        self.leaves = sorted(leaves)  # (start, shift, bytes, units)
        self.ends = [0]
        for leaf in self.leaves:
            self.ends.append(self.ends[-1] + leaf[2])
        self.total = self.ends[-1]

    def single(self, i: int) -> bool:
        return self.leaves[i][3] == 1 or self.leaves[i][1] == 0

    def filled(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """How far each shard reaches if it takes all it can; ``hopeful`` supposes that bins can be cut anywhere."""
        at, out = 0, []
        for _ in range(shards):
            x = at + capacity
            i = bisect_right(self.ends, x) - 1
            at = self.total if i == len(self.leaves) else x if hopeful and not self.single(i) else self.ends[i]
            out.append(at)
        return out

    def smallest(self, shards: int, low: int, hopeful: bool) -> int:
        """The smallest capacity from ``low`` on with which the shards hold all, by binary search."""
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.filled(mid, shards, hopeful)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def unclear(self, shards: int, low: int, high: int) -> list[int]:
        """Bins of several units in which a shard's end may lie for capacities from ``low`` to ``high``."""
        found: set[int] = set()
        sure, hoped = [0, *self.filled(low, shards, False)], [0, *self.filled(high, shards, True)]
        for a, b in zip(sure, hoped):
            i, j = bisect_right(self.ends, a + low) - 1, bisect_right(self.ends, b + high) - 1
            found.update(range(i, min(j, len(self.leaves) - 1) + 1))
        return sorted(i for i in found if not self.single(i))

    def cuts(self, shards: int, capacity: int) -> list[int]:
        """Where shards from the second on start in the order: as even as the capacity lets them be."""
        latest = self.filled(capacity, shards, False)
        earliest, at = [], self.total
        for _ in range(shards - 1):
            at = self.ends[bisect_left(self.ends, max(0, at - capacity))]
            earliest.append(at)
        earliest.reverse()
        out, before = [], 0
        for k in range(shards - 1):
            even = self.total * (k + 1) // shards
            i = bisect_right(self.ends, max(even, earliest[k])) - 1
            if i + 1 < len(self.ends) and self.ends[i + 1] - even < even - self.ends[i]:
                i += 1
            i = min(i, bisect_right(self.ends, min(before + capacity, latest[k])) - 1)
            before = self.ends[i]
            out.append(self.leaves[i][0] if i < len(self.leaves) else 1 << (KEY_BITS + 1))
        return out


@dataclass(frozen=True)
class Plan:
    """Shards of their own for the largest units, the places of other large ones, the cuts of the rest, and the capacity found."""

    shards: int
    giants: int
    large: DataFrame
    cuts: tuple[int, ...]
    capacity: int


def _binned(ordered: DataFrame, shift: int) -> list[tuple[int, int, int, int]]:
    at = F.shiftright("place", shift)
    rows = ordered.groupBy(at.alias("bin")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    return [(r["bin"] << shift, shift, r["bytes"], r["n"]) for r in rows]


def planned(rows: DataFrame, shards: int = 8) -> Plan:
    """The cuts of ``rows (size, key)``; an empty table has none, and with fewer units than shards some stay empty."""
    units = saved(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-units")
    total = units.agg(F.sum("bytes")).first()[0] or 0
    large = units.where(F.col("bytes") * (shards * LARGE) > total)  # fewer than shards times LARGE units
    giants, left = 0, total
    for r in large.orderBy(F.col("bytes").desc(), "key").limit(shards).collect():
        if r["bytes"] * (shards - giants) <= left:
            break
        giants, left = giants + 1, left - r["bytes"]
    rest = max(shards - giants, 1)
    nth = F.row_number().over(Window.orderBy(F.col("bytes").desc(), "key")) - 1
    turn = F.col("nth") - giants
    lane = F.when(turn % (2 * rest) < rest, turn % rest).otherwise(rest - 1 - turn % rest)
    wide = (1 << KEY_BITS) // rest
    place = F.when(turn >= 0, lane.cast("long") * F.lit(wide) + F.lit(wide // 2) + turn)
    large = saved(large.withColumn("nth", nth).select("key", F.when(turn < 0, F.col("nth")).cast("int").alias("giant"), place.alias("place")), "shard-large")
    if not left:
        return Plan(shards, giants, large, (), 0)
    ordered = units.join(F.broadcast(large), "key", "left").where("giant is null").select(F.coalesce("place", "key").alias("place"), "bytes")
    bins = Bins(_binned(ordered, KEY_BITS - BINS.bit_length() + 1))
    low = max(-(-left // rest), ordered.agg(F.max("bytes")).first()[0])
    while True:
        low, high = bins.smallest(rest, low, True), bins.smallest(rest, low, False)
        if low == high:
            break
        unclear = [bins.leaves[i] for i in bins.unclear(rest, low, high)]
        finer = max(1, (BINS // len(unclear)).bit_length() - 1)
        split: list[tuple[int, int, int, int]] = []
        for shift in sorted({leaf[1] for leaf in unclear}):
            inside = F.shiftright("place", shift).isin([leaf[0] >> shift for leaf in unclear if leaf[1] == shift])
            split += _binned(ordered.where(inside), max(0, shift - finer))
        bins = Bins([*(set(bins.leaves) - set(unclear)), *split])
    return Plan(shards, giants, large, tuple(bins.cuts(rest, high)), high)


def assigned(rows: DataFrame, plan: Plan) -> DataFrame:
    """Adds ``shard`` and ``place`` to rows that have ``key``; no row moves."""
    found = rows.join(F.broadcast(plan.large), "key", "left").withColumn("place", F.coalesce("place", "key"))
    after = F.lit(plan.giants)
    for cut in plan.cuts:
        after = after + (F.col("place") >= F.lit(cut)).cast("int")
    return found.withColumn("shard", F.coalesce("giant", after).cast("int")).drop("giant")


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` per input row, shards from 0 and slots from 0 without gaps.

    Slots follow the order of units and then ids; null ids come first, and rows that are equal in all of this are
    numbered one by one. A null text is an empty one. Rows are sorted by ranges of (shard, place, id), so that a unit
    of any number of rows is dealt to many tasks. An empty table gives an empty result; other columns are ignored.
    """
    rows = saved(units_of(docs), "shard-rows")
    order = ["shard", "place", "doc_id"]
    laid = assigned(rows, planned(rows, shards)).repartitionByRange(*order).sortWithinPartitions(*order)
    laid = saved(laid.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "shard-ranges")
    # a row per range and shard
    runs = laid.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("part", "shard", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    found = laid.join(F.broadcast(runs), ["part", "shard"])
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, files: int = 64) -> None:
    """Write whole rows of ``docs`` to folders ``shard=0`` and so on, each shard in up to ``files`` files.

    Rows go to files by a hash of text and id, so that large units are split among files; a task that runs again
    writes the same rows. ``docs`` must have no column ``shard``.
    """
    if "shard" in docs.columns:
        raise ValueError("docs has a column named shard")
    plan = planned(units_of(docs), shards)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    placed = assigned(docs.select(row, key_of(text_of()).alias("key"), F.xxhash64("text", "doc_id").alias("salt")), plan)
    placed = placed.repartition(shards * files, "shard", F.pmod("salt", F.lit(files)))
    placed.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), "shard").write.partitionBy("shard").mode("errorifexists").parquet(path)
