"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sizes are counted once per document. Targets are shares of the total by weight, stopped at a number of passes over a
source; what is left over goes to the other sources by weight. Whole passes of a source are taken as they are. What
the targets ask for beyond is a number of blocks of ``BLOCK`` tokens: the sources get them by highest quotients, then
the shards of each source get integer quotas of its blocks, again by highest quotients, and each shard takes its quota
from its documents, laid out in an order given by a seed, as a run of blocks that starts at a seeded block.

Shards are bounded in tokens and in rows, and a source has ``SHARDS`` at most, so a source of any size is dealt to
many tasks and the shards of one are few. Sources are numbered and levelled by sums, not in one task; only the blocks
that quotients leave open, fewer than two a source, are ranked together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendon.llm.shared import BROADCAST_ROWS, looked_up, saved, text_of
from tendon.llm.words import words_of

BLOCK = 64
#: Tokens and rows that a shard is made for, and shards of a source at most; a larger source has larger shards.
SHARD_TOKENS = 200_000
SHARD_ROWS = 50_000
SHARDS = 65_536
PASSES = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """``(doc_id, source, size, digest)``: source is marked by ``has_source`` so that null and empty names stay apart."""
    return docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.col("source").isNotNull().alias("has_source"),
        n_words(text_of()).alias("size"),
        F.unhex(F.md5(text_of())).alias("digest"),
        *more,
    )


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row in the order, from 0, without a task for all: ranges are sorted apart and counted."""
    at = F.monotonically_increasing_id()
    ranged = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at), "mix-ranges")
    part = F.shiftright("__at", 33).alias("__part")
    per = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))  # one row per range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("__part", part).join(F.broadcast(per.select("__part", before.alias("__before"))), "__part")
    return placed.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), passes: int = PASSES) -> DataFrame:
    """``(source, has_source, source_size, target)`` of a table of one row per source ``(source, has_source, source_size)``.

    Sources take the weights in turn by code point, a null source last. With w the weight and s the size, a source
    is full where ``passes * s`` is below the common level times w, and the level shares the total exactly: the
    sources that aren't full split by weight what the full ones leave. Each round marks the sources that the level
    fills and raises it; it is over when no source is added.
    """
    order = [F.col("has_source").desc(), F.col("source").asc()]
    place = numbered(sources, order, "place")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights)).cast("int") + 1)
    rows = saved(place.select("source", "has_source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(passes))).alias("cap")), "mix-weights")
    level, n_full = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("cap") < F.lit(level) * F.col("w")
        r = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("w"))).alias("w"), F.count_if(full).alias("n")).first()
        if r["n"] == n_full or not r["w"]:
            break
        level, n_full = ((r["all"] or 0) - (r["cap"] or 0.0)) / r["w"], r["n"]
    target = F.least(F.col("cap"), F.lit(float(level or 0.0)) * F.col("w"))
    return rows.select("source", "has_source", "source_size", target.alias("target"))


def seated(rows: DataFrame, seats: int, votes: str, tie: str) -> DataFrame:
    """Adds ``quota``, the Sainte-Lague seats of each row among all; equal quotients go by ``tie``, which no two rows share.

    As ``quotas``, for one group of any size: totals are sums, and the open quotients are sorted by all tasks.
    """
    v = F.col(votes).cast("double")
    r = rows.agg(F.count(F.lit(1)), F.sum(v)).first()
    n, total = r[0], r[1] or 0.0
    at = lambda x: F.floor(v * F.lit(x / total) + 0.5).cast("long") if total > 0 and x > 0 else F.lit(0).cast("long")
    few, many = seats - n / 2 - 1, seats + n / 2 + 1
    rows = rows.withColumn("__sure", at(few)).withColumn("__most", F.when(v > 0, F.greatest(at(many), at(few))).otherwise(0))
    left = seats - (rows.agg(F.sum("__sure")).first()[0] or 0)
    one = rows.where("__most > __sure").withColumn("__k", F.explode(F.sequence("__sure", F.col("__most") - 1)))
    won = one.orderBy((v / (2 * F.col("__k") + 1)).desc(), tie).limit(max(left, 0)).groupBy(tie).agg(F.count(F.lit(1)).alias("__won"))
    out = rows.join(won, tie, "left")
    return out.withColumn("quota", F.col("__sure") + F.coalesce("__won", F.lit(0))).drop("__sure", "__most", "__won")


def quotas(shards: DataFrame, seats: str, votes: str, within: list[str]) -> DataFrame:
    """Sainte-Lague seats of each row of ``shards`` among the rows with the same ``within``.

    ``seats`` (the number to give) is the same in all rows of a group. A row with v votes has the quotients
    v / 1, v / 3, v / 5 and so on, and the highest quotients of the group get the seats. Seats that a row has at any
    divisor that gives too few are certain; only the few quotients between that divisor and one that gives too many
    are ranked, two per row on average.
    """
    group = Window.partitionBy(*within)
    v, s, n = F.col(votes).cast("double"), F.col(seats), F.count(F.lit(1)).over(group)
    total = F.sum(F.col(votes).cast("double")).over(group)
    rows = shards.withColumn("__n", n).withColumn("__total", total)
    few, many = s - F.col("__n") / 2 - 1, s + F.col("__n") / 2 + 1
    at = lambda x: F.when((F.col("__total") > 0) & (x > 0), F.floor(v * x / F.col("__total") + 0.5)).otherwise(0).cast("long")
    rows = rows.withColumn("__sure", at(few)).withColumn("__most", F.when(v > 0, F.greatest(at(many), at(few))).otherwise(0))
    rows = rows.withColumn("__open", s - F.sum("__sure").over(group))
    one = rows.withColumn("__k", F.explode(F.when(F.col("__most") > F.col("__sure"), F.sequence("__sure", F.col("__most") - 1))))
    rank = F.row_number().over(group.orderBy((v / (2 * F.col("__k") + 1)).desc(), "shard"))
    won = one.withColumn("__rank", rank).where(F.col("__rank") <= F.col("__open"))
    won = won.groupBy(*within, "shard").agg(F.count(F.lit(1)).alias("__won"))
    out = rows.join(won, [*within, "shard"], "left")
    return out.withColumn("quota", F.col("__sure") + F.coalesce("__won", F.lit(0))).drop("__n", "__total", "__sure", "__most", "__open", "__won")


def _number(*parts: Column) -> Column:
    """A number below 2 to the 48 from a seeded hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *parts)), 1, 12), 16, 10).cast("long")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, at, n in zip(batch.column("__text").to_pylist(), batch.column("__from").to_pylist(), batch.column("__length").to_pylist()):
            if not n:
                out.append(None)
                continue
            w = words_of(pa.array([text]))
            size, parts = len(w.starts), []
            while n > 0:
                end = min(at + n, size)
                parts.append(w.data[w.starts[at] : w.ends[end - 1]].tobytes().decode())
                n, at = n - (end - at), 0
            out.append("\n".join(parts))
        rest = [c for c in batch.schema.names if c not in ("__from", "__length")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, pa.string())], [*rest, "__slice"])


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), passes: int = PASSES) -> DataFrame:
    """The mix itself: each document once per whole pass over its source, and the words of the chosen blocks.

    Columns are those of ``docs``; ``n_chars`` is that of the text in the row. A run of words keeps the white space
    between them. Documents of which nothing is taken are left out. Of rows that are equal in id, source and text,
    each gets one of their runs, in the order of their other columns. Null texts and an empty table give no rows.
    """
    names = docs.columns
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("doc_id", "source")]
    key = F.md5(F.concat_ws("|", F.length(parts[0]), *parts, F.md5(text_of())))
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row")
    keyed = docs.select(row, key.alias("__key"), text_of().alias("__text"))
    runs = taken(docs.select("doc_id", "source", "text", key.alias("__key")), weights, passes, ("__key",))
    runs = saved(runs.select("__key", "taken", "whole", F.col("run_from").alias("__from"), F.col("run_length").alias("__length")), "mix-runs")
    again = saved(runs.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__key"), "mix-again")
    n_again = again.count()
    some = F.broadcast(again) if n_again <= BROADCAST_ROWS else again
    once = runs.join(some, "__key", "left_anti") if n_again else runs
    rows = keyed.join(once.where("taken > 0").drop("taken"), "__key")
    if n_again:
        nth = lambda *by: F.row_number().over(Window.partitionBy("__key").orderBy(*by))
        copies = keyed.join(some, "__key", "left_semi").withColumn("__nth", nth(F.to_json("__row")))
        theirs = runs.join(some, "__key", "left_semi").withColumn("__nth", nth("whole", "__length", "__from"))
        rows = rows.unionByName(copies.join(theirs.where("taken > 0").drop("taken"), ["__key", "__nth"]).drop("__nth"))
    rows = rows.drop("__key")
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.drop("__from", "__length").dtypes)
    rows = rows.mapInArrow(_slices, f"{fields}, __slice string")
    texts = F.concat(F.array_repeat(F.col("__text"), F.col("whole").cast("int")), F.when(F.col("__slice").isNotNull(), F.array("__slice")).otherwise(F.array().cast("array<string>")))
    rows = rows.select("__row", F.explode(texts).alias("__text"))
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return rows.select(*(new.get(c, F.col("__row").getField(c)).alias(c) for c in names))


def taken(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), passes: int = PASSES, more: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, whole, run_from, run_length, source, has_source)`` per input row, and ``more`` columns.

    ``taken`` counts words with repeats: ``whole`` passes over the document and, of one more pass, the words that
    the chosen blocks hold: ``run_length`` words from ``run_from`` on, going round past the end. No document is
    taken more than ``passes`` times. A null text has no words, a null source is a source of its own that comes
    last, and a null or repeated id is a row like any other. Rows that are equal in id, source and text lie beside
    each other in one shard. Without words all targets are 0.
    """
    rows = saved(sized(docs, *more), "mix-sizes")
    per = saved(rows.groupBy("source", "has_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "mix-sums")
    per = targets(per.select("source", "has_source", "source_size"), weights, passes).join(per.drop("source_size"), ["source", "has_source"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    wanted = F.greatest(F.ceil(F.col("source_size") / SHARD_TOKENS), F.ceil(F.col("n_docs") / SHARD_ROWS), F.lit(1))
    per = per.withColumn("whole", whole).withColumn("n_shards", F.least(wanted, F.lit(SHARDS)).cast("long"))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))
    per = saved(per.withColumn("rest", rest).withColumn("name", F.struct(~F.col("has_source"), "source")), "mix-rest")
    blocks = round(round(per.agg(F.sum("rest")).first()[0] or 0.0, 3) / BLOCK)
    per = saved(seated(per, blocks, "rest", "name").drop("name", "rest").withColumnRenamed("quota", "seats"), "mix-sources")
    dealt = looked_up(rows, per, ["source", "has_source"], "n_docs", rows.count())
    number = _number(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex("digest"))
    dealt = dealt.withColumn("shard", number % F.col("n_shards")).withColumn("place", number)
    in_shard = Window.partitionBy("source", "has_source", "shard")
    order = in_shard.orderBy("place", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    laid = dealt.withColumn("first", F.coalesce(F.sum("size").over(order), F.lit(0).cast("long")))
    sizes = dealt.groupBy("source", "has_source", "shard").agg(F.sum("size").alias("shard_size"), F.max("seats").alias("seats"))
    given = quotas(sizes, "seats", "shard_size", ["source", "has_source"]).drop("seats")
    laid = laid.join(given, ["source", "has_source", "shard"])
    blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / BLOCK)).cast("long")
    start = (_number(F.lit("block"), F.col("source"), F.col("has_source").cast("string"), F.col("shard").cast("string")) % blocks) * BLOCK
    run = F.least(F.col("quota") * BLOCK, F.col("shard_size"))
    laid = laid.withColumn("a", F.least(start, F.col("shard_size"))).withColumn("run", run)
    # the run is [a, a + run) on a ring of shard_size words; the part past the end starts again at 0
    def part(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("first") + F.col("size"), hi) - F.greatest(F.col("first"), lo))

    head = part(F.col("a"), F.least(F.col("a") + F.col("run"), F.col("shard_size")))
    tail = part(F.lit(0).cast("long"), F.col("a") + F.col("run") - F.col("shard_size"))
    laid = laid.withColumn("head", head).withColumn("tail", tail).withColumn("run_length", F.col("head") + F.col("tail"))
    run_from = F.when(F.col("head") > 0, F.greatest(F.lit(0).cast("long"), F.col("a") - F.col("first"))).otherwise(F.lit(0).cast("long"))
    return laid.select(
        "doc_id", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("run_length")).alias("taken"),
        "whole", run_from.alias("run_from"), "run_length", "source", "has_source", *more,
    )
