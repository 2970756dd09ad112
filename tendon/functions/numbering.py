"""Running sums and numbers over any number of rows, without a task that sorts them all or all of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendon.sources.tables import saved


def running(rows: DataFrame, order: list[Column | str], values: dict[str, Column], key: tuple[str, ...] = (), totals: tuple[str, ...] = ()) -> DataFrame:
    """Adds for each name the sum of its value over the rows that come before in the order, within the key if there is one;
    ``totals`` names values of which ``<name>_total``, the sum over the whole key, is added too.

    Rows are sorted by ranges of (key, order) and written; each range sums its own rows, and the sums of whole ranges,
    one row per range and key that it holds, are summed in turn. A key of any size is dealt to many ranges. Rows that
    are equal in key and order come in any order.
    """
    by = [*(F.col(f"`{k}`") for k in key), *order]
    named = {n: v.cast("long") for n, v in values.items()}
    laid = rows.withColumns({f"__{n}": v for n, v in named.items()}).repartitionByRange(*by).sortWithinPartitions(*by)
    laid = saved(laid.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "ranges")
    keys = [*key, "__part"]
    per = laid.groupBy(*keys).agg(*(F.sum(f"__{n}").alias(f"__{n}_part") for n in named))
    whole = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    ahead = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = [F.coalesce(F.sum(f"__{n}_part").over(ahead), zero).alias(f"__{n}_ahead") for n in named]
    per = per.select(*keys, *sums, *(F.sum(f"__{n}_part").over(whole).alias(f"{n}_total") for n in totals))
    here = Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    found = laid.join(per, keys)
    return found.select(*(F.col(f"`{x}`") for x in rows.columns), *((F.coalesce(F.sum(f"__{n}").over(here), zero) + F.col(f"__{n}_ahead")).alias(n) for n in named), *(f"{n}_total" for n in totals))
