"""Exact deduplication with DataFrame operations only.

Documents are grouped by a 128-bit hash of the text. Bytes are compared inside every group of two or more: its texts
are grouped once more with the text itself as a key, so that a collision of hashes splits the group. Texts of
documents whose hash is unique are never shuffled. Copies collapse before each shuffle, and joins treat the keys of
large groups apart, so one group may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendon.llm.shared import BROADCAST_ROWS, looked_up, saved, text_of


def groups(docs: DataFrame, keep: str = "max") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    ``keep`` says whether the smallest ("min") or the largest ("max") id of equal texts stays. A null text equals an
    empty one. A null id is never kept unless its whole group has none. Rows that repeat both id and text are counted
    one by one in ``group_size``; all rows with the kept id are marked kept, ``deduplicated`` leaves one of them. An
    empty table gives an empty result; other columns are ignored.
    """
    best = F.max if keep == "max" else F.min
    texts = docs.select("doc_id", text_of().alias("text"))
    hashed = texts.withColumn("h", F.unhex(F.md5("text")))
    prints = saved(hashed.select("doc_id", "h", F.unhex(F.sha2("text", 256)).alias("sha")), "exact-prints")
    shared = saved(prints.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "exact-hashes")
    rows = prints.count()
    some = shared.count()
    if some <= BROADCAST_ROWS:
        members = hashed.join(F.broadcast(shared), "h", "left_semi")
    else:
        members = looked_up(hashed, shared, ["h"], "n", rows).where("n is not null")
    classes = (
        members.groupBy("h", "text")
        .agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id"))
        .select("h", F.unhex(F.sha2("text", 256)).alias("sha"), "group_size", "keep_id")
    )
    classes = saved(classes, "exact-classes")
    found = looked_up(prints, classes, ["h", "sha"], "group_size", rows)
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, keep: str = "max") -> DataFrame:
    """``docs`` with one row of each class of equal texts, all columns kept.

    Works as ``groups``; where several rows share the kept id and the text, the first by its contents stays. A null
    text equals an empty one; a class without ids keeps one row. An empty table stays empty; columns may have any
    names.
    """
    names = docs.columns
    best = F.max if keep == "max" else F.min
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row")
    hashed = docs.select(row, F.col("doc_id").alias("__id"), text_of().alias("__text"))
    hashed = hashed.withColumn("__h", F.unhex(F.md5("__text")))
    prints = saved(hashed.select("__h"), "exact-prints")
    shared = saved(prints.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"), "exact-hashes")
    rows = prints.count()
    marked = looked_up(hashed, shared, ["__h"], "__n", rows)
    several = marked.where("__n is not null")
    classes = several.groupBy("__h", "__text").agg(best("__id").alias("__keep"), F.count(F.lit(1)).alias("__weight"))
    classes = classes.select("__h", F.sha2("__text", 256).alias("__sha"), "__keep", "__weight")
    classes = saved(classes, "exact-classes")
    members = several.select("__row", "__id", "__h").withColumn("__sha", F.sha2(text_of("__row.text"), 256))
    kept = looked_up(members, classes, ["__h", "__sha"], "__weight", rows).where(F.col("__id").eqNullSafe(F.col("__keep")))
    # partial results of a class are one row each, so copies collapse before the shuffle
    first = kept.groupBy("__h", "__sha").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    out = marked.where("__n is null").select("__row").unionByName(first.select("__row"))
    return out.select(*(F.col("__row").getField(c).alias(c) for c in names))
