"""A trie of the shared beginnings of conversations, with totals of its subtrees by parallel tree contraction.

A turn is known by 120 bits of a hash of its place, role and text; a beginning by the exclusive or of its turns' bits,
which is a running value over sorted ranges of turns, so a conversation of any length is dealt to many tasks and its
parent is one exclusive or away. Nodes are groups of equal beginnings.

Totals come from contraction in rounds of joins on saved tables. Each round rakes all leaves into their parents and
splices out every other node of the unary chains, leaving what the node adds on the edge to its only child; nodes that
are left shrink geometrically, at any depth. The rounds are then gone through backwards, and a spliced node's total is
its own and its edge's plus its child's, so each join is with the nodes that were left at that round alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendon.llm.mixing import n_words
from tendon.llm.shared import looked_up, saved, text_of

#: A conversation takes its first turns from the first of its family of so many ids.
FAMILY = 20
#: Bytes of a run of ids that are hashed as one row.
RUN_BYTES = 1 << 18


def _bits(of: Column, name: str) -> list[Column]:
    """120 bits of the MD5 as two longs."""
    digest = F.md5(of)
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long").alias(f"{name}{i + 1}") for i in range(2)]


def _scan(key: str, sums: tuple[str, ...], xors: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Running values within a task whose rows are sorted by ``key``, and the task's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(key).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            lengths = np.diff(np.append(starts, len(k)))
            columns, names = list(batch.columns), list(batch.schema.names)
            for c in (*sums, *xors):
                v = batch.column(c).to_numpy()
                acc = np.cumsum(v) if c in sums else np.bitwise_xor.accumulate(v)
                ahead = np.concatenate([[0], acc[starts[1:] - 1]])
                if last is not None and k[0] == last:
                    ahead[0] = -carried[c] if c in sums else carried[c]
                ahead = np.repeat(ahead, lengths)
                acc = acc - ahead if c in sums else acc ^ ahead
                carried[c] = acc[-1]
                columns.append(pa.array(acc))
                names.append(f"{c}_run")
            last = k[-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(k), part, np.int32))], [*names, "part"])

    return run


def running(rows: DataFrame, key: str, order: list[Column | str], sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``<column>_run``, the running sum or exclusive or of long columns among the rows of a key, in the order given.

    Rows are sorted by ranges of (key, order) and scanned by tasks. Only keys that cross from one range to the next
    need what lies before: there are fewer of them than ranges, and their values are broadcast, one row per range and key.
    """
    by = [F.col(key), *order]
    shape = ", ".join(f"{n} {t}" for n, t in [*rows.dtypes, *((f"{c}_run", "long") for c in (*sums, *xors)), ("part", "int")])
    laid = saved(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_scan(key, sums, xors), shape), "trie-ranges")
    ends = laid.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    crossing = ends.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    own = [*(F.sum(c).alias(c) for c in sums), *(F.bit_xor(c).alias(c) for c in xors)]
    per = laid.join(F.broadcast(crossing), key, "left_semi").groupBy(key, "part").agg(*own)
    ahead = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(key, "part", *(F.sum(c).over(ahead).alias(f"{c}_ahead") for c in sums), *(F.bit_xor(c).over(ahead).alias(f"{c}_ahead") for c in xors))
    found = laid.join(F.broadcast(per), [key, "part"], "left")
    here, ahead_of = (lambda c: F.col(f"{c}_run")), (lambda c: F.coalesce(f"{c}_ahead", F.lit(0)))
    new = [*((here(c) + ahead_of(c)).alias(f"{c}_run") for c in sums), *(here(c).bitwiseXOR(ahead_of(c)).alias(f"{c}_run") for c in xors)]
    return found.select(*rows.columns, *new)


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its family: 0 to 3."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns ``(conv_id, depth, t1, t2, words, last)`` and conversations ``(conv_id, n_turns, total)``, both saved.

    ``total`` is the rebuilt length. Turns with the same place in the order go by a hash of role and text. Rows
    without conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), text_of()
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *_bits(F.concat_ws(":", F.length(role), role, text), "u"), n_words(text).alias("words"), F.lit(1).cast("long").alias("one")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("u1"), F.col("u2")]
    turns = saved(running(turns, "conv_id", order, sums=("one",)).select("conv_id", F.col("one_run").alias("i"), "u1", "u2", "words"), "trie-turns")
    n = turns.groupBy("conv_id").agg(F.max("i").alias("n_turns"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = shared_turns(F.col("conv_id"))
    convs = n.withColumn("base", base).join(n.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base")), "base", "left")
    convs = convs.withColumn("taken", F.least(h, F.coalesce("n_base", F.lit(0))))
    convs = saved(convs.withColumn("total", F.col("taken") + F.greatest(F.lit(0), F.col("n_turns") - h)), "trie-conversations")
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("i") <= 3)).select(F.col("conv_id").alias("base"), F.col("i").alias("depth"), "u1", "u2", "words")
    heads = convs.join(first, "base").where(F.col("depth") <= F.col("taken"))
    own = looked_up(turns.where(F.col("i") > h), convs.select("conv_id", "taken", "total", "n_turns"), ["conv_id"], "n_turns", turns.count())
    own = own.withColumn("depth", F.col("taken") + F.col("i") - h)
    columns = ["conv_id", "depth", "u1", "u2", "words", "total"]
    both = heads.select(*columns).unionByName(own.select(*columns))
    placed = both.select("conv_id", "depth", *_bits(F.concat_ws(":", "depth", "u1", "u2"), "t"), "words", (F.col("depth") == F.col("total")).alias("last"))
    return placed, convs.select("conv_id", "n_turns", "total")


def _coin(a: Column, b: Column, depth: Column, k: int) -> Column:
    """Alternates along chains: by a bit of the depth, or by a hash every third round and from the sixtieth bit on."""
    bit = k - k // 3
    if k % 3 == 2 or bit >= 60:
        return F.xxhash64(a, b, F.lit(k)).bitwiseAND(F.lit(1)) == 1
    return F.shiftright(depth, bit).bitwiseAND(F.lit(1)) == 1


def subtree_totals(nodes: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """``(a, b, *values)`` per node: sums over its subtree, itself included.

    ``nodes`` is saved and has ``(a, b, pa, pb, depth, n_children, *values)``: the node's key, its parent's (null at
    roots), and long values. Any number of roots will do.
    """
    edge = {v: f"{v}_edge" for v in values}
    left = nodes.select("a", "b", "pa", "pb", "depth", F.col("n_children").alias("k"), *values, *(F.lit(0).cast("long").alias(edge[v]) for v in values))
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while left.where("k > 0").limit(1).count():
        r = len(rounds)
        leaf = F.col("k") == 0
        gains = [F.sum(F.when(leaf, F.col(v) + F.col(edge[v]))).alias(f"{v}_gain") for v in values]
        up = left.where("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"))
        up = up.agg(*gains, F.count_if(~leaf).alias("live"), F.max(F.when(~leaf, F.struct("a", "b", "depth"))).alias("only"))
        added = {v: F.col(v) + F.coalesce(f"{v}_gain", F.lit(0)) for v in values}
        raked = left.where("k > 0").join(up, ["a", "b"]).withColumns(added).withColumn("k", F.col("live"))
        chain = F.col("pa").isNotNull() & (F.col("k") == 1) & _coin(F.col("a"), F.col("b"), F.col("depth"), r) & ~_coin(F.col("only.a"), F.col("only.b"), F.col("only.depth"), r)
        raked = raked.withColumn("out", chain).select("a", "b", "pa", "pb", "depth", "k", *values, *edge.values(), "only", "out")
        raked = saved(raked, "trie-raked")
        out = raked.where("out").select(
            F.col("only.a").alias("a"), F.col("only.b").alias("b"), F.col("a").alias("va"), F.col("b").alias("vb"), F.col("pa").alias("vpa"), F.col("pb").alias("vpb"),
            *(F.col(v).alias(f"{v}_v") for v in values), *(F.col(edge[v]).alias(f"{v}_vedge") for v in values),
        )
        spliced = saved(raked.where("not out").drop("only", "out").join(out, ["a", "b"], "left"), "trie-spliced")
        rounds.append((left, spliced))
        cut = F.col("va").isNotNull()
        left = spliced.select(
            "a", "b", F.when(cut, F.col("vpa")).otherwise(F.col("pa")).alias("pa"), F.when(cut, F.col("vpb")).otherwise(F.col("pb")).alias("pb"), "depth", "k", *values,
            *(F.when(cut, F.col(edge[v]) + F.col(f"{v}_v") + F.col(f"{v}_vedge")).otherwise(F.col(edge[v])).alias(edge[v]) for v in values),
        )
    totals = left.select("a", "b", *values)
    for before, spliced in reversed(rounds):
        cut = spliced.where("va is not null").select("a", "b", "va", "vb", *((F.col(f"{v}_v") + F.col(edge[v])).alias(f"{v}_more") for v in values))
        own = cut.join(totals, ["a", "b"]).select(F.col("va").alias("a"), F.col("vb").alias("b"), *((F.col(v) + F.col(f"{v}_more")).alias(v) for v in values))
        leaves = before.where("k = 0").select("a", "b", *values)
        totals = saved(totals.unionByName(own).unionByName(leaves), "trie-totals")
    return totals


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a node that follow each other, joined by commas to rows of bounded size."""
    node, first, parts, size = None, None, [], 0
    out: list[tuple[int, int, int, str]] = []
    for batch in batches:
        for a, b, i in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "conv_id"))):
            if node != (a, b) or size > RUN_BYTES:
                if parts:
                    out.append((*node, first, ",".join(parts)))
                node, first, parts, size = (a, b), i, [], 0
            parts.append(str(i))
            size += len(parts[-1]) + 1
        if len(out) > 4096 or sum(len(r[3]) for r in out[-64:]) > 4 * RUN_BYTES:
            yield _rows(out, ("a", "b", "first", "ids"))
            out = []
    if parts:
        out.append((*node, first, ",".join(parts)))
    if out:
        yield _rows(out, ("a", "b", "first", "ids"))


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [pa.string() if isinstance(c[0], str) else pa.int64() for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the runs of each node in turn; the state of one node is held."""
    node, state = None, None
    for batch in batches:
        out = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
            if node == (a, b):
                state.update(b"," + ids.encode())
            else:
                if state is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256(ids.encode())
        if out:
            yield _rows(out, ("a", "b", "sha"))
    if state is not None:
        yield _rows([(*node, state.hexdigest())], ("a", "b", "sha"))


def end_digests(ends: DataFrame) -> DataFrame:
    """``(a, b, sha)``: SHA-256 of the ids of ``(a, b, conv_id)`` in rising order, comma-joined.

    Ids are sorted by ranges and joined to runs of bounded size first, so that the one task that must hash a node's
    bytes in their order gets few rows and holds one run.
    """
    order = ["a", "b", "conv_id"]
    runs = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs, "a long, b long, first long, ids string")
    runs = saved(runs, "trie-runs")
    return runs.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_hashed, "a long, b long, sha string")


def trie(conversations: DataFrame) -> DataFrame:
    """Nodes ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.

    Turns go by ``turn``, nulls first, and then by a hash of role and text; a null role or text is empty, and repeated
    rows are turns of their own. Every conversation begins with turns of the first of its family (``shared_turns``).
    Members of a node are the conversations that start with it; ``saved_tokens`` sums the words of a node's last turn
    over all members but one, over the subtree. An empty table has no node; other columns are ignored.
    """
    placed, convs = rebuilt(conversations)
    path = running(placed, "conv_id", ["depth"], xors=("t1", "t2"))
    path = saved(path.select("conv_id", "depth", "words", "last", F.col("t1_run").alias("a"), F.col("t2_run").alias("b"), F.col("t1_run").bitwiseXOR(F.col("t1")).alias("pa"), F.col("t2_run").bitwiseXOR(F.col("t2")).alias("pb")), "trie-path")
    one = lambda *cs: [F.min(c).alias(c) for c in cs]
    nodes = path.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_convs"), *one("conv_id", "depth", "words", "pa", "pb"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(zero.alias("a"), zero.alias("b"), "n_convs", "conv_id", zero.alias("depth"), zero.alias("words"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"))
    nodes = saved(nodes.unionByName(root), "trie-nodes")
    children = nodes.where("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumns({"saved_tokens": (F.col("n_convs") - 1) * F.col("words"), "n_leaves": (F.col("n_children") == 0).cast("long")})
    nodes = saved(nodes, "trie-nodes")
    totals = subtree_totals(nodes, ("saved_tokens", "n_leaves"))
    ends = path.where("last").select("a", "b", "conv_id").unionByName(convs.where("total = 0").select(zero.alias("a"), zero.alias("b"), "conv_id"))
    found = nodes.drop("saved_tokens", "n_leaves").join(totals, ["a", "b"]).join(end_digests(ends), ["a", "b"], "left")
    found = saved(found.withColumns({"pa": F.coalesce("pa", zero), "pb": F.coalesce("pb", zero)}), "trie-found")
    parents = saved(nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent"), F.col("n_children").alias("weight")), "trie-parents")
    found = looked_up(found, parents, ["pa", "pb"], "weight", found.count())
    return found.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
