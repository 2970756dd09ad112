"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped sorted hash arrays.

Counting goes in three rounds over the training texts, each gathered in tasks before it is sent to shards:

1. words -> counts; the shards, sorted by hash, are the vocabulary, and a word's place in them is its number;
2. pairs of numbers -> counts, sorted by a hash of the pair that can be undone;
3. from the pairs, per number: the sum and the number of pairs it begins by count (1, 2, more), and the number of
   distinct words before it.

Only counts of counts, a few numbers per shard, reach the driver. All arrays grow with the corpus and are cut into
shards; scoring tasks map them and look up the distinct words and pairs of each block of texts in sorted order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendon.llm.shared import new_folder
from tendon.llm.sorted_arrays import SENT, Mapped, by_shard, counted, dealt, shard_bits, summed, write_column
from tendon.llm.words import chunks, mix, words_of

#: The hash of the token that ends a text; words' hashes are spread over all numbers and miss it but by chance.
END = np.uint64(0xE0D0C0B0A0908070)
STATS = "shard long, parts array<binary>, stats array<long>"
KINDS = ("total", "one", "two", "more", "before")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["shard", "parts", "stats"])


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    for k in (0xC4CEB9FE1A85EC53, 0xFF51AFD7ED558CCD):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(pow(k, -1, 2**64))
    return x ^ (x >> np.uint64(33))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end among them, and where each text's tokens begin (one more at the end)."""
    w = words_of(column)
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    out = np.full(first[-1], END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[first[1:] - 1] = False
    out[keep] = w.hashes()
    return out, first


@dataclass
class Model:
    """What a scoring task needs: the mapped arrays and the discounts."""

    vocabulary: Mapped
    pairs: Mapped
    contexts: Mapped
    n_words: int
    n_tokens: int
    discounts: tuple[float, float, float]
    low_discounts: tuple[float, float, float]
    n_pairs: int
    low_back: float

    def low(self, before: np.ndarray) -> np.ndarray:
        """Probability of a word by the number of distinct words before it."""
        floor = 1.0 / (self.n_words + 1)
        if not self.n_pairs:
            return np.full(len(before), floor)
        d = np.array([0.0, *self.low_discounts])[np.minimum(before, 3)]
        return np.maximum(before - d, 0) / self.n_pairs + self.low_back * floor


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many things were counted 1, 2, 3 and 4 times; 0.5, 1, 1.5 if any is none."""
    if min(n) == 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def _text_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for part in chunks(batch):
            yield tokens(part.column("text"))[0]


def _vocabulary(rows: DataFrame, folder: str, bits: int, partitions: int) -> tuple[list[int], int]:
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return counted(_text_hashes(batches), bits)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in by_shard(batches):
            keys, counts = summed(parts)
            write_column(folder, "key", shard, keys)
            write_column(folder, "count", shard, counts)
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(keys)]), pa.array([int(counts.sum())])], ["shard", "n", "total"])

    done = dealt(rows.mapInArrow(gather, SENT), partitions).mapInArrow(write, "shard long, n long, total long").collect()
    sizes = [0] * (1 << bits)
    for r in done:
        sizes[r["shard"]] = r["n"]
    return sizes, sum(r["total"] for r in done)


def numbered(vocabulary: Mapped, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes' places in the vocabulary, and which of them each hash is."""
    one, back = np.unique(hashes, return_inverse=True)
    return one, vocabulary.positions(one), back


def pair_keys(number: np.ndarray, first: np.ndarray, n_words: int) -> np.ndarray:
    """Hash of each token's number and the one before it; a text begins after the number ``n_words``."""
    before = np.empty_like(number)
    before[1:] = number[:-1]
    before[first[:-1]] = n_words
    known = (number >= 0) & (before >= 0)
    key = np.where(known, before, 0).astype(np.uint64) * np.uint64(n_words + 1) + np.where(known, number, 0).astype(np.uint64)
    return mix(key), before, known


def fitted(docs: DataFrame, partitions: int | None = None) -> Model:
    """The model of the texts in ``docs``; null texts count as empty, other columns are ignored."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = shard_bits(partitions)
    rows = docs.select("text")
    at = new_folder(spark, "kneser-ney")
    sizes, n_tokens = _vocabulary(rows, f"{at}/words", bits, partitions)
    vocabulary, n_words = Mapped(f"{at}/words", sizes), sum(sizes)
    if n_words >= 2**32 - 2:
        raise ValueError("pairs of word numbers need 64 bits: at most 2**32 - 2 distinct words")
    ranges = 1 << max(1, bits - 2)
    span = -(-(n_words + 1) // ranges)  # numbers per shard of contexts

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[np.ndarray]:
            for batch in batches:
                for part in chunks(batch):
                    hashes, first = tokens(part.column("text"))
                    if len(hashes):
                        _, place, back = numbered(vocabulary, hashes)
                        yield pair_keys(place[back], first, n_words)[0]

        return counted(keys(), bits)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in by_shard(batches):
            keys, counts = summed(parts)
            write_column(f"{at}/pairs", "key", shard, keys)
            write_column(f"{at}/pairs", "count", shard, counts.astype(np.min_scalar_type(int(counts.max()))))
            pair = unmix(keys)
            left, right = pair // np.uint64(n_words + 1), pair % np.uint64(n_words + 1)
            found = [(left, counts), (left[counts == 1], None), (left[counts == 2], None), (left[counts > 2], None), (right, None)]
            found = [summed([(number, np.ones(len(number), np.int64) if n is None else n)]) for number, n in found]
            bounds = np.arange(ranges, dtype=np.uint64) * np.uint64(span)
            cuts = [np.append(np.searchsorted(one, bounds), len(one)) for one, _ in found]
            out = [(-1, [], [shard, len(keys), *(int((counts == k).sum()) for k in (1, 2, 3, 4))])]
            for i in range(ranges):
                parts = []
                for (one, n), cut in zip(found, cuts):
                    part = slice(cut[i], cut[i + 1])
                    parts += [one[part].astype(np.uint32).tobytes(), n[part].astype(np.uint64).tobytes()]
                if any(parts):
                    out.append((i, parts, []))
            yield _rows(out)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        now = None

        def done() -> tuple:
            for kind, values in held.items():
                write_column(f"{at}/contexts", kind, now, values.astype(np.min_scalar_type(int(values.max(initial=0)))))
            n = held["before"]
            return now, [], [int(n.sum()), *(int((n == k).sum()) for k in (1, 2, 3, 4)), int((n > 2).sum())]

        out = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] < 0:
                    out.append(tuple(r.values()))
                    continue
                if now != r["shard"]:
                    if now is not None:
                        out.append(done())
                    now = r["shard"]
                    held = {k: np.zeros(span, np.uint64) for k in KINDS}
                for k, kind in enumerate(KINDS):
                    number = np.frombuffer(r["parts"][2 * k], np.uint32).astype(np.int64)
                    held[kind][number - now * span] += np.frombuffer(r["parts"][2 * k + 1], np.uint64)
        if now is not None:
            out.append(done())
        if out:
            yield _rows(out)

    pairs = dealt(rows.mapInArrow(gather, SENT), partitions).mapInArrow(write, STATS)
    stats = dealt(pairs, partitions).mapInArrow(contexts, STATS).select("shard", "stats").collect()
    pair_sizes, there = [0] * (1 << bits), [0] * ranges
    high, low, n_pairs, n_more = np.zeros(4, np.int64), np.zeros(4, np.int64), 0, 0
    for r in stats:
        s = r["stats"]
        if r["shard"] < 0:
            pair_sizes[s[0]] = s[1]
            high += s[2:6]
        else:
            there[r["shard"]] = 1
            n_pairs += s[0]
            low += s[1:5]
            n_more += s[5]
    low_d = discounts(low.tolist())
    back = (low_d[0] * low[0] + low_d[1] * low[1] + low_d[2] * n_more) / n_pairs if n_pairs else 1.0
    held = Mapped(f"{at}/contexts", [span * x for x in there])
    held.before = np.arange(ranges + 1, dtype=np.int64) * span
    return Model(vocabulary, Mapped(f"{at}/pairs", pair_sizes), held, n_words, n_tokens, discounts(high.tolist()), low_d, n_pairs, float(back))


def _scored(model: Model, there: list[int], span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.contexts
        held.before = np.arange(len(there) + 1, dtype=np.int64) * span
        smooth = 0.1 * (model.n_words + 1) + model.n_tokens
        for batch in batches:
            for part in chunks(batch):
                hashes, first = tokens(part.column("text"))
                _, place, back = numbered(model.vocabulary, hashes)
                count = model.vocabulary.values("count", place)
                before = held.values("before", place)
                base = np.log10((count + 0.1) / smooth)
                low = model.low(before)
                number = place[back]
                key, left, known = pair_keys(number, first, model.n_words)
                one, at = np.unique(key, return_inverse=True)
                c = np.where(known, model.pairs.values("count", model.pairs.positions(one))[at], 0)
                lefts, which = np.unique(left, return_inverse=True)
                total, n1, n2, n3 = (held.values(k, lefts) for k in ("total", "one", "two", "more"))
                d1, d2, d3 = model.discounts
                some = total > 0
                safe = np.where(some, total, 1)
                gamma = np.where(some, (d1 * n1 + d2 * n2 + d3 * n3) / safe, 1.0)[which]
                p = np.maximum(c - np.array([0.0, d1, d2, d3])[np.minimum(c, 3)], 0) / safe[which] + gamma * low[back]
                add = lambda x: np.add.reduceat(x, first[:-1]) if len(x) else np.empty(0, x.dtype)
                known_words = add((count > 0)[back].astype(np.int64))
                rest = [c for c in part.schema.names if c != "text"]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in rest), pa.array(np.diff(first)), pa.array(known_words), pa.array(np.full(n, model.n_tokens)), pa.array(add(base[back])), pa.array(add(np.log10(p)))],
                    [*rest, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score, perplexity)`` of every row's whole text.

    Every text ends with one end token, an empty or null one has only that. ``score`` is the model's log10
    probability of the text, ``base_score`` that of additively smoothed word counts. Ids may be null or repeat.
    """
    rows = docs.select(F.col(id_col), F.coalesce("text", F.lit("")).alias("text"))
    sizes = model.contexts.sizes
    span = int(model.contexts.before[1]) if len(sizes) else 0
    fields = f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = rows.mapInArrow(_scored(model, sizes, span), fields)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores of all rows by the model of those that are not held out, with the flag ``held_out``."""
    model = fitted(docs.where(~held_out).select("text"))
    rows = docs.select(F.struct(F.col("doc_id"), held_out.alias("held_out")).alias("row"), "text")
    out = scored(rows, model, "row")
    return out.select("row.doc_id", "row.held_out", *(c for c in out.columns if c != "row"))


