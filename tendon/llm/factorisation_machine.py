"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

Pairwise interactions have low rank, so a document is scored in time linear in its distinct features:
the sum over pairs <v_i, v_j> x_i x_j is half of (sum v_i x_i) squared less the sum of (v_i x_i) squared.

The model is fitted in one task on a bounded draw of labelled documents (``SAMPLE``, by a hash of the id) and kept in
the shared folder; every document is scored, from its whole text alone.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendon.llm.quality_rules import measure
from tendon.llm.shared import id_crc, mapped_path, new_folder, put_file
from tendon.llm.words import LOWER, Words, chunks, words_of

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 4_000
HASH_BITS = 18
RANK = 8
EPOCHS = 12
#: Steps at least; small samples are gone through more often.
STEPS = 1_000
RATE = 0.1
DECAY = 1e-4
BATCH = 32
BINS = 12
THRESHOLD = 0.3

#: Structure statistics as shares, and the edges of their bins.
_EDGES = np.array([0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 0.95])
_SHARES = ("symbols", "dup_lines", "repeats", "upper", "bangs", "distinct", "digits", "beyond_ascii")
_SIZES = ("words", "length", "line", "bytes")
WIDTH = (1 << HASH_BITS) + BINS * (len(_SHARES) + len(_SIZES))


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all texts, and where each text's begin (one more at the end).

    Words count by the log of their frequency, scaled to length one per text; each statistic is one of BINS flags.
    """
    n = len(w.first) - 1
    m = measure(w)
    bucket = (w.hashes(LOWER) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    both, times = np.unique(w.text_ids() * (1 << HASH_BITS) + bucket, return_counts=True)
    doc, word = both >> HASH_BITS, both & ((1 << HASH_BITS) - 1)
    value = np.log1p(times)
    value /= np.sqrt(np.bincount(doc, value**2, n))[doc]
    words = np.maximum(m["n_words"], 1)
    sizes = np.diff(w.offsets)
    shares = {
        "symbols": m["n_symbols"] / words,
        "dup_lines": m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
        "repeats": m["n_repeat_words"] / words,
        "upper": m["n_upper"] / np.maximum(m["word_chars"], 1),
        "bangs": m["n_bangs"] / words,
        "distinct": np.bincount(doc, minlength=n) / words,
        "digits": w.sums((w.data >= 48) & (w.data <= 57)) / np.maximum(sizes, 1),
        "beyond_ascii": w.sums(w.data >= 128) / np.maximum(sizes, 1),
    }
    logs = {
        "words": np.log2(m["n_words"] + 1.0) * 0.7,
        "length": m["word_chars"] / words * 0.7,
        "line": np.log2(m["n_words"] / np.maximum(m["n_lines"], 1) + 1),
        "bytes": np.log2(sizes + 1.0) * 0.6,
    }
    bins = [np.searchsorted(_EDGES, shares[k], "right") for k in _SHARES]
    bins += [np.clip(logs[k], 0, BINS - 1).astype(np.int64) for k in _SIZES]
    k = len(bins)
    flags = (1 << HASH_BITS) + np.arange(k)[:, None] * BINS + np.array(bins).reshape(k, n)
    all_doc = np.concatenate([doc, np.tile(np.arange(n), k)])
    order = np.argsort(all_doc, kind="stable")
    number = np.concatenate([word, flags.ravel()])[order]
    values = np.concatenate([value, np.full(k * n, 0.5)])[order]
    return number, values, np.searchsorted(all_doc[order], np.arange(n + 1))


def logits(number: np.ndarray, value: np.ndarray, first: np.ndarray, bias: float, line: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The machine's sums before the logistic function; every text has some features."""
    at = first[:-1]
    if not len(at):
        return np.empty(0)
    vx = low[number] * value[:, None]
    total = np.add.reduceat(vx, at, axis=0)
    return bias + np.add.reduceat(line[number] * value, at) + 0.5 * (total**2 - np.add.reduceat(vx**2, at, axis=0)).sum(axis=1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(number: np.ndarray, value: np.ndarray, first: np.ndarray, label: np.ndarray, seed: int = 1) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, line weights and low-rank vectors by AdaGrad on the logistic loss."""
    rng = np.random.default_rng(seed)
    line, low, bias = np.zeros(WIDTH), rng.normal(0, 0.01, (WIDTH, RANK)), 0.0
    if not len(label):
        return bias, line, low
    share = np.clip(label.mean(), 0.02, 0.98)
    bias = float(np.log(share / (1 - share)))
    g_line, g_low, g_bias = np.full(WIDTH, 1e-2), np.full((WIDTH, RANK), 1e-2), 1e-2
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(label)))):
        order = rng.permutation(len(label))
        for i in range(0, len(order), BATCH):
            docs = order[i : i + BATCH]
            sizes = first[docs + 1] - first[docs]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(first[docs] - (ends - sizes), sizes)
            f, x, own = number[at], value[at], np.concatenate([[0], ends])
            error = logistic(logits(f, x, own, bias, line, low)) - label[docs]
            e = np.repeat(error, sizes)
            vx = low[f] * x[:, None]
            total = np.repeat(np.add.reduceat(vx, own[:-1], axis=0), sizes, axis=0)
            which, back = np.unique(f, return_inverse=True)
            d_line = np.bincount(back, e * x) / len(docs) + DECAY * line[which]
            d_low = np.stack([np.bincount(back, e * x * (total[:, k] - vx[:, k])) for k in range(RANK)], axis=1) / len(docs) + DECAY * low[which]
            g_line[which] += d_line**2
            g_low[which] += d_low**2
            line[which] -= RATE * d_line / np.sqrt(g_line[which])
            low[which] -= RATE * d_low / np.sqrt(g_low[which])
            d = float(error.mean())
            g_bias += d * d
            bias -= RATE * d / np.sqrt(g_bias)
    return bias, line, low


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    number = np.concatenate([p[0] for p in parts])
    value = np.concatenate([p[1] for p in parts])
    sizes = np.concatenate([np.diff(p[2]) for p in parts])
    return number, value, np.concatenate([[0], np.cumsum(sizes)])


_NOTHING = np.empty(0, np.int64), np.empty(0), np.zeros(1, np.int64)


def _packed(bias: float, line: np.ndarray, low: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.concatenate([[bias, *[0.0] * RANK], np.concatenate([line[:, None], low], axis=1).ravel()]).astype(np.float32).reshape(-1, RANK + 1))
    return out.getvalue()


def _fitted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, labels = [], []
        for batch in batches:
            for part in chunks(batch):
                parts.append(features(words_of(part.column("text"))))
                labels.append(part.column("label").to_numpy(zero_copy_only=False))
        label = np.concatenate(labels).astype(float) if labels else np.empty(0)
        put_file(path, _packed(*fit(*(_joined(parts) if parts else _NOTHING), label)))
        yield pa.RecordBatch.from_arrays([pa.array([len(label)])], ["n"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> str:
    """Fit on at most ``sample`` labelled documents for which ``usable`` holds; the path of the model.

    ``labels`` has ``(doc_id, label)``; null labels are left out, and a document with several has the largest. The
    labelled documents drawn are those with the smallest hashes of their ids; of several texts with one id, the first
    by code point counts.
    """
    one = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    drawn = one.where(usable).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).repartition(1).sortWithinPartitions("doc_id").select("text", "label")
    path = f"{new_folder(docs.sparkSession, 'machine')}/model.npy"
    if not rows.mapInArrow(_fitted(path), "n long").collect():  # no labels, no task
        put_file(path, _packed(*fit(*_NOTHING, np.empty(0))))
    return path


def _scores(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = np.load(mapped_path(path), mmap_mode="r")
        bias, line, low = float(model[0, 0]), model[1:, 0], model[1:, 1:]
        for batch in batches:
            for part in chunks(batch):
                score = logistic(logits(*features(words_of(part.column("text"))), bias, line, low).astype(np.float64))
                rest = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(score, pa.float64())], [*rest, "score"])

    return run


def scored(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, score)``, the probability of good quality, of every row's whole text.

    Null and empty texts are scored by the statistics of a text without words. Null and repeated ids are rows like
    any other; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col), F.col("text"))
    return rows.mapInArrow(_scores(path), f"`{id_col}` {dict(rows.dtypes)[id_col]}, score double")


def held_out(column: str = "doc_id") -> Column:
    return id_crc(column) % 5 == 0
