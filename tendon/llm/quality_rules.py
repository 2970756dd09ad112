"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; a policy
is a named, versioned mask over these bits, so that a change of policy, or the effect of a single rule, is a
bitwise expression over the ledger and never a second look at the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendon.llm.words import Words, chunks, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def rules() -> list[tuple[str, Column]]:
    """Name and failure condition of each rule; rule i owns bit i. Bits are never reused, new rules go to the end."""
    c = F.col
    return [
        ("too_few_words", c("n_words") < 50),
        ("repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        ("symbols", 100 * c("n_symbols") > 20 * c("n_words")),
        ("shouting", 100 * c("n_upper") > 50 * c("word_chars")),
        ("exclamations", 100 * c("n_bangs") > 30 * c("n_words")),
        ("repeated_lines", 100 * c("n_dup_lines") > 50 * c("n_lines")),
        ("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
        ("too_many_words", c("n_words") > 1_000_000),
    ]


#: Name -> version -> names of the rules whose failure rejects a document.
POLICIES: dict[str, dict[int, tuple[str, ...]]] = {
    "base": {1: ("too_few_words", "repeated_windows")},
    "web": {
        1: ("too_few_words", "repeated_windows", "symbols", "shouting", "exclamations"),
        2: ("too_few_words", "repeated_windows", "symbols", "shouting", "exclamations", "repeated_lines", "word_length"),
    },
}


def policy_mask(name: str = "web", version: int | None = None) -> int:
    """Bits of a policy's rules; the latest version if none is given."""
    versions = POLICIES[name]
    chosen = versions[max(versions) if version is None else version]
    bits = {rule: 1 << i for i, (rule, _) in enumerate(rules())}
    return sum(bits[rule] for rule in chosen)


def measure(w: Words) -> dict[str, np.ndarray]:
    """The measurements of each text."""
    n = len(w.first) - 1
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.starts] += 1
    np.add.at(inside, w.ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    key = w.codes()
    repeat = np.zeros(len(key), bool)
    if len(key) > 2:
        doc = w.text_ids()
        at = np.flatnonzero(doc[:-2] == doc[2:])
        top = int(key.max()) + 1
        window = doc[at]
        for k in range(3):  # numbers of the windows, exact: each step numbers pairs of numbers anew
            window = np.unique(window * top + key[at + k], return_inverse=True)[1]
        order = np.argsort(window)
        same = np.diff(window[order]) == 0
        again = np.zeros(len(at), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        hit = at[again]
        for k in range(3):
            repeat[hit + k] = True
    covered = np.zeros(len(key) + 1, np.int64)
    np.cumsum(repeat, out=covered[1:])
    lines, dups = np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw = w.data.tobytes()
    for i in range(n):
        full = [x for x in raw[w.offsets[i] : w.offsets[i + 1]].split(b"\n") if x and not x.isspace()]
        lines[i] = len(full)
        dups[i] = len(full) - len(set(full))
    return {
        "n_words": w.counts,
        "word_chars": w.sums(inside & ((w.data & 0xC0) != 0x80)),
        "n_symbols": w.sums(_SYMBOL[w.data]),
        "n_dup_lines": dups,
        "n_repeat_words": covered[w.first[1:]] - covered[w.first[:-1]],
        "n_lines": lines,
        "n_upper": w.sums((w.data >= 65) & (w.data <= 90)),
        "n_bangs": w.sums(w.data == 33),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "__text"):
            values = measure(words_of(part.column("__text")))
            rest = [c for c in part.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in rest), *(pa.array(values[m], pa.int64()) for m in MEASURES)], [*rest, *MEASURES]
            )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, measurements, rule_bits)`` of every document.

    Texts are read whole; a null text counts as one without words. Null and repeated ids are kept as they are, one
    row per input row; other columns are ignored, whatever their names. An empty table gives an empty ledger.
    """
    kept = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = dict(kept.dtypes)[id_col]
    fields = ", ".join([f"`{id_col}` {kind}", *(f"{m} long" for m in MEASURES)])
    measured = kept.mapInArrow(_measured, fields)
    return measured.withColumn("rule_bits", _bits())


def _bits() -> Column:
    out = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(rules()):
        out = out + F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return out


def verdict(mask: int, bits: str = "rule_bits") -> Column:
    """True where no rule of the mask failed."""
    return F.col(bits).bitwiseAND(F.lit(mask).cast("long")) == 0


def ablations(rows: DataFrame, mask: int) -> DataFrame:
    """Per rule of the mask: documents that fail it, documents that only it rejects, and documents kept without it.

    The ledger is first counted by its bits (2 to the number of rules combinations at most), so the shuffle is tiny.
    """
    seen = rows.groupBy("rule_bits").agg(F.count(F.lit(1)).alias("n"))
    named = [(i, name) for i, (name, _) in enumerate(rules()) if mask >> i & 1]
    per = F.explode(F.array(*(F.struct(F.lit(i).alias("bit"), F.lit(name).alias("rule")) for i, name in named))).alias("r")
    bit = F.expr("shiftleft(1L, r.bit)")
    failed = F.col("rule_bits").bitwiseAND(F.lit(mask).cast("long"))
    return (
        seen.select("rule_bits", "n", per)
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(failed.bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(failed == bit, F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(failed.bitwiseAND(F.bitwise_not(bit)) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def accepted(docs: DataFrame, mask: int | None = None) -> DataFrame:
    """The documents that pass the policy, with their own columns; names that clash with the ledger's are safe."""
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), F.col("text"))
    kept = ledger(packed, "__row", "text").where(verdict(policy_mask() if mask is None else mask))
    return kept.select(*(F.col("__row").getField(c).alias(c) for c in names))


