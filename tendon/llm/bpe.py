"""Byte-level BPE over a corpus by a global shuffle of distinct words.

1. Texts are cut into pre-tokens, block by block. A block has its distinct words, and for every text the places of its
   pre-tokens among them, in order. Blocks follow the rows of a partition, so both are the same whenever it is read.
2. The blocks' words go to the shards of their hashes. A shard encodes each distinct word of the corpus once, and
   sends the ids back to every block that has the word.
3. Ids join the texts of their block, and each text's ids are laid out by position. Decoding joins the ids with the
   table of token bytes.

A word goes through a shuffle once per block and not once per occurrence, so frequent words are no hot keys; positions
travel as numbers of a byte or two. Words are told apart by their bytes; hashes only choose shards.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendon.llm.sorted_arrays import shard_bits
from tendon.llm.words import chunks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes of texts that make up a block, or one longer text.
BLOCK = 6 << 20
#: Ids that are laid out before their rows are handed on.
HANDED = 1 << 19
#: Shards per shuffle partition; a task holds the words of one shard at a time.
SHARDS = 2
_CUT = regex.compile(public_tokenizers.PATTERN)
#: A space next to white space or to an end of the text: there, spaces alone don't bound pre-tokens.
_LOOSE = regex.compile(r"\A | \s|\s | \Z")
#: In the order of rows of a block, texts come after all shards of words.
_TEXT = 1 << 40


def _ranks(ranks: str) -> dict[bytes, int]:
    with open(ranks, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoding(ranks: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(ranks), special_tokens={})


@lru_cache(maxsize=4)
def merges(ranks: str) -> tiktoken.Encoding:
    """Encodes whatever it is given as one piece."""
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=_ranks(ranks), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(ranks: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens one after another, where each token's begin, and how many it has."""
    table = {i: raw for raw, i in _ranks(ranks).items()}
    sizes = np.zeros(max(table) + 1, np.int64)
    sizes[list(table)] = [len(x) for x in table.values()]
    return np.frombuffer(b"".join(table[i] for i in sorted(table)), np.uint8), np.cumsum(sizes) - sizes, sizes


def pieces_of(text: str) -> list[str]:
    """Pieces of a text that pre-tokens don't reach across.

    A single space between two other characters bounds pre-tokens. Pieces follow such spaces; the first piece, which
    has no space before it, begins with a space to tell it apart. Texts with other white space around spaces come as
    pre-tokens, which begin with two spaces.
    """
    if _LOOSE.search(text):
        return ["  " + x for x in _CUT.findall(text)]
    pieces = text.split(" ")
    pieces[0] = " " + pieces[0]
    return pieces


def pre_tokens(piece: str) -> list[str]:
    if piece.startswith("  "):
        return [piece[2:]]
    return _CUT.findall(piece[1:] if piece.startswith(" ") else " " + piece)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all ranges one after another."""
    total = np.cumsum(sizes)
    out = np.arange(total[-1] if len(total) else 0)
    return out + np.repeat(starts - (total - sizes), sizes)


class _Codes(dict):
    def __missing__(self, key):
        self[key] = len(self)
        return len(self) - 1


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as planes of bytes, compressed; planes of zeros cost nothing."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _numbers(planes: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(planes), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _list_planes(starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    pack = zstandard.ZstdCompressor(1)
    numbers = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [pack.compress(numbers[a:b].T.tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]


def _cut(bits: int, give: str):
    """Rows of words, ``(block, shard, sizes, words)``, or rows of texts, ``(block, shard, __id, places)``, as ``give`` says."""

    def block_of(part: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
        pieces, codes, counts = _Codes(), [], []
        for text in part.column("__text").to_pylist():
            own = pieces_of(text) if text else []
            codes.append(np.fromiter(map(pieces.__getitem__, own), np.int64, len(own)))
            counts.append(len(own))
        words = _Codes()
        inner = [[words[w] for w in pre_tokens(p)] for p in pieces]
        many = np.fromiter(map(len, inner), np.int64, len(inner))
        flat = np.fromiter(chain.from_iterable(inner), np.int64, int(many.sum()))
        raw = [w.encode() for w in words]
        del inner, pieces, words
        shard = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw)) >> np.uint64(64 - bits)
        order = np.argsort(shard, kind="stable")
        if give == "words":
            names, first = np.unique(shard[order], return_index=True)
            runs = np.split(order, first[1:]) if len(raw) else []
            sizes = [_planes(np.fromiter((len(raw[i]) for i in run), np.int64, len(run))) for run in runs]
            data = [zstandard.compress(b"".join([raw[i] for i in run]), 1) for run in runs]
            columns = [pa.array([block] * len(runs), pa.int64()), pa.array(names.astype(np.int64)), pa.array(sizes, pa.binary()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "shard", "sizes", "words"])
            return
        place = np.empty(len(raw), np.int64)
        place[order] = np.arange(len(raw))
        del raw
        start, flat, ids = np.cumsum(many) - many, place[flat], part.column("__id")
        for lo in range(0, len(codes), 512):
            code = np.concatenate(codes[lo : lo + 512])
            ends = np.concatenate([[0], np.cumsum(many[code])])[np.cumsum(counts[lo : lo + 512])]
            places = _list_planes(np.concatenate([[0], ends[:-1]]), ends, flat[ragged(start[code], many[code])])
            k = len(places)
            columns = [pa.array([block] * k, pa.int64()), pa.array([_TEXT] * k, pa.int64()), ids.slice(lo, k), pa.array(places, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "shard", "__id", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = None, [], 0

        def whole() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            if block is None and batch.num_rows:  # blocks are numbered in their partition of the table
                block = batch.column("__part")[0].as_py() << 32
            for part in chunks(batch, "__text", BLOCK):
                more = part.column("__text").nbytes
                if held and size + more > BLOCK:
                    yield from block_of(whole(), block)
                    block, held, size = block + 1, [], 0
                held.append(part)
                size += more
        if held:
            yield from block_of(whole(), block)

    return run


class _Ids(dict):
    """Ids of the words of a shard, each encoded once."""

    def __init__(self, ranks: str):
        self.encode = merges(ranks).encode_ordinary

    def __missing__(self, raw: bytes) -> list[int]:
        ids = self[raw] = self.encode(raw.decode())
        return ids


def _encode_words(ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, None
        for batch in batches:
            counts, flat = [], []
            for shard, sizes, words in zip(batch.column("shard").to_pylist(), batch.column("sizes").to_pylist(), batch.column("words").to_pylist()):
                if shard != now:
                    now, known = shard, _Ids(ranks)
                ends = np.cumsum(_numbers(sizes)).tolist()
                data = zstandard.decompress(words)
                ids = [known[data[a:b]] for a, b in zip([0, *ends], ends)]
                counts.append(_planes(np.fromiter(map(len, ids), np.int64, len(ids))))
                flat.append(_planes(np.fromiter(chain.from_iterable(ids), np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("shard"), pa.array(counts, pa.binary()), pa.array(flat, pa.binary())], ["block", "shard", "sizes", "ids"]
            )

    return run


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte strings that end at these bytes of the data."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _laid_out(ranks: str, decode: bool):
    """Rows of a block, ids of its words before its texts, to the ids of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        size = start = flat = None
        for batch in batches:
            of, shard = batch.column("block").to_numpy(), batch.column("shard").to_numpy()
            cuts = np.flatnonzero((of[1:] != of[:-1]) | ((shard[1:] == _TEXT) != (shard[:-1] == _TEXT))) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)]):
                if lo == hi:
                    continue
                if of[lo] != block:
                    block, parts, flat = of[lo], [], None
                if shard[lo] != _TEXT:
                    parts += [(_numbers(s), _numbers(i)) for s, i in zip(batch.column("sizes")[lo:hi].to_pylist(), batch.column("ids")[lo:hi].to_pylist())]
                    continue
                if flat is None:
                    size = np.concatenate([p[0] for p in parts] or [np.empty(0, np.int64)])
                    flat = np.concatenate([p[1] for p in parts] or [np.empty(0, np.int64)]).astype("<u4")
                    start, parts = np.cumsum(size) - size, []
                ids, ends, first, n = [], [], lo, 0
                for at in range(lo, hi):
                    word = _numbers(batch.column("places")[at].as_py())
                    ids.append(flat[ragged(start[word], size[word])])
                    n += len(ids[-1])
                    ends.append(n)
                    if n > HANDED or at + 1 == hi:
                        yield out_of(batch.column("__id").slice(first, at + 1 - first), np.concatenate(ids), np.array(ends))
                        ids, ends, first, n = [], [], at + 1, 0

    def out_of(own: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        columns = [own, pa.array(np.diff(np.concatenate([[0], ends]))), _binary(ids, 4 * ends)]
        if decode:
            data, starts, sizes = token_bytes(ranks)
            at = np.concatenate([[0], np.cumsum(sizes[ids])])
            columns.append(_binary(data[ragged(starts[ids], sizes[ids])], at[ends]))
        return pa.RecordBatch.from_arrays(columns, ["__id", "n_tokens", "ids", "decoded"][: len(columns)])

    return run


def encoded(docs: DataFrame, ranks: str = RANKS, id_col: str = "doc_id", decode: bool = False) -> DataFrame:
    """``(id, n_tokens, ids)`` of every row's whole text; ``ids`` is little-endian unsigned 32-bit integers.

    With ``decode``, also ``decoded``, the bytes of the ids, joined from the token table where the ids are laid out.

    A null or empty text has no ids. Null and repeated ids are rows like any other; other columns are ignored; an
    empty table gives an empty result. ``docs`` is read twice and must give the same rows in the same order, as a stored
    table does; save what comes out of a shuffle first.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col("text").alias("__text"), F.spark_partition_id().alias("__part"))
    kind = rows.schema["__id"].dataType.simpleString()
    bits = shard_bits(SHARDS * partitions)
    words = rows.mapInArrow(_cut(bits, "words"), "block long, shard long, sizes binary, words binary")
    words = words.repartition(partitions, "shard").sortWithinPartitions("shard")
    ids = words.mapInArrow(_encode_words(ranks), "block long, shard long, sizes binary, ids binary")
    texts = rows.mapInArrow(_cut(bits, "texts"), f"block long, shard long, __id {kind}, places binary")
    every = ids.unionByName(texts, allowMissingColumns=True)
    every = every.repartition(partitions, "block").sortWithinPartitions("block", "shard")
    out = every.mapInArrow(_laid_out(ranks, decode), f"__id {kind}, n_tokens long, ids binary" + ", decoded binary" * decode)
    return out.withColumnRenamed("__id", id_col)


def _decode(ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, sizes = token_bytes(ranks)
        for batch in batches:
            for part in chunks(batch, "ids"):
                out = []
                for raw in part.column("ids"):
                    ids = np.frombuffer(raw.as_buffer(), "<u4") if raw.is_valid else np.empty(0, "<u4")
                    out.append(data[ragged(starts[ids], sizes[ids])].tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return run


def decoded(rows: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Adds ``decoded``, the bytes of ``ids``; null ids have none."""
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(_decode(ranks), f"{fields}, decoded binary")
