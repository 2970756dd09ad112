"""SimHash near-deduplication by the generalised pigeonhole principle.

A fingerprint has a bit set where over half the shingle hashes have it. Fingerprints within ``RADIUS`` bits are
linked. Search works on distinct fingerprints:

1. bits that occur together are put into the same partition (greedy, on the matrix of pair counts over all
   fingerprints), so that partitions differ in how well they separate;
2. the number of fingerprints per value of each partition is counted exactly, and from it the number within each
   radius of every value;
3. each fingerprint allots thresholds to the partitions by dynamic programming, to meet the fewest candidates. If the
   thresholds (-1: skip the partition) add up to RADIUS - partitions + 1, no link can escape all of them;
4. fingerprints meet in the buckets they probe. A bucket yields a spanning forest of its links and not the pairs, and
   large buckets are dealt out as pairs of blocks;
5. links are joined to components.

With a ``similarity``, links only say which texts are compared. Fingerprints within the radius propose texts as above;
texts that are similar enough but lie further apart are proposed by bands of minima (``bands``), which are plain join
keys: a band that several texts share links them to the first of them. Proposed texts are grouped, and inside a group
texts are linked where the Jaccard similarity of their sets of shingles is at least that (``similar``). Two texts of
similarity J share no band with a chance of (1 - J ** ROWS) ** BANDS: 0.0007 at 0.8, 0.00001 at 0.85. Texts are told
apart by 128 bits of MD5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendon.llm.components import rooted
from tendon.llm.shared import BROADCAST_ROWS, looked_up, saved, text_of

SHINGLE = 3
RADIUS = 3
PARTS = 4
WIDTH = 64 // PARTS
#: Fingerprints of one bucket that meet at a time.
BLOCK = 4_096
#: Sets of shingles that meet at a time, by number and by the hashes in them.
SETS, SET_HASHES = 1_024, 2_000_000
#: Bands of so many minima each; texts that agree in a band are compared.
BANDS, ROWS = 24, 6
_LONG = 65_536


def digests(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; a text of fewer words is one shingle."""
    words = text.lower().split()
    flat = b" ".join(words)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if n < 1:
        return np.array([digest(flat, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:n].tolist()
    return np.fromiter((digest(flat[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _LONG):
        bits = np.unpackbits(hashes[i : i + _LONG].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text in UTF-8; 0 without words."""
    return majority(digests(text, shingle)) if text.strip() else 0


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(digests(text, shingle))


_FACTORS = np.array([xxhash.xxh32_intdigest(str(i), 1) | 1 for i in range(BANDS * ROWS)], np.uint32)[:, None]


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS numbers, each made of the least of the hashes under ROWS permutations of their upper halves."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.min([(high[i : i + 4_096] * _FACTORS).min(axis=1) for i in range(0, len(high), 4_096)], axis=0)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("__text").cast(pa.large_binary())
        found = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
        rest = [c for c in batch.schema.names if c != "__text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(found.view(np.int64))], [*rest, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, fp)`` of every row's whole text; a null text counts as empty."""
    kept = docs.select(F.col(id_col), F.col("text").alias("__text"))
    return kept.mapInArrow(_prints, f"`{id_col}` {dict(kept.dtypes)[id_col]}, fp long")


def text_key():
    """128 bits that tell texts apart; a null text counts as empty."""
    return F.unhex(F.md5(text_of().cast("binary")))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, hash, fp, size, bands)`` of every row's whole text: its key, its fingerprint, the number of its distinct
    shingles and their bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, found = [], [], []
            for t in batch.column("__text").cast(pa.large_binary()):
                text = t.as_py() or b""
                every = digests(text, shingle)
                fps.append(majority(every) if text.strip() else 0)
                every = np.unique(every)
                sizes.append(len(every))
                found.append(bands(every))
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), flat)
            kept = [batch.column("doc_id"), batch.column("hash"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(kept, ["doc_id", "hash", "fp", "size", "bands"])

    kept = docs.select("doc_id", text_key().alias("hash"), F.col("text").alias("__text"))
    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, hash binary, fp long, size long, bands array<long>")


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((64, 64)), 0
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for i in range(0, len(fps), _LONG):
            bits = np.unpackbits(fps[i : i + _LONG].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
    i, j = np.divmod(np.arange(4096), 64)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel().astype(np.int64)), pa.array(np.full(4096, n))], ["i", "j", "both", "n"])


def bit_groups(distinct: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of equal width, correlated bits together.

    Counts come from all fingerprints; what reaches the driver is one 64 by 64 matrix.
    """
    rows = distinct.select("fp").mapInArrow(_pair_counts, "i long, j long, both long, n long")
    rows = rows.groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect()
    both, n = np.zeros((64, 64)), 0
    for r in rows:
        both[r["i"], r["j"]], n = r["both"], r["n"]
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    like = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(like, 0)
    free, groups, width = set(range(64)), [], 64 // parts
    for _ in range(parts):
        left = sorted(free)
        group = [max(left, key=lambda b: (like[b, left].sum(), -b))]
        free.discard(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: (like[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def part_values(fps: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """Values of each partition, one row per fingerprint."""
    one = np.uint64(1)
    out = np.zeros((len(fps), len(groups)), np.int64)
    for g, bits in enumerate(groups):
        for k, b in enumerate(bits):
            out[:, g] |= (((fps >> np.uint64(b)) & one) << np.uint64(k)).astype(np.int64)
    return out


def _values(groups: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = part_values(batch.column(0).to_numpy().view(np.uint64), groups)
            part = np.tile(np.arange(len(groups)), len(at))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(at.ravel())], ["part", "value"])

    return run


def ball_counts(counts: np.ndarray, radius: int) -> np.ndarray:
    """``out[g, r, v]``: how many fingerprints have, in partition g, a value within r bits of v."""
    parts, size = counts.shape
    width = size.bit_length() - 1
    out = np.zeros((parts, radius + 1, size))
    at = np.arange(size)
    for g in range(parts):
        # shells[r]: values at exactly r bits; built up one bit at a time
        shells = [counts[g].astype(float)] + [np.zeros(size) for _ in range(radius)]
        for b in range(width):
            shells = [shells[r] + (shells[r - 1][at ^ (1 << b)] if r else 0) for r in range(radius + 1)]
        out[g] = np.cumsum(shells, axis=0)
    return out


def _masks(width: int, radius: int) -> list[np.ndarray]:
    """Differences of exactly r bits, for r up to ``radius``."""
    every = np.arange(1 << width)
    ones = np.bitwise_count(every)
    return [every[ones == r] for r in range(radius + 1)]


def allot(values: np.ndarray, balls: np.ndarray, radius: int) -> np.ndarray:
    """Thresholds (-1: skipped) of each fingerprint's partitions, adding up to radius - partitions + 1.

    The cost of a threshold is the number of candidates plus that of probes.
    """
    n, parts = values.shape
    width = balls.shape[2].bit_length() - 1
    probes = np.cumsum([len(m) for m in _masks(width, radius)])
    best = np.full((radius + 2, n), np.inf)  # by the sum of thresholds + 1 so far
    best[0] = 0
    picks = []
    for g in range(parts):
        new, pick = np.full_like(best, np.inf), np.zeros((radius + 2, n), np.int8)
        for t in range(-1, radius + 1):
            cost = 0 if t < 0 else balls[g, t, values[:, g]] + probes[t]
            for s in range(radius + 2):
                if s - t - 1 >= 0:
                    total = best[s - t - 1] + cost
                    better = total < new[s]
                    new[s] = np.where(better, total, new[s])
                    pick[s] = np.where(better, t, pick[s])
        best = new
        picks.append(pick)
    out, left = np.zeros((n, parts), np.int64), np.full(n, radius + 1)  # thresholds + 1 add up to radius + 1
    for g in reversed(range(parts)):
        out[:, g] = picks[g][left, np.arange(n)]
        left = left - out[:, g] - 1
    return out


def _signatures(groups: list[list[int]], shared, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = shared.value
        width = balls.shape[2].bit_length() - 1
        masks = _masks(width, radius)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                values = part_values(fps, groups)
                taus = allot(values, balls, radius)
                keys, whose, probing = [], [], []
                for g in range(len(groups)):
                    keys.append(values[:, g] | (g << width))
                    whose.append(fps)
                    probing.append(taus[:, g] >= 0)
                    for r in range(1, radius + 1):
                        hit = np.flatnonzero(taus[:, g] >= r)
                        if len(hit):
                            near = values[hit, g][:, None] ^ masks[r]
                            full = balls[g, 0][near] > 0
                            keys.append(near[full] | (g << width))
                            whose.append(np.broadcast_to(fps[hit][:, None], near.shape)[full])
                            probing.append(np.ones(int(full.sum()), bool))
                key, fp, probe = np.concatenate(keys), np.concatenate(whose), np.concatenate(probing)
                size = balls[key >> width, 0, key & ((1 << width) - 1)]
                some = size > 1
                some |= probe & (size > 0)
                key, fp, probe, size = key[some], fp[some], probe[some], size[some]
                blocks = np.maximum(1, np.ceil(size / BLOCK)).astype(np.int64)
                mine = ((fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks
                rep = np.repeat(np.arange(len(key)), blocks)
                other = np.arange(len(rep)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                own = mine[rep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[rep]), pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other)), pa.array(fp[rep].view(np.int64)), pa.array(probe[rep])],
                    ["key", "low", "high", "fp", "probe"],
                )

    return run


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the fingerprints that are linked within ``radius`` bits."""
    left, a, b = fps, [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(front[:256, None] ^ left[None, :]) <= radius
            hit = near.any(axis=0)
            a.append(front[:256][near[:, hit].argmax(axis=0)])
            b.append(left[hit])
            front = np.concatenate([front[256:], left[hit]])
            left = left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _links(radius: int):
    def of(key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(fp)]):
            if hi - lo > 1 and probe[lo:hi].any():
                one = np.unique(fp[lo:hi])
                if len(one) == 2:
                    if int(one[0] ^ one[1]).bit_count() <= radius:
                        out.append((one[:1], one[1:]))
                elif len(one) > 2:
                    a, b = forest(one, radius)
                    if len(a):
                        out.append((a, b))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        last = None

        def flush(final: bool) -> pa.RecordBatch | None:
            nonlocal held
            if not held:
                return None
            key, fp, probe = (np.concatenate([h[i] for h in held]) for i in range(3))
            cut = len(fp)
            if not final:  # the last bucket may go on in the next batch
                cut = len(fp) - int(np.argmax(np.any(key[::-1] != key[-1], axis=1))) if np.any(key != key[-1]) else 0
            held = [(key[cut:], fp[cut:], probe[cut:])] if cut < len(fp) else []
            edges = of(key[:cut], fp[:cut], probe[:cut]) if cut else []
            if not edges:
                return None
            a, b = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
                held.append((key, batch.column(3).to_numpy().view(np.uint64), batch.column(4).to_numpy(zero_copy_only=False)))
                if (last := flush(False)) is not None:
                    yield last
        if (last := flush(True)) is not None:
            yield last

    return run


def links(distinct: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``(fp)`` that connect whatever is linked within ``radius``."""
    spark = distinct.sparkSession
    groups = bit_groups(distinct, parts)
    width = 64 // parts
    counted = distinct.select("fp").mapInArrow(_values(groups), "part long, value long").groupBy("part", "value").count()
    counts = np.zeros((parts, 1 << width), np.int64)
    found = counted.toPandas()  # parts * 2 ** width rows at most
    counts[found["part"].to_numpy(np.int64), found["value"].to_numpy(np.int64)] = found["count"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(ball_counts(counts, radius))
    rows = distinct.select("fp").mapInArrow(_signatures(groups, shared, radius), "key long, low long, high long, fp long, probe boolean")
    rows = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return rows.mapInArrow(_links(radius), "a long, b long")


def proposed(prints: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: links between the keys of texts ``(hash, fp, bands)`` that connect all that have equal fingerprints, are
    linked through fingerprints within ``radius``, or share a band."""
    rows = prints.count()
    per_fp = saved(prints.groupBy("fp").agg(F.min("hash").alias("first"), F.max("hash").alias("last"), F.count(F.lit(1)).alias("n")), "simhash-fps")
    equal = saved(per_fp.where("first <> last").select("fp", "first", "n"), "simhash-equal")
    equal = looked_up(prints.select("fp", F.col("hash").alias("a")), equal, ["fp"], "n", rows).where("a <> first").select("a", F.col("first").alias("b"))
    near = saved(links(per_fp, radius), "simhash-links")
    for end in ("a", "b"):
        near = near.join(per_fp.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}")), end)
    near = near.select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    banded = prints.select(F.col("hash").alias("a"), F.explode("bands").alias("band"))
    per_band = banded.groupBy("band").agg(F.min("a").alias("b"), F.max("a").alias("last"), F.count(F.lit(1)).alias("n"))
    per_band = saved(per_band.where("b <> last").select("band", "b", "n"), "simhash-bands")
    alike = looked_up(banded, per_band, ["band"], "n", BANDS * rows).where("a <> b").select("a", "b")
    return equal.unionByName(near).unionByName(alike)


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").cast(pa.large_binary())
            found = [shingles(t.as_py() or b"", shingle).tobytes() for t in texts]
            rest = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(found, pa.binary())], [*rest, "set"])

    return run


def set_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the sets whose Jaccard similarity is at least ``similarity``."""
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(words), np.int64)
    left, out = np.arange(len(sets)), []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            # sets of other sizes can't be similar enough
            fits = left[(sizes[left] >= similarity * sizes[x] - 1e-9) & (similarity * sizes[left] <= sizes[x] + 1e-9)]
            if not len(fits):
                continue
            mine = flat[starts[x] : starts[x] + sizes[x]]
            mark[mine] = 1
            n = sizes[fits]
            cut = np.cumsum(n) - n
            both = np.add.reduceat(mark[flat[np.repeat(starts[fits] - cut, n) + np.arange(n.sum())]], cut)
            mark[mine] = 0
            hit = fits[both >= similarity * (sizes[x] + n - both) - 1e-9]
            out += [(x, int(y)) for y in hit]
            front += hit.tolist()
            left = np.setdiff1d(left, hit, assume_unique=True)
    return out


def similar(docs: DataFrame, prints: DataFrame, radius: int, shingle: int, similarity: float) -> DataFrame:
    """``(a, b)``: links between the keys of distinct texts that connect those of at least the wanted similarity, as far
    as ``proposed`` links, or chains of them, lead from one to the other.

    Groups of proposed texts are dealt as pairs of blocks, which are bounded by the number of texts and by the hashes
    in their sets; a set is sent once for each block of its group.
    """
    loose = saved(rooted(proposed(prints, radius)), "simhash-loose")
    ends = loose.select(F.col("root").alias("hash")).distinct().withColumn("root", F.col("hash"))
    in_group = loose.select(F.col("node").alias("hash"), "root").unionByName(ends)
    sized = prints.select("hash", "size").join(_slim(in_group.select("hash")), "hash", "left_semi").dropDuplicates(["hash"])
    in_group = saved(in_group.join(sized, "hash"), "simhash-grouped")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / SETS), F.ceil(F.sum("size") / SET_HASHES)).cast("long")
    wanted = in_group.join(saved(in_group.groupBy("root").agg(blocks.alias("blocks")), "simhash-blocks"), "root")
    wanted = saved(wanted.select("hash", "root", "blocks"), "simhash-wanted")
    rows = docs.select(text_key().alias("hash"), F.col("text").alias("__text")).join(_slim(wanted), "hash")
    sets = rows.mapInArrow(_sets(shingle), "hash binary, root binary, blocks long, set binary").groupBy("hash", "root", "blocks").agg(F.first("set").alias("set"))
    own = F.pmod(F.xxhash64("hash"), F.col("blocks"))
    dealt = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "hash", "set")

    def forest_of(table: pa.Table) -> pa.Table:
        edges = set_forest([np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()], similarity)
        a, b = (table.column("hash").take(pa.array([e[k] for e in edges], pa.int64())) for k in range(2))
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("root", "low", "high").applyInArrow(forest_of, "a binary, b binary")


def components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per input row; the component's id is the smallest id reachable.

    Texts are linked within ``radius`` bits; with ``similarity``, where their sets of shingles have that Jaccard
    similarity, and the radius only bounds the search. Texts are read whole. Texts without words, null ones included,
    have fingerprint 0 and are linked like others. A null id never becomes a component's id unless the component has
    no other; repeated ids and texts are rows like any other. An empty table gives an empty result; other columns are
    ignored.
    """
    if similarity is None and shingle != SHINGLE:
        raise ValueError("another width of shingles needs a similarity")
    prints = saved(fingerprints(docs) if similarity is None else sketches(docs, shingle), "simhash-prints")
    key = "fp" if similarity is None else "hash"
    distinct = saved(prints.groupBy(key).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    found = links(distinct, radius) if similarity is None else similar(docs, prints, radius, shingle, similarity)
    roots = saved(rooted(found), "simhash-roots")
    ends = roots.select(F.col("root").alias(key)).distinct().withColumn("root", F.col(key))
    member = roots.select(F.col("node").alias(key), "root").unionByName(ends.select(key, "root"))
    named = distinct.join(member, key, "left").withColumn("root", F.coalesce("root", key))
    named = saved(named, "simhash-named")
    per = saved(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size")), "simhash-components")
    table = looked_up(named, per, ["root"], "size", distinct.count()).where("n > 1 or size > 1").select(key, "n", "component_id", "first")
    table = saved(table, "simhash-table")
    found = looked_up(prints, table, [key], "n", prints.count())
    mine = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "fp", mine.alias("component_id"))


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """``docs`` with one document of each component, the one with its id; all columns kept.

    Of several rows with that id, the first by its contents stays; rows without an id stay as they are.
    """
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row")
    found = components(docs, radius, shingle, similarity)
    dropped = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__id")).distinct()
    again = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    dropped, again = _slim(saved(dropped, "simhash-dropped")), _slim(saved(again.select("__id"), "simhash-again"))
    rows = docs.select(row, F.col("doc_id").alias("__id")).join(dropped, "__id", "left_anti")
    order = Window.partitionBy("__id").orderBy(F.to_json("__row"))
    first = rows.join(again, "__id", "left_semi").withColumn("__first", F.row_number().over(order)).where("__first = 1")
    kept = rows.join(again, "__id", "left_anti").select("__row").unionByName(first.select("__row"))
    return kept.select(*(F.col("__row").getField(c).alias(c) for c in names))


def _slim(ids: DataFrame) -> DataFrame:
    """Ids to look rows up by: broadcast after they were counted and are few, else joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
