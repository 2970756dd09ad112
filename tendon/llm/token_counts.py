"""Token counts that survive edits: a segment tree over the pre-tokens of each document.

Leaves are runs of about ``LEAF`` pre-tokens with their numbers of characters and tokens; inner nodes have the sums.
An edit re-encodes pre-tokens from the first leaf whose matches could have looked at the edited place, until a match
ends where an old leaf after the edit ended: from there on everything matches as before. If the new pre-tokens fit
into as many leaves as they replace, only sums on the way to the root change; otherwise the sums are laid out anew,
without encoding anything else.

A match of the pattern looks at most at one character after the first that it doesn't take, so leaves that end two or
more characters before an edit stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendon.llm.bpe import _CUT, RANKS, encoding
from tendon.llm.shared import text_of

LEAF = 32
LOOK = 2
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 300_000

STATE = "text string, chars array<int>, tokens array<int>"
EDITS = "array<struct<start: int, stop: int, insert: string>>"


class Counter:
    """Tokens of pre-tokens, remembered."""

    def __init__(self, ranks: str):
        self.piece, self.known = encoding(ranks)._encode_single_piece, {}

    def __call__(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            n = self.known[word] = len(self.piece(word.encode()))
        return n


class Tree:
    """Sums over leaves in heap order: node i has the children 2 i and 2 i + 1; leaf k is node ``width + k``."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = chars, tokens
        self.width = len(chars) // 2

    @classmethod
    def of(cls, chars: np.ndarray, tokens: np.ndarray) -> Tree:
        width = 1 << max(0, (max(len(chars), 1) - 1).bit_length())
        levels = []
        for leaves in (chars, tokens):
            nodes = np.zeros(2 * width, np.int64)
            nodes[width : width + len(leaves)] = leaves
            lo = width
            while lo > 1:
                nodes[lo // 2 : lo] = nodes[lo : 2 * lo : 2] + nodes[lo + 1 : 2 * lo : 2]
                lo //= 2
            levels.append(nodes.tolist())
        return cls(*levels)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The first leaf that ends after ``place``, and where it begins; the number of leaves if there is none."""
        if place >= self.chars[1]:
            return self.width, self.chars[1]
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if before + self.chars[node] <= place:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def set_leaf(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.width + leaf
        by_chars, by_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += by_chars
            self.tokens[node] += by_tokens
            node //= 2

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        chars = np.array(self.chars[self.width :], np.int64)
        some = chars > 0
        return chars[some], np.array(self.tokens[self.width :], np.int64)[some]


def leaves_of(words: list[str], count: Counter, size: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of runs of ``size`` pre-tokens."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.arange(0, len(words), size)
    chars = np.fromiter(map(len, words), np.int64, len(words))
    tokens = np.fromiter(map(count, words), np.int64, len(words))
    return np.add.reduceat(chars, at), np.add.reduceat(tokens, at)


def edit(text: str, tree: Tree, start: int, stop: int, insert: str, count: Counter) -> tuple[str, Tree, int]:
    """The text and the tree after ``text[start:stop]`` gave way to ``insert``, and how many characters were encoded."""
    start = min(max(start, 0), len(text))
    stop = min(max(stop, start), len(text))
    new = text[:start] + insert + text[stop:]
    shift = len(new) - len(text)
    first, at = tree.leaf_at(max(start - LOOK, 0))
    if first == tree.width and tree.chars[1]:  # the end of the text: look again from its last leaf
        first, at = tree.leaf_at(tree.chars[1] - 1)
    last, end = tree.leaf_at(max(stop - 1, at))  # leaves from first on, up to where an old leaf ends at or after stop
    end += tree.chars[tree.width + last] if last < tree.width else 0
    words, now = [], at
    if new:
        for m in _CUT.finditer(new, at):
            while end + shift < now and last + 1 < tree.width:
                last += 1
                end += tree.chars[tree.width + last]
            if now == end + shift and end >= stop and now > at:
                break
            words.append(m[0])
            now = m.end()
        else:
            last = tree.width - 1
    encoded = now - at
    replaced = min(last, tree.width - 1) - min(first, tree.width) + 1
    if words and 0 < replaced and len(words) <= 2 * LEAF * replaced and len(words) >= replaced and first < tree.width:
        size = -(-len(words) // replaced)
        chars, tokens = leaves_of(words, count, size)
        for k in range(replaced):
            tree.set_leaf(first + k, int(chars[k]) if k < len(chars) else 0, int(tokens[k]) if k < len(chars) else 0)
        return new, tree, encoded
    chars, tokens = leaves_of(words, count)
    w = tree.width
    old_c, old_t = np.array(tree.chars[w:], np.int64), np.array(tree.tokens[w:], np.int64)
    chars = np.concatenate([old_c[:first], chars, old_c[last + 1 :]])
    tokens = np.concatenate([old_t[:first], tokens, old_t[last + 1 :]])
    some = chars > 0
    return new, Tree.of(chars[some], tokens[some]), encoded


def _ints(rows: list[list[int]]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int32()))


def _built(ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(ranks)
        for batch in batches:
            chars, tokens = [], []
            for text in batch.column("text").to_pylist():
                tree = Tree.of(*leaves_of(_CUT.findall(text), count))
                chars.append(tree.chars)
                tokens.append(tree.tokens)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), batch.column("text"), _ints(chars), _ints(tokens)], [*rest, "text", "chars", "tokens"])

    return run


def trees(docs: DataFrame, ranks: str = RANKS, id_col: str = "doc_id") -> DataFrame:
    """``(id, text, chars, tokens)``: the segment tree of every document; ``tokens[1]`` is its number of tokens.

    A null text counts as empty. Null and repeated ids are rows like any other; other columns are ignored; an empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col), text_of().alias("text"))
    return rows.mapInArrow(_built(ranks), f"`{id_col}` {dict(rows.dtypes)[id_col]}, {STATE}")


def _applied(ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(ranks)
        for batch in batches:
            texts, chars, tokens, encoded = [], [], [], []
            for text, c, t, edits in zip(*(batch.column(x).to_pylist() for x in ("text", "chars", "tokens", "edits"))):
                tree, total = Tree(c, t), 0
                for e in edits or []:
                    text, tree, n = edit(text, tree, e["start"] or 0, e["stop"] or 0, e["insert"] or "", count)
                    total += n
                texts.append(text)
                chars.append(tree.chars)
                tokens.append(tree.tokens)
                encoded.append(total)
            rest = [c for c in batch.schema.names if c not in ("text", "chars", "tokens", "edits")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(texts, pa.string()), _ints(chars), _ints(tokens), pa.array(encoded, pa.int64())],
                [*rest, "text", "chars", "tokens", "encoded"],
            )

    return run


def edited(state: DataFrame, ranks: str = RANKS, id_col: str = "doc_id") -> DataFrame:
    """The state after the edits in its column ``edits`` (an array of start, stop, insert, in order).

    Each edit is in characters of the text as the edits before left it; places outside the text are moved to its
    ends, nulls count as 0 and as nothing to insert. ``encoded`` is the number of characters that were encoded.
    """
    rows = state.select(id_col, "text", "chars", "tokens", "edits")
    return rows.mapInArrow(_applied(ranks), f"`{id_col}` {dict(rows.dtypes)[id_col]}, {STATE}, encoded long")


def with_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """Joins a log of edits ``(doc_id, seq, start, stop, insert)`` to the state; edits of a document go by ``seq``."""
    own = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "insert"))).alias("edits"))
    own = own.withColumn("edits", F.expr("transform(edits, e -> named_struct('start', int(e.start), 'stop', int(e.stop), 'insert', e.insert))"))
    return state.drop("edits").join(own, "doc_id", "left")


def derived_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with one to four ``edits`` each, drawn by hashes of the id from the text: cuts, moves and repeats."""
    n = "length(coalesce(text, ''))"
    h = "xxhash64(doc_id, k, {})"
    start = f"int(pmod({h.format(1)}, {n} + 1))"
    cut = f"int(pmod({h.format(2)}, 40))"
    insert = f"substr(coalesce(text, ''), 1 + int(pmod({h.format(3)}, {n} + 1)), int(pmod({h.format(4)}, 60)))"
    each = f"transform(sequence(1, 1 + int(pmod(xxhash64(doc_id), 4))), k -> named_struct('start', {start}, 'stop', {start} + {cut}, 'insert', {insert}))"
    return docs.withColumn("edits", F.expr(each))
