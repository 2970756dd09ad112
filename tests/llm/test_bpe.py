import random

import public_tokenizers
import pyarrow as pa
import regex

from tendon.llm import bpe

ODD = ["", None, " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "a\n\nb c", "don't we'll 'S x's 's", " x y", "\x1c a\x1fb \x85 c", "日本語 テキスト", "👍🏽 ok", "1234 ½ Ⅷ", "éa", "tab\tsep \t x", "a" * 5000, " " * 3000 + "z", "!!! ??? ...\r\n\r\n x"]


def test_ids_equal_the_library_and_decode_to_the_text(spark, docs_of, prose):
    rng = random.Random(3)
    alphabet = "ab Z9'\n\t .,é日👍  \x1d_-s"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [prose(n, n) for n in (1, 10, 500, 20_000)] + [prose(10, 10)] * 3
    docs = docs_of(texts)
    want = bpe.encoding(bpe.RANKS)
    got = {r["doc_id"]: r for r in bpe.decoded(bpe.encoded(docs)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = want.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids), (i, text)
        assert bytes(got[i]["ids"]) == b"".join(x.to_bytes(4, "little") for x in ids), (i, text)
        assert bytes(got[i]["decoded"]) == (text or "").encode()
    at_once = {r["doc_id"]: r for r in bpe.encoded(docs, decode=True).collect()}
    assert at_once == got


def merged(word, ranks):
    """The plain merge loop: of all neighbours, the pair with the lowest rank becomes one, the leftmost of equal ones first."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_ids_equal_plain_merges(spark, docs_of, prose):
    ranks = bpe._ranks(bpe.RANKS)
    texts = [t for t in ODD if not t or len(t) < 1000] + [prose(n, n) for n in (1, 30, 300)] + ["zqx" * 40]
    got = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encoded(docs_of(texts)).collect()}
    for i, text in enumerate(texts):
        want = [x for w in regex.findall(public_tokenizers.PATTERN, text or "") for x in merged(w.encode(), ranks)]
        assert got[i] == b"".join(x.to_bytes(4, "little") for x in want), text


def test_blocks_of_any_size_and_hashes_that_words_share(spark, docs_of, prose, monkeypatch):
    texts = ODD + [prose(40, i) for i in range(60)] + [prose(3_000, 1)] + [None] * 5
    want = {r["doc_id"]: r for r in bpe.encoded(docs_of(texts), decode=True).collect()}
    for name, value in (("BLOCK", 1), ("BLOCK", 3_000), ("HANDED", 5), ("SHARDS", 64)):
        with monkeypatch.context() as m:
            m.setattr(bpe, name, value)
            assert {r["doc_id"]: r for r in bpe.encoded(docs_of(texts), decode=True).collect()} == want, name
    monkeypatch.setattr(bpe.xxhash, "xxh64_intdigest", lambda w: 7)  # all words in one shard, by one hash
    table = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string()), pa.array([3] * len(texts))], ["__id", "__text", "__part"])
    words, places = (list(bpe._cut(4, give)(iter([table]))) for give in ("words", "texts"))
    ids = list(bpe._encode_words(bpe.RANKS)(iter(words)))
    nothing = lambda b, kind: pa.nulls(len(b), kind)
    rows = [(*b.columns, nothing(b, pa.int64()), nothing(b, pa.binary())) for b in ids]
    rows += [(b.column(0), b.column(1), nothing(b, pa.binary()), nothing(b, pa.binary()), b.column(2), b.column(3)) for b in places]
    every = [pa.RecordBatch.from_arrays(list(r), ["block", "shard", "sizes", "ids", "__id", "places"]) for r in rows]
    got = {r["__id"]: r["ids"] for b in bpe._laid_out(bpe.RANKS, False)(iter(every)) for r in b.to_pylist()}
    assert got == {i: bytes(r["ids"]) for i, r in want.items()}


def test_empty_and_repeated(spark, docs_of):
    assert bpe.encoded(docs_of([])).collect() == []
    rows = bpe.encoded(docs_of(["x y", "x y", None], [None, 3, 3])).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 2, 2]
