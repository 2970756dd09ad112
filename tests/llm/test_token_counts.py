import random

from tendon.llm import token_counts as tc
from tendon.llm.bpe import _CUT, RANKS, encoding


def test_edits_count_like_encoding_anew(prose):
    count, whole = tc.Counter(RANKS), encoding(RANKS)
    rng = random.Random(2)
    alphabet = "ab 'Z9\n\t .,é日👍 rest"
    for case in range(400):
        text = prose(rng.choice([0, 1, 30, 400, 3000]), case) if case % 2 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400)))
        tree = tc.Tree.of(*tc.leaves_of(_CUT.findall(text), count))
        for _ in range(rng.randint(1, 12)):
            start = rng.randint(0, len(text))
            stop = start + rng.choice([0, 0, 1, 2, 5, 30, 500])
            insert = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 10, 200])))
            text, tree, encoded = tc.edit(text, tree, start, stop, insert, count)
            assert tree.tokens[1] == len(whole.encode_ordinary(text)), (case, text, start, stop, insert)
            assert tree.chars[1] == len(text)
            assert all(tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1] for i in range(1, tree.width))
            ends = set()
            at = 0
            for w in _CUT.findall(text):
                at += len(w)
                ends.add(at)
            at = 0
            for n in tree.leaves()[0]:
                at += n
                assert at in ends


def test_small_edits_encode_little(prose):
    count = tc.Counter(RANKS)
    text = prose(20_000, 1)
    tree = tc.Tree.of(*tc.leaves_of(_CUT.findall(text), count))
    _, _, encoded = tc.edit(text, tree, 50_000, 50_003, "xyz abc", count)
    assert 0 < encoded < 2_000


def test_over_tables(spark, docs_of, prose):
    texts = [None, "", "one", prose(300, 1), prose(300, 1), " " * 500, "x" * 3000]
    docs = docs_of(texts)
    state = tc.trees(docs)
    whole = encoding(RANKS)
    assert {r["doc_id"]: r["tokens"][1] for r in state.collect()} == {i: len(whole.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    log = spark.createDataFrame([(3, 2, 0, 4, None), (3, 1, 10, 12, " new words "), (6, 1, 1500, None, " ")], "doc_id long, seq int, start int, stop int, insert string")
    got = {r["doc_id"]: r for r in tc.edited(tc.with_edits(state, log)).collect()}
    want = texts[3][:10] + " new words " + texts[3][12:]
    assert got[3]["text"] == want[4:] and got[3]["tokens"][1] == len(whole.encode_ordinary(want[4:]))
    assert got[6]["tokens"][1] == len(whole.encode_ordinary(got[6]["text"])) and len(got[6]["text"]) == 3001
    assert got[4]["encoded"] == 0 and got[0]["tokens"][1] == 0
    assert tc.edited(tc.derived_edits(tc.trees(docs_of([])))).collect() == []
    for r in tc.edited(tc.derived_edits(state)).collect():
        assert r["tokens"][1] == len(whole.encode_ordinary(r["text"]))
