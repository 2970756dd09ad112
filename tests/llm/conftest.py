import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, n long, root string"


def rows_of(texts, ids=None, sources=None):
    ids = range(len(texts)) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    return [(i, t, "en", s, None if t is None else len(t), "clash", 7, None) for i, t, s in zip(ids, texts, sources)]


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents with extra columns whose names clash with internal ones."""

    def make(texts, ids=None, sources=None):
        return spark.createDataFrame(rows_of(texts, ids, sources), SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(5)
    words = ["the", "of", "and", "Rain", "stone", "über", "été", "a", "river", "l'eau", "don't", "x1", "2024", "—", "end."]
    words += ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 9))) for _ in range(300)]

    def make(n_words, seed):
        r = random.Random(seed)
        picked = [words[min(int(r.expovariate(0.02)), len(words) - 1)] for _ in range(n_words)]
        return "".join(w + ("\n" if r.random() < 0.05 else " ") for w in picked).strip()

    return make
