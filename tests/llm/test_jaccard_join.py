"""The n-gram Jaccard join against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from conftest import words

from plotcheck.llm import jaccard_join


def brute(rows, n=5, percent=80):
    """(doc_id, set size, smallest id reachable) of each row."""

    def grams(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()

    sets = [(r[0], grams(r[1])) for r in rows]
    known = {s for i, s in sets if i is not None and s}
    known = sorted(known, key=len)
    parent = {s: s for s in known}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for a, x in enumerate(known):
        for y in known[a + 1 :]:
            if 100 * len(x) < percent * len(y):
                break
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                parent[find(x)] = find(y)
    low = {}
    for i, s in sets:
        if i is not None and s:
            low[find(s)] = min(i, low.get(find(s), i))
    return Counter((i, len(s), i if i is None or not s else low[find(s)]) for i, s in sets)


@pytest.fixture(scope="module")
def more(spark, docs, rows):
    """Texts of all sizes, with copies near the limit on both sides, shared passages and one-word changes of short texts."""
    rng = random.Random(12)
    passage = words(rng, 60)
    out = []
    for i in range(220):
        n = rng.choice([1, 2, 4, 6, 8, 9, 10, 12, 14, 18, 25, 40, 70, 150, 400])
        w = words(rng, n, rng.choice([3, 4000])).split()
        for k in range(rng.randrange(1, 5)):
            v = list(w)
            for _ in range(rng.randrange(0, 2 + n // 40)):
                at = rng.randrange(len(v))
                v[at : at + rng.randrange(2)] = [f"new{rng.randrange(9)}"] * rng.randrange(3)
            if rng.random() < 0.2 * (n > 100):
                v += passage.split()
            out.append((1000 + 10 * i + k, " ".join(v), "en", "s0", 1))
    every = rows + out
    return every, spark.createDataFrame([(*r, "a", "b", 7, "c", 8, 9) for r in every], docs.schema)


@pytest.mark.parametrize(("shingle", "percent"), [(5, 80), (1, 80), (5, 60), (3, 95)])
def test_equals_all_pairs(more, shingle, percent):
    rows, df = more
    got = jaccard_join.similar_sets(df, shingle, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == brute(rows, shingle, percent)


def test_empty(no_docs):
    assert jaccard_join.similar_sets(no_docs).count() == 0


@pytest.mark.parametrize("percent", [80, 60, 95])
def test_bands(percent):
    """Every size lies in one band; what can link lies at most one band apart; the segments suffice."""
    bands = jaccard_join.Bands(percent, 5000)
    size = np.arange(1, 5001)
    of = bands.of(size)
    assert (np.diff(of) >= 0).all() and (of[-(-percent * size // 100) - 1] >= of - 1).all()
    need = jaccard_join.allowed(size, size, percent) + 1
    m, d = np.array(bands.m)[of], np.array(bands.d)[of]
    assert (m + d >= need).all()


def test_narrow_sets_link(spark, docs, monkeypatch):
    """Where sets leave many segments empty, empty segments are asked for, in all shards."""
    monkeypatch.setattr(jaccard_join.Bands, "of", lambda self, sizes: np.searchsorted(self.upper, sizes))
    rng = random.Random(9)
    rows = []
    for i in range(300):
        w = [f"a{rng.randrange(99999)}" for _ in range(rng.randrange(9, 16))]
        rows += [(10 * i, " ".join(w), "en", "s0", 1), (10 * i + 1, " ".join([*w[:-1], "other"]), "en", "s0", 1)]
    df = spark.createDataFrame([(*r, "a", "b", 7, "c", 8, 9) for r in rows], docs.schema)
    assert Counter(map(tuple, jaccard_join.similar_sets(df, 1, 80).collect())) == brute(rows, 1, 80)


@pytest.mark.parametrize("name", ["op11_ngram_jaccard_join", "op12_spelling_variants"])
def test_equals_sql(spark, name):
    import duckdb

    from plotcheck.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.QUERIES[name](spark, sf)
    out = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in out.description].index(c) for c in got.columns]
    assert Counter(map(tuple, got.collect())) == Counter(tuple(r[i] for i in at) for r in out.fetchall())
