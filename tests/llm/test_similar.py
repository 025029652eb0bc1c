"""Groups of similar texts against all pairs."""

import random

import corpus_pipeline
import pytest
from conftest import words

from plotcheck.llm import similar


def five(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)}


def groups(rows):
    """Smallest id reachable from each (id, text) with an id."""
    known = sorted({r[:2] for r in rows if r[0] is not None}, key=str)
    sets, parent = [five(t) for _, t in known], list(range(len(known)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(known)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(known):
        low[find(i)] = min(k, low.get(find(i), k))
    return {row: low[find(i)] for i, row in enumerate(known)}


@pytest.fixture(scope="module")
def edited():
    """Texts of 300 words, and copies with every word of a few places changed: similarities from 0.7 to 0.95."""
    rng = random.Random(11)
    out = []
    for i in range(40):
        w = words(rng, 300, 5000).split()
        out.append((10 * i, " ".join(w), "en", "s0", 1))
        for k in (1, 2, 3):
            v = list(w)
            for at in rng.sample(range(300), 2 * k + 1):
                v[at] = f"new{rng.randrange(9999)}"
            out.append((10 * i + k, " ".join(v), "en", "s0", 1))
    return out


@pytest.mark.parametrize("most", [512, 2])
def test_stage_keeps_one_of_each_group(spark, docs, rows, edited, most):
    every = rows + [(1000 + r[0], *r[1:]) for r in edited]
    df = spark.createDataFrame([(*r, "a", "b", 7, "c", 8, 9) for r in every], docs.schema)
    old, similar.GROUP, similar.CELL = (similar.GROUP, similar.CELL), most, 16 * most
    try:
        kept = corpus_pipeline.simhash_near_dedup(spark, df, "")
        assert kept.columns == df.columns
        ids = sorted((r.doc_id for r in kept.collect()), key=str)
    finally:
        similar.GROUP, similar.CELL = old
    want = groups(every)
    assert ids == sorted([*{k for (k, _), low in want.items() if k == low}, None], key=str)


def test_empty(no_docs):
    assert similar.keep_one_per_group(no_docs).count() == 0
