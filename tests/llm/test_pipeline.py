"""The pipeline's stages, each on its predecessor's result: rows and texts against brute force."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_similar import groups

from plotcheck.llm import mixing, quality

SF = "/root/testdata/sf0.001"


def without_repeats(texts, length):
    """Each text without the bytes that strings of ``length`` which occur elsewhere too cover."""
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        out.append(bytes(c for c, m in zip(t, mark, strict=True) if not m))
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each but the last, and the last one's table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        seen.append(docs.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    return seen, last


def test_quality_drops_what_scores_low(spark, stages):
    (before, after, *_), _ = stages
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.score >= 0.7}
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if r.doc_id in good)
    assert 0 < len(after) < len(before)


def test_one_of_each_group_stays(stages):
    (_, before, after, *_), _ = stages
    want = groups([(r.doc_id, r.text) for r in before])
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if want[r.doc_id, r.text] == r.doc_id)


def test_repeats_are_cut(stages):
    (_, _, before, after, _), _ = stages
    cut = without_repeats([(r.text or "").encode() for r in before], 200)
    want = {r.doc_id: t.decode(errors="ignore") for r, t in zip(before, cut, strict=True)}
    assert {r.doc_id: r.text for r in after} == want and len(after) == len(before)
    assert [r.lang for r in sorted(after, key=lambda r: r.doc_id)] == [r.lang for r in sorted(before, key=lambda r: r.doc_id)]


def test_mix_repeats_whole_documents(spark, stages):
    (_, _, _, before, after), _ = stages
    docs = spark.createDataFrame(before)
    copies = {r.doc_id: r.taken // r["size"] if r["size"] else None for r in mixing.mix_digest(docs).collect()}
    held = Counter(r.doc_id for r in after)
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[r.doc_id] == r.text for r in after)
    assert {i: held[i] for i, n in copies.items() if n is not None} == {i: n for i, n in copies.items() if n is not None}
    # Copies are whole, so a source misses its target by one document at most.
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(0 <= held[r.doc_id] <= 2 for r in before) and sum(size(r.text) * held[r.doc_id] for r in before) > 0


def test_packed_sequences_hold_all(stages):
    (*_, docs), last = stages
    assert sum(r.piece == 0 for r in last) == len(docs)
    fill = Counter()
    for r in last:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024
    assert len(fill) <= -(-sum(fill.values()) // 1024) + 3
    at = {}
    for r in sorted(last, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_no_documents(spark, no_docs, tmp_path):
    """Every stage takes an empty table."""
    docs = no_docs.select("doc_id", "text", "lang", "source", F.col("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        if "text" not in docs.columns:
            break
