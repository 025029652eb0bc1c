"""SimHash and suffix-array deduplication against brute force."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash

from plotcheck.llm import simhash_dedup, suffix_dedup


def fingerprint(text, n):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius):
    """Smallest id reachable from each (id, fingerprint)."""
    known = sorted({(i, f) for i, f in fps if i is not None})
    parent = {x: x for x in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(known):
        for y in known[:a]:
            if (x[1] ^ y[1]).bit_count() <= radius:
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
    return {x: find(x)[0] for x in known}


@pytest.mark.parametrize("n", [4, 5])
def test_simhash_groups(docs, rows, n):
    got = simhash_dedup.near_duplicate_groups(docs, n, 4).collect()
    assert len(got) == len(rows)
    fps = [(r[0], fingerprint(r[1], n)) for r in rows]
    want = components(fps, 4)
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == Counter(fps)
    assert all(r.component_id == want.get((r.doc_id, r.fp & (1 << 64) - 1)) for r in got)


def test_links_lose_no_pair(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = {}
    for c in centres:
        for _ in range(12):
            x = c
            for b in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << b
            fps.setdefault(x, len(fps))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f), i) for f, i in fps.items()], "fp long, rep long")
    old, simhash_dedup.CELL = simhash_dedup.CELL, 5  # many cells are dealt out in parts
    try:
        links = [tuple(r) for r in simhash_dedup.fingerprint_links(df, 4).collect()]
    finally:
        simhash_dedup.CELL = old
    by_id = {i: f for f, i in fps.items()}
    assert all((by_id[a] ^ by_id[b]).bit_count() <= 4 for a, b in links)
    want = components([(i, f) for f, i in fps.items()], 4)
    parent = {i: i for i in by_id}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {(i, by_id[i]): find(i) for i in by_id} == want


def test_one_stays(docs, rows, no_docs):
    kept = simhash_dedup.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = components([(r[0], fingerprint(r[1], 5)) for r in rows], 4)
    assert Counter(ids) == Counter([*{i for (i, _), c in want.items() if c == i}, None])
    assert simhash_dedup.near_duplicate_groups(no_docs).count() == 0


def brute_removed(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if mark[i] and (i == 0 or not mark[i - 1]))
        kept = bytes(c for c, m in zip(t, mark, strict=True) if not m)
        out.append((len(t), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


def digest(df):
    return Counter(tuple(r) for r in suffix_dedup.removal_digest(df).collect())


def test_suffix_removal(docs, rows, no_docs):
    want = brute_removed([(r[1] or "").encode() for r in rows], 200)
    assert digest(docs) == Counter((r[0], *w) for r, w in zip(rows, want, strict=True))
    assert suffix_dedup.removal_digest(no_docs).count() == 0


@pytest.mark.parametrize("hot", [1000, 1])
def test_suffix_periodic_and_shared(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("ab") for _ in range(n))
    passage = letters(300)
    texts = ["a" * 500, "ab" * 150, letters(199), letters(200)] + [letters(rng.randrange(90)) + passage[rng.randrange(60) : 300 - rng.randrange(60)] + letters(rng.randrange(90)) for _ in range(60)]
    texts += [texts[3], "é" * 150 + passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute_removed([t.encode() for t in texts], 200)
    assert digest(df) == Counter((i, *w) for i, w in enumerate(want))


def test_texts_over_a_step(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP", 1000)
    rng = random.Random(4)
    t = "".join(rng.choice("abcdef") for _ in range(5000))
    texts = [t, t[2100:2600] + "x" * 10, t[950:1300]]
    batch = suffix_dedup.pa.RecordBatch.from_pydict({"doc_id": [0, 1, 2], "row_hash": [0, 0, 0], "text": texts})
    spans = [b.to_pylist() for b in suffix_dedup._scan(iter([batch]), 200)]
    starts = {(s["doc_id"], i) for b in spans for s in b for i in range(s["a"], s["b"] + 1)}
    assert starts == {(d, i) for d, x in enumerate(texts) for i in range(len(x) - 199)}


@pytest.mark.parametrize("kind", ["uint64", "S3"])
def test_family_of_levels(kind):
    rng = random.Random(6)
    keys = [rng.randrange(300) for _ in range(500)]
    keys = [k.to_bytes(3) for k in keys] if kind == "S3" else keys
    family = suffix_dedup.SuffixFamily()
    for i in range(0, 500, 37):
        family.add(suffix_dedup.np.array(keys[i : i + 37], dtype=kind))
    count = Counter(keys)
    assert family.matched().tolist() == [count[k] > 1 for k in keys]
    assert len(family.levels) <= 5  # 14 batches: 8 + 4 + 2
    assert all((level[1:] >= level[:-1]).all() for _, level, _ in family.levels)


def test_extreme_ids_and_many_equal_rows(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(3000))
    rows = [(5, text)] * 200 + [(-(2**62), text[:400]), (None, "x" + text[:300]), (0, "y" + text[:300]), (-(2**63), "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_removed([t.encode() for _, t in rows[199:]], 200)
    # A row stands for the 200 equal ones here: all of it repeats.
    want[0] = (3000, 3000, 1, hashlib.sha256(b"").hexdigest())
    assert digest(df) == Counter((5, *want[0]) for _ in range(200)) + Counter((i, *w) for (i, _), w in zip(rows[200:], want[1:], strict=True))
    spans = suffix_dedup.repeated_spans(df).filter("doc_id = 5").selectExpr("sum(size(spans)) n").first().n
    assert spans <= 200 * 60  # one row's spans for each row


@pytest.mark.parametrize("known", [0, 100_000])
def test_split_anchors_of_both_steps(spark, monkeypatch, known):
    """Anchors over a shard's fair part, strings combined before the shuffle, and strings with zero bytes."""
    for name, value in (("HOT", 1), ("KNOWN", known), ("SAMPLE", 1.0), ("STRETCHES", 40), ("STARTS", 500)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(12)
    letters = lambda n, of="abcd": "".join(rng.choice(of) for _ in range(n))
    passage = letters(330)
    texts = [letters(rng.randrange(40)) + passage[rng.randrange(3) * 20 : 330 - rng.randrange(3) * 20] + letters(rng.randrange(40)) for _ in range(150)]
    texts += ["\0" * 250, "a" + "\0" * 210, "b" * 199 + "\0", "b" * 199, "b" * 199 + "\0\0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    want = brute_removed([t.encode() for t in texts], 200)
    assert digest(df) == Counter((i, *w) for i, w in enumerate(want))


def test_remove_repeats_keeps_rows(docs, rows):
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.text is None} == {100}
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert all(r.kept == "c" and r.fp == "a" for r in got)
