"""Top-k, fingerprints, classifier and language identification."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import place

from plotcheck.llm import fingerprints, langid, quality, topk

N = fingerprints.BITS


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def brute_top(rows, k):
    """(query, rank, id, score) over rows of (id, vector); a row is known by its place."""
    low, high = -(1 << 63), (1 << 63) - 1
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, v) in enumerate(sound):
        if a is not None and a % 50 == 0:
            score = [(b, min(max(sum(x * y for x, y in zip(v, w, strict=False)), low), high)) for m, (b, w) in enumerate(sound) if m != n]
            score.sort(key=lambda s: (-s[1], s[0] is None, s[0] or 0))
            out += [(a, r + 1, b, s) for r, (b, s) in enumerate(score[:k])]
    return Counter(out)


def test_top_k(spark, monkeypatch):
    rng = random.Random(2)
    vec = [(i, [rng.uniform(-1, 1) for _ in range(10)], "x") for i in range(160)]
    vec += [(i, list(vec[7][1]), "x") for i in range(300, 340)]  # ties
    vec += [(150, list(vec[150][1]), "x"), (150, [0.25] * 10, "x"), (None, [1.0] * 10, "x"), (200, None, "x"), (250, [1.0, None] * 5, "x"), (350, [float("nan")] * 10, "x"), (400, [float("inf")] * 10, "x"), (500, [], "x"), (550, [0.5] * 3, "x")]
    # Products that no double holds, and scores beyond a long.
    vec += [(600, [1e30] * 10, "x"), (601, [-1e30] * 10, "x"), (650, [3e7 + j for j in range(10)], "x"), (651, [2e6 - j for j in range(10)], "x"), (2, [1e12] * 4, "x")]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<double>, score string")
    for name, value in (("QUERIES", 3), ("CANDIDATES", 40), ("_STEP", 17)):
        monkeypatch.setattr(topk, name, value)
    q = topk.quantized(df)
    assert Counter(map(tuple, topk.top_k(q, q.filter("vec_id % 50 = 0"), 5).collect())) == brute_top([r[:2] for r in vec], 5)
    few = topk.quantized(spark.createDataFrame(vec[:3], df.schema))
    assert topk.top_k(few, few, 5).count() == 6
    none = topk.quantized(spark.createDataFrame([], df.schema))
    assert topk.top_k(none, none, 5).count() == 0


def test_lists_are_read_to_the_cutoff():
    """Where vectors differ in length, fewer components are multiplied than all pairs have; the answer is whole."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.standard_normal((4000, 32)) * rng.pareto(2, (4000, 1)))
    t = pa.table({"row": np.arange(4000), "vec_id": np.arange(4000), "v": pa.array(v.tolist(), pa.list_(pa.float64()))})
    q, work = t.slice(0, 80), [0]
    first = topk._score(q, t, 5, False, work)
    low = {}
    for i, s in zip(first["query_row"].to_pylist(), first["score"].to_pylist(), strict=True):
        low[i] = min(s, low.get(i, s))
    got = topk._score(q.append_column("tau", pa.array([low[i] for i in range(80)])), t, 5, True, work)
    score = v[:80] @ v.T
    score[np.arange(80), np.arange(80)] = -np.inf
    assert sorted(got["score"].to_pylist()) == sorted(np.sort(score, axis=1)[:, -5:].ravel().tolist())
    assert work[0] < 0.7 * 80 * 4000 * 32


def scrambled(x):
    """The finaliser of splitmix64."""
    m = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def brute_fingerprint(text):
    """Weighted votes of the hashes of pairs of words, with plain integers; 256 bits."""
    m = (1 << 64) - 1
    letter = [scrambled((i + 1 + 29) * 0x9E3779B97F4A7C15 & m) for i in range(256)]
    words = [scrambled(sum(scrambled((letter[c] + k * 0xD1342543DE82EF95) & m) for k, c in enumerate(w)) & m) for w in text.encode().lower().split()]
    if not words:
        return bytes(N // 8)
    terms = Counter()
    for i in range(max(len(words) - 1, 1)):
        h = 0
        for w in words[i : i + 2]:
            h = scrambled((h * 0xD1342543DE82EF95 + w) & m)
        terms[h] += 1
    votes, total = [0.0] * N, 0.0
    for h, n in terms.items():
        weight = float(np.float32(1 + math.log(n)))
        total += weight
        bits = b"".join((h if j == 0 else scrambled(h ^ 0xA5A5A5A5 * j & m)).to_bytes(8, "little") for j in range(N // 64))
        value = int.from_bytes(bits)
        for b in range(N):
            votes[b] += weight * (value >> N - 1 - b & 1)
    return sum(1 << N - 1 - b for b in range(N) if 2 * votes[b] > total).to_bytes(N // 8)


def test_edit_robustness(docs, rows, no_docs):
    got = fingerprints.edit_robustness(docs).collect()
    assert len(got) == len(rows) and fingerprints.edit_robustness(no_docs).count() == 0
    ordered = sorted(rows, key=place)
    want = []
    for k, r in enumerate(ordered):
        t, nxt = r[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = (brute_fingerprint(x) for x in (t, e, nxt))
        like = lambda x, y: sum(p == q for p, q in zip(f"{int.from_bytes(x):0{N}b}", f"{int.from_bytes(y):0{N}b}", strict=True)) / N
        want.append((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), a.hex(), b.hex(), like(a, b), like(a, c)))
    key = lambda x: (str(x[0]), x[2], x[3])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    # Votes that tie but for rounding may fall either way.
    apart = lambda x, y: (int(x, 16) ^ int(y, 16)).bit_count()
    assert all(g[:3] == w[:3] and apart(g[3], w[3]) <= 2 and apart(g[4], w[4]) <= 2 and abs(g[5] - w[5]) <= 4 / N and abs(g[6] - w[6]) <= 4 / N for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.9 * len(got)


@pytest.mark.parametrize(("radius", "blocks", "hot"), [(3, 5, 10_000), (8, None, 10_000), (8, None, 3)])
def test_block_tables_find_all(spark, monkeypatch, radius, blocks, hot):
    monkeypatch.setattr(fingerprints, "HOT", hot)
    rng = random.Random(8)
    base = [rng.getrandbits(N) for _ in range(30)]
    near = []
    for x in base:
        for _ in range(4):
            y = x
            for b in rng.sample(range(N), rng.randrange(radius + 3)):
                y ^= 1 << b
            near.append(y)
    hexed = lambda xs: spark.createDataFrame([(i, f"{x:0{N // 4}x}") for i, x in enumerate(xs)] + [(None, None)], "doc_id long, fingerprint string")
    every = base + near + base[:3]
    got = [(r.query_fp, r.fp, r.distance) for r in fingerprints.near_fingerprints(hexed(base), hexed(every), radius, blocks).collect()]
    want = {(f"{a:0{N // 4}x}", f"{b:0{N // 4}x}", (a ^ b).bit_count()) for a in base for b in every if (a ^ b).bit_count() <= radius}
    assert len(got) == len(want) and set(got) == want
    if blocks is None:
        found = {r.doc_id: (r.n_near, r.nearest) for r in fingerprints.neighbours(hexed(every), hexed(base), radius).collect() if r.doc_id is not None}
        for i, a in enumerate(base):
            d = [(a ^ b).bit_count() for b in {*every} - {a} if (a ^ b).bit_count() <= radius]
            assert found[i] == (len(d), min(d, default=None))


def test_terms_are_votes():
    assert fingerprints.fingerprint(b" \n") == bytes(N // 8)
    assert fingerprints.fingerprint(b"A b c") == fingerprints.fingerprint(b"a  b\tC")
    a, b = "one two three four five six seven " * 3, "one two three four five six eight " * 3
    assert fingerprints.likeness(fingerprints.fingerprint(a.encode()), fingerprints.fingerprint(b.encode())) > 0.6


def junk(rng, bad, n):
    w = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('rstlm')}" for _ in range(n)]
    return " ".join(x.upper() + "!!" if bad else x for x in w)


def test_classifier_learns(spark):
    rng = random.Random(9)
    y = {i: rng.random() < 0.8 for i in range(400)}
    df = spark.createDataFrame([(i, junk(rng, not y[i], 30), "zz", "zz") for i in y], "doc_id long, text string, lang string, __score string")
    labels = spark.createDataFrame([(i, int(v), 0) for i, v in y.items()], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(df, labels).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    right = [r.predicted == y[r.doc_id] for r in out if r.held_out]
    assert sum(right) >= 0.98 * len(right) > 50
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in out)
    # Labels of held-out rows change nothing.
    flipped = spark.createDataFrame([(i, int(v) ^ held(i), 0) for i, v in y.items()], labels.schema)
    assert {r.doc_id: round(r.score, 9) for r in quality.quality_scores(df, flipped).collect()} == {r.doc_id: round(r.score, 9) for r in out}


def test_classifier_edges(docs, rows, labels, no_docs, spark):
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == len(rows) and all(r.score is not None for r in out)
    assert quality.quality_scores(no_docs, labels).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert {round(r.score, 6) for r in quality.quality_scores(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, 0) for i in range(20)], labels.schema)
    assert all(r.predicted == 1 for r in quality.quality_scores(docs, ones).collect())


def test_descent_separates():
    rng = random.Random(0)

    rows = [np.array(sorted(rng.sample(range(50, 200), 10) + [i % 2])) for i in range(200)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(200)])
    ratio = quality.ratios(rows, y)
    w, b = quality.descend(rows, y, ratio)
    margins = [(w[r] @ ratio[r]) / np.sqrt((ratio[r] ** 2).sum()) + b for r in rows]
    assert all(m * s > 0 for m, s in zip(margins, y, strict=True))


def test_descent_reaches_the_optimum():
    """No step from the solution lowers the convex objective, bias included; words that tell nothing get ratios near 0."""
    rng = np.random.default_rng(4)
    rows = [np.array(sorted(rng.choice(40, 8, replace=False))) for _ in range(60)]
    y = np.where([(r < 12).sum() + rng.normal(0, 1) > 2.4 for r in rows], 1.0, -1.0)
    ratio = quality.ratios(rows, y)
    counts = [sum(40 <= i for i in r) for r in rows]
    one = np.array([1 + sum(7 in r for r, c in zip(rows, y, strict=True) if c > 0), 1 + sum(7 in r for r, c in zip(rows, y, strict=True) if c < 0)])
    total = [quality.BUCKETS + 8 * (y > 0).sum(), quality.BUCKETS + 8 * (y < 0).sum()]
    assert sum(counts) == 0 and abs(ratio[7] - (math.log(one[0] / total[0]) - math.log(one[1] / total[1]))) < 1e-9
    x = np.zeros((60, 40))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())

    def objective(w, b):
        return (w @ w + b * b) / 2 + quality.BOUND * np.maximum(0, 1 - y * (x @ w + b)).sum()

    w, b = quality.descend(rows, y, ratio, epochs=400)
    assert not w[40:].any()
    best = objective(w[:40], b)
    for scale in (1e-3, 1e-2, 0.1, 1):
        for _ in range(500):
            d = rng.normal(0, scale, 41)
            assert objective(w[:40] + d[:40], b + d[40]) >= best - 1e-4
    short = objective(*(lambda v, c: (v[:40], c))(*quality.descend(rows, y, ratio)))
    assert short <= 1.05 * best


def brute_phrases(text, sample):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        n += 1 if k > 1 else 2
        i += max(k - 1, 1)
    return n


@pytest.mark.parametrize(("dense", "stretch"), [(64, 512), (2, 16), (1, 3)])
def test_cross_parsing_counts_longest_matches(monkeypatch, dense, stretch):
    monkeypatch.setattr(langid, "DENSE", dense)
    monkeypatch.setattr(langid, "STRETCH", stretch)
    rng = random.Random(7)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    samples = {"a": [text(300, "abcd ")], "b": [text(300, "cdef ")], "c": ["ab" * 200], "d": [text(300, "ab")]}
    model = langid.train(samples)
    asked = [text(n, "abcdefgh ").strip() or "a" for n in (1, 5, 255, 256, 257, 700)] + ["ab" * 300, "ba" * 40 + "c" + "ab" * 300, text(900, "ab")]
    squeeze = lambda t: " ".join(t.split(" ")) if "  " not in t else __import__("re").sub(" +", " ", t)
    got, size = langid.phrases(asked, model)
    for t, g, s in zip(asked, got, size, strict=True):
        t = squeeze(t)
        assert s == len(t)
        for k, name in enumerate(model.languages):
            assert g[k] == brute_phrases(t, squeeze(samples[name][0]))


def test_large_alphabets_are_told_apart():
    """Two languages of 3000 letters each, none shared: a short text is enough."""
    rng = random.Random(1)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 6000)]
    kinds = {"x": letters[:3000], "y": letters[3000:]}
    model = langid.train({k: ["".join(rng.choices(own, k=8000))] for k, own in kinds.items()})
    assert len(model.points) > 5000
    for n, least in ((5, 0.95), (20, 0.99)):
        asked = [(k, "".join(rng.choices(own, k=n))) for k, own in kinds.items() for _ in range(300)]
        found = langid.identify([t for _, t in asked], model)
        assert sum(k == f for (k, _), (f, _) in zip(asked, found, strict=True)) >= least * len(asked)


def test_samples_are_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "CHARACTERS", 30)
    seen = {}
    monkeypatch.setattr(langid, "train", lambda samples: seen.update(samples))
    rows = [(i, f"{i:02d}" + "a" * 8, "short") for i in range(40)] + [(i, "b" * (100 + i), "long") for i in range(100, 110)] + [(1, None, "none")]
    langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(seen["short"]) == 3 and all(len(t) == 10 for t in seen["short"])
    assert seen["long"] == ["b" * min(100 + i for i in range(100, 110) if not held(i))]
    assert set(seen) == {"short", "long"}


@pytest.mark.parametrize("bad", [None, "", "12 34 !?"])
def test_undetermined(bad):
    model = langid.train({"x": ["some text"], "y": ["anders wo"]})
    assert langid.identify([bad], model) == [("und", 0.0)]
    assert langid.identify(["some"], langid.train({})) == [("und", 0.0)]


def test_languages(spark, docs, rows, no_docs):
    rng = random.Random(11)
    kinds = {"en": "the of and to in is that for with was".split(), "de": "der die und das nicht ein ist mit für auch".split(), "fr": "le la et les des une est pour que dans".split()}
    data = [(i, " ".join(rng.choice(kinds[k]) for _ in range(40)), k, "s") for i, k in enumerate(list(kinds) * 30)]
    out = {r.doc_id: r for r in langid.predicted_languages(spark.createDataFrame(data, "doc_id long, text string, lang string, score string")).collect()}
    assert all(out[i].lang_pred == k and 0 <= out[i].score <= 1 and out[i].held_out == held(i) for i, _, k, _ in data)
    got = langid.predicted_languages(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {100, 101, 102}
    assert langid.predicted_languages(no_docs).count() == 0


def test_an_id_is_learnt_once(spark):
    """However many rows repeat an id, the sample has one of them."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta".split() if i % 2 else "uno dos tres cuatro".split()) for _ in range(30))) for i in range(40)]
    schema = "doc_id long, text string"
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = quality.learn(spark.createDataFrame(rows, schema), marks)
    again = quality.learn(spark.createDataFrame(rows + [next(r for r in rows if not held(r[0]))] * 3000, schema), marks)
    assert np.array_equal(once.scaled, again.scaled) and once.bias == again.bias
