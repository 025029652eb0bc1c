"""Periodic runs and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plotcheck.llm import periodic_runs, spelling


def brute_runs(w):
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best[i, j - i + q] = min(q, best.get((i, j - i + q), q))
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(2)
    found = []
    for _ in range(3000):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(60))]
        if len(w) > 4 and rng.random() < 0.5:
            a, p = rng.randrange(len(w)), rng.randrange(1, 8)
            w = w[:a] + [w[a + (i - a) % min(p, len(w) - a)] for i in range(a, len(w))]
        found.append(w)
    assert periodic_runs.runs_of([np.array(w, np.int64) for w in found]) == [brute_runs(w) for w in found]


def test_long_runs_take_linear_time():
    assert periodic_runs.runs_of([np.zeros(30_000, np.int64)]) == [[(0, 30_000, 1)]]
    w = np.tile(np.arange(500), 60)
    assert periodic_runs.runs_of([w]) == [[(0, 30_000, 500)]]


def brute_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return doc_id, len(runs), s, length, q, 1000 * length // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop))


@pytest.fixture(scope="module")
def more(spark, docs, rows):
    """The rows of all tests, with repeated words and lines, and misspelt words."""
    rng = random.Random(3)
    extra = []
    for i in range(300):
        w = [f"w{rng.randrange(6)}" for _ in range(rng.randrange(80))]
        extra.append((2000 + i, " ".join(w) + " one two\nthree " * rng.randrange(8), "en", "s1", 1))
    letters = "abcdefghiABéÀ×÷"
    names = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 14))) for _ in range(60)]
    for i in range(200):
        w = []
        for _ in range(60):
            x = rng.choice(names[: 1 + rng.randrange(60)])
            at = rng.randrange(len(x))
            w.append(rng.choice([x] * 12 + [x[:at] + x[at + 1 :], x[:at] + rng.choice(letters) + x[at:], x[:at] + rng.choice(letters) + x[at + 1 :]]))
        extra.append((3000 + i, "1 ".join(w) + "'文x", "en", "s1", 1))
    extra.append((3500, "longestword " * 300 + "longestwore " * 20 + "longestwxre " * 2, "en", "s1", 1))
    every = rows + extra
    return every, spark.createDataFrame([(*r, "a", "b", 7, "c", 8, 9) for r in every], docs.schema)


def test_run_digest(more, no_docs):
    rows, df = more
    assert Counter(map(tuple, periodic_runs.run_digest(df).collect())) == Counter(brute_digest(r[0], r[1]) for r in rows)
    assert periodic_runs.run_digest(no_docs).count() == 0


def test_listed_runs(more):
    rows, df = more
    want = Counter((r[0], *run) for r in rows for run in brute_runs(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")))
    assert Counter(map(tuple, periodic_runs.periodic_runs(df).collect())) == want


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(rows):
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, other in near.items():
        best = min(other, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_spelling(more, no_docs, block):
    rows, df = more
    old, spelling.BLOCK = spelling.BLOCK, block  # blocks are dealt in parts, guests come in slices
    try:
        got = spelling.spelling_groups(df).collect()
    finally:
        spelling.BLOCK = old
    want = brute_spelling(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r.form is not None and r.root != r.form for r in got)
    assert spelling.spelling_groups(no_docs).count() == 0


def test_near_words_in_many_groups(spark, monkeypatch):
    """More words than any one group of letters separates, others than Latin letters, one of 5000 letters."""
    rng = random.Random(4)
    words = {"".join(rng.choice("abcxyz文é") for _ in range(rng.randrange(1, 6))) for _ in range(1500)} | {"a" * 5000, "a" * 4999 + "b"}
    df = spark.createDataFrame([(w, 1) for w in words] + [("", 1)], "word string, n long")
    monkeypatch.setattr(type(df), "count", lambda self: 4_000_000)
    got = [tuple(sorted((r.a, r.b))) for r in spelling.near_words(df).collect()]
    want = {(a, b) for a in words for b in words if a < b and abs(len(a) - len(b)) < 2 and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want
