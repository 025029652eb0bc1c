"""Periodic runs of words, as maximal pairs of suffixes that lie close together.

A run from word s with period q and length L makes the suffixes at s and s + q share exactly L - q words, with different
words before them; and a pair of suffixes that share l words, differ before and after, and lie q <= l / 3 apart, spans a
stretch of period q that nothing extends. So runs are maximal pairs, and the LCP-interval tree of each text lists these:
going up from the deepest intervals, the positions of an interval are kept in order, each with the word to its left, and
two children give the pairs of different left words.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotcheck.llm.common import slices, texts

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Words that pairs of a run share at least: L - q with L >= max(LEAST, TIMES * q), for q = 1.
SHARED = LEAST - 1


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the periodic tail that the crc32 of one in ten ids puts in; a null id changes nothing."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


def _ranks(codes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of the substrings of 1, 2, 4, ... words within their own texts, until all of them differ.

    ``codes``: words as numbers that differ between texts; ``ends``: for every position the end of its text.
    """
    at = np.arange(len(codes))
    levels, width = [np.unique(codes, return_inverse=True)[1].astype(np.int64)], 1
    while int(levels[-1].max(initial=-1)) + 1 < len(codes):
        r = levels[-1]
        to = at + width
        inside = to < ends
        behind = np.where(inside, r[np.minimum(to, len(r) - 1)] + 1, 0)
        levels.append(np.unique(r * (len(r) + 1) + behind, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return levels


def _shared(levels: list[np.ndarray], ends: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words the suffixes at x and y (of one text) share."""
    out = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = x + out, y + out
        inside = (i + (1 << k) <= ends[x]) & (j + (1 << k) <= ends[y])
        i, j = np.where(inside, i, 0), np.where(inside, j, 0)
        out += np.where(inside & (levels[k][i] == levels[k][j]), 1 << k, 0)
    return out


def _merge(a: list[int], b: list[int]) -> list[int]:
    """Two ordered lists as one; the shorter goes into the longer where it is short enough."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return a
    if b[0] > a[-1]:
        a.extend(b)
        return a
    if 16 * len(b) < len(a):
        for x in b:
            a.insert(bisect_left(a, x), x)
        return a
    return sorted(a + b)  # two runs in order: linear


def _pairs(order: list[int], lcp: list[int], left: list[int]) -> Iterator[tuple[int, int, int]]:
    """Maximal pairs (x, y, shared words) with y - x <= shared / (TIMES - 1), of the suffixes of one text in order.

    ``lcp[i]``: words that suffixes i - 1 and i share; ``left``: the word before each position, by number.
    Positions that share l words and lie within l / 3 are steps of one period, and all but the first of them follow
    the same word. So of the positions before x within reach only the first can have another left word, and those after
    x have one all or none. Each pair listed is a run in one of its multiples: the list is linear in the words.
    """

    def combine(a: list[int], b: list[int], depth: int) -> list[int]:
        few, many = (a, b) if len(a) < len(b) else (b, a)
        reach = depth // (TIMES - 1)
        for x in few:
            i = bisect_left(many, x - reach)
            if i < len(many) and many[i] < x and left[many[i]] != left[x]:
                found.append((many[i], x, depth))
            i = bisect_left(many, x)
            if i < len(many) and many[i] <= x + reach and left[many[i]] != left[x]:
                while i < len(many) and many[i] <= x + reach:
                    found.append((x, many[i], depth))
                    i += 1
        return _merge(a, b)

    found: list[tuple[int, int, int]] = []
    stack: list[list] = []  # open intervals: depth, positions of the children so far
    n = len(order)
    current = [order[0]] if n else []
    for i in range(1, n + 1):
        depth = lcp[i] if i < n else 0
        depth = depth if depth >= SHARED else 0
        while stack and stack[-1][0] > depth:
            top, gathered = stack.pop()
            current = combine(gathered, current, top)
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][1] = combine(stack[-1][1], current, depth)
            else:
                stack.append([depth, current])
        if i < n:
            current = [order[i]]
        if found:
            yield from found
            found.clear()


def runs_of(texts_words: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For every text (its words as numbers) its runs as (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts_words]
    sizes = np.array([len(w) for w in texts_words], np.int64)
    which = np.flatnonzero(sizes >= LEAST)
    # Texts without a repeated string of four words have no run: they share SHARED words nowhere.
    for step in (1, 4):
        if not len(which):
            return out
        n = sizes[which]
        owner = np.repeat(np.arange(len(which)), n)
        words = np.concatenate([texts_words[i] for i in which.tolist()]).astype(np.int64)
        stop = np.cumsum(n)
        ends = np.repeat(stop, n)
        codes = owner * (int(words.max()) + 1) + words
        if step == 1:
            grams = np.unique(codes, return_inverse=True)[1].astype(np.int64)
            for width in (1, 2):
                to = np.arange(len(grams)) + width
                behind = np.where(to < ends, grams[np.minimum(to, len(grams) - 1)] + 1, 0)
                grams = np.unique(grams * (len(grams) + 1) + behind, return_inverse=True)[1].astype(np.int64)
            again = np.bincount(grams)[grams] > 1
            which = which[np.bincount(owner[again], minlength=len(which)) > 0]
    levels = _ranks(codes, ends)
    order = np.argsort(levels[-1], kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    same = np.r_[False, owner[order[1:]] == owner[order[:-1]]]
    lcp = np.zeros(len(order), np.int64)
    at = np.flatnonzero(same)
    lcp[at] = _shared(levels, ends, order[at - 1], order[at])
    begin = stop - n
    for k, i in enumerate(which.tolist()):
        a, b = int(begin[k]), int(stop[k])
        if lcp[a:b].max() < SHARED:
            continue
        left = np.r_[-1, words[a : b - 1]].tolist()
        best: dict[tuple[int, int], int] = {}
        for x, y, depth in _pairs((order[a:b] - a).tolist(), lcp[a:b].tolist(), left):
            q = y - x
            if depth + q >= max(LEAST, TIMES * q):
                key = (x, depth + q)
                best[key] = min(q, best.get(key, q))
        out[i] = sorted((s, length, q) for (s, length), q in best.items())
        out[i].sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    mark = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        mark[start + q] += 1
        mark[start + length] -= 1
    return [w for w, m in zip(words, np.cumsum(mark).tolist()) if not m]  # noqa: B905


def _numbered(found: list[list[bytes]]) -> list[np.ndarray]:
    flat = pa.array([w for words in found for w in words], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    return np.split(flat, np.cumsum([len(w) for w in found])[:-1])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, period) of every run of every whole text: words of ``common.WORD``, numbered from 0.

    Null, empty and blank texts have none. Rows that repeat an id, or have none, are looked at each on its own. Other
    columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [t.split() for t in texts(batch.column("text"))]
            runs = runs_of(_numbered(found))
            ids = batch.column("doc_id").to_pylist()
            rows = [(i, *r) for i, of in zip(ids, runs) for r in of]  # noqa: B905
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["doc_id", "start", "length", "period"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, start long, length long, period long")


def run_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``: runs of its words after ``planted``, the longest one, and digests.

    Columns: doc_id, n_runs, start, length, period, exponent_milli of the longest run (ties: smallest start, then period;
    null without runs), runs_sha256, collapsed_sha256. Nulls, repeated rows, empty texts and tables as in periodic_runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            found = [planted(t.split(), i) for t, i in zip(texts(batch.column("text")), ids)]  # noqa: B905
            every = runs_of(_numbered(found))
            longest = [min(r, key=lambda x: (-x[1], x[0], x[2])) if r else (None, None, None) for r in every]
            longs = [ids, [len(r) for r in every], *([x[c] for x in longest] for c in range(3)), [x[1] and 1000 * x[1] // x[2] for x in longest]]
            listed = [sha("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()) for r in every]
            kept = [sha(b" ".join(collapsed(w, r))) for w, r in zip(found, every)]  # noqa: B905
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in longs), pa.array(listed), pa.array(kept)], names=[c.split()[0] for c in schema.split(", ")])

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, schema)
