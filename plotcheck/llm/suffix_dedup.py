"""Removal of long repeated strings with a logarithmic family of suffix arrays.

Every start of a 200-byte string belongs to one anchor: the 40-byte string in it with the least fingerprint. Equal
strings have equal anchors at equal offsets, so suffixes are dealt to shards by anchor and never compared across
shards. A shard indexes what it receives batch by batch: each batch becomes a suffix array, is merge-scanned against
the arrays of the existing levels, and levels of equal size merge, so that an entry is moved a logarithmic number of
times.

Step 1 indexes stretches (the starts of one anchor in a row, about 80) by anchor and by whole content (128 bits of
XXH3). A stretch whose whole content repeats needs no more work; one whose anchor is alone has no match; the rest are
looked at start by start in step 2, in a second family: arrays of suffixes in byte order, each cut after the 200 bytes
that are compared, so that a match is an equality of bytes. The number of shards follows the data in both steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plotcheck.llm.common import mix, partitions, random_words, slices, texts
from plotcheck.storage import materialize

ANCHOR = 40
#: Bytes looked at in one step of an anchor scan; longer texts are read in overlapping steps.
STEP = 750_000
#: Stretches of one anchor with different content that a flush sends to the anchor's shard at most; it knows then that the anchor repeats.
SENT = 8
#: An anchor of more undecided stretches is split among shards.
HOT = 1000
#: Stretches of step 1, and starts of step 2, in a shard, about.
STRETCHES, STARTS = 250_000, 120_000
#: Share of the stretches by which anchors that exceed a shard's fair part are found; it decides how they are dealt alone.
SAMPLE = 0.05
#: Strings of much shared anchors that a task remembers, to send each of them twice at most.
KNOWN = 50_000

_BYTES = random_words(256, seed=11)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, STEP + 1024)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _prefix(data: np.ndarray) -> np.ndarray:
    """Running sums from which the fingerprint of any substring follows."""
    up, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up, out=out[1:])
    return out


def _substrings(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of data[start:end]."""
    _, down = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


class SuffixFamily:
    """Sorted arrays of doubling size, with the number of each entry: of byte strings (suffixes in byte order) or of numbers."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.hits: list[np.ndarray] = []
        self.n = 0

    def add(self, keys: np.ndarray) -> None:
        """Index a batch: sort it, scan it against every level for matches, then merge levels of equal size."""
        if not len(keys):
            return
        hit = np.zeros(len(keys), bool)
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        twin = k[1:] == k[:-1]
        hit[order[1:][twin]] = True
        hit[order[:-1][twin]] = True
        for _, other, numbers in self.levels:
            at = np.searchsorted(other, k)
            found = other[np.minimum(at, len(other) - 1)] == k
            hit[order[found]] = True
            met = k[found]
            low, high = at[found], np.searchsorted(other, met, side="right")
            # Every entry of the level that equals one of the batch; equal ones of the batch are asked once.
            fresh = np.r_[True, met[1:] != met[:-1]] if len(met) else np.zeros(0, bool)
            low, n = low[fresh], (high - low)[fresh]
            self._mark(numbers[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)])
        self.hits.append(hit)
        self.levels.append((0, k, order + self.n))
        self.n += len(keys)
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a, x), (_, b, y) = self.levels[-2:]
            # Merge the shorter into the longer.
            if len(a) < len(b):
                a, x, b, y = b, y, a, x
            place = np.searchsorted(a, b, side="right") + np.arange(len(b))
            rest = np.ones(len(a) + len(b), bool)
            rest[place] = False
            keys_, numbers = np.empty(len(rest), a.dtype), np.empty(len(rest), np.int64)
            keys_[place], keys_[rest], numbers[place], numbers[rest] = b, a, y, x
            self.levels[-2:] = [(rank + 1, keys_, numbers)]

    def _mark(self, numbers: np.ndarray) -> None:
        starts = np.cumsum([0, *map(len, self.hits)])
        which = np.searchsorted(starts, numbers, side="right") - 1
        for i in np.unique(which):
            self.hits[i][numbers[which == i] - starts[i]] = True

    def matched(self) -> np.ndarray:
        """For every entry in the order of arrival: does its string occur elsewhere too?"""
        return np.concatenate(self.hits) if self.hits else np.zeros(0, bool)


def _stretches(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, anchor, fingerprints of all anchors) of the stretches of ``data``; no string crosses one of ``ends``."""
    n = len(data) - length + 1
    prefix = _prefix(data)
    _, down = _powers(len(prefix))
    grams = mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * down[: len(prefix) - ANCHOR])
    low = np.uint64((1 << 24) - 1)
    best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, need = 1, length - ANCHOR + 1
    while 2 * width <= need:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < need:
        best = np.minimum(best[: len(best) - (need - width)], best[need - width :])
    anchor = (best & low).astype(np.int64)
    valid = np.zeros(n + 1, np.int8)
    begin = 0
    for end in ends.tolist():
        if end - begin >= length:
            valid[begin : end - length + 1] = 1
        begin = end
    valid[n] = 0
    brk = np.empty(n, bool)
    brk[0] = True
    brk[1:] = anchor[1:] != anchor[:-1]
    brk[ends[ends < n]] = True
    first = np.flatnonzero(brk)
    # Starts that would cross an end are never valid; they close the stretch before them.
    counts = np.add.reduceat(valid[:n].astype(np.int64), first)
    keep = counts > 0
    first, counts = first[keep], counts[keep]
    return first, first + counts - 1, anchor[first], grams


_SPANS = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("row_hash", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("p", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64()), ("more", pa.int64())])
#: Whole: all its strings repeat. Mixed: to be looked at start by start. Both: whole, and shown to the mixed ones as well.
_SHARD, _WHOLE, _MIXED, _BOTH = 0, 1, 2, 3


def _scan(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Stretches of every text. kind 0 goes to the anchor's shard; 1 and 2 are decided within the flush."""

    def flush(joined: bytes, ends: np.ndarray, ids: np.ndarray, hashes: np.ndarray, shift: np.ndarray) -> pa.RecordBatch | None:
        data = np.frombuffer(joined, np.uint8)
        first, last, anchor, grams = _stretches(data, ends, length)
        if not len(first):
            return None
        key = grams[anchor]
        whole, digest = memoryview(joined), xxhash.xxh3_128_digest
        content = np.frombuffer(b"".join([digest(whole[x:y]) for x, y in zip(first.tolist(), (last + length).tolist())]), np.uint64).reshape(-1, 2)  # noqa: B905
        order = np.lexsort((content[:, 1], content[:, 0], key))
        k, c = key[order], content[order]
        new_key = np.r_[True, k[1:] != k[:-1]]
        new_content = new_key | np.r_[True, (c[1:] != c[:-1]).any(axis=1)]
        # Combine before the shuffle: of equal stretches two go to the shard, the others are known to repeat.
        at = np.flatnonzero(new_content)
        size = np.diff(np.r_[at, len(k)])
        nth = np.arange(len(k)) - np.repeat(at, size)
        kind = np.where(nth >= 2, _WHOLE, _SHARD).astype(np.int8)
        # And of stretches of one anchor with different content, the first few.
        keys_at = np.flatnonzero(new_key)
        variant = np.cumsum(new_content) - 1
        variant -= np.repeat(variant[keys_at], np.diff(np.r_[keys_at, len(k)]))
        kind[(variant >= SENT) & (kind == _SHARD)] = _MIXED
        doc = np.searchsorted(ends, first[order], side="right")
        base = np.r_[0, ends[:-1]][doc] - shift[doc]
        columns = [kind, ids[doc], hashes[doc], first[order] - base, last[order] - base, anchor[order] - base, k.view(np.int64), *np.ascontiguousarray(c.T).view(np.int64)]
        # What is decided here is written without what only the deciding needs.
        spare = [None] * 5 + [kind == _WHOLE] * 2 + [kind != _SHARD] * 2
        return pa.RecordBatch.from_arrays([pa.array(x, t, mask=m) for x, t, m in zip(columns, _SPANS.types, spare)], schema=_SPANS)  # noqa: B905

    for batch in slices(batches, "text", 8 * STEP):
        ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row_hash"))
        parts: list[tuple[bytes, int, int]] = []
        size = 0

        def take(parts: list) -> pa.RecordBatch | None:
            data = b"".join(x for x, _, _ in parts)
            ends = np.cumsum([len(x) for x, _, _ in parts])
            rows = np.array([i for _, i, _ in parts])
            return flush(data, ends, ids[rows], hashes[rows], np.array([s for _, _, s in parts]))  # noqa: B023

        for i, text in enumerate(texts(batch.column("text"))):
            for s in range(0, max(len(text) - length + 1, 0), STEP):
                piece = text[s : s + STEP + length - 1]
                if parts and size + len(piece) > 2 * STEP:
                    if (out := take(parts)) is not None:
                        yield out
                    parts, size = [], 0
                parts.append((piece, i, s))
                size += len(piece)
        if parts and (out := take(parts)) is not None:
            yield out


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard of step 1: which stretches repeat as a whole, and which share an anchor with other content.

    Of an anchor that is split among shards (hot) the shard has some contents only: it is sure to repeat, and taken to
    have several contents.
    """
    anchors, contents, kept = SuffixFamily(), SuffixFamily(), []
    for batch in batches:
        anchors.add(batch.column("anchor").to_numpy().view(np.uint64))
        both = np.stack([batch.column(c).to_numpy().astype(">i8") for c in ("content", "more")], axis=1)
        contents.add(np.ascontiguousarray(both).view("S16").ravel())
        kept.append(batch)
    if not kept:
        return
    hot = np.concatenate([b.column("hot").to_numpy(zero_copy_only=False) for b in kept])
    seen, kind, at = anchors.matched() | hot, np.where(contents.matched(), _WHOLE, _MIXED).astype(np.int8), 0
    key, content = (np.concatenate([b.column(c).to_numpy() for b in kept]) for c in ("anchor", "content"))
    order = np.flatnonzero(seen)
    order = order[np.lexsort((content[order], key[order]))]
    k, c = key[order], content[order]
    new_key = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    new = new_key | np.r_[True, c[1:] != c[:-1]] if len(k) else new_key
    group = np.cumsum(new_key) - 1
    several = (np.bincount(group, weights=new, minlength=1)[group] > 1) | hot[order] if len(k) else new
    shown = order[new & several]
    kind[shown[kind[shown] == _WHOLE]] = _BOTH
    for batch in kept:
        s, k = seen[at : at + batch.num_rows], kind[at : at + batch.num_rows]
        at += batch.num_rows
        lean = [pc.if_else(pa.array(k == _WHOLE), None, batch.column(c)) for c in ("p", "anchor")]
        none = pa.nulls(batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(k), *(batch.column(c) for c in ("doc_id", "row_hash", "a", "b")), *lean, none, none], schema=_SPANS).filter(pa.array(s))


_PARTS = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("a", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("anchor", pa.int64()), ("block", pa.int64()), ("shared", pa.int64()), ("bytes", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of undecided stretches, one row each; stretches of a much shared anchor in blocks of 16 offsets from it.

    Starts at different offsets from their anchor never match, and equal strings of a block agree in what all strings of
    the block have in common (shared). Of equal strings over a block two go on, the others are known to repeat: they keep
    no bytes and go to any shard.
    """
    known: dict[tuple[int, int, bytes], int] = {}
    for batch in slices(batches, "text"):
        rows: list[int] = []
        out: list[list] = [[] for _ in _PARTS.names[2:]]
        for i, (text, spans) in enumerate(zip(texts(batch.column("text")), batch.column("spans").to_pylist())):  # noqa: B905
            for s in spans or ():
                a, b, p, anchor = s["a"], s["b"], s["p"], s["anchor"]
                if not s["hot"]:
                    parts = [(a, b, -1, None, text[a : b + length])]
                else:
                    parts = []
                    for block in range((p - b) // 16, (p - a) // 16 + 1):
                        lo, hi, at = max(a, p - 16 * block - 15), min(b, p - 16 * block), p - 16 * block
                        own = text[lo : hi + length]
                        key = (anchor, hi - lo, own)
                        n = known.get(key, 0)
                        if n < 2 and (n or len(known) < KNOWN):
                            known[key] = n + 1
                        shared = xxhash.xxh3_64_intdigest(text[at : at + length - 15]) >> 1
                        parts.append((lo, hi, block, len(rows) + 31 * lo, None) if n >= 2 else (lo, hi, block, shared, text[a : b + length]))
                for lo, hi, block, shared, own in parts:
                    rows.append(i)
                    for column, value in zip(out, (a, lo, hi, anchor, block, shared, own)):  # noqa: B905
                        column.append(value)
        if rows:
            ids = [batch.column(c).take(pa.array(rows)) for c in ("doc_id", "row_hash")]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, t) for c, t in zip(out, _PARTS.types[2:]))], schema=_PARTS)  # noqa: B905


def _match(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One shard of step 2: runs of starts whose string of full length occurs elsewhere."""
    family, kept = SuffixFamily(), []
    for all_ in slices(batches, "bytes", STEP // 3):
        known = all_.column("bytes").is_null()
        done = all_.filter(known)
        if done.num_rows:
            yield pa.RecordBatch.from_arrays([done.column(c) for c in ("doc_id", "row_hash", "lo", "hi")], names=["doc_id", "row_hash", "a", "b"])
        batch = all_.filter(all_.column("bytes").is_valid())
        if not batch.num_rows:
            continue
        a, lo, hi = (batch.column(c).to_numpy() for c in ("a", "lo", "hi"))
        strings = texts(batch.column("bytes"))
        data = np.frombuffer(b"".join(strings), np.uint8)
        base = np.cumsum([0, *map(len, strings)])[:-1]
        n = hi - lo + 1
        row = np.repeat(np.arange(len(n)), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]
        suffixes = np.lib.stride_tricks.sliding_window_view(data, length)[base[row] + start - a[row]]
        family.add(np.ascontiguousarray(suffixes).view(f"S{length}").ravel())
        kept.append((batch.select(["doc_id", "row_hash"]), row, start))
    matched, done_ = family.matched(), 0
    for rows, row, start in kept:
        m = matched[done_ : done_ + len(row)]
        done_ += len(row)
        if not m.any():
            continue
        r, s = row[m], start[m]
        new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)])
        stop = np.r_[new[1:], len(r)] - 1
        own = rows.take(pa.array(r[new]))
        yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(s[new]), pa.array(s[stop])], names=["doc_id", "row_hash", "a", "b"])


def _runs(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs [start, end) from runs of matched starts."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"] + length) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _known_by(id_col: str, text_col: str) -> tuple[Column, Column]:
    """(doc_id, row_hash) by which a row is known: the id, 0 for null, and a hash of the text and of whether the id is null."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), F.xxhash64(F.col(text_col), F.col(id_col).isNull())


def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_hash, text, no_id, spans) for every row: spans are the runs of starts (a, b) of repeated strings.

    A string repeats if it also starts anywhere else, in the same text too. Rows are known by id and content, so
    repeated ids, repeated rows and null ids (no_id, with doc_id 0) are fine: equal rows repeat each other, and each has
    the spans once. Null texts count as empty and have no spans, as have texts of under ``length`` bytes. An empty table
    gives no rows.
    """
    doc_id, row_hash = _known_by(id_col, text_col)
    src = docs.select(doc_id.alias("doc_id"), row_hash.alias("row_hash"), F.col(text_col).alias("text"), F.col(id_col).isNull().alias("no_id"))
    spans = _spans(src.select("doc_id", "row_hash", "text"), length)
    return src.repartition(partitions(docs.sparkSession), "doc_id", "row_hash").join(spans, ["doc_id", "row_hash"], "left")


def _spans(src: DataFrame, length: int) -> DataFrame:
    """(doc_id, row_hash, spans) of the rows of (doc_id, row_hash, text) that have any."""
    n = partitions(src.sparkSession)
    ddl = "kind byte, doc_id long, row_hash long, a long, b long, p long, anchor long, content long, more long"
    scanned = materialize(src.mapInArrow(lambda x: _scan(x, length), ddl), "stretches")
    to_shard = scanned.filter(f"kind = {_SHARD}")
    stretches = to_shard.count()
    shards = max(n, -(-stretches // STRETCHES))
    # At most as many anchors as twice the shards exceed half of a fair part: they are dealt by their content as well.
    sampled = to_shard.select("anchor").sample(SAMPLE, seed=7).groupBy("anchor").count()
    split = sampled.filter(F.col("count") > max(SAMPLE * stretches / shards / 2, 20)).select("anchor", F.lit(True).alias("hot"))
    to_shard = to_shard.join(F.broadcast(split), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).select(*_SPANS.names, "hot")
    dealt_by = F.when(F.col("hot"), F.xxhash64("content", "more")).otherwise(F.lit(0))
    sharded = to_shard.repartition(shards, "anchor", dealt_by).mapInArrow(_decide, ddl)
    decided = materialize(scanned.filter(f"kind <> {_SHARD}").unionByName(sharded), "decided")
    whole = decided.filter(f"kind in ({_WHOLE}, {_BOTH})").select("doc_id", "row_hash", "a", "b")
    mixed = decided.filter(f"kind in ({_MIXED}, {_BOTH})")
    hot = mixed.groupBy("anchor").count().filter(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot"))
    flagged = mixed.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    open_ = flagged.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("a", "b", "p", "anchor", "hot")).alias("spans"))
    cut = src.repartition(n, "doc_id", "row_hash").join(open_, ["doc_id", "row_hash"], "left").select("doc_id", "row_hash", "text", "spans")
    cut = cut.mapInArrow(lambda x: _cut(x, length), "doc_id long, row_hash long, a long, lo long, hi long, anchor long, block long, shared long, bytes binary")
    starts = mixed.agg(F.sum(F.col("b") - F.col("a") + 1)).first()[0] or 0
    cut = cut.repartition(max(n, -(-starts // STARTS)), "anchor", "block", "shared")
    partly = cut.mapInArrow(lambda x: _match(x, length), "doc_id long, row_hash long, a long, b long")
    return whole.unionByName(partly).groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def removal_digest(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row: what removing repeated strings leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, spans in zip(texts(batch.column("text")), batch.column("spans").to_pylist()):  # noqa: B905
                runs = _runs(spans, length)
                out.append((len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_without(text, runs)).hexdigest()))
            sizes, removed, n, sha = map(list, zip(*out))  # noqa: B905
            ids = pc.if_else(batch.column("no_id"), None, batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated_spans(docs, length, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in runs)]
    return b"".join(text[e:a] for e, a in zip(ends, [*(a for a, _ in runs), len(text)]))  # noqa: B905


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with repeated strings cut from text and n_chars set anew; every row and column stays.

    A character that a cut splits goes too. A null text stays null.
    """

    @F.arrow_udf(StringType())
    def kept(texts_: pa.Array, spans: pa.Array) -> pa.Array:
        # One text at a time as bytes.
        pairs = ((t.as_py(), s.as_py()) for t, s in zip(texts_, spans))  # noqa: B905
        return pa.array([None if t is None or s is None else _without(t.encode(), _runs(s, length)).decode(errors="ignore") for t, s in pairs], pa.string())

    # Rows travel as one struct, once: no name of theirs can clash, and each is cut where it meets its spans.
    doc_id, row_hash = _known_by("doc_id", "text")
    src = docs.select(F.struct(*docs.columns).alias("row"), doc_id.alias("id"), row_hash.alias("hash"))
    spans = _spans(docs.select(doc_id.alias("doc_id"), row_hash.alias("row_hash"), "text"), length).toDF("id", "hash", "spans")
    out = src.join(spans, ["id", "hash"], "left").select("row", F.coalesce(kept("row.text", "spans"), "row.text").alias("kept"))
    text = F.col("kept")
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])
