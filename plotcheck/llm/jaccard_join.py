"""Exact Jaccard join of word n-gram sets, by a partition of the universe and the pigeonhole principle.

Sets are put into bands by size. Within a band, hashing deals all possible n-grams to m segments. Two sets that link differ in
at most H elements, so if a set allows t(i) differing elements in segment i (-1: the segment is not looked at, 0: equal content,
1: one element more or less) and the t(i) + 1 sum to H + 1, one of its segments meets its allowance. Every set puts the content
of each segment of its own band into the index, and for the first d segments the contents with one element left out. It looks
itself up in its own band and, if smaller sets of the band below can link with it, there too.

Which segments a set looks at is decided by cost: the lists of all its signatures are counted over all sets first, and a set
then gives up its longest lists, as many as its allowance leaves. What the rest joins is a candidate; candidates are compared
by their whole sets. So no link is lost, whatever the costs say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotcheck.llm.common import mix, partitions, slices, texts
from plotcheck.llm.similar import shingles, smallest_reachable, verified_links
from plotcheck.storage import materialize

#: Bytes of text whose signatures one shard of the index holds, about.
SHARD_BYTES = 50_000_000

_LEVEL, _LESS, _PAIR, _EMPTY = 1, 2, 4, 8  # flags of a signature: band below, one element left out, segment with such, empty segment
_CUT = np.uint64(0xFFFF)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F)]


def allowed(x: np.ndarray | int, y: np.ndarray | int, percent: int) -> np.ndarray | int:
    """In how many elements two linked sets of these sizes differ at most."""
    return (100 - percent) * (x + y) // (100 + percent)


class Bands:
    """Size bands up to a largest set, each with its segments: ``upper`` sizes, ``m`` segments, of which ``d`` with one-deletion contents."""

    def __init__(self, percent: int, largest: int) -> None:
        self.percent, self.upper, self.m, self.d = percent, [0], [0], [0]
        while self.upper[-1] < largest:
            low = self.upper[-1]
            # Two steps of the least similarity in one band; sets that allow few differences are kept apart from others.
            high = max(low + 1, 10_000 * low // percent**2)
            for few in (0, 1):
                while allowed(100 * (high + 1) // percent, high + 1, percent) <= few and allowed(100 * (low + 1) // percent, low + 1, percent) == few:
                    high += 1
            need = int(allowed(100 * high // percent, high, percent)) + 1
            if need == 1 or (need == 2 and low >= 1):
                m, d = 1, need - 1
            else:
                m = need + need // 10 + 1
                d = min(m, 4 + m // 32)
            self.upper.append(high)
            self.m.append(m)
            self.d.append(d)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.upper, sizes)


def _signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, ...]:
    """(sig, owner, flags, spare) of non-empty sets; ``spare[level]``: how much allowance each can give up in its band and in the one below (-1: does not look there)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    bands = Bands(percent, int(sizes.max(initial=1)))
    upper, ms, ds = (np.array(x, np.int64) for x in (bands.upper, bands.m, bands.d))
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    value = mix(element ^ _K[2])
    low, high = (value & np.uint64(0xFFFFFFFF)).astype(np.float64), (value >> np.uint64(32)).astype(np.float64)
    whose = np.repeat(np.arange(len(sets)), sizes)
    out_sig, out_owner, out_flags, spare = [], [], [], []
    for level in (0, 1):
        band = bands.of(sizes) - level
        looks = (band >= 1) if level == 0 else (band >= 1) & (-(-percent * sizes // 100) <= upper[np.maximum(band, 0)])
        band = np.where(looks, band, 0)
        m, d = ms[band], ds[band]
        need = allowed(sizes, sizes if level == 0 else upper[band], percent) + 1
        first = np.cumsum(m) - m
        mine = looks[whose]
        w, v = whose[mine], value[mine]
        seg = ((mix(element[mine] + _K[1] * band[w].astype(np.uint64)) >> np.uint64(32)) * m[w].astype(np.uint64)) >> np.uint64(32)
        cell = first[w] + seg.astype(np.int64)
        n = int(m.sum())
        sums = [np.bincount(cell, x[mine], n).astype(np.int64).astype(np.uint64) for x in (low, high)]
        total = sums[0] + (sums[1] << np.uint64(32))
        count = np.bincount(cell, minlength=n)
        owner = np.repeat(np.arange(len(sets)), m)
        number = np.arange(n) - first[owner]
        salt = band.astype(np.uint64) * _K[0]
        sign = lambda content, o, s: (mix(content + salt[o] + s.astype(np.uint64) * _K[1]) & ~_CUT) | (s.astype(np.uint64) & _CUT)  # noqa: B023, E731
        pair = (number < d[owner]) & (count > 1)
        capacity = np.bincount(owner, (count > 0) + pair.astype(np.float64), len(sets)).astype(np.int64)
        left = capacity - need
        # Sets too narrow for their allowance look at empty segments as well; the index of the own band holds these for all.
        narrow = looks & (left < 0)
        sig = sign(total, owner, number)
        kept = (count > 0) | (narrow[owner] if level else True)
        flags = level + _PAIR * pair + _EMPTY * (count == 0)
        out_sig.append(sig[kept])
        out_owner.append(owner[kept])
        out_flags.append(flags[kept])
        dropped = pair[cell]
        out_sig.append(sign(total[cell[dropped]] - v[dropped], w[dropped], seg[dropped]))
        out_owner.append(w[dropped])
        out_flags.append(np.full(int(dropped.sum()), level + _LESS))
        # An empty segment counts once: all of them together always suffice.
        left = np.where(narrow, left + np.bincount(owner, count == 0, len(sets)).astype(np.int64), left)
        spare.append(np.where(looks, np.where(narrow, -2 - np.maximum(left, 0), np.maximum(left, 0)), -1))
    return np.concatenate(out_sig), np.concatenate(out_owner), np.concatenate(out_flags).astype(np.uint8), np.stack(spare)


def _set(text: bytes, shingle: int) -> np.ndarray:
    return shingles(text, shingle) if text.strip() else np.zeros(0, np.uint64)


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


_PARTS = (np.uint64, np.uint32, np.uint8, np.int64, np.int32, np.int32)  # sig, owner, flags | node, spare of both levels


def _unblob(data: bytes) -> list[np.ndarray]:
    at, out = 8 * len(_PARTS), []
    for n, kind in zip(np.frombuffer(data, np.int64, len(_PARTS)).tolist(), _PARTS):  # noqa: B905
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


_INDEX = "kind int, shard int, doc_id long, row_hash long, node long, n long, signatures binary"
_SHARED = "kind int, doc_id long, row_hash long, node long, n long, level int, spare int, sig long, flags int, same long, less long"


def _index(batches: Iterator[pa.RecordBatch], shingle: int, percent: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: the set of every document (node: hash of the set, n: its size). Kind 1: signatures for each shard."""
    for batch in slices(batches, "text", min(16_000_000, max(4_000_000, 80_000 * shards))):
        sets = [_set(t, shingle) for t in texts(batch.column("text"))]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        n = np.array([len(s) for s in sets])
        once = np.unique(node, return_index=True)[1]
        once = once[n[once] > 0]
        sig, owner, flags, spare = _signatures([sets[i] for i in once.tolist()], percent)
        nodes = node[once]
        # Empty segments are long lists that nobody looks at, but for narrow sets: they lie with their set, and these ask everywhere.
        empty = (flags & _EMPTY) > 0
        narrow = spare[:, owner][(flags & _LEVEL).astype(int), np.arange(len(sig))] < -1
        at = np.where(empty, nodes[owner].view(np.uint64) % np.uint64(shards), (sig >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)
        asks = np.flatnonzero(empty & narrow)
        if len(asks):
            more, where = np.repeat(asks, shards), np.tile(np.arange(shards), len(asks))
            more, where = more[where != at[more]], where[where != at[more]]
            sig, owner, at = np.r_[sig, sig[more]], np.r_[owner, owner[more]], np.r_[at, where]
            flags = np.r_[flags, flags[more] | 16]  # a question only: its list entry lies elsewhere
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(shards + 1))
        blobs, used = [], []
        for s in range(shards):
            mine = order[cuts[s] : cuts[s + 1]]
            if len(mine):
                who, local = np.unique(owner[mine], return_inverse=True)
                used.append(s)
                blobs.append(_blob(sig[mine], local.astype(np.uint32), flags[mine], nodes[who], *spare[:, who].astype(np.int32)))
        k, e = len(sets), len(blobs)
        null = pa.nulls(e, pa.int64())
        join = lambda a, b: pa.concat_arrays([a, b])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([0] * k + [1] * e, pa.int32()),
                join(pa.array((mix(batch.column("doc_id").to_numpy().view(np.uint64)) % np.uint64(shards)).astype(np.int32)), pa.array(used, pa.int32())),
                join(batch.column("doc_id").cast(pa.int64()), null),
                join(batch.column("row_hash").cast(pa.int64()), null),
                join(pa.array(node), null),
                join(pa.array(n, pa.int64()), null),
                join(pa.nulls(k, pa.binary()), pa.array(blobs, pa.binary())),
            ],
            names=[c.split()[0] for c in _INDEX.split(", ")],
        )


def _lists(blobs: list[bytes]) -> pa.RecordBatch | None:
    """Signatures of one shard that other sets have too, with the lengths of their lists in the index: contents equal, or equal with one element left out."""
    parts = [_unblob(b) for b in blobs]
    sig = np.concatenate([p[0] for p in parts])
    flags = np.concatenate([p[2] for p in parts])
    node = np.concatenate([p[3][p[1]] for p in parts])
    spare = np.concatenate([np.where(p[2] & _LEVEL, p[5][p[1]], p[4][p[1]]) for p in parts])
    # Most signatures are alone.
    order = np.argsort(sig, kind="stable")
    s = sig[order]
    again = np.zeros(len(s), bool)
    again[1:] = s[1:] == s[:-1]
    again[:-1] |= again[1:]
    order = order[again]
    sig, flags, node, spare = sig[order], flags[order], node[order], spare[order]
    order = np.lexsort((flags, node, sig))
    sig, flags, node, spare = sig[order], flags[order], node[order], spare[order]
    once = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]) | (flags[1:] != flags[:-1])][: len(sig)]
    sig, flags, node, spare = sig[once], flags[once], node[once], spare[once]
    if not len(sig):
        return None
    start = np.r_[True, sig[1:] != sig[:-1]]
    run = np.cumsum(start) - 1
    home = (flags & (_LEVEL | 16)) == 0
    whole = (flags & _LESS) == 0
    asks = ~((flags & _EMPTY > 0) & (spare >= -1))  # empty segments are looked at by narrow sets only
    per = lambda x: np.bincount(run, x, run[-1] + 1).astype(np.int64)[run]
    same, less, wholes, size = per(home & whole), per(home & ~whole), per(whole), per(np.ones(len(sig)))
    other = same - (home & whole)
    # Kept: what finds something, or can be found by some question.
    keep = (per(asks) > 0) & np.where(whole, (other + less > 0) & asks | home & (size > 1), (same > 0) & asks | home & (wholes > 0))
    if not keep.any():
        return None
    k = int(keep.sum())
    null = pa.nulls(k, pa.int64())
    longs = lambda x: pa.array(x[keep].astype(np.int64))
    ints = lambda x: pa.array(x[keep].astype(np.int32))
    columns = [pa.array(np.ones(k, np.int32)), null, null, longs(node), null, ints(flags & _LEVEL), ints(spare), pa.array(sig[keep].view(np.int64)), ints(flags), longs(np.where(whole, other, same)), longs(np.where(whole, less, 0))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SHARED.split(", ")])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard: sets pass, signatures become lists."""
    shard, blobs = None, []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        kind = t.column("kind").to_numpy()
        sets = t.filter(pa.array(kind == 0))
        if sets.num_rows:
            k = sets.num_rows
            null, none = pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32())
            cols = [sets.column(c).combine_chunks() for c in ("doc_id", "row_hash", "node", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), *cols, none, none, null, none, null, null], names=[c.split()[0] for c in _SHARED.split(", ")])
        parts = t.filter(pa.array(kind == 1))
        for s, b in zip(parts.column("shard").to_pylist(), parts.column("signatures").to_pylist()):  # noqa: B905
            if s != shard and blobs:
                out = _lists(blobs)
                blobs = []
                if out is not None:
                    yield out
            shard = s
            blobs.append(b)
    if blobs and (out := _lists(blobs)) is not None:
        yield out


def _allocate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each set looks up. Rows come sorted by (node, level, segment); of the lists that cost most it gives up as many as it can spare.

    A segment with one-deletion contents has an allowance of two: one for equal contents, a second for one element more or less.
    """

    def decide(t: pa.Table) -> pa.RecordBatch:
        node, level, spare, sig, flags, same, less = (t.column(c).to_numpy() for c in ("node", "level", "spare", "sig", "flags", "same", "less"))
        seg = sig & 0xFFFF
        group = np.cumsum(np.r_[True, (node[1:] != node[:-1]) | (level[1:] != level[:-1])]) - 1
        part = np.cumsum(np.r_[True, (np.diff(group) > 0) | (seg[1:] != seg[:-1])]) - 1
        whole = (flags & _LESS) == 0
        n = part[-1] + 1
        first = np.bincount(part, np.where(whole, same, 0), n)
        second = np.bincount(part, np.where(whole, np.where(flags & _PAIR, less, 0), same), n)
        pair = np.bincount(part, (flags & (_PAIR | _LESS)) > 0, n) > 0
        of = np.zeros(n, np.int64)
        of[part] = group
        can = np.zeros(group[-1] + 1, np.int64)
        can[group] = np.where(spare < -1, -2 - spare, spare)
        # Items to give up: (segment, saving, allowance). A second allowance goes before, or with, the first.
        one = np.flatnonzero((first > 0) & (~pair | (second >= first)))
        two = np.flatnonzero(pair & (second > 0) & (second >= first))
        both = np.flatnonzero(pair & (first > second))
        item = np.r_[two, one, both]
        saving = np.r_[second[two], first[one], (first[both] + second[both]) / 2]
        weight = np.r_[np.ones(len(two) + len(one), np.int64), np.full(len(both), 2)]
        order = np.lexsort((np.arange(len(item)), -saving, of[item]))
        item, weight = item[order], weight[order]
        owner = of[item]
        used = np.cumsum(weight)
        begin = np.searchsorted(owner, np.arange(group[-1] + 1))
        before = np.r_[0, used][begin]
        used -= before[owner]
        given = np.zeros(n, np.int64)
        done = used <= can[owner]
        np.add.at(given, item[done], weight[done])
        # One allowance that is left over takes the second of a segment whose two did not fit.
        tail = np.flatnonzero(~done & (used - weight < can[owner]))
        given[item[tail]] += 1
        keeps = np.where(pair, 2, 1) - given
        asks = np.where(whole, (keeps[part] >= 1) & (same > 0) | (keeps[part] == 2) & (less > 0), (keeps[part] == 2) & (same > 0))
        asks &= ~((flags & _EMPTY > 0) & (spare >= -1))
        role = np.where(whole, np.where((keeps[part] == 2) & (less > 0), 3, 1), 4)
        home = ((flags & (_LEVEL | 16)) == 0) & ~asks
        out = asks | home
        role = np.where(asks, role, 0) + 8 * ((flags & (_LEVEL | 16)) == 0) + 16 * ~whole
        return pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(node[out]), pa.array(role[out].astype(np.int32))], names=["sig", "node", "role"])

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        node = t.column("node").to_numpy()
        cut = int(np.argmax(node == node[-1]))
        if cut:
            yield decide(t.slice(0, cut))
        rest = t.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield decide(rest)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join the sets which a question of some signature finds; rows come sorted by signature."""

    def links(t: pa.Table) -> pa.RecordBatch:
        sig, node, role = (t.column(c).to_numpy() for c in ("sig", "node", "role"))
        run = np.cumsum(np.r_[True, sig[1:] != sig[:-1]]) - 1
        asks, home, less = role & 7, (role & 8) > 0, (role & 16) > 0
        out = []
        # (who asks, whom it finds): equal contents; own content against those with one element left out; and the other way round.
        for who, whom in (((asks & 1) > 0, home & ~less), (asks == 3, home & less), (asks == 4, home & ~less)):
            hit = np.bincount(run, who)[run] > 0
            member = hit & (who | whom)
            r, v = run[member], node[member]
            if not len(r):
                continue
            start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            hub = np.repeat(np.minimum.reduceat(v, start), np.diff(np.r_[start, len(r)]))
            out.append(np.stack([v, hub], axis=1)[v != hub])
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        last = t.column("sig").to_numpy()
        cut = int(np.argmax(last == last[-1]))
        if cut:
            yield links(t.slice(0, cut))
        rest = t.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield links(rest)


def _sizes(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Rows without an id: the size of their set."""
    for batch in slices(batches, "text"):
        n = [len(_set(t, shingle)) for t in texts(batch.column("text"))]
        null = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([null, pa.array(n, pa.int64()), null], names=["doc_id", "n_shingles", "component_id"])


def similar_sets(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    A text's set: its distinct runs of ``shingle`` words (A-Z lower-cased); with fewer words the whole sequence; none for null,
    empty and blank texts, which link with nothing. Texts link if 100 * intersection >= ``percent`` * union. component_id is the
    smallest doc_id reachable, itself included. Equal sets are compared once. A row without id keeps a null component and links
    nothing. Rows that repeat an id each get a row, with the component of their own text. N-grams and sets are told apart by
    64-bit hashes. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions(spark), -(-size // SHARD_BYTES))
    # Rows without id have a set, but put nothing into the index.
    lone = src.filter("doc_id IS NULL")
    found = src.filter("doc_id IS NOT NULL").mapInArrow(lambda b: _index(b, shingle, percent, shards), _INDEX)
    dealt = found.repartitionById(shards, "shard").sortWithinPartitions("shard")
    table = materialize(dealt.mapInArrow(_count, _SHARED), "lists")
    sets = table.filter("kind = 0").select("doc_id", "row_hash", "node", "n")
    lists = table.filter("kind = 1")
    asked = lists.select("node", "level", "spare", "sig", "flags", "same", "less").repartition(partitions(spark), "node")
    asked = asked.sortWithinPartitions("node", "level", F.col("sig").bitwiseAND(F.lit(0xFFFF)))
    met = asked.mapInArrow(_allocate, "sig long, node long, role int").repartition(partitions(spark), "sig").sortWithinPartitions("sig")
    candidates = smallest_reachable(met.mapInArrow(_meet, "a long, b long"))
    known = materialize(sets.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "row_hash")).alias("one")).select("node", F.col("one.doc_id").alias("rep"), F.col("one.row_hash").alias("row_hash")), "texts")
    roots = verified_links(src, known, materialize(candidates, "near"), percent / 100, shingle)
    chained = known.join(roots, "node").select("node", "root", "rep")
    first = chained.join(chained.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("node", "component_id")
    known = known.select("node", "rep").join(first, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    out = sets.join(known, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(lone.mapInArrow(lambda b: _sizes(b, shingle), "doc_id long, n_shingles long, component_id long"))
