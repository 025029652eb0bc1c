"""Packing documents into sequences of fixed length with best fit and swap-based local search."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotcheck.llm.common import slices
from plotcheck.llm.tokens import CACHED, encoder
from plotcheck.storage import materialize

#: Pieces that one task packs together, about.
GROUP = 20_000


def pieces(docs: DataFrame, path: str, split: str, length: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids with ``end_id`` appended, cut only where longer than ``length``.

    The first piece takes what is not a multiple of ``length``. Null and empty texts have the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, split, cached), end_id.to_bytes(4, "little")
        for batch in slices(batches, "text"):
            rows, piece, start, size, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = enc.ids(text or "") + end
                n = len(ids) // 4
                first = n % length or length
                for k, s in enumerate([0, *range(first, n, length)]):
                    e = s + (length if k else first)
                    rows.append(i)
                    piece.append(k)
                    start.append(s)
                    size.append(e - s)
                    crc.append(zlib.crc32(ids[4 * s : 4 * e]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Bins:
    """Bins of item numbers, and an index of the underfull ones by the sizes, and sums of two sizes, that they hold."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Largest items first, each into the bin that it fills most."""
        room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        open_ = 0  # bit r: some bin has room r
        for i in sorted(range(len(self.sizes)), key=lambda i: -self.sizes[i]):
            s = self.sizes[i]
            fits = open_ >> s
            if fits:
                r = s + (fits & -fits).bit_length() - 1
                b = room[r].pop()
                if not room[r]:
                    open_ &= ~(1 << r)
            else:
                b, r = len(self.bins), self.capacity
                self.bins.append([])
                self.fill.append(0)
            self.bins[b].append(i)
            self.fill[b] += s
            room[r - s].append(b)
            open_ |= 1 << (r - s)

    def _list(self, b: int) -> None:
        """Enter a bin's sizes and pair sums into the index; earlier entries of it no longer count."""
        self.stamp[b] += 1
        if not 0 < self.fill[b] < self.capacity:
            return
        entry = (self.fill[b], b, self.stamp[b])
        own = sorted(Counter(self.sizes[i] for i in self.bins[b]).items())
        for at, (s, n) in enumerate(own):
            self._enter(0, s, entry)
            for t, _ in own[:at]:
                self._enter(1, s + t, entry)
            if n > 1:
                self._enter(1, 2 * s, entry)

    def _enter(self, which: int, size: int, entry: tuple[int, int, int]) -> None:
        heapq.heappush(self.holders[which].setdefault(size, []), entry)
        self.held[which] |= 1 << size

    def _other(self, which: int, size: int, b: int) -> int | None:
        """The emptiest bin but b that holds this size (or sum of two), if it is no fuller than b."""
        heap = self.holders[which].get(size)
        aside = None
        found = None
        while heap:
            fill, c, stamp = heap[0]
            if stamp != self.stamp[c]:
                heapq.heappop(heap)
            elif c == b:
                aside = heapq.heappop(heap)
            else:
                found = c if fill <= self.fill[b] else None
                break
        if aside:
            heapq.heappush(heap, aside)
        elif not heap:
            self.held[which] &= ~(1 << size)
        return found

    def _best_step(self, b: int) -> tuple[int, int | None, int, int] | None:
        """(gain, size that leaves b or None, size or sum that enters, bin it comes from) of the step that fills b most."""
        gap, best = self.capacity - self.fill[b], None
        for out in (None, *sorted({self.sizes[i] for i in self.bins[b]})):
            x = out or 0
            for which in (0, 1):
                options = self.held[which] & ((1 << (x + gap + 1)) - 1)
                while options:
                    size = options.bit_length() - 1
                    if size - x <= (best[0] if best else 0):
                        break
                    c = self._other(which, size, b)
                    if c is not None:
                        best = (size - x, out, size if which == 0 else -size, c)
                        break
                    options &= ~(1 << size)
            if best and best[0] == gap:
                break
        return best

    def _take(self, c: int, size: int) -> list[int]:
        """Numbers of the item of this size in a bin, or (negative size) of two items with this sum."""
        own = self.bins[c]
        if size > 0:
            return [next(i for i in own if self.sizes[i] == size)]
        seen: dict[int, int] = {}
        for i in own:
            if -size - self.sizes[i] in seen:
                return [seen[-size - self.sizes[i]], i]
            seen[self.sizes[i]] = i
        raise LookupError(size)

    def _put(self, i: int, old: int, new: int) -> None:
        self.bins[old].remove(i)
        self.bins[new].append(i)
        self.fill[old] -= self.sizes[i]
        self.fill[new] += self.sizes[i]

    def improve(self) -> None:
        """Local search until no step is left: an underfull bin, fullest first, takes from a no fuller one by a move, a
        swap of one for one, or of two for one, whichever fills it most. Every step raises the sum of squared fills, so
        that the search ends; bins that give all they hold are empty."""
        n = len(self.bins)
        self.stamp = [0] * n
        self.holders: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.held = [0, 0]  # bit s: some underfull bin may hold size (or sum) s
        for b in range(n):
            self._list(b)
        changed = True
        while changed:
            changed = False
            for b in sorted((b for b in range(n) if 0 < self.fill[b] < self.capacity), key=lambda b: (-self.fill[b], b)):
                while 0 < self.fill[b] < self.capacity and (step := self._best_step(b)) is not None:
                    _, out, size, c = step
                    leaves = self._take(b, out) if out else []
                    for i in self._take(c, size):
                        self._put(i, c, b)
                    for i in leaves:
                        self._put(i, b, c)
                    self._list(b)
                    self._list(c)
                    changed = True


def pack(sizes: list[int], capacity: int, search: bool = True) -> list[list[int]]:
    """Bins of item numbers, each of at most ``capacity``; sizes lie in 1..capacity. Without ``search``, best fit alone."""
    packed = _Bins(sizes, capacity)
    packed.best_fit()
    if search:
        packed.improve()
    return [b for b in packed.bins if b]


def _place(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    all_ = [b for b in batches if b.num_rows]
    if not all_:
        return
    t = pa.Table.from_batches(all_)
    size = t.column("length").to_numpy()
    # A fixed order, so that a task that runs again places alike.
    order = np.lexsort((t.column("ids_crc32").to_numpy(), t.column("piece").to_numpy(), t.column("doc_id").fill_null(0).to_numpy(), t.column("doc_id").is_null().to_numpy(), -size))
    seq, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    for k, members in enumerate(pack(size[order].tolist(), length)):
        at = 0
        for i in members:
            seq[order[i]], offset[order[i]] = k, at
            at += size[order[i]]
    seq += TaskContext.get().partitionId() << 40
    for at in range(0, t.num_rows, 50_000):
        piece = t.slice(at, 50_000)
        out = piece.append_column("sequence_id", pa.array(seq[at : at + 50_000])).append_column("offset", pa.array(offset[at : at + 50_000]))
        yield from out.combine_chunks().to_batches()


def best_fit_pack(docs: DataFrame, path: str, split: str = "space", length: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED) -> DataFrame:
    """Every piece of every document with its sequence and place.

    A piece that fills a sequence stands alone, with a negative number, and is never shuffled. The others are dealt
    evenly to groups of about GROUP, each packed by one task: the loss against packing all together is under a
    sequence for each group. A sequence has no gap. Rows that repeat an id, or have none, are documents of their own.
    An empty table gives no rows. ``cached`` words are kept with their ids in each Python worker.
    """
    cut = materialize(pieces(docs, path, split, length, end_id, id_col, text_col, cached), "pieces")
    short = F.col("length") < length
    groups = max(1, round(cut.filter(short).count() / GROUP))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    alone = cut.filter(~short).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # By place in the written table, not by content: equal rows must not meet in one group.
    dealt = cut.filter(short).withColumn("nth", F.monotonically_increasing_id()).repartition(groups, F.xxhash64("nth")).drop("nth")
    return dealt.mapInArrow(lambda b: _place(b, length), schema).unionByName(alone)
