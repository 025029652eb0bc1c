"""Texts of high five-word Jaccard similarity: candidates by wide SimHash fingerprints and pivot tables, each group checked exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotcheck.llm.common import partitions, random_words, slices, texts
from plotcheck.llm.fingerprints import BITS, fingerprint
from plotcheck.storage import materialize

WORDS = BITS // 64
#: Reference fingerprints of the distance table.
PIVOTS = random_words(6 * WORDS, seed=3).reshape(6, WORDS)
#: Bits in which candidates differ at most. A similarity of 0.8 lies near 26 bits where edits are spread, near 38 where one stretch is gone.
RADIUS = 56
#: Fingerprints of a cell that one task compares with each other at most.
CELL = 4096
#: Shingles of a candidate group's texts that one task holds, about, and compares with each other at most.
GROUP = 150_000

_FP = [f"f{i}" for i in range(WORDS)]


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """Distinct XXH64 values of the runs of ``n`` words, sorted; fewer words make one run, no word makes an empty one."""
    words = text.lower().split()
    line = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    first, last = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)]
    return np.unique(np.array([xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(first, last[n - 1 :])], np.uint64))  # noqa: B905


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows that come sorted by ``keys``, one table for each value of them."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        key = np.stack([t.column(k).to_numpy() for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):  # noqa: B905
            yield t.slice(a, b - a)
        rest = t.slice(cuts[-1]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def _many_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows that come sorted by ``keys``, cut only between different values of them."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        last = np.ones(t.num_rows, bool)
        for k in keys:
            col = t.column(k).to_numpy()
            last &= col == col[-1]
        cut = int(np.argmax(last))  # the last run may go on
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def _chain(t: pa.Table, radius: int) -> pa.RecordBatch:
    """Links that chain all pairs within ``radius`` bits of each run of equal (cell, part); rows come sorted by these."""
    cell, part, node = (t.column(c).to_numpy() for c in ("cell", "part", "node"))
    fp = np.stack([t.column(c).to_numpy() for c in _FP], axis=1).view(np.uint64)
    new = np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])]
    run = np.cumsum(new) - 1
    table = np.bitwise_count(fp[:, None, :] ^ PIVOTS[None]).sum(axis=2, dtype=np.int16)
    label, out = np.arange(len(fp)), []
    at, step = np.arange(len(fp) - 1), 1
    while len(at):
        at = at[at + step < len(fp)]
        at = at[run[at] == run[at + step]]
        open_ = at[label[at] != label[at + step]]
        near = open_[np.abs(table[open_] - table[open_ + step]).max(axis=1, initial=0) <= radius]  # the pivots' lower bound
        met = near[np.bitwise_count(fp[near] ^ fp[near + step]).sum(axis=1, dtype=np.int16) <= radius]  # the survivors
        fresh = False
        for p in met.tolist():
            i, j = p, p + step
            while label[i] != i:
                i = label[i]
            while label[j] != j:
                j = label[j]
            if i != j:
                label[max(i, j)] = min(i, j)
                out.append((p, p + step))
                fresh = True
        while fresh and ((flat := label[label]) != label).any():
            label = flat
        step += 1
    return _links(node, out)


def _alike(sets: list[np.ndarray], least: float, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all pairs whose sets have a Jaccard similarity of ``least`` or more; pairs of one label need none."""
    sizes = np.array([len(x) for x in sets])
    left, out = np.arange(len(sets)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            u = queue.pop()
            if label is not None:
                same = label[left] == label[u]
                queue += left[same].tolist()  # already joined: reached without a link
                left = left[~same]
            near = left[(sizes[left] >= least * sizes[u] - 1e-9) & (least * sizes[left] <= sizes[u] + 1e-9)]
            if not len(near):
                continue
            values = np.concatenate([sets[v] for v in near.tolist()])
            at = np.minimum(np.searchsorted(sets[u], values), sizes[u] - 1)
            both = np.add.reduceat((sets[u][at] == values).astype(np.int64), np.r_[0, np.cumsum(sizes[near])[:-1]])
            met = near[both >= least * (sizes[near] + sizes[u] - both) - 1e-9]
            if len(met):
                out += [(u, v) for v in met.tolist()]
                queue += met.tolist()
                left = np.setdiff1d(left, met, assume_unique=True)
    return out


def _links(node: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]], pa.int64()), pa.array(node[at[:, 1]], pa.int64())], names=["a", "b"])


#: Parts in which rows of one key meet what is known of the key.
SALTS = 16


def _known_of(rows: DataFrame, facts: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row of ``facts`` of their ``key``; the rows of a crowded key are dealt out by ``by``."""
    each = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by, F.lit(3)), F.lit(SALTS)).cast("int")).join(each, [key, "__salt"], how).drop("__salt")


def _deal(rows: DataFrame, key: str, most: int, sort: str, weight: Column | None = None) -> DataFrame:
    """Rows of one ``key`` together; if they weigh over ``most`` (one each, if not given), as all pairs of parts, each pair a run of its own (column part)."""
    hot = rows.groupBy(key).agg(F.sum(weight if weight is not None else F.lit(1)).alias("n")).filter(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("parts"))
    own = F.coalesce(F.pmod(F.xxhash64(sort, F.lit(7)), F.col("parts")).cast("int"), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(F.col("own"), o) * F.col("parts") + F.greatest(F.col("own"), o))
    dealt = _known_of(rows, hot, key, sort, "left").withColumn("own", own)
    dealt = dealt.select(*rows.columns, F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("part"))
    return dealt.repartition(partitions(rows.sparkSession), key, "part").sortWithinPartitions(key, "part")


def candidate_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that chain the nodes (node, f0, f1, ...) which share 16 bits at some byte of the fingerprint and lie within ``radius`` bits."""

    def window(k: int) -> Column:
        byte = lambda i: F.shiftrightunsigned(F.col(_FP[i // 8]), 8 * (i % 8)).bitwiseAND(F.lit(255))
        return byte(k) * 256 + byte((k + 1) % (BITS // 8)) + (k << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _many_runs(batches, ("cell", "part")):
            yield _chain(t, radius)

    cells = nodes.select("node", *_FP, F.explode(F.array(*[window(k) for k in range(BITS // 8)])).alias("cell"))
    return _deal(cells, "cell", CELL, "node").mapInArrow(run, "a long, b long").distinct()


def smallest_reachable(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node reachable over ``links`` (a, b), for every node of them.

    Large-star and small-star rounds as in ``graph.connected_components``, but the least neighbour is found by a window: a
    round shuffles each link twice, and once more to drop repeated ones.
    """
    e = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    nodes, before = materialize(nodes, "nodes"), None
    least = F.min("v").over(W.partitionBy("u"))
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("m", F.least("u", least)).filter("v > u")
        large = both.select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", least).select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        e = materialize(small.filter("u <> v").distinct(), "links", replaces=e)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("u")).first())
        if now == before and now[0] == now[2]:
            return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        before = now
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def _labels(node: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """For each node the smallest one that ``pairs`` (of numbers) join it to."""
    up = list(range(len(node)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs:
        up[top(i)] = top(j)
    roots = np.array([top(i) for i in range(len(node))], np.int64)
    low = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(low, roots, node)
    return low[roots]


def verified_links(src: DataFrame, known: DataFrame, near: DataFrame, least: float, shingle: int) -> DataFrame:
    """(node, root) of the nodes of ``near`` (node, root: what candidates chain together): the smallest node reachable over pairs of similarity ``least`` or more.

    ``src``: (doc_id, row_hash, text); ``known``: (node, rep, row_hash) names the row of it whose text stands for a node.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own = [shingles(t, shingle).view(np.int64) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), pa.array(own, pa.list_(pa.int64()))], names=["node", "root", "runs"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
        for t in _runs((b for batch in batches for b in slices_of_lists(batch)), ("root", "part")):
            yield t, [x.values.to_numpy().view(np.uint64) for x in t.column("runs").combine_chunks()]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, root, label, parts): what a part joins by itself."""
        for t, runs in groups(batches):
            label = _labels(t.column("node").to_numpy(), _alike(runs, least))
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("node", "root")), pa.array(label), t.column("parts").combine_chunks()], names=["node", "root", "label", "parts"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between labels."""
        for t, runs in groups(batches):
            label = t.column("label").to_numpy()
            yield _links(label, _alike(runs, least, label))

    chosen = near.join(known.select("node", "rep", F.col("row_hash").alias("hash")), "node")
    mine = src.join(chosen, (src.row_hash == chosen.hash) & (src.doc_id == chosen.rep)).select("node", "root", "text")
    held = materialize(mine.mapInArrow(sets, "node long, root long, runs array<long>").dropDuplicates(["node"]), "sets")
    # A group that one task can hold is settled at once. A larger one is settled part by part; parts of near copies leave few
    # labels. Then one text of each label meets those of the other parts, and only groups that are still apart compare all.
    weight = F.size("runs")
    parts = held.groupBy("root").agg(F.sum(weight).alias("n")).select("root", F.greatest(F.ceil(F.col("n") / GROUP), F.lit(1)).cast("int").alias("parts"))
    own = _known_of(held, parts, "root", "node").withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    local = own.select("node", "root", "runs", "parts", "part").repartition(partitions(src.sparkSession), "root", "part").sortWithinPartitions("root", "part")
    done = materialize(local.mapInArrow(settle, "node long, root long, label long, parts int"), "settled")
    large = done.filter("parts > 1").select("node", "root", "label")
    if large.isEmpty():
        return done.select("node", F.col("label").alias("root"))
    rows = held.select("node", "runs").join(large, "node").select("node", "root", "runs", "label")
    links = materialize(_deal(rows.filter("node = label"), "root", GROUP, "node", weight).mapInArrow(join, "a long, b long"), "joined")

    def renamed(labels: DataFrame, found: DataFrame) -> DataFrame:
        """(node, root, label): every label as the smallest one that ``found`` joins it to."""
        top = smallest_reachable(found).select(F.col("node").alias("label"), F.col("root").alias("top"))
        return labels.join(top, "label", "left").select("node", "root", F.coalesce("top", "label").alias("label"))

    large = materialize(renamed(large, links), "labels")
    apart = large.groupBy("root").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("root")
    rows = _known_of(held.select("node", "runs").join(large, "node"), apart, "root", "node").select("node", "root", "runs", "label")
    more = materialize(_deal(rows, "root", GROUP, "node", weight).mapInArrow(join, "a long, b long"), "joined")
    if not more.isEmpty():
        large = renamed(large, more)
    return done.filter("parts = 1").select("node", F.col("label").alias("root")).unionByName(large.select("node", F.col("label").alias("root")))


def similar_groups(docs: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """(row_hash, component_id) for every distinct text that has a doc_id.

    component_id is the smallest doc_id of the texts reachable over pairs of Jaccard similarity ``least`` or more of their
    sets of ``shingle`` words. Texts without words are alike. Candidates meet as candidate_links says; whatever chains of
    candidates join is compared exactly, so no link is false and a missed candidate is the only way to miss one.
    """

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fp = np.frombuffer(b"".join(fingerprint(t) for t in texts(batch.column("text"))), np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), *(pa.array(np.ascontiguousarray(fp[:, i])) for i in range(WORDS))], names=["doc_id", "row_hash", *_FP])

    src = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    fps = materialize(src.mapInArrow(wide, "doc_id long, row_hash long, " + ", ".join(f"{c} long" for c in _FP)), "wide")
    known = materialize(fps.groupBy(F.col("row_hash").alias("node")).agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in _FP]), "texts")
    near = materialize(smallest_reachable(candidate_links(known)), "near")
    roots = verified_links(src, known.withColumn("row_hash", F.col("node")), near, least, shingle)
    joined_ = known.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    first = joined_.groupBy("root").agg(F.min("rep").alias("component_id"))
    return joined_.join(first, "root").select(F.col("node").alias("row_hash"), "component_id")


def slices_of_lists(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def keep_one_per_group(docs: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their text's group; of rows that repeat it, one. Rows without doc_id stay."""
    first = similar_groups(docs, least, shingle).select(F.col("component_id").alias("id"), F.col("row_hash").alias("hash"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    kept = packed.filter("id IS NOT NULL").join(first, ["id", "hash"], "left_semi").dropDuplicates(["id"])
    return kept.select("row").unionByName(packed.filter("id IS NULL").select("row")).select("row.*")
