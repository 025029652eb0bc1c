"""Near-duplicate groups by SimHash, with links found through pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotcheck.llm.common import partitions, random_words, slices, texts
from plotcheck.operators.graph import connected_components
from plotcheck.storage import materialize

BITS = 64
#: Reference fingerprints of the distance table.
PIVOTS = random_words(12, seed=3)
#: Distinct fingerprints that one task compares with each other at most.
CELL = 4096

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_OFFSETS = (256 * np.arange(8)).astype(np.intp)


def simhash(text: bytes, shingle: int) -> int:
    """64-bit SimHash of the shingles of ``text`` (bytes of UTF-8), as a signed integer; 0 without words.

    Words are runs of non-white-space with A-Z lower-cased; fewer words than ``shingle`` make one shingle; each
    occurrence counts. A bit is 1 if it is set in over half of the shingles' XXH64 values (seed 42).
    """
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(line, 42)], dtype=np.uint64)
    else:
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        first, last = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)]
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(line[a:b], 42) for a, b in zip(first, last[shingle - 1 :])], dtype=np.uint64)  # noqa: B905
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    bits = 2 * (counts @ _BYTE_BITS) > len(h)
    return int(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_hash, fp): the SimHash of every whole text as a signed long, with a hash of the text. Null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = pa.array([simhash(t, shingle) for t in texts(batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), fps], names=["doc_id", "row_hash", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_hash"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, row_hash long, fp long")


def _blocks(n: int, radius: int) -> int:
    """How many bit blocks to use, so that a cell of blocks that must agree holds few of ``n`` spread fingerprints."""
    blocks = radius + 2
    while blocks < radius + 6 and n >> (BITS * (blocks - radius) // blocks) > 16:
        blocks += 1
    return blocks


def _link(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of each cell; rows come sorted by cell and by distance to the first pivot."""
    rest = None

    def links(t: pa.Table) -> pa.RecordBatch:
        cell, rep = (t.column(c).to_numpy() for c in ("cell", "rep"))
        part = t.column("part").to_numpy()
        fp = t.column("fp").to_numpy().view(np.uint64)
        n = len(fp)
        table = np.bitwise_count(fp[:, None] ^ PIVOTS).astype(np.int8)
        first = table[:, 0]
        label = np.arange(n)
        out_a, out_b = [], []
        at, step = np.arange(n - 1), 1
        while len(at):
            at = at[at + step < n]
            to = at + step
            at = at[(cell[at] == cell[to]) & (part[at] == part[to]) & (first[to] - first[at] <= radius)]
            to = at + step
            open_ = label[at] != label[to]
            x, y = at[open_], to[open_]
            near = np.abs(table[x] - table[y]).max(axis=1, initial=0) <= radius  # the pivots' lower bound
            x, y = x[near], y[near]
            close = np.bitwise_count(fp[x] ^ fp[y]) <= radius  # the survivors
            for p, q in zip(x[close].tolist(), y[close].tolist()):  # noqa: B905
                i, j = p, q
                while label[i] != i:
                    i = label[i]
                while label[j] != j:
                    j = label[j]
                if i != j:
                    label[max(i, j)] = min(i, j)
                    out_a.append(rep[p])
                    out_b.append(rep[q])
            if close.any():
                while (flat := label[label]).tolist() != label.tolist():
                    label = flat
            step += 1
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if t.num_rows < 2:
            rest = t
            continue
        cell, part = t.column("cell").to_numpy(), t.column("part").to_numpy()
        same = (cell == cell[-1]) & (part == part[-1])  # the last cell may go on
        cut = int(np.argmax(same))
        if cut:
            yield links(t.slice(0, cut))
        rest = t.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows > 1:
        yield links(rest)


def fingerprint_links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) that join all fingerprints within ``radius`` bits, as chains, never all pairs.

    ``distinct``: (fp, rep), each fingerprint once with the id that stands for it. The 64 bits are cut into
    blocks; two fingerprints within the radius agree in all but ``radius`` of them, so each choice of agreeing
    blocks is one table of cells, and no pair is lost. In a cell, pairs whose distances to some reference
    fingerprint differ by more than the radius are discarded and the rest are verified. A cell of over CELL
    fingerprints is dealt out as pairs of parts to several tasks.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    blocks = _blocks(max(n, 1), radius)
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    tables = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(sum(masks[i] for i in chosen))))) for k, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    cells = distinct.select("fp", "rep", F.explode(F.array(*tables)).alias("cell"))
    hot = cells.groupBy("cell").count().filter(F.col("count") > CELL).select("cell", F.ceil(F.col("count") / CELL).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(F.col("own"), o) * F.col("parts") + F.greatest(F.col("own"), o))
    dealt = cells.join(hot, "cell", "left").withColumn("own", F.coalesce(own, F.lit(0)))
    dealt = dealt.select("cell", "fp", "rep", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("part"))
    by_pivot = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(PIVOTS[:1].view(np.int64)[0]))))
    dealt = dealt.repartition(partitions(spark), "cell", "part").sortWithinPartitions("cell", "part", by_pivot)
    return dealt.mapInArrow(lambda b: _link(b, radius), "a long, b long").distinct()


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_hash, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits, itself
    included. Null, empty and blank texts have fingerprint 0 and link like any other; equal fingerprints are
    compared once, through their smallest id. A row without id keeps a null component and links nothing. Rows
    that repeat an id each get a row, with the component of its own text. Other columns of ``docs`` are not read; an empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    known = materialize(fps.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = connected_components(fingerprint_links(known, radius))
    groups = known.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = fps.join(groups, "fp", "left")
    return out.select("doc_id", "row_hash", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one_per_group(docs: DataFrame, shingle: int = 5, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their text's group; rows without doc_id stay.

    Of rows that repeat that id, one stays.
    """
    first = near_duplicate_groups(docs, shingle, radius).filter("doc_id = component_id").select(F.col("doc_id").alias("id"), F.col("row_hash").alias("hash")).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    kept = packed.filter("id IS NOT NULL").join(first, ["id", "hash"], "left_semi").dropDuplicates(["id"])
    return kept.select("row").unionByName(packed.filter("id IS NULL").select("row")).select("row.*")
