"""SimHash document fingerprints and their search through permuted block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotcheck.llm.common import in_order, mix, random_words, slices
from plotcheck.storage import materialize

#: Bits of a fingerprint.
BITS = 256
#: Words in a term.
TERM = 2
#: Fingerprints of one key of a block table that stay together.
HOT = 10_000

_LETTERS = random_words(256, seed=29)
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0xD1342543DE82EF95


def _term_hashes(text: bytes) -> np.ndarray:
    """One uint64 for each run of TERM words (fewer words: one for all)."""
    data = np.frombuffer(text.lower(), np.uint8)
    word = np.r_[False, ~_WHITE[data], False]
    change = np.flatnonzero(word[1:] != word[:-1])
    first, last = change[::2], change[1::2]
    if not len(first):
        return np.zeros(0, np.uint64)
    # Each letter is scrambled with its place in its word; a word is the sum of its letters.
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.r_[0, first[1:], len(data)]))
    codes = mix(_LETTERS[data] + place.astype(np.uint64) * np.uint64(_BASE))
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(codes, dtype=np.uint64)]
    words = mix(total[last] - total[first])
    k = min(TERM, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(_BASE) + words[j : len(words) - k + 1 + j])
    return out


def fingerprint(text: bytes) -> bytes:
    """BITS bits: every term's hash votes for or against each bit, with the weight 1 + ln of its count. No word: all zero."""
    terms, counts = np.unique(_term_hashes(text), return_counts=True)
    if not len(terms):
        return bytes(BITS // 8)
    weight = (1 + np.log(counts)).astype(np.float32)
    words = np.stack([terms, *(mix(terms ^ np.uint64(0xA5A5A5A5 * (j + 1))) for j in range(BITS // 64 - 1))], axis=1)
    votes = np.zeros(BITS, np.float64)
    for at in range(0, len(terms), 4096):
        bits = np.unpackbits(words[at : at + 4096].view(np.uint8), axis=1).astype(np.float32)
        votes += weight[at : at + 4096] @ bits
    return np.packbits(2 * votes > weight.sum(dtype=np.float64)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) as hex, for every row; null and blank texts have all bits zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = [fingerprint((t or "").encode()).hex() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fingerprint"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, fingerprint string")


def _block_tables(column: Column, blocks: int, radius: int) -> Column:
    """One key for every choice of ``radius`` blocks left out: fingerprints within the radius share one at least."""
    edges = [BITS // 4 * k // blocks for k in range(blocks + 1)]
    part = [F.substring(column, 1 + a, b - a) for a, b in zip(edges, edges[1:])]  # noqa: B905
    return F.array(*[F.xxhash64(F.lit(i), *(part[k] for k in kept)) for i, kept in enumerate(combinations(range(blocks), blocks - radius))])


def _blocks(n: int, radius: int) -> int:
    """How many blocks to cut, so that a table's key of those that must agree tells ``n`` spread fingerprints apart."""
    blocks = radius + 1
    while blocks < radius + 3 and n >> min(BITS * (blocks - radius) // blocks, 62) > 16:
        blocks += 1
    return blocks


def near_fingerprints(queries: DataFrame, index: DataFrame, radius: int = 8, blocks: int | None = None) -> DataFrame:
    """(query_fp, fp, distance): all distinct fingerprints of ``index`` within ``radius`` bits of each of ``queries``.

    Both have a column fingerprint (hex); each distinct value counts once, so that copies add no work; nulls take no
    part. The bits are cut into ``blocks`` (by the number of fingerprints, if not given); at most ``radius`` of them
    differ, so one of the tables of the others, in permuted order, finds every one. A pair counts in the first table
    that both share. Keys of over HOT fingerprints are dealt out in parts, which the queries visit all.
    """
    known = materialize(index.select(F.col("fingerprint").alias("fp")).filter("fp IS NOT NULL").distinct(), "index")
    blocks = blocks or _blocks(known.count(), radius)
    tables = lambda c: _block_tables(F.col(c), blocks, radius)
    x = known.select("fp", F.posexplode(tables("fp")).alias("nth", "key"))
    asked = queries.select(F.col("fingerprint").alias("query_fp")).filter("query_fp IS NOT NULL").distinct()
    q = asked.select("query_fp", F.posexplode(tables("query_fp")).alias("nth", "key"))
    hot = x.groupBy("key").count().filter(F.col("count") > HOT).select("key", F.ceil(F.col("count") / HOT).cast("int").alias("parts"))
    x = x.join(hot, "key", "left").select("fp", "key", F.coalesce(F.pmod(F.xxhash64("fp"), "parts").cast("int"), F.lit(0)).alias("part"))
    q = q.join(hot, "key", "left").select("query_fp", "nth", "key", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    longs = lambda c: [F.conv(F.substring(c, 1 + 16 * k, 16), 16, -10).cast("long") for k in range(BITS // 64)]
    distance = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(longs("query_fp"), longs("fp"))), F.lit(0))  # noqa: B905
    near = q.join(x, ["key", "part"]).withColumn("distance", distance).filter(F.col("distance") <= radius)
    first = F.array_position(F.zip_with(tables("query_fp"), tables("fp"), lambda a, b: a == b), True) - 1
    return near.filter(first == F.col("nth")).select("query_fp", "fp", "distance")


def neighbours(docs: DataFrame, queries: DataFrame, radius: int = 8) -> DataFrame:
    """(doc_id, fingerprint, n_near, nearest): for each row of ``queries`` the distinct fingerprints of ``docs`` within ``radius`` bits.

    Both are (doc_id, fingerprint), ``queries`` some of ``docs``. n_near leaves out the own fingerprint; nearest is the
    least distance of another one, null if none is near. Copies count once; rows that repeat an id keep a row each.
    """
    found = near_fingerprints(queries, docs, radius).filter("fp <> query_fp").groupBy(F.col("query_fp").alias("fingerprint"))
    near = found.agg(F.count("*").alias("n_near"), F.min("distance").alias("nearest"))
    return queries.select("doc_id", "fingerprint").join(near, "fingerprint", "left").select("doc_id", "fingerprint", F.coalesce("n_near", F.lit(0)).alias("n_near"), "nearest")


_OUT = "kind int, pid int, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FINAL = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc_id: int | None, text: str, own: bytes, following: str, next_fp: bytes) -> dict:
    edited = _edited(text, following).encode()
    fp = fingerprint(edited)
    return {"kind": 0, "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited).hexdigest(), "fingerprint": own.hex(), "edited_fingerprint": fp.hex(), "near_edited": likeness(own, fp), "near_next": likeness(own, next_fp)}


def edit_robustness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: its fingerprint, and its likeness to that of its edited text and of the next document.

    The edited text has the last half of the characters (rounded down) replaced by as many of the first of the next
    document, ascending doc_id (nulls first, rows that repeat an id by the hash of their text); after the last comes the
    first. Texts are dealt out once, as ranges in this order; a range's last row meets the next range's first in a
    second, small step. Null texts are empty. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    def rows(out: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, schema=schema)

    spark = docs.sparkSession
    schema = to_arrow_schema(spark.createDataFrame([], _OUT).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, before, out = TaskContext.get().partitionId(), None, []
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):  # noqa: B905
                text = text or ""
                own = fingerprint(text.encode())
                if before is None:
                    out.append({"kind": 2, "pid": pid, "text": text, "fingerprint": own.hex()})
                else:
                    out.append(_row(*before, text, own))
                before = (doc_id, text, own)
            yield rows(out, schema)
            out = []
        if before is not None:
            doc_id, text, own = before
            yield rows([{"kind": 1, "pid": pid, "doc_id": doc_id, "text": text, "fingerprint": own.hex()}], schema)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows([_row(r["doc_id"], r["text"], bytes.fromhex(r["fingerprint"]), r["head"], bytes.fromhex(r["head_fp"])) for r in batch.to_pylist()], schema)

    ordered = in_order(docs, id_col, text_col)
    done = materialize(ordered.mapInArrow(run, _OUT), "fingerprints")
    # A row for each range that has any: which one follows it.
    order = W.orderBy("pid")
    follows = done.filter("kind = 2").select("pid").select("pid", F.lag("pid").over(order).alias("tail"), F.max("pid").over(W.partitionBy()).alias("end"))
    heads = done.filter("kind = 2").join(follows.select("pid", F.coalesce("tail", "end").alias("tail")), "pid").select(F.col("tail").alias("pid"), F.col("text").alias("head"), F.col("fingerprint").alias("head_fp"))
    tails = done.filter("kind = 1").select("pid", "doc_id", "text", "fingerprint").join(heads, "pid")
    return done.filter("kind = 0").select(_FINAL).unionByName(tails.mapInArrow(close, _OUT).select(_FINAL))
