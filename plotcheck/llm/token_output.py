"""Token ids in a compact binary form: bit planes of id blocks, compressed one by one, with a chunk index.

One file value holds whole documents:

    b"TPL2" | u8 planes (8: byte planes, 1: bit planes) | u32 ids in a block | u64 documents | u64 ids | u32 blocks
    zstandard(doc ids, i64 each) | zstandard(is the doc id null, u8 each) | zstandard(ids of each document, u64 each),
    each after its u32 size
    index: for each block u32 ids and, for each of its planes, u32 compressed size
    the planes, block after block

all little-endian. A block is transposed, so that plane k has bit (or byte) k of every id; planes that are zero
throughout have size 0. Values are stored in Parquet, which the cluster's file system takes from lost executors too.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotcheck.llm.common import in_order, slices
from plotcheck.llm.tokens import encoder
from plotcheck.storage import materialize

MAGIC = b"TPL2"
_HEAD = struct.Struct("<4sBIQQI")


def _planes(ids: np.ndarray, bits: int) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [raw[:, k].tobytes() for k in range(4)]
    out = []
    for k in range(4):
        byte = np.unpackbits(raw[:, k, None], axis=1, bitorder="little")
        out += [np.packbits(byte[:, j], bitorder="little").tobytes() for j in range(8)]
    return out


def _ids(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if not plane:
            continue
        if bits == 8:
            raw[:, k] = np.frombuffer(plane, np.uint8)
        else:
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << (k % 8)
    return raw.reshape(-1).view("<u4")


def write_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, block: int = 65_536, bits: int = 1, level: int = 3) -> bytes:
    """The file value for documents with ``counts`` ids each, all in ``ids``."""
    z = zstandard.ZstdCompressor(level=level)
    none = [i is None for i in doc_ids]
    head = [z.compress(x.tobytes()) for x in (np.array([i or 0 for i in doc_ids], "<i8"), np.array(none, "u1"), np.array(counts, "<u8"))]
    index, body = [], []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        index.append(struct.pack("<I", len(part)))
        for plane in _planes(part, bits):
            packed = z.compress(plane) if any(plane) else b""
            index.append(struct.pack("<I", len(packed)))
            body.append(packed)
    blocks = -(-len(ids) // block)
    return b"".join([_HEAD.pack(MAGIC, bits, block, len(doc_ids), len(ids), blocks), *(struct.pack("<I", len(x)) + x for x in head), *index, *body])


def read_file(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(doc ids, with nulls, ids of each document, all ids) of a file value."""
    magic, bits, _, docs, total, blocks = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    d, at, head = zstandard.ZstdDecompressor(), _HEAD.size, []
    for _ in range(3):
        (n,) = struct.unpack_from("<I", data, at)
        head.append(d.decompress(data[at + 4 : at + 4 + n]))
        at += 4 + n
    planes = 32 // bits
    index = np.frombuffer(data, "<u4", blocks * (1 + planes), at).reshape(blocks, 1 + planes)
    at += index.nbytes
    parts = []
    for row in index.tolist():
        packed = []
        for n in row[1:]:
            packed.append(d.decompress(data[at : at + n]) if n else b"")
            at += n
        parts.append(_ids(packed, row[0], bits))
    ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    assert len(ids) == total
    return pa.array(np.frombuffer(head[0], "<i8", docs), mask=np.frombuffer(head[1], "u1", docs).astype(bool)), np.frombuffer(head[2], "<u8", docs), ids


def token_files(docs: DataFrame, path: str, split: str, end_id: int, file_ids: int = 2_000_000, block: int = 65_536, bits: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, part, n_ids, payload): the ids of all documents in ascending doc_id order, in files of about ``file_ids`` ids.

    Shards are ranges of doc_id, so that (shard, part) orders the files. Null ids come first; rows that repeat an id come
    in the order of their text's hash, and spread over shards where they are many. Null and empty texts have the end id
    alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, shard = encoder(path, split), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        rows, counts, parts, size, part = [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            payload = write_file(rows, counts, np.frombuffer(b"".join(parts), "<u4"), block, bits)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], names=["shard", "part", "n_ids", "payload"])

        for batch in slices(batches, "text"):
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):  # noqa: B905
                ids = enc.ids(text or "") + end
                rows.append(i)
                counts.append(len(ids) // 4)
                parts.append(ids)
                size += counts[-1]
                if size >= file_ids:
                    yield out()
                    rows, counts, parts, size, part = [], [], [], 0, part + 1
        if rows:
            yield out()

    ordered = in_order(docs, id_col, text_col)
    return ordered.mapInArrow(run, "shard int, part int, n_ids long, payload binary")


def read_documents(files: DataFrame) -> DataFrame:
    """(shard, part, doc_id, local, n_tokens, ids_crc32) of every document in the files; local: ids before it in its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, part, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "payload"))):  # noqa: B905
                doc, n, ids = read_file(payload)
                ends = np.cumsum(n).astype(np.int64)
                raw = ids.tobytes()
                starts = ends - n.astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]  # noqa: B905
                rows = len(doc)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, shard, np.int32)), pa.array(np.full(rows, part, np.int32)), doc, pa.array(starts), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())], names=["shard", "part", "doc_id", "local", "n_tokens", "ids_crc32"])

    return files.select("shard", "part", "payload").mapInArrow(run, "shard int, part int, doc_id long, local long, n_tokens long, ids_crc32 long")


def written_digest(docs: DataFrame, path: str, split: str = "word", end_id: int = 1) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from files written and read back.

    Nulls and repeated ids as in ``token_files``: every row is a document of its own. An empty table gives no rows.
    """
    files = materialize(token_files(docs, path, split, end_id), "tokens")
    # Ids before each file: within its shard, and those of the shards before; a row per shard meets in one task.
    meta = files.select("shard", "part", "n_ids")
    shards = meta.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))
    own = F.sum("n_ids").over(W.partitionBy("shard").orderBy("part")) - F.col("n_ids")
    base = meta.withColumn("own", own).join(shards, "shard").select("shard", "part", (F.col("own") + F.col("before")).alias("base"))
    read = read_documents(files).join(base, ["shard", "part"])
    return read.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
