"""Exact top-k inner products with a three-phase uniform threshold.

The components are cut into LISTS lists, each with its own partial scores; a list is ordered by the length of its part
of the vectors, which bounds the scores in it. Phase 1 gathers each list's best entries from the head of every block of
candidates and scores them in full: the k-th best of a query is a safe cutoff, which the queries carry to all blocks.
A score above it needs a partial score of a LISTS-th of it in one list at least. Phase 2 therefore reads each list only
down to the length that can still reach this share and collects the entries that do; phase 3 resolves the partial
scores that these entries still lack, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotcheck.storage import materialize

LISTS = 2
#: Queries and candidates that one task scores against each other at most, about.
QUERIES, CANDIDATES = 16_384, 16_384
#: Share of a block of candidates, longest first, that phase 1 looks at. Any share gives a safe cutoff.
HEAD = 0.125
#: Candidates, and cells of queries by candidates, that a step scores at once.
_STEP, _CELLS = 2048, 4_000_000
#: Scores end at the range of a long.
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_FOUND = tuple[np.ndarray, np.ndarray, np.ndarray]


def quantized(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(row, vec_id, v): components as floor(scale * x), x as double; row numbers the rows, which may repeat an id.

    A null vector, and a vector with a null or non-finite component, takes no part; every other row does, one with a
    null id too. A component whose product leaves the range of a double counts as the end of that range. Vectors of
    different length: missing components count as zero; an empty vector scores zero. The result is written once, so
    that row numbers hold.
    """

    def whole(x):  # noqa: ANN001, ANN202
        y = F.greatest(F.least(x.cast("double") * scale, F.lit(1.7976931348623157e308)), F.lit(-1.7976931348623157e308))
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    sound = vectors.filter(F.col(vec_col).isNotNull() & ~bad)
    return materialize(sound.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, whole).alias("v")), "vectors")


def _matrix(t: pa.Table, width: int) -> np.ndarray:
    col = t.column("v").combine_chunks()
    size = pc.list_value_length(col).to_numpy()
    flat = col.flatten().to_numpy().astype(np.float64)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _best(query: np.ndarray, ids: np.ndarray, no_id: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Entries with each query's k best scores, ties to smaller ids, rows without id last."""
    order = np.lexsort((ids, no_id, ~score, query))
    q = query[order]
    first = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1] if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two sides in a type in which LISTS times any of their products is exact."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1) * LISTS
    if bound < 2**53:
        return a, b
    if bound < 2**62:
        return a.astype(np.int64), b.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).astype(object), whole(b).astype(object)


def _long(score: np.ndarray) -> np.ndarray:
    return np.clip(score, _LOW, _HIGH).astype(np.int64) if score.dtype == object else score.astype(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray, own: np.ndarray, tau: np.ndarray | None, k: int, work: list[int]) -> Iterator[_FOUND]:
    """(query, candidate, score) of phase 1 (no ``tau``) or of phases 2 and 3. own: the candidate that is the query itself, or -1.

    ``work`` counts the multiplications of components.
    """
    edges = [a.shape[1] * j // LISTS for j in range(LISTS + 1)]
    lists = [slice(x, y) for x, y in zip(edges, edges[1:])]  # noqa: B905
    # Rounding up keeps a bound a bound.
    long_a, long_b = ([1.000001 * np.sqrt((m[:, s].astype(np.float64) ** 2).sum(axis=1)) for s in lists] for m in (a, b))
    order = np.argsort(-sum(x**2 for x in long_b), kind="stable")
    if tau is None:
        order = order[: max(int(np.ceil(HEAD * len(order))), min(k + 1, len(order)))]
    else:
        share = [np.where((tau > 0) & (x > 0), tau / LISTS / np.maximum(x, 1e-300), 0).min() for x in long_a]
        share = [0.0 if (tau <= 0).any() else s for s in share]
        goal = tau.astype(object) if a.dtype == object else tau.astype(a.dtype)
        every = tau == _LOW
    step = max(1, min(_STEP, _CELLS // max(len(a), 1)))
    for at in range(0, len(order), step):
        js = order[at : at + step]
        part = b[js]
        if tau is None:
            partial = [a[:, s] @ part[:, s].T for s in lists]
            work[0] += a.shape[1] * len(a) * len(js)
            top = min(k + 1, len(js))
            pick = np.concatenate([np.argsort(p, axis=1)[:, len(js) - top :] if p.dtype == object else np.argpartition(p, len(js) - top, axis=1)[:, len(js) - top :] for p in partial], axis=1)
            pick.sort(axis=1)
            i = np.repeat(np.arange(len(a)), pick.shape[1])
            fresh = np.concatenate([np.ones((len(pick), 1), bool), pick[:, 1:] != pick[:, :-1]], axis=1).ravel()
            i, j = i[fresh], pick.ravel()[fresh]
            other = own[i] != js[j]
            i, j = i[other], j[other]
            yield i, js[j], _long(sum(p[i, j] for p in partial))
            continue
        hit = np.zeros((len(a), len(js)), bool)
        hit[every] = True
        known = []
        for s, length, least in zip(lists, long_b, share):  # noqa: B905
            read = np.flatnonzero(length[js] >= least)
            p = a[:, s] @ part[read][:, s].T
            work[0] += (s.stop - s.start) * len(a) * len(read)
            hit[:, read] |= LISTS * p >= goal[:, None]
            known.append((p, read))
        i, j = np.nonzero(hit)
        other = own[i] != js[j]
        i, j = i[other], j[other]
        score = np.zeros(len(i), a.dtype)
        for s, (p, read) in zip(lists, known):  # noqa: B905
            place = np.full(len(js), -1)
            place[read] = np.arange(len(read))
            has = place[j] >= 0
            score[has] += p[i[has], place[j[has]]]
            x, y = i[~has], j[~has]
            work[0] += (s.stop - s.start) * len(x)
            score[~has] += (a[x, s] * part[y, s]).sum(axis=1)
        out = _long(score)
        keep = out >= tau[i]
        yield i[keep], js[j[keep]], out[keep]


def _score(q: pa.Table, c: pa.Table, k: int, cutoff: bool, work: list[int] | None = None) -> pa.Table:
    """The k best of a block of candidates for each of a block of queries, as far as the phase looks."""
    out_schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    if not q.num_rows or not c.num_rows:
        return out_schema.empty_table()
    work = [0] if work is None else work
    width = max(max(pc.max(pc.list_value_length(t.column("v"))).as_py() for t in (q, c)), LISTS)
    a, b = _matrix(q, width), _matrix(c, width)
    q_rows, c_rows = (t.column("row").to_numpy() for t in (q, c))
    _, own_q, own_c = np.intersect1d(q_rows, c_rows, return_indices=True)
    own = np.full(len(a), -1)
    own[own_q] = own_c
    ids, no_id = c.column("vec_id").fill_null(0).to_numpy(), c.column("vec_id").is_null().to_numpy()
    tau = q.column("tau").to_numpy() if cutoff else None
    # Vectors of large components are scored apart, in a type that holds their products.
    limit = np.sqrt(2.0**53 / (width * LISTS)) * 0.999
    sides = [[np.flatnonzero(big == w) for w in (False, True)] for big in (np.abs(m).max(axis=1) > limit for m in (a, b))]
    found: list[_FOUND] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64))]
    for qs in sides[0]:
        for cs in sides[1]:
            if not len(qs) or not len(cs):
                continue
            back = np.full(len(b), -2)
            back[cs] = np.arange(len(cs))
            mine = np.where(own[qs] >= 0, back[own[qs]], -1)
            for i, j, s in _pairs(*_exact(a[qs], b[cs]), mine, None if tau is None else tau[qs], k, work):
                found.append((qs[i], cs[j], s))
                i, j, s = (np.concatenate(x) for x in zip(*found))  # noqa: B905
                best = _best(i, ids[j], no_id[j], s, k)
                found = [(i[best], j[best], s[best])]
    i, j, s = found[0]
    return pa.table([pa.array(q_rows[i]), q.column("vec_id").combine_chunks().take(pa.array(i)), c.column("vec_id").combine_chunks().take(pa.array(j)), pa.array(s)], schema=out_schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k highest inner products over all rows of ``vectors`` but itself.

    Both are (row, vec_id, v) as ``quantized`` gives them, ``queries`` some of ``vectors``. Ties go to the smaller
    vec_id, rows without id last; rows that repeat an id are candidates, and queries, of their own. A query with fewer
    candidates gets all. Scores beyond a long end at its range. Empty tables give no rows. Queries and candidates meet
    in blocks; each pair of blocks sends k entries for a query at most.
    """
    q_blocks = max(1, -(-queries.count() // QUERIES))
    c_blocks = max(1, -(-vectors.count() // CANDIDATES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    # Columns of their own, as both sides of the cogroup come from one table.
    own = [F.col(c).alias(c) for c in ("row", "vec_id", "v")]
    cands = vectors.select(*own, block(c_blocks).alias("cb"), every(q_blocks).alias("qb"))
    schema = "query_row long, query_id long, vec_id long, score long"

    def scored(qs: DataFrame, cutoff: bool) -> DataFrame:
        asked = qs.withColumns({"qb": block(q_blocks), "cb": every(c_blocks)})
        met = asked.groupBy("qb", "cb").cogroup(cands.groupBy("qb", "cb")).applyInArrow(lambda x, y: _score(x, y, k, cutoff), schema)
        rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
        return met.withColumn("rank", rank).filter(F.col("rank") <= k)

    cut = scored(queries, False).groupBy("query_row").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    known = cut.select(F.col("query_row").alias("row"), F.when(F.col("n") >= k, F.col("low")).alias("tau"))
    asked = materialize(queries.join(known, "row", "left").withColumn("tau", F.coalesce("tau", F.lit(_LOW))), "cutoffs")
    return scored(asked, True).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
