"""Exact quantiles of a whole table, without a task that holds all values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotcheck.storage import materialize

#: Values that the last step of a rank looks at one by one, at most.
LAST = 10_000
#: Accuracy of the sketches that bracket a rank: they miss it by 1 / ACCURACY of the rows at most.
ACCURACY = 2_000


def _narrowed(values: DataFrame, ranks: dict[tuple[str, int], tuple[float | None, float | None]]) -> dict[tuple[str, int], tuple[float | None, float | None, int, int]]:
    """One pass: for each (column, rank) a narrower bracket around it, with the number of values below it and within."""
    aims, exprs = list(ranks), []
    held = lambda c, lo, hi: F.when((F.lit(lo is None) | (F.col(c) >= F.lit(lo or 0.0))) & (F.lit(hi is None) | (F.col(c) <= F.lit(hi or 0.0))), F.col(c))
    for i, (c, _) in enumerate(aims):
        lo, hi = ranks[aims[i]]
        exprs += [F.count(held(c, lo, hi)).alias(f"n{i}"), F.count(F.when(F.col(c) < F.lit(lo or 0.0), 1) if lo is not None else F.lit(None)).alias(f"b{i}")]
    now = values.agg(*exprs).first()
    asked = []
    for i, (c, rank) in enumerate(aims):
        lo, hi = ranks[aims[i]]
        share = lambda r, i=i: min(1.0, max(0.0, r / max(now[f"n{i}"], 1)))
        at, slack = rank - now[f"b{i}"], 2 * now[f"n{i}"] / ACCURACY + 1
        asked.append(F.percentile_approx(held(c, lo, hi), [share(at - slack), share(at + slack + 1)], ACCURACY).alias(f"p{i}"))
    found = values.agg(*asked).first()
    checks = []
    for i, (c, _) in enumerate(aims):
        if found[f"p{i}"] is not None:
            a, b = found[f"p{i}"]
            checks += [F.count(F.when(F.col(c) < F.lit(a), 1)).alias(f"b{i}"), F.count(F.when(F.col(c) <= F.lit(b), 1)).alias(f"u{i}")]
    exact = values.agg(*checks).first() if checks else None
    out = {}
    for i, key in enumerate(aims):
        lo, hi = ranks[key]
        if found[f"p{i}"] is None:
            out[key] = (lo, hi, now[f"b{i}"], now[f"n{i}"])
            continue
        a, b = found[f"p{i}"]
        below, upto = exact[f"b{i}"], exact[f"u{i}"]
        # The sketch may have missed on one side; that side stays as it was.
        lo, below = (a, below) if below <= key[1] else (lo, now[f"b{i}"])
        hi, upto = (b, upto) if upto > key[1] else (hi, now[f"b{i}"] + now[f"n{i}"])
        out[key] = (lo, hi, below, upto - below)
    return out


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str | Column, float]]) -> dict[str, float | None]:
    """Quantiles of columns of ``df`` by name, as ``percentile`` gives them; None over no values. Nulls do not count.

    Ranks are bracketed by sketches and exact counts of what lies below, until a bracket holds one value or LAST values; only
    these are looked at one by one. Each pass reads the columns once and returns one row.
    """
    columns = {}
    for name, (c, _) in wanted.items():
        columns[name] = (F.col(c) if isinstance(c, str) else c).cast("double")
    values = materialize(df.select(*[c.alias(f"v{i}") for i, c in enumerate(columns.values())]), "values")
    at = {name: f"v{i}" for i, name in enumerate(columns)}
    sizes = values.agg(*[F.count(c).alias(c) for c in at.values()]).first()
    place = {name: p * (sizes[at[name]] - 1) for name, (_, p) in wanted.items() if sizes[at[name]]}
    open_: dict[tuple[str, int], tuple[float | None, float | None]] = {(at[name], r): (None, None) for name, x in place.items() for r in {math.floor(x), math.ceil(x)}}
    known: dict[tuple[str, int], float] = {}
    while open_:
        brackets = _narrowed(values, open_)
        rest = {}
        for key, (lo, hi, below, n) in brackets.items():
            if lo is not None and lo == hi:
                known[key] = lo
            elif n <= LAST or (lo, hi) == open_[key]:
                c = F.col(key[0])
                inside = values.filter((F.lit(lo is None) | (c >= F.lit(lo or 0.0))) & (F.lit(hi is None) | (c <= F.lit(hi or 0.0))))
                for value, count in inside.filter(c.isNotNull()).groupBy(c.alias("v")).count().orderBy("v").toLocalIterator():
                    below += count
                    if below > key[1]:
                        known[key] = value
                        break
            else:
                rest[key] = (lo, hi)
        open_ = rest
    out: dict[str, float | None] = dict.fromkeys(wanted)
    for name, x in place.items():
        low, high = known[at[name], math.floor(x)], known[at[name], math.ceil(x)]
        out[name] = low if math.floor(x) == math.ceil(x) else (math.ceil(x) - x) * low + (x - math.floor(x)) * high
    return out
