"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotcheck.llm.common import WORD
from plotcheck.storage import materialize

#: Newton iterations at most; the dual of each source is convex in one variable, and bracketed.
ITERATIONS = 60
#: A source is balanced when its expected words are this near its target.
TOLERANCE = 1e-7
#: Parts that the documents of one size in one source are dealt to when rates are rounded.
PARTS = 64
_UNIT = 1 << 30


def with_sizes(docs: DataFrame) -> DataFrame:
    """``docs`` with __size, the number of words of text (null: 0), __source, a key that is never null, and __part."""
    return docs.withColumns(
        {
            "__size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
            "__source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~")),
            "__part": F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)),
        }
    )


def source_targets(classes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(__source, source_size, target, mean) from the size classes of each source.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` of all words; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight, until none is above.
    """
    per = classes.groupBy("__source").agg(F.sum(F.col("__size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("__size") > 0, F.col("n"))).alias("docs"))
    # Windows over all: a row for each source. "~" is above "=", so null comes last.
    nth = F.row_number().over(W.orderBy("__source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))
    room = (F.lit(float(most)) * F.col("source_size")).cast("double")
    per = per.withColumns({"weight": weight, "room": room}).withColumn("nth", F.row_number().over(W.orderBy(F.col("room") / F.col("weight"), "__source")))
    # Sources stop in the order of room for weight. Once the first j have stopped, the rest share what is left; the
    # level holds from the first source on that has room for it.
    all_, before = W.partitionBy(), W.orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    gone = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = (F.lit(float(share)) * F.sum("source_size").over(all_) - gone("room")) / (F.sum("weight").over(all_) - gone("weight"))
    per = per.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("room"), F.col("nth"))
    per = per.withColumn("level", F.min_by("level", fits).over(all_))
    target = F.coalesce(F.least("room", F.col("level") * F.col("weight")), F.col("room"))
    return per.select("__source", "source_size", target.alias("target"), (F.col("source_size") / F.col("docs")).alias("mean"))


def _rate(most: float):  # noqa: ANN202
    """The rate of a size class: exponentially tilted, ``most`` at the highest."""
    return F.when(F.col("full"), F.lit(most)).otherwise(F.least(F.lit(most), F.exp(F.least(F.col("lam") * F.col("__size") / F.col("mean"), F.lit(50.0)))))


def balanced(classes: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """``targets`` with lam, by which rates min(most, exp(lam * size / mean)) give each source its target.

    These rates are the nearest to one, in relative entropy, that meet the target. Each iteration is one aggregation of
    all classes; sums are whole numbers of a 1024th of a word, so that reruns agree. A source whose target is all it
    may take, or nothing, is full.
    """
    full = (F.col("target") >= F.col("source_size") * most) | (F.col("source_size") == 0)
    start = {"full": full, "lam": F.when(full, 0.0).otherwise(F.log(F.col("target") / F.col("source_size"))), "lo": F.lit(float("-inf")), "hi": F.lit(float("inf"))}
    state = materialize(targets.withColumns(start), "newton")
    for _ in range(ITERATIONS):
        rate = _rate(most)
        words = F.col("n") * F.col("__size")
        open_ = F.when(rate < most, F.col("__size") / F.col("mean")).otherwise(0.0)
        fixed = lambda x: F.sum(F.round(x * 1024).cast("long"))
        sums = classes.join(state.filter("NOT full"), "__source").groupBy("__source").agg(fixed(words * rate).alias("g"), fixed(words * rate * open_).alias("h"))
        step = state.join(sums, "__source", "left").withColumns({"g": F.coalesce(F.col("g") / 1024 - F.col("target"), F.lit(0.0)), "h": F.col("h") / 1024})
        step = step.withColumns({"lo": F.when(F.col("g") < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("g") > 0, F.col("lam")).otherwise(F.col("hi")), "done": F.abs("g") <= TOLERANCE * F.col("target") + 0.01})
        newton = F.col("lam") - F.col("g") / F.when(F.col("h") > 0, F.col("h"))
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        middle = F.when(F.col("hi") == float("inf"), F.greatest(2 * F.col("lo"), F.lit(1.0))).when(F.col("lo") == float("-inf"), F.least(2 * F.col("hi"), F.lit(-1.0))).otherwise((F.col("lo") + F.col("hi")) / 2)
        # A source whose bracket has closed is as near as its sizes allow.
        done = F.col("done") | (F.col("hi") - F.col("lo") < 1e-12)
        step = step.withColumns({"done": done, "lam": F.when(done, F.col("lam")).when(inside, newton).otherwise(middle)})
        state = materialize(step, "newton")
        rest = state.filter("NOT done").count()
        state = state.select("__source", "source_size", "target", "mean", "full", "lam", "lo", "hi")
        if not rest:
            return state
    raise RuntimeError(f"{rest} sources not balanced after {ITERATIONS} iterations")


def with_copies(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, sized: DataFrame | None = None) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and copies (0 to ``most``), for columns doc_id, text, source.

    ``sized`` may hold the rows of with_sizes(docs), written already. Rates are rounded along each source by size, so
    that copies of near sizes make up for each other: a source's words differ from its target by about its longest
    document at most. Rows are told apart by doc_id where they are equal in source and size; repeated ids and null ids
    are rows of their own, and a null source is a source. An empty table gives no rows. Reruns give the same copies.
    """
    sized = with_sizes(docs) if sized is None else sized
    parts = materialize(sized.groupBy("__source", "__size", "__part").agg(F.count("*").alias("n")), "sizes")
    classes = parts.groupBy("__source", "__size").agg(F.sum("n").alias("n"))
    targets = source_targets(classes, weights, share, most)
    rates = balanced(classes, materialize(targets, "targets"), most)
    rated = classes.join(rates.select("__source", "source_size", "target", "mean", "full", "lam"), "__source")
    rate = F.round(_rate(most) * _UNIT).cast("long")
    rated = rated.withColumn("rate", F.least(rate, F.lit(int(most * _UNIT)))).withColumn("extra", F.pmod(F.col("rate"), F.lit(_UNIT)))
    # Fractions of copies owed before each class, and before each part of it.
    owed = F.col("n") * F.col("extra")
    upto = W.partitionBy("__source").orderBy(F.desc("__size"))
    rated = rated.withColumn("owed", F.sum(owed).over(upto) - owed).drop("n")
    own = F.sum("n").over(W.partitionBy("__source", "__size").orderBy("__part")) - F.col("n")
    known = parts.withColumn("own", own).join(rated, ["__source", "__size"])
    known = known.select("__source", "__size", "__part", "source_size", "target", "rate", "extra", (F.col("owed") + F.col("own") * F.col("extra")).alias("owed"))
    nth = F.row_number().over(W.partitionBy("__source", "__size", "__part").orderBy("doc_id"))
    out = sized.withColumn("nth", nth).join(known, ["__source", "__size", "__part"])
    at = lambda i: F.floor((F.col("owed") + i * F.col("extra") + _UNIT // 2) / _UNIT)
    copies = F.floor(F.col("rate") / _UNIT) + at(F.col("nth")) - at(F.col("nth") - 1)
    kept = [c for c in sized.columns if not c.startswith("__")]
    return out.select(*kept, F.col("__size").alias("__size"), "source_size", "target", copies.cast("int").alias("copies"))


def mix_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document of the mix."""
    sized = materialize(with_sizes(docs).select("doc_id", "source", "__size", "__source", "__part"), "sized")
    out = with_copies(docs, sized=sized)
    return out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    out = with_copies(packed, sized=with_sizes(packed).drop("text", "source"))
    return out.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
