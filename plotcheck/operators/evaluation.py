"""Operators that link, sample, measure and release detections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotcheck.functions import geometry as g
from plotcheck.operators.quantiles import exact_quantiles
from plotcheck.operators.spatial import box_join
from plotcheck.storage import materialize

BOX = ["x1", "y1", "x2", "y2"]


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_id, r_id, inter, iou) of boxes (id, x1, y1, x2, y2) that share area."""
    met = box_join(left.select("id", *BOX), right.select("id", *BOX))
    met = met.withColumns({"inter": F.expr(g.box_overlap("l_", "r_")), "iou": F.expr(g.box_iou("l_", "r_"))}).filter("inter > 0")
    return met.select("l_id", "r_id", "inter", "iou")


def best_overlap_link(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """Each left row with its right partner of the highest IoU above ``least`` (ties to the smaller id), or null."""
    m = overlaps(left, right).filter(F.col("iou") > least)
    best = m.groupBy(F.col("l_id").alias("id")).agg(F.max_by(F.struct("r_id", "iou"), F.struct(F.round("iou", 9), -F.col("r_id"))).alias("b"))
    return left.select("id").join(best, "id", "left").select("id", F.col("b.r_id").alias("partner"), F.col("b.iou").alias("iou"))


def append_unmatched(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """All left ids, and the right ids that are nobody's partner."""
    links = best_overlap_link(left, right, least)
    free = right.select("id").join(links.select(F.col("partner").alias("id")), "id", "left_anti")
    return left.select("id", F.lit("left").alias("origin")).unionByName(free.select("id", F.lit("right").alias("origin")))


def label_candidates(cand: DataFrame, ref: DataFrame, least: float = 0.5) -> DataFrame:
    """The class of the reference that covers each candidate best: min(shared / candidate, 2 shared / reference) of ``least`` at least, else 'nichts'."""
    met = box_join(cand.select("id", *BOX), ref.select("id", "klasse", *BOX)).withColumn("inter", F.expr(g.box_overlap("l_", "r_"))).filter("inter > 0")
    weight = F.least(F.col("inter") / F.expr(g.box_area("l_")), 2 * F.col("inter") / F.expr(g.box_area("r_")))
    met = met.withColumn("weight", F.round(weight, 9)).filter(F.col("weight") >= least)
    best = met.groupBy(F.col("l_id").alias("id")).agg(F.max_by("r_klasse", F.struct("weight", -F.col("r_id"))).alias("label"))
    return cand.select("id").join(best, "id", "left").select("id", F.coalesce("label", F.lit("nichts")).alias("label"))


def compare_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """F1 by class of two versions; a class that one lacks counts 0 there."""
    o, n = old.select("klasse", F.col("f1").alias("old")), new.select("klasse", F.col("f1").alias("new"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return o.join(n, "klasse", "full").select("klasse", z("old").alias("old"), z("new").alias("new"), (z("new") - z("old")).alias("gain"))


def cross_scenarios(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every row under every scenario; ``scenarios`` is a dimension of the plan, not data."""
    return df.crossJoin(F.broadcast(scenarios))


def filter_ladder(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """(stage, name, rows): how many rows pass the first n filters."""
    failed = F.lit(len(stages))
    for i, (_, ok) in reversed(list(enumerate(stages))):
        failed = F.when(~F.coalesce(ok, F.lit(False)), F.lit(i)).otherwise(failed)
    hist = df.select(failed.alias("failed")).groupBy("failed").agg(F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame([(i, name) for i, (name, _) in enumerate(stages)], "stage int, name string")
    return names.join(hist, F.col("failed") > F.col("stage"), "left").groupBy("stage", "name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def rule_scores(df: DataFrame) -> DataFrame:
    """(id, klasse, score) of fixed class rules on area, height and vegetation."""
    rules = {"gartenhaus": "CASE WHEN area BETWEEN 4 AND 30 AND height BETWEEN 1.8 AND 4 THEN 0.6 ELSE 0.0 END", "pool": "CASE WHEN area BETWEEN 6 AND 80 AND height < 2.5 THEN 0.5 ELSE 0.0 END", "baum": "CASE WHEN height > 3 AND area < 12 THEN 0.7 ELSE 0.0 END"}
    each = F.array(*[F.struct(F.lit(k).alias("klasse"), F.expr(e).cast("double").alias("score")) for k, e in rules.items()])
    return df.select("id", F.explode(each).alias("r")).select("id", "r.klasse", "r.score")


def blend_probabilities(prob: DataFrame, rules: DataFrame, impossible: DataFrame) -> DataFrame:
    """Class probabilities without the impossible ones, raised to the rule score, the others rescaled to the rest."""
    p = prob.join(impossible.withColumn("no", F.lit(True)), ["id", "klasse"], "left").withColumn("p", F.when(F.col("no"), 0.0).otherwise(F.col("p"))).drop("no")
    p = p.join(rules, ["id", "klasse"], "left").withColumn("ruled", F.coalesce("score", F.lit(0.0)) > F.col("p"))
    p = p.withColumn("q", F.greatest("p", F.coalesce("score", F.lit(0.0))))
    w = W.partitionBy("id")
    taken = F.sum(F.when(F.col("ruled"), F.col("q")).otherwise(0.0)).over(w)
    free = F.sum(F.when(F.col("ruled"), 0.0).otherwise(F.col("q"))).over(w)
    scaled = F.when(F.col("ruled"), F.col("q")).when(free > 0, F.col("q") * F.greatest(1 - taken, F.lit(0.0)) / free).otherwise(0.0)
    return p.select("id", "klasse", scaled.alias("p"))


def no_object(score: Column, p_none: Column) -> Column:
    return (score < 0.3) | (p_none > 0.6)


def rectangle_decision(ratio: Column, is_building: Column) -> Column:
    """Rectangle from 0.65 on, outline below 0.55; between them buildings are rectangles."""
    return F.when(ratio >= 0.65, "rectangle").when(ratio < 0.55, "outline").when(is_building, "rectangle").otherwise("outline")


def top_k_classes(prob: DataFrame, k: int = 3, threshold: float = 0.0) -> DataFrame:
    w = W.partitionBy("id").orderBy(F.desc("p"), "klasse")
    return prob.filter("klasse <> 'nichts'").filter(F.col("p") >= threshold).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def salted(seed: str, *keys: str) -> Column:
    """A fixed order that looks random."""
    return F.sha2(F.concat_ws("/", F.lit(seed), *keys), 256)


def stratified_split(df: DataFrame, stratum: str, key: str, k: int, seed: str) -> DataFrame:
    """The first ``k`` rows of each stratum in salted order are test, the others dev."""
    w = W.partitionBy(stratum).orderBy(salted(seed, key), key)
    return df.withColumn("part", F.when(F.row_number().over(w) <= k, "test").otherwise("dev"))


def quota_sample(df: DataFrame, klass: str, key: str, quota: int, seed: str) -> DataFrame:
    """(class, taken, shortfall) of at most ``quota`` rows of each class."""
    w = W.partitionBy(klass).orderBy(salted(seed, key), key)
    t = df.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= quota)
    return t.groupBy(klass).agg(F.count("*").alias("taken"), F.sum(F.col(key)).alias("ids"), F.greatest(F.lit(quota) - F.count("*"), F.lit(0)).alias("shortfall"))


def group_kfold(df: DataFrame, group: str, folds: int, seed: str) -> DataFrame:
    """Folds that never split a group."""
    rank = df.select(group).distinct().withColumn("fold", F.dense_rank().over(W.orderBy(salted(seed, group), group)) % folds)
    return df.join(rank, group)


def running_version(registry: DataFrame, known: DataFrame) -> DataFrame:
    """Next version, open candidates and the latest released version for each class."""
    return registry.join(known, "version", "left").groupBy("klasse").agg((F.max("version") + 1).alias("next"), F.count_if(F.col("status").isNull()).alias("open"), F.max(F.when(F.col("status") == "released", F.col("version"))).alias("released"))


def counts(matched: DataFrame) -> list[Column]:
    del matched
    return [F.count_if("tp").alias("tp"), F.count_if("fp").alias("fp"), F.count_if("fn").alias("fn")]


def with_rates(df: DataFrame) -> DataFrame:
    """Precision, recall and F1; a rate over nothing is null."""
    p = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    r = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    d = df.withColumns({"precision": p, "recall": r})
    return d.withColumn("f1", F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))))


def judged(det: DataFrame, ref: DataFrame, match: Callable[[DataFrame], DataFrame], least: float = 0.3) -> DataFrame:
    """Rows (klasse, tp, fp, fn, iou, dl, db, dh, held, spans) of detections and references of one class.

    ``match`` links them one to one, the highest IoU first (``iterative.greedy_match``). Unsure references are neutral: one
    that is missed counts nothing, nor does an unmatched detection that touches one of any class. Of each link: the errors
    of length, width and height, and how many of them lie within the detection's ``span``; a null height gives none.
    """
    boxed = box_join(det.select("id", "klasse", *BOX), ref.select("id", "klasse", "sicher", *BOX))
    met = boxed.filter("l_klasse = r_klasse").withColumn("iou", F.round(F.expr(g.box_iou("l_", "r_")), 9)).filter(F.col("iou") >= least)
    pairs = match(met.select(F.col("l_id").alias("det"), F.col("r_id").alias("ref"), "iou")).withColumnsRenamed({"det": "l_id", "ref": "r_id"})
    size = lambda c: [F.expr("greatest(x2 - x1, y2 - y1)").alias(c + "l"), F.expr("least(x2 - x1, y2 - y1)").alias(c + "b"), F.col("height").alias(c + "h")]
    d = det.select(F.col("id").alias("l_id"), "klasse", "span", *size("d")).join(pairs, "l_id", "left").join(ref.select(F.col("id").alias("r_id"), *size("r")), "r_id", "left")
    errors = [F.round(F.abs(F.col(f"d{k}") - F.col(f"r{k}")), 9).alias("d" + k) for k in "lbh"]
    d = d.select("l_id", "r_id", "klasse", "iou", "span", *errors)
    near = boxed.filter("NOT r_sicher").select("l_id").distinct().withColumn("unsure", F.lit(True))
    d = d.join(near, "l_id", "left")
    linked = F.col("r_id").isNotNull()
    within = sum((F.when(F.col(c) <= F.col("span"), 1).otherwise(0) for c in ("dl", "db", "dh")), F.lit(0))
    n = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("dl", "db", "dh")), F.lit(0))
    hits = d.select("klasse", linked.alias("tp"), (~linked & F.col("unsure").isNull()).alias("fp"), F.lit(False).alias("fn"), "iou", "dl", "db", "dh", within.alias("held"), n.alias("spans"))
    missed = ref.filter("sicher").select(F.col("id").alias("r_id"), "klasse").join(pairs, "r_id", "left_anti")
    none = [F.lit(None).cast("double").alias(c) for c in ("iou", "dl", "db", "dh")]
    return hits.unionByName(missed.select("klasse", F.lit(False).alias("tp"), F.lit(False).alias("fp"), F.lit(True).alias("fn"), *none, F.lit(0).alias("held"), F.lit(0).alias("spans")))


def class_metrics(rows: DataFrame) -> DataFrame:
    """Counts, rates, mean IoU, median errors and the share of errors within span, for each class."""
    medians = [F.median(c).alias(k) for c, k in (("dl", "median_length"), ("db", "median_width"), ("dh", "median_height"))]
    share = F.sum("held") / F.nullif(F.sum("spans"), F.lit(0))
    return with_rates(rows.groupBy("klasse").agg(*counts(rows), F.avg("iou").alias("mean_iou"), *medians, share.alias("in_span")))


def metrics_rollup(rows: DataFrame) -> DataFrame:
    """A row for each class, for the merged class of small buildings, and for all together."""
    merged = F.explode(F.expr("CASE WHEN klasse IN ('gartenhaus', 'carport_garage') THEN array(klasse, 'kleinbau') ELSE array(klasse) END"))
    per = rows.withColumn("k", merged).groupBy(F.col("k").alias("klasse")).agg(*counts(rows))
    total = rows.agg(F.lit("gesamt").alias("klasse"), *counts(rows))
    return with_rates(per.unionByName(total))


def failure_funnel(ref: DataFrame, cand: DataFrame, det: DataFrame) -> DataFrame:
    """Where the chain breaks for each reference: no candidate, wrong class, or found."""
    c = overlaps(ref, cand).select(F.col("l_id").alias("id")).distinct().withColumn("c", F.lit(True))
    same = box_join(ref.select("id", "klasse", *BOX), det.select("id", "klasse", *BOX)).filter(F.expr(g.box_overlap("l_", "r_") + " > 0") & (F.col("l_klasse") == F.col("r_klasse"))).select(F.col("l_id").alias("id")).distinct().withColumn("d", F.lit(True))
    stage = F.when(F.col("c").isNull(), "no_candidate").when(F.col("d").isNull(), "wrong_class").otherwise("found")
    return ref.join(c, "id", "left").join(same, "id", "left").groupBy("klasse", stage.alias("stage")).agg(F.count("*").alias("n"))


def blockwise_eval(det: DataFrame, ref: DataFrame, block: float, every: int) -> DataFrame:
    """Recall on the sampled blocks and precision over all detections, by class: touched counts for both."""
    hit = overlaps(det, ref).join(det.select(F.col("id").alias("l_id"), "klasse"), "l_id").join(ref.select(F.col("id").alias("r_id"), F.col("klasse").alias("rk")), "r_id")
    right = hit.filter("klasse = rk")
    chosen = F.pmod(F.floor(F.col("x1") / block) * 7 + F.floor(F.col("y1") / block), F.lit(every)) == 0
    r = ref.filter(chosen).join(right.select(F.col("r_id").alias("id")).distinct().withColumn("ok", F.lit(1)), "id", "left").groupBy("klasse").agg(F.count("*").alias("sampled"), F.count("ok").alias("recalled"))
    d = det.join(right.select(F.col("l_id").alias("id")).distinct().withColumn("ok", F.lit(1)), "id", "left").join(hit.filter("klasse <> rk").select(F.col("l_id").alias("id")).distinct().withColumn("other", F.lit(1)), "id", "left")
    d = d.groupBy("klasse").agg(F.count("*").alias("detected"), F.count("ok").alias("correct"), F.count_if(F.col("ok").isNull() & F.col("other").isNotNull()).alias("confused"))
    return d.join(r, "klasse", "left").select("klasse", "detected", "correct", "confused", F.coalesce("sampled", F.lit(0)).alias("sampled"), F.coalesce("recalled", F.lit(0)).alias("recalled"))


def map_agreement(a: DataFrame, b: DataFrame, tolerances: tuple[int, ...]) -> DataFrame:
    """For each tolerance in cells: share of A near B and of B near A, for cell sets (site, col, row_)."""
    from plotcheck.operators.raster import offsets

    def share(p: DataFrame, q: DataFrame, n: int, name: str) -> DataFrame:
        near = offsets(q.select("site", "col", "row_"), n).distinct().withColumn("hit", F.lit(1))
        return p.join(near, ["site", "col", "row_"], "left").groupBy("site").agg((F.count("hit") / F.count("*")).alias(name))

    out = None
    for n in tolerances:
        part = share(a, b, n, "a_near_b").join(share(b, a, n, "b_near_a"), "site").withColumn("cells", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def worst(df: DataFrame, by: str, label: str, ranks: dict[str, int]) -> DataFrame:
    """The label of the highest rank in each group."""
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return df.groupBy(by).agg(F.max_by(label, rank[F.col(label)]).alias(label))


def latency_summary(df: DataFrame, value: str, by: str, limit: float) -> DataFrame:
    p = lambda q: F.expr(f"percentile({value}, {q})")
    return df.groupBy(by).agg(F.count(value).alias("n"), p(0.5).alias("median"), p(0.95).alias("p95"), F.max(value).alias("worst"), (F.count_if(F.col(value) < limit) / F.count(value)).alias("fast"))


def per_key_summary(df: DataFrame, key: str) -> DataFrame:
    """Median, 90th percentile and maximum of the rows for each key."""
    n = materialize(df.groupBy(key).agg(F.count("*").alias("n")).select("n"), "per_key")
    q = exact_quantiles(n, {"median": ("n", 0.5), "p90": ("n", 0.9)})
    value = lambda x: F.lit(q[x]).cast("double").alias(x)
    return n.agg(F.count("*").alias("keys"), F.sum("n").alias("rows"), F.max("n").alias("most")).select("keys", "rows", value("median"), value("p90"), "most")


def tape_comparison(pairs: DataFrame) -> DataFrame:
    """Median absolute error of measured against estimated extents by source and measure, and whether within the target."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.abs(F.col(f"m_{m}") - F.col(f"e_{m}")).alias("error")) for m in ("length", "width", "height")])
    e = pairs.select("source", F.explode(each).alias("x")).select("source", "x.*")
    return e.groupBy("source", "measure").agg(F.count("error").alias("n"), F.median("error").alias("error")).withColumn("target", F.col("error") <= 0.5)


def prediction_agreement(a: DataFrame, b: DataFrame, value: str, by: str) -> DataFrame:
    """Median, least and share of at least 0.99 of an agreement on the same keys."""
    m = a.join(b, "id")
    return m.groupBy(by).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.min(value).alias("least"), (F.count_if(F.col(value) >= 0.99) / F.count("*")).alias("share"))


def threshold_sweep(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The threshold with the best F1 for each class, the lowest of equals; rows have label, klasse and p."""
    s = cross_scenarios(rows, thresholds)
    hit = F.col("p") >= F.col("t")
    m = s.groupBy("klasse", "t").agg(F.count_if(hit & F.col("label")).alias("tp"), F.count_if(hit & ~F.col("label")).alias("fp"), F.count_if(~hit & F.col("label")).alias("fn"))
    m = with_rates(m).withColumn("f1", F.round(F.coalesce("f1", F.lit(0.0)), 9))
    return m.groupBy("klasse").agg(F.max_by(F.struct("t", "f1"), F.struct("f1", -F.col("t"))).alias("b")).select("klasse", "b.t", "b.f1")


def confidence_sweep(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Detections kept and precision of the merged class at each confidence."""
    s = cross_scenarios(rows, thresholds).filter("p >= t")
    return s.groupBy("t").agg(F.count("*").alias("kept"), (F.count_if("label") / F.count("*")).alias("precision"))


def release_gate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Released only if no class loses F1; each class with its reason."""
    c = compare_versions(old, new)
    return c.select("klasse", "old", "new", F.when(F.col("gain") < 0, "loses").otherwise("holds").alias("reason"), F.bool_and(F.col("gain") >= 0).over(W.partitionBy()).alias("released"))


def frozen_checksum(df: DataFrame, by: str, key: str) -> DataFrame:
    """(by, checksum, n): a digest of each group's keys in any order, repeats included.

    Each key's sha256 is cut into eight numbers that are added up over the group, so that groups of any size combine
    before the shuffle; the checksum is the sha256 of the sums and the count.
    """
    sha = F.sha2(F.col(key).cast("string"), 256)
    part = lambda i: F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = df.groupBy(by).agg(*[F.sum(part(i)).alias(f"p{i}") for i in range(8)], F.count("*").alias("n"))
    return sums.select(by, F.sha2(F.concat_ws("-", *[F.col(f"p{i}").cast("string") for i in range(8)], F.col("n").cast("string")), 256).alias("checksum"), "n")


def verify_frozen(df: DataFrame, by: str, key: str, frozen: DataFrame) -> DataFrame:
    """Groups whose checksum is not the frozen one."""
    now = frozen_checksum(df, by, key).select(by, F.col("checksum").alias("now"))
    return frozen.join(now, by, "full").filter(~F.col("checksum").eqNullSafe(F.col("now"))).select(by)


def global_offset(pairs: DataFrame) -> DataFrame:
    """Median shift between linked outlines."""
    shifts = materialize(pairs.select("dx", "dy"), "shifts")
    q = exact_quantiles(shifts, {"dx": ("dx", 0.5), "dy": ("dy", 0.5)})
    return shifts.agg(F.count("*").alias("n")).select(F.lit(q["dx"]).cast("double").alias("dx"), F.lit(q["dy"]).cast("double").alias("dy"), "n")


def random_cap(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """At most ``n`` rows, in salted order."""
    return df.orderBy(salted(seed, key), key).limit(n)


def error_sample(df: DataFrame, by: str, key: str, n: int, seed: str, verdicts: DataFrame) -> DataFrame:
    """``n`` rows of each variant for judgement by hand, and the precision of those judged."""
    w = W.partitionBy(by).orderBy(salted(seed, key), key)
    s = df.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n).join(verdicts, key, "left")
    return s.groupBy(by).agg(F.count("*").alias("sampled"), F.count("right").alias("judged"), (F.count_if("right") / F.nullif(F.count("right"), F.lit(0))).alias("precision"))


def best_place(cells: DataFrame, by: str) -> DataFrame:
    """Green before yellow, then the nearest, then the smallest id."""
    rank = F.when(F.col("colour") == "green", 0).when(F.col("colour") == "yellow", 1)
    ok = cells.filter(rank.isNotNull())
    best = ok.groupBy(by).agg(F.min(F.struct(rank.alias("rank"), F.round("distance", 6).alias("distance"), F.col("id"))).alias("b"))
    return best.select(by, "b.id", "b.distance", F.when(F.col("b.rank") == 0, "green").otherwise("yellow").alias("colour"))


def thin_every_kth(df: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """Every k-th row of each group, so that at most ``most`` are left."""
    w = W.partitionBy(by)
    d = df.withColumns({"nth": F.row_number().over(w.orderBy(key)) - 1, "all": F.count("*").over(w)})
    return d.filter(F.col("nth") % F.ceil(F.col("all") / most) == 0).drop("nth", "all")


def latest_per_key(df: DataFrame, keys: list[str], date: str, tie: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc(date), F.desc(tie))
    return df.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def stable_ids(df: DataFrame, prefix: str, *order: str) -> DataFrame:
    """Consecutive ids in a total order, numbered within ranges of it first, so that no task sorts all rows."""
    ranged = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    nth = ranged.withColumn("nth", F.row_number().over(W.partitionBy("part").orderBy(*order)))
    from plotcheck.storage import materialize

    nth = materialize(nth, "ids")
    before = nth.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return nth.join(before, "part").withColumn("stable_id", F.concat(F.lit(prefix), F.lpad((F.col("before") + F.col("nth")).cast("string"), 9, "0"))).drop("part", "nth", "before")


def retain_within_budget(files: DataFrame, by: str, most: float) -> DataFrame:
    """The most recently used files of each group up to ``most`` bytes."""
    w = W.partitionBy(by).orderBy(F.desc("used"), "key").rowsBetween(W.unboundedPreceding, 0)
    return files.withColumn("total", F.sum("size").over(w)).filter(F.col("total") <= most)


def weld_vertices(vertices: DataFrame, digits: int) -> DataFrame:
    """Vertices (v, x, y, z) with the smallest vertex that rounds to the same place."""
    key = [F.round(c, digits).alias(f"k{c}") for c in ("x", "y", "z")]
    k = vertices.select("v", *key)
    first = k.groupBy("kx", "ky", "kz").agg(F.min("v").alias("welded"))
    return k.join(first, ["kx", "ky", "kz"]).select("v", "welded")
