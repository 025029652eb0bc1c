"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotcheck.functions import geometry as g
from plotcheck.operators import evaluation as e
from plotcheck.operators.iterative import greedy_match
from plotcheck.plans.registry import query
from plotcheck.plans.spatial_queries import role, rounded


def boxes(view, *roles):  # noqa: ANN001, ANN002, ANN201
    return role(view, *roles).withColumnRenamed("obj_id", "id")


_IN = lambda *r: f"role IN ({', '.join(map(str, r))})"
_TOUCH = "a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2"
_IOU = f"round({g.box_iou('a.', 'b.')}, 9)"
_SETS = "l AS (SELECT * FROM footprint WHERE {a}), r AS (SELECT * FROM footprint WHERE {b})"
_ROLE01 = _SETS.format(a="role = 0", b="role IN (1, 2, 3, 4, 5)")
_LINK = f"""m AS (SELECT a.obj_id AS id, b.obj_id AS partner, {_IOU} AS iou FROM l a JOIN r b ON {_TOUCH} WHERE {g.box_overlap('a.', 'b.')} > 0 AND {g.box_iou('a.', 'b.')} > 0.3),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY iou DESC, partner) AS nth FROM m), links AS (SELECT l.obj_id AS id, partner, iou FROM l LEFT JOIN k ON k.id = l.obj_id AND nth = 1)"""


@query("best_overlap_link", f"WITH {_ROLE01}, {_LINK} SELECT id, partner, iou FROM links")
def _(view):
    return rounded(e.best_overlap_link(boxes(view, 0), boxes(view, 1, 2, 3, 4, 5), 0.3), "iou", digits=9)


@query("append_unmatched", f"WITH {_ROLE01}, {_LINK} SELECT obj_id AS id, 'left' AS origin FROM l UNION ALL SELECT obj_id, 'right' FROM r WHERE obj_id NOT IN (SELECT partner FROM links WHERE partner IS NOT NULL)")
def _(view):
    return e.append_unmatched(boxes(view, 0), boxes(view, 1, 2, 3, 4, 5), 0.3)


@query("label_candidates", f"""
WITH {_SETS.format(a='role IN (3, 4)', b='role IN (8, 9)')},
m AS (SELECT a.obj_id AS id, b.obj_id AS r_id, b.klasse, round(least({g.box_overlap('a.', 'b.')} / {g.box_area('a.')}, 2 * {g.box_overlap('a.', 'b.')} / {g.box_area('b.')}), 9) AS w FROM l a JOIN r b ON {_TOUCH} WHERE {g.box_overlap('a.', 'b.')} > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, r_id) AS nth FROM m WHERE w >= 0.25)
SELECT l.obj_id AS id, coalesce(k.klasse, 'nichts') AS label FROM l LEFT JOIN k ON k.id = l.obj_id AND nth = 1""")
def _(view):
    return e.label_candidates(boxes(view, 3, 4), boxes(view, 8, 9), 0.25)


_F1 = "SELECT klasse, round(2.0e0 * sum(CASE WHEN confidence >= {t} AND sicher THEN 1 ELSE 0 END) / (2 * sum(CASE WHEN confidence >= {t} AND sicher THEN 1 ELSE 0 END) + sum(CASE WHEN confidence >= {t} AND NOT sicher THEN 1 ELSE 0 END) + sum(CASE WHEN confidence < {t} AND sicher THEN 1 ELSE 0 END)), 9) AS f1 FROM footprint WHERE role % 2 = {r} GROUP BY klasse"


def _f1(view, r, t):
    d = view("footprint").filter(F.col("role") % 2 == r)
    hit = F.col("confidence") >= t
    m = d.groupBy("klasse").agg(F.count_if(hit & F.col("sicher")).alias("tp"), F.count_if(hit & ~F.col("sicher")).alias("fp"), F.count_if(~hit & F.col("sicher")).alias("fn"))
    return rounded(e.with_rates(m), "f1", digits=9)


_OLDNEW = f"o AS ({_F1.format(t='0.5e0', r=1)} HAVING klasse <> 'baum'), n AS ({_F1.format(t='0.4e0', r=0)} HAVING klasse <> 'pool'), c AS (SELECT coalesce(o.klasse, n.klasse) AS klasse, coalesce(o.f1, 0) AS old, coalesce(n.f1, 0) AS new FROM o FULL JOIN n ON o.klasse = n.klasse)"


def _old_new(view):
    return _f1(view, 1, 0.5).filter("klasse <> 'baum'"), _f1(view, 0, 0.4).filter("klasse <> 'pool'")


@query("compare_versions", f"WITH {_OLDNEW} SELECT klasse, old, new, round(new - old, 9) AS gain FROM c")
def _(view):
    return rounded(e.compare_versions(*_old_new(view)), "gain", digits=9)


@query("release_gate", f"WITH {_OLDNEW} SELECT klasse, old, new, CASE WHEN new - old < 0 THEN 'loses' ELSE 'holds' END AS reason, bool_and(new - old >= 0) OVER () AS released FROM c")
def _(view):
    return e.release_gate(*_old_new(view))


def _thresholds(view, values):
    return view("region").sparkSession.createDataFrame([(v,) for v in values], "t double")


@query("cross_scenarios", "SELECT klasse, t, count(*) AS n FROM footprint CROSS JOIN (SELECT unnest([0.3e0, 0.5e0, 0.7e0]) AS t) WHERE role = 3 AND confidence >= t GROUP BY klasse, t")
def _(view):
    return e.cross_scenarios(role(view, 3), _thresholds(view, (0.3, 0.5, 0.7))).filter("confidence >= t").groupBy("klasse", "t").agg(F.count("*").alias("n"))


_STAGES = [("area", "(x2 - x1) * (y2 - y1) >= 12"), ("height", "eaves BETWEEN 2.2 AND 4.2"), ("confident", "confidence > 0.4"), ("official", "provenance = 'amtlich'")]


@query("filter_ladder", "WITH d AS (SELECT * FROM footprint WHERE role IN (3, 4)) " + " UNION ALL ".join(f"SELECT {i} AS stage, '{n}' AS name, count(*) AS \"rows\" FROM d WHERE " + " AND ".join(f"({c})" for _, c in _STAGES[: i + 1]) for i, (n, _) in enumerate(_STAGES)))
def _(view):
    return e.filter_ladder(role(view, 3, 4), [(n, F.expr(c)) for n, c in _STAGES])


_RULES = """rules AS (SELECT id, 'gartenhaus' AS klasse, CASE WHEN area BETWEEN 4 AND 30 AND height BETWEEN 1.8 AND 4 THEN 0.6e0 ELSE 0 END AS score FROM d UNION ALL
SELECT id, 'pool', CASE WHEN area BETWEEN 6 AND 80 AND height < 2.5 THEN 0.5e0 ELSE 0 END FROM d UNION ALL SELECT id, 'baum', CASE WHEN height > 3 AND area < 12 THEN 0.7e0 ELSE 0 END FROM d)"""
_D = "d AS (SELECT obj_id AS id, (x2 - x1) * (y2 - y1) AS area, eaves AS height FROM footprint WHERE role IN (3, 4))"


def _sized(view):
    return role(view, 3, 4).selectExpr("obj_id AS id", "(x2 - x1) * (y2 - y1) AS area", "eaves AS height")


@query("rule_scores", f"WITH {_D}, {_RULES} SELECT id, klasse, score FROM rules")
def _(view):
    return e.rule_scores(_sized(view))


_KLASSEN = ("gartenhaus", "pool", "baum", "nichts")
_WEIGHT = "CAST(1 + (id * {m}) % 13 AS DOUBLE)"
_SUM = " + ".join(_WEIGHT.format(m=m) for m in (3, 5, 7, 11))
_PROB = "prob AS (" + " UNION ALL ".join(f"SELECT id, '{k}' AS klasse, {_WEIGHT.format(m=m)} / ({_SUM}) AS p FROM d" for k, m in zip(_KLASSEN, (3, 5, 7, 11), strict=True)) + ")"


def _prob(view):
    each = F.array(*[F.struct(F.lit(k).alias("klasse"), (F.expr(_WEIGHT.format(m=m)) / F.expr(_SUM)).alias("p")) for k, m in zip(_KLASSEN, (3, 5, 7, 11), strict=True)])
    return _sized(view).select("id", F.explode(each).alias("x")).select("id", "x.*")


@query("blend_probabilities", f"""
WITH {_D}, {_RULES}, {_PROB}, z AS (SELECT p.id, p.klasse, CASE WHEN p.klasse = 'pool' AND d.height > 4 THEN 0 ELSE p END AS p FROM prob p JOIN d ON d.id = p.id),
j AS (SELECT z.id, z.klasse, p, greatest(p, coalesce(score, 0)) AS q, coalesce(score, 0) > p AS ruled FROM z LEFT JOIN rules r ON r.id = z.id AND r.klasse = z.klasse),
s AS (SELECT *, sum(CASE WHEN ruled THEN q ELSE 0 END) OVER (PARTITION BY id) AS taken, sum(CASE WHEN ruled THEN 0 ELSE q END) OVER (PARTITION BY id) AS free FROM j)
SELECT id, klasse, round(CASE WHEN ruled THEN q WHEN free > 0 THEN q * greatest(1 - taken, 0) / free ELSE 0 END, 6) AS p FROM s""")
def _(view):
    impossible = _sized(view).filter("height > 4").select("id", F.lit("pool").alias("klasse"))
    return rounded(e.blend_probabilities(_prob(view), e.rule_scores(_sized(view)), impossible), "p")


@query("top_k_classes", f"WITH {_D}, {_PROB}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, klasse) AS nth FROM prob WHERE klasse <> 'nichts') SELECT id, klasse, round(p, 6) AS p, CAST(nth AS INTEGER) AS \"rank\" FROM k WHERE nth <= 2")
def _(view):
    return rounded(e.top_k_classes(_prob(view), 2), "p")


@query("no_object", "SELECT obj_id, confidence < 0.3 OR CAST(obj_id % 100 AS DOUBLE) / 100 > 0.6 AS none FROM footprint WHERE role IN (3, 4)")
def _(view):
    return role(view, 3, 4).select("obj_id", e.no_object(F.col("confidence"), F.expr("CAST(obj_id % 100 AS DOUBLE) / 100")).alias("none"))


@query("rectangle_decision", "SELECT obj_id, CASE WHEN confidence >= 0.65 THEN 'rectangle' WHEN confidence < 0.55 THEN 'outline' WHEN klasse = 'gartenhaus' THEN 'rectangle' ELSE 'outline' END AS shape FROM footprint WHERE role IN (3, 4)")
def _(view):
    return role(view, 3, 4).select("obj_id", e.rectangle_decision(F.col("confidence"), F.col("klasse") == "gartenhaus").alias("shape"))


def _salt(seed, *keys):
    return f"sha256(concat_ws('/', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}))"


@query("stratified_split", f"WITH k AS (SELECT parcel_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {_salt('s1', 'parcel_id')}, parcel_id) AS nth FROM parcel) SELECT parcel_id, stratum, CASE WHEN nth <= 20 THEN 'test' ELSE 'dev' END AS part FROM k")
def _(view):
    return e.stratified_split(view("parcel").select("parcel_id", "stratum"), "stratum", "parcel_id", 20, "s1")


@query("quota_sample", f"""WITH k AS (SELECT obj_id, klasse, row_number() OVER (PARTITION BY klasse ORDER BY {_salt('q', 'obj_id')}, obj_id) AS nth FROM footprint)
SELECT klasse, count(*) AS taken, CAST(sum(obj_id) AS BIGINT) AS ids, greatest(320 - count(*), 0) AS shortfall FROM k WHERE nth <= 320 GROUP BY klasse""")
def _(view):
    return e.quota_sample(view("footprint"), "klasse", "obj_id", 320, "q")


@query("group_kfold", f"WITH r AS (SELECT plot, dense_rank() OVER (ORDER BY {_salt('k', 'plot')}, plot) % 5 AS fold FROM (SELECT DISTINCT plot FROM class_prob)) SELECT cand_id, c.plot, CAST(fold AS INTEGER) AS fold FROM class_prob c JOIN r ON r.plot = c.plot")
def _(view):
    return e.group_kfold(view("class_prob").select("cand_id", "plot"), "plot", 5, "k")


@query("running_version", """
WITH r AS (SELECT klasse, parcel_id % 9 AS version FROM footprint WHERE role = 3), k AS (SELECT v AS version, CASE WHEN v % 2 = 0 THEN 'released' ELSE 'rejected' END AS status FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS v))
SELECT klasse, max(r.version) + 1 AS next, CAST(sum(CASE WHEN status IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS open, max(CASE WHEN status = 'released' THEN r.version END) AS released FROM r LEFT JOIN k ON k.version = r.version GROUP BY klasse""")
def _(view):
    r = role(view, 3).selectExpr("klasse", "parcel_id % 9 AS version")
    known = view("region").sparkSession.createDataFrame([(v, "rejected" if v % 2 else "released") for v in range(7)], "version long, status string")
    return e.running_version(r, known)


_JUDGED = f"""RECURSIVE {_SETS.format(a='role IN (3, 4)', b='role IN (8, 9)')}, m AS (SELECT concat(a.parcel_id, a.klasse) AS grp, a.obj_id AS l_id, b.obj_id AS r_id, {_IOU} AS iou FROM l a JOIN r b ON {_TOUCH} AND a.klasse = b.klasse WHERE {_IOU} >= 0.3),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY iou DESC, l_id DESC, r_id DESC) AS nth FROM m),
gr AS (SELECT DISTINCT grp, CAST(0 AS BIGINT) AS nth, CAST([] AS BIGINT[]) AS li, CAST([] AS BIGINT[]) AS ri FROM o UNION ALL
  SELECT gr.grp, o.nth, CASE WHEN list_contains(li, l_id) OR list_contains(ri, r_id) THEN li ELSE list_append(li, l_id) END, CASE WHEN list_contains(li, l_id) OR list_contains(ri, r_id) THEN ri ELSE list_append(ri, r_id) END FROM gr JOIN o ON o.grp = gr.grp AND o.nth = gr.nth + 1),
la AS (SELECT grp, unnest(li) AS l_id, unnest(ri) AS r_id FROM gr WHERE nth = (SELECT max(nth) FROM o WHERE o.grp = gr.grp)),
p AS (SELECT la.l_id, la.r_id, iou FROM la JOIN m ON m.l_id = la.l_id AND m.r_id = la.r_id),
un AS (SELECT DISTINCT a.obj_id FROM l a JOIN r b ON {_TOUCH} AND NOT b.sicher),
e AS (SELECT a.klasse, b.obj_id AS rid, un.obj_id AS unsure, iou, round(abs(greatest(a.x2 - a.x1, a.y2 - a.y1) - greatest(b.x2 - b.x1, b.y2 - b.y1)), 9) AS dl, round(abs(least(a.x2 - a.x1, a.y2 - a.y1) - least(b.x2 - b.x1, b.y2 - b.y1)), 9) AS db,
  round(abs(a.eaves - CASE WHEN b.obj_id % 3 <> 0 THEN b.eaves END), 9) AS dh FROM l a LEFT JOIN p ON p.l_id = a.obj_id LEFT JOIN r b ON b.obj_id = p.r_id LEFT JOIN un ON un.obj_id = a.obj_id),
judged AS (SELECT klasse, rid IS NOT NULL AS tp, rid IS NULL AND unsure IS NULL AS fp, false AS fn, iou, dl, db, dh, CASE WHEN dl <= 1 THEN 1 ELSE 0 END + CASE WHEN db <= 1 THEN 1 ELSE 0 END + CASE WHEN dh <= 1 THEN 1 ELSE 0 END AS held,
  CASE WHEN dl IS NULL THEN 0 ELSE 1 END + CASE WHEN db IS NULL THEN 0 ELSE 1 END + CASE WHEN dh IS NULL THEN 0 ELSE 1 END AS spans FROM e
  UNION ALL SELECT klasse, false, false, true, NULL, NULL, NULL, NULL, 0, 0 FROM r WHERE sicher AND obj_id NOT IN (SELECT r_id FROM p))"""
_COUNTS = "CAST(sum(CASE WHEN tp THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN fp THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN fn THEN 1 ELSE 0 END) AS BIGINT) AS fn"
_RATES = "round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 9) AS precision, round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 9) AS recall, CASE WHEN tp + fp + fn > 0 THEN round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 9) END AS f1"


def _judged(view):
    det = boxes(view, 3, 4).join(view("footprint").select(F.col("obj_id").alias("id"), F.col("eaves").alias("height")), "id").withColumn("span", F.lit(1.0))
    height = view("footprint").select(F.col("obj_id").alias("id"), F.when(F.col("obj_id") % 3 != 0, F.col("eaves")).alias("height"))
    return e.judged(det, boxes(view, 8, 9).join(height, "id"), greedy_match)


@query("class_metrics", f"""WITH {_JUDGED}, c AS (SELECT klasse, {_COUNTS}, round(avg(iou), 6) AS mean_iou, round(median(dl), 6) AS median_length, round(median(db), 6) AS median_width, round(median(dh), 6) AS median_height,
  round(sum(held) / CAST(nullif(sum(spans), 0) AS DOUBLE), 9) AS in_span FROM judged GROUP BY klasse) SELECT *, {_RATES} FROM c""")
def _(view):
    out = rounded(e.class_metrics(_judged(view)), "mean_iou", "median_length", "median_width", "median_height")
    return rounded(out, "precision", "recall", "f1", "in_span", digits=9)


@query("metrics_rollup", f"""
WITH {_JUDGED}, c AS (SELECT klasse, {_COUNTS} FROM judged GROUP BY klasse UNION ALL SELECT 'kleinbau', {_COUNTS} FROM judged WHERE klasse IN ('gartenhaus', 'carport_garage') UNION ALL SELECT 'gesamt', {_COUNTS} FROM judged) SELECT *, {_RATES} FROM c""")
def _(view):
    return rounded(e.metrics_rollup(_judged(view)), "precision", "recall", "f1", digits=9)


@query("blockwise_eval", f"""
WITH {_SETS.format(a='role IN (3, 4)', b='role IN (8, 9)')}, h AS (SELECT a.obj_id AS l_id, b.obj_id AS r_id, a.klasse = b.klasse AS same FROM l a JOIN r b ON {_TOUCH} WHERE {g.box_overlap('a.', 'b.')} > 0),
d AS (SELECT klasse, count(*) AS detected, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS correct, CAST(sum(CASE WHEN NOT ok AND other THEN 1 ELSE 0 END) AS BIGINT) AS confused FROM
  (SELECT klasse, obj_id IN (SELECT l_id FROM h WHERE same) AS ok, obj_id IN (SELECT l_id FROM h WHERE NOT same) AS other FROM l) GROUP BY klasse),
s AS (SELECT klasse, count(*) AS sampled, CAST(sum(CASE WHEN obj_id IN (SELECT r_id FROM h WHERE same) THEN 1 ELSE 0 END) AS BIGINT) AS recalled FROM r WHERE CAST(floor(x1 / 100) * 7 + floor(y1 / 100) AS BIGINT) % 3 = 0 GROUP BY klasse)
SELECT d.klasse, detected, correct, confused, coalesce(sampled, 0) AS sampled, coalesce(recalled, 0) AS recalled FROM d LEFT JOIN s ON s.klasse = d.klasse""")
def _(view):
    return e.blockwise_eval(boxes(view, 3, 4), boxes(view, 8, 9), 100.0, 3)


@query("failure_funnel", f"""
WITH ref AS (SELECT * FROM footprint WHERE role IN (8, 9)), c AS (SELECT * FROM footprint WHERE role = 3), d AS (SELECT * FROM footprint WHERE role = 4),
s AS (SELECT klasse, CASE WHEN NOT EXISTS (SELECT 1 FROM c b WHERE {g.box_overlap('a.', 'b.')} > 0) THEN 'no_candidate' WHEN NOT EXISTS (SELECT 1 FROM d b WHERE a.klasse = b.klasse AND {g.box_overlap('a.', 'b.')} > 0) THEN 'wrong_class' ELSE 'found' END AS stage FROM ref a)
SELECT klasse, stage, count(*) AS n FROM s GROUP BY klasse, stage""")
def _(view):
    return e.failure_funnel(boxes(view, 8, 9), boxes(view, 3), boxes(view, 4))


_SITE = "SELECT DISTINCT obj_id % 4 AS site, CAST(floor(x1 / 10) AS BIGINT) AS col, CAST(floor(y1 / 10) AS BIGINT) AS row_ FROM footprint WHERE role = {}"


@query("map_agreement", f"""
WITH a AS ({_SITE.format(3)}), b AS ({_SITE.format(5)}), n AS (SELECT unnest([1, 2]) AS cells),
x AS (SELECT site, cells, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.site = a.site AND abs(b.col - a.col) <= cells AND abs(b.row_ - a.row_) <= cells) THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS s FROM a, n GROUP BY site, cells),
y AS (SELECT site, cells, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM a WHERE b.site = a.site AND abs(b.col - a.col) <= cells AND abs(b.row_ - a.row_) <= cells) THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS s FROM b, n GROUP BY site, cells)
SELECT x.site, x.cells, round(x.s, 9) AS a_near_b, round(y.s, 9) AS b_near_a FROM x JOIN y ON x.site = y.site AND x.cells = y.cells""")
def _(view):
    cells = lambda r: role(view, r).select(F.expr("obj_id % 4 AS site"), F.floor(F.col("x1") / 10).alias("col"), F.floor(F.col("y1") / 10).alias("row_")).distinct()
    return rounded(e.map_agreement(cells(3), cells(5), (1, 2)), "a_near_b", "b_near_a", digits=9)


@query("worst_provenance", "SELECT parcel_id, CASE max(CASE provenance WHEN 'amtlich' THEN 0 WHEN 'nutzerbestätigt' THEN 1 ELSE 2 END) WHEN 0 THEN 'amtlich' WHEN 1 THEN 'nutzerbestätigt' ELSE 'erkannt' END AS provenance FROM footprint GROUP BY parcel_id")
def _(view):
    return e.worst(view("footprint"), "parcel_id", "provenance", {"amtlich": 0, "nutzerbestätigt": 1, "erkannt": 2})


@query("worst_status", "SELECT parcel_id, CASE max(CASE WHEN eaves > 4 THEN 2 WHEN eaves > 3 THEN 1 ELSE 0 END) WHEN 0 THEN 'ok' WHEN 1 THEN 'warn' ELSE 'bad' END AS status FROM footprint GROUP BY parcel_id")
def _(view):
    f = view("footprint").withColumn("status", F.expr("CASE WHEN eaves > 4 THEN 'bad' WHEN eaves > 3 THEN 'warn' ELSE 'ok' END"))
    return e.worst(f, "parcel_id", "status", {"ok": 0, "warn": 1, "bad": 2})


@query("latency_summary", "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS worst, round(CAST(sum(CASE WHEN value < 1 THEN 1 ELSE 0 END) AS DOUBLE) / count(value), 9) AS fast FROM events GROUP BY event_type")
def _(view):
    return rounded(rounded(e.latency_summary(view("events"), "value", "event_type", 1.0), "median", "p95"), "fast", digits=9)


@query("windows_per_parcel", """
WITH n AS (SELECT parcel_id, (CAST(floor((x0 + w + skew + 20 - 48) / 48 + 0.5) AS BIGINT) - CAST(floor((x0 - 20 - 48) / 48 + 0.5) AS BIGINT) + 1) * (CAST(floor((y0 + h + 20 - 48) / 48 + 0.5) AS BIGINT) - CAST(floor((y0 - 20 - 48) / 48 + 0.5) AS BIGINT) + 1) AS n FROM parcel)
SELECT count(*) AS keys, CAST(sum(n) AS BIGINT) AS "rows", quantile_cont(n, 0.5) AS median, round(quantile_cont(n, 0.9), 6) AS p90, max(n) AS most FROM n""")
def _(view):
    from plotcheck.operators.spatial import windows_for_extent

    ext = view("parcel").selectExpr("parcel_id", "x0 AS x1", "y0 AS y1", "x0 + w + skew AS x2", "y0 + h AS y2")
    return rounded(e.per_key_summary(windows_for_extent(ext, 20.0), "parcel_id"), "p90")


_TAPE = "SELECT a.obj_id, a.provenance AS source, a.x2 - a.x1 AS m_length, a.y2 - a.y1 AS m_width, a.eaves AS m_height, b.x2 - b.x1 AS e_length, b.y2 - b.y1 AS e_width, b.eaves AS e_height FROM footprint a JOIN footprint b ON a.parcel_id = b.parcel_id AND a.role = 2 AND b.role = 3"


@query("tape_comparison", f"""
WITH p AS ({_TAPE}), u AS (SELECT source, 'length' AS measure, abs(m_length - e_length) AS error FROM p UNION ALL SELECT source, 'width', abs(m_width - e_width) FROM p UNION ALL SELECT source, 'height', abs(m_height - e_height) FROM p)
SELECT source, measure, count(error) AS n, round(median(error), 6) AS error, round(median(error), 6) <= 0.5 AS target FROM u GROUP BY source, measure""")
def _(view):
    ext = lambda r, p: role(view, r).selectExpr("parcel_id", *(["provenance AS source"] if p == "m" else []), f"x2 - x1 AS {p}_length", f"y2 - y1 AS {p}_width", f"eaves AS {p}_height")
    out = rounded(e.tape_comparison(ext(2, "m").join(ext(3, "e"), "parcel_id")), "error")
    return out.withColumn("target", F.col("error") <= 0.5)


@query("prediction_agreement", f"""
WITH a AS (SELECT obj_id AS id, klasse, x1, y1, x2, y2 FROM footprint WHERE role = 3), b AS (SELECT obj_id AS id, x1 + (obj_id % 3) / 10.0e0 AS x1, y1, x2 + (obj_id % 3) / 10.0e0 AS x2, y2 FROM footprint WHERE role = 3),
m AS (SELECT klasse, {_IOU} AS iou FROM a JOIN b ON a.id = b.id)
SELECT klasse, count(*) AS n, round(median(iou), 6) AS median, round(min(iou), 6) AS least, round(CAST(sum(CASE WHEN iou >= 0.99 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS share FROM m GROUP BY klasse""")
def _(view):
    a = boxes(view, 3).select("id", "klasse", *[F.col(c).alias("a_" + c) for c in e.BOX])
    b = boxes(view, 3).selectExpr("id", "x1 + CAST(id % 3 AS DOUBLE) / 10 AS b_x1", "y1 AS b_y1", "x2 + CAST(id % 3 AS DOUBLE) / 10 AS b_x2", "y2 AS b_y2")
    m = a.join(b, "id").withColumn("iou", F.expr(f"round({g.box_iou('a_', 'b_')}, 9)"))
    return rounded(rounded(e.prediction_agreement(m.select("id", "klasse", "iou"), b.select("id"), "iou", "klasse"), "median", "least"), "share", digits=9)


@query("variant_table", """
WITH v AS (SELECT unnest([0.2e0, 0.4e0, 0.6e0]) AS t), d AS (SELECT t, parcel_id FROM footprint, v WHERE role = 3 AND confidence >= t), r AS (SELECT parcel_id FROM footprint WHERE role = 5)
SELECT v.t, (SELECT count(*) FROM d WHERE d.t = v.t) AS detected, (SELECT count(*) FROM r WHERE parcel_id IN (SELECT parcel_id FROM d WHERE d.t = v.t)) AS recalled FROM v""")
def _(view):
    d = e.cross_scenarios(role(view, 3), _thresholds(view, (0.2, 0.4, 0.6))).filter("confidence >= t")
    r = e.cross_scenarios(role(view, 5).select("parcel_id"), _thresholds(view, (0.2, 0.4, 0.6)))
    recalled = r.join(d.select("t", "parcel_id"), ["t", "parcel_id"], "left_semi").groupBy("t").agg(F.count("*").alias("recalled"))
    found = _thresholds(view, (0.2, 0.4, 0.6)).join(d.groupBy("t").agg(F.count("*").alias("detected")), "t", "left").join(recalled, "t", "left")
    return found.select("t", F.coalesce("detected", F.lit(0)).alias("detected"), F.coalesce("recalled", F.lit(0)).alias("recalled"))


_SWEEP = "s AS (SELECT klasse, t, sum(CASE WHEN p >= t AND label THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p >= t AND NOT label THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN p < t AND label THEN 1 ELSE 0 END) AS fn FROM (SELECT klasse, confidence AS p, sicher AS label FROM footprint WHERE role % 2 = 1), (SELECT unnest([0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0]) AS t) GROUP BY klasse, t)"


def _labelled(view):
    return view("footprint").filter("role % 2 = 1").selectExpr("klasse", "confidence AS p", "sicher AS label")


@query("threshold_sweep", f"WITH {_SWEEP}, f AS (SELECT klasse, t, coalesce(round(2.0e0 * tp / nullif(2 * tp + fp + fn, 0), 9), 0) AS f1 FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY klasse ORDER BY f1 DESC, t) AS nth FROM f) SELECT klasse, t, f1 FROM k WHERE nth = 1")
def _(view):
    return e.threshold_sweep(_labelled(view), _thresholds(view, (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)))


@query("confidence_sweep", "SELECT t, count(*) AS kept, round(CAST(sum(CASE WHEN sicher THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS precision FROM footprint, (SELECT unnest([0.5e0, 0.6e0, 0.7e0, 0.8e0]) AS t) WHERE role % 2 = 1 AND klasse IN ('gartenhaus', 'carport_garage') AND confidence >= t GROUP BY t")
def _(view):
    rows = _labelled(view).filter("klasse IN ('gartenhaus', 'carport_garage')")
    return rounded(e.confidence_sweep(rows, _thresholds(view, (0.5, 0.6, 0.7, 0.8))), "precision", digits=9)


_PARTS = ", ".join(f"sum(CAST(concat('0x', substr(sha256(CAST(obj_id AS VARCHAR)), {8 * i + 1}, 8)) AS BIGINT)) AS p{i}" for i in range(8))


@query("frozen_set", f"SELECT klasse, sha256(concat_ws('-', {', '.join(f'p{i}' for i in range(8))}, n)) AS checksum, n FROM (SELECT klasse, {_PARTS}, count(*) AS n FROM footprint GROUP BY klasse)")
def _(view):
    return e.frozen_checksum(view("footprint"), "klasse", "obj_id")


@query("global_offset", "SELECT round(median(b.x1 - a.x1), 6) AS dx, round(median(b.y1 - a.y1), 6) AS dy, count(*) AS n FROM footprint a JOIN footprint b ON a.parcel_id = b.parcel_id AND a.role = 3 AND b.role = 5")
def _(view):
    a = role(view, 3).selectExpr("parcel_id", "x1 AS ax", "y1 AS ay")
    m = role(view, 5).select("parcel_id", "x1", "y1").join(a, "parcel_id").selectExpr("x1 - ax AS dx", "y1 - ay AS dy")
    return rounded(e.global_offset(m), "dx", "dy")


@query("random_cap", f"SELECT obj_id FROM footprint WHERE role = 4 ORDER BY {_salt('r', 'obj_id')}, obj_id LIMIT 100")
def _(view):
    return e.random_cap(role(view, 4).select("obj_id"), "obj_id", 100, "r")


@query("error_sample", f"""
WITH k AS (SELECT obj_id, klasse, sicher, obj_id % 3 <> 0 AS judged, row_number() OVER (PARTITION BY klasse ORDER BY {_salt('e', 'obj_id')}, obj_id) AS nth FROM footprint)
SELECT klasse, count(*) AS sampled, CAST(sum(CASE WHEN judged THEN 1 ELSE 0 END) AS BIGINT) AS judged, round(sum(CASE WHEN judged AND sicher THEN 1 ELSE 0 END) / CAST(nullif(sum(CASE WHEN judged THEN 1 ELSE 0 END), 0) AS DOUBLE), 9) AS precision FROM k WHERE nth <= 40 GROUP BY klasse""")
def _(view):
    verdicts = view("footprint").filter("obj_id % 3 <> 0").select("obj_id", F.col("sicher").alias("right"))
    return rounded(e.error_sample(view("footprint").select("obj_id", "klasse"), "klasse", "obj_id", 40, "e", verdicts), "precision", digits=9)


_COLOUR = "SELECT parcel_id, obj_id AS id, CASE WHEN confidence > 0.6 THEN 'green' WHEN confidence > 0.3 THEN 'yellow' ELSE 'red' END AS colour, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 6) AS distance"


@query("best_place", f"""
WITH c AS ({_COLOUR} FROM footprint f JOIN parcel USING (parcel_id)), k AS (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY CASE colour WHEN 'green' THEN 0 ELSE 1 END, distance, id) AS nth FROM c WHERE colour <> 'red')
SELECT parcel_id, id, distance, colour FROM k WHERE nth = 1""")
def _(view):
    c = view("footprint").join(view("parcel").select("parcel_id", "x0", "y0"), "parcel_id").selectExpr(*[x.strip() for x in ("parcel_id", "obj_id AS id", "CASE WHEN confidence > 0.6 THEN 'green' WHEN confidence > 0.3 THEN 'yellow' ELSE 'red' END AS colour", "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS distance")])
    return e.best_place(c, "parcel_id")


@query("order_findings", "SELECT obj_id, CAST(row_number() OVER (PARTITION BY parcel_id ORDER BY CASE WHEN role = 2 THEN 0 ELSE 1 END, (x2 - x1) * (y2 - y1) DESC, obj_id) AS INTEGER) AS place FROM footprint WHERE role IN (2, 3)")
def _(view):
    from pyspark.sql import Window as W

    own = F.when(F.col("role") == 2, 0).otherwise(1)
    w = W.partitionBy("parcel_id").orderBy(own, F.desc(F.expr("(x2 - x1) * (y2 - y1)")), "obj_id")
    return role(view, 2, 3).select("obj_id", F.row_number().over(w).alias("place"))


@query("thin_every_kth", "WITH k AS (SELECT parcel_id, obj_id, row_number() OVER (PARTITION BY parcel_id ORDER BY obj_id) - 1 AS nth, count(*) OVER (PARTITION BY parcel_id) AS n FROM footprint) SELECT parcel_id, obj_id FROM k WHERE nth % CAST(ceil(n / 4.0e0) AS BIGINT) = 0")
def _(view):
    return e.thin_every_kth(view("footprint").select("parcel_id", "obj_id"), "parcel_id", "obj_id", 4)


@query("latest_per_key", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY maker, model ORDER BY year_ DESC, row_id DESC) AS nth FROM device_catalog) SELECT maker, model, lw, year_, row_id FROM k WHERE nth = 1")
def _(view):
    return e.latest_per_key(view("device_catalog"), ["maker", "model"], "year_", "row_id").select("maker", "model", "lw", "year_", "row_id")


@query("stable_ids", "SELECT obj_id, concat('b', lpad(CAST(row_number() OVER (ORDER BY x1, y1, obj_id) AS VARCHAR), 9, '0')) AS stable_id FROM footprint WHERE role = 4")
def _(view):
    return e.stable_ids(role(view, 4).select("obj_id", "x1", "y1"), "b", "x1", "y1", "obj_id").select("obj_id", "stable_id")


@query("retain_within_budget", """
WITH f AS (SELECT user_id, event_id AS key, ts AS used, 1 + event_id % 5 AS size FROM contribution), t AS (SELECT *, CAST(sum(size) OVER (PARTITION BY user_id ORDER BY used DESC, key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM f)
SELECT user_id, key, size, total FROM t WHERE total <= 20""")
def _(view):
    f = view("contribution").selectExpr("user_id", "event_id AS key", "ts AS used", "1 + event_id % 5 AS size")
    return e.retain_within_budget(f, "user_id", 20).select("user_id", "key", "size", "total")


@query("weld_vertices", """
WITH v AS (SELECT parcel_id * 4 + seq AS v, round(x / 50, 0) AS kx, round(y / 50, 0) AS ky, round((seq % 2) * 0.3e0, 0) AS kz FROM parcel_vertex)
SELECT v, min(v) OVER (PARTITION BY kx, ky, kz) AS welded FROM v""")
def _(view):
    return e.weld_vertices(view("parcel_vertex").selectExpr("parcel_id * 4 + seq AS v", "x / 50 AS x", "y / 50 AS y", "(seq % 2) * 0.3D AS z"), 0)


@query("multi_region_union", "SELECT obj_id, 'a' AS region, eaves, NULL AS klasse FROM footprint WHERE role = 0 UNION ALL SELECT obj_id, 'b', NULL, klasse FROM footprint WHERE role = 2")
def _(view):
    from plotcheck.sources.files import multi_region_union

    return multi_region_union([role(view, 0).select("obj_id", F.lit("a").alias("region"), "eaves"), role(view, 2).select("obj_id", F.lit("b").alias("region"), "klasse")])


@query("union_objects", "SELECT obj_id, role FROM footprint WHERE role IN (2, 4, 7)")
def _(view):
    part = lambda r: role(view, r).select("obj_id", "role")
    return part(2).unionByName(part(4)).unionByName(part(7))


@query("except_erased", "SELECT event_id FROM contribution WHERE event_id NOT IN (SELECT event_id FROM contribution WHERE aktion = 'verworfen' AND user_id % 3 = 0)")
def _(view):
    c = view("contribution")
    return c.select("event_id").join(c.filter("aktion = 'verworfen' AND user_id % 3 = 0").select("event_id"), "event_id", "left_anti")


@query("distinct_by_key", "SELECT DISTINCT parcel_id, klasse, provenance FROM footprint WHERE role IN (8, 9)")
def _(view):
    return role(view, 8, 9).select("parcel_id", "klasse", "provenance").dropDuplicates(["parcel_id", "klasse", "provenance"])
