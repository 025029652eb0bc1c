"""Queries of the operators that take rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotcheck.operators import iterative as it
from plotcheck.operators.evaluation import overlaps
from plotcheck.plans.evaluation_queries import boxes
from plotcheck.plans.registry import query
from plotcheck.plans.spatial_queries import centres, role, rounded


@query("suppress_overlaps")
def _(view):
    return it.suppress_overlaps(view("footprint").withColumnRenamed("obj_id", "id")).select("id", "confidence")


@query("spaced_select")
def _(view):
    return it.spaced_select(centres(view("footprint")).select(F.col("obj_id").alias("id"), "x", "y"), 12.0, "w9")


@query("spaced_quota")
def _(view):
    points = centres(view("footprint")).select(F.col("obj_id").alias("id"), F.col("klasse").alias("stratum"), "x", "y")
    quotas = points.groupBy("stratum").agg(F.ceil(F.count("*") / 20).cast("int").alias("quota"))
    return it.spaced_quota(points, quotas, 12.0, "w9")


@query("greedy_match")
def _(view):
    m = overlaps(boxes(view, 3, 4), boxes(view, 0, 1, 2, 5, 6, 7, 8, 9))
    return it.greedy_match(m.select(F.col("l_id").alias("det"), F.col("r_id").alias("ref"), F.round("iou", 6).alias("iou")).filter("iou >= 0.05"))


_MASK = "nutzart IN ('Fließgewässer', 'Straßenverkehr')"
_LABEL = f"""m AS (SELECT col, row_, row_ * 2147483648 + col AS id FROM terrain_cell WHERE {_MASK}),
reach AS (SELECT id, id AS root FROM m UNION SELECT b.id, reach.root FROM reach JOIN m a ON a.id = reach.id JOIN m b ON abs(a.col - b.col) + abs(a.row_ - b.row_) = 1),
lab AS (SELECT m.col, m.row_, min(root) AS label FROM m JOIN reach ON reach.id = m.id GROUP BY m.col, m.row_)"""


@query("components", f"WITH RECURSIVE {_LABEL} SELECT col, row_, label FROM lab")
def labels(view):  # noqa: ANN001, ANN201
    return it.components(view("terrain_cell").filter(_MASK))


@query("component_stats", f"""WITH RECURSIVE {_LABEL}, s AS (SELECT label, count(*) AS cells, min(col) AS min_col, max(col) AS max_col, min(row_) AS min_row_, max(row_) AS max_row_ FROM lab GROUP BY label)
SELECT *, round(cells / CAST((max_col - min_col + 1) * (max_row_ - min_row_ + 1) AS DOUBLE), 9) AS rect, CASE WHEN cells < 3 THEN 'small' WHEN cells < 12 THEN 'medium' ELSE 'large' END AS band FROM s""")
def _(view):
    return rounded(it.component_stats(it.components(view("terrain_cell").filter(_MASK))), "rect", digits=9)


_TREE = """cb AS (SELECT c_nationkey, x0 AS x1, y0 AS y1, x0 + w AS x2, y0 + h AS y2 FROM customer JOIN parcel ON parcel_id = c_custkey),
nt AS (SELECT 100 + n_nationkey AS id, n_regionkey AS parent, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM nation JOIN cb ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey),
tree AS (SELECT parent AS id, CAST(NULL AS BIGINT) AS parent, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM nt GROUP BY parent UNION ALL SELECT id, parent, x1, y1, x2, y2 FROM nt
  UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, x0, y0, x0 + w, y0 + h FROM customer JOIN parcel ON parcel_id = c_custkey)"""


def _tree(view):
    c = view("customer").select("c_custkey", "c_nationkey").join(view("parcel"), F.col("parcel_id") == F.col("c_custkey"))
    leaf = c.selectExpr("1000 + c_custkey AS id", "100 + c_nationkey AS parent", "x0 AS x1", "y0 AS y1", "x0 + w AS x2", "y0 + h AS y2")
    box = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]
    nation = leaf.groupBy(F.col("parent").alias("id")).agg(*box).join(view("nation").selectExpr("100 + n_nationkey AS id", "n_regionkey AS parent"), "id").select("id", "parent", "x1", "y1", "x2", "y2")
    region = nation.groupBy(F.col("parent").alias("id")).agg(*box).select("id", F.lit(None).cast("bigint").alias("parent"), "x1", "y1", "x2", "y2")
    return region.unionByName(nation).unionByName(leaf)


_HIT = "x1 <= 700 AND x2 >= 300 AND y1 <= 500 AND y2 >= 200"
_WALK = f"walk AS (SELECT id, parent, x1, y1, x2, y2, 0 AS level FROM tree WHERE parent IS NULL AND {_HIT} UNION ALL SELECT t.id, t.parent, t.x1, t.y1, t.x2, t.y2, level + 1 FROM walk JOIN tree t ON t.parent = walk.id WHERE t.x1 <= 700 AND t.x2 >= 300 AND t.y1 <= 500 AND t.y2 >= 200)"


@query("descend_tree", f"WITH RECURSIVE {_TREE}, {_WALK} SELECT CAST(id AS BIGINT) AS id, level FROM walk")
def _(view):
    return it.descend_tree(_tree(view), (300.0, 200.0, 700.0, 500.0)).select("id", "level")


@query("level_stats", f"WITH RECURSIVE {_TREE}, {_WALK} SELECT level, count(*) AS n, round(avg((x2 - x1 + y2 - y1) / 2), 6) AS edge, round(median((x2 - x1 + y2 - y1) / 20), 6) AS threshold FROM walk GROUP BY level")
def _(view):
    return rounded(it.level_stats(it.descend_tree(_tree(view), (300.0, 200.0, 700.0, 500.0))), "edge", "threshold")


_FLOW = """nb AS (SELECT a.col, a.row_, b.col AS to_col, b.row_ AS to_row, round((a.z - b.z) / CASE WHEN a.col <> b.col AND a.row_ <> b.row_ THEN sqrt(2.0e0) ELSE 1 END, 9) AS slope
  FROM terrain_cell a JOIN terrain_cell b ON abs(a.col - b.col) <= 1 AND abs(a.row_ - b.row_) <= 1 AND (a.col <> b.col OR a.row_ <> b.row_)),
bs AS (SELECT *, row_number() OVER (PARTITION BY col, row_ ORDER BY slope DESC, to_row, to_col) AS nth FROM nb WHERE slope > 0),
flow AS (SELECT t.col, t.row_, to_col, to_row FROM terrain_cell t LEFT JOIN bs ON bs.col = t.col AND bs.row_ = t.row_ AND nth = 1)"""


@query("flow_direction", f"WITH {_FLOW} SELECT * FROM flow")
def _(view):
    return it.flow_direction(view("terrain_cell"))


@query("local_sinks", f"WITH {_FLOW} SELECT col, row_ FROM flow WHERE to_col IS NULL")
def _(view):
    return it.flow_direction(view("terrain_cell")).filter("to_col IS NULL").select("col", "row_")


@query("upslope_area", f"WITH RECURSIVE {_FLOW}, path AS (SELECT col, row_ FROM flow UNION ALL SELECT f.to_col, f.to_row FROM path JOIN flow f ON f.col = path.col AND f.row_ = path.row_ WHERE f.to_col IS NOT NULL) SELECT col, row_, count(*) AS area FROM path GROUP BY col, row_")
def _(view):
    return it.upslope_area(it.flow_direction(view("terrain_cell")))


_ROOF = "rf AS (SELECT DISTINCT obj_id, CAST(floor(x1 / 2) AS BIGINT) + i AS col, CAST(floor(y1 / 2) AS BIGINT) + j AS row_ FROM footprint, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1, 2]) AS j) WHERE role = 0)"


@query("roof_runoff_share", f"""WITH {_ROOF}, st AS (SELECT i, j FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
rg AS (SELECT DISTINCT obj_id, col + i AS col, row_ + j AS row_ FROM rf, st), x AS (SELECT rg.* FROM rg WHERE NOT EXISTS (SELECT 1 FROM rf WHERE rf.obj_id = rg.obj_id AND rf.col = rg.col AND rf.row_ = rg.row_)),
n AS (SELECT obj_id, count(*) AS roof FROM rf GROUP BY obj_id) SELECT x.obj_id, col, row_, round(roof / CAST(count(*) OVER (PARTITION BY x.obj_id) AS DOUBLE), 9) AS share FROM x JOIN n ON n.obj_id = x.obj_id""")
def _(view):
    r = role(view, 0).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    r = r.select("obj_id", (F.floor(F.col("x1") / 2) + F.col("i")).alias("col"), (F.floor(F.col("y1") / 2) + F.col("j")).alias("row_"))
    return rounded(it.roof_runoff_share(r), "share", digits=9)


