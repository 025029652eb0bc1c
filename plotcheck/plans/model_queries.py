"""Queries of the model operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotcheck.operators import models as m
from plotcheck.plans.registry import query
from plotcheck.plans.spatial_queries import centres, role

_FROM = """c AS (SELECT obj_id AS id, klasse, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, CASE role WHEN 3 THEN 'dev' ELSE 'extra' END AS source FROM footprint WHERE role IN (3, 6)
  UNION ALL SELECT event_id, klasse, e - 698000, n - 5486000, 'contribution' FROM contribution WHERE aktion = 'bestaetigt'),
t AS (SELECT (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM footprint WHERE role = 5)"""


@query("training_table", f"WITH {_FROM} SELECT id, klasse, x, y, source FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE sqrt((c.x - t.x) * (c.x - t.x) + (c.y - t.y) * (c.y - t.y)) <= 15)")
def table(view):  # noqa: ANN001, ANN201
    o = lambda r: centres(role(view, r)).select(F.col("obj_id").alias("id"), "klasse", "x", "y")
    c = view("contribution").filter("aktion = 'bestaetigt'").selectExpr("event_id AS id", "klasse", "e - 698000 AS x", "n - 5486000 AS y")
    return m.training_table(o(3), o(6), c, o(5), 15.0)


@query("training_counts", f"WITH {_FROM} SELECT source, count(*) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE sqrt((c.x - t.x) * (c.x - t.x) + (c.y - t.y) * (c.y - t.y)) <= 15) GROUP BY source")
def _(view):
    return table(view).groupBy("source").agg(F.count("*").alias("n"))


@query("train_classifier")
def _(view):
    return m.out_of_fold(view("class_prob").filter("label IS NOT NULL").select("cand_id", "label", "plot", "embedding"), "plot", 3)


@query("score")
def _(view):
    rows = view("class_prob").filter("label IS NOT NULL")
    return m.score(rows, m.fit(rows.filter("plot < 15")))
