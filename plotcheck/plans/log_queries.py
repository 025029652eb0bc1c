"""Queries of the log operators and file sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plotcheck.operators import logs
from plotcheck.plans.registry import query
from plotcheck.plans.spatial_queries import role, rounded
from plotcheck.sources import files
from plotcheck.storage import shared_dir

_NAME = "CASE event_id % 4 WHEN 0 THEN concat('32', CAST(CAST(floor(e / 1000) AS BIGINT) AS VARCHAR(9)), '_', CAST(CAST(floor(n / 1000) AS BIGINT) AS VARCHAR(9))) WHEN 1 THEN concat(CAST(CAST(floor(e / 1000) AS BIGINT) AS VARCHAR(9)), '_', CAST(CAST(floor(n / 1000) AS BIGINT) AS VARCHAR(9)), '_20_DOM') WHEN 2 THEN concat(CAST(CAST(floor(e / 1000) AS BIGINT) AS VARCHAR(9)), '_', CAST(CAST(floor(n / 1000) AS BIGINT) AS VARCHAR(9))) ELSE 'x1_2' END"


@query("parse_tile_name", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(floor(e / 1000) AS INTEGER) END AS kx, CASE WHEN event_id % 4 < 3 THEN CAST(floor(n / 1000) AS INTEGER) END AS ky FROM contribution")
def _(view):
    c = view("contribution").select("event_id", F.expr(_NAME).alias("name"))
    return c.withColumns(files.parse_tile_name(F.col("name"))).drop("name")


@query("compact_json", """
WITH c AS (SELECT obj_id, CASE WHEN provenance = 'amtlich' THEN round(eaves, 2) ELSE round(eaves, 1) END AS h, CASE WHEN ridge > eaves THEN CASE WHEN provenance = 'amtlich' THEN round(ridge, 2) ELSE round(ridge, 1) END END AS f, CASE WHEN klasse <> 'baum' THEN klasse END AS k FROM footprint)
SELECT obj_id, concat('{"i":', CAST(obj_id AS VARCHAR), ',"h":', CAST(h AS VARCHAR), coalesce(',"f":' || CAST(f AS VARCHAR), ''), coalesce(',"k":"' || k || '"', ''), '}') AS json FROM c""")
def _(view):
    return files.compact_json(view("footprint"))


def _contributions(view):
    """Contributions as log entries: a square of 4 m, every 11th with two corners, every 13th in another tile."""
    corners = "array(array(e, n), array(e + 4, n), array(e + 4, n + 4.04D), array(e, n + 4))"
    return view("contribution").selectExpr(
        "CAST(event_id AS STRING) AS id", "event_id", "ts", "aktion", "klasse", f"CASE WHEN event_id % 11 = 0 THEN slice({corners}, 1, 2) ELSE {corners} END AS geometrie",
        "concat(CAST(CAST(floor(e / 1000) AS BIGINT) + IF(event_id % 13 = 0, 1, 0) AS STRING), '_', CAST(CAST(floor(n / 1000) AS BIGINT) AS STRING)) AS kachel")


_FAULT = "CASE WHEN aktion = 'kaputt' THEN 'action' WHEN klasse = 'unbekannt' THEN 'class' WHEN event_id % 11 = 0 THEN 'points' WHEN event_id % 13 = 0 THEN 'other_tile' END"


@query("clean_contribution", f"SELECT CAST(event_id AS VARCHAR) AS id, aktion, klasse, round(n + 4.04, 1) AS top FROM contribution WHERE {_FAULT} IS NULL")
def _(view):
    ok, _ = logs.clean_contribution(_contributions(view))
    return ok.select("id", "aktion", "klasse", F.element_at(F.element_at("geometrie", 3), 2).alias("top"))


@query("refused_contribution", f"SELECT CAST(event_id AS VARCHAR) AS id, {_FAULT} AS reason FROM contribution WHERE {_FAULT} IS NOT NULL")
def _(view):
    return logs.clean_contribution(_contributions(view))[1]


@query("clean_request", """SELECT event_id, CASE WHEN klasse = 'unbekannt' THEN 'class' WHEN event_id % 17 = 0 THEN 'points' WHEN NOT (e BETWEEN 698000 AND 699500 AND e + 300 + event_id % 200 BETWEEN 698000 AND 699500) THEN 'area' WHEN 300 + event_id % 200 > 400 THEN 'extent' END AS reason FROM contribution""")
def _(view):
    r = view("contribution").selectExpr("event_id", "klasse", "IF(event_id % 17 = 0, array(), array(array(e, n), array(e + 300 + event_id % 200, n))) AS punkte")
    return r.select("event_id", logs.request_fault((698000.0, 5486000.0, 699500.0, 5489000.0)).alias("reason"))


@query("validity_reason", "SELECT obj_id, CASE WHEN NOT sicher THEN 'unsure' WHEN eaves < 2.2 THEN 'low' WHEN (x2 - x1) * (y2 - y1) < 8 THEN 'small' END AS reason FROM footprint WHERE role = 5")
def _(view):
    checks = [("unsure", F.col("sicher")), ("low", F.col("eaves") >= 2.2), ("small", F.expr("(x2 - x1) * (y2 - y1) >= 8"))]
    return role(view, 5).select("obj_id", logs.validity_reason(checks).alias("reason"))


@query("campaign_eligibility", """
WITH r AS (SELECT id, CASE WHEN id % 13 = 0 THEN 'unsubscribed' WHEN freigabe <> 'ja' THEN 'not_released' WHEN email = 'kaputt' THEN 'bad_address' WHEN date_diff('day', gesendet, DATE '2024-01-25') < 7 THEN 'too_soon' END AS reason FROM recipient),
k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY id) AS nth FROM r) SELECT id, coalesce(reason, CASE WHEN nth <= 200 THEN 'send' ELSE 'over_cap' END) AS reason FROM k""")
def _(view):
    return logs.campaign_eligibility(view("recipient"), view("recipient").filter("id % 13 = 0").select("id"), "2024-01-25", 7, 200)


def _events(view):
    return view("contribution").selectExpr("event_id", "user_id AS client", "aktion AS action", "CAST(ts AS TIMESTAMP) AS ts")


@query("rate_limit", """
WITH RECURSIVE r AS (SELECT user_id AS client, ts FROM contribution), w AS (SELECT client, min(ts) AS start FROM r GROUP BY client
  UNION ALL SELECT w.client, min(r.ts) FROM w JOIN r ON r.client = w.client AND r.ts > w.start + INTERVAL 3600 SECONDS GROUP BY w.client)
SELECT w.client, start, count(*) AS n, greatest(count(*) - 2, 0) AS refused FROM w JOIN r ON r.client = w.client AND r.ts >= start AND r.ts <= start + INTERVAL 3600 SECONDS GROUP BY w.client, start""")
def _(view):
    return logs.rate_limit(_events(view), 3600, 2).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("accept_answers", """SELECT event_id, a.link, CASE WHEN a.ts >= CAST(bis + 1 AS TIMESTAMP) + INTERVAL 14 HOURS THEN 'expired' WHEN a.ts > revoked_at THEN 'revoked' ELSE 'accepted' END AS status FROM answer a LEFT JOIN revocation r ON r.link = a.link""")
def _(view):
    return logs.accept_answers(view("answer").withColumn("ts", F.col("ts").cast("timestamp_ntz")), view("revocation").withColumn("revoked_at", F.col("revoked_at").cast("timestamp_ntz")))


@query("answers_by_link", "SELECT link, count(*) AS n, CAST(sum(CASE WHEN antwort = 'passt' THEN 1 ELSE 0 END) AS BIGINT) AS fits, min(ts) AS first, max(ts) AS last FROM answer GROUP BY link")
def _(view):
    return logs.answers_by_link(view("answer"))


@query("retention", "SELECT event_id, link FROM answer WHERE ts >= TIMESTAMP '2025-02-20' - INTERVAL 400 DAYS")
def _(view):
    return logs.retention(view("answer").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "2025-02-20").select("event_id", "link")


@query("revoke_and_purge", "SELECT event_id, link FROM answer WHERE link NOT IN (SELECT link FROM revocation)")
def _(view):
    return logs.revoke_and_purge(view("answer"), view("revocation")).select("event_id", "link")


_WIN = "CAST(floor((e - 698000 - 48) / 48 + 0.5) AS BIGINT) AS wx, CAST(floor((n - 5486000 - 48) / 48 + 0.5) AS BIGINT) AS wy"


@query("prepare_windows", f"""
WITH q AS (SELECT user_id AS client, {_WIN} FROM contribution), st AS (SELECT i, j FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
w AS (SELECT client, wx + i AS wx, wy + j AS wy, min(abs(i) + abs(j)) AS far FROM q, st GROUP BY 1, 2, 3)
SELECT client, wx, wy, far, CAST(row_number() OVER (PARTITION BY client ORDER BY far, wx, wy) AS INTEGER) AS place FROM w WHERE (wx + wy) % 5 <> 0""")
def _(view):
    q = view("contribution").selectExpr("user_id AS client", *[x.strip() for x in _WIN.split(", ")])
    w = q.selectExpr("explode(sequence(wx - 1, wx + 1)) AS wx", "wy").selectExpr("wx", "explode(sequence(wy - 1, wy + 1)) AS wy").filter("(wx + wy) % 5 = 0").distinct()
    return logs.prepare_windows(q, w)


@query("nearest_first_queue", f"WITH q AS (SELECT event_id, user_id, {_WIN} FROM contribution) SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY abs(wx - 20) + abs(wy - 20), event_id) AS INTEGER) AS place FROM q")
def _(view):
    from pyspark.sql import Window as W

    q = view("contribution").selectExpr("event_id", "user_id", *[x.strip() for x in _WIN.split(", ")])
    return q.select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy(F.expr("abs(wx - 20) + abs(wy - 20)"), "event_id")).alias("place"))


@query("activity_windows", """
WITH e AS (SELECT user_id, aktion, ts FROM contribution),
s AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 15 MINUTES OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM s)
SELECT 'tumbling' AS kind, aktion AS key, date_trunc('hour', ts) AS start, count(*) AS n FROM e GROUP BY 2, 3
UNION ALL SELECT 'sliding', aktion, date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)), count(*) FROM e, (SELECT unnest([0, 1]) AS k) GROUP BY 2, 3
UNION ALL SELECT 'session', CAST(user_id AS VARCHAR), min(ts), count(*) FROM g GROUP BY user_id, nth""")
def _(view):
    return logs.activity_windows(_events(view)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("dedupe_contributions", """
WITH l AS (SELECT user_id AS id, event_id, ts FROM contribution), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS nth FROM l)
SELECT id, event_id FROM k WHERE nth = 1 AND id % 4 <> 1""")
def _(view):
    log = view("contribution").selectExpr("user_id AS id", "event_id", "ts")
    done = log.select("id").distinct().filter("id % 4 < 2").selectExpr("id", "IF(id % 4 = 1, 'x', NULL) AS result")
    return logs.fresh_contributions(log, done).select("id", "event_id")


def _path(view, name):
    return f"{shared_dir(view('region').sparkSession)}/{name}-{uuid.uuid4().hex}"


@query("read_log_tolerant", "SELECT CAST(event_id AS VARCHAR) AS id, klasse FROM contribution WHERE aktion <> 'kaputt' AND event_id % 11 <> 0 AND event_id % 7 <> 0")
def _(view):
    lines = _contributions(view).select(F.when(F.col("event_id") % 7 == 0, F.lit('{"id": "broken')).otherwise(F.to_json(F.struct("id", "aktion", "klasse", "geometrie", "kachel"))).alias("value"))
    path = _path(view, "log")
    lines.write.text(path)
    return files.read_log_tolerant(view("region").sparkSession, path).select("id", "klasse")


@query("append_erase_log", "SELECT CAST(event_id AS VARCHAR) AS id FROM contribution WHERE user_id % 3 <> 0")
def _(view):
    spark = view("region").sparkSession
    c, path, target = view("contribution").selectExpr("CAST(event_id AS STRING) AS id", "user_id"), _path(view, "log"), _path(view, "log")
    files.append_log(c.filter("user_id % 2 = 0"), path)
    files.append_log(c.filter("user_id % 2 = 1"), path)
    files.erase_from_log(spark, path, "id string, user_id long", c.filter("user_id % 3 = 0").select("id"), target)
    return spark.read.schema("id string").json(target)


@query("read_features", "SELECT CAST(parcel_id AS VARCHAR) AS id, seq, x, y FROM parcel_vertex")
def _(view):
    spark = view("region").sparkSession
    v = view("parcel_vertex").groupBy("parcel_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))
    ring = F.transform("v", lambda p: F.array(p["x"], p["y"]))
    f = v.select(F.col("parcel_id").cast("string").alias("id"), F.create_map(F.lit("id"), F.col("parcel_id").cast("string")).alias("properties"), F.concat(ring, F.slice(ring, 1, 1)).alias("ring"))
    path = _path(view, "features")
    files.write_features(f, path)
    # A feature a line is a collection of one.
    one = spark.read.text(path).select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "value", F.lit("]}")).alias("value"))
    target = _path(view, "features")
    one.write.text(target)
    return files.read_features(spark, target, multiline=False).select("id", "seq", "x", "y")


@query("read_csv_semicolon", "SELECT CAST(obj_id AS VARCHAR) AS obj_id, klasse, eaves FROM footprint WHERE role = 6")
def _(view):
    path = _path(view, "csv")
    role(view, 6).select("obj_id", "klasse", F.translate(F.col("eaves").cast("string"), ".", ",").alias("eaves")).write.csv(path, sep=";", header=True)
    return files.read_csv_semicolon(view("region").sparkSession, path, ("eaves",))


@query("read_annotations", """
WITH a AS (SELECT *, CAST(row_number() OVER (PARTITION BY parcel_id ORDER BY obj_id) - 1 AS INTEGER) AS nth FROM footprint WHERE role IN (5, 6) AND x2 > x1 AND y2 > y1)
SELECT CAST(parcel_id AS VARCHAR) AS plot, nth, klasse, CASE WHEN obj_id % 3 = 2 THEN 16 ELSE 4 END AS corners, CASE WHEN obj_id % 3 = 2 THEN round((x1 + x2) / 2 + 1, 6) ELSE x1 END AS x, CASE WHEN obj_id % 3 = 2 THEN round((y1 + y2) / 2, 6) ELSE y1 END AS y FROM a""")
def _(view):
    o = role(view, 5, 6).filter("x2 > x1 AND y2 > y1").selectExpr("parcel_id", "obj_id", """named_struct('klasse', klasse, 'box', IF(obj_id % 3 = 0, array(x1, y1, x2, y2), NULL),
      'rechteck', IF(obj_id % 3 = 1, array((x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1, 0.0D), NULL), 'kreis', IF(obj_id % 3 = 2, array((x1 + x2) / 2, (y1 + y2) / 2, 2.0D), NULL)) AS o""")
    path = _path(view, "annotations")
    g = o.groupBy("parcel_id").agg(F.sort_array(F.collect_list(F.struct("obj_id", "o"))).alias("l"))
    g.select(F.col("parcel_id").cast("string").alias("grundstueck"), F.transform("l", lambda s: s["o"]).alias("objekte")).write.json(path)
    out = files.read_annotations(view("region").sparkSession, path, multiline=False)
    out = out.select("plot", "nth", "klasse", F.size("ring").alias("corners"), F.col("ring")[0][0].alias("x"), F.col("ring")[0][1].alias("y"))
    return rounded(out, "x", "y")
