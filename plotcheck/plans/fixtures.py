"""Site tables derived from the supplied ones by portable SQL, for Spark and for the SQL oracles alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

VIEWS: dict[str, str] = {
    "parcel": """
SELECT c_custkey AS parcel_id, CAST((c_custkey % 40) * 50 AS DOUBLE) AS x0, CAST(floor(c_custkey / 40.0) * 50 AS DOUBLE) AS y0,
       CAST(26 + (c_custkey * 7) % 15 AS DOUBLE) AS w, CAST(24 + (c_custkey * 11) % 17 AS DOUBLE) AS h, CAST(c_custkey % 5 AS DOUBLE) AS skew,
       CASE c_nationkey % 3 WHEN 0 THEN 'rein' WHEN 1 THEN 'allgemein' ELSE 'misch' END AS area_kind,
       CASE WHEN c_nationkey % 10 = 0 THEN 'aussen' ELSE 'innen' END AS zone, c_mktsegment AS stratum
FROM customer""",
    "parcel_vertex": """
SELECT parcel_id, 0 AS seq, x0 AS x, y0 AS y FROM parcel UNION ALL
SELECT parcel_id, 1, x0 + w, y0 FROM parcel UNION ALL
SELECT parcel_id, 2, x0 + w + skew, y0 + h FROM parcel UNION ALL
SELECT parcel_id, 3, x0, y0 + h FROM parcel""",
    "parcel_edge": """
SELECT parcel_id, seq AS seg, seq AS side, x AS ax, y AS ay,
       coalesce(lead(x) OVER (PARTITION BY parcel_id ORDER BY seq), first_value(x) OVER (PARTITION BY parcel_id ORDER BY seq)) AS bx,
       coalesce(lead(y) OVER (PARTITION BY parcel_id ORDER BY seq), first_value(y) OVER (PARTITION BY parcel_id ORDER BY seq)) AS by_
FROM parcel_vertex""",
    "footprint": """
SELECT o_orderkey AS obj_id, o_custkey AS parcel_id, o_orderkey % 10 AS role,
       p.x0 + 2 + (o_orderkey * 13) % 22 AS x1, p.y0 + 2 + (o_orderkey * 17) % 20 AS y1,
       p.x0 + 4 + (o_orderkey * 13) % 22 + o_orderkey % 6 AS x2, p.y0 + 4 + (o_orderkey * 17) % 20 + (o_orderkey * 3) % 5 AS y2,
       CAST(20 + o_orderkey % 30 AS DOUBLE) / 10 AS eaves, CAST(20 + o_orderkey % 30 + (o_orderkey % 4) * 8 AS DOUBLE) / 10 AS ridge,
       CAST((o_orderkey * 29) % 100 AS DOUBLE) / 100 AS confidence,
       CASE (o_orderkey * 7) % 5 WHEN 0 THEN 'gartenhaus' WHEN 1 THEN 'carport_garage' WHEN 2 THEN 'pool' WHEN 3 THEN 'hecke' ELSE 'baum' END AS klasse,
       CASE o_orderstatus WHEN 'F' THEN 'amtlich' WHEN 'O' THEN 'erkannt' ELSE 'nutzerbestätigt' END AS provenance,
       o_orderpriority <> '5-LOW' AS sicher
FROM orders JOIN parcel p ON p.parcel_id = o_custkey""",
    "laser_point": """
SELECT l_orderkey * 10 + l_linenumber AS pt_id,
       CAST((l_orderkey * 37 + l_linenumber * 101 + l_partkey * 17) % 2000 AS DOUBLE) + CAST(l_suppkey % 10 AS DOUBLE) / 10 AS x,
       CAST((l_orderkey * 53 + l_linenumber * 211 + l_partkey * 29) % 1900 AS DOUBLE) + CAST(l_partkey % 10 AS DOUBLE) / 10 AS y,
       CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 20 ELSE 6 END AS cls, 1 + l_linenumber % 3 AS n_returns,
       CASE l_returnflag WHEN 'A' THEN CAST(0 AS DOUBLE) ELSE CAST(l_quantity AS DOUBLE) / 10 END AS height,
       CAST(floor(l_extendedprice) AS BIGINT) % 65536 AS intensity, l_shipdate AS gps_time
FROM lineitem""",
    "terrain_cell": """
SELECT CAST(a.p_partkey % 50 AS BIGINT) AS col, CAST(floor(a.p_partkey / 50.0) AS BIGINT) AS row_,
       430 + CAST((a.p_partkey % 50) * 4 + (a.p_partkey * 7919) % 13 AS DOUBLE) / 10 AS z,
       CAST((a.p_partkey * 31) % 256 AS DOUBLE) AS nir, CAST((a.p_partkey * 17) % 256 AS DOUBLE) AS red,
       CASE WHEN a.p_size < 10 THEN 'Straßenverkehr' WHEN a.p_size < 13 THEN 'Fließgewässer' WHEN a.p_size < 35 THEN 'Wohnbaufläche' ELSE 'Landwirtschaft' END AS nutzart
FROM part a""",
    "device_catalog": """
SELECT p_brand AS maker, p_name AS model, CAST(30 + p_size AS DOUBLE) AS lw, 2000 + p_partkey % 25 AS year_, p_partkey AS row_id,
       CASE WHEN p_partkey % 4 = 0 THEN 'Brine' ELSE 'Outdoor Air / Water' END AS source_type
FROM part""",
    "rain_table": """
SELECT CAST(5 * (n_nationkey + 1) AS INTEGER) AS dauer_min,
       CASE r_regionkey WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 10 WHEN 3 THEN 30 ELSE 100 END AS jahre,
       8 + CAST(n_nationkey * 13 AS DOUBLE) / 10 + r_regionkey * 4 AS hn, CAST(13 + r_regionkey AS DOUBLE) AS uc
FROM nation CROSS JOIN region""",
    "contribution": """
SELECT event_id, ts, user_id,
       CASE event_type WHEN 'click' THEN 'bestaetigt' WHEN 'view' THEN 'verworfen' WHEN 'signup' THEN 'neu' WHEN 'purchase' THEN 'nachgezogen' ELSE 'kaputt' END AS aktion,
       CASE event_id % 4 WHEN 0 THEN 'gartenhaus' WHEN 1 THEN 'pool' WHEN 2 THEN 'baum' ELSE 'unbekannt' END AS klasse,
       698000 + CAST((event_id * 37) % 2000 AS DOUBLE) AS e, 5486000 + CAST((event_id * 53) % 2000 AS DOUBLE) AS n, props
FROM events""",
    "answer": """
SELECT event_id, user_id AS link, ts, CASE WHEN event_type IN ('click', 'view') THEN 'passt' ELSE 'frage' END AS antwort,
       CAST('2024-01-01' AS DATE) + CAST(10 + user_id % 20 AS INTEGER) AS bis
FROM events WHERE event_type <> 'error'""",
    "revocation": """
SELECT user_id AS link, min(ts) AS revoked_at FROM events WHERE event_type = 'error' AND user_id % 5 = 0 GROUP BY user_id""",
    "class_prob": """
SELECT vec_id AS cand_id, label, vec_id % 20 AS plot, embedding FROM embeddings""",
    "recipient": """
SELECT c_custkey AS id, c_name AS firma, CASE WHEN c_custkey % 7 = 0 THEN 'nein' ELSE 'ja' END AS freigabe,
       CASE WHEN c_custkey % 11 = 0 THEN 'kaputt' ELSE concat('k', CAST(c_custkey AS VARCHAR(20)), '@example.com') END AS email,
       CASE WHEN c_custkey % 3 = 0 THEN CAST('2024-01-01' AS DATE) + CAST(c_custkey % 30 AS INTEGER) END AS gesendet
FROM customer""",
}


def _needs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def _order(names: list[str]) -> list[str]:
    """Names with all that they are derived from, in order."""
    out: list[str] = []

    def add(name: str) -> None:
        for other in _needs(VIEWS[name]):
            if other != name:
                add(other)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied or derived table as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for v in _order([name]):
        for base in BASE:
            if re.search(rf"\b{base}\b", VIEWS[v]):
                spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
        spark.sql(VIEWS[v]).createOrReplaceTempView(v)
    return spark.table(name)


def with_views(sql: str) -> str:
    """``sql`` with the derived tables that it names, as DuckDB runs it."""
    parts = [f"{v} AS ({VIEWS[v].strip()})" for v in _order(_needs(sql))]
    head = "WITH " + ",\n".join(parts) if parts else ""
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return head.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + body[15:]
    return head + (",\n" + body[4:].lstrip() if body.upper().startswith("WITH ") else "\n" + body)
