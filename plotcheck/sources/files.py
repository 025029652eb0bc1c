"""Readers and writers of features, logs, annotations, grids and tables with semicolons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
LOG = "id string, aktion string, klasse string, geometrie array<array<double>>, kachel string"
ACTIONS = ("bestaetigt", "verworfen", "neu", "nachgezogen")


def multi_region_union(parts: list[DataFrame]) -> DataFrame:
    """All areas' tables together; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_features(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """(id, properties, vertex rows) of GeoJSON polygon features: the outer ring's vertices, not closed."""
    f = spark.read.schema(FEATURES).json(path, multiLine=multiline).select(F.explode("features").alias("f"))
    ring = f.select(F.col("f.properties")["id"].alias("id"), F.col("f.properties").alias("properties"), F.posexplode(F.col("f.geometry.coordinates")[0]).alias("seq", "c"), F.size(F.col("f.geometry.coordinates")[0]).alias("n"))
    return ring.filter("seq < n - 1").select("id", "properties", "seq", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"))


def write_features(df: DataFrame, path: str) -> None:
    """One JSON feature a line from (id, properties map, ring array of [x, y])."""
    feature = F.struct(F.lit("Feature").alias("type"), "id", F.col("properties"), F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")).alias("geometry"))
    df.select(F.to_json(feature).alias("value")).write.text(path)


def parse_log(lines: DataFrame) -> DataFrame:
    """Log entries of text lines (value): broken lines, unknown actions and outlines of under three points are left out."""
    e = lines.select(F.from_json("value", LOG).alias("e")).select("e.*")
    return e.filter(F.col("id").isNotNull() & F.col("aktion").isin(*ACTIONS) & (F.size("geometrie") >= 3))


def read_log_tolerant(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))


def read_annotations(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """(plot, nth, klasse, ring) of annotations drawn as polygon, rotated rectangle, circle (centre, diameter) or box."""
    schema = "grundstueck string, objekte array<struct<klasse:string,poly:array<array<double>>,rechteck:array<double>,kreis:array<double>,box:array<double>>>"
    o = spark.read.schema(schema).json(path, multiLine=multiline).select(F.col("grundstueck").alias("plot"), F.posexplode("objekte").alias("nth", "o"))
    r, b, k = F.col("o.rechteck"), F.col("o.box"), F.col("o.kreis")
    turn = F.radians(r[4])
    corner = lambda i, j: F.array(r[0] + i * r[2] / 2 * F.cos(turn) - j * r[3] / 2 * F.sin(turn), r[1] + i * r[2] / 2 * F.sin(turn) + j * r[3] / 2 * F.cos(turn))
    rect = F.when(r.isNotNull(), F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)))
    box = F.when(b.isNotNull(), F.array(F.array(b[0], b[1]), F.array(b[2], b[1]), F.array(b[2], b[3]), F.array(b[0], b[3])))
    circle = F.when(k.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.array(k[0] + k[2] / 2 * F.cos(i * 0.39269908169872414), k[1] + k[2] / 2 * F.sin(i * 0.39269908169872414))))
    return o.select("plot", "nth", F.col("o.klasse").alias("klasse"), F.coalesce(F.col("o.poly"), rect, circle, box).alias("ring"))


def comma_number(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def read_csv_semicolon(spark: SparkSession, path: str, numbers: tuple[str, ...] = ()) -> DataFrame:
    """A table with semicolons and quotes, and a byte order mark or not; ``numbers`` have decimal commas."""
    df = spark.read.csv(path, sep=";", header=True, quote='"', encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.withColumns({c: comma_number(F.col(c)) for c in numbers})


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """(col, row_, x, y, z) of the cells of an ASCII grid; no-data cells are null."""
    text = spark.read.text(path, wholetext=True)
    head = {k: F.regexp_extract("value", rf"(?i)(?m)^\s*{k}\s+(\S+)", 1).cast("double") for k in ("xllcorner", "yllcorner", "cellsize", "NODATA_value")}
    rows = F.regexp_extract("value", r"(?i)nrows\s+(\d+)", 1).cast("int")
    t = text.select(*[v.alias(k) for k, v in head.items()], F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda s: s.rlike(r"^\s*[-+0-9.]"))).alias("row_", "line"), rows.alias("nrows"))
    cells = t.select("*", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v"))
    z = F.col("v").cast("double")
    out = cells.withColumn("z", F.when(z != F.col("NODATA_value"), z))
    return out.select("col", "row_", (F.col("xllcorner") + (F.col("col") + 0.5) * F.col("cellsize")).alias("x"), (F.col("yllcorner") + (F.col("nrows") - F.col("row_") - 0.5) * F.col("cellsize")).alias("y"), "z")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def erase_from_log(spark: SparkSession, path: str, schema: str, ids: DataFrame, target: str) -> None:
    """Write the log without the erased ids to ``target``, from where it replaces the old one."""
    spark.read.schema(schema).json(path).join(ids.select("id"), "id", "left_anti").write.mode("overwrite").json(target)


def parse_tile_name(name: Column) -> dict[str, Column]:
    """Tile column and row of names such as 32698_5486 or 698_5486_20_DOM; null if it is none."""
    pattern = r"^(?:32)?(\d{3})_(\d{4})(?:_20_DOM)?$"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit("")).cast("int")
    return {"kx": part(1), "ky": part(2)}


def compact_json(df: DataFrame) -> DataFrame:
    """(id, json) with short keys, centimetres for what is official and decimetres for the rest, and no nulls."""
    digits = lambda c: F.when(F.col("provenance") == "amtlich", F.round(c, 2)).otherwise(F.round(c, 1))
    body = F.struct(F.col("obj_id").alias("i"), digits("eaves").alias("h"), F.when(F.col("ridge") > F.col("eaves"), digits("ridge")).alias("f"), F.when(F.col("klasse") != "baum", F.col("klasse")).alias("k"))
    return df.select("obj_id", F.to_json(body, {"ignoreNullFields": "true"}).alias("json"))


def missing_columns(df: DataFrame, needed: list[str]) -> list[str]:
    """Columns a model needs that a table lacks; none means the table fits."""
    return sorted(set(needed) - set(df.columns))
