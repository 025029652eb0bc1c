"""Tables cut into square tiles, in folders of a column's bands, so that a scan of an area reads its tiles only."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotcheck.storage import shared_dir


#: Rows of tiles that share a folder: folders of single tiles take longer to make and to list than their rows to read.
BAND = 1024


def write_tiles(df: DataFrame, path: str, tile_m: float, x: str = "x", y: str = "y") -> None:
    """Write ``df`` with the tiles (kx, ky) that hold (x, y), in folders kx=<column>/band=<BAND rows>, each sorted by ky.

    Crowded folders get several files; a scan skips row groups of other tiles by their least and greatest ky. Rows without a place are left out.
    """
    at = lambda c: F.floor(F.col(c) / tile_m)
    dealt = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"kx": at(x), "ky": at(y)}).withColumn("band", F.floor(F.col("ky") / BAND))
    dealt.hint("rebalance", "kx", "band").sortWithinPartitions("kx", "band", "ky").write.partitionBy("kx", "band").parquet(path)


def read_tiles(spark: SparkSession, path: str, bbox: tuple[float, float, float, float], tile_m: float) -> DataFrame:
    """Rows of the tiles that touch the half-open box; other folders are not read."""
    x1, y1, x2, y2 = bbox
    low, high = lambda v: math.floor(v / tile_m), lambda v: math.ceil(v / tile_m) - 1
    held = F.col("kx").between(low(x1), high(x2)) & F.col("band").between(low(y1) // BAND, high(y2) // BAND) & F.col("ky").between(low(y1), high(y2))
    return spark.read.parquet(path).filter(held).drop("band")


def tile_folder(spark: SparkSession, name: str) -> str:
    """A new place for tiles in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def near_windows(tiles: DataFrame, windows: DataFrame, tile_m: float) -> DataFrame:
    """Rows of a tile table (x, y, kx, ky) with each window (x1, y1, x2, y2, half-open) that they lie in, as w_*.

    Windows are dealt to the tiles that they touch, so that a row meets the windows of its own tile only.
    """
    at = lambda c: F.floor(F.col(c) / tile_m)
    end = lambda c: F.greatest(F.ceil(F.col(c) / tile_m) - 1, at(c.replace("2", "1")))
    w = windows.withColumn("kx", F.explode(F.sequence(at("x1"), end("x2")))).withColumn("ky", F.explode(F.sequence(at("y1"), end("y2"))))
    w = w.select("kx", "ky", *[F.col(c).alias(f"w_{c}") for c in windows.columns])
    return tiles.join(w, ["kx", "ky"]).filter("x >= w_x1 AND x < w_x2 AND y >= w_y1 AND y < w_y2")
