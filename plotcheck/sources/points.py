"""Laser points partitioned by square cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_point_cells(points: DataFrame, size: float = 100.0) -> DataFrame:
    return points.withColumns({"kx": F.floor(F.col("x") / size), "ky": F.floor(F.col("y") / size)})


def write_point_cells(points: DataFrame, path: str, size: float = 100.0) -> None:
    """Write a folder for each cell; a cell's rows come from one task or a few, not from all."""
    with_point_cells(points, size).repartition("kx", "ky").write.partitionBy("kx", "ky").parquet(path)


def points_in_window(points: DataFrame, bounds: tuple[float, float, float, float], size: float = 100.0) -> DataFrame:
    """Points in the half-open window; the cell columns prune partitions."""
    x1, y1, x2, y2 = bounds
    cells = F.col("kx").between(int(x1 // size), int(x2 // size)) & F.col("ky").between(int(y1 // size), int(y2 // size))
    return points.filter(cells & (F.col("x") >= x1) & (F.col("x") < x2) & (F.col("y") >= y1) & (F.col("y") < y2))
