"""Floorplan grid arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOLUTION = 0.05
MAX_CELLS = 4_000_000


def pixel_of(x: Column, y: Column, origin_x, origin_y, resolution: float = RESOLUTION) -> tuple[Column, Column]:
    """Grid column and row of a world point."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.floor((x - lit(origin_x)) / resolution), F.floor((y - lit(origin_y)) / resolution)


def center_of(col: Column, row: Column, origin_x, origin_y, resolution: float = RESOLUTION) -> tuple[Column, Column]:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return (col + 0.5) * resolution + lit(origin_x), (row + 0.5) * resolution + lit(origin_y)


def build_grid(boxes: DataFrame, keys: Sequence[str], x0: str, y0: str, x1: str, y1: str,
               resolution: float = RESOLUTION, padding: int = 10, max_cells: int = MAX_CELLS) -> DataFrame:
    """Origin and size of the padded grid of each level; too large a grid is an error."""
    margin = padding * resolution
    g = boxes.groupBy(*keys).agg(
        F.min(x0).alias("_x0"), F.min(y0).alias("_y0"), F.max(x1).alias("_x1"), F.max(y1).alias("_y1"))
    size = lambda lo, hi: F.ceil((F.col(hi) - F.col(lo) + 2 * margin) / resolution) + 1
    g = g.withColumns({"n_rows": size("_y0", "_y1"), "n_cols": size("_x0", "_x1")})
    checked = F.when(F.col("n_rows") * F.col("n_cols") <= max_cells, F.col("n_rows")).otherwise(
        F.raise_error(F.lit("floorplan grid has too many cells")).cast("bigint"))
    return g.select(*keys, (F.col("_x0") - margin).alias("origin_x"), (F.col("_y0") - margin).alias("origin_y"),
                    checked.alias("n_rows"), "n_cols")


def point_key(x: Column, y: Column, scale: float = 1e6) -> Column:
    """Integer key of a coordinate pair, rounded half to even."""
    return F.struct(F.rint(x * scale).cast("bigint").alias("x"), F.rint(y * scale).cast("bigint").alias("y"))


def edge_key(xa: Column, ya: Column, xb: Column, yb: Column, scale: float = 1e6) -> Column:
    """Undirected edge key: the two point keys in order."""
    return F.array_sort(F.array(point_key(xa, ya, scale), point_key(xb, yb, scale)))
