"""Rigid transforms with constant matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def undo_transform(vertices: DataFrame, matrix, scale: float = 1.0) -> DataFrame:
    """Divide out the scale, then apply the inverse of a 4x4 transform (inverted once, 16 numbers)."""
    inv = np.linalg.inv(np.asarray(matrix, dtype=float))
    x, y, z = (F.col(c) / scale for c in "xyz")
    row = lambda i: x * float(inv[i, 0]) + y * float(inv[i, 1]) + z * float(inv[i, 2]) + float(inv[i, 3])
    return vertices.withColumns({c: row(i) for i, c in enumerate("xyz")})
