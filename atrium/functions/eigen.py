"""Additive second moments of point groups and the eigen-decomposition of 3x3 covariances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from atrium.functions.vectors import Vec

MOMENTS = ("n", "sx", "sy", "sz", "sxx", "syy", "szz", "sxy", "sxz", "syz")
FIELDS = ("l0", "l1", "l2", "nx", "ny", "nz", "ux", "uy", "uz")
SCHEMA = T.StructType([T.StructField(n, T.DoubleType()) for n in FIELDS])


def moment_sums(p: Vec, weight: Column | None = None) -> list[Column]:
    """Ten sums that describe a group up to second order; sums of two groups add up."""
    w = weight if weight is not None else F.lit(1.0)
    terms = (w, p.x * w, p.y * w, p.z * w, p.x * p.x * w, p.y * p.y * w, p.z * p.z * w, p.x * p.y * w, p.x * p.z * w, p.y * p.z * w)
    return [F.sum(e).alias(f"m_{n}") for n, e in zip(MOMENTS, terms)]


def merge_moments(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.sum(f"m_{n}").alias(f"m_{n}") for n in MOMENTS))


@pandas_udf(SCHEMA)
def eig3_sym(n: pd.Series, sx: pd.Series, sy: pd.Series, sz: pd.Series, sxx: pd.Series, syy: pd.Series,
             szz: pd.Series, sxy: pd.Series, sxz: pd.Series, syz: pd.Series) -> pd.DataFrame:
    """Ascending eigenvalues of the covariance, the smallest direction (n) and the largest (u)."""
    count = np.maximum(n.to_numpy(float), 1.0)
    mean = np.stack([sx, sy, sz], axis=1).astype(float) / count[:, None]
    pairs = np.stack([sxx, sxy, sxz, sxy, syy, syz, sxz, syz, szz], axis=1).astype(float) / count[:, None]
    cov = pairs.reshape(-1, 3, 3) - mean[:, :, None] * mean[:, None, :]
    values, vectors = np.linalg.eigh(cov)
    out = np.concatenate([values, vectors[:, :, 0], vectors[:, :, 2]], axis=1)
    return pd.DataFrame(out, columns=list(FIELDS))


def eigen_of_moments() -> Column:
    return eig3_sym(*(F.col(f"m_{n}") for n in MOMENTS))


def oriented(n: Vec) -> Vec:
    """Canonical sign of a direction: z up, then y, then x positive."""
    flip = (n.z < 0) | ((n.z == 0) & ((n.y < 0) | ((n.y == 0) & (n.x < 0))))
    return n.scale(F.when(flip, -1.0).otherwise(1.0))


def planes_from_moments(df: DataFrame, keep: Sequence[str], flip: Column | None = None) -> DataFrame:
    """Least-squares plane per row of moments: unit normal, z up unless ``flip`` says otherwise.

    Fewer than three points, or points on one line, have no plane; they get the horizontal plane
    through their mean height.
    """
    e = df.withColumn("_e", eigen_of_moments())
    n = oriented(Vec(F.col("_e.nx"), F.col("_e.ny"), F.col("_e.nz")))
    mean = Vec(*(F.col(f"m_{c}") / F.col("m_n") for c in ("sx", "sy", "sz")))
    flat = (F.col("m_n") < 3) | (F.col("_e.l1") <= F.lit(1e-12))
    n = Vec(F.lit(0.0), F.lit(0.0), F.lit(1.0)).when(flat, n)
    if flip is not None:
        n = n.scale(F.when(flip, -1.0).otherwise(1.0))
    staged = e.select(*df.columns, n.x.alias("a"), n.y.alias("b"), n.z.alias("c"), flat.alias("degenerate"),
                      F.greatest(F.col("_e.l0"), F.lit(0.0)).alias("residual2"))
    return staged.withColumn("d", -(F.col("a") * mean.x + F.col("b") * mean.y + F.col("c") * mean.z)).select(
        *keep, "a", "b", "c", "d", "degenerate", "residual2")
