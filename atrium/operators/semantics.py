"""Label votes: rays to vertices, vertices to superpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.functions.vectors import vec
from atrium.operators import spatial as S
from atrium.session import cut_lineage


def knn_probabilities(vertices: DataFrame, rays: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """Label fractions among the k rays nearest to each vertex, in long form."""
    # a ray is told apart by its place and label only, so copies beyond k of one place do not matter
    numbered = rays.select(*keys, "x", "y", "z", "label")
    if keys:  # rays of scenes without vertices to ask for are in nobody's neighbourhood
        asking = cut_lineage(vertices.select(*keys).distinct())
        numbered = numbered.join(F.broadcast(asking) if asking.count() <= S.BROADCAST_CELLS else asking, list(keys), "left_semi")
    tree = S.point_tree(numbered, keys, "label", vec(), k)
    hits = S.knn(vertices.select(*keys, "vertex_id", "x", "y", "z"), tree, vec(), k=k)
    long = hits.select(*keys, "vertex_id", F.explode("hits.tid").alias("label"))
    return long.groupBy(*keys, "vertex_id", "label").agg((F.count("*") / F.lit(float(k))).alias("p"))
