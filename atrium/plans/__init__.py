"""Importing this package registers every query."""

from atrium.plans import (  # noqa: F401
    aggregations, inputs, layouts, projections, rasters, spatial_joins, topology, upkeep,
)
from atrium.plans.registry import REGISTRY, spark_callable  # noqa: F401
