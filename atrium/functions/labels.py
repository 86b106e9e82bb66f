"""Label vocabulary of the layout task and its mapping from the 133 panoptic classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The nine layout labels in id order.
LAYOUT_LABELS = (
    "wall",
    "ceiling",
    "floor",
    "surface",
    "inaccurate_window",
    "inaccurate_mirror",
    "inaccurate_outdoor",
    "stairs",
    "object",
)

# Panoptic class ids per layout label; every other id is an object.
PANOPTIC_IDS = {
    "wall": (109, 110, 111, 112, 131),
    "ceiling": (118,),
    "floor": (87, 122, 132),
    "surface": (85, 86, 114, 120),
    "inaccurate_window": (115,),
    "inaccurate_mirror": (93,),
    "inaccurate_outdoor": (90, 116, 119, 123, 125, 126),
    "stairs": (106,),
}

# Display colour of each layout label.
LAYOUT_COLORS = (
    (210, 68, 68),
    (90, 150, 230),
    (80, 185, 105),
    (238, 180, 70),
    (75, 205, 215),
    (205, 105, 220),
    (130, 130, 130),
    (245, 105, 30),
    (150, 105, 70),
)

# Names the segmentation vocabulary must carry at these ids.
EXPECTED_NAMES = {
    85: "curtain",
    86: "door-stuff",
    87: "floor-wood",
    90: "gravel",
    93: "mirror-stuff",
    106: "stairs",
    109: "wall-brick",
    110: "wall-stone",
    111: "wall-tile",
    112: "wall-wood",
    114: "window-blind",
    115: "window-other",
    116: "tree-merged",
    118: "ceiling-merged",
    119: "sky-other-merged",
    120: "cabinet-merged",
    122: "floor-other-merged",
    123: "pavement-merged",
    125: "grass-merged",
    126: "dirt-merged",
    131: "wall-other-merged",
    132: "rug-merged",
}

PANOPTIC_COUNT = 133
OBJECT_ID = LAYOUT_LABELS.index("object")


def layout_id(panoptic: Column) -> Column:
    """Layout id of a panoptic id as a chain of set tests, which needs no join."""
    out = F.lit(OBJECT_ID)
    for name, ids in PANOPTIC_IDS.items():
        out = F.when(panoptic.isin(*ids), F.lit(LAYOUT_LABELS.index(name))).otherwise(out)
    return out


def layout_name(label: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LAYOUT_LABELS)), label.cast("int") + 1)


def label_map(spark: SparkSession) -> DataFrame:
    """One row per panoptic id with its layout id, name and colour (133 rows)."""
    ids = spark.range(PANOPTIC_COUNT).select(F.col("id").cast("int").alias("coco_id"))
    colors = F.array(*(F.array(*map(F.lit, rgb)) for rgb in LAYOUT_COLORS))
    return (
        ids.withColumn("layout_id", layout_id(F.col("coco_id")))
        .withColumn("layout_name", layout_name(F.col("layout_id")))
        .withColumn("rgb", F.element_at(colors, F.col("layout_id") + 1))
        .select(
            "coco_id",
            "layout_id",
            "layout_name",
            *(F.col("rgb")[i].alias(c) for i, c in enumerate("rgb")),
        )
    )


def check_vocabulary(names: DataFrame) -> DataFrame:
    """Mismatch rows of a vocabulary ``(id, name)``: missing, unexpected or differently named ids."""
    spark = names.sparkSession
    expected = ", ".join(f"({i}, '{n}')" for i, n in EXPECTED_NAMES.items())
    required = spark.range(PANOPTIC_COUNT).select(F.col("id").cast("int").alias("id"))
    required = required.join(
        spark.sql(f"SELECT * FROM VALUES {expected} AS t(id, expected)"), "id", "left"
    )
    joined = names.select(F.col("id").cast("int"), F.col("name"), F.lit(True).alias("present")).join(
        required.withColumn("known", F.lit(True)), "id", "full_outer"
    )
    problem = (
        F.when(F.col("present").isNull(), "missing")
        .when(F.col("known").isNull(), "unexpected")
        .when(F.col("expected") != F.col("name"), "renamed")
    )
    return joined.select("id", "expected", F.col("name").alias("actual"), problem.alias("problem")).filter(
        "problem IS NOT NULL"
    )


def layout_members(names: DataFrame) -> DataFrame:
    """Per layout label the sorted panoptic ids mapped to it (bounded by the 133 ids)."""
    return names.select(layout_id(F.col("id")).alias("layout_id"), F.col("id").cast("int")).groupBy(
        "layout_id"
    ).agg(F.sort_array(F.collect_set("id")).alias("coco_ids")).withColumn(
        "layout_name", layout_name(F.col("layout_id"))
    )
