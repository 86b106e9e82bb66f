"""Readers of scene inputs: explicit schemas, one row per item, checks as data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atrium.functions.text import base_name
from atrium.operators.ranking import prefix_counts
from atrium.sources.formats import register_formats

NUMBERS = ("w", "h", "width", "height", "fl_x", "fl_y", "fx", "fy", "cx", "cy", "camera_angle_x", "camera_angle_y")
MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))
FRAME = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("transform_matrix", MATRIX)]
                     + [T.StructField(n, T.DoubleType()) for n in NUMBERS])
TRANSFORMS = T.StructType([T.StructField("scene_id", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in NUMBERS]
                          + [T.StructField("frames", T.ArrayType(FRAME))])
POLYGON = T.StructType([
    T.StructField("vertices", T.ArrayType(T.LongType())), T.StructField("contours", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("contour_masks_rdp", T.ArrayType(T.ArrayType(T.BooleanType()))), T.StructField("plane_eq", T.ArrayType(T.DoubleType())),
    T.StructField("class", T.StringType()), T.StructField("class_id", T.IntegerType())])
CANDIDATE = T.StructType([
    T.StructField("polygon_id", T.LongType()), T.StructField("level_id", T.StringType()), T.StructField("plane_eq", T.ArrayType(T.DoubleType())),
    T.StructField("mean_elevation_meters", T.DoubleType()), T.StructField("area_square_meters", T.DoubleType())])
RECORD = T.StructType([T.StructField("scene_id", T.LongType()), T.StructField("index", T.LongType()), T.StructField("name", T.StringType()),
                       T.StructField("histogram", T.MapType(T.StringType(), T.LongType()))])


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    """Scene documents with intrinsics and a list of frames."""
    return spark.read.schema(TRANSFORMS).json(path)


def frame_rows(transforms: DataFrame) -> DataFrame:
    """One row per frame in document order, with its base name and pose."""
    return transforms.select("scene_id", F.posexplode("frames").alias("frame_id", "f")).select(
        "scene_id", "frame_id", F.col("f.file_path").alias("file_path"), base_name(F.col("f.file_path")).alias("name"),
        F.col("f.transform_matrix").alias("c2w"))


def payload_rows(transforms: DataFrame) -> DataFrame:
    """Intrinsics as found in the document head (order -1) and in each frame."""
    head = transforms.select("scene_id", F.lit(-1).alias("payload"), *NUMBERS)
    frames = transforms.select("scene_id", F.posexplode("frames").alias("payload", "f")).select("scene_id", "payload", *(F.col(f"f.{n}").alias(n) for n in NUMBERS))
    return head.unionByName(frames)


def valid_pose(c2w: Column) -> Column:
    finite = F.forall(c2w, lambda row: (F.size(row) == 4) & F.forall(row, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return (F.size(c2w) == 4) & finite


def duplicate_names(frames: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    return frames.groupBy(*keys, "name").agg(F.count("*").alias("n")).filter("n > 1")


def scan_frame_files(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """Files of a folder tree in name order with a dense index; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    listing = files.select("path", "length", base_name(F.col("path")).alias("name"))
    # names are ordered through their first bytes, then within each such group
    from pyspark.sql import Window as W

    head = listing.withColumn("_h", F.conv(F.hex(F.rpad(F.substring("name", 1, 6), 6, "\0")), 16, 10).cast("bigint"))
    starts = prefix_counts(head.groupBy("_h").agg(F.count("*").alias("_n")), "_h", "_n", "_offset")
    tail = F.row_number().over(W.partitionBy("_h", F.substring("name", 7, 6)).orderBy("name", "path")) - 1
    groups = head.withColumn("_t", F.conv(F.hex(F.rpad(F.substring("name", 7, 6), 6, "\0")), 16, 10).cast("bigint"))
    inner = prefix_counts(groups.groupBy("_h", "_t").agg(F.count("*").alias("_m")), "_t", "_m", "_inner", ["_h"])
    out = groups.withColumn("_tail", tail).join(starts.select("_h", "_offset"), "_h").join(inner.select("_h", "_t", "_inner"), ["_h", "_t"])
    return out.select((F.col("_offset") + F.col("_inner") + F.col("_tail")).alias("index"), "name", "path", "length")


def read_frame_list(spark: SparkSession, path: str) -> DataFrame:
    """Explicit ordered lists of names, one file per scene and one name per line; blank lines do not count.

    Columns that come from the folder names are kept.
    """
    lines = spark.read.text(path, wholetext=True)
    folder = [c for c in lines.columns if c != "value"]
    names = lines.select(*folder, F.filter(F.transform(F.split("value", "\n"), lambda s: F.trim(s)), lambda s: s != "").alias("names"))
    return names.select(*folder, F.posexplode("names").alias("index", "name"))


def missing_names(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Listed rows whose name no found frame has."""
    return wanted.join(found.select("name").distinct(), "name", "left_anti").select(wanted.columns)


def read_frame_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def check_record_count(records: DataFrame, manifest: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Declared against found number of records per scene."""
    found = records.groupBy(*keys).agg(F.count("*").alias("found"))
    return manifest.select(*keys, "declared").join(found, list(keys), "full_outer").select(
        *keys, "declared", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce(F.col("declared") == F.col("found"), F.lit(False)).alias("ok"))


def read_pixel_maps(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """Rasters stored as .npy files, one row per pixel: (name, pix_row, pix_col, value).

    Files go together and large ones are cut by rows, so read partitions are of one size.
    """
    register_formats(spark)
    return spark.read.format("npy_pixels").option("glob", glob).load(path)


def check_pixel_maps(pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    """Per frame: full shape, all finite, something positive."""
    v = F.col("value")
    return pixels.groupBy("name").agg(
        (F.count("*") == rows * cols).alias("shape_ok"), F.every(~F.isnan(v) & (F.abs(v) < float("inf"))).alias("finite"), F.bool_or(v > 0).alias("any_positive"))


def read_lines(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """Text lines with their order: part (file in name order), at (byte in it), line."""
    register_formats(spark)
    reader = spark.read.format("ordered_lines")
    return (reader.option("split", split) if split else reader).load(path)


def numbered_lines(lines: DataFrame, out: str) -> DataFrame:
    """Lines with their 0-based number in text order, without a single-task sort."""
    key = F.shiftleft(F.col("part").cast("bigint"), 40) + F.col("at")  # files below 2^40 bytes
    return prefix_counts(lines.withColumns({"_key": key, "_one": F.lit(1).cast("bigint")}), "_key", "_one", out, bits=64).drop("_key", "_one")


def read_mesh(spark: SparkSession, path: str, form: str = "ply", split: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (vertex_id, x, y, z, r, g, b) and triangles (triangle_id, v0, v1, v2) of ASCII PLY or OBJ text.

    The text may lie in one file or in ordered parts; ids follow from the order of lines.  OBJ has no
    colours (null) and counts vertices from one.
    """
    lines = read_lines(spark, path, split)
    if form == "obj":
        vertices, faces = (numbered_lines(lines.filter(F.col("line").startswith(f"{c} ")), "i") for c in "vf")
        shift, places = 1, (1, 2, 3)
    else:
        mark = F.max(F.when(F.col("line") == "end_header", F.struct("part", "at"))).alias("end")
        count = F.max(F.when(F.col("line").startswith("element vertex "), F.get(F.split("line", " "), F.lit(2)).cast("bigint"))).alias("nv")
        head = lines.filter("line = 'end_header' OR line LIKE 'element vertex %'").agg(mark, count)  # one row
        body = lines.join(F.broadcast(head)).filter(F.struct("part", "at") > F.col("end"))
        body = numbered_lines(body, "i")
        vertices, faces = body.filter("i < nv"), body.filter("i >= nv").withColumn("i", F.col("i") - F.col("nv"))
        shift, places = 0, (0, 1, 2)
    at = lambda k, kind: F.get(F.split("line", " +"), F.lit(k)).cast(kind)
    xyz = [at(k, "double").alias(c) for k, c in zip(places, "xyz")]
    rgb = [at(k + 3, "int").alias(c) if form == "ply" else F.lit(None).cast("int").alias(c) for k, c in enumerate("rgb")]
    corners = [(F.regexp_extract(F.get(F.split("line", " +"), F.lit(k)), "^[0-9]+", 0).cast("bigint") - shift).alias(f"v{k - 1}") for k in (1, 2, 3)]
    return vertices.select(F.col("i").alias("vertex_id"), *xyz, *rgb), faces.select(F.col("i").alias("triangle_id"), *corners)


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Features of a GeoJSON collection with one feature per line; ``schema`` has ``type`` and what else is wanted."""
    parsed = F.from_json(F.regexp_replace("line", "^,", ""), schema)  # head and end are no documents of their own
    return read_lines(spark, path).select(parsed.alias("f")).filter("f.type = 'Feature'").select("f.*")


def read_polygon_info(documents: DataFrame, keys: Sequence[str], column: str = "value") -> DataFrame:
    """Polygon maps keyed by stringified ids (JSON text per scene) as rows with integer ids."""
    parsed = documents.select(*keys, F.from_json(column, T.MapType(T.StringType(), POLYGON)).alias("m"))
    return parsed.select(*keys, F.explode("m").alias("k", "p")).select(*keys, F.col("k").cast("bigint").alias("polygon_id"), "p.*")


def read_prototype(vertices: DataFrame, triangles: DataFrame, polygons: DataFrame, planes: DataFrame | None, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Planes of all polygons, fitted where missing, and the checks of the four tables."""
    from atrium.functions.eigen import moment_sums, planes_from_moments
    from atrium.functions.vectors import vec
    from atrium.operators.mesh import corner_rows
    from atrium.operators.quality import mesh_quality

    poly = [*keys, "polygon_id"]
    missing = polygons.select(*poly) if planes is None else polygons.select(*poly).join(planes, poly, "left_anti")
    used = corner_rows(triangles, keys, ["polygon_id"]).select(*poly, "vertex_id").distinct().join(missing, poly, "left_semi")
    fitted = planes_from_moments(used.join(vertices, [*keys, "vertex_id"]).groupBy(*poly).agg(*moment_sums(vec())), poly).select(*poly, "a", "b", "c", "d")
    full = fitted if planes is None else planes.select(*poly, "a", "b", "c", "d").unionByName(fitted)
    return full, mesh_quality(vertices, triangles, keys)


def read_ceiling_candidates(spark: SparkSession, path: str, floor_z: float, ceiling_z: float) -> DataFrame:
    return usable_candidates(spark.read.schema(CANDIDATE).json(path), floor_z, ceiling_z)


def usable_candidates(records: DataFrame, floor_z: float, ceiling_z: float) -> DataFrame:
    """Candidates with a full, not too steep plane, an area and a height above the floor."""
    c = F.get("plane_eq", F.lit(2))
    filled = records.withColumns({
        "mean_elevation_meters": F.coalesce("mean_elevation_meters", F.lit(float(ceiling_z))),
        "area_square_meters": F.coalesce("area_square_meters", F.lit(0.0))})
    return filled.filter((F.size("plane_eq") == 4) & (F.abs(c) > 1e-8) & (F.col("area_square_meters") > 1e-10)
                         & (F.col("mean_elevation_meters") > floor_z + 1e-6))


def match_frames(frames: DataFrame, records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames and records joined by name, with what is missing or extra; duplicates are an error row.

    A name that occurs twice on one side is kept once and marked.
    """
    on = [*keys, "name"]
    single = lambda df: df.groupBy(*on).agg(*(F.min(c).alias(c) for c in df.columns if c not in on), F.count("*").alias("_n"))
    left, right = single(frames).withColumnRenamed("_n", "_l"), single(records).withColumnRenamed("_n", "_r")
    status = (F.when((F.col("_l") > 1) | (F.col("_r") > 1), "duplicate").when(F.col("_r").isNull(), "missing")
              .when(F.col("_l").isNull(), "extra").otherwise("matched"))
    return left.join(right, on, "full_outer").withColumn("status", status).drop("_l", "_r")


def missing_extra(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, counted with multiplicity."""
    return wanted.exceptAll(found).withColumn("side", F.lit("missing")).unionByName(found.exceptAll(wanted).withColumn("side", F.lit("extra")))
