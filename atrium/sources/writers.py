"""Sinks: frame records, features, meshes as text, entities by class, arrays, run records and gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.sources.formats import register_formats


def save_mode(overwrite: bool) -> str:
    """An existing output is an error unless overwriting was asked for."""
    return "overwrite" if overwrite else "errorifexists"


def write_frame_records(records: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON document per line with keys in name order."""
    records.select(*sorted(records.columns)).write.mode(save_mode(overwrite)).json(path)


def write_features(features: DataFrame, path: str, overwrite: bool = False) -> None:
    """One GeoJSON feature collection in ordered parts: head, a feature per line by id, end."""
    write_mesh_rows(collection_lines(features), path, overwrite, ".geojson")


def collection_lines(features: DataFrame) -> DataFrame:
    """Lines (section, idx, line) of a feature collection; every feature but the first begins with a comma."""
    first = F.broadcast(features.agg(F.min("id").alias("_first")))  # one row
    body = feature_lines(features, "id").join(first)
    line = F.when(F.col("id") == F.col("_first"), F.col("value")).otherwise(F.concat(F.lit(","), "value"))
    frame = features.sparkSession.createDataFrame([(0, '{"type":"FeatureCollection","features":['), (2, "]}")], "section int, line string")
    return frame.select("section", F.lit(None).cast(features.schema["id"].dataType).alias("idx"), "line").unionByName(
        body.select(F.lit(1).alias("section"), F.col("id").alias("idx"), line.alias("line")))


def feature_lines(features: DataFrame, *keep: str) -> DataFrame:
    """GeoJSON features, one per line: ``id``, ``geometry_type``, ``coordinates`` and other columns as properties."""
    rest = [c for c in features.columns if c not in ("id", "geometry_type", "coordinates")]
    doc = F.struct(
        F.lit("Feature").alias("type"), F.col("id"),
        F.struct(F.col("geometry_type").alias("type"), F.col("coordinates")).alias("geometry"),
        F.struct(*rest).alias("properties"))
    return features.select(*keep, F.to_json(doc).alias("value"))


def byte(channel: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(channel))).cast("int")


def ply_lines(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """ASCII PLY as (section, idx, line): header, coloured vertex lines, faces.

    ``vertices``: vertex_id 0..n-1, x..z, r, g, b; ``triangles``: triangle_id, v0..v2.  An empty mesh
    is an error.
    """
    nv, nt = vertices.agg(F.count("*").alias("nv")), triangles.agg(F.count("*").alias("nt"))  # one row each
    header = F.concat_ws(
        "\n", F.lit("ply"), F.lit("format ascii 1.0"), F.concat(F.lit("element vertex "), F.col("nv")),
        *(F.lit(f"property float {c}") for c in "xyz"), *(F.lit(f"property uchar {c}") for c in ("red", "green", "blue")),
        F.concat(F.lit("element face "), F.col("nt")), F.lit("property list uchar int vertex_indices"), F.lit("end_header"))
    refuse = F.raise_error(F.lit("refusing to write an empty mesh")).cast("string")
    head = nv.join(F.broadcast(nt)).select(F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("idx"), F.when((F.col("nv") > 0) & (F.col("nt") > 0), header).otherwise(refuse).alias("line"))
    v = vertices.select(F.lit(1).alias("section"), F.col("vertex_id").cast("bigint").alias("idx"),
                        F.format_string("%.6f %.6f %.6f %d %d %d", "x", "y", "z", *(byte(F.col(c)) for c in "rgb")).alias("line"))
    t = triangles.select(F.lit(2).alias("section"), F.col("triangle_id").cast("bigint").alias("idx"), F.format_string("3 %d %d %d", "v0", "v1", "v2").alias("line"))
    return head.unionByName(v).unionByName(t)


def obj_lines(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """OBJ as (section, idx, line); faces count vertices from one."""
    v = vertices.select(F.lit(1).alias("section"), F.col("vertex_id").cast("bigint").alias("idx"), F.format_string("v %.6f %.6f %.6f", "x", "y", "z").alias("line"))
    t = triangles.select(F.lit(2).alias("section"), F.col("triangle_id").cast("bigint").alias("idx"),
                         F.format_string("f %d %d %d", *(F.col(f"v{i}") + 1 for i in range(3))).alias("line"))
    return v.unionByName(t)


def write_mesh_rows(lines: DataFrame, path: str, overwrite: bool = False, extension: str = ".ply") -> None:
    """Lines in (section, idx) order over range-partitioned part files; in name order they are the text.

    Tasks stage their part, one commit makes all parts visible.
    """
    register_formats(lines.sparkSession)
    _staged(lines.orderBy("section", "idx").select("line").write.format("ordered_lines").option("extension", extension), path, overwrite)


def write_pixel_maps(pixels: DataFrame, path: str, overwrite: bool = False, dtype: str = "float64") -> None:
    """One .npy file per frame from pixel rows (name, pix_row, pix_col, value); a frame is written by one task."""
    register_formats(pixels.sparkSession)
    rows = pixels.select("name", F.col("pix_row").cast("int"), F.col("pix_col").cast("int"), F.col("value").cast("double"))
    rows = rows.repartition("name").sortWithinPartitions("name", "pix_row", "pix_col")
    _staged(rows.write.format("npy_pixels").option("dtype", dtype), path, overwrite)


def _staged(writer, path: str, overwrite: bool) -> None:
    """Sources of our own know no errorifexists mode; the option says the same."""
    writer.mode("overwrite" if overwrite else "append").option("ifexists", "replace" if overwrite else "error").save(path)


def write_layout_tables(entities: DataFrame, path: str, overwrite: bool = False) -> None:
    """Entities in one folder per class."""
    entities.write.mode(save_mode(overwrite)).partitionBy("class").parquet(path)


def write_arrays(rows: DataFrame, path: str, by: Sequence[str] = ("scene_id",), overwrite: bool = False) -> None:
    rows.write.mode(save_mode(overwrite)).partitionBy(*by).parquet(path)


def run_rows(checks: DataFrame, component: str, counts: Mapping[str, Column], started: Column, finished: Column, outputs: Sequence[str], keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """One record per scene of a component run; failed validations give status ``failed``."""
    from atrium.functions.text import elapsed_seconds, iso_utc

    entries = [x for n, c in counts.items() for x in (F.lit(n), c.cast("bigint"))]
    return checks.select(
        *keys, F.lit(component).alias("component"), F.when(F.col("passed"), "complete").otherwise("failed").alias("status"),
        iso_utc(started).alias("started_at"), iso_utc(finished).alias("finished_at"), elapsed_seconds(started, finished).alias("elapsed_seconds"),
        F.create_map(*entries).alias("counts"), "validation", F.array(*map(F.lit, outputs)).alias("outputs"))


def write_run(runs: DataFrame, path: str) -> None:
    """Append run records; records that failed validation stop the write."""
    guard = F.when(F.col("status") == "complete", F.col("status")).otherwise(F.raise_error(F.lit("run failed its validation")).cast("string"))
    runs.withColumn("status", guard).write.mode("append").json(path)


def gate_complete(runs: DataFrame, outputs: DataFrame, present: DataFrame, component: str, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Scenes whose latest run of a component is complete and whose declared outputs all exist."""
    latest = runs.filter(F.col("component") == component).groupBy(*keys).agg(F.max_by("status", F.struct("finished_at", "status")).alias("status"))
    lacking = outputs.filter(F.col("component") == component).join(present, [*keys, "output"], "left_anti").select(*keys).distinct()
    return latest.filter("status = 'complete'").join(lacking, list(keys), "left_anti").select(*keys)
