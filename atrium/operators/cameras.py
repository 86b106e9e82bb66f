"""Camera intrinsics, metric depth and back-projection of pixels into the world."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.functions.vectors import Vec, clamp

# Fixed values of the depth network's input: height, width and focal length it was trained for.
NETWORK_HEIGHT, NETWORK_WIDTH, CANONICAL_FOCAL = 616, 1064, 1000.0
MAX_DEPTH = 300.0
FALLBACK_DEPTH = 0.5  # stands in for an invalid depth so that the ray keeps its direction

# Accepted spellings of each intrinsic, first one wins.
INTRINSIC_KEYS = {
    "width": ("w", "width"),
    "height": ("h", "height"),
    "fx": ("fl_x", "fx"),
    "fy": ("fl_y", "fy"),
    "cx": ("cx",),
    "cy": ("cy",),
    "angle_x": ("camera_angle_x",),
    "angle_y": ("camera_angle_y",),
}


def pinhole_intrinsics(payloads: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One camera per scene from payload rows (document head first, then its frames, by ``order``).

    Each value comes from the first payload that has it; a focal length may come from the field of
    view, ``fy`` from ``fx``, and the principal point from the image centre.
    """

    def first(names: Sequence[str]) -> Column:
        value = F.coalesce(*(F.col(n).cast("double") for n in names if n in payloads.columns))
        return F.min_by(value, F.when(value.isNotNull(), F.col(order)))

    found = payloads.groupBy(*keys).agg(*(first(n).alias(k) for k, n in INTRINSIC_KEYS.items()))
    from_angle = lambda size, angle: F.lit(0.5) * F.col(size) / F.tan(F.lit(0.5) * F.col(angle))
    out = (
        found.withColumn("fx", F.coalesce("fx", from_angle("width", "angle_x")))
        .withColumn("fy", F.coalesce("fy", from_angle("height", "angle_y"), "fx"))
        .withColumn("cx", F.coalesce("cx", F.col("width") / 2))
        .withColumn("cy", F.coalesce("cy", F.col("height") / 2))
    )
    ok = F.coalesce(
        (F.col("width") > 0) & (F.col("height") > 0) & (F.col("fx") > 0) & (F.col("fy") > 0), F.lit(False)
    )
    return out.select(
        *keys,
        F.col("width").cast("int").alias("width"),
        F.col("height").cast("int").alias("height"),
        "fx", "fy", "cx", "cy",
        ok.alias("valid"),
    )


def letterbox(width: Column, height: Column) -> dict[str, Column]:
    """Scale and paddings that fit an image into the depth network's input."""
    scale = F.least(F.lit(float(NETWORK_HEIGHT)) / height, F.lit(float(NETWORK_WIDTH)) / width)
    new_w, new_h = F.floor(width * scale), F.floor(height * scale)
    pad_w, pad_h = NETWORK_WIDTH - new_w, NETWORK_HEIGHT - new_h
    top, left = F.floor(pad_h / 2), F.floor(pad_w / 2)
    return {
        "resize_scale": scale, "new_width": new_w, "new_height": new_h,
        "pad_top": top, "pad_bottom": pad_h - top, "pad_left": left, "pad_right": pad_w - left,
    }


def metric_depth(canonical: Column, fx: Column, scale: Column) -> Column:
    """Canonical-camera depth to metres of the real camera, kept in the usable range."""
    return clamp(canonical * fx * scale / F.lit(CANONICAL_FOCAL), 0.0, MAX_DEPTH)


def pose_columns(frames: DataFrame, on: Sequence[str]) -> DataFrame:
    """Frame keys with the upper three pose rows as twelve flat columns, the form that is joined."""
    return frames.select(*on, *(F.col("c2w")[i][j].alias(f"_m{i}{j}") for i in range(3) for j in range(4)))


def to_world(p: Vec) -> Vec:
    """Camera point to world by the pose columns."""
    row = lambda i: F.col(f"_m{i}0") * p.x + F.col(f"_m{i}1") * p.y + F.col(f"_m{i}2") * p.z + F.col(f"_m{i}3")
    return Vec(row(0), row(1), row(2))


def camera_point(col: Column, row: Column, depth: Column, fx, fy, cx, cy, half_pixel: bool) -> Vec:
    """Point in OpenGL camera axes (x right, y up, looking along -z)."""
    shift = 0.5 if half_pixel else 0.0
    x = (col + F.lit(shift) - cx) * depth / fx
    y = (row + F.lit(shift) - cy) * depth / fy
    return Vec(x, -y, -depth)


def unproject_depth(
    pixels: DataFrame, frames: DataFrame, fx, fy, cx, cy, *, stride: int = 8,
    min_depth: float = 0.1, max_depth: float = 30.0, on: Sequence[str] = ("scene_id", "frame_id"),
) -> DataFrame:
    """World points of every ``stride``-th pixel in both axes with a usable depth."""
    kept = stride_rows(pixels, stride).filter(depth_in_range(F.col("depth"), min_depth, max_depth))
    joined = kept.join(pose_columns(frames, on), list(on))
    fx, fy, cx, cy = (F.lit(float(v)) if not isinstance(v, Column) else v for v in (fx, fy, cx, cy))
    world = to_world(camera_point(F.col("pix_col"), F.col("pix_row"), F.col("depth"), fx, fy, cx, cy, False))
    return joined.select(*pixels.columns, *(v.alias(n) for n, v in zip("xyz", world)))


def backproject_samples(
    samples: DataFrame, frames: DataFrame, fx, fy, cx, cy, *,
    on: Sequence[str] = ("scene_id", "frame_id"), flat: str | None = None, width: int | Column | None = None,
) -> DataFrame:
    """Rays from the camera centre through sampled pixel centres; invalid depths get a fallback length.

    Samples have ``pix_row`` and ``pix_col``, or with ``flat`` the name of a flat index into frames of
    ``width`` columns, from which these follow.
    """
    if flat is not None:
        row, col = pixel_of_index(F.col(flat), width)
        samples = samples.withColumns({"pix_row": row, "pix_col": col})
    joined = samples.join(pose_columns(frames, on), list(on))
    fx, fy, cx, cy = (F.lit(float(v)) if not isinstance(v, Column) else v for v in (fx, fy, cx, cy))
    valid = valid_depth(F.col("depth"))
    depth = F.when(valid, F.col("depth")).otherwise(F.lit(FALLBACK_DEPTH))
    dest = to_world(camera_point(F.col("pix_col"), F.col("pix_row"), depth, fx, fy, cx, cy, True))
    origin = Vec(*(F.col(f"_m{i}3") for i in range(3)))
    return joined.select(
        *samples.columns,
        valid.alias("valid"),
        *(v.alias(f"o{n}") for n, v in zip("xyz", origin)),
        *(v.alias(n) for n, v in zip("xyz", dest)),
    )


def pixel_of_index(flat: Column, width) -> tuple[Column, Column]:
    """Row and column of a flat pixel index."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.floor(flat / w).cast("int"), F.pmod(flat, w).cast("int")


def valid_depth(depth: Column) -> Column:
    return depth.isNotNull() & ~F.isnan(depth) & (depth > 0) & (depth < F.lit(float("inf")))


def depth_in_range(depth: Column, low: float = 0.1, high: float = 30.0) -> Column:
    return depth.isNotNull() & ~F.isnan(depth) & depth.between(low, high)


def stride_rows(pixels: DataFrame, stride: int) -> DataFrame:
    return pixels.filter((F.col("pix_row") % stride == 0) & (F.col("pix_col") % stride == 0))


def depth_range_counts(pixels: DataFrame, keys: Sequence[str], low: float = 0.1, high: float = 30.0) -> DataFrame:
    """Per frame: accepted samples, samples beyond the far limit, and the range of accepted depths."""
    d, ok = F.col("depth"), depth_in_range(F.col("depth"), low, high)
    return pixels.groupBy(*keys).agg(
        F.count_if(ok).alias("accepted"),
        F.count_if(~F.isnan(d) & (d > high)).alias("too_far"),
        F.min(F.when(ok, d)).alias("min_depth"),
        F.max(F.when(ok, d)).alias("max_depth"),
    )
