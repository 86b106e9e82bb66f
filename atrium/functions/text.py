"""String, map and time scalars: paths, ids, histograms as JSON, elapsed time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")


def relocate(path: Column, roots: Mapping[str, str]) -> Column:
    """Path after the first known component directory, put under that component's new root."""
    found = [
        F.when(path.rlike(f"/{name}/"), F.concat(F.lit(f"{root}/"), F.regexp_extract(path, f"/{name}/(.*)$", 1)))
        for name, root in roots.items()
    ]
    return F.coalesce(*found)


def checkpoint_step(path: Column) -> Column:
    """Step number of ``step-N.ckpt`` or ``fitted_mesh_N.ply``; null for other files."""
    digits = F.regexp_extract(base_name(path), r"^(?:step-|fitted_mesh_)0*([0-9]+)\.(?:ckpt|ply)$", 1)
    return F.when(digits != "", digits).cast("bigint")


def room_id(level: Column, number: Column) -> Column:
    return F.format_string("level_%d_room_%03d", level, number)


def opening_id(number: Column) -> Column:
    return F.format_string("opening_%03d", number)


def short_number(name: Column, before: str, digits: int) -> Column:
    """Name whose number behind ``before`` keeps its first ``digits`` digits, as ``lpad`` leaves it."""
    return F.regexp_replace(name, rf"({before}\d{{{digits}}})\d+", "$1")


def wall_id(room: Column, index: Column, above: Column | None = None) -> Column:
    base = F.concat(room, F.lit(":wall:"), index.cast("string"))
    return base if above is None else F.concat(base, F.lit(":above_"), above)


def histogram_json(label: str, count: str) -> Column:
    """Sparse histogram as JSON with keys in numeric order (aggregate over one row per label)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(label), F.col(count))))
    return F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e[label].cast("string"), e[count]))))


def argmin_array(values: Column) -> Column:
    """0-based index of the smallest element, the first one on ties."""
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def elapsed_seconds(started: Column, finished: Column) -> Column:
    micros = F.unix_micros(finished.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))
    return F.round(micros / F.lit(1e6), 6)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
