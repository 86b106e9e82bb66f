"""Stable display colours and instance colour codes as integer arithmetic on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Golden-ratio hue step, and saturation and brightness of each palette.
GOLDEN = 0.6180339887498949
CANDIDATE_SV = (0.62, 0.95)
PLANE_SV = (0.72, 0.95)
KNUTH = 2654435761


def hsv_to_rgb(hue: Column, saturation: float, value: float) -> tuple[Column, Column, Column]:
    """RGB in [0, 1] of a hue in [0, 1)."""
    sector = F.floor(hue * 6.0)
    frac = hue * 6.0 - sector
    v = F.lit(value)
    p = F.lit(value * (1.0 - saturation))
    q = v * (F.lit(1.0) - F.lit(saturation) * frac)
    t = v * (F.lit(1.0) - F.lit(saturation) * (F.lit(1.0) - frac))
    i = F.pmod(sector, F.lit(6))

    def pick(*channels: Column) -> Column:
        out = channels[5]
        for k in range(4, -1, -1):
            out = F.when(i == k, channels[k]).otherwise(out)
        return out

    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def golden_hue(index: Column) -> Column:
    hue = index * F.lit(GOLDEN)
    return hue - F.floor(hue)


def candidate_color(id_: Column) -> tuple[Column, ...]:
    return tuple(F.rint(c * 255).cast("int") for c in hsv_to_rgb(golden_hue(id_ + 1), *CANDIDATE_SV))


def plane_color(id_: Column) -> tuple[Column, ...]:
    return tuple(F.rint(c * 255).cast("int") for c in hsv_to_rgb(golden_hue(id_), *PLANE_SV))


def hashed_color(id_: Column) -> Column:
    """24-bit colour from a multiplicative hash."""
    return ((id_ + 1) * F.lit(KNUTH)).bitwiseAND(F.lit(0xFFFFFF))


def instance_of_color(red: Column, green: Column, blue: Column) -> Column:
    return red.cast("bigint") + green.cast("bigint") * 256 + blue.cast("bigint") * 65536


def color_of_instance(id_: Column) -> tuple[Column, Column, Column]:
    channel = lambda s: F.shiftright(id_, s).bitwiseAND(F.lit(255)).cast("int")
    return channel(0), channel(8), channel(16)


def room_hue(label: Column) -> Column:
    """Hue step (0..179) of a room label in the floorplan preview."""
    return F.rint(golden_hue(label) * 179).cast("int")
