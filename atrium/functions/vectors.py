"""Small 3D vector and plane algebra on Columns; everything here stays inside codegen."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = F.lit  # shorthand for literals


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    def __add__(self, o: "Vec") -> "Vec":  # type: ignore[override]
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: "Vec") -> "Vec":
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def scale(self, k) -> "Vec":
        return Vec(self.x * k, self.y * k, self.z * k)

    def over(self, k: Column) -> "Vec":
        """Divide by a number; null where it is zero, which ANSI mode would reject."""
        k = F.nullif(k, F.lit(0.0))
        return Vec(self.x / k, self.y / k, self.z / k)

    def dot(self, o: "Vec") -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: "Vec") -> "Vec":
        return Vec(
            self.y * o.z - self.z * o.y,
            self.z * o.x - self.x * o.z,
            self.x * o.y - self.y * o.x,
        )

    def norm2(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.norm2())

    def unit(self, floor: float = 0.0) -> "Vec":
        n = F.greatest(self.norm(), F.lit(floor)) if floor else self.norm()
        return self.over(n)

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))

    def when(self, cond: Column, other: "Vec") -> "Vec":
        return Vec(*(F.when(cond, a).otherwise(b) for a, b in zip(self, other)))


def vec(prefix: str = "", suffix: str = "") -> Vec:
    """Vector from three columns such as ``ax, ay, az`` (prefix) or ``x1, y1, z1`` (suffix)."""
    return Vec(*(F.col(f"{prefix}{c}{suffix}") for c in "xyz"))


def named(prefix: str, v: Vec) -> dict[str, Column]:
    """Column map of a vector for ``withColumns``; used to keep long expressions computed once."""
    return {f"{prefix}{n}": c for n, c in zip("xyz", v)}


def vec_of(struct: Column) -> Vec:
    return Vec(struct["x"], struct["y"], struct["z"])


def const(x: float, y: float, z: float) -> Vec:
    return Vec(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))


class Plane(NamedTuple):
    a: Column
    b: Column
    c: Column
    d: Column

    @property
    def n(self) -> Vec:
        return Vec(self.a, self.b, self.c)

    def at(self, p: Vec) -> Column:
        return self.n.dot(p) + self.d


def plane(prefix: str = "", suffix: str = "") -> Plane:
    return Plane(*(F.col(f"{prefix}{c}{suffix}") for c in "abcd"))


def r6(value: Column, digits: int = 6) -> Column:
    """Rounding for comparison between engines.

    The shift keeps decimal half-way values, which many derived coordinates are, from falling to
    either side by the last bit of a double.
    """
    return F.round(value + F.lit(2.3 * 10.0 ** -(digits + 2)), digits)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def project_to_plane(p: Vec, pl: Plane) -> tuple[Vec, Column]:
    """Foot of the perpendicular on a unit plane, and the unsigned distance."""
    dist = pl.at(p)
    return p - pl.n.scale(dist), F.abs(dist)


def plane_axes(n: Vec) -> tuple[Vec, Vec]:
    """Two unit axes spanning the plane: cross with the coordinate axis the normal leans on least."""
    ax, ay, az = F.abs(n.x), F.abs(n.y), F.abs(n.z)
    use_x = (ax <= ay) & (ax <= az)
    use_y = ~use_x & (ay <= az)
    axis = Vec(
        F.when(use_x, 1.0).otherwise(0.0),
        F.when(use_y, 1.0).otherwise(0.0),
        F.when(use_x | use_y, 0.0).otherwise(1.0),
    )
    u = n.cross(axis).unit()
    return u, n.cross(u)


def slope_axes(n: Vec) -> tuple[Vec, Vec]:
    """Axes (1, 0, -nx/nz) and n x e1, both normalised; only for planes that are not vertical."""
    e1 = Vec(F.lit(1.0), F.lit(0.0), -n.x / n.z).unit()
    return e1, n.cross(e1).unit()


def project_to_line(p: Vec, p1: Vec, p2: Vec) -> tuple[Vec, Column]:
    """Foot on the infinite line and distance; null when the two line points coincide."""
    d = p2 - p1
    length2 = F.when(d.norm2() > 0, d.norm2())
    t = (p - p1).dot(d) / length2
    foot = p1 + d.scale(t)
    return foot, (p - foot).norm()


def plane_plane_line(p: Plane, q: Plane, eps: float = 1e-8) -> tuple[Vec, Vec, Column]:
    """Point and direction of the common line; the flag is false for (nearly) parallel planes."""
    direction = p.n.cross(q.n)
    det = direction.norm2()
    ok = F.abs(det) >= eps
    point = (q.n.cross(direction).scale(-p.d) + direction.cross(p.n).scale(-q.d)).over(
        F.when(ok, det)
    )
    return point, direction, ok


def line_plane_point(p1: Vec, p2: Vec, pl: Plane, eps: float = 1e-8) -> Vec:
    d = p2 - p1
    t = -(pl.at(p1)) / (d.dot(pl.n) + F.lit(eps))
    return p1 + d.scale(t)


def three_plane_point(p: Plane, q: Plane, r: Plane, eps: float = 1e-8) -> tuple[Vec, Column]:
    det = p.n.dot(q.n.cross(r.n))
    ok = F.abs(det) >= eps
    point = (
        q.n.cross(r.n).scale(-p.d) + r.n.cross(p.n).scale(-q.d) + p.n.cross(q.n).scale(-r.d)
    ).over(F.when(ok, det))
    return point, ok


def segment_foot(p: Vec, a: Vec, b: Vec, eps: float = 1e-8) -> Vec:
    """Closest point of a segment; a segment shorter than sqrt(eps) counts as its first point."""
    d = b - a
    return a + d.scale(segment_share(p, a, d, eps))


def segment_share(p: Vec, a: Vec, d: Vec, eps: float = 1e-8) -> Column:
    """Where on the segment a..a+d (0..1) its closest point lies."""
    l2 = d.norm2()
    return F.when(l2 < eps, F.lit(0.0)).otherwise(clamp((p - a).dot(d) / l2, 0.0, 1.0))


def segment_distance2(p: Vec, a: Vec, b: Vec, eps: float = 1e-8) -> Column:
    return (p - segment_foot(p, a, b, eps)).norm2()


def with_triangle_closest(df: DataFrame, p: Vec, a: Vec, b: Vec, c: Vec, out: str = "q") -> DataFrame:
    """Add the closest point of a triangle as ``{out}x..z`` and its barycentric weights ``{out}v, {out}w``.

    The six dot products that tell vertex, edge and face regions apart are columns of their own, so
    that each is computed once.
    """
    ab, ac = b - a, c - a
    dots = {f"_d{i}": e.dot(p - o) for i, (e, o) in enumerate(((ab, a), (ac, a), (ab, b), (ac, b), (ab, c), (ac, c)), 1)}
    df = df.withColumns(dots)
    d1, d2, d3, d4, d5, d6 = (F.col(n) for n in dots)
    df = df.withColumns({"_va": d3 * d6 - d5 * d4, "_vb": d5 * d2 - d1 * d6, "_vc": d1 * d4 - d3 * d2})
    va, vb, vc = F.col("_va"), F.col("_vb"), F.col("_vc")
    zero, one = F.lit(0.0), F.lit(1.0)
    zeroless = lambda c: F.nullif(c, F.lit(0.0))
    share = (d4 - d3) / zeroless((d4 - d3) + (d5 - d6))
    regions = [  # condition, weight of ab, weight of ac
        ((d1 <= 0) & (d2 <= 0), zero, zero),
        ((d3 >= 0) & (d4 <= d3), one, zero),
        ((d6 >= 0) & (d5 <= d6), zero, one),
        ((vc <= 0) & (d1 >= 0) & (d3 <= 0), d1 / zeroless(d1 - d3), zero),
        ((vb <= 0) & (d2 >= 0) & (d6 <= 0), zero, d2 / zeroless(d2 - d6)),
        ((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), one - share, share),
    ]
    v, w = vb / zeroless(va + vb + vc), vc / zeroless(va + vb + vc)
    for cond, cv, cw in reversed(regions):
        v, w = F.when(cond, cv).otherwise(v), F.when(cond, cw).otherwise(w)
    df = df.withColumns({f"{out}v": v, f"{out}w": w}).drop(*dots, "_va", "_vb", "_vc")
    return df.withColumns(named(out, a + ab.scale(F.col(f"{out}v")) + ac.scale(F.col(f"{out}w"))))


def triangle_distance2(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Squared distance to a triangle without the closest point: face if the foot is inside, else edges."""
    ab, ac = b - a, c - a
    n = ab.cross(ac)
    n2 = n.norm2()
    ap = p - a
    v = ap.cross(ac).dot(n)
    w = ab.cross(ap).dot(n)
    inside = (n2 > 0) & (v >= 0) & (w >= 0) & (v + w <= n2)
    h = ap.dot(n)
    edges = F.least(segment_distance2(p, a, b), segment_distance2(p, b, c), segment_distance2(p, c, a))
    return F.when(inside, h * h / n2).otherwise(edges)


def triangle_normal(a: Vec, b: Vec, c: Vec) -> tuple[Column, Vec]:
    """Area (0 where not a number) and unit normal with its length kept away from zero."""
    n = (b - a).cross(c - a)
    length = n.norm()
    area = F.when(F.isnan(length), 0.0).otherwise(length * 0.5)
    return area, n.over(F.greatest(length, F.lit(1e-14)))


def ray_triangle(origin: Vec, dest: Vec, a: Vec, b: Vec, c: Vec, eps: float = 1e-12) -> Column:
    """Parameter t of the hit along origin->dest (1 at dest), null without a hit."""
    d = dest - origin
    ab, ac = b - a, c - a
    h = d.cross(ac)
    det = ab.dot(h)
    ok = F.abs(det) > eps
    safe = F.when(ok, det)
    s = origin - a
    u = s.dot(h) / safe
    q = s.cross(ab)
    v = d.dot(q) / safe
    t = ac.dot(q) / safe
    return F.when(ok & (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0), t)


def angle_degrees(u: Vec, v: Vec) -> Column:
    return F.degrees(F.acos(clamp(u.dot(v), -1.0, 1.0)))


def plane_z(pl: Plane, x: Column, y: Column, eps: float = 1e-8) -> Column:
    """Height of the plane over (x, y); an error for planes too steep to have one."""
    steep = F.raise_error(F.lit("plane has no height: |c| is too small")).cast("double")
    return F.when(F.abs(pl.c) > eps, -(pl.a * x + pl.b * y + pl.d) / pl.c).otherwise(steep)
