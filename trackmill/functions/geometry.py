"""Rotations, rigid transforms, ellipsoidal coordinates and interpolation as column expressions.

A quaternion is four columns (w, x, y, z); a transform maps a source frame into a target frame: rotate, then move.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Quaternion = tuple[Column, Column, Column, Column]
Vector = tuple[Column, Column, Column]
#: WGS84.
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)


def from_roll_pitch_heading(roll: Column, pitch: Column, heading: Column) -> Quaternion:
    """The rotation heading (about z), then pitch (about y), then roll (about x)."""
    cr, sr, cp, sp, ch, sh = F.cos(roll / 2), F.sin(roll / 2), F.cos(pitch / 2), F.sin(pitch / 2), F.cos(heading / 2), F.sin(heading / 2)
    return canonical((cr * cp * ch + sr * sp * sh, sr * cp * ch - cr * sp * sh, cr * sp * ch + sr * cp * sh, cr * cp * sh - sr * sp * ch))


def canonical(q: Quaternion) -> Quaternion:
    """Length one, and the first part that is not zero positive."""
    norm = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    sign = F.lit(1.0)
    for part in reversed(q):
        sign = F.when(part < 0, -1.0).when(part > 0, 1.0).otherwise(sign)
    return tuple(sign * p / norm for p in q)


def multiply(p: Quaternion, q: Quaternion) -> Quaternion:
    a, b, c, d = p
    e, f, g, h = q
    return a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e


def conjugate(q: Quaternion) -> Quaternion:
    return q[0], -q[1], -q[2], -q[3]


def rotate(q: Quaternion, v: Vector) -> Vector:
    """v + 2w(u x v) + 2 u x (u x v) for the vector part u."""
    w, x, y, z = q
    cx, cy, cz = y * v[2] - z * v[1], z * v[0] - x * v[2], x * v[1] - y * v[0]
    return v[0] + 2 * (w * cx + y * cz - z * cy), v[1] + 2 * (w * cy + z * cx - x * cz), v[2] + 2 * (w * cz + x * cy - y * cx)


def transform(q: Quaternion, t: Vector, v: Vector) -> Vector:
    return tuple(a + b for a, b in zip(rotate(q, v), t))


def inverse(q: Quaternion, t: Vector) -> tuple[Quaternion, Vector]:
    back = conjugate(q)
    return back, tuple(-x for x in rotate(back, t))


def compose(first: tuple[Quaternion, Vector], second: tuple[Quaternion, Vector]) -> tuple[Quaternion, Vector]:
    """The transform that does `second`, then `first`; its frames must meet (second's target is first's source)."""
    return multiply(first[0], second[0]), transform(first[0], first[1], second[1])


def rotation_distance(p: Quaternion, q: Quaternion) -> Column:
    dot = F.abs(sum((a * b for a, b in zip(p[1:], q[1:])), p[0] * q[0]))
    return 2 * F.acos(F.least(F.lit(1.0), dot))


def slerp(p: Quaternion, q: Quaternion, share: Column) -> Quaternion:
    """Along the shorter arc; straight where the two are nearly the same."""
    dot = sum((a * b for a, b in zip(p[1:], q[1:])), p[0] * q[0])
    sign, size = F.when(dot < 0, -1.0).otherwise(1.0), F.least(F.abs(dot), F.lit(1.0))
    angle = F.acos(size)
    near = size > 0.9995
    one = F.when(near, 1 - share).otherwise(F.sin((1 - share) * angle) / F.sin(F.when(near, 1.0).otherwise(angle)))
    two = F.when(near, share).otherwise(F.sin(share * angle) / F.sin(F.when(near, 1.0).otherwise(angle)))
    return canonical(tuple(one * a + two * sign * b for a, b in zip(p, q)))


def to_ecef(lat: Column, lon: Column, alt: Column) -> Vector:
    """Metres from degrees and metres."""
    phi, lam = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    return (n + alt) * F.cos(phi) * F.cos(lam), (n + alt) * F.cos(phi) * F.sin(lam), (n * (1 - E2) + alt) * F.sin(phi)


def to_enu(lat: Column, lon: Column, alt: Column, origin: tuple[float, float, float]) -> Vector:
    """East, north and up of a place, from an origin in degrees and metres."""
    o = tuple(map(F.lit, origin))
    dx, dy, dz = (a - b for a, b in zip(to_ecef(lat, lon, alt), to_ecef(*o)))
    sp, cp, sl, cl = F.sin(F.radians(o[0])), F.cos(F.radians(o[0])), F.sin(F.radians(o[1])), F.cos(F.radians(o[1]))
    return -sl * dx + cl * dy, -sp * cl * dx - sp * sl * dy + cp * dz, cp * cl * dx + cp * sl * dy + sp * dz


def from_enu(east: Column, north: Column, up: Column, origin: tuple[float, float, float]) -> Vector:
    """Degrees and metres of a place given from an origin, by Bowring's formula (well under a millimetre near the ground)."""
    o = tuple(map(F.lit, origin))
    sp, cp, sl, cl = F.sin(F.radians(o[0])), F.cos(F.radians(o[0])), F.sin(F.radians(o[1])), F.cos(F.radians(o[1]))
    x0, y0, z0 = to_ecef(*o)
    x, y, z = x0 - sl * east - sp * cl * north + cp * cl * up, y0 + cl * east - sp * sl * north + cp * sl * up, z0 + cp * north + sp * up
    p, b = F.sqrt(x * x + y * y), A * (1 - FLATTENING)
    theta = F.atan2(z * A, p * b)
    phi = F.atan2(z + E2 / (1 - E2) * b * F.pow(F.sin(theta), F.lit(3)), p - E2 * A * F.pow(F.cos(theta), F.lit(3)))
    n = A / F.sqrt(1 - E2 * F.pow(F.sin(phi), F.lit(2)))
    return F.degrees(phi), F.degrees(F.atan2(y, x)), p * F.cos(phi) + z * F.sin(phi) - A * A / n
