"""Geodetic columns: ECEF, topocentric frames, tile boxes, mesh footprints."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84; the semi-minor axis is written with different precision by different producers, so it is a parameter.
A = 6378137.0
B = 6356752.314245
B_CARTESIAN = 6356752.3142451793
B_TRANSFORM = 6356752.3142
METRES_PER_DEGREE = 111_320.0


def ecef_lonlat(lon: Column, lat: Column, height: Column, b: float = B_CARTESIAN) -> Column:
    """``struct<x,y,z>`` of degrees and metres through the surface normal; a null height is 0."""
    lo, la, h = F.radians(lon), F.radians(lat), F.coalesce(height, F.lit(0.0))
    nx, ny, nz = F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)
    kx, ky, kz = F.lit(A * A) * nx, F.lit(A * A) * ny, F.lit(b * b) * nz
    gamma = F.sqrt(nx * kx + ny * ky + nz * kz)
    return F.struct((kx / gamma + nx * h).alias("x"), (ky / gamma + ny * h).alias("y"), (kz / gamma + nz * h).alias("z"))


def ecef_from_lla(lat: Column, lon: Column, alt: Column, b: float = B) -> Column:
    la, lo = F.radians(lat), F.radians(lon)
    radius = F.lit(A * A) / F.sqrt(A * A * F.cos(la) * F.cos(la) + b * b * F.sin(la) * F.sin(la))
    return F.struct(
        ((radius + alt) * F.cos(la) * F.cos(lo)).alias("x"), ((radius + alt) * F.cos(la) * F.sin(lo)).alias("y"), ((F.lit((b / A) ** 2) * radius + alt) * F.sin(la)).alias("z")
    )


def lla_from_ecef(x: Column, y: Column, z: Column, b: float = B) -> Column:
    """One Bowring step; the altitude p / cos(lat) - N is unstable near the poles."""
    ea, eb = (A * A - b * b) / (A * A), (A * A - b * b) / (b * b)
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * A, p * b)
    lat = F.atan2(z + eb * b * F.pow(F.sin(theta), 3), p - ea * A * F.pow(F.cos(theta), 3))
    n = F.lit(A) / F.sqrt(1 - ea * F.sin(lat) * F.sin(lat))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"), (p / F.cos(lat) - n).alias("alt"))


def _axes(lat: Column, lon: Column) -> tuple[list[Column], list[Column], list[Column]]:
    """East, north and up at a place."""
    la, lo = F.radians(lat), F.radians(lon)
    east = [-F.sin(lo), F.cos(lo), F.lit(0.0)]
    north = [-F.sin(la) * F.cos(lo), -F.sin(la) * F.sin(lo), F.cos(la)]
    up = [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]
    return east, north, up


def enu_from_lla(lat: Column, lon: Column, alt: Column, ref: tuple[Column, Column, Column]) -> Column:
    p, o = ecef_from_lla(lat, lon, alt), ecef_from_lla(*ref)
    d = [p[c] - o[c] for c in "xyz"]
    return F.struct(*[sum((a * v for a, v in zip(axis[1:], d[1:])), axis[0] * d[0]).alias(c) for c, axis in zip("xyz", _axes(ref[0], ref[1]))])


def lla_from_enu(x: Column, y: Column, z: Column, ref: tuple[Column, Column, Column]) -> Column:
    """Back from the frame at ``ref``: its axes are orthonormal, so the transpose turns back."""
    o, axes = ecef_from_lla(*ref), _axes(ref[0], ref[1])
    return lla_from_ecef(*[o[c] + axes[0][i] * x + axes[1][i] * y + axes[2][i] * z for i, c in enumerate("xyz")])


def gps_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = ecef_from_lla(lat1, lon1, F.lit(0.0)), ecef_from_lla(lat2, lon2, F.lit(0.0))
    return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "yz"), (a["x"] - b["x"]) * (a["x"] - b["x"])))


def enu_transform16(lat: Column, lon: Column, alt: Column, scale: Column | None = None, b: float = B_TRANSFORM) -> Column:
    """Column-major 4x4 from the local frame at a place to ECEF, times a scale."""
    s = F.lit(1.0) if scale is None else scale
    o = ecef_from_lla(lat, lon, alt, b)
    cells: list[Column] = []
    for axis in _axes(lat, lon):
        cells += [v * s for v in axis] + [F.lit(0.0)]
    return F.array(*cells, o["x"], o["y"], o["z"], F.lit(1.0))


def box_from_size(center: Column, size: Column) -> Column:
    """12 numbers: centre, then half axes along x, y, z."""
    zero = F.lit(0.0)
    return F.array(center[0], center[1], center[2], size[0] / 2, zero, zero, zero, size[1] / 2, zero, zero, zero, size[2] / 2)


def box_transform(box: Column, m: Column) -> Column:
    """A 12-number box under a column-major 4x4."""
    out = []
    for k in range(4):
        v = [F.get(box, F.lit(3 * k + i)) for i in range(3)]
        for row in range(3):
            cell = F.get(m, F.lit(row)) * v[0] + F.get(m, F.lit(4 + row)) * v[1] + F.get(m, F.lit(8 + row)) * v[2]
            out.append(cell + F.get(m, F.lit(12 + row)) if k == 0 else cell)
    return F.array(*out)


def mesh_footprint(lat: Column, lon: Column, width: Column, depth: Column, east: Column, north: Column) -> Column:
    """``struct<west,south,east,north>`` in degrees of a mesh of a size, its centre shifted by metres; null if anything is no number."""
    la, lo, w, d, e, n = (c.try_cast("double") for c in (lat, lon, width, depth, east, north))
    e, n = F.coalesce(e, F.lit(0.0)), F.coalesce(n, F.lit(0.0))
    per_lon = METRES_PER_DEGREE * F.cos(F.radians(la))
    ok = la.isNotNull() & lo.isNotNull() & (w > 0) & (d > 0) & (F.abs(per_lon) > 1e-9)
    clo, cla = lo + F.try_divide(e, per_lon), la + n / METRES_PER_DEGREE
    hw, hd = F.try_divide(w, per_lon) / 2, d / METRES_PER_DEGREE / 2
    return F.when(ok, F.struct((clo - hw).alias("west"), (cla - hd).alias("south"), (clo + hw).alias("east"), (cla + hd).alias("north")))


def local_frame(x: Column, y: Column, z: Column, anchor: tuple[Column, Column, Column]) -> Column:
    """Preview frame: the anchor's up turned to +Z, then the fixed turn by Euler angles (-90, 0, -90) degrees."""
    n = F.sqrt(anchor[0] * anchor[0] + anchor[1] * anchor[1] + anchor[2] * anchor[2])
    u = [c / n for c in anchor]
    d = [a - b for a, b in zip((x, y, z), anchor)]
    # Shortest turn from u to +Z about u x Z = (uy, -ux, 0).
    k = F.try_divide(F.lit(1.0), 1 + u[2])
    t = [
        (1 - u[0] * u[0] * k) * d[0] - u[0] * u[1] * k * d[1] - u[0] * d[2],
        -u[0] * u[1] * k * d[0] + (1 - u[1] * u[1] * k) * d[1] - u[1] * d[2],
        u[0] * d[0] + u[1] * d[1] + u[2] * d[2],
    ]
    # Euler XYZ of (-90, 0, -90): Rx(-90) Rz(-90).
    return F.struct(t[1].alias("x"), t[2].alias("y"), t[0].alias("z"))


def extent_to_local(ref: tuple[float, float, float] | None, extent: list[float] | None, projection: str | int | None) -> list[float] | None:
    """[min x, min y, max x, max y] of a projected extent in the frame at ``ref``; None if anything is missing.

    One extent per survey: plain numbers. Projections: lon/lat (4326), Web Mercator (3857), UTM zones (326zz, 327zz).
    """
    if ref is None or not extent or projection is None:
        return None
    code = int(str(projection).rpartition(":")[2])
    lat0, lon0, alt0 = ref
    if len(extent) == 6:
        extent = [extent[0], extent[1], extent[3], extent[4]]
    frame = project(lat0, lon0, code)
    # The projection of a small move east and north is the frame's linear part.
    m = np.array([np.subtract(project(*lla, code), frame) for lla in (_moved(ref, 1, 0), _moved(ref, 0, 1))]).T
    corners = [(extent[i], extent[j]) for i in (0, 2) for j in (1, 3)]
    local = np.array([np.linalg.solve(m, np.subtract(c, frame)) for c in corners])
    return [*local.min(0).tolist(), *local.max(0).tolist()]


def _moved(ref: tuple[float, float, float], east: float, north: float) -> tuple[float, float]:
    lat, lon = math.radians(ref[0]), math.radians(ref[1])
    e2 = 1 - (B / A) ** 2
    w = math.sqrt(1 - e2 * math.sin(lat) ** 2)
    return ref[0] + math.degrees(north / (A * (1 - e2) / w**3 + ref[2])), ref[1] + math.degrees(east / ((A / w + ref[2]) * math.cos(lat)))


def project(lat: float, lon: float, code: int) -> tuple[float, float]:
    """Easting and northing of a place."""
    if code == 4326:
        return lon, lat
    if code == 3857:
        return A * math.radians(lon), A * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        zone, south = code % 100, code >= 32700
        e2, k0 = 1 - (B / A) ** 2, 0.9996
        ep, la, d = e2 / (1 - e2), math.radians(lat), math.radians(lon - (6 * zone - 183))
        n, t, c, a = A / math.sqrt(1 - e2 * math.sin(la) ** 2), math.tan(la) ** 2, ep * math.cos(la) ** 2, math.cos(la) * d
        m = A * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * la - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * la) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * la) - 35 * e2**3 / 3072 * math.sin(6 * la))
        x = k0 * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a**5 / 120) + 500_000
        y = k0 * (m + n * math.tan(la) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a**6 / 720))
        return x, y + (10_000_000 if south else 0)
    raise ValueError(f"projection {code} isn't supported")
