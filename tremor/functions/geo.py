"""Distances, areas, polygons. Angles are degrees, lengths km; rings are [(lat, lon), ...]."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere of distances (km), and the WGS84 ellipsoid of areas (m, flattening).
EARTH_RADIUS, WGS84_A, WGS84_F = 6378.1, 6378137.0, 1 / 298.257223563

#: Wells-Coppersmith regressions log10(y) = a * m + b of (surface length, subsurface length, width, area, slip).
RUPTURE = {
    "strike_slip": ((0.74, -3.55), (0.62, -2.57), (0.27, -0.76), (0.9, -3.42), (0.9, -6.32)),
    "reverse": ((0.63, -2.86), (0.58, -2.42), (0.41, -1.61), (0.98, -3.99), (0.08, -0.74)),
    "normal": ((0.5, -2.01), (0.5, -1.88), (0.35, -1.14), (0.82, -2.87), (0.63, -4.45)),
    "oblique": ((0.69, -3.22), (0.59, -2.44), (0.32, -1.01), (0.91, -3.49), (0.69, -4.80)),
}
RUPTURE_FIELDS = ("srl", "ssrl", "rw", "ra", "ad")


def rupture(magnitude: Column, field: str, fault: str = "oblique") -> Column:
    a, b = RUPTURE[fault][RUPTURE_FIELDS.index(field)]
    return F.pow(F.lit(10.0), F.lit(a) * magnitude + F.lit(b))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS, cosines: tuple[Column, Column] | None = None) -> Column:
    """Great-circle distance; the root's argument is held in [0, 1]. ``cosines`` are those of the latitudes where they are at hand."""
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), F.lit(2.0))
    a, b = cosines or (F.cos(F.radians(lat1)), F.cos(F.radians(lat2)))
    h = half(lat1 - lat2) + a * b * half(lon1 - lon2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def km_per_degree(lat: Column, radius: float = EARTH_RADIUS) -> tuple[Column, Column]:
    """(km of a degree of latitude, of longitude) at a latitude; the latter is the distance over one degree."""
    lon = F.lit(2 * radius) * F.asin(F.abs(F.cos(F.radians(lat))) * F.lit(math.sin(math.radians(0.5))))
    return F.lit(2 * math.pi * radius / 360), lon


def wrapped(lon: Column) -> Column:
    """Longitude of an event west of the date line, moved past 180."""
    return F.when(lon < 0, lon + 360).otherwise(lon)


def _edges(ring: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(lat 1, lon 1, lat 2, lon 2) of the edges that are not points."""
    return [(*p, *q) for p, q in zip(ring, [*ring[1:], ring[0]]) if tuple(p) != tuple(q)]


def _held_edges(ring: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(e, ("y1", "x1", "y2", "x2"))]) for e in _edges(ring)])


def at_point(lat: Column, lon: Column, f) -> Column:
    """``f`` of the point's columns (y, x), which are computed once however often ``f`` refers to them."""
    return F.get(F.transform(F.array(F.struct(lat.cast("double").alias("y"), lon.cast("double").alias("x"))), lambda p: f(p.y, p.x)), F.lit(0))


def in_box(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point is in a ring's box; on stored columns, scans prune by it."""
    lats, lons = [p[0] for p in ring], [p[1] for p in ring]
    return lat.between(min(lats), max(lats)) & lon.between(min(lons), max(lons))


def in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]], boundary: bool | None = True) -> Column:
    """Whether a point is in a ring, by crossings; points on the boundary count if ``boundary``, and with None as their crossings say.

    A fold over the ring's edges, so the plan does not grow with the ring and the point is
    computed once. Null where a coordinate is.
    """

    def inside(y: Column, x: Column) -> Column:
        def step(s: Column, e: Column) -> Column:
            side = (x - e.x1) * (e.y2 - e.y1) - (y - e.y1) * (e.x2 - e.x1)
            on = (side == 0) & y.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2)) & x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2))
            over = ((e.y1 > y) != (e.y2 > y)) & (x < e.x1 + (y - e.y1) * ((e.x2 - e.x1) / (e.y2 - e.y1)))
            return F.struct((s.odd != over).alias("odd"), (s.on | on).alias("on"))

        start = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("on"))
        found = F.aggregate(_held_edges(ring), start, step, lambda s: s.odd if boundary is None else (s.odd | s.on) if boundary else (s.odd & ~s.on))
        return F.when(in_box(y, x, ring), found).when(y.isNotNull() & x.isNotNull(), F.lit(False))

    return at_point(lat, lon, inside)


def boundary_distance(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """km from a point to the nearest place on a ring's edges, in the plane of the point's degree lengths."""

    def nearest(y: Column, x: Column) -> Column:
        per_lat, per_lon = km_per_degree(y)

        def step(best: Column, e: Column) -> Column:
            ax, ay, bx, by = (e.x1 - x) * per_lon, (e.y1 - y) * per_lat, (e.x2 - x) * per_lon, (e.y2 - y) * per_lat
            dx, dy = bx - ax, by - ay
            share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
            px, py = ax + share * dx, ay + share * dy
            return F.least(best, F.sqrt(px * px + py * py))

        return F.aggregate(_held_edges(ring), F.lit(math.inf), step)

    return at_point(lat, lon, nearest)


def contained(ring: list[tuple[float, float]], lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """``contains`` of arrays."""
    lat, lon = np.asarray(lat, float), np.asarray(lon, float)
    odd = np.zeros(np.broadcast(lat, lon).shape, bool)
    for y1, x1, y2, x2 in _edges(ring):
        if y1 != y2:
            odd ^= ((y1 > lat) != (y2 > lat)) & (lon < x1 + (lat - y1) * ((x2 - x1) / (y2 - y1)))
    return odd


def contains(ring: list[tuple[float, float]], lat: float, lon: float) -> bool:
    """The same crossings for one point, boundary left out."""
    inside = False
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]]):
        if (y1 > lat) != (y2 > lat) and lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


def _shoelace(points: list[tuple[float, float]]) -> float:
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]]))) / 2


def _q(phi: float, e2: float) -> float:
    e, s = math.sqrt(e2), math.sin(phi)
    return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))


def albers_area(ring: list[tuple[float, float]]) -> float:
    """km2 of the vertices joined by straight lines in Albers' equal-area map, standard parallels at the ring's box."""
    e2 = WGS84_F * (2 - WGS84_F)
    lo, hi = math.radians(min(p[0] for p in ring)), math.radians(max(p[0] for p in ring))
    m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    n = (m(lo) ** 2 - m(hi) ** 2) / (_q(hi, e2) - _q(lo, e2)) if hi != lo else math.sin(lo)
    if abs(n) < 1e-12:
        return _shoelace([(math.radians(lon) * WGS84_A, WGS84_A * _q(math.radians(lat), e2) / 2) for lat, lon in ring]) / 1e6
    c = m(lo) ** 2 + n * _q(lo, e2)
    points = []
    for lat, lon in ring:
        rho, theta = WGS84_A * math.sqrt(max(0.0, c - n * _q(math.radians(lat), e2))) / n, n * math.radians(lon)
        points.append((rho * math.sin(theta), -rho * math.cos(theta)))
    return _shoelace(points) / 1e6


def geodesic_area(ring: list[tuple[float, float]], steps: int = 200) -> float:
    """km2 on the ellipsoid inside edges followed along great circles of the authalic sphere."""
    e2 = WGS84_F * (2 - WGS84_F)
    q_pole = _q(math.pi / 2, e2)
    radius2 = WGS84_A**2 * q_pole / 2
    points = []
    for (lat1, lon1), (lat2, lon2) in zip(ring, [*ring[1:], ring[0]]):
        a, b = (_unit(math.asin(_q(math.radians(lat), e2) / q_pole), math.radians(lon)) for lat, lon in ((lat1, lon1), (lat2, lon2)))
        angle = math.acos(max(-1.0, min(1.0, sum(x * y for x, y in zip(a, b)))))
        for k in range(steps):
            t = k / steps
            w = (1 - t, t) if angle < 1e-12 else (math.sin((1 - t) * angle) / math.sin(angle), math.sin(t * angle) / math.sin(angle))
            x, y, z = (w[0] * p + w[1] * q for p, q in zip(a, b))
            points.append((math.atan2(y, x), z / math.sqrt(x * x + y * y + z * z)))
    total = 0.0
    for (l1, s1), (l2, s2) in zip(points, [*points[1:], points[0]]):
        total += (math.remainder(l2 - l1, 2 * math.pi)) * (s1 + s2) / 2
    return abs(total) * radius2 / 1e6


def _unit(lat: float, lon: float) -> tuple[float, float, float]:
    return math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)


def globe_area(radius: float = EARTH_RADIUS) -> float:
    return 4 * math.pi * radius**2


def utm_zone(lat: float, lon: float) -> int:
    """EPSG code of the WGS84 zone of a point."""
    return (32600 if lat >= 0 else 32700) + int((lon + 180) // 6) % 60 + 1


def utm_zone_of(lat: Column, lon: Column) -> Column:
    """``utm_zone`` of columns."""
    return (F.when(lat >= 0, 32600).otherwise(32700) + F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def transverse_mercator(lat: np.ndarray, lon: np.ndarray, zone: int) -> tuple[np.ndarray, np.ndarray]:
    """(easting, northing) in metres in a UTM zone (EPSG code), by Krueger's series."""
    south, middle = zone >= 32700, math.radians((zone % 100) * 6 - 183)
    n, big_a, alpha, _ = _krueger()
    e = math.sqrt(WGS84_F * (2 - WGS84_F))
    phi, dl = np.radians(lat), np.radians(lon) - middle
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(dl)), np.arcsinh(np.sin(dl) / np.hypot(t, np.cos(dl)))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return 500000 + 0.9996 * big_a * x, (1e7 if south else 0.0) + 0.9996 * big_a * y


def from_transverse_mercator(x: np.ndarray, y: np.ndarray, zone: int) -> tuple[np.ndarray, np.ndarray]:
    """(lat, lon) of UTM coordinates."""
    south, middle = zone >= 32700, (zone % 100) * 6 - 183
    n, big_a, _, beta = _krueger()
    e2 = WGS84_F * (2 - WGS84_F)
    e = math.sqrt(e2)
    xi0, eta0 = (np.asarray(y, float) - (1e7 if south else 0.0)) / (0.9996 * big_a), (np.asarray(x, float) - 500000) / (0.9996 * big_a)
    xi = xi0 - sum(b * np.sin(2 * j * xi0) * np.cosh(2 * j * eta0) for j, b in enumerate(beta, 1))
    eta = eta0 - sum(b * np.cos(2 * j * xi0) * np.sinh(2 * j * eta0) for j, b in enumerate(beta, 1))
    conformal = np.sin(xi) / np.hypot(np.sinh(eta), np.cos(xi))  # tangent of the conformal latitude
    tan = conformal.copy()
    for _ in range(6):
        s = np.sinh(e * np.arctanh(e * tan / np.sqrt(1 + tan * tan)))
        now = tan * np.sqrt(1 + s * s) - s * np.sqrt(1 + tan * tan)
        tan = tan + (conformal - now) / np.sqrt(1 + now * now) * (1 + (1 - e2) * tan * tan) / ((1 - e2) * np.sqrt(1 + tan * tan))
    return np.degrees(np.arctan(tan)), middle + np.degrees(np.arctan2(np.sinh(eta), np.cos(xi)))


def _krueger() -> tuple[float, float, tuple[float, ...], tuple[float, ...]]:
    """Third flattening, radius of the rectified meridian, and Krueger's coefficients forth and back (to the fourth order)."""
    n = WGS84_F / (2 - WGS84_F)
    big_a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    # Krueger's series.
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    return n, big_a, alpha, beta


def triangles(ring: list[tuple[float, float]]) -> list[tuple[tuple[float, float], tuple[float, float], tuple[float, float]]]:
    """A simple ring cut into triangles, ear by ear."""
    points = [tuple(map(float, p)) for p, q in zip(ring, [*ring[1:], ring[0]]) if tuple(p) != tuple(q)]
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, [*points[1:], points[0]])) < 0:
        points.reverse()
    out = []
    while len(points) > 3:
        for i in range(len(points)):
            a, b, c = points[i - 1], points[i], points[(i + 1) % len(points)]
            ear = turn(a, b, c)
            inside = lambda p: turn(a, b, p) >= 0 and turn(b, c, p) >= 0 and turn(c, a, p) >= 0  # noqa: B023, E731
            if ear == 0 or (ear > 0 and not any(inside(p) for p in points if p not in (a, b, c))):
                if ear:
                    out.append((a, b, c))
                points.pop(i)
                break
        else:
            raise ValueError("the ring crosses itself")
    if len(points) == 3 and turn(*points):
        out.append(tuple(points))
    if not out:
        raise ValueError("the ring has no area")
    return out


def place_in_ring(ring: list[tuple[float, float]], pick: Column, u: Column, v: Column) -> Column:
    """A place (struct lat, lon) uniform in degrees within a ring, from three uniform numbers: a triangle by area, then a point in it."""
    cut = triangles(ring)
    areas = [abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) for a, b, c in cut]
    ends, so_far = [], 0.0
    for a in areas:
        so_far += a
        ends.append(so_far / sum(areas))
    held = F.array(*[F.struct(F.lit(e).alias("end"), *[F.lit(w).alias(n) for w, n in zip((*a, *b, *c), ("ay", "ax", "by", "bx", "cy", "cx"))]) for e, (a, b, c) in zip([*ends[:-1], 2.0], cut)])
    first = lambda t: F.get(F.filter(held, lambda x: x.end > t.pick), F.lit(0))

    def put(t: Column) -> Column:
        r = F.sqrt(t.u)
        at = lambda x, c: (1 - r) * x[f"a{c}"] + r * (1 - t.v) * x[f"b{c}"] + r * t.v * x[f"c{c}"]
        return F.get(F.transform(F.array(first(t)), lambda x: F.struct(at(x, "y").alias("lat"), at(x, "x").alias("lon"))), F.lit(0))

    return F.get(F.transform(F.array(F.struct(pick.alias("pick"), u.alias("u"), v.alias("v"))), put), F.lit(0))


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Monotone chain, counter-clockwise in (x, y) order of the tuples; collinear points are left out."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(reversed(points))


def box_of(points: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    """(lat_lo, lat_hi, lon_lo, lon_hi)."""
    return min(p[0] for p in points), max(p[0] for p in points), min(p[1] for p in points), max(p[1] for p in points)


def clipped(ring: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """The part of a convex ring in a box, side by side (Sutherland and Hodgman)."""
    for axis, bound, sign in ((0, box[0], 1), (0, box[1], -1), (1, box[2], 1), (1, box[3], -1)):
        out = []
        for p, q in zip(ring, [*ring[1:], *ring[:1]]):
            a, b = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if a >= 0:
                out.append(p)
            if a * b < 0:
                out.append(tuple(x + (y - x) * a / (a - b) for x, y in zip(p, q)))
        ring = out
    return ring


def centroid(ring: list[tuple[float, float]]) -> tuple[float, float]:
    """Of the area; of the vertices where there is none."""
    crosses = [(p[0] * q[1] - q[0] * p[1], p, q) for p, q in zip(ring, [*ring[1:], ring[0]])]
    whole = sum(c for c, _, _ in crosses)
    if not whole:
        return sum(p[0] for p in ring) / len(ring), sum(p[1] for p in ring) / len(ring)
    return tuple(sum(c * (p[k] + q[k]) for c, p, q in crosses) / (3 * whole) for k in (0, 1))


def scaled_ring(ring: list[tuple[float, float]], factor: float, box: tuple[float, float, float, float] | None = None) -> list[tuple[float, float]]:
    """A convex ring with ``factor`` times the planar area about its centroid, as far as a box (lat_lo, lat_hi, lon_lo, lon_hi) leaves room.

    What the box cuts off is made up for by scaling further, until the area is right or the
    box is full. A ring without area becomes the box.
    """
    if box is not None and _shoelace(ring) <= 0:
        return [(box[0], box[2]), (box[0], box[3]), (box[1], box[3]), (box[1], box[2])]
    lat, lon = centroid(ring)
    at = lambda s: [(lat + s * (y - lat), lon + s * (x - lon)) for y, x in ring]
    if box is None:
        return at(math.sqrt(factor))
    wanted, lo, hi = factor * _shoelace(ring), 1.0, math.sqrt(factor)
    while _shoelace(clipped(at(hi), box)) < wanted * 0.999 and hi < 1e6:
        lo, hi = hi, hi * 2
    for _ in range(60):
        middle = (lo + hi) / 2
        lo, hi = (lo, middle) if _shoelace(clipped(at(middle), box)) >= wanted else (middle, hi)
    return clipped(at(hi), box)


def expanded_ring(ring: list[tuple[float, float]], km: float) -> list[tuple[float, float]]:
    """Each vertex moved ``km`` away from the mean vertex."""
    lat, lon = sum(p[0] for p in ring) / len(ring), sum(p[1] for p in ring) / len(ring)
    per_lat = 2 * math.pi * EARTH_RADIUS / 360
    per_lon = per_lat * math.cos(math.radians(lat))
    out = []
    for y, x in ring:
        dy, dx = (y - lat) * per_lat, (x - lon) * per_lon
        d = math.hypot(dx, dy)
        out.append((y + km * dy / d / per_lat, x + km * dx / d / per_lon) if d else (y, x))
    return out


def hull_facets(points: np.ndarray) -> tuple[list[tuple[list[float], float]], float]:
    """(facets (outward normal, offset), volume) of the convex hull of points in space.

    Points are added one by one: the facets that see a new point go, and the edges between
    these and the others get facets with it.
    """
    points = np.unique(np.asarray(points, float), axis=0)
    scale = float(np.abs(points - points.mean(axis=0)).max()) if len(points) else 0.0
    eps = 1e-9 * max(scale, 1e-30)
    first = _corner(points, eps)
    middle = points[first].mean(axis=0)

    def facet(i: int, j: int, k: int) -> tuple[tuple[int, int, int], np.ndarray, float]:
        normal = np.cross(points[j] - points[i], points[k] - points[i])
        normal /= np.linalg.norm(normal)
        if normal @ (points[i] - middle) < 0:
            return (i, k, j), -normal, float(-normal @ points[i])
        return (i, j, k), normal, float(normal @ points[i])

    a, b, c, d = first
    facets = [facet(a, b, c), facet(a, b, d), facet(a, c, d), facet(b, c, d)]
    for p in range(len(points)):
        seen = [f for f in facets if f[1] @ points[p] > f[2] + eps]
        if p in first or not seen:
            continue
        edges = {(f[0][x], f[0][(x + 1) % 3]) for f in seen for x in range(3)}
        kept = [f for f in facets if not f[1] @ points[p] > f[2] + eps]
        facets = kept + [facet(i, j, p) for i, j in edges if (j, i) not in edges]
    volume = sum(abs(float(np.dot(points[i] - middle, np.cross(points[j] - middle, points[k] - middle)))) / 6 for (i, j, k), _, _ in facets)
    return [(n.tolist(), o) for _, n, o in facets], volume


def extreme_points(points: np.ndarray, directions: int = 200) -> np.ndarray:
    """Those of points in space that can be vertices of their convex hull: rows whose hull is the same, and few.

    Starts with the farthest points in ``directions`` spread over the sphere; then the farthest point beyond
    each facet joins, until none is outside. Points in a plane or on a line are reduced there.
    """
    points = np.unique(np.asarray(points, float).reshape(-1, 3), axis=0)
    if len(points) <= 4:
        return points
    scale = float(np.abs(points - points.mean(axis=0)).max())
    eps = 1e-9 * max(scale, 1e-30)
    k = np.arange(directions) + 0.5
    up, around = 1 - 2 * k / directions, math.pi * (1 + math.sqrt(5)) * k
    ways = np.stack((np.sqrt(1 - up * up) * np.cos(around), np.sqrt(1 - up * up) * np.sin(around), up), axis=1)
    kept = np.unique(points[(points @ ways.T).argmax(axis=0)], axis=0)
    while True:
        try:
            facets, _ = hull_facets(kept)
        except ValueError:  # perhaps a flat set, perhaps only its farthest points are
            try:
                kept = np.unique(np.concatenate((kept, points[_corner(points, eps)])), axis=0)
                continue
            except ValueError:
                return _extreme_in_plane(points)
        normals, offsets = np.array([n for n, _ in facets]), np.array([o for _, o in facets])
        beyond = points @ normals.T - offsets
        out = beyond.max(axis=0) > eps
        if not out.any():
            return kept
        more = np.unique(np.concatenate((kept, points[beyond[:, out].argmax(axis=0)])), axis=0)
        if len(more) == len(kept):
            return kept
        kept = more


def _extreme_in_plane(points: np.ndarray) -> np.ndarray:
    """The vertices of the hull of points that lie in a plane."""
    middle = points.mean(axis=0)
    axes = np.linalg.svd(points - middle, full_matrices=False)[2][:2]
    flat = (points - middle) @ axes.T
    at = {tuple(p): i for i, p in enumerate(flat.tolist())}
    hull = convex_hull([tuple(p) for p in flat.tolist()])
    ends = [int(flat[:, 0].argmin()), int(flat[:, 0].argmax())]
    return points[sorted({*(at[tuple(p)] for p in hull), *ends})]


def _corner(points: np.ndarray, eps: float) -> list[int]:
    """Four points that span a volume."""
    if len(points) >= 4:
        a, b = int(points[:, 0].argmin()), int(points[:, 0].argmax())
        line = points[b] - points[a]
        if np.linalg.norm(line) > eps:
            off = np.linalg.norm(np.cross(points - points[a], line / np.linalg.norm(line)), axis=1)
            c = int(off.argmax())
            if off[c] > eps:
                normal = np.cross(line, points[c] - points[a])
                high = np.abs((points - points[a]) @ (normal / np.linalg.norm(normal)))
                if high.max() > eps:
                    return [a, b, c, int(high.argmax())]
    raise ValueError("the points span no volume")
