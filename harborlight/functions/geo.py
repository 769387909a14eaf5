"""Geographic column functions. Latitude and longitude are degrees, distances as named."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_NM = 3440.065
EARTH_RADIUS_M = 6371000.0
METERS_PER_NM = 1852

# The collection area and the margin that counts as its edge.
AREA_SOUTH, AREA_NORTH, AREA_WEST, AREA_EAST = 54.0, 66.0, 9.0, 31.0
AREA_MARGIN = 0.5


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(float(value))


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def path_points(lat, lon, course, knots, minutes: int = 45, step: int = 5) -> Column:
    """The start point, then one predicted point every `step` minutes: array of struct(lat, lon)."""
    lat, lon, course, knots = map(_col, (lat, lon, course, knots))
    start = F.struct(lat.alias("lat"), lon.alias("lon"))
    # Written out rather than as a lambda over minutes, so that it runs as generated code.
    ahead = [destination(lat, lon, course, knots * (m / 60.0)) for m in range(step, minutes + 1, step)]
    return F.array(start, *ahead)


def _central_angle(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # Rounding can lift `a` a hair over 1 for antipodes.
    return 2 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def haversine_nm(lat1, lon1, lat2, lon2) -> Column:
    return F.lit(EARTH_RADIUS_NM) * _central_angle(lat1, lon1, lat2, lon2)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    return F.lit(EARTH_RADIUS_M) * _central_angle(lat1, lon1, lat2, lon2)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.cos(dlon)
    return (F.degrees(F.atan2(y, x)) + 360) % 360


def destination(lat, lon, course, nm) -> Column:
    """Point reached from (lat, lon) after `nm` on `course`: struct(lat, lon)."""
    lat, lon, course, nm = map(_col, (lat, lon, course, nm))
    angle = nm / EARTH_RADIUS_NM
    phi, theta = F.radians(lat), F.radians(course)
    sin_phi2 = F.sin(phi) * F.cos(angle) + F.cos(phi) * F.sin(angle) * F.cos(theta)
    lat2 = F.asin(sin_phi2)
    lon2 = F.radians(lon) + F.atan2(
        F.sin(theta) * F.sin(angle) * F.cos(phi), F.cos(angle) - F.sin(phi) * F.sin(lat2)
    )
    return F.struct(F.degrees(lat2).alias("lat"), F.degrees(lon2).alias("lon"))


def segment_hit(px, py, qx, qy, x1, y1, x2, y2) -> Column:
    """Where segment p-q meets segment 1-2 in the plane: struct(t, x, y), t along p-q; else null.

    Parallel segments give null: an overlap along an edge is met by the neighbouring edges.
    """
    rx, ry = qx - px, qy - py
    sx, sy = x2 - x1, y2 - y1
    denominator = F.nullif(rx * sy - ry * sx, F.lit(0.0))
    t = ((x1 - px) * sy - (y1 - py) * sx) / denominator
    u = ((x1 - px) * ry - (y1 - py) * rx) / denominator
    hit = t.between(0, 1) & u.between(0, 1)
    return F.when(hit, F.struct(t.alias("t"), (px + t * rx).alias("x"), (py + t * ry).alias("y")))


def bbox_around(lat, lon, nm) -> Column:
    lat, lon, nm = map(_col, (lat, lon, nm))
    dlat = nm / 60.0
    dlon = nm / (60.0 * F.cos(F.radians(lat)))
    return F.struct(
        (lat - dlat).alias("min_lat"),
        (lon - dlon).alias("min_lon"),
        (lat + dlat).alias("max_lat"),
        (lon + dlon).alias("max_lon"),
    )


def in_bbox(lat, lon, box: Column, buffer: float = 0.0) -> Column:
    lat, lon = _col(lat), _col(lon)
    return lat.between(box["min_lat"] - buffer, box["max_lat"] + buffer) & lon.between(
        box["min_lon"] - buffer, box["max_lon"] + buffer
    )


def in_boxes(lat, lon, boxes: Sequence[tuple[float, float, float, float]]) -> Column:
    """Any of (south, west, north, east)."""
    lat, lon = _col(lat), _col(lon)
    test = F.lit(False)
    for south, west, north, east in boxes:
        test = test | (lat.between(south, north) & lon.between(west, east))
    return test


def at_area_edge(lat, lon) -> Column:
    lat, lon = _col(lat), _col(lon)
    return (
        (lat < AREA_SOUTH + AREA_MARGIN)
        | (lat > AREA_NORTH - AREA_MARGIN)
        | (lon < AREA_WEST + AREA_MARGIN)
        | (lon > AREA_EAST - AREA_MARGIN)
    )


def grid_cell(lat, lon, size: float = 0.1) -> tuple[Column, Column]:
    return (
        F.floor(_col(lat) / size).cast("int"),
        F.floor(_col(lon) / size).cast("int"),
    )


def adjacent_cells(cell_lat: Column, cell_lon: Column) -> Column:
    """The cell and its eight neighbours: array of struct(cell_lat, cell_lon)."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return F.array(
        *[F.struct((cell_lat + a).alias("cell_lat"), (cell_lon + b).alias("cell_lon")) for a, b in steps]
    )


def course_diff(a, b) -> Column:
    gap = F.abs(_col(a) - _col(b))
    return F.when(gap > 180, 360 - gap).otherwise(gap)


def point_array(points: Sequence[tuple[float, float]]) -> Column:
    """A constant list of places as array of struct(lat, lon)."""
    return F.array(
        *[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in points]
    )




def min_distance_nm(lat, lon, points: Sequence[tuple[float, float]]) -> Column:
    lat, lon = _col(lat), _col(lon)
    distances = [haversine_nm(lat, lon, F.lit(a), F.lit(b)) for a, b in points]
    return F.least(*distances) if len(distances) > 1 else distances[0]


def near_any(lat, lon, points: Sequence[tuple[float, float]], nm: float) -> Column:
    """Some point is nearer than `nm` (strict)."""
    lat, lon = _col(lat), _col(lon)
    reach = nm / 60.0 * 1.01
    close = F.filter(point_array(points), lambda p: F.abs(p["lat"] - lat) <= reach)
    return F.exists(close, lambda p: haversine_nm(lat, lon, p["lat"], p["lon"]) < nm)


def is_open_sea(lat, lon, ports: Sequence[tuple[float, float]], nm: float) -> Column:
    return ~near_any(lat, lon, ports, nm)


def centroid(points: Column) -> Column:
    """Mean of an array of struct(lat, lon); null when empty."""
    zero = F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    total = F.aggregate(
        points, zero, lambda s, p: F.struct((s["lat"] + p["lat"]).alias("lat"), (s["lon"] + p["lon"]).alias("lon"))
    )
    n = F.size(points)
    return F.when(n > 0, F.struct((total["lat"] / n).alias("lat"), (total["lon"] / n).alias("lon")))


def box_area_nm2(min_lat, min_lon, max_lat, max_lon) -> Column:
    return haversine_nm(min_lat, min_lon, max_lat, min_lon) * haversine_nm(min_lat, min_lon, min_lat, max_lon)


def points_area_nm2(points: Column) -> Column:
    """Area of the box around an array of struct(lat, lon); 0 for fewer than two points."""
    lats = F.transform(points, lambda p: p["lat"])
    lons = F.transform(points, lambda p: p["lon"])
    area = box_area_nm2(F.array_min(lats), F.array_min(lons), F.array_max(lats), F.array_max(lons))
    return F.when(F.size(points) < 2, F.lit(0.0)).otherwise(area)


def on_edges(lat, lon, edges: Column) -> Column:
    """On one of `edges`, its ends included."""
    x, y = _col(lon), _col(lat)
    return F.exists(
        edges,
        lambda e: ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])),
    )


def point_in_edges(lat, lon, edges: Column) -> Column:
    """Strictly inside the even-odd area of `edges`, array of struct(x1, y1, x2, y2); x is longitude."""
    x, y = _col(lon), _col(lat)
    crossings = F.filter(
        edges,
        lambda e: ((e["y1"] > y) != (e["y2"] > y))
        & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]),
    )
    return (F.size(crossings) % 2 == 1) & ~on_edges(lat, lon, edges)
