"""Vessels that stay within a small circle. Not part of the standard pipeline."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from harborlight.functions import geo
from harborlight.functions.alerts import or_unknown, to_alerts
from harborlight.operators.throttle import throttle

# Fixed values.
COOLDOWN_S = 3600
MIN_POINTS = 3
SPREAD_BUCKET_S = 600
#: Reports whose hull is worked out once.
BLOCK = 256
FRAME = ["t_s", "latitude", "longitude", "speed_over_ground"]


def _possible(positions: DataFrame, radius_nm: float, history_s: int) -> DataFrame:
    """(mmsi, bucket) in which a report can loiter: the whole buckets that every frame ending
    there contains do not reach further than the circle's diameter.

    One row per vessel and ten minutes, from a map-side combined aggregate.
    """
    bucket = F.floor(F.col("t_s") / SPREAD_BUCKET_S)
    extent = positions.groupBy("mmsi", bucket.alias("_bucket")).agg(
        F.min("latitude").alias("_south"),
        F.max("latitude").alias("_north"),
        F.min("longitude").alias("_west"),
        F.max("longitude").alias("_east"),
    )
    whole = history_s // SPREAD_BUCKET_S - 1
    frame = Window.partitionBy("mmsi").orderBy("_bucket").rangeBetween(-whole, -1)
    south, north = F.min("_south").over(frame), F.max("_north").over(frame)
    west, east = F.min("_west").over(frame), F.max("_east").over(frame)
    # Narrowest parallel of the range, so that the width is not overstated.
    width = (east - west) * 60 * F.cos(F.radians(F.greatest(F.abs(south), F.abs(north))))
    # Longitudes that seem to go round the globe may just cross its seam.
    reach = F.greatest((north - south) * 60, F.when(east - west < 180, width).otherwise(0.0))
    near = F.col("_reach").isNull() | (F.col("_reach") <= 2 * radius_nm * 1.01)
    return extent.withColumn("_reach", reach).where(near).select("mmsi", "_bucket")


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (n, 2), by Andrew's monotone chain."""
    points = np.unique(points, axis=0).tolist()
    if len(points) < 3:
        return np.array(points)

    def chain(ordered: list) -> list:
        out = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def nm_from(lat: float, lon: float, points: np.ndarray) -> np.ndarray:
    """Great-circle distances of points (latitude, longitude)."""
    half_lat, half_lon = np.radians(points[:, 0] - lat) / 2, np.radians(points[:, 1] - lon) / 2
    a = np.sin(half_lat) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(points[:, 0])) * np.sin(half_lon) ** 2
    return 2 * geo.EARTH_RADIUS_NM * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0.0, 1 - a)))


class Frames:
    """Measures over the last `history_s` seconds of each report of one vessel, reports in order.

    Sums come from running totals. The farthest of a frame's points from their centre is a corner of a convex hull (a
    circle as small as these is convex in degrees, but at the poles), so a block of reports is asked for its corners only, and only
    the ends of a frame point by point. Nothing is kept per report but a few numbers.
    """

    def __init__(self, t: np.ndarray, lat: np.ndarray, lon: np.ndarray, speed: np.ndarray, history_s: int):
        self.t, self.points, self.hulls = t, np.column_stack((lat, lon)), {}
        self.first = np.searchsorted(t, t - history_s)
        # Running totals from a near origin keep the digits of the place.
        self.origin = self.points[0] if len(t) else np.zeros(2)
        self.places = np.vstack(([0.0, 0.0], np.cumsum(self.points - self.origin, axis=0)))
        known = ~np.isnan(speed)
        self.speeds = np.concatenate(([0.0], np.cumsum(np.where(known, speed, 0.0))))
        self.known = np.concatenate(([0], np.cumsum(known)))

    def _corners(self, block: int) -> np.ndarray:
        if block not in self.hulls:
            self.hulls[block] = hull(self.points[block * BLOCK : (block + 1) * BLOCK])
        return self.hulls[block]

    def measure(self, i: int, radius_nm: float, minutes: int) -> tuple | None:
        """(radius, minutes, points, mean speed, latitude, longitude) of the frame that ends with report i, if it loiters."""
        first, n = int(self.first[i]), i + 1 - int(self.first[i])
        lasted = int(self.t[i] - self.t[first]) // 60
        if n < MIN_POINTS or lasted < minutes:
            return None
        centre = self.origin + (self.places[i + 1] - self.places[first]) / n
        low, high = -(-first // BLOCK), (i + 1) // BLOCK
        if low < high:
            ends = [self.points[first : low * BLOCK], self.points[high * BLOCK : i + 1]]
            asked = np.concatenate([*ends, *(self._corners(b) for b in range(low, high))])
        else:
            asked = self.points[first : i + 1]
        radius = float(nm_from(centre[0], centre[1], asked).max())
        if not radius <= radius_nm:
            return None
        spoken = int(self.known[i + 1] - self.known[first])
        speed = float(self.speeds[i + 1] - self.speeds[first]) / spoken if spoken else 0.0
        return radius, lasted, n, speed, float(centre[0]), float(centre[1])


MEASURES = [
    ("loiter_radius_nm", pa.float64()), ("loiter_minutes", pa.int64()), ("position_count", pa.int64()), ("average_speed", pa.float64()),
    ("center_lat", pa.float64()), ("center_lon", pa.float64()),
]
MEASURE_DDL = (
    "loiter_radius_nm double, loiter_minutes long, position_count long, average_speed double, center_lat double, center_lon double"
)


def loitering_candidates(
    positions: DataFrame, radius_nm: float = 0.5, minutes: int = 45, history_min: int = 120
) -> DataFrame:
    """Reports whose last `history_min` minutes stay in the circle, before the cooldown.

    The time frame is as long as a slice, so a report is copied to the next slice only and each slice is measured on its
    own. Vessels that move, and MMSIs several vessels share, fall out before that; what is left is one ship's own
    reporting rate. Reports without a place are no history.
    """
    history_s = history_min * 60
    own = F.floor(F.col("t_s") / history_s)
    possible = _possible(positions, radius_nm, history_s)
    slices = possible.select(
        "mmsi", F.floor(F.col("_bucket") * SPREAD_BUCKET_S / history_s).alias("_slice")
    ).distinct()
    placed = positions.where("latitude is not null and longitude is not null")
    copied = placed.withColumn("_own", own).withColumn("_slice", F.explode(F.array(own, own + 1)))

    def measure(group: pa.Table) -> pa.Table:
        group = group.sort_by([("t_s", "ascending"), ("row_id", "ascending")]).combine_chunks()
        frames = Frames(*(group[c].cast(pa.float64()).to_numpy() if c != "t_s" else group[c].to_numpy() for c in FRAME), history_s)
        asked = np.flatnonzero(pc.equal(group["_own"], group["_slice"]).to_numpy())
        found = [(int(i), m) for i in asked for m in [frames.measure(int(i), radius_nm, minutes)] if m]
        out = group.select(columns).take(pa.array([i for i, _ in found], pa.int64()))
        for k, (name, kind) in enumerate(MEASURES):
            out = out.append_column(name, pa.array([m[k] for _, m in found], kind))
        return out

    columns = positions.columns
    schema = StructType([*positions.schema.fields, *_parse_datatype_string(MEASURE_DDL).fields])
    return copied.join(slices, ["mmsi", "_slice"], "left_semi").groupBy("mmsi", "_slice").applyInArrow(measure, schema)


def loitering_events(positions: DataFrame, **limits) -> DataFrame:
    return graded(throttle(loitering_candidates(positions, **limits), ["mmsi"], COOLDOWN_S, strict=True))


def graded(kept: DataFrame) -> DataFrame:
    """Severity and title of reports that alert."""
    long = F.col("loiter_minutes")
    severity = F.when(long > 360, "CRITICAL").when(long > 120, "HIGH").otherwise("MEDIUM")
    return kept.withColumn("severity", severity).withColumn(
        "title", F.concat(F.col("severity"), F.lit(": Vessel Loitering Detected"))
    )


def detect_loitering(positions: DataFrame, **limits) -> DataFrame:
    text = F.format_string(
        "Vessel %s (MMSI: %s) has been loitering at position (%.4f, %.4f) for %d minutes within a %.2f NM radius. "
        "Average speed: %.1f kts.",
        or_unknown("ship_name"), F.col("mmsi"), F.col("center_lat"), F.col("center_lon"), F.col("loiter_minutes"),
        F.col("loiter_radius_nm"), F.col("average_speed"),
    )
    return to_alerts(
        loitering_events(positions, **limits),
        "LOITERING",
        text,
        {
            "loiter_duration_minutes": "loiter_minutes",
            "loiter_radius_nm": "loiter_radius_nm",
            "center_lat": "center_lat",
            "center_lon": "center_lon",
            "average_speed": "average_speed",
            "position_count": "position_count",
        },
    )
