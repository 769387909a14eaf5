"""Which vessels were near each other: an as-of join in space and time.

A report sees, for every other vessel, that vessel's latest report if it is not stale. Each
report is therefore valid from its own time until the vessel's next report or until it turns
stale. The join keys are a grid cell about the size of the search radius and a short time
bucket: the valid report is copied to the cells its search box touches and the buckets it is
valid in, the looking report stays in its own cell. Busy waters are spread over the buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions import geo
from harborlight.operators.history import following, running_sum, with_history

BUCKET_SECONDS = 150


def with_validity(positions: DataFrame) -> DataFrame:
    """Add `seq` (report number of the vessel), `next_t` and `next_row` (the vessel's next report)."""
    rows = with_history(
        positions,
        following("_next", "t_s", "row_id"),
        running_sum("seq", F.lit(1).cast("long")),
    )
    return rows.select(
        *positions.columns, "seq", F.col("_next.t_s").alias("next_t"), F.col("_next.row_id").alias("next_row")
    )


def buckets(stale_s: int, bucket_s: int = BUCKET_SECONDS) -> Column:
    """The time buckets a report with validity columns is valid in."""
    until = F.least(F.col("next_t"), F.col("t_s") + stale_s)
    return F.sequence(F.floor(F.col("t_s") / bucket_s).cast("long"), F.floor(until / bucket_s).cast("long"))


def bucket_of(t: Column, bucket_s: int = BUCKET_SECONDS) -> Column:
    return F.floor(t / bucket_s).cast("long")


def valid_at(prefix: str, t: Column, row: Column, stale_s: int) -> Column:
    """The report in the `prefix` columns is the latest of its vessel at (t, row) and not stale."""
    own_t, own_row = F.col(f"{prefix}t_s"), F.col(f"{prefix}row_id")
    next_t, next_row = F.col(f"{prefix}next_t"), F.col(f"{prefix}next_row")
    before = (own_t < t) | ((own_t == t) & (own_row < row))
    not_replaced = next_t.isNull() | (next_t > t) | ((next_t == t) & (next_row > row))
    return before & not_replaced & (t - own_t < stale_s)


def prefixed(df: DataFrame, prefix: str) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in df.columns]


def _span(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))


def _cell_size(radius_nm: float) -> float:
    """Two radii of latitude, rounded so that whole cells go round the globe."""
    return 360.0 / math.floor(360.0 / (2 * radius_nm / 60.0))


def neighbours(looking: DataFrame, seen: DataFrame, radius_nm: float, stale_s: int = 600) -> DataFrame:
    """Report of `looking` with the valid report of another vessel (columns `o_...`) within `radius_nm`.

    `seen` has the validity columns and is filtered as the caller likes. Adds `distance_nm`.
    """
    size = _cell_size(radius_nm)
    around = round(360.0 / size)
    lat, lon = F.col("latitude"), F.col("longitude")
    # A little wider than the circle; near the poles the box takes all longitudes.
    dlat = radius_nm / 60.0 * 1.001
    dlon = F.least(F.lit(180.0), F.lit(dlat * 1.05) / F.greatest(F.cos(F.radians(F.abs(lat) + dlat)), F.lit(1e-6)))
    usable = lat.between(-90, 90) & lon.between(-180, 180)
    lons = F.array_distinct(F.transform(_span(lon - dlon, lon + dlon, size), lambda i: F.pmod(i, F.lit(around))))
    right = (
        seen.where(usable)
        .select(
            *prefixed(seen, "o_"),
            _span(lat - dlat, lat + dlat, size).alias("_lats"),
            lons.alias("_lons"),
            buckets(stale_s).alias("_times"),
        )
        .withColumn("_cell_lat", F.explode("_lats"))
        .withColumn("_cell_lon", F.explode("_lons"))
        .withColumn("_bucket", F.explode("_times"))
        .drop("_lats", "_lons", "_times")
    )
    cell_lat, cell_lon = geo.grid_cell(lat, lon, size)
    left = (
        looking.where(usable)
        .withColumn("_cell_lat", cell_lat)
        .withColumn("_cell_lon", F.pmod(cell_lon, F.lit(around)))
        .withColumn("_bucket", bucket_of(F.col("t_s")))
    )
    return (
        left.join(right, ["_cell_lat", "_cell_lon", "_bucket"])
        # Cheap tests first; the distance is only worked out for what they leave.
        .where(F.abs(lat - F.col("o_latitude")) <= dlat)
        .where(valid_at("o_", F.col("t_s"), F.col("row_id"), stale_s))
        .where(F.col("mmsi") != F.col("o_mmsi"))
        .withColumn("distance_nm", geo.haversine_nm(lat, lon, "o_latitude", "o_longitude"))
        .where(F.col("distance_nm") <= radius_nm)
        .drop("_cell_lat", "_cell_lon", "_bucket")
    )
