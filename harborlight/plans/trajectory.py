"""Vessels predicted to enter a cable zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions import geo
from harborlight.functions.alerts import or_unknown, to_alerts
from harborlight.operators.once import once
from harborlight.operators.throttle import throttle
from harborlight.operators.zones import CELL_DEGREES, in_cell, with_edges, zone_cells
from harborlight.plans.cable import zones_of_type

# Fixed values.
COOLDOWN_S = 1800


def _box_cells(box: Column, size: float) -> tuple[Column, Column]:
    def span(low: str, high: str) -> Column:
        return F.sequence(F.floor(box[low] / size).cast("int"), F.floor(box[high] / size).cast("int"))

    return span("min_lat", "max_lat"), span("min_lon", "max_lon")


def _reach_box(lat: Column, lon: Column, nm: Column) -> Column:
    """Box around every point within `nm`; one that comes near a pole takes in all longitudes."""
    north, south = F.least(lat + nm / 60, F.lit(90.0)), F.greatest(lat - nm / 60, F.lit(-90.0))
    # Meridians are closest at the latitude farthest from the equator.
    farthest = F.greatest(F.abs(north), F.abs(south))
    dlon = F.when(farthest > 89, 360.0).otherwise(F.least(F.lit(360.0), nm / 60 * 1.05 / F.cos(F.radians(farthest))))
    return F.struct(
        south.alias("min_lat"), (lon - dlon).alias("min_lon"), north.alias("max_lat"), (lon + dlon).alias("max_lon")
    )


def path_box(path: Column) -> Column:
    lats, lons = F.transform(path, lambda p: p["lat"]), F.transform(path, lambda p: p["lon"])
    return F.struct(
        F.array_min(lats).alias("min_lat"),
        F.array_min(lons).alias("min_lon"),
        F.array_max(lats).alias("max_lat"),
        F.array_max(lons).alias("max_lon"),
    )


def _touching(a: Column, b: Column) -> Column:
    return (
        (a["min_lat"] <= b["max_lat"]) & (a["max_lat"] >= b["min_lat"])
        & (a["min_lon"] <= b["max_lon"]) & (a["max_lon"] >= b["min_lon"])
    )


def first_hit(path: Column, box: Column, edges: Column) -> Column:
    """Where the path first meets an edge: struct(i, hit) of its first segment that does, hit as by segment_hit; else null.

    `box` is the path's box; edges outside it are dropped before any intersection is worked out.
    """
    near = F.filter(
        edges,
        lambda e: (F.least(e["x1"], e["x2"]) <= box["max_lon"]) & (F.greatest(e["x1"], e["x2"]) >= box["min_lon"])
        & (F.least(e["y1"], e["y2"]) <= box["max_lat"]) & (F.greatest(e["y1"], e["y2"]) >= box["min_lat"]),
    )
    segments = F.transform(
        F.sequence(F.lit(1), F.size(path) - 1),
        lambda i: F.struct(i.alias("i"), F.element_at(path, i).alias("p"), F.element_at(path, i + 1).alias("q")),
    )

    def nearest(s: Column, candidates: Column) -> Column:
        p, q = s["p"], s["q"]
        hit = F.array_min(
            F.transform(
                candidates,
                lambda e: geo.segment_hit(p["lon"], p["lat"], q["lon"], q["lat"], e["x1"], e["y1"], e["x2"], e["y2"]),
            )
        )
        return F.struct(s["i"].alias("i"), hit.alias("hit"))

    def along(candidates: Column) -> Column:
        hits = F.transform(segments, lambda s: nearest(s, candidates))
        return F.when(F.size(candidates) > 0, F.get(F.filter(hits, lambda h: h["hit"].isNotNull()), F.lit(0)))

    return geo.let(near, along)


def _meeting(box: Column, other: Column) -> Column:
    """What two boxes share."""
    lows, highs = ("min_lat", "min_lon"), ("max_lat", "max_lon")
    return F.struct(
        *[F.greatest(box[c], other[c]).alias(c) for c in lows], *[F.least(box[c], other[c]).alias(c) for c in highs]
    )


def _near_zones(positions: DataFrame, targets: DataFrame, reach: Column, size: float) -> DataFrame:
    """(report, zone) whose boxes touch, the report's taken as far as it can get; each pair once.

    The reach is cut to the box around all zones, so a report with any speed is copied to no more cells than the zones
    lie among. A pair that shares several cells is taken in the lowest shared one only, so no distinct is needed.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    lows, highs = ("min_lat", "min_lon"), ("max_lat", "max_lon")
    around = targets.agg(F.struct(
        *[F.min(f"bbox.{c}").alias(c) for c in lows], *[F.max(f"bbox.{c}").alias(c) for c in highs]
    ).alias("box")).scalar()
    moving = (
        positions.where(lat.between(-90, 90) & lon.between(-180, 180))
        .withColumn("_reach", _reach_box(lat, lon, reach))
        .withColumn("_around", around)
        .where(_touching(F.col("_reach"), F.col("_around")))
        .withColumn("_reach", _meeting(F.col("_reach"), F.col("_around")))
        .drop("_around")
    )
    vlats, vlons = _box_cells(F.col("_reach"), size)
    zlats, zlons = _box_cells(F.col("bbox"), size)
    vessels = moving.withColumn("_cell_lat", F.explode(vlats)).withColumn("_cell_lon", F.explode(vlons))
    cells = targets.withColumn("_cell_lat", F.explode(zlats)).withColumn("_cell_lon", F.explode(zlons))
    lowest = (
        F.col("_cell_lat") == F.floor(F.greatest(F.col("_reach.min_lat"), F.col("bbox.min_lat")) / size)
    ) & (F.col("_cell_lon") == F.floor(F.greatest(F.col("_reach.min_lon"), F.col("bbox.min_lon")) / size))
    near = vessels.join(cells, ["_cell_lat", "_cell_lon"]).where(lowest & _touching(F.col("_reach"), F.col("bbox")))
    return near.drop("_reach", "_cell_lat", "_cell_lon")


def path_zone_hits(
    positions: DataFrame, zones: DataFrame, minutes: int = 45, step: int = 5, size: float = CELL_DEGREES
) -> DataFrame:
    """(report, cable zone) whose predicted path meets the zone from outside, with the entry point.

    Vessels and zones first meet by their boxes; only then is the path worked out, and only if it comes to the zone's
    box does it meet the zone's cells, each with the edges in it. The first of the hits in all cells is the entry.
    Zones are told apart by zone_id.
    """
    knots = F.col("speed_over_ground")
    targets = with_edges(zones_of_type(zones)).select("zone_id", "zone_name", "bbox")
    cells = zone_cells(zones_of_type(zones), size).select("zone_id", "_cell_lat", "_cell_lon", "_whole", "_ref", "edges")
    headed = positions.withColumn("course", F.coalesce(F.col("course_over_ground"), F.col("heading"))).where("course is not null")
    near = _near_zones(headed, targets, F.lit(minutes / 60.0 * 1.01) * knots, size)
    ahead = once(near, "_path", geo.path_points("latitude", "longitude", "course", "speed_over_ground", minutes, step))
    boxed = once(ahead, "_box", path_box(F.col("_path"))).where(_touching(F.col("_box"), F.col("bbox")))
    cell_lat, cell_lon = geo.grid_cell("latitude", "longitude", size)
    inside = F.col("_whole") | (geo.in_bbox("latitude", "longitude", F.col("bbox")) & in_cell("latitude", "longitude", size))
    place = ["zone_id", "_cell_lat", "_cell_lon"]
    outside = (
        boxed.withColumn("_cell_lat", cell_lat).withColumn("_cell_lon", cell_lon)
        .join(cells, place, "left")
        .where(~F.coalesce(inside, F.lit(False)))
        .drop("_cell_lat", "_cell_lon", "_whole", "_ref", "edges")
    )
    out = [*positions.columns, "course", "zone_id", "zone_name"]
    if positions.isStreaming:
        # Hits of several cells need an aggregate, and that would hold rows back until the watermark.
        met = outside.join(with_edges(zones_of_type(zones)).select("zone_id", "edges"), "zone_id")
    else:
        lats, lons = _box_cells(_meeting(F.col("_box"), F.col("bbox")), size)
        spread = outside.withColumn("_cell_lat", F.explode(lats)).withColumn("_cell_lon", F.explode(lons))
        met = spread.join(cells.where(~F.col("_whole")), place)
    found = once(met, "_hit", first_hit(F.col("_path"), F.col("_box"), F.col("edges")), keep_null=False)
    if not positions.isStreaming:
        first = F.min_by(F.struct(*out, "_hit"), F.struct("_hit.i", "_hit.hit")).alias("r")
        found = found.groupBy("mmsi", "t_s", "row_id", "zone_id").agg(first).select("r.*")
    return found.select(*out, F.col("_hit.hit.y").alias("entry_lat"), F.col("_hit.hit.x").alias("entry_lon"))


def trajectory_candidates(
    positions: DataFrame, zones: DataFrame, minutes: int = 45, step: int = 5, min_kts: float = 3.0
) -> DataFrame:
    speed = F.col("speed_over_ground")
    hits = path_zone_hits(positions.where(speed >= min_kts), zones, minutes, step)
    eta = geo.haversine_nm("latitude", "longitude", "entry_lat", "entry_lon") / speed * 60
    return hits.withColumn("eta_minutes", eta).where((F.col("eta_minutes") > 1) & (F.col("eta_minutes") <= minutes))


def trajectory_events(positions: DataFrame, zones: DataFrame, **limits) -> DataFrame:
    eta = F.col("eta_minutes")
    kept = throttle(trajectory_candidates(positions, zones, **limits), ["mmsi", "zone_id"], COOLDOWN_S)
    return kept.withColumn(
        "severity", F.when(eta < 15, "HIGH").when(eta < 30, "MEDIUM").otherwise("LOW")
    ).withColumn(
        "title", F.format_string("PREDICTIVE: Vessel approaching %s in ~%.0f min", F.col("zone_name"), eta)
    )


def detect_trajectory(positions: DataFrame, zones: DataFrame, **limits) -> DataFrame:
    text = F.format_string(
        "Vessel %s (MMSI: %s) is on course to enter %s cable zone. Current speed: %.1f kts, heading: %.0f°. "
        "Predicted zone entry at (%.4f, %.4f) in approximately %.0f minutes.",
        or_unknown("ship_name"), F.col("mmsi"), F.col("zone_name"), F.col("speed_over_ground"), F.col("course"),
        F.col("entry_lat"), F.col("entry_lon"), F.col("eta_minutes"),
    )
    return to_alerts(
        trajectory_events(positions, zones, **limits),
        "TRAJECTORY_PREDICTION",
        text,
        {
            "cable_name": "zone_name",
            "zone_id": "zone_id",
            "vessel_speed": "speed_over_ground",
            "vessel_heading": "course",
            "predicted_entry_lat": "entry_lat",
            "predicted_entry_lon": "entry_lon",
            "time_to_entry_minutes": F.floor(F.col("eta_minutes") + 0.5),
            "prediction_type": F.lit("TRAJECTORY_INTERSECTION"),
        },
        subject=F.col("zone_id"),
    )
