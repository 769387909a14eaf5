"""Fishing patterns inside protected areas and economic zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.functions import ais, geo
from harborlight.functions.alerts import or_unknown, to_alerts
from harborlight.operators.history import previous, with_history, with_last_rows
from harborlight.operators.once import once
from harborlight.operators.zones import in_zones
from harborlight.plans.state import KEEP_POSITIONS, mean_of, turn_count

# Fixed values.
MIN_CONFIDENCE = 60
SURE_CONFIDENCE = 80
MINUTES_PER_POSITION = 3
VARIANCE_LIMIT = 2.0
TRACK = ["latitude", "longitude", "speed_over_ground", "course_over_ground"]


def fishing_analysis(
    positions: DataFrame,
    max_kts: float = 5.0,
    turns_per_h: float = 10.0,
    area_nm2: float = 100.0,
    min_pos: int = 10,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Reports whose last 20 positions look like fishing, with the measures behind it."""
    framed = with_last_rows(positions, "_last", KEEP_POSITIONS, *TRACK, counted=counted)
    return fishing_signs(framed, positions.columns, max_kts, turns_per_h, area_nm2, min_pos)


def fishing_signs(
    framed: DataFrame, columns: list[str], max_kts: float = 5.0, turns_per_h: float = 10.0, area_nm2: float = 100.0, min_pos: int = 10
) -> DataFrame:
    """The measures over `_last`, the last positions of each report, where three signs of four are met."""
    framed = framed.where(F.size("_last") >= min_pos)

    def measure(last):
        speeds = F.transform(last, lambda p: p["speed_over_ground"])
        lats, lons = F.transform(last, lambda p: p["latitude"]), F.transform(last, lambda p: p["longitude"])
        mean = F.coalesce(mean_of(speeds), F.lit(0.0))
        square = F.coalesce(mean_of(F.transform(speeds, lambda s: s * s)), F.lit(0.0))
        return F.struct(
            mean.alias("avg_speed"),
            (square - mean * mean).alias("speed_variance"),
            geo.let(F.transform(last, lambda p: p["course_over_ground"]), turn_count).alias("course_changes"),
            F.size(last).alias("positions_analyzed"),
            F.array_min(lats).alias("south"),
            F.array_min(lons).alias("west"),
            F.array_max(lats).alias("north"),
            F.array_max(lons).alias("east"),
        )

    m = F.col("_m")
    measured = once(framed, "_m", geo.let(F.col("_last"), measure)).select(
        *columns,
        *[m[c].alias(c) for c in ("avg_speed", "speed_variance", "course_changes", "positions_analyzed")],
        geo.box_area_nm2(m["south"], m["west"], m["north"], m["east"]).alias("area_nm2"),
    )
    hourly = F.col("course_changes") * 60.0 / (F.col("positions_analyzed") * MINUTES_PER_POSITION)
    signs = [
        F.col("avg_speed") < max_kts,
        F.col("speed_variance") > VARIANCE_LIMIT,
        F.col("turns_per_hour") >= turns_per_h,
        F.col("area_nm2") < area_nm2,
    ]
    count = sum((s.cast("int") for s in signs[1:]), signs[0].cast("int"))
    quarter = F.lit(25.0)
    confidence = (
        F.when(signs[0], quarter * (1 - F.col("avg_speed") / max_kts)).otherwise(0.0)
        + F.least(quarter, F.col("speed_variance") * 5)
        + F.least(quarter, F.col("turns_per_hour") * 2.5)
        + F.when(signs[3], quarter * (1 - F.col("area_nm2") / area_nm2)).otherwise(0.0)
    )
    return (
        measured.withColumn("turns_per_hour", hourly)
        .where(count >= 3)
        .withColumn("confidence", F.least(F.lit(100.0), confidence))
    )


def fishing_grounds(zones: DataFrame) -> DataFrame:
    return zones.where(F.col("zone_type").isin("MPA", "EEZ"))


def fishing_hits(signs: DataFrame, grounds: DataFrame) -> DataFrame:
    """Reports that likely fish where they must not, with severity and title."""
    fishing = ais.is_fishing("ship_type")
    mpa = F.col("zone_type") == "MPA"
    likely = signs.where(F.col("confidence") >= MIN_CONFIDENCE)
    hits = in_zones(likely, grounds, "zone_id", "zone_name", "zone_type").where(mpa | fishing)
    severity = (
        F.when(mpa & (F.col("confidence") > SURE_CONFIDENCE), "CRITICAL")
        .when(mpa | ~fishing, "HIGH")
        .otherwise("MEDIUM")
    )
    return hits.withColumn("severity", severity).withColumn(
        "title",
        F.concat(F.when(fishing, "Fishing vessel").otherwise("Vessel"), F.lit(" fishing in "), F.col("zone_name")),
    )


def fishing_events(positions: DataFrame, zones: DataFrame, once_per_visit: bool = False, **limits) -> DataFrame:
    """Fishing-like reports inside an MPA or EEZ, one row per (report, zone).

    once_per_visit keeps the first of consecutive alerts of a vessel in a zone.
    """
    grounds = fishing_grounds(zones)
    # Only vessels that report from such a zone at all need their tracks analysed.
    visitors = in_zones(positions, grounds).select("mmsi").distinct()
    tracks = positions.join(visitors, "mmsi", "left_semi")
    if once_per_visit:
        tracks = with_history(tracks, previous("_prev", "row_id"), counted=positions)
    events = fishing_hits(fishing_analysis(tracks, counted=positions, **limits), grounds)
    if once_per_visit:
        seen = with_history(events, previous("_shown", "row_id"), key=("mmsi", "zone_id"), counted=positions)
        goes_on = F.col("_shown.row_id") == F.col("_prev.row_id")
        events = seen.where(~F.coalesce(goes_on, F.lit(False))).drop("_shown", "_prev")
    return events


def detect_fishing(positions: DataFrame, zones: DataFrame, once_per_visit: bool = False, **limits) -> DataFrame:
    fishing = ais.is_fishing("ship_type")
    kind = F.when(fishing, "Fishing vessel").otherwise("Vessel")
    text = F.format_string(
        "%s %s (MMSI: %s) detected fishing in %s. Avg speed: %.1f kts, Course changes: %d, Confidence: %.0f%%",
        kind, or_unknown("ship_name"), F.col("mmsi"), F.col("zone_name"), F.col("avg_speed"),
        F.col("course_changes"), F.col("confidence"),
    )
    return to_alerts(
        fishing_events(positions, zones, once_per_visit, **limits),
        "FISHING_IN_MPA",
        text,
        {
            "zone_id": "zone_id",
            "zone_type": "zone_type",
            "avg_speed_knots": "avg_speed",
            "speed_variance": "speed_variance",
            "course_changes": "course_changes",
            "area_covered_sqnm": "area_nm2",
            "confidence": "confidence",
            "positions_analyzed": "positions_analyzed",
            "suspicious_behavior": F.when(~fishing, "non_fishing_vessel_fishing_pattern"),
        },
        subject=F.col("zone_id"),
    )
