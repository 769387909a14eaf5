"""Restricted-zone entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.functions import ais
from harborlight.functions.alerts import or_unknown, to_alerts
from harborlight.operators.history import previous, with_history
from harborlight.operators.zones import in_zones


def geofence_events(positions: DataFrame, zones: DataFrame, on_entry_only: bool = False) -> DataFrame:
    """Reports inside a zone whose rule they break, one row per (report, zone).

    on_entry_only keeps the first of consecutive reports of a vessel inside the zone.
    """
    rows = positions
    if on_entry_only:
        rows = with_history(positions, previous("_prev", "row_id"))
    fishing = ais.is_fishing("ship_type")
    kind = F.col("zone_type")
    everyone = F.coalesce(F.col("alert_all_vessels"), F.lit(False))
    broken = (
        F.when(kind.isin("sanctioned_waters", "restricted"), F.lit(True))
        .when(kind == "MPA", fishing | everyone)
        .when(kind == "EEZ", fishing)
        .otherwise(everyone)
    )
    # Zones that can never alert are dropped before the join.
    able = zones.where(kind.isin("sanctioned_waters", "restricted", "MPA", "EEZ") | everyone)
    hits = in_zones(rows, able, "zone_id", "zone_name", "zone_type", "alert_all_vessels").where(broken)
    critical = (kind == "sanctioned_waters") | ((kind == "MPA") & fishing)
    events = hits.withColumn("severity", F.when(critical, "CRITICAL").otherwise("HIGH")).withColumn(
        "title", F.concat(F.lit("Geofence Violation: "), F.col("zone_name"))
    )
    if on_entry_only:
        seen = with_history(events, previous("_last", "row_id"), key=("mmsi", "zone_id"), counted=positions)
        events = seen.where(~F.col("_last.row_id").eqNullSafe(F.col("_prev.row_id")) | F.col("_last").isNull())
        events = events.drop("_last", "_prev")
    return events


def detect_geofence(positions: DataFrame, zones: DataFrame, on_entry_only: bool = False) -> DataFrame:
    text = F.format_string(
        "Vessel %s (MMSI: %s) entered %s zone: %s",
        or_unknown("ship_name"), F.col("mmsi"), F.col("zone_type"), F.col("zone_name"),
    )
    return to_alerts(
        geofence_events(positions, zones, on_entry_only),
        "GEOFENCE_VIOLATION",
        text,
        {
            "zone_name": "zone_name",
            "zone_type": "zone_type",
            "vessel_speed": "speed_over_ground",
            "vessel_course": "course_over_ground",
        },
        subject=F.col("zone_id"),
    )
