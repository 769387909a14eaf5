"""Vessels that move while they report to be at anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions import geo
from harborlight.functions.alerts import or_unknown, to_alerts
from harborlight.functions.geo import METERS_PER_NM
from harborlight.operators.history import running_max, running_sum, with_history, with_islands
from harborlight.operators.throttle import throttle
from harborlight.operators.zones import in_zones
from harborlight.plans.cable import zones_of_type
from harborlight.session import written

# Fixed values.
ANCHORED_STATUSES = (1, 5)
DRAG_KNOTS = 0.5
FAST_DRAG_KNOTS = 1.5
DRIFT_NM = 0.05
COOLDOWN_S = 900


def claims_anchored(nav_status: Column) -> Column:
    return F.coalesce(nav_status.isin(*ANCHORED_STATUSES), F.lit(False))


def drag_cause() -> Column:
    """What gives a report at anchor away: fast, moving, drift, or null."""
    speed = F.coalesce(F.col("speed_over_ground"), F.lit(0.0))
    return (
        F.when(speed > FAST_DRAG_KNOTS, "fast")
        .when(speed > DRAG_KNOTS, "moving")
        .when(F.col("drift_nm") > DRIFT_NM, "drift")
    )


def anchor_spells(positions: DataFrame) -> DataFrame:
    """Reports at anchor with `anchor` = struct(t_s, row_id, latitude, longitude, ...), the spell's first report."""
    runs = with_islands(
        positions,
        "anchor",
        ["t_s", "row_id", "latitude", "longitude", "nav_status"],
        lambda p, c: claims_anchored(p["nav_status"]) != claims_anchored(c["nav_status"]),
    )
    return runs.where(claims_anchored(F.col("nav_status")))


def anchor_drift(positions: DataFrame) -> DataFrame:
    """Later reports of a spell with drift from the anchor point and the largest drift so far.

    The reports at anchor are stored before the second pass over them.
    """
    drift = geo.haversine_nm("anchor.latitude", "anchor.longitude", "latitude", "longitude")
    rows = (
        anchor_spells(positions)
        .withColumn("anchor_row", F.col("anchor.row_id"))
        .where(F.col("row_id") != F.col("anchor_row"))
        .withColumn("drift_nm", drift)
    )
    return with_history(
        written(rows, "anchored"), running_max("max_drift_nm", F.col("drift_nm")), key=("mmsi", "anchor_row")
    )


def anchor_candidates(positions: DataFrame, zones: DataFrame) -> DataFrame:
    """Dragging reports, before the cooldown."""
    dragging = (
        anchor_drift(positions)
        .withColumn("speed", F.coalesce(F.col("speed_over_ground"), F.lit(0.0)))
        .withColumn("cause", drag_cause())
        .where(F.col("cause").isNotNull())
    )
    # The first cable by id, when a report lies in several.
    cables = (
        in_zones(dragging.select("row_id", "mmsi", "t_s", "latitude", "longitude"), zones_of_type(zones), "zone_id", "zone_name")
        .groupBy("mmsi", "t_s", "row_id")
        .agg(F.min(F.struct("zone_id", "zone_name")).alias("_cable"))
    )
    near = F.col("_cable").isNotNull()
    severity = (
        F.when(F.col("cause") == "fast", F.when(near, "CRITICAL").otherwise("HIGH"))
        .when(F.col("cause") == "moving", F.when(near, "HIGH").otherwise("MEDIUM"))
        .otherwise(F.when(near, "CRITICAL").otherwise("MEDIUM"))
    )
    return (
        dragging.join(cables, ["mmsi", "t_s", "row_id"], "left")
        .withColumn("near_cable", near)
        .withColumn("cable_name", F.col("_cable.zone_name"))
        .withColumn("severity", severity)
        .withColumn("anchor_minutes", F.floor((F.col("t_s") - F.col("anchor.t_s")) / 60))
        .drop("_cable")
    )


def anchor_events(positions: DataFrame, zones: DataFrame) -> DataFrame:
    """Alerts with `alert_count`, the alerts of the spell before this one."""
    kept = written(throttle(anchor_candidates(positions, zones), ["mmsi"], COOLDOWN_S), "anchor-alerts")
    counted = with_history(
        kept, running_sum("alert_count", F.lit(1).cast("long"), inclusive=False), key=("mmsi", "anchor_row")
    )
    title = (
        F.when(~F.col("near_cable"), "Anchor Dragging Detected")
        .when(F.col("severity") == "CRITICAL", "CRITICAL: Anchor Dragging Near Cable!")
        .otherwise("Anchor Dragging Near Infrastructure")
    )
    return counted.withColumn("title", title)


def detect_anchor_drag(positions: DataFrame, zones: DataFrame) -> DataFrame:
    drift_m = F.col("drift_nm") * METERS_PER_NM
    cable = F.col("cable_name")
    reason = (
        F.when(F.col("cause") == "fast", F.concat(
            F.format_string("Moving at %.1f kts while reporting anchored", F.col("speed")),
            F.when(F.col("near_cable"), F.concat(F.lit(" NEAR "), cable)).otherwise("")))
        .when(F.col("cause") == "moving", F.concat(
            F.format_string("Moving at %.1f kts while anchored", F.col("speed")),
            F.when(F.col("near_cable"), F.concat(F.lit(" near "), cable)).otherwise("")))
        .otherwise(F.concat(
            F.format_string("Drifted %.0f meters from anchor position", drift_m),
            F.when(F.col("near_cable"), F.concat(F.lit(" NEAR "), cable)).otherwise("")))
    )
    text = F.when(
        F.col("near_cable"),
        F.format_string(
            "Vessel %s (MMSI: %s) appears to be dragging anchor near %s. %s. "
            "Drifted %.0fm from anchor position. IMMEDIATE THREAT TO INFRASTRUCTURE.",
            or_unknown("ship_name"), F.col("mmsi"), cable, reason, drift_m),
    ).otherwise(
        F.format_string(
            "Vessel %s (MMSI: %s) appears to be dragging anchor. %s. Drifted %.0fm from anchor position.",
            or_unknown("ship_name"), F.col("mmsi"), reason, drift_m)
    )
    return to_alerts(
        anchor_events(positions, zones),
        "ANCHOR_DRAGGING",
        text,
        {
            "anchor_position": F.format_string("%.4f, %.4f", F.col("anchor.latitude"), F.col("anchor.longitude")),
            "current_position": F.format_string("%.4f, %.4f", F.col("latitude"), F.col("longitude")),
            "drift_distance_m": F.floor(drift_m + 0.5),
            "drift_distance_nm": F.round("drift_nm", 2),
            "max_drift_m": F.floor(F.col("max_drift_nm") * METERS_PER_NM + 0.5),
            "current_speed": "speed",
            "nav_status": "nav_status",
            "anchor_duration_minutes": "anchor_minutes",
            "near_cable": "near_cable",
            "cable_name": "cable_name",
            "alert_count": "alert_count",
        },
    )
