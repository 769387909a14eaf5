"""Slow, stopped or monitored vessels inside cable protection zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight import dims
from harborlight.functions import ais, geo
from harborlight.functions.alerts import or_unknown, to_alerts
from harborlight.operators.throttle import throttle
from harborlight.operators.zones import in_zones

# Fixed values.
STOPPED_KNOTS = 0.5
SLOW_KNOTS = 3.0
LARGE_TRANSIT_KNOTS = 8.0
PORT_NM = 2.5
COOLDOWN_S = 900

#: What an alert's description says about each risk factor.
FINDINGS = {
    "STOPPED_IN_ZONE": "lies still and may be at anchor",
    "FLAGGED_STATE_SLOW": "slow under a watched flag",
    "HIGH_RISK_SHIP_SLOW": "slow cargo ship or tanker",
    "SLOW_IN_ZONE": "slow in a protected zone",
    "FLAGGED_STATE_TRANSIT": "passes under a watched flag",
    "LARGE_VESSEL_TRANSIT": "cargo ship or tanker passes at reduced speed",
}


def zones_of_type(zones: DataFrame, kind: str = "cable_protection") -> DataFrame:
    return zones.where(F.col("zone_type") == kind)


def cable_candidates(positions: DataFrame, zones: DataFrame) -> DataFrame:
    """Every threatening (report, cable zone), before the cooldown."""
    hits = in_zones(positions, zones_of_type(zones), "zone_id", "zone_name")
    speed = F.coalesce(F.col("speed_over_ground"), F.lit(0.0))
    flag = ais.flag_state("mmsi", "cable")
    monitored = flag.isin(dims.MONITORED_FLAGS)
    large = ais.is_cargo("ship_type") | ais.is_tanker("ship_type")
    factor = (
        F.when(F.col("speed") < STOPPED_KNOTS, "STOPPED_IN_ZONE")
        .when((F.col("speed") < SLOW_KNOTS) & monitored, "FLAGGED_STATE_SLOW")
        .when((F.col("speed") < SLOW_KNOTS) & large, "HIGH_RISK_SHIP_SLOW")
        .when(F.col("speed") < SLOW_KNOTS, "SLOW_IN_ZONE")
        .when(monitored, "FLAGGED_STATE_TRANSIT")
        .when(large & (F.col("speed") < LARGE_TRANSIT_KNOTS), "LARGE_VESSEL_TRANSIT")
    )
    severity, title = (F.create_map(*[F.lit(x) for k, v in dims.CABLE_ALERTS.items() for x in (k, v[i])]) for i in (0, 1))
    near_port = geo.near_any("latitude", "longitude", dims.BALTIC_ANCHORAGES, PORT_NM)
    return (
        hits.withColumn("speed", speed)
        .withColumn("flag", flag)
        .withColumn("risk_factor", factor)
        .where(F.col("risk_factor").isNotNull())
        .where((F.col("speed") >= SLOW_KNOTS) | ~near_port)
        .withColumn("severity", severity[F.col("risk_factor")])
        .withColumn("title", title[F.col("risk_factor")])
    )


def cable_events(positions: DataFrame, zones: DataFrame) -> DataFrame:
    return throttle(cable_candidates(positions, zones), ["mmsi", "zone_id"], COOLDOWN_S)


def description() -> Column:
    """One sentence: who, how fast, in which zone, and what is worth a look."""
    finding = F.create_map(*[F.lit(x) for pair in FINDINGS.items() for x in pair])[F.col("risk_factor")]
    return F.format_string(
        "%s, MMSI %s, flag %s: %.1f knots in %s; %s.",
        or_unknown("ship_name"), F.col("mmsi"), F.coalesce("flag", F.lit("unknown")), F.col("speed"), F.col("zone_name"), finding,
    )


def detect_cable_proximity(positions: DataFrame, zones: DataFrame) -> DataFrame:
    return to_alerts(
        cable_events(positions, zones),
        "CABLE_PROXIMITY",
        description(),
        {
            "cable_name": "zone_name",
            "zone_id": "zone_id",
            "vessel_speed": "speed",
            "ship_type": "ship_type",
            "flag_state": "flag",
            "risk_factor": "risk_factor",
        },
        subject=F.col("zone_id"),
        flag=F.col("flag"),
    )
