"""Transmission gaps, and vessels that first appear in open water."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight import dims
from harborlight.functions import ais, geo
from harborlight.functions.alerts import or_unknown, to_alerts
from harborlight.operators.history import following, last_seen, with_history
from harborlight.plans.state import STATIC_COLUMNS, interval_features, interval_means

# Fixed values.
MIN_MESSAGES = 5
SHORE_NM = 5.0
FAR_NM = 20.0


def quiet_type(ship_type: Column) -> Column:
    """Types whose silence is normal: sailing, pleasure craft, passenger."""
    t = F.coalesce(ship_type, F.lit(-1))
    return t.between(36, 37) | t.between(60, 69)


def gap_severity(gap_min: Column, tanker: Column, sensitive: Column) -> Column:
    return (
        F.when(sensitive, "CRITICAL")
        .when(gap_min > 24 * 60, "HIGH")
        .when((gap_min > 6 * 60) | tanker, "MEDIUM")
        .otherwise("LOW")
    )


def gone_dark_events(
    positions: DataFrame, threshold_min: int = 30, as_of: int | None = None, sensitive: Column | None = None
) -> DataFrame:
    """The last report before each silence.

    A vessel's final report counts as a silence up to `as_of` (epoch seconds), if that is given.
    `sensitive` marks reports of sanctioned vessels or in sensitive zones.
    """
    rows = with_history(
        positions,
        following("_next", "t_s"),
        *interval_features(),
        *[last_seen(f"_{c}", F.col(c)) for c in STATIC_COLUMNS],
    )
    gap_end = F.coalesce(F.col("_next.t_s"), F.lit(as_of).cast("long"))
    gap = F.floor((gap_end - F.col("t_s")) / 60).cast("long")
    speed = F.col("speed_over_ground")
    known = rows.withColumn("gap_minutes", gap).withColumns({c: F.col(f"_{c}") for c in STATIC_COLUMNS})
    silent = (
        (F.col("gap_minutes") >= threshold_min)
        & (F.col("message_count") >= MIN_MESSAGES)
        & (speed.isNull() | (speed >= 0.5))
        & ~quiet_type(F.col("ship_type"))
    )
    tanker = ais.is_tanker("ship_type")
    noted = sensitive if sensitive is not None else F.lit(False)
    return (
        interval_means(known.drop("_next", *[f"_{c}" for c in STATIC_COLUMNS]), F.coalesce(silent, F.lit(False)))
        .where(~((F.col("avg_interval_s") > 0) & (F.col("gap_minutes") * 60 < F.col("avg_interval_s") * 10)))
        .withColumn("severity", gap_severity(F.col("gap_minutes"), tanker, noted))
        .withColumn("title", F.lit("Vessel Gone Dark"))
    )


def detect_gone_dark(
    positions: DataFrame, threshold_min: int = 30, as_of: int | None = None, sensitive: Column | None = None
) -> DataFrame:
    gap = F.col("gap_minutes")
    text = F.format_string(
        "Vessel %s (MMSI: %s) has not transmitted for %d hours %d minutes. Last position: %.4f, %.4f",
        or_unknown("ship_name"), F.col("mmsi"), F.floor(gap / 60), gap % 60, F.col("latitude"), F.col("longitude"),
    )
    return to_alerts(
        gone_dark_events(positions, threshold_min, as_of, sensitive),
        "DARK_EVENT",
        text,
        {
            "gap_minutes": gap,
            "last_speed": "speed_over_ground",
            "last_seen": F.timestamp_seconds("t_s").cast("string"),
            "dark_type": F.lit("GONE_DARK"),
            "vessel_category": F.when(ais.is_tanker("ship_type"), "tanker"),
        },
        subject=F.lit("gone"),
    )


def first_reports(positions: DataFrame) -> DataFrame:
    """The first report of each vessel (map-side combined)."""
    row = F.struct(*positions.columns)
    return positions.groupBy("mmsi").agg(F.min_by(row, F.struct("t_s", "row_id")).alias("r")).select("r.*")


def appeared_dark_events(positions: DataFrame) -> DataFrame:
    """First reports in open water, away from the edge of the collection area."""
    distance = geo.min_distance_nm("latitude", "longitude", dims.COASTAL_POINTS)
    laden = ais.is_tanker("ship_type") | ais.is_cargo("ship_type")
    return (
        first_reports(positions)
        .where(~geo.at_area_edge("latitude", "longitude"))
        .withColumn("shore_nm", distance)
        .where(F.col("shore_nm") > SHORE_NM)
        .withColumn("severity", F.when(laden | (F.col("shore_nm") > FAR_NM), "HIGH").otherwise("MEDIUM"))
        .withColumn("title", F.format_string("Dark AIS: %s Appeared in Open Water", or_unknown("ship_name", F.col("mmsi"))))
    )


def detect_appeared_dark(positions: DataFrame) -> DataFrame:
    text = F.format_string(
        "Vessel %s (MMSI: %s) suddenly appeared %.1f nm from shore at position (%.4f, %.4f). "
        "This vessel was not previously tracked, indicating it was operating with AIS transponder off. "
        "Vessels appearing in open water without prior tracking history are suspicious.",
        or_unknown("ship_name"), F.col("mmsi"), F.col("shore_nm"), F.col("latitude"), F.col("longitude"),
    )
    return to_alerts(
        appeared_dark_events(positions),
        "DARK_EVENT",
        text,
        {
            "dark_type": F.lit("APPEARED_DARK"),
            "distance_from_shore_nm": "shore_nm",
            "vessel_speed": "speed_over_ground",
            "vessel_course": "course_over_ground",
            "ship_type": "ship_type",
        },
        subject=F.lit("appeared"),
    )
