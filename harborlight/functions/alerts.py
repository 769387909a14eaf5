"""The one alert layout all detectors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight import dims
from harborlight.functions.geo import _col

ALERT_SCHEMA = (
    "alert_id string, alert_type string, severity string, mmsi string, vessel_name string, "
    "imo_number string, flag_state string, latitude double, longitude double, "
    "detected_at timestamp, title string, description string, details string"
)
ALERT_COLUMNS = [part.strip().split(" ")[0] for part in ALERT_SCHEMA.split(",")]


def or_unknown(value, fallback="Unknown") -> Column:
    return F.coalesce(_col(value), fallback if isinstance(fallback, Column) else F.lit(fallback))


def severity_rank(severity) -> Column:
    """LOW 1 .. CRITICAL 4; anything else 0."""
    s = _col(severity)
    rank = F.lit(0)
    for i, name in enumerate(dims.SEVERITIES):
        rank = F.when(s == name, i + 1).otherwise(rank)
    return rank


def max_severity(*severities) -> Column:
    """The worst of several severities."""
    ranked = F.greatest(*[F.struct(severity_rank(s).alias("r"), _col(s).alias("s")) for s in severities])
    return ranked["s"]


def alert_id(alert_type: str, subject: Column | None = None) -> Column:
    """Same alert, same id, so that a replay or a retried batch does not double it."""
    parts = [F.lit(alert_type), F.col("mmsi"), F.col("t_s").cast("string"), F.col("row_id").cast("string")]
    if subject is not None:
        parts.append(subject.cast("string"))
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def to_alerts(
    events: DataFrame,
    alert_type: str,
    description: Column,
    details: dict[str, Column | str] | Column,
    subject: Column | None = None,
    flag: Column | None = None,
) -> DataFrame:
    """Events with position columns, `severity` and `title` -> rows in ALERT_SCHEMA.

    `details` is a JSON column or named values, of which null ones are left out of the document.
    """
    if isinstance(details, dict):
        details = F.to_json(F.struct(*[_col(v).alias(k) for k, v in sorted(details.items())]))
    return events.select(
        alert_id(alert_type, subject).alias("alert_id"),
        F.lit(alert_type).alias("alert_type"),
        F.col("severity"),
        F.col("mmsi"),
        F.col("ship_name").alias("vessel_name"),
        F.col("imo_number"),
        (flag if flag is not None else F.lit(None)).cast("string").alias("flag_state"),
        F.col("latitude"),
        F.col("longitude"),
        F.timestamp_seconds(F.col("t_s")).alias("detected_at"),
        F.col("title"),
        description.alias("description"),
        details.alias("details"),
    )
