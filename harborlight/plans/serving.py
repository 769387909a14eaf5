"""What a map or dashboard asks for: current positions, trails, alerts and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight import dims
from harborlight.functions import ais
from harborlight.functions.geo import in_boxes
from harborlight.operators.history import previous, with_history
from harborlight.operators.throttle import thin_track

# Fixed values.
TRAIL_POINTS = 200
ALERTS_SHOWN = 250
VESSEL_TTL_S = 6 * 3600


def current_positions(positions: DataFrame) -> DataFrame:
    """Latest report of each vessel (map-side combined)."""
    row = F.struct(*positions.columns)
    return positions.groupBy("mmsi").agg(F.max_by(row, F.struct("t_s", "row_id")).alias("r")).select("r.*")


def vessels_minimal(current: DataFrame, flag_source: str = "display") -> DataFrame:
    return current.select(
        "mmsi", "latitude", "longitude", "heading", F.col("speed_over_ground").alias("speed"), "ship_name",
        "ship_type", ais.flag_state("mmsi", flag_source).alias("flag"), F.col("t_s").alias("timestamp_s"),
    )


def vessels_in_bbox(current: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Vessels in (south, west, north, east); all without a box."""
    return current if box is None else current.where(in_boxes("latitude", "longitude", [box]))


def vessel_by_mmsi(current: DataFrame, mmsi: str) -> DataFrame:
    return current.where(F.col("mmsi") == mmsi)


def _contains(query: str, *columns: Column) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    return found


def search_vessels(current: DataFrame, query: str) -> DataFrame:
    if not query:
        return current
    return current.where(
        _contains(query, F.col("ship_name"), F.col("mmsi"), ais.flag_state("mmsi", "display"), F.col("ship_type").cast("string"))
    )


def filter_alerts(alerts: DataFrame, severities: list[str], types: list[str], query: str = "") -> DataFrame:
    out = alerts.where(F.col("severity").isin(severities) & F.col("alert_type").isin(types))
    if query:
        out = out.where(_contains(query, *[F.col(c) for c in ("vessel_name", "mmsi", "title", "description")]))
    return out


def filter_by_category(current: DataFrame, categories: list[str]) -> DataFrame:
    shown = ais.vessel_category("ship_type")
    return current.where(F.when(shown == "unknown", "other").otherwise(shown).isin(categories))


def filter_by_speed_bucket(current: DataFrame, buckets: list[str]) -> DataFrame:
    return current.where(ais.speed_bucket("speed_over_ground").isin(buckets))


def flagged_only(current: DataFrame) -> DataFrame:
    return current.where(ais.is_flagged("mmsi"))


def infrastructure_by_type(zones: DataFrame, types: list[str]) -> DataFrame:
    return zones.where(F.col("infrastructure_type").isin(types))


def infrastructure_counts(zones: DataFrame) -> DataFrame:
    return zones.groupBy("infrastructure_type").agg(F.count("*").alias("zones"))


def with_alerts_only(rows: DataFrame, alerts: DataFrame) -> DataFrame:
    """Vessels or trails that have an alert."""
    return rows.join(alerts.select("mmsi").distinct(), "mmsi", "left_semi")


def trail_points(positions: DataFrame, points: int = TRAIL_POINTS) -> DataFrame:
    """The last `points` kept track points of each vessel, `n` counting from the newest."""
    kept = thin_track(positions.where((F.col("latitude") != 0) & (F.col("longitude") != 0)))
    newest = Window.partitionBy("mmsi").orderBy(F.desc("t_s"), F.desc("row_id"))
    return kept.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= points)


def as_trails(kept: DataFrame) -> DataFrame:
    """Track points -> one row per vessel with at least two: points = array of struct(lon, lat, t_s)."""
    point = F.struct("t_s", "row_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    ordered = F.array_sort(F.collect_list(point))
    return (
        kept.groupBy("mmsi")
        .agg(F.transform(ordered, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), p["t_s"].alias("t_s"))).alias("points"))
        .withColumn("point_count", F.size("points"))
        .where(F.col("point_count") >= 2)
    )


def trails(positions: DataFrame, points: int = TRAIL_POINTS) -> DataFrame:
    return as_trails(trail_points(positions, points))


def trails_with_vessel(trail: DataFrame, current: DataFrame) -> DataFrame:
    """Add the vessel's current name ('' if none) and type (0 if none)."""
    vessel = current.select("mmsi", "ship_name", "ship_type")
    return trail.join(vessel, "mmsi", "left").fillna({"ship_name": "", "ship_type": 0})


def trail_horizon(trail: DataFrame, hours: float, now_s: int) -> DataFrame:
    """Points of the last `hours` and points without a time; trails with fewer than two are dropped.

    A trail whose points all qualify, or that has no time at all, stays as it is; 0 hours show none.
    """
    if hours == 0:
        return trail.where(F.lit(False))
    since = int(now_s - hours * 3600)
    recent = F.filter("points", lambda p: p["t_s"].isNull() | (p["t_s"] >= since))
    return (
        trail.withColumn("points", recent)
        .withColumn("point_count", F.size("points"))
        .where(F.col("point_count") >= 2)
    )


def recent_alerts(alerts: DataFrame, limit: int = ALERTS_SHOWN) -> DataFrame:
    if limit <= 0:
        raise ValueError("limit must be positive")
    return alerts.orderBy(F.desc("detected_at"), "alert_id").limit(limit)


def top_alerts_per_vessel(alerts: DataFrame, k: int = 5) -> DataFrame:
    """The k newest alerts of each vessel; Spark ranks within partitions before the exchange."""
    newest = Window.partitionBy("mmsi").orderBy(F.desc("detected_at"), "alert_id")
    return alerts.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= k)


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Totals by severity, by type and overall in one pass: dimension, value, alerts."""
    by_both = alerts.groupingSets(
        [["severity"], ["alert_type"], []], "severity", "alert_type"
    ).agg(F.count("*").alias("alerts"), F.grouping_id().alias("_g"))
    dimension = F.when(F.col("_g") == 1, "severity").when(F.col("_g") == 2, "alert_type").otherwise("total")
    value = F.when(F.col("_g") == 1, F.col("severity")).when(F.col("_g") == 2, F.col("alert_type")).otherwise("all")
    return by_both.select(dimension.alias("dimension"), value.alias("value"), "alerts")


def system_stats(current: DataFrame, alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """total_vessels, total_alerts, total_incidents, active_incidents as one row."""
    names = ["total_vessels", "total_alerts", "total_incidents", "active_incidents"]

    def part(df: DataFrame, **counts: Column) -> DataFrame:
        return df.agg(*[counts.get(name, F.lit(0).cast("long")).alias(name) for name in names])

    every = F.count("*")
    parts = (
        part(current, total_vessels=every)
        .unionByName(part(alerts, total_alerts=every))
        .unionByName(part(incidents, total_incidents=every, active_incidents=F.count_if(F.col("status") == "ACTIVE")))
    )
    return parts.agg(*[F.sum(name).alias(name) for name in names])


def storage_stats(trail: DataFrame, incidents: DataFrame) -> DataFrame:
    """How much the serving tables hold, as one row."""
    points = trail.agg(F.count("*").alias("trail_vessels"), F.coalesce(F.sum("point_count"), F.lit(0)).alias("trail_points"))
    held = incidents.agg(
        F.count("*").alias("incidents"),
        F.coalesce(F.sum("alert_count"), F.lit(0)).alias("incident_alerts"),
        F.count_if(F.col("status") == "ACTIVE").alias("active"),
        F.count_if(F.col("status") == "RESOLVED").alias("resolved"),
    )
    one = held.select(F.struct(*held.columns)).scalar()
    return points.withColumn("_held", one).select(*points.columns, "_held.*")


def active_vessels(current: DataFrame, now_s: int, most: int | None = None, spare: int = 0) -> DataFrame:
    """Vessels seen within six hours; if more than `most`, where given, the oldest go, `spare` beyond the excess.

    The count is a scalar subquery; only one number passes through the driver.
    """
    fresh = current.where(F.col("t_s") >= now_s - VESSEL_TTL_S)
    if most is None:
        return fresh
    total = fresh.agg(F.count("*")).scalar()
    by_second = fresh.groupBy("t_s").agg(F.count("*").alias("_here"))
    # Vessels per second of last report; the running count goes over seconds, not vessels.
    earlier = by_second.withColumn(
        "_before", F.coalesce(F.sum("_here").over(Window.orderBy("t_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_here")
    within = Window.partitionBy("t_s").orderBy("mmsi")
    ranked = fresh.withColumn("_n", F.row_number().over(within)).join(earlier, "t_s").withColumn("_total", total)
    drop = F.when(F.col("_total") > most, F.col("_total") - most + spare).otherwise(0)
    return ranked.where(F.col("_before") + F.col("_n") > drop).select(*current.columns)


def position_changes(positions: DataFrame) -> DataFrame:
    """Reports that moved the vessel on the map: the first, and each with a new place."""
    rows = with_history(positions, previous("_prev", "latitude", "longitude"))
    same = (F.col("_prev.latitude") == F.col("latitude")) & (F.col("_prev.longitude") == F.col("longitude"))
    return rows.where(F.col("_prev").isNull() | ~F.coalesce(same, F.lit(False))).drop("_prev")


def message_rate(positions: DataFrame, window_s: int = 5) -> DataFrame:
    """Changed vessels per second over a sliding window that advances by one second."""
    changed = position_changes(positions).select(F.timestamp_seconds("t_s").alias("ts"))
    return (
        changed.groupBy(F.window("ts", f"{window_s} seconds", "1 second").alias("w"))
        .agg(F.count("*").alias("changes"))
        .select(F.unix_seconds("w.end").alias("until_s"), "changes", (F.col("changes") / window_s).alias("per_second"))
    )


def combined_alerts(alerts: DataFrame, investigation: DataFrame, mmsi: str) -> DataFrame:
    """A vessel's alerts together with those of an investigated track, newest first."""
    common = [c for c in alerts.columns if c in investigation.columns]
    own = alerts.where(F.col("mmsi") == mmsi).select(*common)
    return own.unionByName(investigation.select(*common)).orderBy(F.desc("detected_at"), "alert_id")


def alerts_with_incident(alerts_in_sessions: DataFrame, incidents: DataFrame) -> DataFrame:
    """Add the incident id to alerts; `alerts_in_sessions` comes from with_sessions."""
    first = alerts_in_sessions.groupBy("mmsi", "session").agg(F.min("t_s").alias("_first_s"))
    ids = incidents.select("mmsi", F.unix_seconds("first_alert_time").alias("_first_s"), F.col("id").alias("incident_id"))
    return alerts_in_sessions.join(first.join(ids, ["mmsi", "_first_s"]).drop("_first_s"), ["mmsi", "session"], "left")


ALERT_TYPES = [
    "GEOFENCE_VIOLATION", "DARK_EVENT", "RENDEZVOUS", "FISHING_IN_MPA", "SANCTIONS_MATCH", "CABLE_PROXIMITY",
    "LOITERING", "AIS_SPOOFING", "CONVOY", "ANCHOR_DRAGGING", "TRAJECTORY_PREDICTION",
]
SEVERITIES = dims.SEVERITIES
