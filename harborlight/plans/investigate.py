"""Who crossed a zone in a time range, and how they behaved."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight import dims
from harborlight.functions import ais, geo
from harborlight.operators.history import previous, running_max, with_history
from harborlight.operators.zones import CELL_DEGREES, with_edges

# Fixed values.
SEARCH_MARGIN = 0.5
INDICATORS = [
    "STOPPED_IN_ZONE", "ANCHOR_STATUS", "SLOW_TRANSIT", "FLAG_OF_CONVENIENCE",
    "HIGH_RISK_FLAG", "PROLONGED_TIME", "SPEED_VARIATION",
]


def parse_timeframe(text: str, now: datetime | None = None) -> tuple[datetime, datetime]:
    """'48h' back from now, or 'ISO/ISO'."""
    now = now or datetime.now(timezone.utc)
    hours = re.fullmatch(r"(\d+)h", text.lower())
    if hours:
        return now - timedelta(hours=int(hours.group(1))), now
    if text.count("/") == 1:
        start, end = (datetime.fromisoformat(part.replace("Z", "+00:00")) for part in text.split("/"))
        return start, end
    raise ValueError(f"not a time frame: {text!r}; use '48h' or 'start/end' in ISO form")


@dataclass
class Investigation:
    vessels: DataFrame
    timeline: DataFrame
    flags: DataFrame
    suspicious: DataFrame


def zone_track(positions: DataFrame, zone: DataFrame, start_s: int | None = None, end_s: int | None = None) -> DataFrame:
    """Reports near the zone with `inside`, `was_inside` and `entered` (inside now or earlier).

    `zone` is a zones DataFrame with one row.
    """
    rows = positions
    if start_s is not None:
        rows = rows.where(F.col("t_s") >= start_s)
    if end_s is not None:
        rows = rows.where(F.col("t_s") <= end_s)
    # The searched box cut into grid cells, so that reports meet it by an equi-join; a report
    # lies in one cell only.
    box = F.col("bbox")

    def span(low: str, high: str) -> Column:
        first, last = box[low] - SEARCH_MARGIN, box[high] + SEARCH_MARGIN
        return F.sequence(F.floor(first / CELL_DEGREES).cast("int"), F.floor(last / CELL_DEGREES).cast("int"))

    shape = (
        with_edges(zone).select("edges", "bbox")
        .withColumn("_cell_lat", F.explode(span("min_lat", "max_lat")))
        .withColumn("_cell_lon", F.explode(span("min_lon", "max_lon")))
    )
    cell_lat, cell_lon = geo.grid_cell("latitude", "longitude", CELL_DEGREES)
    inside = geo.in_bbox("latitude", "longitude", box) & geo.point_in_edges("latitude", "longitude", F.col("edges"))
    near = (
        rows.withColumn("_cell_lat", cell_lat)
        .withColumn("_cell_lon", cell_lon)
        .join(shape, ["_cell_lat", "_cell_lon"])
        .where(geo.in_bbox("latitude", "longitude", box, SEARCH_MARGIN))
        .withColumn("inside", inside)
        .drop("edges", "bbox", "_cell_lat", "_cell_lon")
    )
    tracked = with_history(
        near, previous("_prev", "inside"), running_max("_entered", F.col("inside").cast("int")), counted=positions
    )
    return (
        tracked.withColumn("was_inside", F.coalesce(F.col("_prev.inside"), F.lit(False)))
        .withColumn("entered", F.col("_entered") == 1)
        .drop("_prev", "_entered")
    )


def crossings(track: DataFrame) -> DataFrame:
    """Entries and exits, in `crossing`."""
    kind = F.when(F.col("inside") & ~F.col("was_inside"), "entry").when(~F.col("inside") & F.col("was_inside"), "exit")
    return track.withColumn("crossing", kind).where(F.col("crossing").isNotNull())


def zone_visits(track: DataFrame, flag: Column) -> DataFrame:
    """One row per vessel that entered: attributes, visits, time and speeds in the zone."""
    order = F.struct("t_s", "row_id")
    entry = F.col("inside") & ~F.col("was_inside")
    exit_ = ~F.col("inside") & F.col("was_inside")
    name = F.trim(F.when(F.col("ship_name") != "", F.col("ship_name")))
    imo = ais.known_text("imo_number")
    speed = F.when(F.col("inside"), F.col("speed_over_ground"))
    seen = track.where("entered")
    visits = seen.groupBy("mmsi").agg(
        F.min_by(name, F.when(name.isNotNull(), order)).alias("ship_name"),
        F.min_by("ship_type", F.when(entry, order)).alias("ship_type"),
        F.min_by(imo, F.when(imo.isNotNull(), order)).alias("imo_number"),
        F.count_if(entry).alias("entries"),
        F.count_if(exit_).alias("exits"),
        F.min(F.when(entry, F.col("t_s"))).alias("first_entry_s"),
        F.max(F.when(exit_, F.col("t_s"))).alias("last_exit_s"),
        F.min_by(F.struct("latitude", "longitude"), F.when(entry, order)).alias("first_entry_at"),
        F.max_by(F.struct("latitude", "longitude"), F.when(exit_, order)).alias("last_exit_at"),
        F.max(F.when(entry, F.col("t_s"))).alias("_last_entry_s"),
        F.sum(F.when(entry, F.col("t_s"))).alias("_entry_sum"),
        F.sum(F.when(exit_, F.col("t_s"))).alias("_exit_sum"),
        F.count_if("inside").alias("reports_in_zone"),
        F.min(speed).alias("min_speed"),
        F.max(speed).alias("max_speed"),
        F.avg(speed).alias("avg_speed"),
        F.count_if(speed < 0.5).alias("_stopped"),
        F.count_if(F.col("inside") & F.col("nav_status").isin(1, 5)).alias("_anchored"),
    )
    # Entries and exits alternate, so the closed visits are all entries but an open last one.
    open_entry = F.when(F.col("entries") > F.col("exits"), F.col("_last_entry_s")).otherwise(0)
    minutes = (F.coalesce(F.col("_exit_sum"), F.lit(0)) - F.col("_entry_sum") + open_entry) / 60.0
    return visits.withColumn("minutes_in_zone", minutes).withColumn("flag_state", flag)


def indicators() -> Column:
    """Over zone_visits rows: array of what stands out, in the order of INDICATORS."""
    tests = [
        F.col("_stopped") >= 3,
        F.col("_anchored") > 0,
        F.col("avg_speed") < 3.0,
        F.col("flag_state").isin(dims.FLAGS_OF_CONVENIENCE),
        F.col("flag_state").isin(dims.HIGH_RISK_FLAGS),
        F.col("minutes_in_zone") > 30,
        (F.col("max_speed") > 0) & (F.col("min_speed") / F.nullif(F.col("max_speed"), F.lit(0.0)) < 0.3),
    ]
    return F.array_compact(F.array(*[F.when(t, n) for t, n in zip(tests, INDICATORS)]))


def flag_counts(vessels: DataFrame, flag: str = "flag_state") -> DataFrame:
    return (
        vessels.groupBy(F.coalesce(F.col(flag), F.lit("Unknown")).alias("flag"))
        .agg(F.count("*").alias("vessels"))
        .withColumn("category", ais.flag_category("flag"))
        .orderBy(F.desc("vessels"), "flag")
    )


def investigate_zone(
    positions: DataFrame,
    zones: DataFrame,
    zone_id: str,
    start_s: int | None = None,
    end_s: int | None = None,
    mids: list[tuple[str, str]] | None = None,
) -> Investigation:
    """Vessels that entered the zone, the timeline of crossings, flags and suspicious vessels."""
    track = zone_track(positions, zones.where(F.col("zone_id") == zone_id), start_s, end_s)
    visits = zone_visits(track, ais.flag_state("mmsi", "investigator", mids)).where(F.col("entries") > 0)
    vessels = (
        visits.withColumn("indicators", indicators())
        .drop("_last_entry_s", "_entry_sum", "_exit_sum", "_stopped", "_anchored")
        .orderBy("first_entry_s", "mmsi")
    )
    names = visits.select("mmsi", F.col("ship_name").alias("vessel_name"))
    timeline = (
        crossings(track)
        .join(names, "mmsi", "left")
        .select(
            "t_s", "row_id", F.upper("crossing").alias("event"), "mmsi", "vessel_name", "latitude", "longitude",
            F.col("speed_over_ground").alias("speed"), F.col("course_over_ground").alias("heading"), "nav_status",
        )
        .orderBy("t_s", "row_id")
    )
    suspicious = vessels.where(F.size("indicators") > 0)
    return Investigation(vessels, timeline, flag_counts(vessels), suspicious)


def report_lines(result: Investigation) -> DataFrame:
    """The vessel table of the report as text, one line per vessel, in order of first entry."""

    def number(c: str) -> Column:
        return F.coalesce(F.format_string("%.1f", F.when(F.col(c).isNotNull(), F.col(c))), F.lit("-"))

    found = F.when(F.size("indicators") > 0, F.array_join("indicators", ", ")).otherwise("-")
    line = F.format_string(
        "| %s | %s | %s | %d | %s min | %s | %s | %s |",
        F.col("mmsi"), F.coalesce(F.col("ship_name"), F.lit("Unknown")),
        F.coalesce(F.col("flag_state"), F.lit("??")), F.col("entries"), F.format_string("%.1f", F.col("minutes_in_zone")),
        F.when(F.col("min_speed").isNull(), "-").otherwise(number("min_speed")),
        F.when(F.col("avg_speed").isNull(), "-").otherwise(number("avg_speed")),
        found,
    )
    return result.vessels.select("first_entry_s", "mmsi", line.alias("line"))


def list_zones(zones: DataFrame) -> DataFrame:
    return zones.select("zone_id", "zone_name", "infrastructure_type", "severity")
