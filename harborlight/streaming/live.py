"""Streaming detectors and serving tables, built from the batch rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborlight.functions import geo
from harborlight.operators.zones import in_zones
from harborlight.plans.anchor import drag_cause
from harborlight.plans.cable import COOLDOWN_S, cable_candidates
from harborlight.plans.geofence import geofence_events
from harborlight.plans.sanctions_match import COOLDOWN_S as SANCTION_COOLDOWN_S
from harborlight.plans.sanctions_match import sanction_matches
from harborlight.plans.serving import TRAIL_POINTS
from harborlight.plans.spoofing import name_finding, report_findings, with_jump
from harborlight.plans.trajectory import COOLDOWN_S as TRAJECTORY_COOLDOWN_S
from harborlight.plans.trajectory import trajectory_candidates
from harborlight.session import written
from harborlight.streaming.stateful import throttle_stream, with_memory

TRAIL_KEEP_S = 72 * 3600
TRAIL_PARTS = 64


def geofence_stream(positions: DataFrame, zones: DataFrame) -> DataFrame:
    """Stream-static join; a static table that is re-read picks up new zones with each batch."""
    return geofence_events(positions, zones)


def cable_stream(positions: DataFrame, zones: DataFrame) -> DataFrame:
    return throttle_stream(cable_candidates(positions, zones), ["mmsi", "zone_id"], COOLDOWN_S)


def shadow_fleet_stream(positions: DataFrame, records: DataFrame) -> DataFrame:
    """Sanction matches under the cooldown; of several matches of one report the first stays."""
    return throttle_stream(sanction_matches(positions, records), ["mmsi"], SANCTION_COOLDOWN_S)


def trajectory_stream(positions: DataFrame, zones: DataFrame, **limits) -> DataFrame:
    """Vessels predicted to enter a cable zone, under the cooldown."""
    return throttle_stream(trajectory_candidates(positions, zones, **limits), ["mmsi", "zone_id"], TRAJECTORY_COOLDOWN_S)


def spoofing_stream(positions: DataFrame) -> DataFrame:
    """Failed checks of each report, by the batch rules over what is remembered: the report before, the first IMO and the names.

    Every failed check comes out; throttle_stream in a second query over the result gives the cooldown.
    """
    before = F.struct(F.col("prev_t").alias("t_s"), F.col("prev_lat").alias("latitude"), F.col("prev_lon").alias("longitude"))
    rows = with_memory(positions).withColumn("_prev", F.when(F.col("prev_t").isNotNull(), before))
    return report_findings(with_jump(rows), positions.columns, name_finding())


def anchor_stream(positions: DataFrame) -> DataFrame:
    """Reports that drag their anchor, with cause and drift, before the cooldown."""
    drift = geo.haversine_nm("anchor_lat", "anchor_lon", "latitude", "longitude")
    rows = with_memory(positions).where(F.col("anchor_row").isNotNull() & (F.col("anchor_row") != F.col("row_id")))
    return rows.withColumn("drift_nm", drift).withColumn("cause", drag_cause()).where(F.col("cause").isNotNull())


def positions_in_zones_stream(positions: DataFrame, zones: DataFrame) -> DataFrame:
    return in_zones(positions, zones, "zone_id", "zone_name", "zone_type")


def upsert_trails(batch: DataFrame, path: str, now_s: int, points: int = TRAIL_POINTS, parts: int = TRAIL_PARTS) -> None:
    """For foreachBatch: add a batch of track points to the trail table at `path`.

    Vessels are hashed into a fixed number of partitions and only the touched ones are
    rewritten. Per vessel the newest `points` of the last 72 hours stay. Running a batch again
    changes nothing, because points are distinct.
    """
    spark = batch.sparkSession
    columns = ["mmsi", "t_s", "row_id", "latitude", "longitude"]
    part = F.pmod(F.xxhash64("mmsi"), F.lit(parts)).cast("int")
    fresh = batch.select(*columns).withColumn("part", part)
    schema = "mmsi string, t_s bigint, row_id bigint, latitude double, longitude double, part int"
    try:
        stored = spark.read.schema(schema).parquet(path)
    except Exception as missing:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        stored = spark.createDataFrame([], schema)
    touched = stored.join(fresh.select("part").distinct(), "part", "left_semi").select(*columns, "part")
    newest = Window.partitionBy("part", "mmsi").orderBy(F.desc("t_s"), F.desc("row_id"))
    merged = (
        touched.unionByName(fresh).distinct()
        .where(F.col("t_s") >= now_s - TRAIL_KEEP_S)
        .withColumn("_n", F.row_number().over(newest))
        .where(F.col("_n") <= points)
        .drop("_n")
    )
    # Stored first: a partition cannot be overwritten while it is being read.
    (
        written(merged, "trails").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("part").parquet(path)
    )
