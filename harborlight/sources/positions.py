"""Position messages: raw feed -> normalised positions, batch reads by time, event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.functions.geo import _col, in_boxes

RAW_SCHEMA = (
    "MessageType string, MetaData struct<MMSI:bigint, ShipName:string, latitude:double, longitude:double, time_utc:string>, "
    "Message struct<"
    "PositionReport:struct<MessageID:int, Cog:double, Sog:double, TrueHeading:double, NavigationalStatus:int>, "
    "ShipStaticData:struct<MessageID:int, Name:string, Type:int, ImoNumber:bigint, CallSign:string, Destination:string, "
    "Eta:string, MaximumStaticDraught:double, Dimension:struct<A:int, B:int, C:int, D:int>>, "
    "StandardClassBPositionReport:struct<Cog:double, Sog:double, TrueHeading:double>>"
)
POSITION_SCHEMA = (
    "mmsi string, timestamp string, latitude double, longitude double, course_over_ground double, "
    "speed_over_ground double, heading double, nav_status int, ship_name string, ship_type int, imo_number string, "
    "call_sign string, destination string, eta string, draught double, dimension_a int, dimension_b int, "
    "dimension_c int, dimension_d int, message_type int, raw_message string"
)
# Message types and the collection area (south, west, north, east).
CLASS_B_MESSAGE = 18
INGEST_BOXES = [(54.0, 12.0, 61.0, 31.0)]


def parse_event_time(text) -> Column:
    """ISO with T and Z or offset, or with a blank and '+0000 UTC'; up to nine decimals. Else null."""
    plain = F.regexp_replace(_col(text), r" ?\+0000 UTC$| UTC$", "Z")
    return F.try_to_timestamp(F.regexp_replace(plain, r"(\.\d{6})\d+", "$1"))


def with_event_time(positions: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Add event_time, t_s (epoch seconds) and row_id, a fingerprint that orders equal times.

    Rows without a readable time keep null; the time-ordered operators need them filtered.
    """
    timed = positions.withColumn("event_time", parse_event_time(timestamp))
    return timed.withColumn("t_s", F.unix_seconds("event_time")).withColumn("row_id", F.xxhash64(*positions.columns))


def without_repeats(positions: DataFrame) -> DataFrame:
    """Each report once. Topics deliver at least once, and equal messages have equal row ids."""
    return positions.dropDuplicates(["mmsi", "t_s", "row_id"])


def normalize_ais(raw: DataFrame, message: str = "value") -> DataFrame:
    """Raw JSON feed messages -> POSITION_SCHEMA, in one pass over the nested struct.

    Position reports, static data and class B reports; other types and messages without an
    MMSI are dropped.
    """
    m = F.from_json(F.col(message), RAW_SCHEMA)
    rows = raw.select(m.alias("m"), F.col(message).alias("raw_message")).where(
        F.col("m.MetaData.MMSI").isNotNull()
        & F.col("m.MessageType").isin("PositionReport", "ShipStaticData", "StandardClassBPositionReport")
    )
    kind, meta = F.col("m.MessageType"), F.col("m.MetaData")
    report, static = F.col("m.Message.PositionReport"), F.col("m.Message.ShipStaticData")
    class_b = F.col("m.Message.StandardClassBPositionReport")
    is_report, is_static = kind == "PositionReport", kind == "ShipStaticData"

    def moving(field: str) -> Column:
        return F.when(is_report, report[field]).when(~is_static, class_b[field])

    def fixed(value: Column) -> Column:
        return F.when(is_static, value)

    name = F.when(is_static & (static["Name"] != ""), static["Name"]).otherwise(meta["ShipName"])
    size = static["Dimension"]
    return rows.select(
        meta["MMSI"].cast("string").alias("mmsi"),
        meta["time_utc"].alias("timestamp"),
        F.coalesce(meta["latitude"], F.lit(0.0)).alias("latitude"),
        F.coalesce(meta["longitude"], F.lit(0.0)).alias("longitude"),
        moving("Cog").alias("course_over_ground"),
        moving("Sog").alias("speed_over_ground"),
        moving("TrueHeading").alias("heading"),
        F.when(is_report, report["NavigationalStatus"]).alias("nav_status"),
        name.alias("ship_name"),
        fixed(static["Type"]).alias("ship_type"),
        fixed(F.when(static["ImoNumber"] != 0, static["ImoNumber"].cast("string"))).alias("imo_number"),
        fixed(static["CallSign"]).alias("call_sign"),
        fixed(static["Destination"]).alias("destination"),
        fixed(F.when(static["Eta"] != "", static["Eta"])).alias("eta"),
        fixed(static["MaximumStaticDraught"]).alias("draught"),
        *[fixed(size[side]).alias(f"dimension_{side.lower()}") for side in "ABCD"],
        F.when(is_report, F.coalesce(report["MessageID"], F.lit(1)))
        .when(is_static, F.coalesce(static["MessageID"], F.lit(5)))
        .otherwise(CLASS_B_MESSAGE)
        .alias("message_type"),
        "raw_message",
    )


def parse_positions(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON position messages -> POSITION_SCHEMA; unreadable ones and those without an MMSI are dropped."""
    rows = messages.select(F.from_json(F.col(value), POSITION_SCHEMA).alias("p")).select("p.*")
    filled = rows.fillna({"latitude": 0.0, "longitude": 0.0})
    return filled.where(F.col("mmsi").isNotNull() & (F.col("mmsi") != ""))


def unreadable(messages: DataFrame, value: str = "value") -> DataFrame:
    """The messages parse_positions drops."""
    mmsi = F.from_json(F.col(value), "mmsi string")["mmsi"]
    return messages.where(F.coalesce(mmsi, F.lit("")) == "")


def to_messages(positions: DataFrame, key: str = "mmsi") -> DataFrame:
    """Rows -> key and JSON value, as topics carry them."""
    return positions.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*positions.columns)).alias("value"))


def ingest_bbox(positions: DataFrame, boxes=INGEST_BOXES) -> DataFrame:
    return positions.where(in_boxes("latitude", "longitude", boxes))


def read_history(positions: DataFrame, start_s: int, end_s: int, time: str = "t_s") -> DataFrame:
    """Rows of a time range; rows without a readable time are kept. The range reaches the scan."""
    return positions.where(F.col(time).between(start_s, end_s) | F.col(time).isNull())


def read_history_topic(spark: SparkSession, options: dict[str, str], start_ms: int, end_ms: int) -> DataFrame:
    """A bounded read of a message topic by broker time."""
    return (
        spark.read.format("kafka").options(**options)
        .option("startingTimestamp", str(start_ms)).option("endingTimestamp", str(end_ms)).load()
    )


REPLAY_SCHEMA = (
    "metadata struct<vessel:string, mmsi:string, imo:string, flag:string>, "
    "track array<struct<timestamp:string, lat:double, lon:double, speed_kn:double, status:string, location:string, alert:string>>, "
    "ais_positions_for_replay array<struct<mmsi:string, timestamp:bigint, lat:double, lon:double, sog:double, cog:double, nav_status:int>>"
)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Stored tracks, a JSON document or a list of them per file."""
    return spark.read.schema(REPLAY_SCHEMA).option("multiLine", True).json(path)


def replay_positions(tracks: DataFrame) -> DataFrame:
    """The replay lists of stored tracks -> positions with t_s and row_id; `tracks` may be a stream of files."""
    rows = tracks.select("metadata", F.posexplode("ais_positions_for_replay").alias("row_id", "p"))
    return rows.select(
        F.col("row_id").cast("long").alias("row_id"),
        F.col("p.timestamp").alias("t_s"),
        F.lit(1).alias("message_type"),
        F.col("p.mmsi").alias("mmsi"),
        F.col("p.lat").alias("latitude"),
        F.col("p.lon").alias("longitude"),
        F.col("p.sog").alias("speed_over_ground"),
        F.col("p.cog").alias("course_over_ground"),
        F.lit(None).cast("double").alias("heading"),
        F.col("p.nav_status").alias("nav_status"),
        F.lit(None).cast("int").alias("ship_type"),
        F.col("metadata.vessel").alias("ship_name"),
        F.col("metadata.imo").alias("imo_number"),
    )


def read_replay_track(spark: SparkSession, path: str) -> DataFrame:
    """The replay list of a stored track -> positions with t_s and row_id."""
    return replay_positions(read_tracks(spark, path))


def tagged_waypoints(tracks: DataFrame) -> DataFrame:
    """Waypoints of stored tracks that carry an alert tag -> alert rows."""
    rows = tracks.select("metadata", F.posexplode("track").alias("i", "w")).where(F.col("w.alert") != "")
    tag = F.col("w.alert")
    severe = tag.contains("ANCHOR_DRAG") | tag.contains("CRITICAL")
    return rows.select(
        F.concat(F.lit("investigation-alert-"), F.col("i").cast("string")).alias("alert_id"),
        F.when(tag.contains("ANCHOR"), "ANCHOR_DRAG").otherwise("CABLE_PROXIMITY").alias("alert_type"),
        F.when(severe, "CRITICAL").otherwise("HIGH").alias("severity"),
        F.col("metadata.mmsi").alias("mmsi"),
        F.col("metadata.vessel").alias("vessel_name"),
        F.col("w.lat").alias("latitude"),
        F.col("w.lon").alias("longitude"),
        parse_event_time("w.timestamp").alias("detected_at"),
        F.translate(tag, "_", " ").alias("title"),
        F.format_string("%s. Speed: %s kts. Status: %s.", F.col("w.location"), F.col("w.speed_kn").cast("string"), F.col("w.status")).alias("description"),
    )


def investigation_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The tagged waypoints of a stored track as alerts."""
    return tagged_waypoints(read_tracks(spark, path))
