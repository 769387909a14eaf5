"""Streaming reads and writes of positions, reference messages and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from harborlight.sources.positions import parse_positions, to_messages, with_event_time

POSITIONS_TOPIC, REFERENCE_TOPIC, SANCTIONS_TOPIC = "ais-raw", "reference-data", "sanctions"
ALERTS_TOPIC, ENRICHED_TOPIC = "alerts", "ais-enriched"
LATENESS = "10 minutes"


def read_topic(spark: SparkSession, topic: str, options: dict[str, str], starting: str = "latest") -> DataFrame:
    """A topic as key, value (text) and offset. `maxOffsetsPerTrigger` in the options limits the rate."""
    raw = (
        spark.readStream.format("kafka").options(**options)
        .option("subscribe", topic).option("startingOffsets", starting).load()
    )
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), "offset")


def read_folder(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """JSON lines files in a folder, one message per line, in the shape of read_topic."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(F.lit(None).cast("string").alias("key"), "value", F.lit(0).cast("long").alias("offset"))


def positions_stream(messages: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Messages -> positions with event time and watermark; rows without a readable time are left out.

    A message delivered again within the lateness counts once.
    """
    timed = with_event_time(parse_positions(messages))
    kept = timed.where(F.col("event_time").isNotNull()).withWatermark("event_time", lateness)
    return kept.dropDuplicatesWithinWatermark(["mmsi", "t_s", "row_id"])


def read_positions_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return positions_stream(read_topic(spark, POSITIONS_TOPIC, options))


def read_reference_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return read_topic(spark, REFERENCE_TOPIC, options, starting="earliest")


def read_sanctions_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return read_topic(spark, SANCTIONS_TOPIC, options, starting="earliest")


def write_topic(df: DataFrame, topic: str, options: dict[str, str], checkpoint: str, key: str = "mmsi") -> DataStreamWriter:
    """Rows as JSON to a topic, at least once."""
    return (
        to_messages(df, key).writeStream.format("kafka").options(**options)
        .option("topic", topic).option("checkpointLocation", checkpoint).trigger(processingTime="10 seconds")
    )


def write_alerts_stream(alerts: DataFrame, options: dict[str, str], checkpoint: str) -> DataStreamWriter:
    return write_topic(alerts, ALERTS_TOPIC, options, checkpoint)


def write_positions_stream(positions: DataFrame, options: dict[str, str], checkpoint: str) -> DataStreamWriter:
    return write_topic(positions, ENRICHED_TOPIC, options, checkpoint)


def write_table(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Rows appended to a parquet table, exactly once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def alert_log(alerts: DataFrame, checkpoint: str) -> DataStreamWriter:
    return alerts.writeStream.format("console").option("truncate", False).option("checkpointLocation", checkpoint)


def vessel_change_feed(positions: DataFrame) -> DataFrame:
    """Latest report time and place per vessel; in update mode only vessels that changed come out."""
    latest = F.max_by(F.struct("latitude", "longitude", "speed_over_ground"), F.struct("t_s", "row_id"))
    return positions.groupBy("mmsi").agg(F.max("t_s").alias("t_s"), latest.alias("report"))
