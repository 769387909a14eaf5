"""Zones and sanctions that arrive as messages while positions are being read.

One query keeps the last message of each key, as a new version of a table with each batch of messages; a query over
positions takes the newest whole version with each batch of its own. A change takes effect without a restart, and a batch
that is run again gives the same version and the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

MESSAGES = "key string, value string, offset long"
#: Versions left for readers that have just begun; older ones are removed.
KEEP_VERSIONS = 20
#: Offsets count within a batch; later batches come after earlier ones.
BATCH_SPAN = 1 << 40


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions at `path`, ascending."""
    fs, done = _files(spark, f"{path}/version=*/_SUCCESS")
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(done) or [])


def newest(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """Messages (key, value, offset), one per key, of the newest version; none before the first one."""
    found = [v for v in versions(spark, path) if below is None or v < below]
    if not found:
        return spark.createDataFrame([], MESSAGES)
    return spark.read.schema(MESSAGES).parquet(f"{path}/version={found[-1]:012d}")


def keep_newest(messages: DataFrame, path: str, checkpoint: str, key: str = "key") -> DataStreamWriter:
    """Messages (`key`, value, offset) of a stream into versions at `path`; a null value takes a key away.

    Messages without a key are kept by their content. The table is as long as there are keys.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = F.coalesce(F.col(key), F.sha2(F.coalesce("value", F.lit("")), 256))
        fresh = batch.select(name.alias("key"), "value", (F.lit(batch_id) * F.lit(BATCH_SPAN) + F.col("offset")).alias("offset"))
        # Messages of one offset, as files have them, are ordered by content.
        order = F.struct("offset", "value")
        last = newest(spark, path, below=batch_id).unionByName(fresh).groupBy("key").agg(F.max_by(F.struct("value", "offset"), order).alias("m"))
        last.select("key", "m.*").where("value is not null").write.mode("overwrite").parquet(f"{path}/version={batch_id:012d}")
        for old in versions(spark, path)[:-KEEP_VERSIONS]:
            fs, place = _files(spark, f"{path}/version={old:012d}")
            fs.delete(place, True)

    return messages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def with_newest(
    positions: DataFrame, path: str, detect: Callable[[DataFrame, DataFrame], DataFrame], out: str, checkpoint: str
) -> DataStreamWriter:
    """detect(positions of a batch, newest messages) into the folder `out`, a part for each batch, each written once.

    The rules used here look at one report only; what they find is a stream again when `out` is read as one, and
    throttle_stream over it gives the cooldown.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        detect(batch, newest(batch.sparkSession, path)).write.mode("overwrite").parquet(f"{out}/batch={batch_id:012d}")

    return positions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
