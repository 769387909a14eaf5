"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Length of the time slices that split one vessel's history (see operators/history.py).
SLICE_CONF = "spark.harborlight.slice.seconds"
DEFAULT_SLICE_SECONDS = 3600
#: Slices of vessels that report more often than this are shorter.
SLICE_ROWS_CONF = "spark.harborlight.slice.rows"
DEFAULT_SLICE_ROWS = 1_000_000


def local_session(app: str = "harborlight", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return tune(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the queries count on; all can be changed at run time.

    Generated methods above 8000 bytes of bytecode are never compiled by HotSpot. The distance
    formulas reach that quickly, and Spark's per-operator code is then many times faster. A busy
    cell's reports are kept in memory during a merge join up to the given number of rows.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.sortMergeJoinExec.buffer.in.memory.threshold", "100000")
    return spark


def slice_seconds(spark: SparkSession) -> int:
    return int(spark.conf.get(SLICE_CONF, str(DEFAULT_SLICE_SECONDS)))


def slice_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(SLICE_ROWS_CONF, str(DEFAULT_SLICE_ROWS)))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return os.path.join(tempfile.gettempdir(), "harborlight-" + spark.sparkContext.applicationId)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where one result feeds many consumers: it cuts the lineage, survives the loss of an
    executor, and gives the consumers a columnar scan they can prune.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
