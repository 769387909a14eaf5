"""Register a Spark query together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.sqlparts import TEST_ZONES
from harborlight import dims
from harborlight.session import written
from harborlight.sources.derived import positions_from_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_STORED: dict[tuple[str, str, str], DataFrame] = {}


class Tables:
    """The given tables, and the positions derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(self, label: str, build: Callable[[], DataFrame]) -> DataFrame:
        """What `build` gives, written once per session and folder of tables and then read like any table."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, label)
        if key not in _STORED:
            _STORED[key] = written(build(), label)
        return _STORED[key]

    @property
    def positions(self) -> DataFrame:
        """The position table, derived from the events."""
        # Files by time, as a position table grows, and enough of them for every core.
        files = self.spark.sparkContext.defaultParallelism
        return self.stored(
            "positions", lambda: positions_from_events(self.spark, self.table("events")).repartitionByRange(files, "t_s")
        )

    @property
    def zones(self) -> DataFrame:
        return dims.zones(self.spark, [dims.box_zone(*z) for z in TEST_ZONES])


def register(name: str, sql: str | None = None):
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap
