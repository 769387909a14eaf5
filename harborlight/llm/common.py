"""Small helpers shared by the operators."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object of any class, pickled by value; see held()."""
    return spark.sparkContext.broadcast({"pickled": cloudpickle.dumps(value)})


def held(shared: Broadcast) -> object:
    """The object behind share(). A worker process unpickles it once and keeps it from task to task."""
    place = shared.value
    if "object" not in place:
        place["object"] = pickle.loads(place["pickled"])
    return place["object"]


def parts_for(total: int | None, each: int, least: int = 12) -> int:
    """How many parts of about `each` units a total needs."""
    return max(least, -(-int(total or 0) // each))


def text_total(documents: DataFrame) -> int:
    """Bytes of all texts."""
    return documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def crc_remainder(column: str, divisor: int):
    """crc32 of a value as text, modulo a divisor; a null value counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def free_name(documents: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of `documents` has (names are compared without case)."""
    taken = {c.lower() for c in documents.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is hot where it has one row of so many; there can't be more hot keys than that.
HOT_SHARE = 1000


def look_up(rows: DataFrame, table: DataFrame, key: str, value: str, weight: str = "rows") -> DataFrame:
    """`rows` with the `value` that `table` has for their `key`, null where it has none.

    `table` has one row for each key, and in `weight` how many of the rows have it. The values of hot keys, at most
    HOT_SHARE of them at any size, are broadcast; their rows don't meet in one task. All others are joined by key.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.where((F.col(weight) * HOT_SHARE >= total) & (F.col(weight) > 1))
    hot = hot.select(F.col(key).alias("_hot"), F.struct(value).alias("_hot_value"))
    cold = table.select(F.col(key).alias("_cold"), F.struct(value).alias("_cold_value"))
    other = F.concat(F.lit("-"), F.xxhash64(*rows.columns).cast("string")).cast(rows.schema[key].dataType)
    spread = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(other)
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_spread", spread)
    found = found.join(cold, F.col("_spread") == F.col("_cold"), "left")
    return found.select(*rows.columns, F.coalesce(F.col("_hot_value")[value], F.col("_cold_value")[value]).alias(value))
