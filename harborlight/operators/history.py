"""Per-vessel ordered functions that split a busy vessel's history.

A window partitioned by vessel alone puts a vessel's whole history in one task, and one
(shared or faked) MMSI can own a large part of all reports. Here the rows are windowed by
(vessel, time slice), and what a row needs from earlier or later slices comes from a table with
one row per (vessel, slice), built with a map-side combined aggregate. That table is joined on
the same (vessel, slice) key, so the large side is exchanged once.

A slice is an hour long, and shorter where a vessel reports more than `slice_rows` an hour: see
slice_table().

    with_history(df, previous("prev", "t_s", "latitude"), running_sum("score", F.col("points")))
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.session import slice_rows, slice_seconds

ORDER = ("t_s", "row_id")
#: Keys are dealt into so many groups; all keys of a group have slices of one length.
GROUPS = 4096
MINUTE = 60


def _cols(names) -> Column:
    return F.struct(*[F.col(n) for n in names])


@dataclass(frozen=True)
class Feature:
    """A column `name` over the ordered history of a key.

    summary: one slice -> value (aggregate). carry: the value a slice receives from the
    others, over the slice table. local: the value within the slice, given the carry column.
    """

    name: str
    summary: Callable[[Column], Column]
    carry: Callable[[Column, object], Column]
    local: Callable[[Column, object], Column]


def previous(name: str, *cols: str) -> Feature:
    """struct(cols) of the report before."""
    return Feature(
        name,
        lambda order: F.max_by(_cols(cols), order),
        lambda s, slices: F.lag(s).over(slices),
        lambda c, w: F.coalesce(F.lag(_cols(cols)).over(w), c),
    )


def following(name: str, *cols: str) -> Feature:
    """struct(cols) of the report after."""
    return Feature(
        name,
        lambda order: F.min_by(_cols(cols), order),
        lambda s, slices: F.lead(s).over(slices),
        lambda c, w: F.coalesce(F.lead(_cols(cols)).over(w), c),
    )


def _to_date(w, inclusive: bool):
    return w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def _before(slices):
    return slices.rowsBetween(Window.unboundedPreceding, -1)


def running_sum(name: str, value: Column, inclusive: bool = True, zero=0) -> Feature:
    return Feature(
        name,
        lambda order: F.sum(value),
        lambda s, slices: F.sum(s).over(_before(slices)),
        lambda c, w: F.coalesce(c, F.lit(zero)) + F.coalesce(F.sum(value).over(_to_date(w, inclusive)), F.lit(zero)),
    )


def running_max(name: str, value: Column, inclusive: bool = True) -> Feature:
    return Feature(
        name,
        lambda order: F.max(value),
        lambda s, slices: F.max(s).over(_before(slices)),
        lambda c, w: F.greatest(c, F.max(value).over(_to_date(w, inclusive))),
    )


def first_seen(name: str, value: Column) -> Feature:
    """First non-null value up to and including the row."""
    return Feature(
        name,
        lambda order: F.min_by(value, F.when(value.isNotNull(), order)),
        lambda s, slices: F.first(s, ignorenulls=True).over(_before(slices)),
        lambda c, w: F.coalesce(c, F.first(value, ignorenulls=True).over(_to_date(w, True))),
    )


def last_seen(name: str, value: Column, inclusive: bool = True) -> Feature:
    """Latest non-null value up to the row."""
    return Feature(
        name,
        lambda order: F.max_by(value, F.when(value.isNotNull(), order)),
        lambda s, slices: F.last(s, ignorenulls=True).over(_before(slices)),
        lambda c, w: F.coalesce(F.last(value, ignorenulls=True).over(_to_date(w, inclusive)), c),
    )


def _group(key) -> Column:
    return F.pmod(F.hash(*key), F.lit(GROUPS))


def slice_table(counted: DataFrame, key, seconds: int, most: int) -> DataFrame:
    """One row with an array of struct(length, parts), an entry for each group of keys.

    A slice lasts as many minutes as hold `most` rows at the rate of the group's busiest minute,
    at most `seconds`. If that minute alone holds more, slices last a second, each cut by row
    number into `parts`. The array has GROUPS entries whatever the input, so it fits in a scalar
    subquery.
    """
    by_minute = counted.groupBy(*key, F.floor(F.col("t_s") / MINUTE).alias("_minute")).agg(F.count("*").alias("_n"))
    busiest = by_minute.groupBy(_group(key).alias("g")).agg(F.max("_n").alias("n"))
    # Groups that need no cutting are left out here and filled in below.
    busy = busiest.where(F.ceil(F.lit(seconds) / MINUTE) * F.col("n") > most)
    rates = busy.agg(F.map_from_entries(F.collect_list(F.struct("g", "n"))).alias("rates"))

    def cut(n: Column) -> Column:
        minutes = F.floor(F.lit(most) / n) * MINUTE
        length = F.when(n.isNull(), seconds).when(n > most, 1).otherwise(F.least(minutes, F.lit(seconds)))
        parts = F.when(n > most, F.ceil(n / most)).otherwise(1)
        return F.struct(length.cast("long").alias("length"), parts.cast("long").alias("parts"))

    groups = F.sequence(F.lit(0), F.lit(GROUPS - 1))
    return rates.select(F.transform(groups, lambda g: cut(F.element_at("rates", g))).alias("slices"))


def sliced(
    df: DataFrame, key=("mmsi",), order=ORDER, seconds: int | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """Add `_slice`: ascending in time, of at most about slice_rows() rows of one key.

    `counted` is a stored table that has at least as many rows of each key as `df`; counting it
    spares a second run of a dear `df`. Rows of one second are only cut by a whole number in the
    second place of `order`, and evenly if that is a fingerprint.
    """
    spark = df.sparkSession
    counted = df if counted is None else counted
    known = [k for k in key if k in counted.columns]
    table = slice_table(counted, known, seconds or slice_seconds(spark), slice_rows(spark))
    cut = F.get(table.scalar(), _group(known))
    rows = df.withColumn("_cut", cut)
    number = F.floor(F.col("t_s") / F.col("_cut.length")).cast("long")
    if len(order) > 1 and df.schema[order[1]].dataType.typeName() == "long":
        parts = F.col("_cut.parts")
        share = F.col(order[1]) / F.lit(2.0**64) + 0.5
        number = number * parts + F.least(parts - 1, F.floor(share * parts)).cast("long")
    return rows.withColumn("_slice", number).drop("_cut")


def with_history(
    df: DataFrame,
    *features: Feature,
    key=("mmsi",),
    order=ORDER,
    seconds: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add the features to every row. Keys and order columns must not be null. `counted`: see sliced()."""
    key = list(key)
    rows = sliced(df, key, order, seconds, counted)
    ordering = _cols(order)
    summary = rows.groupBy(*key, "_slice").agg(
        *[f.summary(ordering).alias(f"_s_{i}") for i, f in enumerate(features)]
    )
    slices = Window.partitionBy(*key).orderBy("_slice")
    carried = summary.select(
        *key,
        "_slice",
        *[f.carry(F.col(f"_s_{i}"), slices).alias(f"_c_{i}") for i, f in enumerate(features)],
    )
    w = Window.partitionBy(*key, "_slice").orderBy(*order)
    joined = rows.join(carried, [*key, "_slice"])
    return joined.select(
        *df.columns, *[f.local(F.col(f"_c_{i}"), w).alias(f.name) for i, f in enumerate(features)]
    )


def with_last_rows(
    df: DataFrame,
    name: str,
    n: int,
    *cols: str,
    key=("mmsi",),
    order=ORDER,
    seconds: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add an array of struct(cols) of the last `n` reports, this one included, oldest first."""
    key = list(key)
    rows = sliced(df, key, order, seconds, counted)
    newest = Window.partitionBy(*key, "_slice").orderBy(*[F.col(c).desc() for c in order])
    tail_item = F.struct(*[F.col(c) for c in order], _cols(cols).alias("_item"))
    tails = (
        rows.select(*key, "_slice", *order, *[c for c in cols if c not in (*key, *order)])
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= n - 1)
        .groupBy(*key, "_slice")
        .agg(F.transform(F.array_sort(F.collect_list(tail_item)), lambda t: t["_item"]).alias("_tail"))
    )
    slices = Window.partitionBy(*key).orderBy("_slice").rowsBetween(-(n - 1), -1)
    carried = tails.select(*key, "_slice", F.flatten(F.collect_list("_tail").over(slices)).alias("_carry"))
    w = Window.partitionBy(*key, "_slice").orderBy(*order).rowsBetween(-(n - 1), 0)
    here = F.collect_list(_cols(cols)).over(w)
    joined = rows.join(carried, [*key, "_slice"]).withColumn("_here", here)
    full = F.concat("_carry", "_here")
    last = F.slice(full, F.greatest(F.size(full) - n + 1, F.lit(1)), n)
    return joined.select(*df.columns, F.when(F.size("_here") >= n, F.col("_here")).otherwise(last).alias(name))


def with_islands(
    df: DataFrame,
    name: str,
    cols: list[str],
    starts: Callable[[Column, Column], Column],
    key=("mmsi",),
    order=ORDER,
    before: str | None = None,
    seconds: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add struct(cols) of the report that began the current run.

    `starts(previous, current)` takes two structs of `cols` and says whether a run begins at
    the current report; the first report of a key always begins one. `before` names a column
    for the previous report's struct. The first report of a slice is judged on the slice table,
    so one pass finds both the runs and their beginnings.
    """
    key = list(key)
    rows = sliced(df, key, order, seconds, counted)
    own, ordering = _cols(cols), _cols(order)
    w = Window.partitionBy(*key, "_slice").orderBy(*order)

    def judged(rows: DataFrame) -> DataFrame:
        seen = rows.withColumn("_own", own).withColumn("_lag", F.lag("_own").over(w))
        begins = F.col("_lag").isNotNull() & F.coalesce(starts(F.col("_lag"), F.col("_own")), F.lit(False))
        return seen.withColumn("_begin", F.when(begins, F.col("_own")))

    needed = list(dict.fromkeys([*key, "_slice", *order, *cols]))
    summary = (
        judged(rows.select(*needed))
        .groupBy(*key, "_slice")
        .agg(
            F.min_by("_own", ordering).alias("_first"),
            F.max_by("_own", ordering).alias("_last"),
            F.max_by("_begin", F.when(F.col("_begin").isNotNull(), ordering)).alias("_latest"),
        )
    )
    slices = Window.partitionBy(*key).orderBy("_slice")
    linked = summary.withColumn("_prev", F.lag("_last").over(slices))
    fresh = F.col("_prev").isNull() | F.coalesce(starts(F.col("_prev"), F.col("_first")), F.lit(False))
    headed = linked.withColumn("_head", F.when(fresh, F.col("_first"))).withColumn(
        "_open", F.last(F.coalesce("_latest", "_head"), ignorenulls=True).over(_before(slices))
    )
    carried = headed.select(*key, "_slice", "_prev", F.coalesce("_head", "_open").alias("_carry"))
    joined = judged(rows.join(carried, [*key, "_slice"]))
    begun = F.coalesce(F.last("_begin", ignorenulls=True).over(_to_date(w, True)), F.col("_carry"))
    extra = [F.coalesce("_lag", "_prev").alias(before)] if before else []
    return joined.select(*df.columns, begun.alias(name), *extra)
