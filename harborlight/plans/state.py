"""Vessel state: what is known about a vessel at each report, and now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.functions import ais, geo
from harborlight.operators.history import Feature, first_seen, following, last_seen, previous, running_sum, with_history
from harborlight.session import written

KEEP_POSITIONS = 20
STATIC_COLUMNS = ["ship_type", "imo_number", "ship_name"]


def interval_features() -> list[Feature]:
    """What interval_means needs from with_history."""
    return [
        previous("_prev", "t_s"),
        first_seen("_first_t", F.col("t_s")),
        running_sum("message_count", F.lit(1).cast("long")),
    ]


def interval_means(rows: DataFrame, wanted: Column) -> DataFrame:
    """The `wanted` rows with `avg_interval_s`; `rows` carry interval_features().

    The mean is updated as (mean * n + gap) / (n + 1), and left alone when the gap is zero while
    n still grows. With s = mean * n that is s + gap, or s * (n + 1) / n for a zero gap: between
    zero gaps s just follows the clock. So only the wanted rows and the zero-gap rows take part:
    with p = the sum of ln((n + 1) / n) over the zero gaps so far, s = exp(p) * sum of (time
    since the row before * exp(-p before)).
    """
    stalled = F.col("_prev").isNotNull() & (F.col("t_s") <= F.col("_prev.t_s"))
    n = F.col("message_count").cast("double")
    few = written(
        rows.withColumn("_wanted", wanted)
        .withColumn("_grow", F.when(stalled, F.ln(n / F.greatest(n - 1, F.lit(1.0)))).otherwise(0.0))
        .where(F.col("_wanted") | stalled)
        .drop("_prev"),
        "intervals",
    )
    linked = with_history(
        few, previous("_before", "t_s"), running_sum("_p", F.col("_grow"), zero=0.0)
    )
    since = F.col("t_s") - F.coalesce(F.col("_before.t_s"), F.col("_first_t"))
    summed = with_history(
        linked.withColumn("_part", since * F.exp(F.col("_grow") - F.col("_p"))),
        running_sum("_sum", F.col("_part"), zero=0.0),
        counted=few,
    )
    mean = F.exp("_p") * F.col("_sum") / n
    return (
        summed.where("_wanted")
        .withColumn("avg_interval_s", mean)
        .drop("_wanted", "_grow", "_before", "_p", "_part", "_sum", "_first_t")
    )


def enrich_static(df: DataFrame, columns: list[str] = STATIC_COLUMNS, motion_only: bool = True) -> DataFrame:
    """Fill type, IMO and name from the vessel's earlier reports; keep reports that carry motion.

    Position reports carry no type or IMO and static reports no speed, so rules that need both
    see little on raw data.
    """
    filled = with_history(df, *[last_seen(f"_{c}", ais.known_text(c) if c != "ship_type" else F.col(c)) for c in columns])
    out = filled.select(*[F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])
    return out.where(F.col("speed_over_ground").isNotNull()) if motion_only else out


def vessel_state(df: DataFrame, keep: int = KEEP_POSITIONS) -> DataFrame:
    """One row per vessel: latest values, counts, mean interval and the last `keep` positions."""
    rows = with_history(
        df,
        *interval_features(),
        following("_next", "row_id"),
        *[last_seen(f"_{c}", F.col(c)) for c in STATIC_COLUMNS],
    )
    first_seen_s = F.col("_first_t").alias("first_seen")
    latest = interval_means(rows.select("*", first_seen_s), F.col("_next").isNull())
    summary = latest.select(
        "mmsi",
        *[F.col(f"_{c}").alias(c) for c in STATIC_COLUMNS],
        F.col("latitude").alias("last_latitude"),
        F.col("longitude").alias("last_longitude"),
        F.col("speed_over_ground").alias("last_speed"),
        F.col("course_over_ground").alias("last_course"),
        "first_seen",
        F.col("t_s").alias("last_seen"),
        "message_count",
        "avg_interval_s",
    )
    newest = Window.partitionBy("mmsi").orderBy(F.desc("t_s"), F.desc("row_id"))
    point = F.struct(
        "t_s",
        "row_id",
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        F.col("speed_over_ground").alias("speed"),
        F.col("course_over_ground").alias("course"),
    )
    # Ranking up to a constant is cut off within each partition before the exchange.
    recent = (
        df.withColumn("_n", F.row_number().over(newest))
        .where(F.col("_n") <= keep)
        .groupBy("mmsi")
        .agg(F.array_sort(F.collect_list(point)).alias("recent_positions"))
    )
    return summary.join(recent, "mmsi")


def is_potentially_dark(as_of: int, threshold_min: int = 30) -> Column:
    """Over vessel_state rows: silent for the threshold and for ten of its usual intervals."""
    gap = F.floor((F.lit(as_of) - F.col("last_seen")) / 60)
    usual = F.floor(F.col("avg_interval_s") / 60)
    regular = (F.col("message_count") > 10) & (F.col("avg_interval_s") > 0)
    return (gap >= threshold_min) & F.when(regular, gap > usual * 10).otherwise(F.lit(True))


def turn_count(courses: Column, degrees: float = 30) -> Column:
    """Changes of more than `degrees` between neighbouring courses of an array; nulls break a pair."""
    pairs = F.sequence(F.lit(1), F.greatest(F.size(courses) - 1, F.lit(1)))
    turns = F.filter(
        pairs,
        lambda i: geo.course_diff(F.get(courses, i - 1), F.get(courses, i)) > degrees,
    )
    return F.size(turns)


def mean_of(values: Column) -> Column:
    """Mean of the non-null items of an array; null when there are none."""
    known = F.filter(values, lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    return total / F.nullif(F.size(known), F.lit(0))


def exhibits_fishing_pattern(recent: Column) -> Column:
    """Over `recent_positions`: at least 10 points, slow on average, at least five turns."""
    speeds = F.transform(recent, lambda p: p["speed"])
    courses = F.transform(recent, lambda p: p["course"])
    return (F.size(recent) >= 10) & (F.coalesce(mean_of(speeds), F.lit(0.0)) < 5.0) & (turn_count(courses) >= 5)
