"""Vessels that travel together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from harborlight.functions import geo
from harborlight.functions.alerts import to_alerts
from harborlight.operators.blocks import Pairs, angle, in_blocks
from harborlight.operators.history import with_islands
from harborlight.operators.pairs import neighbours, with_validity
from harborlight.operators.throttle import throttle
from harborlight.session import written

# Fixed values.
MIN_KNOTS = 1.0
STALE_S = 600
COOLDOWN_S = 3600
LARGE_CONVOY = 5
LONG_CONVOY_MIN = 60
NAMES_SHOWN = 3


PLACE = ["mmsi", "t_s", "row_id", "latitude", "longitude", "speed_over_ground", "course_over_ground"]
CREW = ["mark_1", "mark_2", "vessel_count"]


def tracked_reports(positions: DataFrame) -> DataFrame:
    """Reports with speed and course, their number and the vessel's next report; stored, as it is read repeatedly."""
    known = with_validity(positions.select(*PLACE, "ship_name")).where(
        F.col("speed_over_ground").isNotNull() & F.col("course_over_ground").isNotNull()
    )
    return written(known, "tracked")


def companions(looking: DataFrame, tracked: DataFrame, nm: float, dknots: float, dcourse: float) -> DataFrame:
    """Reports of `looking` with each vessel (`o_` columns) that moves alongside."""
    near = neighbours(looking.where(F.col("speed_over_ground") >= MIN_KNOTS), tracked, nm, STALE_S)
    return alongside(near, dknots, dcourse)


def alongside(near: DataFrame, dknots: float, dcourse: float) -> DataFrame:
    return near.where(
        (F.abs(F.col("o_speed_over_ground") - F.col("speed_over_ground")) <= dknots)
        & (geo.course_diff("o_course_over_ground", "course_over_ground") <= dcourse)
    )


def convoy_reports(
    tracked: DataFrame, nm: float = 3.0, dknots: float = 5.0, dcourse: float = 30.0, min_vessels: int = 2
) -> DataFrame:
    """Reports of a vessel in company: how many, mean speed and course, and marks of who.

    The marks are two 64-bit fingerprints of the set of MMSIs, the same for every member. They
    and the sums are taken where the companions are found, so no companion is moved.
    """
    report = ["mmsi", "t_s", "row_id", "seq", "speed_over_ground", "course_over_ground"]

    def run(table: pa.Table) -> pa.Table:
        pairs = Pairs(table, STALE_S)
        who = pc.dictionary_encode(table.column("mmsi").combine_chunks()).indices.to_numpy()
        names = ["latitude", "longitude", "speed_over_ground", "course_over_ground", "_1", "_2"]
        lat, lon, speed, course, mark_1, mark_2 = (pairs.array(c) for c in names)
        found = []
        for a, b in pairs.batches(both=False):
            # Cheap tests first.
            near = (who[a] != who[b]) & (np.abs(lat[a] - lat[b]) <= nm / 60 * 1.001) & (np.abs(speed[b] - speed[a]) <= dknots)
            a, b = a[near], b[near]
            turn = np.abs(course[b] - course[a])
            near = np.where(turn > 180, 360 - turn, turn) <= dcourse
            a, b = a[near], b[near]
            near = geo.EARTH_RADIUS_NM * angle(lat[a], lon[a], lat[b], lon[b]) <= nm
            a, b = a[near], b[near]
            if not len(a):
                continue
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            rows = table.select(report).take(pa.array(a[first]))
            sums = [np.diff(np.append(first, len(a)))]
            # Longer numbers, so that the order of companions does not show in the means.
            sums += [np.add.reduceat(v[b].astype(np.longdouble), first).astype(float) for v in (speed, course)]
            sums += [np.bitwise_xor.reduceat(m[b], first) for m in (mark_1, mark_2)]
            for name, values in zip(CREW_SUMS, sums):
                rows = rows.append_column(name, pa.array(values))
            found.append(rows)
        return pa.concat_tables(found) if found else empty

    schema = "mmsi string, t_s long, row_id long, seq long, speed_over_ground double, course_over_ground double"
    schema += ", _n long, _speeds double, _courses double, _1 long, _2 long"
    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    moving = tracked.select(*PLACE, "seq", "next_t", "next_row", *[_mark("mmsi", i).alias(f"_{i}") for i in (1, 2)])
    alike = in_blocks(moving.where(F.col("speed_over_ground") >= MIN_KNOTS), moving, nm, STALE_S, run, schema)
    together = alike.groupBy(*report).agg(
        *[F.sum(c).alias(c) for c in CREW_SUMS[:3]], *[F.bit_xor(c).alias(c) for c in CREW_SUMS[3:]]
    )
    return _amounts(together, report[:4], [], min_vessels)


#: Number of companions, sums of their speeds and courses, and fingerprints of who they are.
CREW_SUMS = ["_n", "_speeds", "_courses", "_1", "_2"]


def _mark(who: str, salt: int) -> Column:
    return F.xxhash64(F.col(who), F.lit(salt))


def crews(alike: DataFrame, report: list[str], min_vessels: int, *more: Column) -> DataFrame:
    """What the companions of each report amount to; `more` aggregates are kept as they are."""
    grouped = alike.groupBy(*report, "speed_over_ground", "course_over_ground").agg(
        F.count("*").alias("_n"),
        F.sum("o_speed_over_ground").alias("_speeds"),
        F.sum("o_course_over_ground").alias("_courses"),
        F.bit_xor(_mark("o_mmsi", 1)).alias("_1"),
        F.bit_xor(_mark("o_mmsi", 2)).alias("_2"),
        *more,
    )
    kept = [c for c in grouped.columns if not c.startswith("_") and c not in (*report, "speed_over_ground", "course_over_ground")]
    return _amounts(grouped, report, kept, min_vessels)


def _amounts(grouped: DataFrame, report: list[str], kept: list[str], min_vessels: int) -> DataFrame:
    """Count, means and marks of a report and its companions from CREW_SUMS."""
    n = F.col("_n") + 1
    return grouped.where(n >= min_vessels).select(
        *report, *kept,
        n.alias("vessel_count"),
        ((F.col("speed_over_ground") + F.col("_speeds")) / n).alias("mean_speed"),
        ((F.col("course_over_ground") + F.col("_courses")) / n).alias("mean_course"),
        F.col("_1").bitwiseXOR(_mark("mmsi", 1)).alias("mark_1"),
        F.col("_2").bitwiseXOR(_mark("mmsi", 2)).alias("mark_2"),
    )


def convoy_candidates(tracked: DataFrame, minutes: int = 3, **limits) -> DataFrame:
    """Reports in a convoy that lasted `minutes`, before the cooldown.

    The convoy holds while the vessel's successive reports, at most ten minutes apart, give the
    same members.
    """

    def breaks(p: Column, c: Column) -> Column:
        same = (p["mark_1"] == c["mark_1"]) & (p["mark_2"] == c["mark_2"]) & (p["vessel_count"] == c["vessel_count"])
        return ~(same & (p["seq"] == c["seq"] - 1) & (c["t_s"] - p["t_s"] <= STALE_S))

    # Stored, because finding the runs reads the reports twice and the join behind them is dear.
    together = written(convoy_reports(tracked, **limits), "convoys")
    runs = with_islands(together, "_start", ["t_s", "row_id", "seq", *CREW], breaks)
    return (
        runs.withColumn("duration_minutes", F.floor((F.col("t_s") - F.col("_start.t_s")) / 60))
        .where((F.col("row_id") != F.col("_start.row_id")) & (F.col("duration_minutes") >= minutes))
        .drop("_start")
    )


def convoy_events(
    positions: DataFrame, minutes: int = 3, nm: float = 3.0, dknots: float = 5.0, dcourse: float = 30.0, min_vessels: int = 2
) -> DataFrame:
    """Alerts with convoy_id and members; only the alerting reports look up who their members are."""
    tracked = tracked_reports(positions)
    candidates = convoy_candidates(
        tracked, minutes, nm=nm, dknots=dknots, dcourse=dcourse, min_vessels=min_vessels
    )
    # Two members can report in the same second; the lower row number goes first.
    kept = written(throttle(candidates, CREW, COOLDOWN_S), "convoy-alerts")

    def member(prefix: str) -> Column:
        return F.struct(
            F.col(f"{prefix}mmsi").alias("mmsi"),
            F.col(f"{prefix}ship_name").alias("name"),
            F.col(f"{prefix}speed_over_ground").alias("speed"),
            F.col(f"{prefix}course_over_ground").alias("course"),
        )

    report = ["mmsi", "t_s", "row_id"]
    looking = tracked.join(kept.select(*report), report, "left_semi").select(*PLACE, "ship_name")
    who = (
        companions(looking, tracked.drop("seq"), nm, dknots, dcourse)
        .groupBy(*report)
        .agg(F.first(member("")).alias("_own"), F.collect_list(member("o_")).alias("_others"))
    )
    ids = F.array_append(F.transform("_others", lambda m: m["mmsi"]), F.col("mmsi"))
    return graded(
        kept.join(who, report)
        .withColumn("convoy_id", F.array_join(F.array_sort(ids), "-"))
        .withColumn("members", F.concat(F.array("_own"), F.array_sort("_others")))
        .drop("_own", "_others", "mark_1", "mark_2")
        .join(positions, report)
    )


def graded(events: DataFrame) -> DataFrame:
    """Severity and title of reports that alert."""
    large = (F.col("vessel_count") >= LARGE_CONVOY) | (F.col("duration_minutes") >= LONG_CONVOY_MIN)
    return events.withColumn("severity", F.when(large, "HIGH").otherwise("MEDIUM")).withColumn("title", F.lit("Convoy Detected"))


def member_names(members, shown: int = NAMES_SHOWN):
    """First few names, then how many more."""
    names = F.transform(F.slice(members, 1, shown), lambda m: F.coalesce(m["name"], m["mmsi"]))
    more = F.size(members) - shown
    return F.concat(F.array_join(names, ", "), F.when(more > 0, F.concat(F.lit(" +"), more, F.lit(" more"))).otherwise(""))


def detect_convoy(positions: DataFrame, nm: float = 3.0, minutes: int = 3, **limits) -> DataFrame:
    return convoy_alerts(convoy_events(positions, minutes, nm, **limits), nm)


def convoy_alerts(events: DataFrame, nm: float = 3.0) -> DataFrame:
    text = F.format_string(
        "%d vessels traveling together at %.1f kts, course %.0f° for %d minutes: %s",
        F.col("vessel_count"), F.col("mean_speed"), F.col("mean_course"), F.col("duration_minutes"),
        member_names(F.col("members")),
    )
    return to_alerts(
        events,
        "CONVOY",
        text,
        {
            "convoy_id": "convoy_id",
            "vessel_count": "vessel_count",
            "duration_minutes": "duration_minutes",
            "average_speed": F.round("mean_speed", 1),
            "average_course": F.floor(F.col("mean_course") + 0.5),
            "members": "members",
            "proximity_nm": F.lit(nm),
        },
        subject=F.col("convoy_id"),
    )
