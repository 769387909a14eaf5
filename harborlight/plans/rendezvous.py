"""Ship-to-ship meetings at open sea."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from harborlight import dims
from harborlight.functions import ais, geo
from harborlight.functions.alerts import or_unknown, to_alerts
from harborlight.functions.geo import METERS_PER_NM
from harborlight.operators.blocks import Pairs, angle, in_blocks
from harborlight.operators.history import following, previous, with_history
from harborlight.operators.pairs import bucket_of, buckets, valid_at
from harborlight.session import written

# Fixed values.
MAX_KNOTS = 5.0
STALE_S = 600
FORGET_S = 7200
CELL = 0.1


def eligible(port_nm: float, ports=dims.OPEN_SEA_PORTS) -> Column:
    """Slow or without speed, and at open sea."""
    slow = F.coalesce(F.col("speed_over_ground") <= MAX_KNOTS, F.lit(True))
    return slow & geo.is_open_sea("latitude", "longitude", ports, port_nm)


PAIR_COLUMNS = [
    "mmsi", "t_s", "row_id", "latitude", "longitude", "speed_over_ground", "ship_type", "ship_name", "imo_number",
]
PREVIOUS_REPORT = ["t_s", "row_id", "latitude", "longitude", "able"]


def eligible_reports(positions: DataFrame, port_nm: float) -> DataFrame:
    """Reports that can meet, each with the vessel's report before (`prev_`) and the time of the one after (`next_`).

    Stored, because the pair join and the search for partings read it several times.
    """
    rows = with_history(
        positions.select(*PAIR_COLUMNS).withColumn("able", eligible(port_nm)),
        previous("_prev", *PREVIOUS_REPORT),
        following("_next", "t_s", "row_id"),
    ).where("able")
    short = {"t_s": "t", "row_id": "row", "latitude": "lat", "longitude": "lon", "able": "able"}
    sides = [F.col(f"_prev.{c}").alias(f"prev_{n}") for c, n in short.items()]
    sides += [F.col("_next.t_s").alias("next_t"), F.col("_next.row_id").alias("next_row")]
    return written(rows.select(*PAIR_COLUMNS, *sides), "eligible")


def _before(t1: Column, row1: Column, t2: Column, row2: Column) -> Column:
    return (t1 < t2) | ((t1 == t2) & (row1 < row2))


def distance_m() -> Column:
    return geo.haversine_m("latitude", "longitude", "o_latitude", "o_longitude")


def step_before(dist_m: float) -> Column:
    """What the pair did one step earlier, when the later of the two reports before this one came in.

    "goes_on" (in contact), "starts" (seen apart), or "unsure" (nothing was seen). That step compares this vessel's report
    before with the other vessel's current one, whichever came first, so it needs no ordering of the pair's contacts.
    """
    c = F.col
    earlier_m = geo.haversine_m("prev_lat", "prev_lon", "o_latitude", "o_longitude")
    seen_earlier = F.coalesce(c("prev_able") & (F.abs(c("prev_t") - c("o_t_s")) < STALE_S), F.lit(False))
    close_cells = in_adjacent_cells("prev_lat", "prev_lon", "o_latitude", "o_longitude")
    return (
        F.when(seen_earlier & (earlier_m <= dist_m), "goes_on")
        .when(seen_earlier & close_cells, "starts")
        .otherwise("unsure")
    )


def in_adjacent_cells(lat: str, lon: str, o_lat: str, o_lon: str) -> Column:
    """Only vessels in adjacent cells are seen to be apart."""
    this, that = geo.grid_cell(lat, lon, CELL), geo.grid_cell(o_lat, o_lon, CELL)
    return (F.abs(this[0] - that[0]) <= 1) & (F.abs(this[1] - that[1]) <= 1)


def alert_soon() -> Column:
    """A tanker takes part, or a cargo and a fishing vessel meet."""
    tanker = ais.is_tanker("ship_type") | ais.is_tanker("o_ship_type")
    cargo = ais.is_cargo("ship_type") | ais.is_cargo("o_ship_type")
    fishing = ais.is_fishing("ship_type") | ais.is_fishing("o_ship_type")
    return tanker | (cargo & fishing)


#: A contact within a stretch, and contacts and metres of the stretch up to it; `low`: `lo` is the reporting vessel.
CONTACT = (
    "struct<t_s: long, row_id: long, low: boolean, ship_type: int, o_t_s: long, o_row_id: long, "
    "o_ship_type: int, soon: boolean, contacts: long, meters: double>"
)
STRETCH = "lo string, hi string, t_s long, row_id long, begins string, last_t long, last_row long, contacts long, meters double"
TOLD = f", told {CONTACT}, head array<{CONTACT}>"
LINKS = pa.array(["goes_on", "starts", "unsure"])


def stretches(able: DataFrame, dist_m: float, minutes: int, told: bool) -> DataFrame:
    """Contacts of a pair in order, summed up between those where an encounter may begin.

    A contact is a report and a vessel within `dist_m` of it. `begins` is the link of a stretch's first contact (see
    step_before): starts, unsure, or goes_on where a stretch only carries on the one before, which it does at the turn of
    an hour and where vessel `lo` comes into another cell. So contacts are summed up where they are found and none is moved.
    With `told`: `told` is the first contact to alert if the encounter begins with the stretch. If it began earlier, `head`
    has the answer: those contacts of the first minutes, and the one after them, that alert for some beginning for which no
    earlier one does. A stretch that neither alerts nor is carried on is left out where the next one shows that.
    """
    late = 120 * minutes
    meters_of = geo.EARTH_RADIUS_M
    # The radius in NM is on a slightly different sphere; a margin keeps the exact test in metres.
    nm = dist_m / METERS_PER_NM * 1.01

    def run(table: pa.Table) -> pa.Table:
        pairs = Pairs(table, STALE_S)
        vessels = pc.dictionary_encode(table.column("mmsi").combine_chunks())
        names = vessels.dictionary
        place = np.empty(len(names), np.int64)
        place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        who = place[vessels.indices.to_numpy()]
        t, lat, lon, kind = (pairs.array(c) for c in ("t_s", "latitude", "longitude", "kind"))
        prev_t, prev_lat, prev_lon = (pairs.numbers(c) for c in ("prev_t", "prev_lat", "prev_lon"))
        prev_able = table.column("prev_able").fill_null(False).to_numpy()
        row = table.column("row_id").fill_null(-1).to_numpy()
        prev_row = table.column("prev_row").fill_null(-2).to_numpy()
        cells = [np.floor(x / CELL) for x in (lat, lon, prev_lat, prev_lon)]
        moments = int(pairs.rank.max()) + 1
        found = []
        for a, b in pairs.batches(both=True):
            right = pairs.right[a]
            lo, hi = np.where(right, b, a), np.where(right, a, b)
            near = np.flatnonzero((who[lo] < who[hi]) & (np.abs(lat[a] - lat[b]) <= nm / 60 * 1.001))
            a, b, lo, hi = a[near], b[near], lo[near], hi[near]
            meters = meters_of * angle(lat[a], lon[a], lat[b], lon[b])
            near = np.flatnonzero(meters <= dist_m)
            if not len(near):
                continue
            # In the order of pair and time.
            near = near[np.argsort((who[lo[near]] * len(names) + who[hi[near]]) * moments + pairs.rank[a[near]], kind="stable")]
            a, b, lo, hi, meters = a[near], b[near], lo[near], hi[near], meters[near]
            n, low = len(a), lo == a
            seen = prev_able[a] & (np.abs(prev_t[a] - t[b]) < STALE_S)
            close = seen & (meters_of * angle(prev_lat[a], prev_lon[a], lat[b], lon[b]) <= dist_m)
            adjacent = (np.abs(cells[2][a] - cells[0][b]) <= 1) & (np.abs(cells[3][a] - cells[1][b]) <= 1)
            link = np.where(close, 0, np.where(seen & adjacent, 1, 2))
            begin = link != 0
            begin[0] = True
            begin[1:] |= (who[lo[1:]] != who[lo[:-1]]) | (who[hi[1:]] != who[hi[:-1]]) | (pairs.block[lo[1:]] != pairs.block[lo[:-1]])
            # Another report of `lo` in between was in another cell, where it has contacts of its own.
            begin[1:] |= (lo[1:] != lo[:-1]) & ((prev_t[lo[1:]] != t[lo[:-1]]) | (prev_row[lo[1:]] != row[lo[:-1]]))
            first = np.flatnonzero(begin)
            of = np.cumsum(begin) - 1
            last = np.append(first[1:], n) - 1
            total = np.cumsum(meters)
            counts, sums = np.arange(n) - first[of] + 1, total - (total - meters)[first[of]]

            def of_report(name: str, rows: np.ndarray) -> pa.Array:
                return table.column(name).take(pa.array(rows)).combine_chunks()

            if told:
                both = kind[a] | kind[b]
                soon = (both & 1 > 0) | (both & 6 == 6)
                age = t[a] - t[a[first[of]]]
                alerts = (age // 60 >= minutes) & (soon | (age // 60 >= 2 * minutes))
                tells = np.minimum.reduceat(np.where(alerts, np.arange(n), n), first)
                # The first contact after the first minutes is one that has a predecessor within them, or begins the stretch.
                within = age < late
                head = within | (age >= late) & np.append(True, within[:-1])
                head &= (link != 1)[first[of]]
                # Contact k alerts if the encounter began by `by`, so it is asked only if that is later than for those before,
                # and if they do not yet alert for the latest beginning there can be, the stretch's first contact.
                at = np.flatnonzero(head)
                by = t[a[at]] - np.where(soon[at], 60 * minutes, late) - t[a[first[of[at]]]]
                known_by = np.maximum.accumulate((of[at] << 34) + (1 << 33) + by)
                before = np.append(-1, known_by[:-1])[:len(at)]
                head[at] = (known_by > before) & (before - (of[at] << 34) < 1 << 33)
                # Nothing lies between two stretches of a block if the first vessel has no report between them in another cell.
                x, y = last[:-1], first[1:]
                joined = (who[lo[y]] == who[lo[x]]) & (who[hi[y]] == who[hi[x]]) & (pairs.block[lo[y]] == pairs.block[lo[x]])
                joined &= (lo[y] == lo[x]) | ((prev_t[lo[y]] == t[lo[x]]) & (prev_row[lo[y]] == row[lo[x]]))
                over = (link[first] == 1) & (tells == n) & np.append(joined & (link[y] == 1), False)
                first, last, tells = first[~over], last[~over], tells[~over]
                heads = np.bincount(of[head], minlength=len(over))[~over]

            columns = [
                of_report("mmsi", lo[first]), of_report("mmsi", hi[first]), of_report("t_s", a[first]), of_report("row_id", a[first]),
                LINKS.take(pa.array(link[first])), of_report("t_s", a[last]), of_report("row_id", a[last]),
                pa.array(last - first + 1), pa.array(sums[last]),
            ]
            if told:
                def contact(at: np.ndarray) -> pa.StructArray:
                    values = {
                        "t_s": of_report("t_s", a[at]), "row_id": of_report("row_id", a[at]), "low": pa.array(low[at]),
                        "ship_type": of_report("ship_type", a[at]), "o_t_s": of_report("t_s", b[at]), "o_row_id": of_report("row_id", b[at]),
                        "o_ship_type": of_report("ship_type", b[at]), "soon": pa.array(soon[at]),
                        "contacts": pa.array(counts[at]), "meters": pa.array(sums[at]),
                    }
                    return pa.StructArray.from_arrays(list(values.values()), list(values))

                none = tells == n
                offsets = np.concatenate(([0], np.cumsum(heads)))
                columns.append(contact(tells[~none]).take(pa.array(np.cumsum(~none) - 1, mask=none)))
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), contact(np.flatnonzero(head))))
            found.append(pa.RecordBatch.from_arrays(columns, names=fields))
        return pa.Table.from_batches(found) if found else empty

    schema = STRETCH + (TOLD if told else "")
    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    fields = empty.column_names
    kinds = F.when(ais.is_tanker("ship_type"), 1).when(ais.is_cargo("ship_type"), 2).when(ais.is_fishing("ship_type"), 4).otherwise(0)
    rows = able.select(
        "mmsi", "t_s", "row_id", "latitude", "longitude", "ship_type", kinds.alias("kind"),
        "prev_t", "prev_row", "prev_lat", "prev_lon", "prev_able", "next_t", "next_row",
    )
    return in_blocks(rows, rows, nm, STALE_S, run, schema, radii=4, whole_pairs=True)


def _partings(gaps: DataFrame, able: DataFrame, dist_m: float) -> DataFrame:
    """The gaps (lo, hi, t_s, row_id) in which some report saw the other vessel beyond `dist_m`.

    A gap lies between two contacts of a pair; `from_t`, `from_row` is the earlier one. Few rows,
    joined to the reports of the two vessels by vessel and time.
    """
    hour = 3600
    sides = gaps.select(
        "lo", "hi", "t_s", "row_id", "from_t", "from_row",
        F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")),
                          F.struct(F.col("hi").alias("a"), F.col("lo").alias("b")))).alias("v"),
    ).select(
        "lo", "hi", "t_s", "row_id", "from_t", "from_row", F.col("v.a").alias("x_mmsi"), F.col("v.b").alias("y_mmsi"),
        F.explode(F.sequence(F.floor(F.col("from_t") / hour), F.floor(F.col("t_s") / hour))).alias("hour"),
    )
    place = ["mmsi", "t_s", "row_id", "latitude", "longitude"]
    looking = able.select(*[F.col(c).alias(f"x_{c}") for c in place], F.floor(F.col("t_s") / hour).alias("hour"))
    after = _before(F.col("from_t"), F.col("from_row"), F.col("x_t_s"), F.col("x_row_id"))
    before = _before(F.col("x_t_s"), F.col("x_row_id"), F.col("t_s"), F.col("row_id"))
    between = (
        sides.join(looking, ["x_mmsi", "hour"]).where(after & before).withColumn("bucket", bucket_of(F.col("x_t_s")))
    )
    seen = able.select(
        *[F.col(c).alias(f"y_{c}") for c in [*place, "next_t", "next_row"]], F.explode(buckets(STALE_S)).alias("bucket")
    )
    apart = geo.haversine_m("x_latitude", "x_longitude", "y_latitude", "y_longitude") > dist_m
    return (
        between.join(seen, ["y_mmsi", "bucket"])
        .where(valid_at("y_", F.col("x_t_s"), F.col("x_row_id"), STALE_S))
        .where(in_adjacent_cells("x_latitude", "x_longitude", "y_latitude", "y_longitude") & apart)
        .select("lo", "hi", "t_s", "row_id")
        .distinct()
    )


def _parted(known: DataFrame, able: DataFrame, dist_m: float) -> DataFrame:
    """The unsure stretches (lo, hi, t_s, row_id) before which some report saw the vessels apart.

    Only those are asked that could carry on the encounter before, whose last contact is at most two hours back.
    """
    pair = ["lo", "hi"]
    earlier = F.lag(F.struct("last_t", "last_row")).over(Window.partitionBy(*pair).orderBy("t_s", "row_id"))
    found = known.select(*pair, "t_s", "row_id", "begins", "last_t", "last_row").withColumn("_before", earlier)
    gaps = found.where((F.col("begins") == "unsure") & (F.col("t_s") - F.col("_before.last_t") <= FORGET_S)).select(
        *pair, "t_s", "row_id", F.col("_before.last_t").alias("from_t"), F.col("_before.last_row").alias("from_row")
    )
    return _partings(written(gaps, "gaps"), able, dist_m)


ENCOUNTER = ["lo", "hi", "started_s", "started_row"]


def encounter_stretches(
    positions: DataFrame, dist_m: float = 1500, minutes: int = 3, port_nm: float = 30, told: bool = True
) -> DataFrame:
    """Stretches with `started_s`, `started_row`: the first contact of their encounter, and its sums before them (`so_far_`).

    An encounter ends when a report of either vessel sees the other beyond `dist_m`, or after two hours without contact.
    Contacts are summed up where they are found; what is stored are stretches, with the contacts to alert if `told`. They
    are moved once, by pair, and stay so for all that follows.
    """
    able = eligible_reports(positions, port_nm)
    known = written(stretches(able, dist_m, minutes, told), "stretches")
    parted = _parted(known, able, dist_m).withColumn("_parted", F.lit(True))
    rows = known.drop("last_row").withColumn("_parted", F.lit(False)).unionByName(parted, allowMissingColumns=True)
    rows = rows.repartition("lo", "hi")
    # A parted key comes before the stretches that have it. Such keys are few; most unsure stretches carry on.
    in_time = Window.partitionBy("lo", "hi").orderBy("t_s", "row_id", F.desc("_parted"))
    before = in_time.rowsBetween(Window.unboundedPreceding, -1)
    to_date = in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.struct("t_s", "row_id")
    noted = rows.select(
        "*", F.last(F.when(F.col("_parted"), key), ignorenulls=True).over(to_date).alias("_noted"),
        F.last("last_t", ignorenulls=True).over(before).alias("_before_t"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("contacts", "meters")],
    ).where(~F.col("_parted"))
    recent = F.coalesce(F.col("t_s") - F.col("_before_t") <= FORGET_S, F.lit(False)) & F.col("row_id").isNotNull()
    goes_on = recent & ~F.coalesce(F.col("_noted") == key, F.lit(False))
    starts = (F.col("begins") == "starts") | ((F.col("begins") == "unsure") & ~goes_on)
    first = F.when(F.col("_starts"), F.struct("t_s", "row_id", "_contacts", "_meters"))
    begun = noted.withColumn("_starts", starts).withColumn("_start", F.last(first, ignorenulls=True).over(to_date))
    begun = begun.drop("_noted", "_before_t", "_parted", "begins")
    return begun.select(
        *[c for c in begun.columns if c not in ("_start", "_contacts", "_meters")],
        F.col("_start.t_s").alias("started_s"), F.col("_start.row_id").alias("started_row"),
        *[(F.col(f"_{c}") - F.col(f"_start._{c}")).alias(f"so_far_{c}") for c in ("contacts", "meters")],
    )


def encounters(positions: DataFrame, dist_m: float = 1500, port_nm: float = 30) -> DataFrame:
    """One row per encounter: its first contact, number of contacts and mean distance."""
    total = F.sum("contacts")
    return encounter_stretches(positions, dist_m, port_nm=port_nm, told=False).groupBy(*ENCOUNTER).agg(
        total.alias("contacts"), (F.sum("meters") / total).alias("mean_distance_m")
    )


def rendezvous_events(
    positions: DataFrame, dist_m: float = 1500, minutes: int = 3, port_nm: float = 30
) -> DataFrame:
    """One row per encounter that qualifies: its first qualifying contact."""

    def lasts(c: Column) -> Column:
        whole = F.floor((c["t_s"] - F.col("started_s")) / 60)
        return (whole >= minutes) & (c["soon"] | (whole >= 2 * minutes))

    parts = encounter_stretches(positions, dist_m, minutes, port_nm)
    chosen = F.when(F.col("_starts"), F.col("told")).otherwise(F.get(F.filter("head", lasts), F.lit(0)))

    def so_far(c: str) -> Column:
        return F.col(f"so_far_{c}") + F.col(f"_c.{c}")

    candidates = parts.withColumn("_c", chosen).where("_c is not null").select(
        *ENCOUNTER, "t_s", "row_id", "_c", (so_far("meters") / so_far("contacts")).alias("mean_distance_m")
    )
    # An encounter's stretches lie side by side in the order they already have, so its first candidate follows another encounter's.
    start = F.struct("started_s", "started_row")
    last = F.lag(start).over(Window.partitionBy("lo", "hi").orderBy("t_s", "row_id"))
    told = candidates.withColumn("_last", last).where(~F.col("_last").eqNullSafe(start))
    # Names and places of the few chosen contacts.
    report = positions.select(*[c for c in PAIR_COLUMNS if c != "ship_type"])
    other = positions.select(
        F.col("mmsi").alias("o_mmsi"), F.col("t_s").alias("o_t_s"), F.col("row_id").alias("o_row_id"),
        F.col("ship_name").alias("o_ship_name"),
    )
    lo, hi = F.col("lo"), F.col("hi")
    kept = (
        told.select(*ENCOUNTER, "mean_distance_m", "_c.*")
        .withColumn("mmsi", F.when(F.col("low"), lo).otherwise(hi))
        .withColumn("o_mmsi", F.when(F.col("low"), hi).otherwise(lo))
        .drop("low", "soon", "contacts", "meters")
    )
    return graded(
        kept.withColumn("duration_minutes", F.floor((F.col("t_s") - F.col("started_s")) / 60))
        .join(report, ["mmsi", "t_s", "row_id"])
        .join(other, ["o_mmsi", "o_t_s", "o_row_id"])
    )


def graded(events: DataFrame) -> DataFrame:
    """Severity and title of encounters that qualify."""
    tanker = ais.is_tanker("ship_type") | ais.is_tanker("o_ship_type")
    return events.withColumn("severity", F.when(tanker, "HIGH").otherwise("MEDIUM")).withColumn(
        "title", F.lit("Potential Ship-to-Ship Transfer")
    )


def detect_rendezvous(
    positions: DataFrame, dist_m: float = 1500, minutes: int = 3, port_nm: float = 30
) -> DataFrame:
    return rendezvous_alerts(rendezvous_events(positions, dist_m, minutes, port_nm))


def rendezvous_alerts(events: DataFrame) -> DataFrame:
    text = F.format_string(
        "Vessels %s and %s within %.0fm for %d minutes at open sea",
        or_unknown("ship_name", F.col("mmsi")), or_unknown("o_ship_name", F.col("o_mmsi")),
        F.col("mean_distance_m"), F.col("duration_minutes"),
    )
    return to_alerts(
        events,
        "RENDEZVOUS",
        text,
        {
            "vessel2_mmsi": "o_mmsi",
            "vessel2_name": "o_ship_name",
            "distance_meters": "mean_distance_m",
            "duration_minutes": "duration_minutes",
            "vessel1_type": "ship_type",
            "vessel2_type": "o_ship_type",
        },
        subject=F.col("o_mmsi"),
    )
