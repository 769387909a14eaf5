"""Streaming forms of the rules about two vessels and more: meetings and convoys.

First every vessel's reports are put in order and told what came before and after (steps); a report leaves that stage when
it is settled that nothing else can follow it within the time a report stays valid. Then the batch rules' join in space
and time runs as a stream-stream join, whose sides are at most that time apart, so both forget what is older. What a pair
or a vessel remembers of it is a few numbers.

The streams here are given as functions that open them: both sides of the join read the feed on their own, because
Spark keeps one watermark only for a stream that is joined with itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from harborlight.functions.geo import METERS_PER_NM
from harborlight.operators.once import once
from harborlight.operators.pairs import neighbours
from harborlight.plans import convoy, rendezvous
from harborlight.plans.rendezvous import STALE_S
from harborlight.streaming.ordered import Ordered, in_order, plain_rows, to_frame
from harborlight.streaming.stateful import throttle_stream

STEP_COLUMNS = [*rendezvous.PAIR_COLUMNS, "course_over_ground", "able"]
STEP_MEMORY = "t_s long, latitude double, longitude double, able boolean, seq long"
STEP_ADDED = (
    "seq long, prev_t long, prev_lat double, prev_lon double, prev_able boolean, "
    "next_t long, next_row long, next_lat double, next_lon double, next_able boolean"
)
#: Vessels in adjacent cells are nearer than this.
ADJACENT_NM = 17.0

Feed = Callable[[], DataFrame]


class Steps(Ordered):
    """Each report with its number, the one before, and the one after if that follows while this one is valid."""

    def step(self, key, memory, row, following):
        own, later = dict(zip(self.columns.names, row)), dict(zip(self.columns.names, following or ()))
        t, lat, lon, able, seq = memory or (None, None, None, None, 0)
        after = [later.get(c) for c in ("t_s", "row_id", "latitude", "longitude", "able")]
        return (own["t_s"], own["latitude"], own["longitude"], own["able"], seq + 1), [(*row, seq + 1, t, lat, lon, able, *after)]


def steps_stream(positions: DataFrame, port_nm: float = 30) -> DataFrame:
    """STEP_COLUMNS, STEP_ADDED and event_time: ten minutes after the report, when it is settled what followed."""
    rows = positions.withColumn("able", rendezvous.eligible(port_nm)).select(*STEP_COLUMNS, "event_time")
    output = StructType([*rows.drop("event_time").schema.fields, *_parse_datatype_string(STEP_ADDED).fields])
    # What lies twice as far back as a report is valid changes nothing.
    return in_order(rows, Steps, STEP_MEMORY, output, settled_s=STALE_S, forget_s=2 * STALE_S)


def _neighbours(looking: DataFrame, seen: DataFrame, nm: float) -> DataFrame:
    """The batch join over two streams; the bound on their times lets both sides forget."""
    apart = F.expr(f"interval {STALE_S} seconds")
    near = neighbours(looking, seen, nm, STALE_S).where(
        (F.col("event_time") >= F.col("o_event_time")) & (F.col("event_time") <= F.col("o_event_time") + apart)
    )
    return near.drop("o_event_time")


class Meetings(StatefulProcessor):
    """One pair's encounters: the first contact that qualifies is told.

    Input comes in the order of time; a parting ends the encounter, and so do two hours without contact.
    """

    def __init__(self, columns: StructType, output: StructType, minutes: int):
        self.columns, self.output, self.minutes = columns, output, minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.encounter = handle.getValueState(
            "encounter", "started_s long, started_row long, last_s long, contacts long, meters double, told boolean"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, types = self.columns.names, [f.dataType for f in self.columns]
        events = sorted((dict(zip(names, r)) for frame in rows for r in plain_rows(frame, names, types)), key=lambda r: (r["t_s"], r["row_id"]))
        state, out = tuple(self.encounter.get()) if self.encounter.exists() else None, []
        for e in events:
            if not e["meets"]:
                state = None
                continue
            if state is None or e["t_s"] - state[2] > rendezvous.FORGET_S:
                state = (e["t_s"], e["row_id"], e["t_s"], 0, 0.0, False)
            started, row, _, contacts, meters, told = state
            contacts, meters = contacts + 1, meters + e["distance_m"]
            minutes = (e["t_s"] - started) // 60
            long_enough = self.minutes if e["soon"] else 2 * self.minutes
            if not told and minutes >= long_enough:
                told = True
                known = {**e, "started_s": started, "started_row": row, "mean_distance_m": meters / contacts, "duration_minutes": minutes}
                # The event time is the report's, as in its own column.
                out.append(tuple(known["settled_s"] if c == "event_time" else known[c] for c in self.output.names))
            state = (started, row, e["t_s"], contacts, meters, told)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if state is None:
            self.encounter.clear()
        else:
            self.encounter.update(state)
            self.handle.registerTimer((state[2] + rendezvous.FORGET_S + 2 * STALE_S) * 1000)
        if out:
            yield to_frame(out, self.output)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.encounter.clear()
        return iter(())

    def close(self) -> None:
        pass


def rendezvous_stream(feed: Feed, dist_m: float = 1500, minutes: int = 3, port_nm: float = 30) -> DataFrame:
    """The rows of rendezvous_events as a stream.

    Of what the vessels around see of each other, contacts go on to the pair, and of partings the first after a contact or
    after a time unseen; a parting after a parting changes nothing.
    """
    reach = max(ADJACENT_NM, dist_m / METERS_PER_NM * 1.01)
    looking, seen = (steps_stream(feed(), port_nm).where("able").drop("course_over_ground", "seq") for _ in range(2))
    meets = rendezvous.distance_m() <= dist_m
    adjacent = rendezvous.in_adjacent_cells("latitude", "longitude", "o_latitude", "o_longitude")
    parts = ~meets & adjacent & (rendezvous.step_before(dist_m) != "starts")
    # Worked out once, behind the join: as join conditions these formulas would be multiplied out.
    judged = F.struct(rendezvous.distance_m().alias("distance_m"), meets.alias("meets"), parts.alias("parts"))
    near = once(_neighbours(looking, seen, reach), "_j", judged).where("_j.meets or _j.parts")
    kept = [*rendezvous.PAIR_COLUMNS, "o_mmsi", "o_t_s", "o_row_id", "o_ship_type", "o_ship_name", "distance_m"]
    events = near.withColumn("distance_m", F.col("_j.distance_m")).select(
        F.least("mmsi", "o_mmsi").alias("lo"), F.greatest("mmsi", "o_mmsi").alias("hi"), *kept, F.col("_j.meets").alias("meets"),
        rendezvous.alert_soon().alias("soon"), F.unix_seconds("event_time").alias("settled_s"), "event_time",
    )
    fields = {f.name: f for f in events.schema}
    output = StructType([
        *[fields[c] for c in ("lo", "hi", *kept)],
        *_parse_datatype_string("started_s long, started_row long, mean_distance_m double, duration_minutes long").fields, fields["event_time"],
    ])
    told = events.withColumn("_lo", F.col("lo")).withColumn("_hi", F.col("hi")).groupBy("_lo", "_hi").transformWithStateInPandas(
        statefulProcessor=Meetings(events.drop("event_time").schema, output, minutes), outputStructType=output,
        outputMode="Append", timeMode="EventTime", eventTimeColumnName="event_time",
    )
    return rendezvous.graded(told.drop("distance_m"))


class Company(StatefulProcessor):
    """How long a vessel's successive reports have given the same crew, by its fingerprints."""

    def __init__(self, columns: StructType, output: StructType, minutes: int):
        self.columns, self.output, self.minutes = columns, output, minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "started_s long, t_s long, seq long, mark_1 long, mark_2 long, vessel_count long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values(["t_s", "row_id"]).reset_index(drop=True)
        run, durations = tuple(self.run.get()) if self.run.exists() else None, []
        for t, seq, *crew in zip(*(frames[c].tolist() for c in ("t_s", "seq", *convoy.CREW))):
            goes_on = run is not None and seq == run[2] + 1 and t - run[1] <= STALE_S and tuple(crew) == run[3:]
            run = (run[0] if goes_on else t, t, seq, *crew)
            durations.append((t - run[0]) // 60 if goes_on else -1)
        self.run.update(tuple(int(x) for x in run))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((int(run[1]) + 3 * STALE_S) * 1000)
        told = frames.assign(duration_minutes=pd.Series(durations, dtype="int64"))
        told = told[told["duration_minutes"] >= self.minutes]
        if len(told):
            yield told[self.output.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.run.clear()
        return iter(())

    def close(self) -> None:
        pass


def convoy_stream(
    feed: Feed, minutes: int = 3, nm: float = 3.0, dknots: float = 5.0, dcourse: float = 30.0, min_vessels: int = 2
) -> DataFrame:
    """The rows of convoy_events as a stream: an alert an hour for each crew."""

    def tracked() -> DataFrame:
        known = F.col("speed_over_ground").isNotNull() & F.col("course_over_ground").isNotNull()
        return steps_stream(feed()).where(known).select(*convoy.PLACE, "ship_name", "seq", "next_t", "next_row", "event_time")

    near = _neighbours(tracked().drop("next_t", "next_row"), tracked().drop("seq"), nm)
    alike = convoy.alongside(near.where(F.col("speed_over_ground") >= convoy.MIN_KNOTS), dknots, dcourse)
    # Members travel as text through the stages behind.
    member = F.to_json(F.struct(
        F.col("o_mmsi").alias("mmsi"), F.col("o_ship_name").alias("name"), F.col("o_speed_over_ground").alias("speed"),
        F.col("o_course_over_ground").alias("course"),
    ))
    report = ["event_time", "mmsi", "t_s", "row_id", "seq", "ship_name", "latitude", "longitude"]
    crews = convoy.crews(
        alike, report, min_vessels, F.concat_ws(",", F.sort_array(F.collect_list(member))).alias("others"),
        F.concat_ws("-", F.sort_array(F.collect_set("o_mmsi"))).alias("names"),
        F.first("speed_over_ground").alias("speed_over_ground_"), F.first("course_over_ground").alias("course_over_ground_"),
    )
    columns = crews.drop("event_time").schema
    fields = {f.name: f for f in crews.schema}
    output = StructType([*columns.fields, *_parse_datatype_string("duration_minutes long").fields, fields["event_time"]])
    lasting = crews.withColumn("_vessel", F.col("mmsi")).groupBy("_vessel").transformWithStateInPandas(
        statefulProcessor=Company(columns, output, minutes), outputStructType=output, outputMode="Append", timeMode="EventTime",
        eventTimeColumnName="event_time",
    )
    kept = throttle_stream(lasting, convoy.CREW, convoy.COOLDOWN_S, behind_s=STALE_S + 1)
    members = F.from_json(F.concat(F.lit("["), "others", F.lit("]")), "array<struct<mmsi: string, name: string, speed: double, course: double>>")
    own = F.struct("mmsi", F.col("ship_name").alias("name"), F.col("speed_over_ground_").alias("speed"), F.col("course_over_ground_").alias("course"))
    rows = kept.withColumn("members", F.concat(F.array(own), F.array_sort(members))).withColumn(
        "convoy_id", F.array_join(F.array_sort(F.array_append(F.split("names", "-"), F.col("mmsi"))), "-")
    )
    rows = rows.withColumnRenamed("speed_over_ground_", "speed_over_ground").withColumnRenamed("course_over_ground_", "course_over_ground")
    return convoy.graded(rows.drop("others", "names", "mark_1", "mark_2"))
