"""Streaming forms of the rules that remember: cooldown, silence and incidents.

Each processor holds a few values per key in Spark's state store and follows the same row rules
as the batch form. Event time only: timers fire on the watermark, never on the clock.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from harborlight.plans.anchor import ANCHORED_STATUSES
from harborlight.plans.dark import MIN_MESSAGES
from harborlight.plans.spoofing import known_name
from harborlight.plans.incidents import (
    GAP_S, incident_description, incident_id, incident_score, incident_severity, incident_title,
)

DAY_S = 86400
#: Vessels silent for so long are forgotten.
FORGET_S = 7 * DAY_S
#: Names not used for so long are forgotten.
NAME_S = 30 * DAY_S


def _rearm(handle: StatefulProcessorHandle, at_s: int) -> None:
    """Leave the key one timer only."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at_s * 1000)


class Cooldown(StatefulProcessor):
    """Emit a row, then drop the rows of its key until the cooldown has passed.

    Once the watermark is past the cooldown, the key is forgotten: whatever may still come is kept. `behind_s` says how far
    the rows' own time lies behind their event time.
    """

    def __init__(self, cooldown_s: int, strict: bool = False, behind_s: int = 0):
        self.wait = cooldown_s + 1 if strict else cooldown_s
        self.behind_s = behind_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t_s long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows)
        batch = batch.sort_values([c for c in ("t_s", "row_id", "rank") if c in batch.columns])
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for i, t in enumerate(batch["t_s"].tolist()):
            if last is None or t >= last + self.wait:
                kept.append(i)
                last = t
        self.last.update((last,))
        if kept:
            _rearm(self.handle, last + self.wait + self.behind_s)
            yield batch.iloc[kept]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def throttle_stream(rows: DataFrame, keys: list[str], cooldown_s: int, strict: bool = False, behind_s: int = 0) -> DataFrame:
    """The streaming form of operators.throttle; `rows` carry event_time with a watermark."""
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Cooldown(cooldown_s, strict, behind_s),
        outputStructType=rows.schema,
        outputMode="Append",
        timeMode="EventTime",
    )


class Silence(StatefulProcessor):
    """Tell when a vessel has been silent for the threshold, and again, with the full gap, on its return.

    Input of a batch is handled before timers, so the gap is also tested when the vessel comes
    back: a timer alone would miss a silence that ends inside one batch.
    """

    def __init__(self, threshold_min: int, forget_s: int = FORGET_S):
        self.threshold_s = threshold_min * 60
        self.forget_s = forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.vessel = handle.getValueState(
            "vessel",
            "t_s long, row_id long, count long, s double, speed double, ship_type int, ship_name string, "
            "imo_number string, latitude double, longitude double",
        )

    def _silent(self, mmsi: str, v: tuple, until_s: int, stage: str) -> dict | None:
        t_s, row_id, count, s, speed, ship_type, name, imo, lat, lon = v
        gap_min = (until_s - t_s) // 60
        mean = s / count
        quiet = ship_type is not None and (36 <= ship_type <= 37 or 60 <= ship_type <= 69)
        if gap_min * 60 < self.threshold_s or count < MIN_MESSAGES or quiet:
            return None
        if (speed is not None and speed < 0.5) or (mean > 0 and gap_min * 60 < mean * 10):
            return None
        return {
            "mmsi": mmsi, "t_s": t_s, "row_id": row_id, "gap_minutes": gap_min, "stage": stage, "ship_name": name,
            "imo_number": imo, "ship_type": ship_type, "latitude": lat, "longitude": lon,
        }

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(["t_s", "row_id"])
        v = tuple(self.vessel.get()) if self.vessel.exists() else None
        out = []

        def known(value, before):
            return before if pd.isna(value) else value

        for r in batch.itertuples(index=False):
            if v is None:
                count, s, before = 1, 0.0, (None, None, None)
            else:
                back = self._silent(key[0], v, r.t_s, "returned")
                if back:
                    out.append(back)
                gap = r.t_s - v[0]
                # s is mean * count; a gap of zero leaves the mean and raises the count.
                count, s = v[2] + 1, v[3] + gap if gap > 0 else v[3] * (v[2] + 1) / v[2]
                before = (v[5], v[6], v[7])
            ship_type = known(r.ship_type, before[0])
            v = (
                int(r.t_s), int(r.row_id), count, float(s), None if pd.isna(r.speed_over_ground) else float(r.speed_over_ground),
                None if ship_type is None else int(ship_type), known(r.ship_name, before[1]), known(r.imo_number, before[2]),
                float(r.latitude), float(r.longitude),
            )
        self.vessel.update(v)
        _rearm(self.handle, v[0] + self.threshold_s)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        v = tuple(self.vessel.get())
        until = expiredTimerInfo.getExpiryTimeInMs() // 1000
        if until - v[0] >= self.forget_s:
            self.vessel.clear()
            return
        silent = self._silent(key[0], v, until, "silent")
        again = v[0] + self.forget_s
        if silent:
            yield pd.DataFrame([silent])
        elif until - v[0] < DAY_S:
            # Not yet long enough against the vessel's usual interval.
            again = min(again, max(until + 60, v[0] + int(v[3] / v[2] * 10) + 60))
        self.handle.registerTimer(again * 1000)

    def close(self) -> None:
        pass


SILENCE_SCHEMA = (
    "mmsi string, t_s long, row_id long, gap_minutes long, stage string, ship_name string, imo_number string, "
    "ship_type int, latitude double, longitude double"
)


def gone_dark_stream(positions: DataFrame, threshold_min: int = 30, forget_s: int = FORGET_S) -> DataFrame:
    """`stage` silent: the threshold has passed; returned: the whole gap, once the vessel is back.

    A vessel that stays away for `forget_s` is forgotten and starts anew.
    """
    needed = positions.select(
        "mmsi", "t_s", "row_id", "event_time", "speed_over_ground", "ship_type", "ship_name", "imo_number", "latitude", "longitude"
    )
    return needed.groupBy("mmsi").transformWithStateInPandas(
        statefulProcessor=Silence(threshold_min, forget_s),
        outputStructType=SILENCE_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )


class Memory(StatefulProcessor):
    """Add to each report what its vessel's earlier reports leave behind.

    The report before (time and place), the first IMO, the first report of the current spell at
    anchor, and at the first report under a name, how many names that makes. The detector rules
    then are column expressions, the same as in batch. A vessel silent for `forget_s` is
    forgotten, and so is a name not used for `name_s`, so the names kept are those in use.
    """

    def __init__(self, anchored: tuple[int, ...], forget_s: int, name_s: int):
        self.anchored = anchored
        self.forget_s = forget_s
        self.name_s = name_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.vessel = handle.getValueState(
            "vessel",
            "t_s long, lat double, lon double, imo string, anchor_row long, anchor_t long, anchor_lat double, anchor_lon double",
        )
        self.names = handle.getMapState("names", "name string", "rank long, t_s long")

    def _naming(self, name, t_s: int, names: dict[str, tuple[int, int]]) -> tuple[int | None, str | None]:
        """How many names the vessel has with a new one, and its oldest; nothing for a name it is known by."""
        if not isinstance(name, str):
            return None, None
        for old in [n for n, (_, last) in names.items() if t_s - last >= self.name_s]:
            del names[old]
            self.names.removeKey((old,))
        rank = names[name][0] if name in names else max((r for r, _ in names.values()), default=0) + 1
        known, names[name] = name in names, (rank, max(t_s, names.get(name, (0, t_s))[1]))
        return (None, None) if known else (len(names), min(names, key=lambda n: names[n][0]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(["t_s", "row_id"])
        t, lat, lon, imo, *anchor = tuple(self.vessel.get()) if self.vessel.exists() else (None,) * 8
        names = {k[0]: tuple(v) for k, v in self.names.iterator()} if self.names.exists() else {}
        before, added = dict(names), []
        for r in batch.itertuples(index=False):
            if imo is None and isinstance(r.imo_number, str) and r.imo_number not in ("", "0"):
                imo = r.imo_number
            if pd.isna(r.nav_status) or int(r.nav_status) not in self.anchored:
                anchor = [None] * 4
            elif anchor[0] is None:
                anchor = [int(r.row_id), int(r.t_s), float(r.latitude), float(r.longitude)]
            added.append((t, lat, lon, imo, *anchor, *self._naming(r.known_name, int(r.t_s), names)))
            t, lat, lon = int(r.t_s), float(r.latitude), float(r.longitude)
        self.vessel.update((t, lat, lon, imo, *anchor))
        for name, use in names.items():
            if before.get(name) != use:
                self.names.updateValue((name,), use)
        _rearm(self.handle, t + self.forget_s)
        # Column by column, so that row numbers with gaps do not pass through floating point.
        known = pd.DataFrame(
            {c: pd.Series(list(v), dtype=MEMORY_TYPES[c], index=batch.index) for c, v in zip(MEMORY_COLUMNS, zip(*added))}
        )
        yield pd.concat([batch, known], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.vessel.clear()
        self.names.clear()
        return iter(())

    def close(self) -> None:
        pass


MEMORY_COLUMNS = [
    "prev_t", "prev_lat", "prev_lon", "first_imo", "anchor_row", "anchor_t", "anchor_lat", "anchor_lon", "name_index", "first_name",
]
MEMORY_TYPES = {
    "prev_t": "Int64", "prev_lat": "float64", "prev_lon": "float64", "first_imo": "object", "anchor_row": "Int64",
    "anchor_t": "Int64", "anchor_lat": "float64", "anchor_lon": "float64", "name_index": "Int64", "first_name": "object",
}
MEMORY_SCHEMA = (
    "prev_t long, prev_lat double, prev_lon double, first_imo string, anchor_row long, anchor_t long, anchor_lat double, anchor_lon double, "
    "name_index long, first_name string"
)


def with_memory(positions: DataFrame, forget_s: int = FORGET_S, name_s: int = NAME_S) -> DataFrame:
    """Positions with MEMORY_COLUMNS; missing places come out as null."""
    positions = positions.withColumn("known_name", known_name())
    schema = StructType(positions.schema.fields + _parse_datatype_string(MEMORY_SCHEMA).fields)
    rows = positions.groupBy("mmsi").transformWithStateInPandas(
        statefulProcessor=Memory(ANCHORED_STATUSES, forget_s, name_s), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    return rows.drop("known_name").withColumns(
        {c: F.when(F.col("prev_t" if c.startswith("prev") else "anchor_t").isNotNull(), F.col(c))
         for c in ("prev_lat", "prev_lon", "anchor_lat", "anchor_lon")}
    )


class Incidents(StatefulProcessor):
    """Collect a vessel's alerts until none came for the gap.

    An incident comes out with each batch that adds to it (`stage` open) and once more at its end (closed).
    """

    def __init__(self, gap_s: int):
        self.gap_s = gap_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState(
            "open",
            "first_s long, last_s long, alerts long, types array<string>, first_name string, last_name string, lat double, lon double",
        )

    def _row(self, mmsi: str, v: tuple, stage: str) -> dict:
        first_s, last_s, alerts, types, first_name, last_name, lat, lon = v
        return {
            "mmsi": mmsi, "stage": stage, "first_s": first_s, "last_s": last_s, "alert_count": alerts, "alert_types": list(types),
            "ship_name": first_name, "last_name": last_name, "lat": lat, "lon": lon,
        }

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(["t_s", "alert_id"])
        v = tuple(self.open.get()) if self.open.exists() else None
        out = []
        for r in batch.itertuples(index=False):
            if v is not None and r.t_s - v[1] >= self.gap_s:
                out.append(self._row(key[0], v, "closed"))
                v = None
            name = f"MMSI {key[0]}" if pd.isna(r.vessel_name) else r.vessel_name
            if v is None:
                v = (int(r.t_s), int(r.t_s), 0, [], name, name, None, None)
            place = (float(r.latitude), float(r.longitude)) if r.latitude and r.longitude and not (pd.isna(r.latitude) or pd.isna(r.longitude)) else v[6:]
            types = list(v[3]) if r.alert_type in v[3] else [*v[3], r.alert_type]
            v = (v[0], max(v[1], int(r.t_s)), v[2] + 1, types, v[4], name, *place)
        self.open.update(v)
        _rearm(self.handle, v[1] + self.gap_s)
        yield pd.DataFrame([*out, self._row(key[0], v, "open")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield pd.DataFrame([self._row(key[0], tuple(self.open.get()), "closed")])
            self.open.clear()

    def close(self) -> None:
        pass


INCIDENT_SCHEMA = (
    "mmsi string, stage string, first_s long, last_s long, alert_count long, alert_types array<string>, ship_name string, "
    "last_name string, lat double, lon double"
)


def incidents_stream(alerts: DataFrame, gap_s: int = GAP_S, lateness: str = "10 minutes") -> DataFrame:
    """Alerts (ALERT_SCHEMA) -> open and closed incidents, with the batch form's id, score, severity and texts.

    A sink that keeps the newest row per id holds the current state.
    """
    rows = alerts.select(
        "mmsi", "alert_id", "alert_type", "detected_at", F.unix_seconds("detected_at").alias("t_s"), "vessel_name", "latitude", "longitude"
    ).where(F.col("mmsi") != "")
    outlines = rows.withWatermark("detected_at", lateness).groupBy("mmsi").transformWithStateInPandas(
        statefulProcessor=Incidents(gap_s), outputStructType=INCIDENT_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
    types = F.col("alert_types")
    scored = outlines.withColumn("risk_score", incident_score(types))
    return scored.select(
        incident_id(F.col("first_s")).alias("id"),
        "mmsi", "ship_name", "stage",
        incident_severity(types, F.col("risk_score")).alias("severity"),
        incident_title(types, F.col("last_name")).alias("title"),
        incident_description(F.col("alert_count"), types, F.col("last_s") - F.col("first_s")).alias("description"),
        "alert_types", "alert_count", "first_s", "last_s",
        F.when(F.col("lat").isNotNull(), F.struct("lat", "lon")).alias("location"),
        "risk_score",
    )
