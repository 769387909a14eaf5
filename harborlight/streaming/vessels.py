"""Streaming forms of the rules about one vessel's past: fishing patterns, loitering and risk scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from harborlight import dims
from harborlight.functions import ais
from harborlight.operators.once import once
from harborlight.plans import fishing, loitering, risk
from harborlight.plans.state import KEEP_POSITIONS
from harborlight.streaming.ordered import Ordered, in_order
from harborlight.streaming.stateful import throttle_stream


class LastReports(Ordered):
    """Each report with its vessel's last positions, itself included, oldest first, a list for each measure."""

    def step(self, key, memory, row, following):
        own = dict(zip(self.columns.names, row))
        kept = [list(m) for m in memory[1:]] if memory else [[] for _ in fishing.TRACK]
        kept = [[*m, own[c]][-KEEP_POSITIONS:] for m, c in zip(kept, fishing.TRACK)]
        return (own["t_s"], *kept), [(*row, *kept)]


def fishing_stream(positions: DataFrame, zones: DataFrame, **limits) -> DataFrame:
    """The rows of fishing_events as a stream; a late report takes its place among the last twenty."""
    rows = positions.select("t_s", "row_id", *[c for c in positions.columns if c not in ("t_s", "row_id")])
    columns = [c for c in rows.columns if c != "event_time"]
    lists = ", ".join(f"last_{c} array<double>" for c in fishing.TRACK)
    output = StructType([*rows.drop("event_time").schema.fields, *_parse_datatype_string(lists).fields])
    kept = in_order(rows, LastReports, f"t_s long, {lists}", output)
    track = F.transform(
        F.sequence(F.lit(0), F.size("last_latitude") - 1),
        lambda i: F.struct(*[F.get(f"last_{c}", i).alias(c) for c in fishing.TRACK]),
    )
    framed = once(kept, "_last", track).drop(*[f"last_{c}" for c in fishing.TRACK])
    return fishing.fishing_hits(fishing.fishing_signs(framed, [*columns, "event_time"], **limits), fishing.fishing_grounds(zones))


LOITER_MEMORY = "t_s long, times array<long>, lats array<double>, lons array<double>, speeds array<double>"


class Loitering(Ordered):
    """Reports whose vessel's last reports stay in the circle. What is remembered is the time frame itself."""

    def __init__(self, columns, memory, output, settled_s, forget_s, radius_nm: float, minutes: int, history_s: int):
        super().__init__(columns, memory, output, settled_s, forget_s)
        self.radius_nm, self.minutes, self.history_s = radius_nm, minutes, history_s

    def step(self, key, memory, row, following):
        own = dict(zip(self.columns.names, row))
        kept = [list(m) for m in memory[1:]] if memory else [[], [], [], []]
        old = next((i for i, t in enumerate(kept[0]) if t >= own["t_s"] - self.history_s), len(kept[0]))
        kept = [m[old:] for m in kept]
        if own["latitude"] is None or own["longitude"] is None:
            return (own["t_s"], *kept), []
        kept = [[*m, own[c]] for m, c in zip(kept, loitering.FRAME)]
        times, *places = kept
        frames = loitering.Frames(np.array(times), *(np.array(m, float) for m in places), self.history_s)
        found = frames.measure(len(times) - 1, self.radius_nm, self.minutes)
        return (own["t_s"], *kept), [(*row, *found)] if found else []


def loitering_stream(positions: DataFrame, radius_nm: float = 0.5, minutes: int = 45, history_min: int = 120) -> DataFrame:
    """The rows of loitering_events as a stream. A vessel is forgotten when its reports are older than the time frame."""
    output = StructType([*positions.drop("event_time").schema.fields, *_parse_datatype_string(loitering.MEASURE_DDL).fields])
    found = in_order(
        positions, Loitering, LOITER_MEMORY, output, forget_s=history_min * 60 + 1, radius_nm=radius_nm, minutes=minutes,
        history_s=history_min * 60,
    )
    return loitering.graded(throttle_stream(found, ["mmsi"], loitering.COOLDOWN_S, strict=True, behind_s=1))


RISK_MEMORY = (
    "t_s long, score int, alerted_s long, n_port int, n_dark int, n_sts int, n_name int, n_erratic int, visit_ports array<int>, visit_s array<long>, visited array<int>"
)


class RiskScore(Ordered):
    """A vessel's score after each report, told where it alerts.

    Counted visits to a port are remembered for the day in which another one would not count; scores, counts and the ports
    visited until the vessel has been silent for a week.
    """

    def step(self, key, memory, row, following):
        own = dict(zip(self.columns.names, row))
        t, kind = own["t_s"], own["kind"]
        _, score, alerted, *counts, ports, times, visited = memory or (t, 0, None, *[0] * len(risk.FACTORS), [], [], [])
        counts = dict(zip(risk.FACTORS, counts))
        visits = {p: s for p, s in zip(ports, times) if t - s <= risk.PORT_REVISIT_S}
        if kind == "report" and own["port"] is not None and own["port"] not in visits:
            visits[own["port"]] = t
            visited = sorted({*visited, own["port"]})
            counts["port"] += 1
        elif kind != "report":
            counts[kind] += 1
        out = []
        # Signals of a report come before it and count with it.
        if following is None or following[:2] != row[:2]:
            total = risk.FLAG_POINTS * own["high_risk_flag"] + sum(
                min(counts[k], most) * points for k, (points, most) in risk.FACTORS.items()
            )
            before, score = score, max(score, min(total, 100))
            crossed = any(score >= floor > before for floor, _ in risk.TIERS)
            waited = alerted is None or t - alerted >= risk.REPEAT_S
            if score > before and score >= risk.TIERS[-1][0] and (crossed or (score - before >= risk.STEP and waited)):
                alerted = t
                out.append((*row, score, before, *counts.values(), list(visited)))
        return (t, score, alerted, *counts.values(), [*visits], [*visits.values()], visited), out


def risk_stream(positions: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """The rows of risk_events as a stream, with `visited_ports`.

    `signals` is a stream of (mmsi, t_s, row_id, kind) with the event_time of the report they are about, from another feed.
    """
    high_risk = F.coalesce(ais.mid("mmsi").isin(dims.HIGH_RISK_MIDS), F.lit(False))
    first = ["t_s", "row_id"]
    rows = positions.select(
        *first, *[c for c in positions.columns if c not in first], risk.port_of().alias("port"), high_risk.alias("high_risk_flag"),
        F.lit("report").alias("kind"), F.lit(1).alias("rank"),
    )
    if signals is not None:
        told = signals.withColumn("high_risk_flag", high_risk).select(
            "mmsi", "t_s", "row_id", "kind", "event_time", "high_risk_flag", F.lit(0).alias("rank")
        )
        rows = rows.unionByName(told, allowMissingColumns=True)
    counts = [f"{k}_count" for k in risk.FACTORS]
    added = "score int, previous_score int, " + ", ".join(f"{c} long" for c in counts) + ", visited array<int>"
    output = StructType([*rows.drop("event_time").schema.fields, *_parse_datatype_string(added).fields])
    alerts = in_order(rows, RiskScore, RISK_MEMORY, output, forget_s=risk.FORGET_S)
    return risk.described(alerts.drop("kind", "rank").withColumn("visited_ports", risk.port_names(F.col("visited"))).drop("visited"))
