"""Cumulative vessel risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight import dims
from harborlight.functions import ais, geo
from harborlight.functions.alerts import or_unknown, to_alerts
from harborlight.operators.history import previous, with_history
from harborlight.operators.throttle import throttle

# Fixed values.
PORT_NM = 5.0
PORT_REVISIT_S = 86400
FORGET_S = 7 * 86400
REPEAT_S = 4 * 3600
STEP = 15
FLAG_POINTS = 30
# kind -> (points, most that count)
FACTORS = {
    "port": (25, 3),
    "dark": (15, 4),
    "sts": (20, 3),
    "name": (10, 3),
    "erratic": (5, 4),
}
TIERS = [(75, "CRITICAL"), (50, "HIGH"), (25, "MEDIUM")]


def risk_tier(score: Column) -> Column:
    tier = F.lit("LOW")
    for floor_, name in reversed(TIERS):
        tier = F.when(score >= floor_, name).otherwise(tier)
    return tier


def port_of(lat: str = "latitude", lon: str = "longitude") -> Column:
    """Number of the first listed Russian port within reach, or null."""
    found = F.lit(None).cast("int")
    for i, (_, plat, plon) in reversed(list(enumerate(dims.RUSSIAN_PORTS))):
        near = (F.abs(F.col(lat) - plat) <= PORT_NM / 60 * 1.01) & (
            geo.haversine_nm(lat, lon, F.lit(plat), F.lit(plon)) <= PORT_NM
        )
        found = F.when(near, F.lit(i)).otherwise(found)
    return found


def port_names(ports: Column) -> Column:
    """Names of an array of port numbers, in the order of the list."""
    return F.transform(
        F.array_sort(ports), lambda i: F.element_at(F.array(*[F.lit(n) for n, _, _ in dims.RUSSIAN_PORTS]), i + 1)
    )


def port_visits(positions: DataFrame) -> DataFrame:
    """Reports that count as a visit: more than a day since the last counted visit to the port."""
    near = positions.withColumn("port", port_of()).where(F.col("port").isNotNull())
    return throttle(near, ["mmsi", "port"], PORT_REVISIT_S, strict=True)


def risk_steps(positions: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Reports at which a vessel's score rises, with the score before and after.

    Only the first report of a vessel (or after a week of silence), port visits and `signals`
    can change the score. `signals` (mmsi, t_s, row_id, kind) names reports that other detectors
    flagged; kinds are dark, sts, name and erratic.
    """
    rows = with_history(positions, previous("_prev", "t_s"))
    fresh = F.col("_prev").isNull() | (F.col("t_s") - F.col("_prev.t_s") >= FORGET_S)
    begins = rows.withColumn("_fresh", fresh).drop("_prev")
    row = F.struct(*positions.columns)
    nothing = F.lit(None).cast("int")
    firsts = begins.where("_fresh").select("mmsi", "t_s", "row_id", row.alias("r"), F.lit("first").alias("kind"), nothing.alias("port"))
    visits = port_visits(positions).select("mmsi", "t_s", "row_id", row.alias("r"), F.lit("port").alias("kind"), "port")
    events = firsts.unionByName(visits)
    if signals is not None:
        flagged = positions.join(signals.select("mmsi", "t_s", "row_id", "kind"), ["mmsi", "t_s", "row_id"])
        events = events.unionByName(
            flagged.select("mmsi", "t_s", "row_id", row.alias("r"), "kind", nothing.alias("port"))
        )
    # One row per report; a report can be a first report, a visit and a signal at once.
    def count_of(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind).alias(f"n_{kind}")

    merged = events.groupBy("mmsi", "t_s", "row_id").agg(
        F.first("r").alias("r"),
        F.max("port").alias("port"),
        F.max(F.col("kind") == "first").alias("_fresh"),
        *[count_of(k) for k in FACTORS],
    )
    # Plain windows: visits are a day apart and signals obey their cooldowns, so what a vessel
    # has here grows with time and not with its reports. Counters start again when fresh.
    vessel = Window.partitionBy("mmsi").orderBy("t_s", "row_id")
    life = merged.withColumn("_life", F.sum(F.col("_fresh").cast("int")).over(vessel))
    in_life = Window.partitionBy("mmsi", "_life").orderBy("t_s", "row_id")
    counted = life.withColumns({f"{k}_count": F.sum(f"n_{k}").over(in_life) for k in FACTORS})
    high_risk = F.coalesce(ais.mid("mmsi").isin(dims.HIGH_RISK_MIDS), F.lit(False))
    total = F.when(high_risk, FLAG_POINTS).otherwise(0)
    for kind, (points, most) in FACTORS.items():
        total = total + F.least(F.col(f"{kind}_count"), F.lit(most)) * points
    scored = counted.withColumn("high_risk_flag", high_risk).withColumn("score", F.least(total, F.lit(100)).cast("int"))
    return (
        scored.withColumn("previous_score", F.coalesce(F.lag("score").over(in_life), F.lit(0)))
        .drop("_fresh", *[f"n_{k}" for k in FACTORS])
        .where(F.col("score") > F.col("previous_score"))
    )


def crossed_tier() -> Column:
    """The highest tier that the score has just entered, in words; else null."""
    crossed = F.lit(None).cast("string")
    for floor_, name in reversed(TIERS):
        crossed = F.when(
            (F.col("score") >= floor_) & (F.col("previous_score") < floor_), F.lit(f"crossed into {name} risk tier")
        ).otherwise(crossed)
    return crossed


def risk_events(positions: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Steps that alert: into a higher tier always, else a rise of 15 or more after four quiet hours.

    A life of a vessel has at most a handful of steps, because each one raises a score that
    stops at 100; they are folded as one small array.
    """
    known = risk_steps(positions, signals).withColumn("_crossed", crossed_tier()).withColumn("_rise", F.col("score") - F.col("previous_score"))
    item = F.struct("t_s", "row_id", *[c for c in known.columns if c not in ("t_s", "row_id", "mmsi", "_life")])
    lives = known.groupBy("mmsi", "_life").agg(F.array_sort(F.collect_list(item)).alias("_steps"))

    def alerts_at(state: Column, s: Column) -> Column:
        waited = state["last"].isNull() | (s["t_s"] - state["last"] >= REPEAT_S)
        fires = (s["score"] >= TIERS[-1][0]) & (s["_crossed"].isNotNull() | ((s["_rise"] >= STEP) & waited))
        return F.struct(
            F.when(fires, s["t_s"]).otherwise(state["last"]).alias("last"),
            F.when(fires, F.array_append(state["fired"], s["row_id"])).otherwise(state["fired"]).alias("fired"),
        )

    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("fired"))
    folded = lives.withColumn("_fired", F.aggregate("_steps", start, alerts_at)["fired"])
    out = folded.select("mmsi", "_fired", F.explode("_steps").alias("s")).where(F.array_contains("_fired", F.col("s.row_id")))
    counts = [f"{k}_count" for k in FACTORS]
    return described(out.select("s.*").select("r.*", "score", "previous_score", "port", "high_risk_flag", *counts))


def described(alerts: DataFrame) -> DataFrame:
    """Reason, severity and title of steps that alert."""
    rise = F.format_string("risk score increased by %d points", F.col("score") - F.col("previous_score"))
    tier = risk_tier(F.col("score"))
    return (
        alerts.withColumn("reason", F.coalesce(crossed_tier(), rise))
        .withColumn("severity", tier)
        .withColumn("title", F.format_string("%s Risk Vessel: %s", tier, or_unknown("ship_name", F.col("mmsi"))))
    )


def score_vessel_risk(positions: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    events = risk_events(positions, signals)
    # Ports visited up to the alert: an alert has at most six.
    visited = port_visits(positions).select("mmsi", F.col("t_s").alias("_visit_s"), "port")
    names = port_names(F.collect_set("_visited"))
    ports = (
        events.select("mmsi", "t_s", "row_id")
        .join(visited.withColumnRenamed("port", "_visited"), "mmsi")
        .where(F.col("_visit_s") <= F.col("t_s"))
        .groupBy("mmsi", "t_s", "row_id")
        .agg(names.alias("visited_ports"))
    )
    return risk_alerts(events.join(ports, ["mmsi", "t_s", "row_id"], "left"))


def risk_alerts(full: DataFrame) -> DataFrame:
    """Alerts of risk events with `visited_ports`."""

    def factor(kind: str, wording: str) -> Column:
        n = F.col(f"{kind}_count")
        return F.when(n > 0, F.format_string(wording, n))

    factors = F.array_compact(F.array(
        factor("port", "%d Russian port visit(s)"),
        factor("dark", "%d dark event(s)"),
        F.when(F.col("high_risk_flag"), "high-risk flag state"),
        factor("sts", "%d suspected STS transfer(s)"),
        factor("name", "%d name change(s)"),
    ))
    text = F.concat(
        F.format_string(
            "Vessel %s (MMSI: %s) has a risk score of %d/100 (%s). ",
            or_unknown("ship_name"), F.col("mmsi"), F.col("score"), F.col("severity")),
        F.when(F.size(factors) > 0, F.concat(F.lit("Contributing factors: "), F.array_join(factors, ", "), F.lit("."))).otherwise(""),
    )
    return to_alerts(
        full,
        "SANCTIONS_MATCH",
        text,
        {
            "risk_score": "score",
            "risk_tier": "severity",
            "alert_reason": "reason",
            "high_risk_flag": "high_risk_flag",
            "dark_event_count": "dark_count",
            "russian_port_visits": "port_count",
            "sts_transfer_count": "sts_count",
            "name_change_count": "name_count",
            "erratic_behavior_count": "erratic_count",
            "visited_russian_ports": "visited_ports",
        },
        subject=F.lit("risk"),
    )
