"""Hand-built tracks: one per rule branch or limit that the query checks do not reach."""

from __future__ import annotations

import json
import threading

import pytest
from conftest import T0
from pyspark.sql import functions as F

from harborlight import dims
from harborlight.functions.alerts import ALERT_COLUMNS
from harborlight.plans import (
    anchor, cable, convoy, dark, fishing, geofence, incidents, loitering, pipeline, rendezvous, risk, sanctions_match, spoofing, trajectory,
)
from harborlight.sources.reference import latest_sanctions


@pytest.fixture(scope="module")
def zones(spark):
    return dims.zones(spark, [dims.box_zone("MPA", "MPA", 19.0, 19.6, 56.9, 57.3)])


def test_cable_speed_limits(track, zones):
    speeds = [0.49, 0.5, 2.99, 3.0, 7.99, 8.0, None]
    rows = [dict(t=i * 10, mmsi=f"23000000{i}", speed_over_ground=s) for i, s in enumerate(speeds)]
    got = {r.mmsi[-1]: r.risk_factor for r in cable.cable_events(track(rows), zones).collect()}
    assert got == {"0": "STOPPED_IN_ZONE", "1": "HIGH_RISK_SHIP_SLOW", "2": "HIGH_RISK_SHIP_SLOW", "3": "LARGE_VESSEL_TRANSIT", "4": "LARGE_VESSEL_TRANSIT", "6": "STOPPED_IN_ZONE"}
    rows = [dict(t=0, mmsi=m, speed_over_ground=s, ship_type=60) for m, s in (("273000001", 1.0), ("230000001", 1.0), ("273000002", 12.0), ("230000002", 4.0))]
    got = {r.mmsi: (r.risk_factor, r.severity) for r in cable.cable_events(track(rows), zones).collect()}
    assert got == {"273000001": ("FLAGGED_STATE_SLOW", "CRITICAL"), "230000001": ("SLOW_IN_ZONE", "HIGH"), "273000002": ("FLAGGED_STATE_TRANSIT", "MEDIUM")}


def test_cable_near_port_is_quiet(track, zones):
    # An anchorage inside a cable zone.
    rows = [dict(t=0, latitude=59.47, longitude=24.70, speed_over_ground=0.1), dict(t=10, mmsi="230000009", latitude=59.60, longitude=24.50, speed_over_ground=0.1)]
    assert {r.mmsi for r in cable.cable_events(track(rows), zones).collect()} == {"230000009"}


def test_alert_layout_and_stable_ids(track, zones):
    df = track([dict(t=0, speed_over_ground=0.2, ship_name=None)])
    a, b = (cable.detect_cable_proximity(df, zones).first() for _ in range(2))
    assert list(a.asDict()) == ALERT_COLUMNS and a.alert_id == b.alert_id
    assert a.description.startswith("Unknown, MMSI 230000001, flag FI: 0.2 knots in C-Lion1")
    assert json.loads(a.details)["risk_factor"] == "STOPPED_IN_ZONE" and a.flag_state == "FI"


def test_gone_dark_limits(track):
    def silence(gap, speed=9.0, kind=70, step=60, n=5, mmsi="230000001"):
        rows = [dict(t=i * step, mmsi=mmsi, speed_over_ground=speed, ship_type=kind) for i in range(n)]
        return rows + [dict(t=(n - 1) * step + gap, mmsi=mmsi, ship_type=kind)]

    cases = {
        "a": (silence(1800, mmsi="a"), "LOW"), "b": (silence(1799, mmsi="b"), None), "c": (silence(1800, n=4, mmsi="c"), None),
        "d": (silence(1800, speed=0.4, mmsi="d"), None), "e": (silence(1800, kind=60, mmsi="e"), None), "f": (silence(1800, kind=80, mmsi="f"), "MEDIUM"),
        "g": (silence(1800, step=300, mmsi="g"), None), "h": (silence(6 * 3600 + 60, mmsi="h"), "MEDIUM"), "i": (silence(24 * 3600 + 60, mmsi="i"), "HIGH"),
    }
    got = {r.mmsi: r.severity for r in dark.gone_dark_events(track([r for rows, _ in cases.values() for r in rows])).collect()}
    assert got == {k: s for k, (_, s) in cases.items() if s}


def test_interval_mean_with_equal_times(track):
    times = [0, 60, 60, 60, 120, 300, 300, 300 + 4000]
    df = track([dict(t=t) for t in times])
    got = dark.gone_dark_events(df).first()
    mean, n = 0.0, 1
    for a, b in zip(times[:6], times[1:7]):
        mean = (mean * n + b - a) / (n + 1) if b > a else mean
        n += 1
    assert got.message_count == n == 7 and abs(got.avg_interval_s - mean) < 1e-9


def test_rendezvous_encounter_ends_when_parted(track):
    def pair(t, apart=0.002, a="230000001", b="230000002"):
        return [dict(t=t, mmsi=a, latitude=58.0, longitude=20.0, speed_over_ground=1.0, ship_type=60), dict(t=t + 5, mmsi=b, latitude=58.0, longitude=20.0 + apart, speed_over_ground=1.0, ship_type=60)]

    # Six minutes are needed without a tanker; a parting at minute four starts the clock anew.
    together = [r for t in range(0, 420, 60) for r in pair(t)]
    assert rendezvous.rendezvous_events(track(together)).count() == 1
    broken = [r for t in range(0, 420, 60) for r in pair(t, 0.2 if t == 240 else 0.002)]
    assert rendezvous.rendezvous_events(track(broken)).count() == 0
    tanker = [dict(r, ship_type=80) for r in broken]
    alert = rendezvous.rendezvous_events(track(tanker)).first()
    assert (alert.severity, alert.duration_minutes) == ("HIGH", 3)


def test_rendezvous_resumes_after_unseen_gap(track):
    # One vessel is too fast for a while, so nothing is seen; the encounter is remembered for two hours.
    rows = []
    for t in (0, 60, 3600, 3660):
        rows += [dict(t=t, mmsi="a", latitude=58.0, longitude=20.0, speed_over_ground=1.0, ship_type=80), dict(t=t + 5, mmsi="b", latitude=58.0, longitude=20.002, speed_over_ground=1.0)]
    rows += [dict(t=1000, mmsi="a", latitude=58.0, longitude=20.0, speed_over_ground=9.0)]
    got = rendezvous.rendezvous_events(track(rows)).collect()
    assert len(got) == 1 and got[0].started_s == T0 + 5 and got[0].duration_minutes == 60


def test_neighbours_across_the_date_line(track):
    rows = []
    for t in range(0, 600, 60):
        rows += [dict(t=t, mmsi="a", latitude=58.0, longitude=179.999, speed_over_ground=1.0, ship_type=80), dict(t=t + 5, mmsi="b", latitude=58.0, longitude=-179.999, speed_over_ground=1.0)]
    assert rendezvous.rendezvous_events(track(rows)).count() == 1


def test_convoy(track):
    rows = []
    for t in range(0, 900, 60):
        for i, m in enumerate(("a", "b", "c")):
            rows.append(dict(t=t + i, mmsi=m, latitude=58.0 + t * 1e-5, longitude=20.0 + i * 0.01, speed_over_ground=10.0 + i, course_over_ground=359.0 if i else 2.0))
    got = convoy.convoy_events(track(rows)).collect()
    assert len(got) == 1 and got[0].convoy_id == "a-b-c" and got[0].vessel_count == 3 and got[0].duration_minutes == 3
    detail = json.loads(convoy.detect_convoy(track(rows)).first().details)
    assert detail["average_speed"] == 11.0 and len(detail["members"]) == 3


def test_trajectory_needs_course_and_time(track, zones):
    base = dict(latitude=57.0, longitude=21.0, course_over_ground=0.0)
    rows = [dict(base, t=0, mmsi="a", speed_over_ground=14.0), dict(base, t=0, mmsi="b", speed_over_ground=2.9), dict(base, t=0, mmsi="c", speed_over_ground=14.0, course_over_ground=180.0),
            dict(base, t=0, mmsi="d", speed_over_ground=14.0, course_over_ground=None, heading=0.0, latitude=57.4), dict(base, t=0, mmsi="e", speed_over_ground=14.0, latitude=57.6)]
    got = {r.mmsi: r for r in trajectory.trajectory_events(track(rows), zones).collect() if r.zone_id == "CABLE-CLION1"}
    assert set(got) == {"d"} and 20 < got["d"].eta_minutes < 30 and got["d"].severity == "MEDIUM"


def test_loitering_cooldown_is_strict(track):
    rows = [dict(t=t, speed_over_ground=0.1) for t in range(0, 9000, 300)]
    got = [(r.t_s - T0, r.loiter_minutes, r.severity) for r in loitering.loitering_events(track(rows)).orderBy("t_s").collect()]
    assert got == [(2700, 45, "MEDIUM"), (6600, 110, "MEDIUM")]


def test_spoofing_checks_not_in_the_tables(track):
    rows = [dict(t=0, mmsi="a23456789", latitude=0.05, longitude=0.05), dict(t=0, mmsi="230000001", latitude=91.0), dict(t=0, mmsi="000000000"), dict(t=0, mmsi="199000001")]
    got = {(r.mmsi, r.check): r.severity for r in spoofing.spoofing_findings(track(rows)).collect()}
    assert got == {
        ("a23456789", "invalid_mmsi"): "HIGH", ("a23456789", "coordinates"): "HIGH", ("230000001", "coordinates"): "CRITICAL",
        ("000000000", "invalid_mmsi"): "HIGH", ("199000001", "invalid_mmsi"): "MEDIUM",
    }
    alert = json.loads(spoofing.detect_spoofing(track(rows[:1])).first().details)
    assert alert["reason"] == "Non-numeric MMSI" and alert["cumulative_spoofing_score"] == 70


def test_teleport_needs_ten_seconds(track):
    rows = [dict(t=0), dict(t=9, latitude=58.0), dict(t=19, latitude=57.0)]
    found = spoofing.spoofing_findings(track(rows)).where("check = 'teleport'").collect()
    assert [(r.t_s - T0, r.severity) for r in found] == [(19, "CRITICAL")]


def test_anchor_spell_and_cable(track, zones):
    rows = [dict(t=0, nav_status=1, speed_over_ground=0.0), dict(t=300, nav_status=1, speed_over_ground=0.6), dict(t=600, nav_status=0),
            dict(t=1200, nav_status=5, latitude=57.61), dict(t=1300, nav_status=5, latitude=57.612, speed_over_ground=None)]
    got = [(r.t_s - T0, r.cause, r.severity, r.alert_count) for r in anchor.anchor_events(track(rows), zones).orderBy("t_s").collect()]
    assert got == [(300, "moving", "HIGH", 0), (1300, "drift", "CRITICAL", 0)]


def test_sanction_precedence(spark, track):
    records = spark.createDataFrame(
        [("SANCTIONED_VESSEL", "9000001", None, "LISTED", 1), ("SANCTIONED_VESSEL", None, "230000001", "BY MMSI", 1), ("SANCTIONED_VESSEL", "9000001", None, "LATER", 2)],
        "record_type string, imo_number string, mmsi string, vessel_name string, offset long",
    )
    flags = dims.high_risk_flags(spark).withColumn("offset", F.lit(0).cast("long"))
    known = latest_sanctions(records.unionByName(flags, allowMissingColumns=True))
    rows = [dict(t=0, imo_number="9000001"), dict(t=10, mmsi="273000002", ship_type=80), dict(t=20, mmsi="273000003", ship_type=70), dict(t=3599), dict(t=3600)]
    got = [(r.mmsi, r.t_s - T0, r.match_type, r.record.vessel_name) for r in sanctions_match.sanction_events(track(rows), known).orderBy("t_s").collect()]
    assert got == [("230000001", 0, "IMO_EXACT_MATCH", "LATER"), ("273000002", 10, "HIGH_RISK_FLAG", None), ("230000001", 3600, "MMSI_EXACT_MATCH", "BY MMSI")]


def test_risk_tiers_reset_and_signals(spark, track):
    day = 86400
    port = dict(latitude=54.70, longitude=20.45, mmsi="273000001")
    sea = dict(latitude=57.0, longitude=20.0, mmsi="273000001")
    rows = [dict(sea, t=0), dict(port, t=100), dict(port, t=100 + day), dict(port, t=101 + day), dict(port, t=102 + 2 * day), dict(port, t=3 * day), dict(sea, t=10 * day + 10)]
    got = [(r.t_s - T0, r.score, r.severity) for r in risk.risk_events(track(rows)).orderBy("t_s").collect()]
    assert got == [(0, 30, "MEDIUM"), (100, 55, "HIGH"), (101 + day, 80, "CRITICAL"), (102 + 2 * day, 100, "CRITICAL"), (10 * day + 10, 30, "MEDIUM")]
    calm = track([dict(t=i * 100, mmsi="230000001", latitude=57.0, longitude=20.0) for i in range(4)])
    signals = calm.where("row_id > 0").select("mmsi", "t_s", "row_id", F.lit("sts").alias("kind"))
    got = [(r.score, r.reason) for r in risk.risk_events(calm, signals).orderBy("t_s").collect()]
    assert got == [(40, "crossed into MEDIUM risk tier"), (60, "crossed into HIGH risk tier")]
    ports = json.loads(risk.score_vessel_risk(track(rows)).orderBy("detected_at").collect()[1].details)
    assert ports["visited_russian_ports"] == ["Kaliningrad"] and ports["risk_tier"] == "HIGH"


def test_incident_gap_is_half_open(spark):
    def alert(i, t, kind):
        return (f"a{i}", kind, "HIGH", "1", "SHIP", 57.0, 20.0, T0 + t)

    data = [alert(0, 0, "DARK_EVENT"), alert(1, 1799, "CABLE_PROXIMITY"), alert(2, 1799 + 1800, "ANCHOR_DRAGGING"), alert(3, 3700, "CABLE_PROXIMITY")]
    df = spark.createDataFrame(data, "alert_id string, alert_type string, severity string, mmsi string, vessel_name string, latitude double, longitude double, s long")
    df = df.withColumn("detected_at", F.timestamp_seconds("s")).withColumn("title", F.lit("t"))
    rows = incidents.correlate_incidents(df).orderBy("first_alert_time").collect()
    assert [(r.alert_types, r.severity, r.risk_score) for r in rows] == [(["DARK_EVENT", "CABLE_PROXIMITY"], "CRITICAL", 92), (["ANCHOR_DRAGGING", "CABLE_PROXIMITY"], "CRITICAL", 100)]
    assert rows[1].title == "Potential Cable Threat: SHIP dragging anchor near infrastructure"


def test_fishing_pattern_and_once_per_visit(track, zones):
    rows = [dict(t=i * 180, latitude=57.1 + 0.01 * ((i * 7) % 5), longitude=19.3 + 0.01 * ((i * 3) % 5), speed_over_ground=((i * 5) % 9) * 0.8, course_over_ground=float(i * 67 % 360), ship_type=30) for i in range(15)]
    every = fishing.fishing_events(track(rows), zones).collect()
    assert len(every) == 6 and {r.zone_id for r in every} == {"MPA"}
    assert fishing.fishing_events(track(rows), zones, once_per_visit=True).count() == 1
    assert geofence.geofence_events(track(rows), zones).count() == 15
    assert geofence.geofence_events(track(rows), zones, on_entry_only=True).count() == 1


def test_all_detectors_union(spark, track, zones):
    rows = [dict(t=i * 120, latitude=57.6, speed_over_ground=0.2, mmsi="273000001", ship_type=80) for i in range(6)]
    records = latest_sanctions(dims.high_risk_flags(spark).withColumn("offset", F.lit(0).cast("long")))
    out = pipeline.run_pipeline(track(rows), zones, records)
    kinds = {r.alert_type for r in out.collect()}
    assert out.columns == ALERT_COLUMNS and {"CABLE_PROXIMITY", "SANCTIONS_MATCH", "DARK_EVENT"} <= kinds


def test_detectors_are_prepared_side_by_side(spark, track, monkeypatch):
    # Every detector waits until all have begun; one by one, none would ever go on.
    begun = threading.Barrier(12, timeout=20)

    def detector(*args, **options):
        begun.wait()
        kept = spark.sparkContext.getLocalProperty("callers")
        return spark.range(1).select(F.lit(kept).alias("kept"))

    for name in [n for n in vars(pipeline) if n.startswith("detect_")] + ["score_vessel_risk"]:
        monkeypatch.setattr(pipeline, name, detector)
    spark.sparkContext.setLocalProperty("callers", "own")
    out = pipeline.run_pipeline(track([dict(t=0)]), None, None)
    spark.sparkContext.setLocalProperty("callers", None)
    assert [r.kept for r in out.collect()] == ["own"] * 12
