"""Stored tracks through the detectors, and the scalar functions in SQL."""

from __future__ import annotations

import json

from conftest import T0
from pyspark.sql import functions as F

from harborlight import dims
from harborlight.functions import ais, alerts, geo, sql
from harborlight.operators.throttle import throttle
from harborlight.plans.replay import replay
from harborlight.sources import positions as src
from harborlight.streaming import live


def _track(mmsi, start, status=None):
    points = [
        {"mmsi": mmsi, "timestamp": start + 300 * i, "lat": 57.6, "lon": 21.0, "sog": 0.2 if i % 4 else 2.0, "cog": 10.0, "nav_status": status}
        for i in range(12)
    ]
    return {
        "metadata": {"vessel": "V", "mmsi": mmsi, "imo": "9"},
        "track": [
            {"timestamp": "2024-01-01T02:00:00Z", "lat": 57.6, "lon": 21.0, "speed_kn": 1.0, "status": "s", "location": "l", "alert": "ANCHOR_DRAG"},
            {"timestamp": "2024-01-01T02:05:00Z", "lat": 57.6, "lon": 21.0, "speed_kn": 1.0, "status": "s", "location": "l"},
        ],
        "ais_positions_for_replay": points,
    }


def test_replay_runs_detectors_and_keeps_tags(spark, tmp_path):
    docs = {"a": _track("273000001", T0, 1), "b": _track("230000002", T0 + 60), "again": _track("273000001", T0, 1), "empty": {"metadata": {"mmsi": "1"}}}
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    found = replay(src.read_tracks(spark, str(tmp_path)), dims.zones(spark)).collect()
    by = {(r.mmsi, r.alert_type) for r in found if r.origin == "detector"}
    assert by == {("273000001", "CABLE_PROXIMITY"), ("230000002", "CABLE_PROXIMITY"), ("273000001", "ANCHOR_DRAGGING")}
    assert sum(r.origin == "tag" for r in found) == 3  # a tag of each document
    ids = [r.alert_id for r in found if r.origin == "detector"]
    assert len(ids) == len(set(ids))  # the second copy of a track adds none
    none = src.read_tracks(spark, str(tmp_path / "empty.json"))
    assert replay(none, dims.zones(spark)).count() == 0


def test_replayed_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "tracks"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.json").write_text(json.dumps(_track(f"27300000{i}", T0 + i)))
    zones = dims.zones(spark)
    stream = spark.readStream.schema(src.REPLAY_SCHEMA).option("multiLine", True).json(str(folder))
    positions = src.replay_positions(stream).withColumn("event_time", F.timestamp_seconds("t_s")).withWatermark("event_time", "10 minutes")
    q = live.cable_stream(positions, zones).writeStream.format("memory").queryName("replayed").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    batch = replay(src.read_tracks(spark, str(folder)), zones).where("origin = 'detector' and alert_type = 'CABLE_PROXIMITY'")
    want = {(r.mmsi, r.detected_at.timestamp()) for r in batch.collect()}
    assert want and {(r.mmsi, float(r.t_s)) for r in spark.table("replayed").collect()} == want


def test_sql_functions_equal_the_column_functions(spark):
    names = sql.register(spark, "t_")
    assert set(names) == {"t_" + n for n in sql.bodies()}
    assert sql.register(spark, "t_") == names  # again is no error
    mmsis = ["273000001", "12", None, "000000000", "AB0000000", "199000000", "613123456", "999000001", "1234567890"]
    rows = [
        (m, t, s, a, b, c, d)
        for i, m in enumerate(mmsis)
        for t, s, a, b, c, d in [
            (None, None, None, 1.0, 2.0, 3.0), (0, "LOW", 57.0, 21.0, 57.0, 21.0), (30 + i, "CRITICAL", 57.0, 20.0 + i, 58.5, 350.0), (79 + i, "x", -89.9, 179.9, 89.9, -179.9),
        ]
    ]
    df = spark.createDataFrame(rows, "mmsi string, ship_type int, severity string, a double, b double, c double, d double")
    place = ("a", "b", "c", "d")
    pairs = {
        "t_haversine_nm(a, b, c, d)": geo.haversine_nm(*place), "t_haversine_m(a, b, c, d)": geo.haversine_m(*place),
        "t_bearing(a, b, c, d)": geo.bearing(*place), "t_course_diff(b, d)": geo.course_diff("b", "d"),
        "t_in_box(a, b, 50, 0, 60, 21)": geo.in_boxes("a", "b", [(50.0, 0.0, 60.0, 21.0)]),
        "t_is_fishing(ship_type)": ais.is_fishing("ship_type"), "t_is_tanker(ship_type)": ais.is_tanker("ship_type"),
        "t_is_cargo(ship_type)": ais.is_cargo("ship_type"), "t_vessel_category(ship_type)": ais.vessel_category("ship_type"),
        "t_mid(mmsi)": ais.mid("mmsi"), "t_mmsi_problem(mmsi)": ais.mmsi_check("mmsi")["problem"],
        "t_flag_category(t_flag_investigator(mmsi))": ais.flag_category(ais.flag_state("mmsi", "investigator")),
        "t_severity_rank(severity)": alerts.severity_rank("severity"),
    } | {f"t_flag_{s}(mmsi)": ais.flag_state("mmsi", s) for s in ("cable", "display", "investigator", "spoofing")}
    differ = df.select(*[(~F.expr(q).eqNullSafe(c)).cast("int").alias(q.split("(")[0]) for q, c in pairs.items()])
    sums = differ.agg(*[F.sum(c).alias(c) for c in differ.columns]).first().asDict()
    rounded = {"t_haversine_nm", "t_haversine_m", "t_bearing"}
    assert {k for k, v in sums.items() if v} <= rounded
    close = [F.max(F.abs(F.expr(q) - c)) for q, c in pairs.items() if q.split("(")[0] in rounded]
    assert max(df.agg(*close).first()) < 1e-6


def test_track_files_follow_the_reports_not_the_vessels(spark, tmp_path):
    from checks.files import _tracks
    from checks.registry import Tables

    events = spark.range(600).selectExpr(
        "id as event_id", "timestamp '2024-01-01 00:00:00' as ts", "id % 200 as user_id", "'x' as event_type", "1d as value", "'' as props"
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    tracks = _tracks(Tables(spark, str(tmp_path)))
    assert tracks.count() > 100 and len(tracks.inputFiles()) == 1
    # A line a track: the whole file is in no single row, but still one document.
    assert spark.read.text(tracks.inputFiles()).count() == tracks.count() > 1
    listed = json.loads("\n".join(r.value for r in spark.read.text(tracks.inputFiles(), wholetext=True).collect()))
    assert len(listed) == tracks.count()
