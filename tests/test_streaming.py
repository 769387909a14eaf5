"""Streams fed from files give the rows of the batch functions."""

from __future__ import annotations

import json

import pytest
from conftest import T0

from harborlight import dims
from harborlight.operators.throttle import throttle
from harborlight.functions.alerts import ALERT_SCHEMA
from harborlight.plans import spoofing
from harborlight.plans.cable import cable_events
from harborlight.plans.incidents import correlate_incidents
from harborlight.plans.trajectory import trajectory_events
from harborlight.sources.positions import parse_positions, with_event_time
from harborlight.streaming import live, stateful, topics


def iso(t):
    from datetime import datetime, timezone

    return datetime.fromtimestamp(T0 + t, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def message(t, mmsi="273000001", **more):
    return json.dumps(dict(mmsi=mmsi, timestamp=iso(t), latitude=57.6, longitude=21.0, speed_over_ground=0.2, ship_type=70, ship_name="S", **more))


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def drain(df, name, checkpoint, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


@pytest.fixture
def feed(tmp_path):
    folder = tmp_path / "feed"
    lines = [message(t) for t in range(0, 6000, 240)] + [message(t, mmsi="230000002") for t in range(100, 6000, 500)]
    write(folder, "1.json", lines[:10] + ["{broken", '{"mmsi": ""}'])
    write(folder, "2.json", lines[10:])
    return folder


def test_cable_stream_equals_batch(spark, feed, tmp_path):
    zones = dims.zones(spark)
    stream = topics.positions_stream(topics.read_folder(spark, str(feed)))
    got = drain(live.cable_stream(stream, zones), "cables", tmp_path / "c1")
    batch = with_event_time(parse_positions(spark.read.text(str(feed)))).withColumnRenamed("timestamp", "ts_text")
    want = cable_events(batch, zones).collect()
    assert want and {(r.mmsi, r.t_s, r.zone_id, r.severity) for r in got} == {(r.mmsi, r.t_s, r.zone_id, r.severity) for r in want}


def test_throttle_stream_keeps_state_between_batches(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.json", [message(t) for t in (0, 300, 899)])
    stream = topics.positions_stream(topics.read_folder(spark, str(folder), files_per_trigger=1))
    kept = stateful.throttle_stream(stream, ["mmsi"], 900)
    q = kept.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    write(folder, "b.json", [message(t) for t in (900, 1000, 1800)])
    q.processAllAvailable()
    q.stop()
    assert sorted(r.t_s - T0 for r in spark.table("kept").collect()) == [0, 900, 1800]
    batch = with_event_time(parse_positions(spark.read.text(str(folder))))
    assert sorted(r.t_s - T0 for r in throttle(batch, ["mmsi"], 900).collect()) == [0, 900, 1800]


def dark_message(t, mmsi="230000007"):
    return json.dumps(dict(mmsi=mmsi, timestamp=iso(t), latitude=57.0, longitude=20.0, speed_over_ground=9.0, ship_type=80, ship_name="D", imo_number="9000007"))


def test_silence_is_told_on_return_and_by_timer(spark, tmp_path):
    folder = tmp_path / "in"
    # A silence of 39 minutes that ends inside one batch.
    write(folder, "a.json", [dark_message(t) for t in (0, 60, 120, 180, 240, 300, 300 + 39 * 60)])
    stream = topics.positions_stream(topics.read_folder(spark, str(folder), files_per_trigger=1), "1 minute")
    q = stateful.gone_dark_stream(stream).writeStream.format("memory").queryName("dark").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    rows = spark.table("dark").collect()
    assert [(r.t_s - T0, r.gap_minutes, r.stage) for r in rows] == [(300, 39, "returned")]
    # Another vessel moves the watermark on, and the timer fires.
    write(folder, "b.json", [dark_message(300 + 39 * 60 + 4000, mmsi="230000008")])
    q.processAllAvailable()
    write(folder, "c.json", [dark_message(300 + 39 * 60 + 9000, mmsi="230000008")])
    q.processAllAvailable()
    q.stop()
    told = [r for r in spark.table("dark").collect() if r.stage == "silent"]
    assert [(r.mmsi, r.t_s - T0) for r in told] == [("230000007", 300 + 39 * 60)] and told[0].gap_minutes >= 30


def test_incident_stream_closes_after_gap(spark, tmp_path):
    folder = tmp_path / "in"

    def alert(t, kind, **more):
        return json.dumps(dict(mmsi="1", alert_id=f"{kind}{t}", alert_type=kind, detected_at=iso(t), severity="HIGH", title="T", **more))

    write(folder, "a.json", [alert(0, "DARK_EVENT"), alert(100, "CABLE_PROXIMITY", vessel_name="B", latitude=57.0, longitude=20.0),
                             alert(1899, "DARK_EVENT", vessel_name="C", latitude=0.0, longitude=20.0), alert(3699, "CONVOY")])
    raw = spark.readStream.schema(ALERT_SCHEMA).json(str(folder))
    rows = drain(stateful.incidents_stream(raw), "incs", tmp_path / "c")
    columns = ["id", "mmsi", "ship_name", "severity", "title", "description", "alert_types", "alert_count", "location", "risk_score"]
    whole = correlate_incidents(spark.read.schema(ALERT_SCHEMA).json(str(folder))).select(*columns).collect()
    by_id = {r.id: [r[c] for c in columns] for r in whole}
    assert len(by_id) == 2 and {r.id for r in rows} == set(by_id)
    for r in rows:
        assert [r[c] for c in columns] == by_id[r.id]
    assert [(r.stage, r.last_s - T0) for r in rows if r.first_s == T0] == [("closed", 1899)]
    assert "open" in [r.stage for r in rows if r.first_s != T0]


def test_repeats_and_state_expiry(spark, tmp_path):
    """A message given twice counts once, and a cooldown is forgotten when the watermark has passed it."""
    folder = tmp_path / "in"
    write(folder, "a.json", [message(t, mmsi=f"27300000{v}") for v in range(8) for t in (0, 0, 300)])
    stream = topics.positions_stream(topics.read_folder(spark, str(folder), files_per_trigger=1), "1 minute")
    q = stateful.throttle_stream(stream, ["mmsi"], 900).writeStream.format("memory").queryName("expiry").option(
        "checkpointLocation", str(tmp_path / "c")
    ).start()
    q.processAllAvailable()

    def held():
        return [o["numRowsTotal"] for o in q.lastProgress["stateOperators"] if o["operatorName"].startswith("transformWithState")][0]

    busy = held()
    write(folder, "b.json", [message(300)])
    write(folder, "c.json", [message(9000, mmsi="230000099")])
    q.processAllAvailable()
    write(folder, "d.json", [message(9001, mmsi="230000099"), message(9200)])
    q.processAllAvailable()
    after = held()
    q.stop()
    assert busy >= 8 and after < busy
    rows = sorted((r.mmsi, r.t_s - T0) for r in spark.table("expiry").collect())
    assert rows == sorted([(f"27300000{v}", 0) for v in range(8)] + [("230000099", 9000), ("273000001", 9200)])


def test_trajectory_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    zones = dims.zones(spark)

    def sailing(t, mmsi, lat, **more):
        return json.dumps(dict(dict(mmsi=mmsi, timestamp=iso(t), latitude=lat, longitude=21.0, speed_over_ground=14.0, course_over_ground=0.0, ship_type=70, ship_name="T"), **more))

    lines = [sailing(t, "230000021", 55.5 + t / 3600 * 14 / 60) for t in range(0, 40_000, 600)]
    # Forged reports: a speed no vessel has, near the pole and anywhere.
    lines += [sailing(50, "230000022", 89.5, speed_over_ground=10_000.0), sailing(60, "230000023", -40.0, speed_over_ground=1e7)]
    write(folder, "a.json", lines[::2] + lines[1::2])
    stream = topics.positions_stream(topics.read_folder(spark, str(folder)))
    got = drain(live.trajectory_stream(stream, zones), "paths", tmp_path / "c")
    batch = with_event_time(parse_positions(spark.read.text(str(folder))))
    want = trajectory_events(batch, zones).collect()
    assert want and {(r.mmsi, r.t_s, r.zone_id) for r in got} == {(r.mmsi, r.t_s, r.zone_id) for r in want}


def test_change_feed_and_table_sink(spark, feed, tmp_path):
    stream = topics.positions_stream(topics.read_folder(spark, str(feed)))
    rows = drain(topics.vessel_change_feed(stream), "changes", tmp_path / "c", mode="update")
    assert max(r.t_s for r in rows if r.mmsi == "273000001") == T0 + 5760
    again = topics.positions_stream(topics.read_folder(spark, str(feed)))
    q = topics.write_table(again, str(tmp_path / "out"), str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 25 + 12


def test_upsert_trails_is_idempotent_and_bounded(spark, tmp_path):
    path = str(tmp_path / "trails")
    schema = "mmsi string, t_s long, row_id long, latitude double, longitude double"
    a = spark.createDataFrame([("a", T0 + i, i, 57.0 + i, 20.0) for i in range(8)], schema)
    b = spark.createDataFrame([("a", T0 + i, i, 57.0 + i, 20.0) for i in range(6, 12)] + [("b", T0 - 400_000, 99, 1.0, 1.0)], schema)
    for batch in (a, b, b):
        live.upsert_trails(batch, path, now_s=T0 + 20, points=5)
    rows = spark.read.parquet(path).orderBy("t_s").collect()
    assert [(r.mmsi, r.row_id) for r in rows] == [("a", i) for i in range(7, 12)]


def test_geofence_stream_static_join(spark, feed, tmp_path):
    zones = dims.zones(spark, [dims.box_zone("R", "restricted", 20.5, 21.5, 57.0, 58.0)])
    stream = topics.positions_stream(topics.read_folder(spark, str(feed)))
    got = drain(live.geofence_stream(stream, zones).select("mmsi", "t_s", "zone_id"), "fences", tmp_path / "c")
    assert len(got) == 25 + 12 and {r.zone_id for r in got} == {"R"}


def test_memory_streams_equal_batch(spark, tmp_path):
    folder = tmp_path / "in"

    def msg(t, lat, **more):
        return json.dumps(dict(mmsi="230000011", timestamp=iso(t), latitude=lat, longitude=20.0, speed_over_ground=4.0, course_over_ground=0.0, heading=0.0, ship_type=70, ship_name="M", **more))

    write(folder, "a.json", [msg(0, 57.0, imo_number="9000001"), msg(60, 59.0), msg(120, 59.0, nav_status=1)])
    stream = topics.positions_stream(topics.read_folder(spark, str(folder), files_per_trigger=1))
    found = live.spoofing_stream(stream).select("t_s", "check", "severity")
    q = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    write(folder, "b.json", [msg(180, 57.0, imo_number="9000002"), msg(240, 57.0, nav_status=1), msg(300, 57.01, nav_status=5)])
    q.processAllAvailable()
    q.stop()
    batch = with_event_time(parse_positions(spark.read.text(str(folder))))
    want = spoofing.spoofing_findings(batch).select("t_s", "check", "severity").collect()
    assert len(want) == 3 and sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, want))
    again = topics.positions_stream(topics.read_folder(spark, str(folder), files_per_trigger=1))
    drags = drain(live.anchor_stream(again).select("t_s", "cause"), "drags", tmp_path / "c2")
    assert [(r.t_s - T0, r.cause) for r in drags] == [(300, "fast")]
