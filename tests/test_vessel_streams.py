"""Fishing, risk and naming as streams, restarts, and zones and sanctions that change while positions are read."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from test_pair_streams import batch, feed, line, ordered_files, run, shuffled

from harborlight import dims
from harborlight.plans import fishing, loitering, risk, spoofing
from harborlight.plans.geofence import geofence_events
from harborlight.plans.sanctions_match import sanction_events, sanction_matches
from harborlight.sources.reference import parse_reference, parse_sanctions
from harborlight.streaming import dimensions, live, topics, vessels


@pytest.fixture(autouse=True)
def few_parts(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fishing_stream_equals_batch(spark, tmp_path):
    rng, lines = random.Random(4), []
    for v, kind in enumerate((30, 70, 30)):
        lat, lon = 57.5, 20.5 + v
        for t in range(v * 7, 5 * 3600, 170):
            speed, course = rng.choice([0.5, 1.0, 4.0, 6.0]), rng.choice([0.0, 90.0, 200.0, None])
            lines.append((t, line(t, f"23000010{v}", lat, lon, ship_type=kind, speed_over_ground=speed, course_over_ground=course)))
            lat, lon = lat + rng.uniform(-0.01, 0.01), lon + rng.uniform(-0.01, 0.01)
    zones = dims.zones(spark, [dims.box_zone("M", "MPA", 20.0, 21.0, 57.0, 58.0), dims.box_zone("E", "EEZ", 21.0, 23.0, 57.0, 58.0)])
    folder = tmp_path / "feed"
    feed(folder, shuffled(sorted(lines)), 3)
    columns = ["mmsi", "t_s", "row_id", "zone_id", "course_changes", "positions_analyzed", "severity", "title"]

    def rows(found):
        return sorted((*(r[c] for c in columns), round(r.confidence, 6), round(r.speed_variance, 6)) for r in found)

    got, left = run(vessels.fishing_stream(ordered_files(spark, folder), zones), "fishing", tmp_path / "c")
    want = fishing.fishing_events(batch(spark, folder), zones).collect()
    assert len(want) >= 20 and {r.zone_id for r in want} == {"M", "E"} and rows(got) == rows(want)
    # A vessel's list is forgotten after a week; the waiting rows are gone at once.
    assert left["transformWithStateInPandasExec"] <= 6


def risk_lines():
    """High-risk flags and others call at listed ports, again within and after a day, and return after a week of silence."""
    rng, lines = random.Random(8), []
    ports = [(lat, lon) for _, lat, lon in dims.RUSSIAN_PORTS]
    mids = [m for m in dims.HIGH_RISK_MIDS][:2] + ["230"]
    for v in range(6):
        mmsi, t = f"{mids[v % 3]}0000{v:02d}", rng.randrange(900)
        while t < 20 * 86400:
            lat, lon = rng.choice(ports) if rng.random() < 0.35 else (57.0, 19.0)
            lines.append((t, line(t, mmsi, lat + 0.001, lon, speed_over_ground=9.0)))
            t += rng.choice([300, 4000, 15_000, 50_000, 90_000, 8 * 86400 if rng.random() < 0.2 else 700])
    return sorted(lines)


def test_risk_stream_equals_batch_over_a_restart(spark, tmp_path):
    lines = risk_lines()
    folder, half = tmp_path / "feed", len(lines) // 2
    folder.mkdir()
    columns = ["mmsi", "t_s", "row_id", "score", "previous_score", "port_count", "high_risk_flag", "reason", "severity", "title"]
    rows = lambda found: sorted(tuple(r[c] for c in columns) for r in found)
    (folder / "000.json").write_text("\n".join(shuffled(lines[:half])) + "\n")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")

    def go():
        q = topics.write_table(vessels.risk_stream(ordered_files(spark, folder)), out, checkpoint).start()
        q.processAllAvailable()
        q.stop()

    go()
    before = spark.read.parquet(out).count()
    (folder / "001.json").write_text("\n".join(shuffled(lines[half:])) + "\n")
    for k, t in enumerate((30 * 86400, 60 * 86400)):
        (folder / f"9{k}.json").write_text(line(t, "230000099", 40.0, 5.0) + "\n")
    go()
    want = risk.risk_events(batch(spark, folder)).collect()
    found = spark.read.parquet(out).collect()
    assert 0 < before < len(want) and rows(found) == rows(want)
    assert all(r.port_count == 0 or r.visited_ports for r in found)


def test_signals_raise_the_score(spark, tmp_path):
    mid = next(iter(dims.HIGH_RISK_MIDS))
    folder = tmp_path / "feed"
    feed(folder, [line(t, f"{mid}000001", 57.0, 19.0) for t in range(0, 3600, 600)], 1)
    reports = batch(spark, folder).where("t_s < 1704070800 and mmsi not like '23%'")
    kinds = reports.orderBy("t_s").limit(3).selectExpr("mmsi", "t_s", "row_id", "explode(array('dark', 'sts')) as kind").collect()
    told = tmp_path / "signals"
    told.mkdir()
    (told / "a.json").write_text("\n".join(json.dumps(r.asDict()) for r in kinds) + "\n")
    for k, t in enumerate((40_000, 90_000)):
        (told / f"b{k}.json").write_text(json.dumps(dict(mmsi="1", t_s=1704067200 + t, row_id=1, kind="dark")) + "\n")
    schema = "mmsi string, t_s long, row_id long, kind string"
    signals = spark.readStream.schema(schema).json(str(told)).selectExpr("*", "timestamp_seconds(t_s) as event_time").withWatermark("event_time", "10 minutes")
    columns = ["mmsi", "t_s", "score", "previous_score", "dark_count", "sts_count", "ship_name", "severity"]
    got, _ = run(vessels.risk_stream(ordered_files(spark, folder), signals), "signalled", tmp_path / "c")
    want = risk.risk_events(batch(spark, folder), spark.read.schema(schema).json(str(told / "a.json"))).collect()
    rows = lambda found: sorted(tuple(r[c] for c in columns) for r in found)
    assert rows(r for r in got if r.mmsi != "1") == rows(want) and max(r.score for r in want) >= 75


def test_all_checks_in_the_spoofing_stream(spark, tmp_path):
    def told(t, mmsi, lat=57.0, lon=20.0, **more):
        return t, line(t, mmsi, lat, lon, **(dict(heading=10.0, speed_over_ground=4.0, ship_name="A") | more))

    lines = [told(t, "230000011", ship_name=n) for t, n in enumerate(["A", "B", "A", None, "C", "b", "D", "E", "Unknown", "C"])]
    lines += [told(0, "12345"), told(5, "230000012", speed_over_ground=70.0), told(5, "230000013"), told(65, "230000013", lat=59.0)]
    lines += [told(5, "230000014"), told(9, "230000014", heading=200.0), told(5, "230000015", lat=91.5), told(6, "230000016", 0.01, 0.01)]
    lines += [told(5, "230000017", imo_number="9000001"), told(8, "230000017", imo_number="9000002"), told(3, "600000001"), told(4, "111111111")]
    folder = tmp_path / "feed"
    feed(folder, [text for _, text in sorted(lines)], 2)
    columns = ["mmsi", "t_s", "check", "severity", "title", "text", "details"]
    rows = lambda found: sorted(tuple(r[c] for c in columns) for r in found)
    got, _ = run(live.spoofing_stream(ordered_files(spark, folder)), "spoofed", tmp_path / "c")
    want = spoofing.spoofing_findings(batch(spark, folder)).collect()
    assert {r.check for r in want} == set(spoofing.CHECKS) and rows(got) == rows(want)


def zone_message(zone_id, west, name="Z"):
    ring = [[west, 57.0], [west + 1, 57.0], [west + 1, 58.0], [west, 58.0], [west, 57.0]]
    data = dict(zone_id=zone_id, zone_name=name, zone_type="restricted", geometry=dict(type="Polygon", coordinates=[ring]), rules=dict(alert_all_vessels=True))
    return json.dumps(dict(record_type="geofence", data=data))


def test_a_zone_is_replaced_while_positions_are_read(spark, tmp_path):
    reports, told = tmp_path / "positions", tmp_path / "zones"
    reports.mkdir(), told.mkdir()
    (told / "1.json").write_text(zone_message("A", 20.0) + "\n")
    messages = topics.read_folder(spark, str(told)).selectExpr("get_json_object(value, '$.data.zone_id') as key", "value", "offset")
    table, out = str(tmp_path / "table"), str(tmp_path / "out")
    keeping = dimensions.keep_newest(messages, table, str(tmp_path / "c1")).start()
    keeping.processAllAvailable()
    positions = topics.positions_stream(topics.read_folder(spark, str(reports)))

    def detect(rows, dimension):
        return geofence_events(rows, parse_reference(dimension)).select("mmsi", "t_s", "zone_id", "zone_name")

    reading = dimensions.with_newest(positions, table, detect, out, str(tmp_path / "c2")).start()
    try:
        (reports / "1.json").write_text(line(0, "230000001", 57.5, 20.5) + "\n" + line(0, "230000002", 57.5, 22.5) + "\n")
        reading.processAllAvailable()
        # The zone moves, another one comes, and the positions query goes on.
        (told / "2.json").write_text(zone_message("A", 22.0, "moved") + "\n" + zone_message("B", 24.0) + "\n")
        keeping.processAllAvailable()
        (reports / "2.json").write_text("\n".join(line(60, f"23000000{v}", 57.5, 18.5 + 2 * v) for v in (1, 2, 3)) + "\n")
        reading.processAllAvailable()
    finally:
        reading.stop(), keeping.stop()
    found = sorted((r.mmsi, r.t_s % 100, r.zone_id, r.zone_name) for r in spark.read.parquet(out).collect())
    assert found == [("230000001", 0, "A", "Z"), ("230000002", 60, "A", "moved"), ("230000003", 60, "B", "Z")]
    assert dimensions.newest(spark, table).count() == 2 and len(dimensions.versions(spark, table)) == 2


def sanctioned(imo, name):
    return json.dumps(dict(record_type="SANCTIONED_VESSEL", imo_number=imo, vessel_name=name, risk_level="high"))


def test_a_sanction_takes_effect_and_is_lifted(spark, tmp_path):
    reports, told = tmp_path / "positions", tmp_path / "lists"
    reports.mkdir(), told.mkdir()
    messages = topics.read_folder(spark, str(told)).selectExpr(
        "get_json_object(value, '$.imo_number') as key", "if(value like '%LIFTED%', null, value) as value", "offset"
    )
    table, out = str(tmp_path / "table"), str(tmp_path / "out")
    keeping = dimensions.keep_newest(messages, table, str(tmp_path / "c1")).start()
    positions = topics.positions_stream(topics.read_folder(spark, str(reports)))

    def detect(rows, dimension):
        return sanction_matches(rows, parse_sanctions(dimension)).select("mmsi", "t_s", "match_type", "record.vessel_name")

    reading = dimensions.with_newest(positions, table, detect, out, str(tmp_path / "c2")).start()
    try:
        for n, lists in enumerate(([], [sanctioned("9000001", "ONE")], [sanctioned("9000001", "LIFTED"), sanctioned("9000002", "TWO")])):
            (told / f"{n}.json").write_text("\n".join(lists) + "\n")
            keeping.processAllAvailable()
            (reports / f"{n}.json").write_text("\n".join(line(60 * n, f"23000000{v}", 57.5, 20.5, imo_number=f"900000{v}") for v in (1, 2)) + "\n")
            reading.processAllAvailable()
    finally:
        reading.stop(), keeping.stop()
    found = sorted((r.mmsi, r.t_s % 1000, r.vessel_name) for r in spark.read.parquet(out).collect())
    assert found == [("230000001", 1704067260 % 1000, "ONE"), ("230000002", 1704067320 % 1000, "TWO")]


def test_shadow_fleet_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "feed"
    feed(folder, shuffled([(t, line(t, f"2300000{v:02d}", 57.5, 20.5, imo_number=f"90000{v:02d}")) for v in range(6) for t in range(v, 9000, 700)]), 1)
    spark.createDataFrame([(sanctioned(f"90000{v:02d}", f"N{v}"), v) for v in (1, 3, 4)], "value string, offset long").createOrReplaceTempView("lists")
    records = parse_sanctions(spark.table("lists"))
    got, _ = run(live.shadow_fleet_stream(ordered_files(spark, folder), records), "shadow", tmp_path / "c")
    want = sanction_events(batch(spark, folder), records).collect()
    rows = lambda found: sorted((r.mmsi, r.t_s, r.match_type, r.record.vessel_name) for r in found)
    assert len(want) == 9 and rows(got) == rows(want)


def test_loitering_stream_equals_batch(spark, tmp_path):
    rng, lines = random.Random(6), []
    for v in range(4):
        lat, lon = 57.5 + v, 20.5
        for t in range(v * 7, 8 * 3600, 110 + 40 * v):
            speed = rng.choice([0.1, 0.4, None])
            lines.append((t, line(t, f"23000020{v}", lat, lon, speed_over_ground=speed)))
            step = 0.05 if rng.random() < 0.01 * v else 0.0008
            lat, lon = lat + rng.uniform(-step, step), lon + rng.uniform(-step, step)
    folder = tmp_path / "feed"
    feed(folder, shuffled(sorted(lines)), 2)
    columns = ["mmsi", "t_s", "row_id", "loiter_minutes", "position_count", "severity", "title"]

    def rows(found):
        return sorted((*(r[c] for c in columns), *(round(r[c], 6) for c in ("loiter_radius_nm", "average_speed", "center_lat"))) for r in found)

    got, left = run(vessels.loitering_stream(ordered_files(spark, folder)), "loiter", tmp_path / "c")
    want = loitering.loitering_events(batch(spark, folder)).collect()
    assert len(want) >= 8 and rows(got) == rows(want)
    assert left["transformWithStateInPandasExec"] <= 4


def test_a_report_each_second_for_a_day(spark):
    """86,400 reports with frames of 7,200: measured without a list per report, and as over the plain frames."""
    rng = np.random.default_rng(5)
    n = 86_400
    lat, lon = 57.0 + np.cumsum(rng.normal(0, 1e-6, n)), 20.0 + np.cumsum(rng.normal(0, 1e-6, n))
    frames = loitering.Frames(np.arange(n), lat, lon, np.full(n, np.nan), 7200)
    for i in [*range(0, n, 9973), n - 1]:
        first = max(0, i - 7200)
        centre = lat[first : i + 1].mean(), lon[first : i + 1].mean()
        farthest = loitering.nm_from(*centre, np.column_stack((lat, lon))[first : i + 1]).max()
        found = frames.measure(i, 50.0, 0)
        assert found is None if i < 2 else abs(found[0] - farthest) < 1e-9 and found[2:4] == (i + 1 - first, 0.0)
    sharp = np.random.default_rng(6).uniform(-1, 1, (500, 2))
    corners = loitering.hull(sharp)
    for angle in np.linspace(0, 6.28, 50):
        way = np.array([np.cos(angle), np.sin(angle)])
        assert np.isclose((sharp @ way).max(), (corners @ way).max())
    day = spark.range(n).selectExpr(
        "'230000001' as mmsi", "1704067200 + id as t_s", "id as row_id", "57.0 + 0.001 * sin(id / 500) as latitude",
        "20.0D + 0.001 * cos(id / 300) as longitude", "0.1D as speed_over_ground", "'S' as ship_name",
    ).selectExpr("*", "cast(null as string) as imo_number")
    kept = loitering.loitering_candidates(day)
    assert kept.count() == n - 45 * 60
