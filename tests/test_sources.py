from __future__ import annotations

import json
import os
import time
from datetime import datetime, timezone

from pyspark.sql import functions as F

from harborlight import dims
from harborlight.functions import ais, alerts, geo
from harborlight.plans.investigate import parse_timeframe
from harborlight.sources import fleet, positions as src, reference


def raw(kind, mmsi, body, **meta):
    m = dict(MMSI=mmsi, ShipName="META", latitude=58.9, longitude=19.4, time_utc="2024-01-01 12:00:00.123456789 +0000 UTC", **meta)
    if mmsi is None:
        del m["MMSI"]
    return json.dumps({"MessageType": kind, "MetaData": m, "Message": {kind: body}})


def test_normalize_three_types_and_drops(spark):
    messages = [
        raw("PositionReport", 230145678, {"MessageID": 3, "Cog": 47.2, "Sog": 8.6, "TrueHeading": 51, "NavigationalStatus": 5}),
        raw("ShipStaticData", 265547210, {"Name": "", "Type": 83, "ImoNumber": 9387421, "Dimension": {"A": 112, "B": 31, "C": 9, "D": 14}}),
        raw("StandardClassBPositionReport", 276003491, {"Sog": 3.4, "Cog": 212.0}),
        raw("PositionReport", None, {"Sog": 1.0}),
        raw("BaseStationReport", 5, {}),
        "{broken",
    ]
    rows = {r.mmsi: r for r in src.with_event_time(src.normalize_ais(spark.createDataFrame([(m,) for m in messages], "value string"))).collect()}
    assert set(rows) == {"230145678", "265547210", "276003491"}
    a, b, c = rows["230145678"], rows["265547210"], rows["276003491"]
    assert (a.message_type, a.speed_over_ground, a.course_over_ground, a.ship_type) == (3, 8.6, 47.2, None)
    assert (b.ship_type, b.imo_number, b.dimension_a, b.dimension_b, b.ship_name, b.speed_over_ground) == (83, "9387421", 112, 31, "META", None)
    assert (c.message_type, c.speed_over_ground, c.nav_status) == (18, 3.4, None)
    assert a.t_s == 1704110400


def test_event_time_forms(spark):
    forms = ["2024-01-01T12:00:00Z", "2024-01-01 12:00:00.5 +0000 UTC", "2024-01-01T12:00:00.123456789Z", "2024-01-01T14:00:00+02:00", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, f string").orderBy("i").select(F.unix_seconds(src.parse_event_time("f"))).collect()]
    assert got == [1704110400] * 4 + [None, None]


def test_geojson_files(spark, tmp_path):
    ring = [[20.0, 55.0], [21.0, 55.0], [21.0, 56.0], [20.0, 55.0]]
    typed = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": "C1", "name": "Cable", "zone_type": "cable_protection", "buffer_nm": 5}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}
    plain = {"type": "Feature", "properties": {"MRGID": 77, "GEONAME": "Park"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}
    (tmp_path / "cables.geojson").write_text(json.dumps(typed, indent=1))
    (tmp_path / "baltic_MPA.geojson").write_text(json.dumps(plain, indent=1))
    rows = {r.zone_id: r for r in reference.read_geojson_zones(spark, str(tmp_path)).collect()}
    assert (rows["C1"].zone_type, rows["C1"].severity, rows["C1"].jurisdiction, len(rows["C1"].rings)) == ("cable_protection", "HIGH", "EU", 1)
    assert (rows["77"].zone_name, rows["77"].zone_type, rows["77"].severity, len(rows["77"].rings)) == ("Park", "MPA", "HIGH", 2)
    assert rows["77"].rings[0][1].x == 21.0


def test_port_and_entity_files(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    (tmp_path / "a" / "ports.json").write_text(json.dumps({"ports": [{"locode": "FIHEL", "name": "Helsinki", "latitude": 60.1, "longitude": 24.9}]}))
    (tmp_path / "a" / "list.json").write_text(json.dumps([{"id": "X", "type": "major"}]))
    ports = {r.port_id: r for r in reference.read_ports(spark, str(tmp_path / "a")).collect()}
    assert (ports["FIHEL"].port_type, ports["FIHEL"].country, ports["X"].port_name, ports["X"].port_type) == ("minor", "", "Unknown", "major")
    (tmp_path / "b" / "eu_list.json").write_text(json.dumps({"entities": [{"id": "E1", "name": "N", "aliases": ["A"], "additional_info": {"k": "v"}}, {"id": "E2", "source": "OFAC"}]}))
    e = {r.entity_id: r for r in reference.read_sanction_entities(spark, str(tmp_path / "b")).collect()}
    assert (e["E1"].sanctions_source, e["E1"].aliases, e["E1"].additional_info, e["E2"].sanctions_source, e["E2"].name) == ("EU_LIST", ["A"], {"k": "v"}, "OFAC", "Unknown")


def test_replay_track(spark, tmp_path):
    doc = {
        "metadata": {"vessel": "V", "mmsi": "375", "imo": "9", "flag": "VC"},
        "track": [{"timestamp": "2025-12-30T12:00:00Z", "lat": 1.0, "lon": 2.0, "speed_kn": 3.0, "status": "s", "location": "l"},
                  {"timestamp": "2025-12-30T13:00:00Z", "lat": 1.0, "lon": 2.0, "speed_kn": 3.0, "status": "s", "location": "l", "alert": "CABLE_PROXIMITY"},
                  {"timestamp": "2025-12-30T14:00:00Z", "lat": 1.0, "lon": 2.0, "speed_kn": 3.0, "status": "s", "location": "l", "alert": "ANCHOR_DRAG"}],
        "ais_positions_for_replay": [{"mmsi": "375", "timestamp": 1735560000, "lat": 60.0, "lon": 28.5, "sog": 11.5, "cog": 270}],
    }
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=1))
    p = src.read_replay_track(spark, str(tmp_path / "t.json")).first()
    assert (p.mmsi, p.t_s, p.speed_over_ground, p.ship_name) == ("375", 1735560000, 11.5, "V")
    a = {r.alert_id: r for r in src.investigation_alerts(spark, str(tmp_path / "t.json")).collect()}
    assert (a["investigation-alert-1"].severity, a["investigation-alert-1"].alert_type) == ("HIGH", "CABLE_PROXIMITY")
    assert (a["investigation-alert-2"].severity, a["investigation-alert-2"].title) == ("CRITICAL", "ANCHOR DRAG")


def test_page_extraction_prefers_tables(spark):
    pages = spark.createDataFrame(
        [(1, "<tr><td>A &amp; B</td><td>9123456</td><td>RU</td></tr><tr><td>x</td><td>9999999</td></tr><p>LONE STAR (IMO 9000001)</p>"), (2, "<p>LONE STAR IMO: 9000001</p>"), (3, "<p>none</p>")],
        "page_id long, html string",
    )
    got = sorted(tuple(r) for r in fleet.extract_sanction_rows(pages).collect())
    assert got == [(1, "9123456", "A & B", "RU"), (2, "9000001", "LONE STAR", "")]


def test_names_in_text_take_time_in_proportion(spark):
    texts = {
        1: "THE GOOD SHIP (IMO 9000001) met Other One [IMO: 9000002], 7 IMO 9000003 and no imo 123; AB IMO9000004, LOST ( IMO 9000006); TWO\n WORDS\n(IMO 9000007)",
        2: "word " * 400_000 + "IMO 9000005", 3: " " * 300_000 + "x", 4: "a" * 300_000, 5: None, 6: "",
    }
    pages = spark.createDataFrame(list(texts.items()), "page_id long, html string")
    start = time.time()
    got = sorted(tuple(r) for r in fleet.extract_sanction_rows(pages).collect())
    assert got == [(1, "9000001", "THE GOOD SHIP", ""), (1, "9000002", "met Other One", ""), (1, "9000007", "TWO\n WORDS", "")]
    assert time.time() - start < 30


def test_scalar_cases(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c).first()[0]

    cats = {77: "cargo", 81: "tanker", 30: "fishing", 64: "passenger", 96: "other", None: "unknown", 0: "unknown"}
    for t, want in cats.items():
        assert value(ais.vessel_category(F.lit(t).cast("int"))) == want
    assert value(ais.format_coordinates(F.lit(59.44), F.lit(24.75))) == "59.4400° N, 24.7500° E"
    assert value(ais.format_coordinates(F.lit(-12.5), F.lit(-77.25))) == "12.5000° S, 77.2500° W"
    assert value(ais.format_speed(F.lit(7.8))) == "7.8 kts" and value(ais.format_speed(F.lit(None).cast("double"))) == "N/A"
    assert value(ais.format_course(F.lit(90.6))) == "91°"
    assert value(ais.nav_status_name(F.lit(1))) == "At anchor" and value(ais.nav_status_name(F.lit(99))) == "Unknown"
    assert value(ais.zone_type_from_filename(F.lit("sanctioned_eez"))) == "EEZ"
    assert value(alerts.max_severity(F.lit("LOW"), F.lit("HIGH"), F.lit("MEDIUM"))) == "HIGH"
    checks = {"12345678": "INVALID_LENGTH", "000000000": "SUSPICIOUS_PATTERN", "123456789": "SUSPICIOUS_PATTERN", "199000000": "INVALID_MID", "AB0000000": "NON_NUMERIC", "230000000": None}
    for m, want in checks.items():
        got = value(ais.mmsi_check(F.lit(m)))
        assert (got.problem if got else None) == want
    pts = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((57.0, 20.0), (58.0, 22.0))])
    assert value(geo.centroid(pts)) == (57.5, 21.0) and value(geo.points_area_nm2(F.slice(pts, 1, 1))) == 0.0
    assert value(ais.flag_display(F.lit("273000000"))) == ("RU", "Russia", True)
    assert value(ais.flag_state(F.lit("12"), "cable")) == "UNKNOWN" and value(ais.flag_state(F.lit("999000000"), "cable")) == "999"
    assert value(ais.flag_state(F.lit("999000000"), "investigator", [("999", "ZZ")])) == "ZZ"


def test_flag_tables(spark, tmp_path):
    tables = {s: dims.mid_pairs(s) for s in ("spoofing", "cable", "display", "investigator")}
    assert [len(tables[s]) for s in ("spoofing", "cable", "display")] == [50, 27, 101]
    assert all(len(t) == len({m for m, _ in t}) for t in tables.values())
    (tmp_path / "mids.csv").write_text("273,RU\nabc,XX\n601,ZA\n601,ZZ\n12,QQ\n999,\n")
    assert reference.read_mids(spark, str(tmp_path / "mids.csv")) == [("273", "RU"), ("601", "ZA")]


def test_investigator_flags(spark):
    path = os.path.join(os.path.dirname(dims.__file__), "data", "investigator_mids.csv")
    whole = reference.read_mids(spark, path)
    assert len(whole) == 246 and dims.mid_pairs("investigator") == whole
    vessels = spark.createDataFrame([(f"{digits}000001", flag) for digits, flag in whole], "mmsi string, want string")
    assert vessels.where(~ais.flag_state("mmsi", "investigator").eqNullSafe(F.col("want"))).count() == 0
    unseen = spark.createDataFrame([("201000001",), ("999000001",), ("12",)], "mmsi string")
    assert [r[0] for r in unseen.select(ais.flag_state("mmsi", "investigator")).collect()] == ["AL", None, None]


def test_timeframe():
    now = datetime(2026, 1, 2, tzinfo=timezone.utc)
    assert parse_timeframe("48h", now)[0] == datetime(2025, 12, 31, tzinfo=timezone.utc)
    assert parse_timeframe("2025-12-30T00:00:00Z/2025-12-31T12:00:00Z")[1] == datetime(2025, 12, 31, 12, tzinfo=timezone.utc)
