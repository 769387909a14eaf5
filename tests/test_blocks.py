"""Pairs of reports summed up in blocks: many small blocks give what comparing all pairs gives."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from conftest import T0

from harborlight.operators import blocks
from harborlight.plans import convoy, rendezvous


@pytest.fixture
def small_blocks(monkeypatch):
    """Few vessels and reports a block."""
    for name, value in (("VESSELS", 4), ("ROWS", 12), ("BATCH_ROWS", 64), ("BATCH_PAIRS", 50)):
        monkeypatch.setattr(blocks, name, value)


def angle(a, b):
    half_lat, half_lon = (math.sin(math.radians(b[c] - a[c]) / 2) for c in ("latitude", "longitude"))
    h = half_lat**2 + math.cos(math.radians(a["latitude"])) * math.cos(math.radians(b["latitude"])) * half_lon**2
    return 2 * math.asin(math.sqrt(h))


def crowd(speed):
    """Vessels on few places around the turn of an hour; one of them reports far more often than the others."""
    rnd, rows = random.Random(7), []
    for v in range(24):
        every = 20 if v == 0 else 200
        place = 57.60 + rnd.random() * 0.06, 21.0 + rnd.random() * 0.1
        for i in range(100 if v == 0 else 10):
            place = place[0] + (rnd.random() - 0.5) * 0.004, place[1] + (rnd.random() - 0.5) * 0.008
            t = 2700 + i * every + v
            rows.append(dict(t=t, mmsi=f"2300000{v:02d}", latitude=place[0], longitude=place[1], speed_over_ground=speed, course_over_ground=rnd.random() * 60))
    return rows


def seen_by(rows):
    """(report, latest report of another vessel) while it is fresh."""
    tracks = defaultdict(list)
    for i, r in enumerate(rows):
        tracks[r["mmsi"]].append(dict(r, row=i))
    reports = sorted((r for track in tracks.values() for r in track), key=lambda r: (r["t"], r["row"]))
    latest = {}
    for r in reports:
        for other in latest.values():
            if other["mmsi"] != r["mmsi"] and r["t"] - other["t"] < 600:
                yield r, other
        latest[r["mmsi"]] = r


def test_contacts_in_small_blocks(track, small_blocks):
    rows = crowd(1.0)
    want = defaultdict(lambda: [0, 0.0])
    for a, b in seen_by(rows):
        if (meters := 6371000.0 * angle(a, b)) <= 1500:
            pair = want[tuple(sorted((a["mmsi"], b["mmsi"])))]
            pair[0], pair[1] = pair[0] + 1, pair[1] + meters
    got = defaultdict(lambda: [0, 0.0])
    for r in rendezvous.encounters(track(rows)).collect():
        pair = got[r.lo, r.hi]
        pair[0], pair[1] = pair[0] + r.contacts, pair[1] + r.contacts * r.mean_distance_m
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - v[1]) < 1e-3 for k, v in want.items())


def test_same_encounters_whatever_the_blocks(track, monkeypatch):
    df = track(crowd(1.0))
    want = sorted(tuple(r) for r in rendezvous.rendezvous_events(df).select("lo", "hi", "started_s", "t_s", "row_id").collect())
    for name, value in (("VESSELS", 4), ("ROWS", 12), ("BATCH_ROWS", 64)):
        monkeypatch.setattr(blocks, name, value)
    got = sorted(tuple(r) for r in rendezvous.rendezvous_events(df).select("lo", "hi", "started_s", "t_s", "row_id").collect())
    assert want and got == want


def test_stretches_of_a_pair_are_moved_once(track):
    plan = rendezvous.rendezvous_events(track(crowd(1.0)))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(lo#\d+, hi#\d+, \d+\)", plan)) == 1
    assert not re.search(r"Exchange hashpartitioning\((_pair#|lo#\d+, hi#\d+, started_s)", plan)


def test_only_pairs_seen_apart_are_noted(track):
    def at(t, mmsi, lon=20.0, speed=1.0):
        return dict(t=t, row=t, mmsi=mmsi, latitude=58.0 if mmsi in "ab" else 59.0, longitude=lon, speed_over_ground=speed)

    rows = [at(t + 5 * k, mmsi, 20.0 + 0.002 * (k % 2)) for t in (0, 60, 3600, 3660) for k, mmsi in enumerate("abcd")]
    rows += [at(1000, "a", speed=9.0), at(300, "d", 20.05)]
    rows = track(sorted(rows, key=lambda r: r["t"]))
    able = rendezvous.eligible_reports(rows, 30)
    known = rendezvous.stretches(able, 1500, 3, told=False)
    assert known.where("begins = 'unsure' and t_s > 1704070000").select("lo").distinct().count() == 2
    assert [(r.lo, r.hi) for r in rendezvous._parted(known, able, 1500).collect()] == [("c", "d")]
    assert sorted((r.lo, r.contacts) for r in rendezvous.encounters(rows).collect()) == [("a", 6), ("c", 3), ("c", 3)]


def test_stretches_hold_only_what_can_alert(track):
    able = rendezvous.eligible_reports(track(crowd(1.0)), 30)
    every = rendezvous.stretches(able, 1500, 3, told=False)
    rows = rendezvous.stretches(able, 1500, 3, told=True).collect()
    assert every.count() > len(rows)
    for r in rows:
        by = [c.t_s - (180 if c.soon else 360) for c in r.head]
        assert all(x < y for x, y in zip(by, by[1:])) and all(x < r.t_s for x in by[:-1])
    # Whatever the beginning, the first contact that lasts is among them.
    contacts = {}
    for a, b in seen_by(crowd(1.0)):
        if 6371000.0 * angle(a, b) <= 1500:
            contacts.setdefault(tuple(sorted((a["mmsi"], b["mmsi"]))), []).append((T0 + a["t"], a["row"]))
    checked = 0
    for r in rows:
        own = [c for c in contacts[r.lo, r.hi] if (r.t_s, r.row_id) <= c <= (r.last_t, r.last_row)]
        for began in range(r.t_s - 400, r.t_s + 1, 20) if r.begins != "starts" else ():
            want = next((c for c in own if c[0] - began >= 360), None)
            got = next(((c.t_s, c.row_id) for c in r.head if (c.t_s - began) // 60 >= 6), None)
            checked += want is not None
            assert got == want
    assert checked


def test_companions_in_small_blocks(track, small_blocks):
    rows = crowd(10.0)
    want = defaultdict(lambda: 1)
    for a, b in seen_by(rows):
        if 3440.065 * angle(a, b) <= 3 and abs(a["course_over_ground"] - b["course_over_ground"]) <= 30:
            want[a["row"]] += 1
    got = {r.row_id: r.vessel_count for r in convoy.convoy_reports(convoy.tracked_reports(track(rows))).collect()}
    assert got == dict(want)


def test_reports_without_a_number_are_not_ordered_within_a_second():
    names = ["_lat", "_lon", "_hour", "_part", "_i", "_j"]
    row = [None, 5, 6]
    columns = {n: pa.array([0, 0, 0]) for n in names} | {
        "_right": pa.array([True, False, False]), "_own": pa.array([True, True, True]), "t_s": pa.array([T0, T0, T0 + 1]),
        "row_id": pa.array(row, pa.int64()), "next_t": pa.array([None] * 3, pa.int64()), "next_row": pa.array([None] * 3, pa.int64()),
    }
    pairs = blocks.Pairs(pa.table(columns), 600)
    assert [(a.tolist(), b.tolist()) for a, b in pairs.batches(both=False)] == [([2], [0])]


def test_crowds_are_dealt_with_few_copies(spark):
    """600 vessels on one spot: a report goes to few blocks, where it went to one for every 128 vessels."""
    reports = spark.range(1800).selectExpr(
        "cast(id % 600 as string) as mmsi", f"{T0} + id div 600 * 150 as t_s", "id as row_id", "57.6d as latitude", "21.0d as longitude",
        f"if(id < 1200, {T0} + id div 600 * 150 + 150, null) as next_t", "if(id < 1200, id + 600, null) as next_row",
    )

    def run(table: pa.Table) -> pa.Table:
        sides = table.column("_right").to_numpy()
        return pa.table({"looking": pa.array([int((~sides).sum())]), "seen": pa.array([int(sides.sum())])})

    dealt = blocks.in_blocks(reports, reports, 3.0, 600, run, "looking long, seen long").agg({"looking": "sum", "seen": "sum"}).first()
    assert dealt["sum(looking)"] == 1800 and dealt["sum(seen)"] <= 2 * 1800


def test_large_blocks_are_worked_through_in_parts(track, monkeypatch):
    def found():
        met = rendezvous.rendezvous_events(track(crowd(1.0))).select("lo", "hi", "started_s", "t_s", "row_id", "mean_distance_m")
        alike = convoy.convoy_reports(convoy.tracked_reports(track(crowd(10.0))))
        return [sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()) for df in (met, alike)]

    want = found()
    for name, value in (("VESSELS", 4), ("BATCH_ROWS", 16), ("BATCH_PAIRS", 50)):
        monkeypatch.setattr(blocks, name, value)
    assert all(want) and found() == want
