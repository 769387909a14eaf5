"""Ordered operators against brute force, with slices short enough to cut every history."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from harborlight import dims
from harborlight.functions import geo
from harborlight.operators.history import (
    first_seen, following, last_seen, previous, running_max, running_sum, sliced, with_history, with_islands, with_last_rows,
)
from harborlight.session import SLICE_ROWS_CONF
from harborlight.operators.throttle import thin_track, throttle
from harborlight.operators.zones import in_zones, zone_cells


def rows(seed=1, n=300, vessels=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = 0 if rng.random() < 0.6 else rng.randrange(vessels)
        out.append((f"v{v}", rng.randrange(0, 40_000), i, rng.choice([None, 1, 2, 3]), round(rng.uniform(0, 5), 2)))
    return out


SCHEMA = "mmsi string, t_s long, row_id long, a int, b double"


def ordered(data):
    by = {}
    for r in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    return by


def test_one_vessel_with_a_third_of_all_reports_is_split(spark):
    """Bursts and all: no slice holds more than twice the target, order and results stay."""
    rng = random.Random(5)
    hot = [("hot", 3600 + (rng.randrange(0, 5) if i % 2 else rng.randrange(0, 7200)), rng.randrange(-(2**63), 2**63)) for i in range(3000)]
    rest = [(f"v{i % 900}", rng.randrange(0, 86_400), rng.randrange(-(2**63), 2**63)) for i in range(6000)]
    df = spark.createDataFrame(hot + rest, "mmsi string, t_s long, row_id long").cache()
    spark.conf.set(SLICE_ROWS_CONF, "200")
    try:
        cut = sliced(df).collect()
        sizes = {}
        for r in cut:
            sizes[(r.mmsi, r._slice)] = sizes.get((r.mmsi, r._slice), 0) + 1
        assert max(sizes.values()) <= 400
        mine = sorted((r.t_s, r.row_id, r._slice) for r in cut if r.mmsi == "hot")
        assert [m[2] for m in mine] == sorted(m[2] for m in mine)
        # Vessels of other groups keep slices of an hour.
        assert sum(r._slice == r.t_s // 3600 for r in cut if r.mmsi != "hot") > 5900
        got = {r.row_id: (r.p.row_id if r.p else None, r.n) for r in with_history(df, previous("p", "row_id"), running_sum("n", F.lit(1))).collect()}
        lasts = {r.row_id: [x.row_id for x in r.last] for r in with_last_rows(df, "last", 5, "row_id").collect()}
        starts = {r.row_id: r.s.row_id for r in with_islands(df, "s", ["t_s", "row_id"], lambda p, c: c["t_s"] - p["t_s"] >= 20).collect()}
    finally:
        spark.conf.unset(SLICE_ROWS_CONF)
    before, start = None, None
    for i, (t, row, _) in enumerate(mine):
        if before is None or t - before[0] >= 20:
            start = row
        assert got[row] == (before[1] if before else None, i + 1) and starts[row] == start
        assert lasts[row] == [m[1] for m in mine[max(0, i - 4) : i + 1]]
        before = (t, row)


def test_history_features_match_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = {
        r.row_id: r
        for r in with_history(
            df, previous("p", "row_id"), following("n", "row_id"), running_sum("s", F.col("b"), zero=0.0),
            running_sum("sx", F.lit(1), inclusive=False), running_max("m", F.col("b")), first_seen("f", F.col("a")),
            last_seen("l", F.col("a")), last_seen("lx", F.col("a"), inclusive=False), seconds=700,
        ).collect()
    }
    assert len(got) == len(data)
    for hist in ordered(data).values():
        for i, r in enumerate(hist):
            g = got[r[2]]
            assert (g.p.row_id if g.p else None) == (hist[i - 1][2] if i else None)
            assert (g.n.row_id if g.n else None) == (hist[i + 1][2] if i + 1 < len(hist) else None)
            assert abs(g.s - sum(x[4] for x in hist[: i + 1])) < 1e-9
            assert g.sx == i
            assert g.m == max(x[4] for x in hist[: i + 1])
            known = [x[3] for x in hist[: i + 1] if x[3] is not None]
            assert g.f == (known[0] if known else None)
            assert g.l == (known[-1] if known else None)
            before = [x[3] for x in hist[:i] if x[3] is not None]
            assert g.lx == (before[-1] if before else None)


def test_last_rows_and_islands_match_brute_force(spark):
    data = rows(2)
    df = spark.createDataFrame(data, SCHEMA)
    last = {r.row_id: [x.row_id for x in r.last] for r in with_last_rows(df, "last", 7, "row_id", seconds=500).collect()}
    isl = {
        r.row_id: (r.start.row_id, r.before.row_id if r.before else None)
        for r in with_islands(
            df, "start", ["t_s", "row_id", "b"], lambda p, c: (c["t_s"] - p["t_s"] > 150) | (c["b"] > 4.5), before="before", seconds=600
        ).collect()
    }
    for hist in ordered(data).values():
        start = None
        for i, r in enumerate(hist):
            assert last[r[2]] == [x[2] for x in hist[max(0, i - 6): i + 1]]
            if i == 0 or r[1] - hist[i - 1][1] > 150 or r[4] > 4.5:
                start = r[2]
            assert isl[r[2]] == (start, hist[i - 1][2] if i else None)


def greedy(times, wait, strict):
    kept, last = [], None
    for t, i in times:
        if last is None or (t - last > wait if strict else t - last >= wait):
            kept.append(i)
            last = t
    return kept


def test_throttle_matches_brute_force_and_spacing(spark):
    data = rows(3, 500)
    df = spark.createDataFrame(data, SCHEMA)
    for strict in (False, True):
        got = {r.row_id for r in throttle(df, ["mmsi"], 900, strict=strict).collect()}
        want = set()
        for hist in ordered(data).values():
            want.update(greedy([(r[1], r[2]) for r in hist], 900, strict))
        assert got == want


def test_throttle_boundary(spark):
    df = spark.createDataFrame([("v", t, t, None, 0.0) for t in (0, 899, 900, 1799, 1800)], SCHEMA)
    assert sorted(r.t_s for r in throttle(df, ["mmsi"], 900).collect()) == [0, 900, 1800]
    assert sorted(r.t_s for r in throttle(df, ["mmsi"], 900, strict=True).collect()) == [0, 1799]


def test_thin_track_matches_brute_force(spark):
    rng = random.Random(5)
    data, lat, lon = [], 57.0, 20.0
    for i in range(400):
        step = rng.choice([0, 0, 0.00004, 0.00009, 0.0003])
        lat, lon = round(lat + rng.choice([-1, 1]) * step, 6), round(lon + rng.choice([-1, 1]) * step, 6)
        data.append(("v", i * 60, i, lat, lon))
    df = spark.createDataFrame(data, "mmsi string, t_s long, row_id long, latitude double, longitude double")
    want, last = [], None
    for _, _, i, la, lo in data:
        if last is None or abs(la - last[0]) > 0.0001 or abs(lo - last[1]) > 0.0001:
            want.append(i)
            last = (la, lo)
    assert sorted(r.row_id for r in thin_track(df).collect()) == want


def test_zone_containment_is_strict_and_ring_order_free(spark):
    square = [(20.0, 55.0), (21.0, 55.0), (21.0, 56.0), (20.0, 56.0)]
    points = [(55.5, 20.5, True), (55.5, 20.0, False), (55.0, 20.5, False), (56.0, 21.0, False), (55.99, 20.01, True), (55.5, 21.2, False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(points)], "row_id long, latitude double, longitude double")
    want = {i for i, p in enumerate(points) if p[2]}
    for ring in (square, square[::-1], square[2:] + square[:2]):
        closed = ring + ring[:1]
        zone = spark.createDataFrame([("Z", "Z", "MPA", "EU", None, "HIGH", False, [closed])], dims.ZONE_SCHEMA)
        assert {r.row_id for r in in_zones(df, zone, "zone_id").collect()} == want


def test_zone_with_hole(spark):
    outer = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)]
    zone = spark.createDataFrame([("Z", "Z", "MPA", "EU", None, "HIGH", False, [outer, hole])], dims.ZONE_SCHEMA)
    df = spark.createDataFrame([(0, 2.0, 2.0), (1, 0.5, 2.0), (2, 3.7, 3.7)], "row_id long, latitude double, longitude double")
    assert {r.row_id for r in in_zones(df, zone, "zone_id").collect()} == {1, 2}


def _strictly_inside(x, y, edges):
    """Even-odd by a ray to the east; on an edge is outside."""
    x1, y1, x2, y2 = edges.T
    on = ((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1)) & (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2))
    if (on & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2))).any():
        return False
    meets = (y1 > y) != (y2 > y)
    x1, y1, x2, y2 = edges[meets].T
    return int((x < (x2 - x1) * (y - y1) / (y2 - y1) + x1).sum()) % 2 == 1


def _zone(spark, ring):
    return spark.createDataFrame([("Z", "Z", "MPA", "EU", None, "HIGH", False, [ring])], dims.ZONE_SCHEMA)


def _contained(spark, ring, points, size=0.5):
    df = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(points)], "row_id long, latitude double, longitude double")
    return {r.row_id for r in in_zones(df, _zone(spark, ring), "zone_id", size=size).collect()}


def test_clipped_zone_edges_match_brute_force(spark):
    rng = random.Random(11)
    # Corners, edges and points on a half-degree lattice, so that ways to the reference points pass through corners and along edges.
    stairs = [(0, 0), (4, 0), (4, 1), (2.5, 1), (2.5, 2), (4, 2), (4, 3.5), (1.5, 3.5), (1.5, 2.5), (1, 2.5), (1, 3.5), (0, 3.5)]
    # A ring that crosses itself, with edges longer than cells.
    crossed = [(round(rng.uniform(-3, 3), 1), round(rng.uniform(-3, 3), 1)) for _ in range(40)]
    for corners in (stairs, crossed):
        ring = [(float(x), float(y)) for x, y in [*corners, corners[0]]]
        edges = np.array([(*a, *b) for a, b in zip(ring[:-1], ring[1:])])
        points = [(x / 4, y / 4) for x in range(-14, 19) for y in range(-14, 19)]
        points += [(rng.uniform(-3, 4), rng.uniform(-3, 4)) for _ in range(300)] + ring
        want = {i for i, (x, y) in enumerate(points) if _strictly_inside(x, y, edges)}
        assert want and _contained(spark, ring, points) == want
        assert _contained(spark, ring, points, size=0.3) == want


def test_a_zone_of_many_points_costs_about_its_edges(spark):
    n = 100_000
    angle = np.arange(n) * 2 * np.pi / n
    radius = 4 + 0.5 * np.sin(37 * angle) + 0.01 * np.sin(1000 * angle)
    ring = [(float(x), float(y)) for x, y in zip(20 + radius * np.cos(angle), 57 + radius * np.sin(angle))]
    ring.append(ring[0])
    kept = zone_cells(_zone(spark, ring)).agg(F.sum(F.size("edges"))).first()[0]
    assert n <= kept < 1.05 * n
    rng = random.Random(3)
    points = [(20 + r * math.cos(a), 57 + r * math.sin(a)) for r, a in ((rng.uniform(3, 5), rng.uniform(0, 7)) for _ in range(200))]
    edges = np.array([(*a, *b) for a, b in zip(ring[:-1], ring[1:])])
    assert _contained(spark, ring, points) == {i for i, (x, y) in enumerate(points) if _strictly_inside(x, y, edges)}


def test_haversine_is_symmetric_and_bearings(spark):
    df = spark.range(1).select(
        geo.haversine_nm(F.lit(44.4072), F.lit(8.9342), F.lit(43.2965), F.lit(5.3698)).alias("a"),
        geo.haversine_nm(F.lit(43.2965), F.lit(5.3698), F.lit(44.4072), F.lit(8.9342)).alias("b"),
        geo.bearing(F.lit(38.0), F.lit(15.0), F.lit(39.0), F.lit(15.0)).alias("n"),
        geo.bearing(F.lit(38.0), F.lit(15.0), F.lit(38.0), F.lit(16.0)).alias("e"),
        geo.bearing(F.lit(39.0), F.lit(15.0), F.lit(38.0), F.lit(15.0)).alias("s"),
    ).first()
    assert 100 < df.a < 250 and abs(df.a - df.b) < 1e-9
    assert abs(df.n) < 0.5 and 85 < df.e < 95 and 175 < df.s < 185


def test_adjacent_cells_and_combined_alerts(spark):
    from harborlight.plans.serving import combined_alerts

    cells = spark.range(1).select(geo.adjacent_cells(F.lit(5), F.lit(-1)).alias("c")).first().c
    assert len({tuple(c) for c in cells}) == 9 and (4, -2) in {tuple(c) for c in cells}
    schema = "alert_id string, mmsi string, detected_at timestamp"
    a = spark.createDataFrame([("a", "1", None), ("b", "2", None)], schema).withColumn("detected_at", F.timestamp_seconds(F.lit(10)))
    b = spark.createDataFrame([("i", "1", None)], schema).withColumn("detected_at", F.timestamp_seconds(F.lit(20)))
    assert [r.alert_id for r in combined_alerts(a, b, "1").collect()] == ["i", "a"]
