"""Meetings and convoys as streams, fed out of order, give the rows of the batch functions."""

from __future__ import annotations

import json
import random
from datetime import datetime, timezone

from conftest import T0

from harborlight.plans import convoy, rendezvous
from harborlight.session import written
from harborlight.sources.positions import parse_positions, with_event_time, without_repeats
from harborlight.streaming import pairs, topics


def line(t, mmsi, lat, lon, **more):
    stamp = datetime.fromtimestamp(T0 + t, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    given = dict(mmsi=mmsi, timestamp=stamp, latitude=lat, longitude=lon, speed_over_ground=3.0, course_over_ground=10.0, ship_type=80, ship_name=f"V{mmsi[-2:]}")
    return json.dumps(given | more)


def wanderers(seed, hours=2.5):
    """Ten vessels around one place at sea: they meet, part, fall silent, sail off and change speed and course."""
    rng, lines = random.Random(seed), []
    for v in range(10):
        mmsi, t = f"2300000{v:02d}", rng.randrange(400)
        lat, lon = 56.0 + rng.uniform(-0.02, 0.02), 18.5 + rng.uniform(-0.04, 0.04)
        kind = rng.choice([80, 70, 30, 60, None])
        while t < hours * 3600:
            speed = rng.choice([0.5, 3.0, 4.0, 4.5, 5.0, 9.0, None]) if rng.random() < 0.3 else 3.0
            course = rng.choice([0.0, 15.0, 100.0, None]) if rng.random() < 0.15 else 5.0
            lines.append((t, line(t, mmsi, lat, lon, ship_type=kind, speed_over_ground=speed, course_over_ground=course)))
            t += rng.choice([60, 60, 90, 200, 590, 610, 1500]) if rng.random() < 0.3 else 60
            step = 0.25 if rng.random() < 0.02 else 0.004
            lat, lon = lat + rng.uniform(-step, step), lon + rng.uniform(-step, step)
            lat, lon = lat + (56.0 - lat) * 0.05, lon + (18.5 - lon) * 0.05
    return sorted(lines)


def shuffled(lines, reach_s=500, seed=1):
    """Out of order by up to `reach_s`, with some messages twice."""
    rng = random.Random(seed)
    order = sorted(((t + rng.uniform(0, reach_s), text) for t, text in lines + lines[::17]), key=lambda x: x[0])
    return [text for _, text in order]


def feed(folder, lines, files):
    folder.mkdir(exist_ok=True)
    size = -(-len(lines) // files)
    for i in range(files):
        (folder / f"{i:03d}.json").write_text("\n".join(lines[i * size : (i + 1) * size]) + "\n")
    # Two later messages move the watermark past all others.
    for k, t in enumerate((40_000, 90_000)):
        (folder / f"9{k}.json").write_text(line(t, "230000099", 40.0, 5.0) + "\n")


def run(df, name, checkpoint):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).start()
    q.processAllAvailable()
    left = {o["operatorName"]: 0 for o in q.lastProgress["stateOperators"]}
    for o in q.lastProgress["stateOperators"]:
        left[o["operatorName"]] += o["numRowsTotal"]
    q.stop()
    return df.sparkSession.table(name).collect(), left


def ordered_files(spark, folder, files_per_trigger=1):
    """One file a batch, in the order of their names."""
    import os
    import time

    now = time.time() - 10_000
    for i, name in enumerate(sorted(os.listdir(folder))):
        os.utime(folder / name, (now + i, now + i))
    return topics.positions_stream(topics.read_folder(spark, str(folder), files_per_trigger))


def batch(spark, folder):
    return written(without_repeats(with_event_time(parse_positions(spark.read.text(str(folder))))), "reports")


def test_rendezvous_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "feed"
    feed(folder, shuffled(wanderers(1)), 3)
    columns = ["lo", "hi", "t_s", "mmsi", "o_mmsi", "o_t_s", "started_s", "duration_minutes", "severity", "ship_name", "o_ship_name"]

    def rows(found):
        return sorted((*(r[c] for c in columns), round(r.mean_distance_m, 6)) for r in found)

    got, left = run(pairs.rendezvous_stream(lambda: ordered_files(spark, folder)), "met", tmp_path / "c")
    want = rendezvous.rendezvous_events(batch(spark, folder)).collect()
    assert len(want) >= 5 and rows(got) == rows(want)
    # After the silence little more than the last report is remembered.
    assert left["symmetricHashJoin"] == 0 and left["transformWithStateInPandasExec"] <= 4


def test_convoy_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "feed"
    feed(folder, shuffled(wanderers(3)), 3)
    columns = ["mmsi", "t_s", "convoy_id", "vessel_count", "duration_minutes", "severity", "title"]

    def rows(found):
        members = lambda r: sorted((m.mmsi, m.name, m.speed, m.course) for m in r.members)
        return sorted((*(r[c] for c in columns), round(r.mean_speed, 6), round(r.mean_course, 6), members(r)) for r in found)

    got, left = run(pairs.convoy_stream(lambda: ordered_files(spark, folder)), "convoys", tmp_path / "c")
    want = convoy.convoy_events(batch(spark, folder)).collect()
    assert len(want) >= 5 and rows(got) == rows(want)
    assert left["symmetricHashJoin"] == 0
