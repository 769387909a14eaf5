"""Stored tracks through the detectors, together with what an investigator tagged on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.plans.anchor import detect_anchor_drag
from harborlight.plans.cable import detect_cable_proximity
from harborlight.plans.pipeline import union_alerts
from harborlight.session import written
from harborlight.sources.positions import replay_positions, tagged_waypoints, without_repeats

Detector = Callable[[DataFrame, DataFrame], DataFrame]
#: What a track can show by itself: it has places, speeds and states of one vessel.
DETECTORS: tuple[Detector, ...] = (detect_cable_proximity, detect_anchor_drag)


def replay(tracks: DataFrame, zones: DataFrame, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """Alerts of the tracks' replay lists, and their tagged waypoints; `origin` is detector or tag.

    Points that several tracks share count once. The detectors are the ones of the live feed.
    """
    positions = written(without_repeats(replay_positions(tracks).where("t_s is not null")), "replay")
    found = union_alerts([detect(positions, zones) for detect in detectors])
    tagged = tagged_waypoints(tracks)
    shared = [c for c in found.columns if c in tagged.columns]
    return found.select(*shared, F.lit("detector").alias("origin")).unionByName(tagged.select(*shared, F.lit("tag").alias("origin")))
