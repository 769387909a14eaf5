"""All standard detectors over one position table."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from harborlight.plans.anchor import detect_anchor_drag
from harborlight.plans.cable import detect_cable_proximity
from harborlight.plans.convoy import detect_convoy
from harborlight.plans.dark import detect_appeared_dark, detect_gone_dark
from harborlight.plans.fishing import detect_fishing
from harborlight.plans.geofence import detect_geofence
from harborlight.plans.loitering import detect_loitering
from harborlight.plans.rendezvous import detect_rendezvous
from harborlight.plans.risk import score_vessel_risk
from harborlight.plans.sanctions_match import detect_shadow_fleet
from harborlight.plans.spoofing import detect_spoofing
from harborlight.plans.trajectory import detect_trajectory
from harborlight.session import written
from harborlight.sources.positions import without_repeats


def union_alerts(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def side_by_side(spark: SparkSession, plans: list[Callable[[], DataFrame]]) -> list[DataFrame]:
    """The plans' tables, each prepared in a thread of its own.

    Detectors store and count what they read several times, in jobs that don't fill a cluster one by one.
    """
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(len(plans)) as threads:
        return [job.result() for job in [threads.submit(inherit(plan)) for plan in plans]]


def run_pipeline(
    positions: DataFrame, zones: DataFrame, sanctions: DataFrame, as_of: int | None = None, loitering: bool = False
) -> DataFrame:
    """Alerts of all active detectors. Loitering is built but off, as it repeats what others report.

    Repeated messages are dropped first, and the rest is stored, as it feeds every detector.
    """
    positions = written(without_repeats(positions), "reports")
    detectors = [
        lambda: detect_geofence(positions, zones),
        lambda: detect_gone_dark(positions, as_of=as_of),
        lambda: detect_appeared_dark(positions),
        lambda: detect_rendezvous(positions),
        lambda: detect_fishing(positions, zones),
        lambda: detect_cable_proximity(positions, zones),
        lambda: detect_trajectory(positions, zones),
        lambda: detect_spoofing(positions),
        lambda: detect_convoy(positions),
        lambda: detect_anchor_drag(positions, zones),
        lambda: detect_shadow_fleet(positions, sanctions),
        lambda: score_vessel_risk(positions),
    ]
    if loitering:
        detectors.append(lambda: detect_loitering(positions))
    return union_alerts(side_by_side(positions.sparkSession, detectors))
