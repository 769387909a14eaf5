from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from harborlight.session import local_session  # noqa: E402

COLUMNS = (
    "row_id bigint, t_s bigint, message_type int, mmsi string, latitude double, longitude double, speed_over_ground double, "
    "course_over_ground double, heading double, nav_status int, ship_type int, ship_name string, imo_number string"
)
T0 = 1704067200


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def track(spark):
    """positions from dicts; missing fields get plain values."""

    def build(rows):
        base = dict(
            message_type=1, mmsi="230000001", latitude=57.6, longitude=21.0, speed_over_ground=10.0, course_over_ground=0.0,
            heading=0.0, nav_status=0, ship_type=70, ship_name="SHIP", imo_number=None,
        )
        full = [dict(base, row_id=i, **{k: v for k, v in r.items() if k != "t"}, t_s=T0 + r["t"]) for i, r in enumerate(rows)]
        names = [c.strip().split(" ")[0] for c in COLUMNS.split(",")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in full], COLUMNS)

    return build
