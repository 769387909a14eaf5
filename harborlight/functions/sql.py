"""The scalar functions for SQL: temporary functions whose bodies are SQL expressions, so Catalyst inlines and optimises them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from harborlight import dims
from harborlight.functions.geo import EARTH_RADIUS_M, EARTH_RADIUS_NM

_PLACES = "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE"
_MEETS = (
    "(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))"
)
_ANGLE = f"2 * atan2(sqrt({_MEETS}), sqrt(greatest(0D, 1 - {_MEETS})))"
_MID = "CASE WHEN length(mmsi) >= 3 THEN substring(mmsi, 1, 3) END"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lookup(pairs: list[tuple[str, str]], key: str) -> str:
    return f"try_element_at(map({', '.join(f'{_text(k)}, {_text(v)}' for k, v in pairs)}), {key})"


def _listed(values) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


def bodies() -> dict[str, tuple[str, str, str]]:
    """Name -> parameters, type of the result, expression."""

    def within(low: int, high: int) -> tuple[str, str, str]:
        return "ship_type INT", "BOOLEAN", f"coalesce(ship_type, -1) BETWEEN {low} AND {high}"

    return {
        "haversine_nm": (_PLACES, "DOUBLE", f"{EARTH_RADIUS_NM}D * ({_ANGLE})"),
        "haversine_m": (_PLACES, "DOUBLE", f"{EARTH_RADIUS_M}D * ({_ANGLE})"),
        "bearing": (
            _PLACES, "DOUBLE",
            "(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) "
            "- sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360) % 360",
        ),
        "course_diff": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN abs(a - b) > 180 THEN 360 - abs(a - b) ELSE abs(a - b) END"),
        "in_box": (
            "lat DOUBLE, lon DOUBLE, south DOUBLE, west DOUBLE, north DOUBLE, east DOUBLE", "BOOLEAN",
            "lat BETWEEN south AND north AND lon BETWEEN west AND east",
        ),
        "is_fishing": within(30, 37),
        "is_tanker": within(80, 89),
        "is_cargo": within(70, 79),
        "vessel_category": (
            "ship_type INT", "STRING",
            "CASE WHEN ship_type IS NULL OR ship_type = 0 THEN 'unknown' WHEN ship_type BETWEEN 70 AND 79 THEN 'cargo' "
            "WHEN ship_type BETWEEN 80 AND 89 THEN 'tanker' WHEN ship_type BETWEEN 30 AND 37 THEN 'fishing' "
            "WHEN ship_type BETWEEN 60 AND 69 THEN 'passenger' WHEN ship_type BETWEEN 40 AND 49 THEN 'highspeed' "
            "WHEN ship_type BETWEEN 50 AND 59 THEN 'special' WHEN ship_type BETWEEN 20 AND 29 THEN 'wing' ELSE 'other' END",
        ),
        "mid": ("mmsi STRING", "STRING", _MID),
        "flag_cable": ("mmsi STRING", "STRING", f"coalesce({_lookup(dims.mid_pairs('cable'), _MID)}, {_MID}, 'UNKNOWN')"),
        "flag_display": ("mmsi STRING", "STRING", f"coalesce({_lookup(dims.mid_pairs('display'), _MID)}, {_MID}, 'XX')"),
        "flag_investigator": ("mmsi STRING", "STRING", _lookup(dims.mid_pairs("investigator"), _MID)),
        "flag_spoofing": ("mmsi STRING", "STRING", _lookup(dims.mid_pairs("spoofing"), _MID)),
        "flag_category": (
            "flag STRING", "STRING",
            f"CASE WHEN flag IN {_listed(dims.HIGH_RISK_FLAGS)} THEN 'HIGH RISK' "
            f"WHEN flag IN {_listed(dims.FLAGS_OF_CONVENIENCE)} THEN 'Flag of Convenience' ELSE 'Standard' END",
        ),
        "mmsi_problem": (
            "mmsi STRING", "STRING",
            "CASE WHEN mmsi IS NULL OR length(mmsi) <> 9 THEN 'INVALID_LENGTH' "
            "WHEN mmsi IN ('000000000', '999999999', '123456789', '111111111') THEN 'SUSPICIOUS_PATTERN' "
            "WHEN try_cast(substring(mmsi, 1, 3) AS INT) IS NULL THEN 'NON_NUMERIC' "
            "WHEN try_cast(substring(mmsi, 1, 3) AS INT) NOT BETWEEN 200 AND 799 THEN 'INVALID_MID' END",
        ),
        "severity_rank": (
            "severity STRING", "INT",
            "CASE severity " + " ".join(f"WHEN {_text(s)} THEN {i}" for i, s in enumerate(dims.SEVERITIES, 1)) + " ELSE 0 END",
        ),
    }


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make the functions known to the session's SQL as `prefix` + name; earlier ones of that name are replaced."""
    names = []
    for name, (parameters, result, expression) in bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {expression}")
        names.append(prefix + name)
    return names
