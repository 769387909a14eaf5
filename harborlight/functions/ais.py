"""AIS column functions: ship types, MMSI structure, flags, display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlight import dims
from harborlight.functions.geo import _col

# Fixed values: "not available" markers.
SPEED_NOT_AVAILABLE = 102.3


def is_fishing(ship_type) -> Column:
    return F.coalesce(F.col(ship_type) if isinstance(ship_type, str) else ship_type, F.lit(-1)).between(30, 37)


def is_tanker(ship_type) -> Column:
    return F.coalesce(F.col(ship_type) if isinstance(ship_type, str) else ship_type, F.lit(-1)).between(80, 89)


def is_cargo(ship_type) -> Column:
    return F.coalesce(F.col(ship_type) if isinstance(ship_type, str) else ship_type, F.lit(-1)).between(70, 79)


def vessel_length(a="dimension_a", b="dimension_b") -> Column:
    return _col(a) + _col(b)


def vessel_width(c="dimension_c", d="dimension_d") -> Column:
    return _col(c) + _col(d)


def vessel_category(ship_type) -> Column:
    t = _col(ship_type)
    return (
        F.when(t.isNull() | (t == 0), "unknown")
        .when(t.between(70, 79), "cargo")
        .when(t.between(80, 89), "tanker")
        .when(t.between(30, 37), "fishing")
        .when(t.between(60, 69), "passenger")
        .when(t.between(40, 49), "highspeed")
        .when(t.between(50, 59), "special")
        .when(t.between(20, 29), "wing")
        .otherwise("other")
    )


def vessel_type_name(ship_type) -> Column:
    t = _col(ship_type).cast("int")
    named = F.element_at(dims.map_column(dims.SHIP_TYPE_NAMES.items()), t)
    return (
        F.when(t.isNull() | (t == 0), "Unknown")
        .when(t.between(70, 79), "Cargo")
        .when(t.between(80, 89), "Tanker")
        .when(t.between(60, 69), "Passenger")
        .otherwise(F.coalesce(named, F.lit("Unknown")))
    )


def nav_status_name(status) -> Column:
    names = dims.map_column(dims.NAV_STATUS_NAMES.items())
    return F.coalesce(F.element_at(names, _col(status).cast("int")), F.lit("Unknown"))


def mid(mmsi="mmsi") -> Column:
    m = _col(mmsi)
    return F.when(F.length(m) >= 3, F.substring(m, 1, 3))


def flag_state(mmsi="mmsi", source: str = "cable", mids: list[tuple[str, str]] | None = None) -> Column:
    """Flag code of an MMSI by one of the tables.

    cable: unknown digits stay as they are, too short gives UNKNOWN. investigator and spoofing:
    unknown gives null. display: unknown digits stay, too short gives XX. `mids`, pairs of
    digits and flag, replaces the table.
    """
    pairs = mids if mids else dims.mid_pairs(source)
    digits = mid(mmsi)
    known = F.element_at(dims.map_column(pairs), digits)
    if source == "cable":
        return F.coalesce(known, digits, F.lit("UNKNOWN"))
    if source == "display":
        return F.coalesce(known, digits, F.lit("XX"))
    return known


def flag_display(mmsi="mmsi") -> Column:
    """struct(code, name, flagged) as shown to a user."""
    digits = mid(mmsi)
    names = dims.map_column([(m, name) for m, _, name in dims.DISPLAY_MIDS])
    name = F.coalesce(F.element_at(names, digits), F.concat(F.lit("MID "), digits), F.lit("Unknown"))
    return F.struct(
        flag_state(mmsi, "display").alias("code"),
        name.alias("name"),
        is_flagged(mmsi).alias("flagged"),
    )


def is_flagged(mmsi="mmsi") -> Column:
    return F.coalesce(mid(mmsi).isin(dims.MONITORED_MIDS), F.lit(False))


def flag_category(flag) -> Column:
    f = _col(flag)
    return (
        F.when(f.isin(dims.HIGH_RISK_FLAGS), "HIGH RISK")
        .when(f.isin(dims.FLAGS_OF_CONVENIENCE), "Flag of Convenience")
        .otherwise("Standard")
    )


def mmsi_check(mmsi="mmsi") -> Column:
    """First failing rule of struct(problem, pattern), or null when the MMSI is sound."""
    m = _col(mmsi)
    number = F.substring(m, 1, 3).try_cast("int")
    pattern = (
        F.when(m == "0" * 9, "all_zeros")
        .when(m == "9" * 9, "all_nines")
        .when(m.isin("123456789", "111111111"), "sequential")
    )
    problem = (
        F.when(m.isNull() | (F.length(m) != 9), "INVALID_LENGTH")
        .when(pattern.isNotNull(), "SUSPICIOUS_PATTERN")
        .when(number.isNull(), "NON_NUMERIC")
        .when(~number.between(200, 799), "INVALID_MID")
    )
    return F.when(
        problem.isNotNull(),
        F.struct(
            problem.alias("problem"),
            F.when(problem == "SUSPICIOUS_PATTERN", pattern).alias("pattern"),
        ),
    )


def uncommon_mid(mmsi="mmsi") -> Column:
    """Digits in the ranges used by little-known registers and in no table."""
    digits = mid(mmsi)
    number = digits.try_cast("int")
    known = [m for m, _ in dims.mid_pairs("spoofing")]
    odd = (number.between(600, 639) | number.between(570, 579)) & ~digits.isin(known)
    return F.coalesce(odd, F.lit(False))


def zone_type_from_filename(name) -> Column:
    n = F.lower(_col(name))
    return (
        F.when(n.contains("mpa") | n.contains("protected"), "MPA")
        .when(n.contains("eez"), "EEZ")
        .when(n.contains("sanction"), "sanctioned_waters")
        .when(n.contains("restrict"), "restricted")
        .otherwise("unknown")
    )


def zone_rules(zone_type) -> Column:
    """Typed alerting rules of a zone type."""
    schema = (
        "struct<alert_vessel_types:array<int>,alert_on_fishing_behavior:boolean,"
        "alert_all_vessels:boolean,check_flag_state:boolean,severity:string>"
    )

    def rule(r) -> Column:
        types = r["alert_vessel_types"]
        listed = F.lit(None) if types is None else F.array(*[F.lit(t) for t in types])
        return F.struct(
            listed.cast("array<int>").alias("alert_vessel_types"),
            F.lit(r["alert_on_fishing_behavior"]).cast("boolean").alias("alert_on_fishing_behavior"),
            F.lit(r["alert_all_vessels"]).alias("alert_all_vessels"),
            F.lit(r["check_flag_state"]).cast("boolean").alias("check_flag_state"),
            F.lit(r["severity"]).alias("severity"),
        ).cast(schema)

    t = _col(zone_type)
    chosen = None
    for kind, r in dims.ZONE_RULES.items():
        chosen = F.when(t == kind, rule(r)) if chosen is None else chosen.when(t == kind, rule(r))
    return chosen.otherwise(rule(dims.DEFAULT_ZONE_RULE))


def zone_severity(severity) -> Column:
    return F.coalesce(_col(severity), F.lit("MEDIUM"))


def normalize_name(name) -> Column:
    return F.trim(F.upper(_col(name)))


def known_text(value, *unknown: str) -> Column:
    """The text, or null when it is empty or one of the `unknown` markers."""
    v = _col(value)
    return F.when((v != "") & ~v.isin(list(unknown)) if unknown else v != "", v)


def effective_heading(heading="heading", course="course_over_ground") -> Column:
    """Heading unless unusable, else the course, else 0."""
    h, c = _col(heading), _col(course)
    return F.when(h.isNotNull() & (h != 0) & (h <= 360), h).otherwise(F.coalesce(c, F.lit(0.0)))


def is_moving(speed) -> Column:
    return F.coalesce(_col(speed) > 0.5, F.lit(False))


def speed_bucket(speed) -> Column:
    s = _col(speed)
    return (
        F.when(s.isNull() | (s < 0.5), "stopped")
        .when(s < 3, "slow")
        .when(s < 15, "normal")
        .when(s < 999, "fast")
    )


def record_hash(imo, name, authorities) -> Column:
    """Short fingerprint of a sanctioned vessel record."""
    listed = F.array_join(F.array_sort(F.coalesce(authorities, F.array().cast("array<string>"))), ",")
    text = F.concat_ws(":", F.coalesce(_col(imo), F.lit("")), F.coalesce(_col(name), F.lit("")), listed)
    return F.substring(F.sha2(text, 256), 1, 16)


def format_coordinates(lat, lon) -> Column:
    lat, lon = _col(lat), _col(lon)
    return F.format_string(
        "%.4f° %s, %.4f° %s",
        F.abs(lat),
        F.when(lat >= 0, "N").otherwise("S"),
        F.abs(lon),
        F.when(lon >= 0, "E").otherwise("W"),
    )


def format_speed(speed) -> Column:
    s = _col(speed)
    return F.when(s.isNull(), "N/A").otherwise(F.format_string("%.1f kts", s))


def format_course(course) -> Column:
    c = _col(course)
    return F.when(c.isNull(), "N/A").otherwise(F.concat(F.floor(c + 0.5).cast("string"), F.lit("°")))
