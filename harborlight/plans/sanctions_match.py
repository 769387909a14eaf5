"""Vessels on sanctions lists, or under a high-risk flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.functions import ais
from harborlight.functions.alerts import or_unknown, to_alerts
from harborlight.operators.throttle import throttle

# Fixed values.
COOLDOWN_S = 3600


def sanction_matches(positions: DataFrame, records: DataFrame) -> DataFrame:
    """Every (report, record) match with `rank`: IMO 1, MMSI 2, flag 3.

    `records` holds one record per key, as parse_sanctions returns. Three inner equi-joins, so
    reports without an IMO are not moved around, and small lists are broadcast by size.
    """
    record = F.struct(*[c for c in records.columns if c != "key"]).alias("record")
    keyed = records.select("key", "record_type", "risk_level", record)
    vessels = keyed.where(F.col("record_type") == "SANCTIONED_VESSEL")
    flags = keyed.where((F.col("record_type") == "HIGH_RISK_FLAG") & (F.col("risk_level") == "critical"))
    ways = [
        (1, "IMO_EXACT_MATCH", vessels, "IMO:", ais.known_text("imo_number"), F.lit(True)),
        (2, "MMSI_EXACT_MATCH", vessels, "MMSI:", ais.known_text("mmsi"), F.lit(True)),
        (3, "HIGH_RISK_FLAG", flags, "FLAG:", ais.mid("mmsi"), ais.is_tanker("ship_type")),
    ]
    parts = []
    for rank, match, side, prefix, value, condition in ways:
        left = positions.withColumn("key", F.concat(F.lit(prefix), value)).where(F.col("key").isNotNull() & condition)
        part = left.join(side.where(F.col("key").startswith(prefix)).select("key", "record"), "key")
        parts.append(
            part.select(*positions.columns, "record", F.lit(rank).alias("rank"), F.lit(match).alias("match_type"))
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sanction_events(positions: DataFrame, records: DataFrame) -> DataFrame:
    """Best match of a report, then an hour of silence per vessel."""
    kept = throttle(sanction_matches(positions, records), ["mmsi"], COOLDOWN_S, order=("row_id", "rank"))
    flagged = F.col("match_type") == "HIGH_RISK_FLAG"
    title = F.when(
        flagged, F.format_string("Tanker with %s Flag", F.col("record.country_name"))
    ).otherwise(F.format_string("SHADOW FLEET: %s Detected", or_unknown("ship_name", "Unknown Vessel")))
    return kept.withColumn("severity", F.when(flagged, "HIGH").otherwise("CRITICAL")).withColumn("title", title)


def detect_shadow_fleet(positions: DataFrame, records: DataFrame) -> DataFrame:
    r = F.col("record")
    by_imo, by_flag = F.col("match_type") == "IMO_EXACT_MATCH", F.col("match_type") == "HIGH_RISK_FLAG"
    listed = ~by_flag
    found = F.when(by_imo, F.concat(F.lit("IMO: "), r["imo_number"])).otherwise(F.concat(F.lit("MMSI: "), r["mmsi"]))
    text = F.when(
        by_flag,
        F.format_string(
            "Tanker %s (MMSI: %s) flying %s flag detected. %s Risk level: %s.",
            or_unknown("ship_name"), F.col("mmsi"), r["country_name"], r["reason"], F.upper(r["risk_level"])),
    ).otherwise(
        F.format_string(
            "CONFIRMED SANCTIONED VESSEL %s (MMSI: %s) detected in Baltic Sea. Exact %s match against sanctions "
            "database. Sanctioned by: %s. Risk level: CRITICAL.",
            F.coalesce(F.col("ship_name"), r["vessel_name"]), F.col("mmsi"), found,
            F.array_join(r["sanctions_authorities"], ", "))
    )
    return to_alerts(
        sanction_events(positions, records),
        "SANCTIONS_MATCH",
        text,
        {
            "match_type": "match_type",
            "sanctioned_imo": F.when(listed, r["imo_number"]),
            "sanctioned_mmsi": F.when(listed, r["mmsi"]),
            "sanctioned_name": F.when(listed, r["vessel_name"]),
            "sanctions_authorities": F.when(listed, r["sanctions_authorities"]),
            "vessel_type": F.when(listed, r["vessel_type"]),
            "notes": F.when(listed, ais.known_text(r["notes"])),
            "exact_match": F.when(listed, F.lit(True)),
            "persistent": F.when(listed, F.lit(True)),
            "flag_mid": F.when(by_flag, r["mid_code"]),
            "flag_country": F.when(by_flag, r["country_name"]),
            "flag_code": F.when(by_flag, r["country_code"]),
            "reason": F.when(by_flag, r["reason"]),
            "risk_level": r["risk_level"],
        },
        subject=F.col("match_type"),
    )
