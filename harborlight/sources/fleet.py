"""Lists of sanctioned vessels: extraction, merging and publishing what is new."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions.ais import record_hash
from harborlight.sources.reference import first_by_priority

# Fixed values.
LIST_MARK = "TT"
LIST_NAME = "TankerTrackers"
VESSEL_COLUMNS = ["imo", "name", "type", "sanctions", "risk_level", "notes", "source"]
TAG = r"<[^>]*>"


def _text(html: Column) -> Column:
    """Cell or page text: tags out, the common entities resolved, edges trimmed."""
    plain = F.regexp_replace(html, TAG, "")
    for entity, ch in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"')):
        plain = F.replace(plain, F.lit(entity), F.lit(ch))
    return F.trim(plain)


def extract_sanction_rows(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> page_id, imo, name, flag.

    Table rows with at least three cells and a 7-digit number beginning with 9; on pages without
    any, "NAME (IMO 1234567)" in the text; on pages without that either, JSON fragments of
    scripts that have an imo. Whole pages, one row per page at a time.
    """
    rows = F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)

    def from_row(row: Column) -> Column:
        cells = F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), _text)
        imo = F.regexp_extract(F.array_join(cells, " "), r"\b(9\d{6})\b", 1)
        flags = F.filter(cells, lambda c: c.rlike("^[A-Z]{2}$"))
        return F.when(
            (F.size(cells) >= 3) & (imo != ""),
            F.struct(imo.alias("imo"), F.get(cells, F.lit(0)).alias("name"), F.coalesce(F.get(flags, F.lit(0)), F.lit("")).alias("flag")),
        )

    listed = F.array_compact(F.transform(rows, from_row))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", " "), TAG, "")
    # From each number back over the letters before it: a pattern that begins with the name would try every letter of the text.
    number = r"(?i)IMO[:\s]*(\d{7})"
    before = F.transform(F.split(text, number), F.reverse)
    named = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(number), 1).alias("imo"),
        F.transform(before, lambda x: F.reverse(F.regexp_extract(x, r"(?i)^[(\[]?\s*+([A-Z\s]*[A-Z])", 1))).alias("name"),
    )
    in_text = F.transform(
        F.filter(named, lambda x: x["imo"].isNotNull() & (F.length(x["name"]) > 2) & (F.length(x["name"]) < 50)),
        lambda x: F.struct(x["imo"].alias("imo"), x["name"].alias("name"), F.lit("").alias("flag")),
    )
    scripts = F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), 1), "\n")
    fragments = F.regexp_extract_all(scripts, F.lit(r'(\{[^{}]*"imo"[^{}]*\})'), 1)

    def from_json(doc: Column) -> Column:
        imo = F.get_json_object(doc, "$.imo")
        name = F.coalesce(F.get_json_object(doc, "$.name"), F.get_json_object(doc, "$.vessel"), F.lit(""))
        return F.when(
            imo.isNotNull(),
            F.struct(imo.alias("imo"), name.alias("name"), F.coalesce(F.get_json_object(doc, "$.flag"), F.lit("")).alias("flag")),
        )

    in_scripts = F.array_compact(F.transform(fragments, from_json))
    found = F.when(F.size(listed) > 0, listed).when(F.size(in_text) > 0, in_text).otherwise(in_scripts)
    return pages.select("page_id", F.explode(found).alias("v")).select("page_id", "v.imo", "v.name", "v.flag")


OFAC_ENTRY = (
    "uid:string, sdnType:string, lastName:string, remarks:string, idList:array<struct<idType:string, idNumber:string>>"
)


def extract_ofac_vessels(documents: DataFrame, column: str = "value") -> DataFrame:
    """JSON documents {sdnList: [...]} -> vessel rows (VESSEL_COLUMNS); entries without an IMO are dropped."""
    entries = documents.select(F.explode(F.from_json(column, f"struct<sdnList:array<struct<{OFAC_ENTRY}>>>")["sdnList"]).alias("e"))
    e = F.col("e")
    ids = F.filter(e["idList"], lambda i: F.upper(i["idType"]).contains("IMO"))
    remark = F.nullif(F.regexp_extract(F.coalesce(e["remarks"], F.lit("")), r"(?i)IMO[:\s]*(\d{7})", 1), F.lit(""))
    rows = entries.where(F.lower(e["sdnType"]) == "vessel").withColumn(
        "imo", F.coalesce(F.get(ids, F.lit(0))["idNumber"], remark)
    )
    return rows.where(F.col("imo") != "").select(
        "imo",
        F.coalesce(e["lastName"], F.lit("")).alias("name"),
        F.lit(None).cast("string").alias("type"),
        F.array(F.lit("OFAC")).alias("sanctions"),
        F.lit("critical").alias("risk_level"),
        F.concat(F.lit("OFAC SDN ID: "), F.coalesce(e["uid"], F.lit("N/A"))).alias("notes"),
        F.lit("OFAC_SDN").alias("source"),
    )


def shadow_fleet_records(vessels: DataFrame, source: str | None = "shadow_fleet_database", loaded_at: str | None = None) -> DataFrame:
    """Vessel list rows -> SANCTIONED_VESSEL records, with `key` IMO:x."""
    none = F.lit(None).cast("string")

    def col(name: str) -> Column:
        return F.col(name) if name in vessels.columns else none

    sanctions = F.col("sanctions") if "sanctions" in vessels.columns else F.lit(None).cast("array<string>")
    return vessels.select(
        F.concat(F.lit("IMO:"), F.col("imo")).alias("key"),
        F.lit("SANCTIONED_VESSEL").alias("record_type"),
        F.col("imo").alias("imo_number"),
        F.coalesce(col("name"), F.lit("Unknown")).alias("vessel_name"),
        F.coalesce(col("type"), F.lit("unknown")).alias("vessel_type"),
        F.coalesce(sanctions, F.array().cast("array<string>")).alias("sanctions_authorities"),
        F.coalesce(col("risk_level"), F.lit("high")).alias("risk_level"),
        F.coalesce(col("notes"), F.lit("")).alias("notes"),
        (F.lit(source) if source else F.coalesce(col("source"), F.lit("api_update"))).alias("source"),
        F.lit(loaded_at).cast("string").alias("loaded_at"),
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    """Vessel rows of all sources, the first source's row per IMO; rows without an IMO are dropped."""
    ranked = [s.select(*VESSEL_COLUMNS, F.lit(i).alias("_source")) for i, s in enumerate(sources)]
    every = reduce(DataFrame.unionByName, ranked).where(F.col("imo") != "")
    return first_by_priority(every, ["imo"], F.col("_source"), F.col("name")).drop("_source")


def not_yet_published(vessels: DataFrame, known: DataFrame) -> DataFrame:
    """Vessels whose fingerprint is not among `known` (hash)."""
    hashed = vessels.withColumn("hash", record_hash("imo", "name", F.col("sanctions")))
    return hashed.join(known.select("hash"), "hash", "left_anti")


def refresh_sanctions(sources: list[DataFrame], known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One update cycle: (new records to publish, all known hashes afterwards)."""
    fresh = not_yet_published(union_sources(*sources), known)
    records = shadow_fleet_records(fresh, source=None)
    return records, known.select("hash").union(fresh.select("hash")).distinct()


def merge_vessels(fleet: DataFrame, found: DataFrame, added_on: str) -> DataFrame:
    """Fleet list (imo, name, flag, type, sanctions, risk_level, notes) merged with found vessels.

    `change` says added, updated or null. A known vessel gets the list's mark once; a new one is
    high risk with only that mark.
    """
    new = first_by_priority(found.where(F.col("imo") != ""), ["imo"], F.col("name"), F.col("flag")).select(
        "imo", F.col("name").alias("_name"), F.col("flag").alias("_flag"), F.lit(True).alias("_found")
    )
    both = fleet.withColumn("_known", F.lit(True)).join(new, "imo", "full_outer")
    known, marked = F.col("_known").isNotNull(), F.coalesce(F.col("sanctions"), F.array().cast("array<string>"))
    hit = F.col("_found").isNotNull()
    listed = F.array_contains(marked, LIST_NAME) | F.array_contains(marked, LIST_MARK)
    update = known & hit & ~listed
    return both.select(
        "imo",
        F.when(known, F.col("name")).otherwise(F.col("_name")).alias("name"),
        F.when(known, F.col("flag")).otherwise(F.col("_flag")).alias("flag"),
        F.when(known, F.col("type")).otherwise("tanker").alias("type"),
        F.when(~known, F.array(F.lit(LIST_MARK))).when(update, F.array_append(marked, F.lit(LIST_MARK))).otherwise(F.col("sanctions")).alias("sanctions"),
        F.when(known, F.col("risk_level")).otherwise("high").alias("risk_level"),
        F.when(known, F.col("notes")).otherwise(F.lit(f"Added from {LIST_NAME} {added_on}")).alias("notes"),
        F.when(~known, "added").when(update, "updated").alias("change"),
    )
