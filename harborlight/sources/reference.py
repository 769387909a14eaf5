"""Zones, ports and sanction lists: files, reference messages, and their typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlight import dims
from harborlight.functions import ais

RING_TYPE = "array<array<double>>"
ZONE_DATA = (
    "zone_id string, zone_name string, zone_type string, jurisdiction string, "
    "geometry struct<type:string, coordinates:string>, "
    "rules struct<alert_vessel_types:array<int>, alert_on_fishing_behavior:boolean, alert_all_vessels:boolean, "
    "check_flag_state:boolean, severity:string>, metadata map<string,string>"
)


def parse_rings(kind: Column, coordinates: Column) -> Column:
    """GeoJSON Polygon or MultiPolygon coordinates (JSON text) -> array of rings of struct(x, y).

    Anything else gives null. Rings are even-odd, so holes need no mark.
    """
    polygon = F.from_json(coordinates, f"array<{RING_TYPE}>")
    multi = F.flatten(F.from_json(coordinates, f"array<array<{RING_TYPE}>>"))
    rings = F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", multi)
    return F.transform(
        rings,
        lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))),
    )


def read_geojson_zones(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollection or single Feature files -> zones (dims.ZONE_SCHEMA) with rules and metadata.

    The type comes from the feature, else from the file name; the rules then follow the type,
    but a feature that names its own type only carries its severity (default HIGH).
    """
    shape = (
        "type string, properties map<string,string>, geometry struct<type:string, coordinates:string>, "
        "features array<struct<properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"
    )
    docs = spark.read.schema(shape).option("multiLine", True).json(path).withColumn("_file", F.input_file_name())
    single = F.when(F.col("type") == "Feature", F.array(F.struct("properties", "geometry")))
    features = docs.select(
        F.regexp_extract("_file", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"),
        F.posexplode(F.coalesce("features", single)).alias("i", "f"),
    ).select("stem", "i", F.col("f.properties").alias("props"), F.col("f.geometry").alias("geometry"))

    def prop(name: str) -> Column:
        return F.col("props")[name]

    zone_id = F.coalesce(prop("id"), prop("MRGID"), F.concat_ws("-", "stem", F.col("i").cast("string")))
    kind = F.coalesce(prop("zone_type"), ais.zone_type_from_filename("stem"))
    by_type = ais.zone_rules("zone_type")
    own = prop("zone_type").isNotNull()
    named = features.withColumn("zone_id", zone_id).withColumn("zone_type", kind)
    return named.select(
        "zone_id",
        F.coalesce(prop("name"), prop("GEONAME"), F.concat(F.lit("Zone "), F.col("zone_id"))).alias("zone_name"),
        "zone_type",
        F.coalesce(prop("jurisdiction"), prop("SOVEREIGN1"), F.lit("EU")).alias("jurisdiction"),
        prop("infrastructure_type").alias("infrastructure_type"),
        F.when(own, F.coalesce(prop("severity"), F.lit("HIGH"))).otherwise(by_type["severity"]).alias("severity"),
        F.when(own, F.lit(False)).otherwise(by_type["alert_all_vessels"]).alias("alert_all_vessels"),
        parse_rings(F.col("geometry.type"), F.col("geometry.coordinates")).alias("rings"),
        by_type.alias("rules"),
        F.col("props").alias("metadata"),
    )


def _documents(spark: SparkSession, path: str, field: str, item: str) -> DataFrame:
    """Items of JSON files that hold either a list or an object with the list in `field`."""
    text = spark.read.text(path, wholetext=True).withColumn("_file", F.input_file_name())
    listed = F.from_json("value", f"array<struct<{item}>>")
    wrapped = F.from_json("value", f"struct<{field}:array<struct<{item}>>>")[field]
    is_list = F.ltrim(F.col("value")).startswith("[")
    return text.select(
        F.regexp_extract("_file", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"),
        F.explode(F.when(is_list, listed).otherwise(wrapped)).alias("x"),
    )


def port_columns(items: DataFrame) -> DataFrame:
    """Raw port items (column `x`) -> ports with defaults."""
    x = F.col("x")
    return items.select(
        F.coalesce(x["id"], x["locode"], F.concat(F.lit("port-"), F.xxhash64(x["name"]).cast("string"))).alias("port_id"),
        F.coalesce(x["name"], F.lit("Unknown")).alias("port_name"),
        F.coalesce(x["country"], F.lit("")).alias("country"),
        F.coalesce(x["latitude"], F.lit(0.0)).alias("latitude"),
        F.coalesce(x["longitude"], F.lit(0.0)).alias("longitude"),
        F.coalesce(x["type"], F.lit("minor")).alias("port_type"),
        x["locode"].alias("locode"),
    )


PORT_ITEM = "id:string, name:string, country:string, latitude:double, longitude:double, type:string, locode:string"


def read_ports(spark: SparkSession, path: str) -> DataFrame:
    return port_columns(_documents(spark, path, "ports", PORT_ITEM))


ENTITY_ITEM = (
    "id:string, type:string, name:string, aliases:array<string>, mmsi:string, imo_number:string, "
    "flag_state:string, source:string, date_listed:string, reason:string, additional_info:map<string,string>"
)


def entity_columns(items: DataFrame) -> DataFrame:
    """Raw sanction items (columns `x`, `stem`) -> sanctioned entities with defaults."""
    x = F.col("x")
    return items.select(
        F.coalesce(x["id"], F.concat(F.lit("sanction-"), F.xxhash64(x["name"]).cast("string"))).alias("entity_id"),
        F.coalesce(x["type"], F.lit("vessel")).alias("entity_type"),
        F.coalesce(x["name"], F.lit("Unknown")).alias("name"),
        F.coalesce(x["aliases"], F.array().cast("array<string>")).alias("aliases"),
        x["mmsi"].alias("mmsi"),
        x["imo_number"].alias("imo_number"),
        x["flag_state"].alias("flag_state"),
        F.coalesce(x["source"], F.upper("stem")).alias("sanctions_source"),
        F.coalesce(x["date_listed"], F.lit("")).alias("date_listed"),
        F.coalesce(x["reason"], F.lit("")).alias("reason"),
        F.coalesce(x["additional_info"], F.create_map().cast("map<string,string>")).alias("additional_info"),
    )


def read_sanction_entities(spark: SparkSession, path: str) -> DataFrame:
    return entity_columns(_documents(spark, path, "entities", ENTITY_ITEM))


def read_mids(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Lines `digits,flag` -> pairs for the functions that take `mids`.

    Other lines are left out, and the first flag by name counts where digits repeat; as digits
    are three, that makes a thousand pairs at most.
    """
    lines = spark.read.schema("mid string, flag string").csv(path)
    known = lines.where(F.col("mid").rlike("^[0-9]{3}$") & (F.col("flag") != ""))
    return [(r.mid, r.flag) for r in known.groupBy("mid").agg(F.min("flag").alias("flag")).orderBy("mid").collect()]


def wrap_reference(df: DataFrame, record_type: str, id_column: str, loaded_at: Column | None = None) -> DataFrame:
    """Rows -> reference messages: key `type:id`, value JSON {record_type, loaded_at, data}."""
    stamp = loaded_at if loaded_at is not None else F.current_timestamp()
    body = F.struct(
        F.lit(record_type).alias("record_type"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("loaded_at"),
        F.struct(*df.columns).alias("data"),
    )
    return df.select(
        F.concat_ws(":", F.lit(record_type), F.col(id_column).cast("string")).alias("key"), F.to_json(body).alias("value")
    )


def parse_reference(messages: DataFrame, record_type: str = "geofence", offset: str = "offset") -> DataFrame:
    """Messages (value, offset) -> the latest zone per zone_id; broken JSON and other records are left out."""
    doc = F.from_json("value", f"record_type string, data struct<{_struct_fields(ZONE_DATA)}>")
    rows = messages.select(doc.alias("d"), F.col(offset).alias("_offset")).where(F.col("d.record_type") == record_type)
    latest = (
        rows.where(F.col("d.data.zone_id").isNotNull())
        .groupBy(F.col("d.data.zone_id").alias("_id"))
        .agg(F.max_by("d.data", "_offset").alias("z"))
    )
    z = F.col("z")
    return latest.select(
        z["zone_id"].alias("zone_id"),
        z["zone_name"].alias("zone_name"),
        z["zone_type"].alias("zone_type"),
        z["jurisdiction"].alias("jurisdiction"),
        z["metadata"]["infrastructure_type"].alias("infrastructure_type"),
        ais.zone_severity(z["rules"]["severity"]).alias("severity"),
        F.coalesce(z["rules"]["alert_all_vessels"], F.lit(False)).alias("alert_all_vessels"),
        parse_rings(z["geometry"]["type"], z["geometry"]["coordinates"]).alias("rings"),
        z["rules"].alias("rules"),
        z["metadata"].alias("metadata"),
    )


def _struct_fields(ddl: str) -> str:
    """Column DDL as the inside of struct<...>."""
    depth, out, start, parts = 0, [], 0, []
    for i, ch in enumerate(ddl + ","):
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            parts.append(ddl[start:i].strip())
            start = i + 1
    for part in parts:
        name, kind = part.split(" ", 1)
        out.append(f"{name}:{kind}")
    return ", ".join(out)


def sanction_keys(record_type: Column, imo: Column, mmsi: Column, mid: Column) -> Column:
    """The keys a sanction record is found by: IMO:x and MMSI:x for vessels, FLAG:mid for flags."""
    vessel = record_type == "SANCTIONED_VESSEL"
    return F.array_compact(
        F.array(
            F.when(vessel & (imo != ""), F.concat(F.lit("IMO:"), imo)),
            F.when(vessel & (mmsi != ""), F.concat(F.lit("MMSI:"), mmsi)),
            F.when(record_type == "HIGH_RISK_FLAG", F.concat(F.lit("FLAG:"), mid)),
        )
    )


def latest_sanctions(records: DataFrame, offset: str = "offset") -> DataFrame:
    """Records in dims.SANCTION_SCHEMA (plus `offset`) -> the latest record per key."""
    row = F.struct(*[c for c in records.columns if c != offset])
    keyed = records.select(
        F.explode(sanction_keys(F.col("record_type"), F.col("imo_number"), F.col("mmsi"), F.col("mid_code"))).alias("key"),
        row.alias("r"),
        F.col(offset).alias("_offset"),
    )
    return keyed.groupBy("key").agg(F.max_by("r", "_offset").alias("r")).select("key", "r.*")


def parse_sanctions(messages: DataFrame, offset: str = "offset") -> DataFrame:
    """Messages (value, offset) -> the latest sanction record per key."""
    fields = _struct_fields(dims.SANCTION_SCHEMA)
    rows = messages.select(F.from_json("value", f"struct<{fields}>").alias("r"), F.col(offset).alias("offset"))
    return latest_sanctions(rows.select("r.*", "offset"), "offset")


def first_by_priority(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """Keep the first row per key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
