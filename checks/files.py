"""Queries over files: zones, ports, sanctioned entities and stored tracks, written as JSON from the given tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from checks import sqlparts as S
from checks.detectors import ANCHOR_CTE, CABLE_CTE
from checks.registry import Tables, register
from harborlight import dims
from harborlight.functions import geo, sql
from harborlight.plans import replay as tracks_replay
from harborlight.plans import serving
from harborlight.session import shared_folder
from harborlight.sources import positions as src, reference

#: Items of a file at most; a file is read by one task.
ITEMS = 500
#: Reports in a file of stored tracks, about; a track is in one file.
FILE_REPORTS = 20_000


def _json_files(t: Tables, label: str, items: DataFrame, group: list, wrap) -> str:
    """A JSON document per group of items (column `x`), `wrap`ped around their list, each in a file of its own."""
    docs = items.groupBy(*group).agg(F.array_sort(F.collect_list("x")).alias("xs")).select(F.to_json(wrap(F.col("xs"))).alias("value"), *group)
    names = [c for c in docs.columns if c != "value"]
    folder = f"{shared_folder(t.spark)}/{label}-{uuid.uuid4().hex}"
    docs.withColumn("doc", F.concat_ws("-", *names)).drop(*names).repartition("doc").write.partitionBy("doc").text(folder)
    return folder


def _zone_files(t: Tables) -> str:
    """A box a customer, in feature collections; some have a type of their own, some no name."""
    c = t.table("customer")
    west, south = F.col("c_custkey") % 40 * 0.5, 50 + F.floor(F.col("c_custkey") / 40) % 20 * 0.25
    corners = [(0.0, 0.0), (0.25, 0.0), (0.25, 0.25), (0.0, 0.25), (0.0, 0.0)]
    ring = F.array(*[F.array(west + x, south + y) for x, y in corners])
    properties = F.create_map(
        F.lit("id"), F.concat(F.lit("Z"), F.col("c_custkey")), F.lit("infrastructure_type"), F.col("c_mktsegment"),
        F.lit("name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")),
        F.lit("zone_type"), F.when(F.col("c_custkey") % 4 == 0, "cable_protection"),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"), F.map_filter(properties, lambda k, v: v.isNotNull()).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    items = c.select(F.floor(F.col("c_custkey") / ITEMS).alias("part"), F.to_json(feature).alias("x"))
    docs = items.groupBy("part").agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("xs"))
    folder = f"{shared_folder(t.spark)}/zones-{uuid.uuid4().hex}"
    docs.select(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("xs"), F.lit("]}")).alias("value"),
        F.col("part").alias("doc"),
    ).repartition("doc").write.partitionBy("doc").text(folder)
    return folder


_ZONES_SQL = f"""select 'Z' || c_custkey as zone_id, case when c_custkey % 3 > 0 then c_name else 'Zone Z' || c_custkey end as zone_name,
  case when c_custkey % 4 = 0 then 'cable_protection' else 'unknown' end as zone_type, c_mktsegment as infrastructure_type,
  case when c_custkey % 4 = 0 then 'HIGH' else '{dims.DEFAULT_ZONE_RULE['severity']}' end as severity, cast(c_custkey % 40 as double) * 0.5 as west,
  50 + (c_custkey // 40) % 20 * 0.25::double as south, 5 as points from customer"""


@register("a05_geojson_zones", _ZONES_SQL)
def geojson_zones(t: Tables):
    zones = reference.read_geojson_zones(t.spark, _zone_files(t) + "/*")
    ring = F.col("rings")[0]
    return zones.select(
        "zone_id", "zone_name", "zone_type", "infrastructure_type", "severity",
        ring[0]["x"].alias("west"), ring[0]["y"].alias("south"), F.size(ring).alias("points"),
    )


@register("b09_infrastructure_counts", "select c_mktsegment as infrastructure_type, count(*) as zones from customer group by 1")
def infrastructure_counts(t: Tables):
    return serving.infrastructure_counts(reference.read_geojson_zones(t.spark, _zone_files(t) + "/*"))


@register(
    "b09_infrastructure_by_type",
    "select 'Z' || c_custkey as zone_id, c_mktsegment as infrastructure_type from customer where c_mktsegment in ('MACHINERY', 'HOUSEHOLD')",
)
def infrastructure_by_type(t: Tables):
    zones = reference.read_geojson_zones(t.spark, _zone_files(t) + "/*")
    return serving.infrastructure_by_type(zones, ["MACHINERY", "HOUSEHOLD"]).select("zone_id", "infrastructure_type")


@register(
    "a06_ports",
    """select case when s_suppkey % 5 = 0 then 'LOC' || s_suppkey else 'P' || s_suppkey end as port_id, s_name as port_name,
  case when s_suppkey % 2 = 0 then 'N' || s_nationkey else '' end as country, s_acctbal / 200 as latitude,
  case when s_suppkey % 7 = 0 then 0 else s_acctbal / 100 end as longitude, case when s_suppkey % 3 = 0 then 'major' else 'minor' end as port_type
  from supplier""",
)
def ports(t: Tables):
    """Ports in lists and in documents with a list; some without id, country, longitude or type."""
    key = F.col("s_suppkey")
    item = F.struct(
        F.when(key % 5 != 0, F.concat(F.lit("P"), key)).alias("id"), F.when(key % 5 == 0, F.concat(F.lit("LOC"), key)).alias("locode"),
        F.col("s_name").alias("name"), F.when(key % 2 == 0, F.concat(F.lit("N"), F.col("s_nationkey"))).alias("country"),
        (F.col("s_acctbal") / 200).alias("latitude"), F.when(key % 7 != 0, F.col("s_acctbal") / 100).alias("longitude"),
        F.when(key % 3 == 0, "major").alias("type"),
    )
    rows = t.table("supplier").select("s_nationkey", F.floor(key / ITEMS).alias("part"), item.alias("x"))
    group = ["s_nationkey", "part"]
    listed = _json_files(t, "ports", rows.where("s_nationkey % 2 = 0"), group, lambda xs: xs)
    wrapped = _json_files(t, "ports", rows.where("s_nationkey % 2 = 1"), group, lambda xs: F.struct(xs.alias("ports")))
    found = [reference.read_ports(t.spark, folder + "/*") for folder in (listed, wrapped)]
    return found[0].unionByName(found[1]).select("port_id", "port_name", "country", "latitude", "longitude", "port_type")


@register(
    "a07_sanction_entities",
    """select 'E' || c_custkey as entity_id, case when c_custkey % 2 = 0 then 'company' else 'vessel' end as entity_type, c_name as name,
  case when c_custkey % 3 = 0 then c_mktsegment || '|' || c_name else '' end as aliases, 'EU' as sanctions_source,
  case when c_custkey % 5 = 0 then 'balance ' || c_nationkey else '' end as reason from customer""",
)
def sanction_entities(t: Tables):
    key = F.col("c_custkey")
    item = F.struct(
        F.concat(F.lit("E"), key).alias("id"), F.when(key % 2 == 0, "company").alias("type"), F.col("c_name").alias("name"),
        F.when(key % 3 == 0, F.array("c_mktsegment", "c_name")).alias("aliases"), F.lit("EU").alias("source"),
        F.when(key % 5 == 0, F.concat(F.lit("balance "), F.col("c_nationkey"))).alias("reason"),
    )
    rows = t.table("customer").select(F.floor(key / ITEMS).alias("part"), item.alias("x"))
    folder = _json_files(t, "entities", rows, ["part"], lambda xs: F.struct(xs.alias("entities")))
    return reference.read_sanction_entities(t.spark, folder + "/*").select(
        "entity_id", "entity_type", "name", F.array_join("aliases", "|").alias("aliases"), "sanctions_source", "reason"
    )


# ---------------------------------------------------------------- stored tracks

def _tracks(t: Tables) -> DataFrame:
    """A track a vessel and day, in lists of tracks: its reports as the replay list, and as waypoints of which some are tagged."""
    day = F.floor(F.col("t_s") / 86400)
    point = F.struct(
        "t_s", "row_id",
        F.struct(
            "mmsi", F.col("t_s").alias("timestamp"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
            F.col("speed_over_ground").alias("sog"), F.col("course_over_ground").alias("cog"), "nav_status",
        ).alias("p"),
        F.struct(
            F.date_format(F.timestamp_seconds("t_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("latitude").alias("lat"),
            F.col("longitude").alias("lon"), F.col("speed_over_ground").alias("speed_kn"), F.lit("under way").alias("status"),
            F.lit("at sea").alias("location"),
            F.when(F.col("row_id") % 50 == 0, "ANCHOR_DRAG").when(F.col("row_id") % 20 == 0, "NEAR_CABLE").alias("alert"),
        ).alias("w"),
    )
    grouped = t.positions.groupBy("mmsi", day.alias("day")).agg(F.array_sort(F.collect_list(point)).alias("points"))
    # Files of several tracks, or their number would be that of the vessels and days.
    files = t.positions.agg(F.ceil(F.greatest(F.count("*"), F.lit(1)) / FILE_REPORTS).cast("long")).scalar()
    docs = grouped.select(
        F.to_json(F.struct(
            F.struct(F.concat(F.lit("V "), "mmsi").alias("vessel"), "mmsi").alias("metadata"),
            F.transform("points", lambda x: x["w"]).alias("track"), F.transform("points", lambda x: x["p"]).alias("ais_positions_for_replay"),
        )).alias("value"),
        F.pmod(F.xxhash64("mmsi", "day"), files).alias("doc"), "mmsi", "day",
    )
    # A line a track, in order, with the signs that make a list of the file's lines, so no task holds whole files.
    in_doc = Window.partitionBy("doc").orderBy("mmsi", "day")
    begins = F.when(F.row_number().over(in_doc) == 1, "[").otherwise(",")
    ends = F.when(F.lead(F.lit(True)).over(in_doc).isNull(), "]").otherwise("")
    folder = f"{shared_folder(t.spark)}/tracks-{uuid.uuid4().hex}"
    docs.select(F.concat(begins, "value", ends).alias("value"), "doc").write.partitionBy("doc").text(folder)
    return src.read_tracks(t.spark, folder + "/*")


REPLAY_POSITIONS = (
    "p as materialized (select row_number() over (partition by mmsi, t_s // 86400 order by t_s, row_id) - 1 as pos, t_s, mmsi, latitude, longitude, "
    "speed_over_ground, course_over_ground, null::double as heading, nav_status, null::int as ship_type, 'V ' || mmsi as ship_name, row_id "
    f"from ({S.query(S.POSITIONS, 'select * from p')}))"
)
_TAGGED = (
    "select case when row_id % 50 = 0 then 'ANCHOR_DRAG' else 'CABLE_PROXIMITY' end as alert_type, case when row_id % 50 = 0 then 'CRITICAL' else 'HIGH' end as severity, "
    "mmsi, t_s, case when row_id % 50 = 0 then 'ANCHOR DRAG' else 'NEAR CABLE' end as title, "
    "'investigation-alert-' || pos as alert_id from p where row_id % 50 = 0 or row_id % 20 = 0"
)


@register("a15_replay_track", S.query(REPLAY_POSITIONS, "select pos as row_id, t_s, mmsi, latitude, longitude, speed_over_ground, course_over_ground, nav_status, ship_name from p"))
def replay_track(t: Tables):
    return src.replay_positions(_tracks(t)).select(
        "row_id", "t_s", "mmsi", "latitude", "longitude", "speed_over_ground", "course_over_ground", "nav_status", "ship_name"
    )


@register("b12_investigation_alerts", S.query(REPLAY_POSITIONS, _TAGGED))
def investigation_alerts(t: Tables):
    return src.tagged_waypoints(_tracks(t)).select(
        "alert_type", "severity", "mmsi", F.unix_seconds("detected_at").alias("t_s"), "title", "alert_id"
    )


_CABLES = "select 'CABLE_PROXIMITY' as alert_type, severity, mmsi, t_s, 'detector' as origin from cab_kept"
_ANCHORS = (
    "select 'ANCHOR_DRAGGING', case cause when 'fast' then case when near_cable then 'CRITICAL' else 'HIGH' end when 'moving' then "
    "case when near_cable then 'HIGH' else 'MEDIUM' end else case when near_cable then 'CRITICAL' else 'MEDIUM' end end, mmsi, t_s, 'detector' from anc_kept"
)
_TAGS = f"select alert_type, severity, mmsi, t_s, 'tag' from ({_TAGGED})"
_REPLAYED = [REPLAY_POSITIONS, S.zones(), *CABLE_CTE, *ANCHOR_CTE, f"replayed as (select * from ({_CABLES} union all {_ANCHORS} union all {_TAGS}))"]


def _replayed(t: Tables) -> DataFrame:
    return tracks_replay.replay(_tracks(t), t.zones).withColumn("t_s", F.unix_seconds("detected_at"))


@register("i12_replay", S.query(*_REPLAYED, "select * from replayed"))
def replay(t: Tables):
    return _replayed(t).select("alert_type", "severity", "mmsi", "t_s", "origin")


@register(
    "h03_combined_alerts",
    S.query(*_REPLAYED, "select alert_type, severity, mmsi, t_s from replayed where origin = 'tag' or (origin = 'detector' and mmsi = (select max(mmsi) from replayed where origin = 'detector'))"),
)
def combined_alerts(t: Tables):
    every = _replayed(t)
    own, tagged = every.where("origin = 'detector'"), every.where("origin = 'tag'")
    return serving.combined_alerts(own, tagged, own.agg(F.max("mmsi")).scalar()).select("alert_type", "severity", "mmsi", "t_s")


# ---------------------------------------------------------------- scalars from SQL

@register(
    "k_sql_functions",
    S.query(
        S.POSITIONS,
        f"""select row_id, round({S.hav('latitude', 'longitude', '57.6', '21')}, 6) as nm, round({S.hav_m('latitude', 'longitude', '57.6', '21')}, 3) as m,
  round((degrees(atan2(sin(radians(21 - longitude)) * cos(radians(57.6)), cos(radians(latitude)) * sin(radians(57.6)) - sin(radians(latitude)) * cos(radians(57.6)) * cos(radians(21 - longitude)))) + 360) % 360, 4) as bearing,
  {S.CABLE_FLAG} as flag, {S.DISPLAY_FLAG} as shown, {S.INVESTIGATOR_FLAG} as investigated,
  case when ship_type is null or ship_type = 0 then 'unknown' when ship_type between 70 and 79 then 'cargo' when ship_type between 80 and 89 then 'tanker'
    when ship_type between 30 and 37 then 'fishing' when ship_type between 60 and 69 then 'passenger' when ship_type between 40 and 49 then 'highspeed'
    when ship_type between 50 and 59 then 'special' when ship_type between 20 and 29 then 'wing' else 'other' end as category,
  case when length(mmsi) <> 9 then 'INVALID_LENGTH' when mmsi in ('000000000', '999999999', '123456789', '111111111') then 'SUSPICIOUS_PATTERN'
    when try_cast(substr(mmsi, 1, 3) as int) is null then 'NON_NUMERIC' when try_cast(substr(mmsi, 1, 3) as int) not between 200 and 799 then 'INVALID_MID' end as problem
  from p where latitude between 54 and 61""",
    ),
)
def sql_functions(t: Tables):
    sql.register(t.spark, "ais_")
    return t.spark.sql(
        """select row_id, round(ais_haversine_nm(latitude, longitude, 57.6, 21), 6) as nm, round(ais_haversine_m(latitude, longitude, 57.6, 21), 3) as m,
  round(ais_bearing(latitude, longitude, 57.6, 21), 4) as bearing, ais_flag_cable(mmsi) as flag, ais_flag_display(mmsi) as shown,
  ais_flag_investigator(mmsi) as investigated, ais_vessel_category(ship_type) as category, ais_mmsi_problem(mmsi) as problem
  from {p} where ais_in_box(latitude, longitude, 54, -180, 61, 180)""",
        p=t.positions,
    )


@register(
    "c09_adjacent_cells",
    S.query(
        S.POSITIONS,
        "select row_id, cast(floor(latitude / 0.1) as int) + a as cell_lat, cast(floor(longitude / 0.1) as int) + b as cell_lon "
        "from p, (values (-1), (0), (1)) x(a), (values (-1), (0), (1)) y(b)",
    ),
)
def adjacent_cells(t: Tables):
    near = geo.adjacent_cells(*geo.grid_cell("latitude", "longitude"))
    return t.positions.select("row_id", F.inline(near))
