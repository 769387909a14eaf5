"""Queries for the sources, functions, joins, aggregates and serving operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks.detectors import ALERTS_CTE, INCIDENT_CTE, all_detector_alerts
from checks.registry import Tables, register
from harborlight import dims
from harborlight.functions import ais, alerts, geo
from harborlight.operators.history import first_seen, last_seen, with_history, with_last_rows
from harborlight.operators.throttle import thin_track
from harborlight.operators.zones import in_zones
from harborlight.plans import incidents, serving, state
from harborlight.sources import fleet, positions as src, reference
from harborlight.session import written

CUR = "cur as materialized (select * exclude (n) from (select *, row_number() over (partition by mmsi order by t_s desc, row_id desc) as n from p) where n = 1)"
NOW = 1704067200 + 12000


def cur(t: Tables):
    return serving.current_positions(t.positions)


def r6(c, name):
    return F.round(c, 6).alias(name)


# ---------------------------------------------------------------- sources

@register(
    "a02_parse_positions",
    S.query(S.POSITIONS, "select mmsi, latitude, longitude, speed_over_ground, nav_status, ship_type, ship_name, imo_number, t_s from p"),
)
def parse_positions(t: Tables):
    p = t.positions.withColumn("timestamp", F.date_format(F.timestamp_seconds("t_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    broken = p.select(F.lit("k").alias("key"), F.lit('{"mmsi": "1", ').alias("value")).unionByName(
        p.select(F.lit("k").alias("key"), F.lit('{"mmsi": "", "latitude": 1}').alias("value"))
    )
    parsed = src.with_event_time(src.parse_positions(src.to_messages(p).unionByName(broken)))
    return parsed.select(
        "mmsi", "latitude", "longitude", "speed_over_ground", "nav_status", "ship_type", "ship_name", "imo_number", "t_s"
    )


def _feed(t: Tables):
    """Feed messages made from the positions: static data, class B (types 36 and 37) and position reports, and a type to drop."""
    p = t.positions
    static, class_b = F.col("message_type") == 5, F.col("ship_type") == 37
    meta = F.struct(
        F.col("mmsi").cast("bigint").alias("MMSI"), F.col("ship_name").alias("ShipName"), "latitude", "longitude",
        F.date_format(F.timestamp_seconds("t_s"), "yyyy-MM-dd HH:mm:ss.123456789 '+0000 UTC'").alias("time_utc"),
    )
    report = F.struct(
        F.lit(1).alias("MessageID"), F.col("course_over_ground").alias("Cog"), F.col("speed_over_ground").alias("Sog"),
        F.col("heading").alias("TrueHeading"), F.col("nav_status").alias("NavigationalStatus"),
    )
    ship = F.struct(
        F.lit(5).alias("MessageID"), F.lit("").alias("Name"), F.col("ship_type").alias("Type"),
        F.coalesce(F.col("imo_number").cast("bigint"), F.lit(0).cast("bigint")).alias("ImoNumber"),
        F.struct(F.lit(150).alias("A"), F.lit(50).alias("B"), F.lit(20).alias("C"), F.lit(20).alias("D")).alias("Dimension"),
    )
    small = F.struct(F.col("course_over_ground").alias("Cog"), F.col("speed_over_ground").alias("Sog"), F.col("heading").alias("TrueHeading"))
    body = F.struct(
        F.when(static, "ShipStaticData").when(class_b, "StandardClassBPositionReport").otherwise("PositionReport").alias("MessageType"),
        meta.alias("MetaData"),
        F.struct(
            F.when(static, ship).alias("ShipStaticData"),
            F.when(~static & class_b, small).alias("StandardClassBPositionReport"),
            F.when(~static & ~class_b, report).alias("PositionReport"),
        ).alias("Message"),
    )
    other = F.lit('{"MessageType": "BaseStationReport", "MetaData": {"MMSI": 1}}')
    return p.select(F.to_json(body).alias("value")).unionByName(p.select(other.alias("value")))


@register(
    "a11_normalize_ais",
    S.query(
        S.POSITIONS,
        """select cast(cast(mmsi as bigint) as varchar) as mmsi, latitude, longitude, ship_name,
  case when message_type = 5 then null else course_over_ground end as course_over_ground,
  case when message_type = 5 then null else speed_over_ground end as speed_over_ground,
  case when message_type = 5 or ship_type = 37 then null else nav_status end as nav_status,
  case when message_type = 5 then ship_type end as ship_type, case when message_type = 5 then imo_number end as imo_number,
  case when message_type = 5 then 200 end as length, case when message_type = 5 then 5 when ship_type = 37 then 18 else 1 end as message_type, t_s from p""",
    ),
)
def normalize_ais(t: Tables):
    out = src.with_event_time(src.normalize_ais(_feed(t)))
    return out.select(
        "mmsi", "latitude", "longitude", "ship_name", "course_over_ground", "speed_over_ground", "nav_status", "ship_type",
        "imo_number", ais.vessel_length().alias("length"), "message_type", "t_s",
    )


@register(
    "a12_parse_event_time",
    S.query(S.POSITIONS, "select row_id, t_s, t_s as iso, t_s as spaced, t_s as offset_form, null::bigint as bad from p"),
)
def parse_event_time(t: Tables):
    ts = F.timestamp_seconds("t_s")
    forms = {
        "iso": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "spaced": F.date_format(ts, "yyyy-MM-dd HH:mm:ss.123456789 '+0000 UTC'"),
        "offset_form": F.date_format(ts, "yyyy-MM-dd HH:mm:ss'+00:00'"),
        "bad": F.concat(F.lit("at "), F.col("mmsi")),
    }
    return t.positions.select("row_id", "t_s", *[F.unix_seconds(src.parse_event_time(f)).alias(n) for n, f in forms.items()])


@register("a13_ingest_bbox", S.query(S.POSITIONS, "select row_id from p where latitude between 54 and 61 and longitude between 12 and 31"))
def ingest_bbox(t: Tables):
    return src.ingest_bbox(t.positions).select("row_id")


@register("a14_read_history", S.query(S.POSITIONS, "select row_id, t_s from p where t_s between 1704070000 and 1704074000"))
def read_history(t: Tables):
    return src.read_history(t.positions, 1704070000, 1704074000).select("row_id", "t_s")


@register(
    "a03_latest_zone_per_id",
    "select 'V-' || user_id as zone_id, 'zone ' || max(event_id) as zone_name, case when max(event_id) % 2 = 0 then 'MPA' else 'EEZ' end as zone_type, "
    "'LOW' as severity, cast(max(event_id) % 50 as double) as west, 5 as corners from events group by user_id",
)
def latest_zone_per_id(t: Tables):
    e = t.table("events")
    west = (F.col("event_id") % 50).cast("double")
    ring = F.array(*[F.array(west + dx, F.lit(50.0) + dy) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    data = F.struct(
        F.concat(F.lit("V-"), F.col("user_id").cast("string")).alias("zone_id"),
        F.concat(F.lit("zone "), F.col("event_id").cast("string")).alias("zone_name"),
        F.when(F.col("event_id") % 2 == 0, "MPA").otherwise("EEZ").alias("zone_type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct(F.lit(False).alias("alert_all_vessels"), F.lit("LOW").alias("severity")).alias("rules"),
    )
    good = e.select(F.to_json(F.struct(F.lit("geofence").alias("record_type"), data.alias("data"))).alias("value"), F.col("event_id").alias("offset"))
    other = e.select(F.lit('{"record_type": "port", "data": {"zone_id": "P"}}').alias("value"), F.col("event_id").alias("offset"))
    broken = e.select(F.lit("{oops").alias("value"), F.col("event_id").alias("offset"))
    zones = reference.parse_reference(good.unionByName(other).unionByName(broken))
    ring0 = F.get("rings", F.lit(0))
    return zones.select("zone_id", "zone_name", "zone_type", "severity", F.get(ring0, F.lit(0))["x"].alias("west"), F.size(ring0).alias("corners"))


@register(
    "a04_latest_sanction_per_key",
    S.query(
        S.POSITIONS,
        """m as (select row_id, imo_number, mmsi, substr(mmsi, 1, 3) as mid, ship_name, row_id % 5 = 0 as is_flag from p),
keyed as (select 'IMO:' || imo_number as key, row_id, ship_name as who from m where not is_flag and imo_number <> ''
  union all select 'MMSI:' || mmsi, row_id, ship_name from m where not is_flag union all select 'FLAG:' || mid, row_id, null from m where is_flag)""",
        "select key, arg_max(coalesce(who, '-'), row_id) as who, max(row_id) as last_offset from keyed group by key",
    ),
)
def latest_sanction_per_key(t: Tables):
    p = t.positions
    flag = F.col("row_id") % 5 == 0
    body = F.struct(
        F.when(flag, "HIGH_RISK_FLAG").otherwise("SANCTIONED_VESSEL").alias("record_type"), "imo_number", "mmsi",
        F.when(~flag, F.col("ship_name")).alias("vessel_name"), F.substring("mmsi", 1, 3).alias("mid_code"),
        F.col("row_id").cast("string").alias("notes"),
    )
    messages = p.select(F.to_json(body).alias("value"), F.col("row_id").alias("offset"))
    return reference.parse_sanctions(messages).select(
        "key", F.coalesce("vessel_name", F.lit("-")).alias("who"), F.col("notes").cast("long").alias("last_offset")
    )


@register(
    "a08_wrap_reference",
    S.query(S.POSITIONS, CUR, "select 'vessel:' || mmsi as key, 'vessel' as record_type, '2024-01-01T00:00:00Z' as loaded_at, mmsi, ship_name from cur"),
)
def wrap_reference(t: Tables):
    rows = cur(t).select("mmsi", "ship_name")
    stamp = F.to_timestamp(F.lit("2024-01-01T00:00:00Z"))
    out = reference.wrap_reference(rows, "vessel", "mmsi", stamp)

    def field(path: str, name: str):
        return F.get_json_object("value", path).alias(name)

    return out.select(
        "key", field("$.record_type", "record_type"), field("$.loaded_at", "loaded_at"), field("$.data.mmsi", "mmsi"), field("$.data.ship_name", "ship_name")
    )


@register(
    "a09_high_risk_flag_reports",
    S.query(
        S.POSITIONS, "flags(mid, code, country, risk, reason) as (values " + ", ".join("(" + ", ".join(S._text(v) for v in r) + ")" for r in dims.HIGH_RISK_FLAG_RECORDS) + ")",
        "select mid as mid_code, country as country_name, risk as risk_level, count(*) as reports from p join flags on mid = substr(mmsi, 1, 3) group by all",
    ),
)
def high_risk_flag_reports(t: Tables):
    flags = dims.high_risk_flags(t.spark)
    return (
        t.positions.withColumn("mid_code", ais.mid("mmsi")).join(flags.select("mid_code", "country_name", "risk_level"), "mid_code")
        .groupBy("mid_code", "country_name", "risk_level").agg(F.count("*").alias("reports"))
    )


# Every vessel that reports; those without an IMO number get one from their MMSI.
FLEET = """vs as materialized (select imo, min(name) as name from (select mmsi, coalesce(min(imo_number), '9' || mmsi) as imo, min(ship_name) as name from p group by mmsi) group by imo)"""


def _vessels(t: Tables):
    own = t.positions.groupBy("mmsi").agg(F.min("imo_number").alias("imo"), F.min("ship_name").alias("name"))
    return own.groupBy(F.coalesce("imo", F.concat(F.lit("9"), "mmsi")).alias("imo")).agg(F.min("name").alias("name"))


def _source(vessels, marks, source):
    return vessels.select(
        "imo", "name", F.lit("tanker").alias("type"),
        F.array(*[F.lit(m) for m in marks]).alias("sanctions"), F.lit("high").alias("risk_level"), F.lit("").alias("notes"), F.lit(source).alias("source"),
    )


@register(
    "a10_shadow_fleet_records",
    S.query(
        S.POSITIONS, FLEET,
        "select 'IMO:' || imo as key, imo as imo_number, name as vessel_name, 'unknown' as vessel_type, 'high' as risk_level, 'shadow_fleet_database' as source "
        "from vs",
    ),
)
def shadow_fleet_records(t: Tables):
    rows = _vessels(t).select("imo", "name")
    return fleet.shadow_fleet_records(rows).select("key", "imo_number", "vessel_name", "vessel_type", "risk_level", "source")


# The local list has the vessels with a number of their own, one list all, the last those with an old name.
SOURCES = """src as (select imo, name, 'local' as source, 0 as s, ['UA'] as sanctions from vs where length(imo) = 7
  union all select imo, name, 'OFAC', 1, ['OFAC'] from vs
  union all select imo, name, 'EU', 2, ['EU', 'CH'] from vs where name like 'NAME %'),
uni as (select * exclude (n) from (select *, row_number() over (partition by imo order by s, name) as n from src) where n = 1)"""
_HASH = "substr(sha256(imo || ':' || name || ':' || array_to_string(list_sort(sanctions), ',')), 1, 16)"


def _sources(t: Tables):
    v = _vessels(t)
    return [
        _source(v.where("length(imo) = 7"), ["UA"], "local"),
        _source(v, ["OFAC"], "OFAC"),
        _source(v.where("name like 'NAME %'"), ["EU", "CH"], "EU"),
    ]


@register("h02_union_sources", S.query(S.POSITIONS, FLEET, SOURCES, "select imo, name, source from uni"))
def union_sources(t: Tables):
    return fleet.union_sources(*_sources(t)).select("imo", "name", "source")


@register("c29_record_hash", S.query(S.POSITIONS, FLEET, SOURCES, f"select imo, {_HASH} as hash from uni"))
def record_hash(t: Tables):
    u = fleet.union_sources(*_sources(t))
    return u.select("imo", ais.record_hash("imo", "name", F.col("sanctions")).alias("hash"))


_KNOWN = f"known as (select {_HASH} as hash from uni where source = 'local')"


@register("d07_not_yet_published", S.query(S.POSITIONS, FLEET, SOURCES, _KNOWN, f"select imo, name, source from uni where {_HASH} not in (select hash from known)"))
def not_yet_published(t: Tables):
    u = fleet.union_sources(*_sources(t))
    known = u.where("source = 'local'").select(ais.record_hash("imo", "name", F.col("sanctions")).alias("hash"))
    return fleet.not_yet_published(u, known).select("imo", "name", "source")


@register(
    "j16_refresh_sanctions",
    S.query(S.POSITIONS, FLEET, SOURCES, _KNOWN,
            f"select imo as imo_number, name as vessel_name, source, 'SANCTIONED_VESSEL' as record_type from uni where {_HASH} not in (select hash from known)"),
)
def refresh_sanctions(t: Tables):
    u = fleet.union_sources(*_sources(t))
    known = u.where("source = 'local'").select(ais.record_hash("imo", "name", F.col("sanctions")).alias("hash"))
    records, _ = fleet.refresh_sanctions(_sources(t), known)
    return records.select("imo_number", "vessel_name", "source", "record_type")


@register(
    "d08_merge_vessels",
    S.query(
        S.POSITIONS, FLEET,
        """a as (select imo, name, case when name like 'NAME %' then ['TT'] else ['EU'] end as s from vs where length(imo) = 7),
b as (select imo, name from vs)""",
        """select coalesce(a.imo, b.imo) as imo, coalesce(a.name, b.name) as name, case when a.imo is null then 'high' else 'critical' end as risk_level,
  case when a.imo is null then 'TT' when b.imo is not null and not list_contains(s, 'TT') then 'EU,TT' else array_to_string(s, ',') end as sanctions,
  case when a.imo is null then 'added' when b.imo is not null and not list_contains(s, 'TT') then 'updated' end as change
  from a full join b on a.imo = b.imo""",
    ),
)
def merge_vessels(t: Tables):
    v = _vessels(t)
    have = v.where("length(imo) = 7").select(
        "imo", "name", F.lit("RU").alias("flag"), F.lit("tanker").alias("type"),
        F.array(F.when(F.col("name").startswith("NAME "), "TT").otherwise("EU")).alias("sanctions"), F.lit("critical").alias("risk_level"), F.lit("").alias("notes"),
    )
    found = v.select("imo", "name", F.lit("").alias("flag"))
    return fleet.merge_vessels(have, found, "2024-01-01").select("imo", "name", "risk_level", F.array_join("sanctions", ",").alias("sanctions"), "change")


@register(
    "a21_extract_sanction_rows",
    "select page_id, '9' || lpad(page_id::varchar, 6, '0') as imo, case page_id % 3 when 0 then 'TANKER ' || page_id when 1 then 'OCEAN STAR' else 'JSON ' || page_id end as name, "
    "case page_id % 3 when 0 then 'RU' else '' end as flag from pages",
)
def extract_sanction_rows(t: Tables):
    """Vessel lists put into the given pages in the three forms the extraction knows."""
    pid = F.col("page_id").cast("string")
    imo = F.concat(F.lit("9"), F.lpad(pid, 6, "0"))
    table = F.format_string("<table><tr><th>Name</th></tr><tr><td><b>TANKER %s</b></td><td>%s</td><td> RU </td></tr></table>", pid, imo)
    text = F.format_string("<p>1. OCEAN STAR (IMO %s)</p>", imo)
    script = F.format_string('<script>var v = {"imo": "%s", "vessel": "JSON %s"};</script>', imo, pid)
    added = F.when(F.col("page_id") % 3 == 0, table).when(F.col("page_id") % 3 == 1, text).otherwise(script)
    pages = t.table("pages").withColumn("html", F.concat(added, F.col("html")))
    return fleet.extract_sanction_rows(pages)


# By the last digits of the number: 0 names it in the id list, 1 and 2 in the remarks (seven digits are read), 3 nowhere.
@register(
    "a22_extract_ofac_vessels",
    S.query(
        S.POSITIONS, FLEET,
        """select case when right(imo, 3)::int % 4 = 0 then imo else left(imo, 7) end as imo, coalesce(name, '') as name, 'OFAC SDN ID: ' || imo as notes
  from vs where right(imo, 3)::int % 4 <> 3""",
    ),
)
def extract_ofac_vessels(t: Tables):
    v = _vessels(t)
    m = F.substring("imo", -3, 3).cast("int") % 4
    by_id = F.when(m == 0, F.array(F.struct(F.lit("Vessel Registration IMO").alias("idType"), F.col("imo").alias("idNumber"))))
    entry = F.struct(
        F.col("imo").alias("uid"), F.lit("Vessel").alias("sdnType"), F.col("name").alias("lastName"),
        F.when(m.isin(1, 2), F.concat(F.lit("Linked; vessel imo: "), "imo")).otherwise("none").alias("remarks"), by_id.alias("idList"),
    )
    person = F.struct(
        F.lit("0").alias("uid"), F.lit("Individual").alias("sdnType"), F.lit("X").alias("lastName"),
        F.concat(F.lit("IMO "), "imo").alias("remarks"), F.lit(None).cast("array<struct<idType:string,idNumber:string>>").alias("idList"),
    )
    docs = v.select(F.to_json(F.struct(F.array(entry, person).alias("sdnList"))).alias("value"))
    return fleet.extract_ofac_vessels(docs).select("imo", "name", "notes")


# ---------------------------------------------------------------- functions

_B = ("latitude", "longitude", "57.5e0", "21.25e0")


@register(
    "c01_geo_functions",
    S.query(
        S.POSITIONS,
        f"""select row_id, round({S.hav(*_B)}, 6) as nm, round({S.hav_m(*_B)}, 3) as m,
  round((degrees(atan2(sin(radians(21.25e0 - longitude)) * cos(radians(57.5e0)), cos(radians(latitude)) * sin(radians(57.5e0)) - sin(radians(latitude)) * cos(radians(57.5e0)) * cos(radians(21.25e0 - longitude)))) + 360) % 360, 6) as brg,
  cast(floor(latitude / 0.1) as int) as cell_lat, cast(floor(longitude / 0.1) as int) as cell_lon,
  latitude < 54.5 or latitude > 65.5 or longitude < 9.5 or longitude > 30.5 as at_edge,
  round(latitude - 5 / 60.0, 6) as box_south, round(longitude + 5 / (60.0 * cos(radians(latitude))), 6) as box_east,
  case when abs(heading - course_over_ground) > 180 then 360 - abs(heading - course_over_ground) else abs(heading - course_over_ground) end as turn from p""",
    ),
)
def geo_functions(t: Tables):
    b = ("latitude", "longitude", F.lit(57.5), F.lit(21.25))
    cell = geo.grid_cell("latitude", "longitude")
    box = geo.bbox_around("latitude", "longitude", 5)
    return t.positions.select(
        "row_id", r6(geo.haversine_nm(*b), "nm"), F.round(geo.haversine_m(*b), 3).alias("m"), r6(geo.bearing(*b), "brg"),
        cell[0].alias("cell_lat"), cell[1].alias("cell_lon"), geo.at_area_edge("latitude", "longitude").alias("at_edge"),
        r6(box["min_lat"], "box_south"), r6(box["max_lon"], "box_east"), geo.course_diff("heading", "course_over_ground").alias("turn"),
    )


@register(
    "c13_path_points",
    S.query(
        S.POSITIONS,
        """q as (select row_id, m / 5 as i, latitude as la, longitude as lo, course_over_ground as c, speed_over_ground * (m / 60.0) / 3440.065 as d from p, range(0, 46, 5) g(m)
   where speed_over_ground is not null),
w as (select *, asin(sin(radians(la)) * cos(d) + cos(radians(la)) * sin(d) * cos(radians(c))) as p2 from q)""",
        """select row_id, cast(i as int) as i, round(degrees(p2), 5) as lat,
  round(degrees(radians(lo) + atan2(sin(radians(c)) * sin(d) * cos(radians(la)), cos(d) - sin(radians(la)) * sin(p2))), 5) as lon from w""",
    ),
)
def path_points(t: Tables):
    moving = t.positions.where("speed_over_ground is not null")
    path = geo.path_points("latitude", "longitude", "course_over_ground", "speed_over_ground")
    return moving.select("row_id", F.posexplode(path).alias("i", "p")).select(
        "row_id", "i", F.round("p.lat", 5).alias("lat"), F.round("p.lon", 5).alias("lon")
    )


@register(
    "c12_point_in_polygon",
    S.query(S.POSITIONS, S.zones(), S.inside(), "select row_id, zone_id from inz"),
)
def point_in_polygon(t: Tables):
    return in_zones(t.positions, t.zones, "zone_id").select("row_id", "zone_id")


@register(
    "c16_distance_to_places",
    S.query(
        S.POSITIONS, f"coast(la, lo) as (values {S.places(dims.COASTAL_POINTS)}), sea(la, lo) as (values {S.places(dims.OPEN_SEA_PORTS)}), berth(la, lo) as (values {S.places(dims.BALTIC_ANCHORAGES)})",
        f"""select row_id, round((select min({S.hav('latitude', 'longitude', 'la', 'lo')}) from coast), 5) as shore_nm,
  not exists (select 1 from sea where {S.hav('latitude', 'longitude', 'la', 'lo')} < 30) as open_sea,
  exists (select 1 from berth where {S.hav('latitude', 'longitude', 'la', 'lo')} < 2.5) as near_port from p""",
    ),
)
def distance_to_places(t: Tables):
    return t.positions.select(
        "row_id", F.round(geo.min_distance_nm("latitude", "longitude", dims.COASTAL_POINTS), 5).alias("shore_nm"),
        geo.is_open_sea("latitude", "longitude", dims.OPEN_SEA_PORTS, 30).alias("open_sea"),
        geo.near_any("latitude", "longitude", dims.BALTIC_ANCHORAGES, 2.5).alias("near_port"),
    )


_CAT = """case when ship_type is null or ship_type = 0 then 'unknown' when ship_type between 70 and 79 then 'cargo' when ship_type between 80 and 89 then 'tanker'
  when ship_type between 30 and 37 then 'fishing' when ship_type between 60 and 69 then 'passenger' when ship_type between 40 and 49 then 'highspeed'
  when ship_type between 50 and 59 then 'special' when ship_type between 20 and 29 then 'wing' else 'other' end"""
_TYPE = "case when ship_type between 70 and 79 then 'Cargo' when ship_type between 80 and 89 then 'Tanker' when ship_type between 60 and 69 then 'Passenger' " + " ".join(
    f"when ship_type = {k} then {S._text(v)}" for k, v in dims.SHIP_TYPE_NAMES.items()) + " else 'Unknown' end"
_NAV = "case " + " ".join(f"when nav_status = {k} then {S._text(v)}" for k, v in dims.NAV_STATUS_NAMES.items()) + " else 'Unknown' end"
_BUCKET = "case when speed_over_ground is null or speed_over_ground < 0.5 then 'stopped' when speed_over_ground < 3 then 'slow' when speed_over_ground < 15 then 'normal' when speed_over_ground < 999 then 'fast' end"


@register(
    "c17_ais_functions",
    S.query(
        S.POSITIONS,
        f"""select row_id, {_CAT} as category, {_TYPE} as type_name, {_NAV} as nav_name, {S.CABLE_FLAG} as cable_flag, {S.DISPLAY_FLAG} as display_flag,
  {S.INVESTIGATOR_FLAG} as investigator_flag, {S.SPOOFING_FLAG} as spoofing_flag,
  case when {S.INVESTIGATOR_FLAG} in {S.listed(dims.HIGH_RISK_FLAGS)} then 'HIGH RISK' when {S.INVESTIGATOR_FLAG} in {S.listed(dims.FLAGS_OF_CONVENIENCE)} then 'Flag of Convenience' else 'Standard' end as flag_category,
  case when length(mmsi) <> 9 then 'INVALID_LENGTH' when mmsi = '111111111' then 'SUSPICIOUS_PATTERN' when try_cast(substr(mmsi, 1, 3) as int) is null then 'NON_NUMERIC'
       when try_cast(substr(mmsi, 1, 3) as int) not between 200 and 799 then 'INVALID_MID' end as mmsi_problem,
  upper(trim(ship_name)) as name, case when heading is not null and heading <> 0 and heading <= 360 then heading else coalesce(course_over_ground, 0) end as shown_heading,
  {_BUCKET} as bucket, coalesce(speed_over_ground > 0.5, false) as moving from p""",
    ),
)
def ais_functions(t: Tables):
    return t.positions.select(
        "row_id", ais.vessel_category("ship_type").alias("category"), ais.vessel_type_name("ship_type").alias("type_name"),
        ais.nav_status_name("nav_status").alias("nav_name"), ais.flag_state("mmsi", "cable").alias("cable_flag"),
        ais.flag_state("mmsi", "display").alias("display_flag"), ais.flag_state("mmsi", "investigator").alias("investigator_flag"),
        ais.flag_state("mmsi", "spoofing").alias("spoofing_flag"),
        ais.flag_category(ais.flag_state("mmsi", "investigator")).alias("flag_category"), ais.mmsi_check("mmsi")["problem"].alias("mmsi_problem"),
        ais.normalize_name("ship_name").alias("name"), ais.effective_heading().alias("shown_heading"),
        ais.speed_bucket("speed_over_ground").alias("bucket"), ais.is_moving("speed_over_ground").alias("moving"),
    )


@register(
    "c32_display_text",
    S.query(
        S.POSITIONS,
        """select row_id, cast(cast(abs(latitude) as decimal(12, 4)) as varchar) || '° N, ' || cast(cast(abs(longitude) as decimal(12, 4)) as varchar) || '° E' as place,
  case when speed_over_ground is null then 'N/A' else cast(cast(speed_over_ground as decimal(12, 1)) as varchar) || ' kts' end as speed,
  case when course_over_ground is null then 'N/A' else cast(floor(course_over_ground + 0.5) as bigint)::varchar || '°' end as course from p""",
    ),
)
def display_text(t: Tables):
    return t.positions.select(
        "row_id", ais.format_coordinates(F.round("latitude", 4), F.round("longitude", 4)).alias("place"), ais.format_speed("speed_over_ground").alias("speed"),
        ais.format_course("course_over_ground").alias("course"),
    )


@register(
    "c26_zone_rules",
    "select event_type, event_id, case event_id % 5 when 0 then 'HIGH' when 1 then 'MEDIUM' when 2 then 'CRITICAL' when 3 then 'HIGH' else 'LOW' end as severity, "
    "event_id % 5 in (2, 3) as alert_all, case event_id % 5 when 0 then 8 when 4 then null else 0 end as listed_types from events",
)
def zone_rules(t: Tables):
    names = F.array(*[F.lit(n) for n in ("Baltic_MPA_2024", "some-eez", "sanctioned", "Restricted-1", "cables")])
    kind = ais.zone_type_from_filename(F.get(names, (F.col("event_id") % 5).cast("int")))
    rule = ais.zone_rules("kind")
    return t.table("events").withColumn("kind", kind).select(
        "event_type", "event_id", rule["severity"].alias("severity"), rule["alert_all_vessels"].alias("alert_all"),
        F.when(rule["alert_vessel_types"].isNotNull(), F.size(rule["alert_vessel_types"])).alias("listed_types"),
    )


# ---------------------------------------------------------------- ordered functions

@register(
    "f02_first_and_known",
    S.query(
        S.POSITIONS,
        """select row_id, first_value(case when imo_number <> '0' then imo_number end ignore nulls) over w as first_imo,
  last_value(speed_over_ground ignore nulls) over w as last_speed, row_number() over w as n from p window w as (partition by mmsi order by t_s, row_id)""",
    ),
)
def first_and_known(t: Tables):
    from harborlight.operators.history import running_sum

    out = with_history(
        t.positions, first_seen("first_imo", ais.known_text("imo_number", "0")), last_seen("last_speed", F.col("speed_over_ground")),
        running_sum("n", F.lit(1).cast("long")),
    )
    return out.select("row_id", "first_imo", "last_speed", "n")


@register(
    "f06_last_20",
    S.query(
        S.POSITIONS, "o as (select *, row_number() over (partition by mmsi order by t_s, row_id) as n from p)",
        "select a.row_id, string_agg(b.row_id, ',' order by b.n) as last_rows from o a join o b on a.mmsi = b.mmsi and b.n between a.n - 19 and a.n group by a.row_id",
    ),
)
def last_20(t: Tables):
    out = with_last_rows(t.positions, "last", 20, "row_id")
    return out.select("row_id", F.array_join(F.transform("last", lambda x: x["row_id"].cast("string")), ",").alias("last_rows"))


@register(
    "f13_enrich_static",
    S.query(
        S.POSITIONS,
        "o as (select *, last_value(ship_type ignore nulls) over w as ty, last_value(case when imo_number <> '' then imo_number end ignore nulls) over w as im from p window w as (partition by mmsi order by t_s, row_id))",
        "select row_id, ty as ship_type, im as imo_number from o where speed_over_ground is not null",
    ),
)
def enrich_static(t: Tables):
    return state.enrich_static(t.positions).select("row_id", "ship_type", "imo_number")


THIN = """o as materialized (select row_id, mmsi, t_s, latitude, longitude, row_number() over (partition by mmsi order by t_s, row_id) as n from p),
th(mmsi, n, la, lo, kept) as (select mmsi, n, latitude, longitude, true from o where n = 1
  union all select o.mmsi, o.n, case when abs(latitude - la) > 0.0001 or abs(longitude - lo) > 0.0001 then latitude else la end,
    case when abs(latitude - la) > 0.0001 or abs(longitude - lo) > 0.0001 then longitude else lo end, abs(latitude - la) > 0.0001 or abs(longitude - lo) > 0.0001
  from th join o on o.mmsi = th.mmsi and o.n = th.n + 1),
kept as materialized (select o.*, row_number() over (partition by o.mmsi order by o.n desc) as back from th join o on o.mmsi = th.mmsi and o.n = th.n where kept)"""


@register("f12_thin_track", S.query(S.POSITIONS, THIN, "select row_id, mmsi from kept"))
def thin(t: Tables):
    return thin_track(t.positions).select("row_id", "mmsi")


TRAILS = "tra as materialized (select mmsi, count(*) as point_count, string_agg(longitude::varchar || ' ' || latitude::varchar, ',' order by n) as line from kept where back <= 30 group by mmsi having count(*) >= 2)"


def _trails(t: Tables):
    return serving.trails(t.positions, 30)


@register("g05_trails", S.query(S.POSITIONS, THIN, TRAILS, "select mmsi, cast(point_count as int) as point_count, line from tra"))
def trails(t: Tables):
    line = F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ",")
    return _trails(t).select("mmsi", "point_count", line.alias("line"))


@register(
    "b11_trail_horizon",
    S.query(S.POSITIONS, THIN, f"select mmsi, cast(count(*) as int) as point_count, min(t_s) as first_s from kept where back <= 30 and t_s >= {NOW} - 3600 group by mmsi having count(*) >= 2"),
)
def trail_horizon(t: Tables):
    out = serving.trail_horizon(_trails(t), 1, NOW)
    return out.select("mmsi", "point_count", F.get("points", F.lit(0))["t_s"].alias("first_s"))


@register(
    "d09_trails_with_vessel",
    S.query(S.POSITIONS, THIN, TRAILS, CUR, "select mmsi, cast(point_count as int) as point_count, coalesce(ship_name, '') as ship_name, coalesce(ship_type, 0) as ship_type from tra left join cur using (mmsi)"),
)
def trails_with_vessel(t: Tables):
    return serving.trails_with_vessel(_trails(t), cur(t)).drop("points")


# ---------------------------------------------------------------- current vessels

@register("g01_current_positions", S.query(S.POSITIONS, CUR, "select row_id, mmsi, t_s, latitude, longitude from cur"))
def current_positions(t: Tables):
    return cur(t).select("row_id", "mmsi", "t_s", "latitude", "longitude")


@register(
    "b01_vessels_minimal",
    S.query(S.POSITIONS, CUR, f"select mmsi, latitude, longitude, heading, speed_over_ground as speed, ship_name, ship_type, {S.DISPLAY_FLAG} as flag, t_s as timestamp_s from cur"),
)
def vessels_minimal(t: Tables):
    return serving.vessels_minimal(cur(t))


_CUR_FILTERS = {
    "b02_vessels_in_bbox": ("latitude between 55 and 58 and longitude between 18 and 21", lambda c: serving.vessels_in_bbox(c, (55, 18, 58, 21))),
    "b03_vessel_by_mmsi": ("mmsi = '230000010'", lambda c: serving.vessel_by_mmsi(c, "230000010")),
    "b04_search_vessels": (
        f"contains(lower(ship_name), 'el 1') or contains(lower(mmsi), 'el 1') or contains(lower({S.DISPLAY_FLAG}), 'el 1') or contains(ship_type::varchar, 'el 1')",
        lambda c: serving.search_vessels(c, "EL 1"),
    ),
    "b06_filter_by_category": (
        f"case when ({_CAT}) = 'unknown' then 'other' else ({_CAT}) end in ('tanker', 'fishing', 'other')",
        lambda c: serving.filter_by_category(c, ["tanker", "fishing", "other"]),
    ),
    "b07_filter_by_speed": (f"({_BUCKET}) in ('stopped', 'normal')", lambda c: serving.filter_by_speed_bucket(c, ["stopped", "normal"])),
    "b08_flagged_only": (f"substr(mmsi, 1, 3) in {S.listed(dims.MONITORED_MIDS)}", serving.flagged_only),
}


def _register_filters() -> None:
    for name, (test, fn) in _CUR_FILTERS.items():
        register(name, S.query(S.POSITIONS, CUR, f"select row_id, mmsi from cur where {test}"))(
            lambda t, fn=fn: fn(cur(t)).select("row_id", "mmsi")
        )


_register_filters()


@register(
    "g04_active_vessels",
    S.query(
        S.POSITIONS, CUR,
        f"fresh as (select *, row_number() over (order by t_s, mmsi) as n, count(*) over () as c from cur where t_s >= {NOW} - 21600)",
        "select mmsi, t_s from fresh where n > case when c > 50 then c - 50 + 10 else 0 end",
    ),
)
def active_vessels(t: Tables):
    return serving.active_vessels(cur(t), NOW, most=50, spare=10).select("mmsi", "t_s")


@register(
    "i08_position_changes",
    S.query(
        S.POSITIONS, "o as (select *, lag(latitude) over w as pla, lag(longitude) over w as plo, lag(row_id) over w as pr from p window w as (partition by mmsi order by t_s, row_id))",
        "select row_id, mmsi from o where pr is null or pla <> latitude or plo <> longitude",
    ),
)
def position_changes(t: Tables):
    return serving.position_changes(t.positions).select("row_id", "mmsi")


@register(
    "e13_message_rate",
    S.query(
        S.POSITIONS, "o as (select *, lag(latitude) over w as pla, lag(longitude) over w as plo, lag(row_id) over w as pr from p window w as (partition by mmsi order by t_s, row_id))",
        "select t_s + d as until_s, count(*) as changes, count(*) / 5.0::double as per_second from o, range(1, 6) g(d) where pr is null or pla <> latitude or plo <> longitude group by 1",
    ),
)
def message_rate(t: Tables):
    return serving.message_rate(t.positions)


# ---------------------------------------------------------------- zones

@register(
    "b13_reports_by_infrastructure",
    S.query(
        S.POSITIONS, S.zones(), S.inside(),
        "select infrastructure_type, count(*) as reports, count(distinct zone_id) as zones from inz join z using (zone_id) where infrastructure_type in ('telecommunications', 'gas_pipeline') group by 1",
    ),
)
def reports_by_infrastructure(t: Tables):
    zones = serving.infrastructure_by_type(t.zones, ["telecommunications", "gas_pipeline"])
    hits = in_zones(t.positions, zones, "zone_id", "infrastructure_type")
    return hits.groupBy("infrastructure_type").agg(F.count("*").alias("reports"), F.countDistinct("zone_id").alias("zones"))


@register(
    "b14_zone_list_with_reports",
    S.query(
        S.POSITIONS, S.zones(), S.inside(),
        "select z.zone_id, zone_name, infrastructure_type, severity, count(inz.row_id) as reports from z left join inz using (zone_id) group by all",
    ),
)
def zone_list(t: Tables):
    from harborlight.plans.investigate import list_zones

    counts = in_zones(t.positions, t.zones, "zone_id").groupBy("zone_id").agg(F.count("*").alias("reports"))
    return list_zones(t.zones).join(counts, "zone_id", "left").fillna({"reports": 0})


# ---------------------------------------------------------------- alerts and incidents

_SHOW = "alert_id, alert_type, severity, mmsi, title"


def _show(df):
    return df.select("alert_id", "alert_type", "severity", "mmsi", "title")


@register("h01_all_alerts", S.query(S.POSITIONS, *ALERTS_CTE, f"select {_SHOW} from alerts"))
def all_alerts(t: Tables):
    return _show(all_detector_alerts(t))


@register(
    "b05_filter_alerts",
    S.query(S.POSITIONS, *ALERTS_CTE, f"select {_SHOW} from alerts where severity in ('HIGH', 'CRITICAL') and alert_type in ('CABLE_PROXIMITY', 'DARK_EVENT') and (contains(lower(title), 'cable') or contains(lower(vessel_name), 'cable') or contains(mmsi, 'cable'))"),
)
def filter_alerts(t: Tables):
    # The search also looks at descriptions; this word is in a title whenever it is in one.
    out = serving.filter_alerts(all_detector_alerts(t), ["HIGH", "CRITICAL"], ["CABLE_PROXIMITY", "DARK_EVENT"], "Cable")
    return _show(out)


@register("g02_recent_alerts", S.query(S.POSITIONS, *ALERTS_CTE, f"select {_SHOW} from alerts order by t_s desc, alert_id limit 250"))
def recent_alerts(t: Tables):
    return _show(serving.recent_alerts(all_detector_alerts(t)))


@register(
    "g09_top_alerts_per_vessel",
    S.query(S.POSITIONS, *ALERTS_CTE, f"select {_SHOW} from (select *, row_number() over (partition by mmsi order by t_s desc, alert_id) as n from alerts) where n <= 5"),
)
def top_alerts(t: Tables):
    return _show(serving.top_alerts_per_vessel(all_detector_alerts(t)))


@register(
    "e01_alert_stats",
    S.query(S.POSITIONS, *ALERTS_CTE,
            "select 'severity' as dimension, severity as value, count(*) as alerts from alerts group by 2 union all select 'alert_type', alert_type, count(*) from alerts group by 2 union all select 'total', 'all', count(*) from alerts"),
)
def alert_stats(t: Tables):
    return serving.alert_stats(all_detector_alerts(t))


@register("d06_vessels_with_alerts", S.query(S.POSITIONS, *ALERTS_CTE, CUR, "select row_id, mmsi from cur where mmsi in (select mmsi from alerts)"))
def vessels_with_alerts(t: Tables):
    return serving.with_alerts_only(cur(t), all_detector_alerts(t)).select("row_id", "mmsi")


@register("c30_severity_rank", S.query(S.POSITIONS, *ALERTS_CTE, "select mmsi, max(case severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end) as worst from alerts group by 1"))
def severity_rank(t: Tables):
    return all_detector_alerts(t).groupBy("mmsi").agg(F.max(alerts.severity_rank("severity")).alias("worst"))


def _incidents(t: Tables):
    return written(incidents.correlate_incidents(all_detector_alerts(t)), "incidents")


@register(
    "g03_incidents_ranked",
    S.query(S.POSITIONS, *INCIDENT_CTE, "select id, mmsi, severity, risk_score from inc order by case severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end desc, last_s desc, id limit 50"),
)
def incidents_ranked(t: Tables):
    return incidents.ranked(_incidents(t)).select("id", "mmsi", "severity", "risk_score")


@register("b10_filter_incidents", S.query(S.POSITIONS, *INCIDENT_CTE, "select id, mmsi from inc where severity = 'HIGH'"))
def filter_incidents(t: Tables):
    return incidents.filter_incidents(_incidents(t), "high", "active").select("id", "mmsi")


@register(
    "g07_retained_incidents",
    S.query(S.POSITIONS, *INCIDENT_CTE, "select id, mmsi from inc order by last_s desc, id limit 40"),
)
def retained_incidents(t: Tables):
    return incidents.retained(_incidents(t), F.timestamp_seconds(F.lit(NOW)), most=40).select("id", "mmsi")


@register(
    "g06_incident_alerts",
    S.query(
        S.POSITIONS, *INCIDENT_CTE,
        "b as (select mmsi, session, alert_id, t_s, row_number() over (partition by mmsi, session order by t_s desc, alert_id desc) as n from ses)",
        "select inc.id, string_agg(alert_id, ',' order by t_s, alert_id) as alert_ids from b join inc using (mmsi, session) where n <= 30 group by inc.id, mmsi",
    ),
)
def incident_shown_alerts(t: Tables):
    return _incidents(t).select("id", F.array_join(F.transform("alerts", lambda a: a["alert_id"]), ",").alias("alert_ids"))


@register("g06_incident_all_alerts", S.query(S.POSITIONS, *INCIDENT_CTE, "select inc.id as incident_id, alert_id from ses join inc using (mmsi, session)"))
def incident_all_alerts(t: Tables):
    return incidents.incident_alerts(all_detector_alerts(t)).select("incident_id", "alert_id")


@register(
    "j14_vessel_incidents",
    S.query(S.POSITIONS, *INCIDENT_CTE, "select id, severity, alert_count, risk_score from inc where mmsi = (select max(mmsi) from inc)"),
)
def vessel_incidents(t: Tables):
    inc = _incidents(t)
    return incidents.vessel_incidents(inc, inc.agg(F.max("mmsi")).scalar()).select("id", "severity", "alert_count", "risk_score")


@register("d09_alert_incident_ids", S.query(S.POSITIONS, *INCIDENT_CTE, "select alert_id, inc.id as incident_id from ses join inc using (mmsi, session)"))
def alert_incident_ids(t: Tables):
    a = all_detector_alerts(t)
    out = serving.alerts_with_incident(incidents.with_sessions(a), incidents.correlate_incidents(a))
    return out.select("alert_id", "incident_id")


@register(
    "j14_incident_detail",
    S.query(S.POSITIONS, *INCIDENT_CTE, CUR, "select id, inc.mmsi, severity, cur.row_id as vessel_row from inc left join cur using (mmsi) where id = (select min(id) from inc)"),
)
def incident_detail(t: Tables):
    inc = _incidents(t)
    found = incidents.incident_detail(inc, cur(t), inc.agg(F.min("id")).scalar())
    return found.select("id", "mmsi", "severity", F.col("vessel.row_id").alias("vessel_row"))


@register(
    "e02_system_stats",
    S.query(S.POSITIONS, *INCIDENT_CTE, CUR,
            "select (select count(*) from cur) as total_vessels, (select count(*) from alerts) as total_alerts, (select count(*) from inc) as total_incidents, (select count(*) from inc) as active_incidents"),
)
def system_stats(t: Tables):
    a = all_detector_alerts(t)
    return serving.system_stats(cur(t), a, written(incidents.correlate_incidents(a), "incidents"))


@register(
    "e03_storage_stats",
    S.query(S.POSITIONS, *INCIDENT_CTE, THIN, TRAILS,
            "select (select count(*) from tra) as trail_vessels, (select cast(sum(point_count) as bigint) from tra) as trail_points, (select count(*) from inc) as incidents, (select cast(sum(alert_count) as bigint) from inc) as incident_alerts, (select count(*) from inc) as active, 0::bigint as resolved"),
)
def storage_stats(t: Tables):
    return serving.storage_stats(_trails(t), _incidents(t))
