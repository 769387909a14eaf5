"""Detector queries. Each returns typed columns; the alert layout itself is covered by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks.registry import SQL, Tables, register
from harborlight import dims
from harborlight.functions import ais
from harborlight.operators.throttle import throttle
from harborlight.plans import (
    anchor, cable, convoy, dark, fishing, geofence, incidents, investigate, loitering, rendezvous, risk,
    pipeline, sanctions_match, spoofing, state, trajectory,
)
from harborlight.session import written
from harborlight.sources.reference import latest_sanctions

FISHING = "coalesce(ship_type, -1) between 30 and 37"
TANKER = "coalesce(ship_type, -1) between 80 and 89"
CARGO = "coalesce(ship_type, -1) between 70 and 79"


def r4(c: str):
    return F.round(F.col(c), 4).alias(c)


# ---------------------------------------------------------------- vessel state

INTERVALS = """ord as materialized (
  select *, row_number() over w as n, t_s - lag(t_s) over w as gap, lead(t_s) over w as next_t,
         last_value(ship_type ignore nulls) over w as type_known,
         last_value(imo_number ignore nulls) over w as imo_known,
         last_value(ship_name ignore nulls) over w as name_known
  from p window w as (partition by mmsi order by t_s, row_id)),
mean(mmsi, n, avg_s) as (
  select mmsi, n, 0e0 from ord where n = 1
  union all
  select o.mmsi, o.n, case when o.gap > 0 then (m.avg_s * m.n + o.gap) / (m.n + 1) else m.avg_s end
  from mean m join ord o on o.mmsi = m.mmsi and o.n = m.n + 1)"""


@register(
    "j00_vessel_state",
    S.query(
        S.POSITIONS,
        INTERVALS,
        """last as (select o.*, m.avg_s, row_number() over (partition by o.mmsi order by o.n desc) as back
  from ord o join mean m on m.mmsi = o.mmsi and m.n = o.n)""",
        """select mmsi, type_known as ship_type, imo_known as imo_number, name_known as ship_name,
  latitude as last_latitude, longitude as last_longitude, speed_over_ground as last_speed,
  course_over_ground as last_course, (select min(t_s) from p where p.mmsi = last.mmsi) as first_seen,
  t_s as last_seen, n as message_count, round(avg_s, 4) as avg_interval_s,
  (select string_agg(b.row_id, ',' order by b.n) from last b where b.mmsi = last.mmsi and b.back <= 20) as recent
  from last where back = 1""",
    ),
)
def vessel_state(t: Tables):
    out = state.vessel_state(t.positions)
    recent = F.array_join(F.transform("recent_positions", lambda p: p["row_id"].cast("string")), ",")
    return out.withColumn("recent", recent).withColumn("avg_interval_s", F.round("avg_interval_s", 4)).drop("recent_positions")


# ---------------------------------------------------------------- geofence

GEOFENCE_CTE = [
    S.inside(),
    f"""geo as (select p.*, z.zone_id, z.zone_name, z.zone_type,
  case when zone_type = 'sanctioned_waters' or (zone_type = 'MPA' and {FISHING}) then 'CRITICAL' else 'HIGH' end as severity
  from inz join p using (row_id) join z using (zone_id)
  where case when zone_type in ('sanctioned_waters', 'restricted') then true
             when zone_type = 'MPA' then {FISHING} or alert_all
             when zone_type = 'EEZ' then {FISHING} else alert_all end)""",
]


@register(
    "j01_geofence",
    S.query(
        S.POSITIONS, S.zones(), *GEOFENCE_CTE,
        "select row_id, mmsi, t_s, zone_id, zone_type, severity, concat('Geofence Violation: ', zone_name) as title, "
        "speed_over_ground, course_over_ground from geo",
    ),
)
def geofence_(t: Tables):
    return geofence.geofence_events(t.positions, t.zones).select(
        "row_id", "mmsi", "t_s", "zone_id", "zone_type", "severity", "title", "speed_over_ground", "course_over_ground"
    )


@register(
    "j01_geofence_entries",
    S.query(
        S.POSITIONS, S.zones(), *GEOFENCE_CTE,
        "seq as (select row_id, lag(row_id) over (partition by mmsi order by t_s, row_id) as prev from p)",
        "select row_id, mmsi, t_s, zone_id from geo join seq using (row_id) "
        "where not exists (select 1 from geo g where g.row_id = seq.prev and g.zone_id = geo.zone_id)",
    ),
)
def geofence_entries(t: Tables):
    return geofence.geofence_events(t.positions, t.zones, on_entry_only=True).select("row_id", "mmsi", "t_s", "zone_id")


# ---------------------------------------------------------------- dark

DARK_FROM = """dark as (select o.*, m.avg_s, cast(floor((coalesce(next_t, {as_of}) - t_s) / 60) as bigint) as gap_minutes
  from ord o join mean m on m.mmsi = o.mmsi and m.n = o.n),
gone as (select * from dark where gap_minutes >= 30 and n >= 5 and (speed_over_ground is null or speed_over_ground >= 0.5)
  and not (coalesce(type_known, -1) between 36 and 37 or coalesce(type_known, -1) between 60 and 69)
  and not (avg_s > 0 and gap_minutes * 60 < avg_s * 10))"""
DARK_SELECT = """select row_id, mmsi, t_s, gap_minutes, n as message_count, round(avg_s, 4) as avg_interval_s, name_known as ship_name,
  type_known as ship_type, speed_over_ground,
  case when gap_minutes > 1440 then 'HIGH' when gap_minutes > 360 or coalesce(type_known, -1) between 80 and 89 then 'MEDIUM' else 'LOW' end as severity
  from gone"""
DARK_COLUMNS = [
    "row_id", "mmsi", "t_s", "gap_minutes", "message_count", "avg_interval_s", "ship_name", "ship_type",
    "speed_over_ground", "severity",
]


@register("j02_gone_dark", S.query(S.POSITIONS, INTERVALS, DARK_FROM.format(as_of="null"), DARK_SELECT))
def gone_dark(t: Tables):
    out = dark.gone_dark_events(t.positions)
    return out.withColumn("avg_interval_s", F.round("avg_interval_s", 4)).select(*DARK_COLUMNS)


@register("j02_gone_dark_as_of", S.query(S.POSITIONS, INTERVALS, DARK_FROM.format(as_of="1704200000"), DARK_SELECT))
def gone_dark_as_of(t: Tables):
    out = dark.gone_dark_events(t.positions, as_of=1704200000)
    return out.withColumn("avg_interval_s", F.round("avg_interval_s", 4)).select(*DARK_COLUMNS)


APPEARED_CTE = [
    f"coast(la, lo) as (values {S.places(dims.COASTAL_POINTS)})",
    "f as (select * from (select *, row_number() over (partition by mmsi order by t_s, row_id) as n from p) where n = 1)",
    f"appeared as (select f.*, (select min({S.hav('f.latitude', 'f.longitude', 'la', 'lo')}) from coast) as shore_nm from f "
    "where not (latitude < 54.5 or latitude > 65.5 or longitude < 9.5 or longitude > 30.5))",
]


@register(
    "j03_appeared_dark",
    S.query(
        S.POSITIONS, *APPEARED_CTE,
        f"""select row_id, mmsi, t_s, round(shore_nm, 4) as shore_nm,
  case when {TANKER} or {CARGO} or shore_nm > 20 then 'HIGH' else 'MEDIUM' end as severity,
  concat('Dark AIS: ', coalesce(ship_name, mmsi), ' Appeared in Open Water') as title from appeared where shore_nm > 5""",
    ),
)
def appeared_dark(t: Tables):
    return dark.appeared_dark_events(t.positions).select("row_id", "mmsi", "t_s", r4("shore_nm"), "severity", "title")


# ---------------------------------------------------------------- rendezvous

TRACKED = """tracked as materialized (select *, lead(t_s) over w as nt, lead(row_id) over w as nr, row_number() over w as seq
  from p window w as (partition by mmsi order by t_s, row_id))"""
AS_OF = """a.mmsi <> b.mmsi and (b.t_s < a.t_s or (b.t_s = a.t_s and b.row_id < a.row_id))
  and (b.nt is null or b.nt > a.t_s or (b.nt = a.t_s and b.nr > a.row_id)) and a.t_s - b.t_s < 600"""
BUCKETS = "b.bk in (a.bk, a.bk - 1)"
MET = [
    f"ports(la, lo) as (values {S.places(dims.OPEN_SEA_PORTS)})",
    TRACKED,
    f"""able as materialized (select *, cast(floor(t_s / 600) as bigint) as bk,
  cast(floor(latitude / 0.1) as int) as cy, cast(floor(longitude / 0.1) as int) as cx from tracked
  where (speed_over_ground is null or speed_over_ground <= 5)
    and not exists (select 1 from ports where {S.hav('latitude', 'longitude', 'la', 'lo')} < 30))""",
    f"""seen as materialized (select least(a.mmsi, b.mmsi) as lo, greatest(a.mmsi, b.mmsi) as hi, a.t_s, a.row_id, a.mmsi, b.mmsi as other,
   a.ship_type as t1, b.ship_type as t2, {S.hav_m('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} as dist
  from able a join able b on {BUCKETS} and abs(a.cy - b.cy) <= 1 and abs(a.cx - b.cx) <= 1 and {AS_OF}),
marked as (select *, dist <= 1500 as near, lag(dist <= 1500) over w as near_before, lag(t_s) over w as t_before
  from seen window w as (partition by lo, hi order by t_s, row_id)),
isl as materialized (select *, sum(case when near_before is null or not near_before or t_s - t_before > 7200 then 1 else 0 end)
  over (partition by lo, hi order by t_s, row_id) as enc from marked where near),
timed as (select *, min(t_s) over (partition by lo, hi, enc) as started_s,
  avg(dist) over (partition by lo, hi, enc order by t_s, row_id) as mean_m,
  count(*) over (partition by lo, hi, enc order by t_s, row_id) as n from isl),
quals as (select *, cast(floor((t_s - started_s) / 60) as bigint) as duration_minutes,
  coalesce(t1, -1) between 80 and 89 or coalesce(t2, -1) between 80 and 89 as tanker,
  (coalesce(t1, -1) between 70 and 79 or coalesce(t2, -1) between 70 and 79)
   and (coalesce(t1, -1) between 30 and 37 or coalesce(t2, -1) between 30 and 37) as mixed from timed),
rdv as (select *, row_number() over (partition by lo, hi, enc order by t_s, row_id) as k from quals
  where duration_minutes >= 3 and (tanker or mixed or duration_minutes >= 6))""",
]


@register(
    "j04_rendezvous",
    S.query(
        S.POSITIONS, *MET,
        "select lo, hi, row_id, t_s, mmsi, other as vessel2_mmsi, started_s, duration_minutes, round(mean_m, 3) as mean_distance_m, "
        "case when tanker then 'HIGH' else 'MEDIUM' end as severity from rdv where k = 1",
    ),
)
def rendezvous_(t: Tables):
    return rendezvous.rendezvous_events(t.positions).select(
        "lo", "hi", "row_id", "t_s", "mmsi", F.col("o_mmsi").alias("vessel2_mmsi"), "started_s", "duration_minutes",
        F.round("mean_distance_m", 3).alias("mean_distance_m"), "severity",
    )


@register(
    "e11_encounter_mean_distance",
    S.query(
        S.POSITIONS, *MET,
        "select lo, hi, started_s, count(*) as contacts, round(avg(dist), 3) as mean_distance_m from timed group by lo, hi, enc, started_s",
    ),
)
def encounter_mean(t: Tables):
    found = rendezvous.encounters(t.positions)
    return found.select("lo", "hi", "started_s", "contacts", F.round("mean_distance_m", 3).alias("mean_distance_m"))


# ---------------------------------------------------------------- fishing

FISHING_CTE = [
    "ord as materialized (select *, row_number() over (partition by mmsi order by t_s, row_id) as n from p)",
    f"""fr as (select a.row_id, b.n, b.speed_over_ground as s, b.course_over_ground as c, b.latitude as la, b.longitude as lo,
   lag(b.course_over_ground) over (partition by a.row_id order by b.n) as pc
  from ord a join ord b on a.mmsi = b.mmsi and b.n between a.n - 19 and a.n),
an0 as (select row_id, count(*) as positions_analyzed, coalesce(avg(s), 0) as avg_speed, coalesce(avg(s * s), 0) as sq,
   count(*) filter (where case when abs(c - pc) > 180 then 360 - abs(c - pc) else abs(c - pc) end > 30) as course_changes,
   min(la) as a1, max(la) as a2, min(lo) as o1, max(lo) as o2 from fr group by row_id having count(*) >= 10),
an1 as (select *, sq - avg_speed * avg_speed as speed_variance,
   {S.hav('a1', 'o1', 'a2', 'o1')} * {S.hav('a1', 'o1', 'a1', 'o2')} as area_nm2,
   course_changes * 60.0 / (positions_analyzed * 3) as turns_per_hour from an0),
an as materialized (select *, least(100, (case when avg_speed < 5 then 25 * (1 - avg_speed / 5) else 0 end) + least(25, speed_variance * 5)
   + least(25, turns_per_hour * 2.5) + (case when area_nm2 < 100 then 25 * (1 - area_nm2 / 100) else 0 end)) as confidence from an1
  where (case when avg_speed < 5 then 1 else 0 end) + (case when speed_variance > 2 then 1 else 0 end)
      + (case when turns_per_hour >= 10 then 1 else 0 end) + (case when area_nm2 < 100 then 1 else 0 end) >= 3)""",
]
FISHING_COLUMNS = ["avg_speed", "speed_variance", "course_changes", "positions_analyzed", "area_nm2", "turns_per_hour", "confidence"]


@register(
    "j05_fishing",
    S.query(
        S.POSITIONS, S.zones(), *FISHING_CTE, S.inside(where="z.zone_type in ('MPA', 'EEZ')"),
        f"""select row_id, mmsi, t_s, zone_id, round(avg_speed, 4) as avg_speed, round(speed_variance, 4) as speed_variance, course_changes,
  positions_analyzed, round(area_nm2, 4) as area_nm2, round(confidence, 4) as confidence,
  case when zone_type = 'MPA' and confidence > 80 then 'CRITICAL' when zone_type = 'MPA' or not {FISHING} then 'HIGH' else 'MEDIUM' end as severity,
  concat(case when {FISHING} then 'Fishing vessel' else 'Vessel' end, ' fishing in ', zone_name) as title
  from an join p using (row_id) join inz using (row_id) join z using (zone_id)
  where confidence >= 60 and (zone_type = 'MPA' or {FISHING})""",
    ),
)
def fishing_(t: Tables):
    return fishing.fishing_events(t.positions, t.zones).select(
        "row_id", "mmsi", "t_s", "zone_id", r4("avg_speed"), r4("speed_variance"), F.col("course_changes").cast("long").alias("course_changes"),
        F.col("positions_analyzed").cast("long").alias("positions_analyzed"), r4("area_nm2"), r4("confidence"), "severity", "title",
    )


@register(
    "e08_fishing_measures",
    S.query(
        S.POSITIONS, *FISHING_CTE,
        "select row_id, round(avg_speed, 4) as avg_speed, round(speed_variance, 4) as speed_variance, course_changes, positions_analyzed, "
        "round(area_nm2, 4) as area_nm2, round(turns_per_hour, 4) as turns_per_hour, round(confidence, 4) as confidence from an",
    ),
)
def fishing_measures(t: Tables):
    out = fishing.fishing_analysis(t.positions)
    whole = ("course_changes", "positions_analyzed")
    return out.select("row_id", *[F.col(c).cast("long").alias(c) if c in whole else r4(c) for c in FISHING_COLUMNS])


# ---------------------------------------------------------------- cable

CABLE_CTE = [
    f"berths(la, lo) as (values {S.places(dims.BALTIC_ANCHORAGES)})",
    S.inside(name="cab_in", where="z.zone_type = 'cable_protection'"),
    f"""cab_hit as (select p.*, z.zone_id, z.zone_name, coalesce(speed_over_ground, 0) as speed, {S.CABLE_FLAG} as flag
  from cab_in join p using (row_id) join z using (zone_id)),
cab_f as (select *, case when speed < 0.5 then 'STOPPED_IN_ZONE'
   when speed < 3 and flag in ('RU','CN','HK','IR') then 'FLAGGED_STATE_SLOW'
   when speed < 3 and coalesce(ship_type, -1) between 70 and 89 then 'HIGH_RISK_SHIP_SLOW'
   when speed < 3 then 'SLOW_IN_ZONE' when flag in ('RU','CN','HK','IR') then 'FLAGGED_STATE_TRANSIT'
   when coalesce(ship_type, -1) between 70 and 89 and speed < 8 then 'LARGE_VESSEL_TRANSIT' end as risk_factor from cab_hit),
cab as materialized (select *, case when risk_factor in ('STOPPED_IN_ZONE', 'FLAGGED_STATE_SLOW', 'HIGH_RISK_SHIP_SLOW') then 'CRITICAL'
   when risk_factor = 'SLOW_IN_ZONE' then 'HIGH' when risk_factor = 'FLAGGED_STATE_TRANSIT' then 'MEDIUM' else 'LOW' end as severity
  from cab_f where risk_factor is not null and not (speed < 3 and exists (
    select 1 from berths where abs(la - latitude) < 0.1 and {S.hav('latitude', 'longitude', 'la', 'lo')} < 2.5)))""",
    S.throttled("cab", "cab_kept", "mmsi || ':' || zone_id", 900),
]
CABLE_COLUMNS = ["row_id", "mmsi", "t_s", "zone_id", "risk_factor", "severity", "flag", "speed"]


@register("j06_cable_proximity", S.query(S.POSITIONS, S.zones(), *CABLE_CTE, f"select {', '.join(CABLE_COLUMNS)} from cab_kept"))
def cable_proximity(t: Tables):
    return cable.cable_events(t.positions, t.zones).select(*CABLE_COLUMNS)


@register("j06_cable_candidates", S.query(S.POSITIONS, S.zones(), *CABLE_CTE, f"select {', '.join(CABLE_COLUMNS)} from cab"))
def cable_candidates(t: Tables):
    return cable.cable_candidates(t.positions, t.zones).select(*CABLE_COLUMNS)


# ---------------------------------------------------------------- trajectory

_D = "(speed_over_ground * (m / 60.0) / 3440.065)"
_LAT2 = f"asin(sin(radians(latitude)) * cos({_D}) + cos(radians(latitude)) * sin({_D}) * cos(radians(course)))"
TRAJECTORY_CTE = [
    f"""mov as (select *, coalesce(course_over_ground, heading) as course from p
  where speed_over_ground >= 3 and coalesce(course_over_ground, heading) is not null),
pts as materialized (select row_id, cast(m / 5 as int) as i, case when m = 0 then latitude else degrees({_LAT2}) end as la,
   case when m = 0 then longitude else degrees(radians(longitude) + atan2(sin(radians(course)) * sin({_D}) * cos(radians(latitude)),
     cos({_D}) - sin(radians(latitude)) * sin({_LAT2}))) end as lo
  from mov, range(0, 46, 5) g(m)),
segs as materialized (select a.row_id, a.i, a.la as py, a.lo as px, b.la as qy, b.lo as qx from pts a join pts b on a.row_id = b.row_id and b.i = a.i + 1),
ts as (select row_id, zone_id, s.i, px, py, qx, qy,
   ((x1 - px) * (y2 - y1) - (y1 - py) * (x2 - x1)) / nullif((qx - px) * (y2 - y1) - (qy - py) * (x2 - x1), 0) as t,
   ((x1 - px) * (qy - py) - (y1 - py) * (qx - px)) / nullif((qx - px) * (y2 - y1) - (qy - py) * (x2 - x1), 0) as u
  from segs s join (select edges.* from edges join z using (zone_id) where zone_type = 'cable_protection') e
    on least(px, qx) <= greatest(x1, x2) and greatest(px, qx) >= least(x1, x2) and least(py, qy) <= greatest(y1, y2) and greatest(py, qy) >= least(y1, y2)),
hits as (select *, row_number() over (partition by row_id, zone_id order by i, t) as k from ts where t between 0 and 1 and u between 0 and 1)""",
    S.inside("mov", "tr_in", "z.zone_type = 'cable_protection'"),
    f"""near as materialized (select mov.*, zone_id, py + t * (qy - py) as entry_lat, px + t * (qx - px) as entry_lon
  from hits join mov using (row_id) where k = 1 and not exists (select 1 from tr_in where tr_in.row_id = hits.row_id and tr_in.zone_id = hits.zone_id)),
traj as materialized (select * from (select *, {S.hav('latitude', 'longitude', 'entry_lat', 'entry_lon')} / speed_over_ground * 60 as eta_minutes from near)
  where eta_minutes > 1 and eta_minutes <= 45)""",
    S.throttled("traj", "traj_kept", "mmsi || ':' || zone_id", 1800),
]


@register(
    "j07_trajectory",
    S.query(
        S.POSITIONS, S.zones(), *TRAJECTORY_CTE,
        "select row_id, mmsi, t_s, zone_id, course, round(entry_lat, 4) as entry_lat, round(entry_lon, 4) as entry_lon, "
        "round(eta_minutes, 3) as eta_minutes, case when eta_minutes < 15 then 'HIGH' when eta_minutes < 30 then 'MEDIUM' else 'LOW' end as severity "
        "from traj_kept",
    ),
)
def trajectory_(t: Tables):
    return trajectory.trajectory_events(t.positions, t.zones).select(
        "row_id", "mmsi", "t_s", "zone_id", "course", r4("entry_lat"), r4("entry_lon"),
        F.round("eta_minutes", 3).alias("eta_minutes"), "severity",
    )


@register(
    "d05_path_zone_hits",
    S.query(
        S.POSITIONS, S.zones(), *TRAJECTORY_CTE,
        "select row_id, zone_id, round(entry_lat, 4) as entry_lat, round(entry_lon, 4) as entry_lon from near",
    ),
)
def path_zone_hits(t: Tables):
    moving = t.positions.where("speed_over_ground >= 3")
    return trajectory.path_zone_hits(moving, t.zones).select("row_id", "zone_id", r4("entry_lat"), r4("entry_lon"))


# ---------------------------------------------------------------- loitering

LOITER_CTE = [
    f"""frm as materialized (select a.row_id, a.mmsi, a.t_s, b.t_s as bt, b.latitude as la, b.longitude as lo, b.speed_over_ground as s
  from p a join p b on a.mmsi = b.mmsi and b.t_s between a.t_s - 7200 and a.t_s and (b.t_s < a.t_s or b.row_id <= a.row_id)),
cen as (select row_id, avg(la) as cla, avg(lo) as clo from frm group by row_id),
lt as materialized (select row_id, mmsi, t_s, max({S.hav('cla', 'clo', 'la', 'lo')}) as radius_nm, cast(floor((t_s - min(bt)) / 60) as bigint) as loiter_minutes,
   count(*) as position_count, coalesce(avg(s), 0) as average_speed, any_value(cla) as center_lat, any_value(clo) as center_lon
  from frm join cen using (row_id) group by row_id, mmsi, t_s having count(*) >= 3),
loit as materialized (select * from lt where radius_nm <= 0.5 and loiter_minutes >= 45)""",
    S.throttled("loit", "loit_kept", "mmsi", 3600, strict=True),
]


def _loiter_select(source: str) -> str:
    return (
        "select row_id, mmsi, t_s, loiter_minutes, round(radius_nm, 6) as loiter_radius_nm, position_count, round(average_speed, 6) as average_speed, "
        f"round(center_lat, 6) as center_lat, round(center_lon, 6) as center_lon from {source}"
    )


def _loiter_columns(df):
    return df.select(
        "row_id", "mmsi", "t_s", "loiter_minutes", F.col("position_count").cast("long").alias("position_count"),
        *[F.round(c, 6).alias(c) for c in ("loiter_radius_nm", "average_speed", "center_lat", "center_lon")],
    )


@register("j08_loitering", S.query(S.POSITIONS, *LOITER_CTE, _loiter_select("loit_kept")))
def loitering_(t: Tables):
    return _loiter_columns(loitering.loitering_events(t.positions))


@register("f07_last_120_minutes", S.query(S.POSITIONS, *LOITER_CTE, _loiter_select("loit")))
def loitering_candidates(t: Tables):
    return _loiter_columns(loitering.loitering_candidates(t.positions))


# ---------------------------------------------------------------- spoofing

_KNOWN_MIDS = S.listed([m for m, _ in dims.mid_pairs("spoofing")])
_NUM = "try_cast(substr(mmsi, 1, 3) as int)"
_IMO = "case when imo_number <> '' and imo_number <> '0' then imo_number end"
_NAME = "case when ship_name <> '' and ship_name <> 'Unknown' then trim(upper(ship_name)) end"
SPOOF_CTE = [
    f"""sp as materialized (select *, lag(t_s) over w as pt, lag(latitude) over w as pla, lag(longitude) over w as plo,
   first_value({_IMO} ignore nulls) over w as first_imo, {_IMO} as imo_known, {_NAME} as nm
  from p window w as (partition by mmsi order by t_s, row_id)),
sj as materialized (select *, {S.hav('pla', 'plo', 'latitude', 'longitude')} as jump_nm, t_s - pt as jump_s from sp),
nmf as (select mmsi, nm, t_s, row_id, row_number() over (partition by mmsi order by t_s, row_id) as name_index from (
   select *, row_number() over (partition by mmsi, nm order by t_s, row_id) as k from sp where nm is not null) where k = 1),
fnd as materialized (
  select row_id, mmsi, t_s, 1 as rank, 'invalid_mmsi' as "check", 30 as points,
     case when length(mmsi) <> 9 then 'MEDIUM' when regexp_full_match(mmsi, '0{{9}}|9{{9}}') or mmsi in ('123456789', '111111111') then 'HIGH'
          when {_NUM} is null then 'HIGH' else 'MEDIUM' end as severity
   from sj where mmsi is null or length(mmsi) <> 9 or regexp_full_match(mmsi, '0{{9}}|9{{9}}') or mmsi in ('123456789', '111111111')
      or {_NUM} is null or {_NUM} not between 200 and 799
  union all select row_id, mmsi, t_s, 2, 'impossible_speed', 20, case when speed_over_ground > 100 then 'CRITICAL' else 'HIGH' end
   from sj where speed_over_ground > 50 and abs(speed_over_ground - 102.3) >= 0.1
  union all select row_id, mmsi, t_s, 3, 'teleport', 50, case when kts > 200 then 'CRITICAL' when kts > 100 then 'HIGH' else 'MEDIUM' end
   from (select *, jump_nm / jump_s * 3600 as kts from sj where jump_s >= 10) where kts > 60
  union all select row_id, mmsi, t_s, 4, 'heading', 10, 'LOW' from sj where pt is not null and speed_over_ground >= 3 and heading <= 360 and course_over_ground <= 360
     and case when abs(heading - course_over_ground) > 180 then 360 - abs(heading - course_over_ground) else abs(heading - course_over_ground) end > 45
  union all select row_id, mmsi, t_s, 5, 'coordinates', 40, case when latitude not between -90 and 90 or longitude not between -180 and 180 then 'CRITICAL' else 'HIGH' end
   from sj where latitude not between -90 and 90 or longitude not between -180 and 180 or (abs(latitude) < 0.1 and abs(longitude) < 0.1)
  union all select row_id, mmsi, t_s, 6, 'imo_change', 60, 'CRITICAL' from sj where imo_known <> first_imo
  union all select row_id, mmsi, t_s, 7, 'uncommon_mid', 15, 'LOW' from sj
   where ({_NUM} between 600 and 639 or {_NUM} between 570 and 579) and substr(mmsi, 1, 3) not in {_KNOWN_MIDS}
  union all select row_id, mmsi, t_s, 8, 'name_change', 35, case when name_index >= 5 then 'HIGH' else 'MEDIUM' end from nmf where name_index >= 3),
scr as (select row_id, mmsi, t_s, cast(sum(sum(points)) over (partition by mmsi order by t_s, row_id) as bigint) as score
  from fnd group by row_id, mmsi, t_s),
fst as materialized (select fnd.*, score from fnd join scr using (row_id) qualify row_number() over (partition by fnd.row_id order by rank) = 1),
alls as materialized (select fnd.*, score from fnd join scr using (row_id))""",
]


@register(
    "j09_spoofing",
    S.query(S.POSITIONS, *SPOOF_CTE, S.throttled("fst", "sp_kept", "mmsi", 1800),
            'select row_id, mmsi, t_s, "check", severity, score from sp_kept'),
)
def spoofing_(t: Tables):
    return spoofing.spoofing_events(t.positions).select("row_id", "mmsi", "t_s", "check", "severity", "score")


@register(
    "j09_spoofing_by_check",
    S.query(S.POSITIONS, *SPOOF_CTE, S.throttled("alls", "sp_kept", "mmsi || ':' || \"check\"", 1800),
            'select row_id, mmsi, t_s, "check", severity, score from sp_kept'),
)
def spoofing_by_check(t: Tables):
    return spoofing.spoofing_events(t.positions, cooldown_key="check").select(
        "row_id", "mmsi", "t_s", "check", "severity", "score"
    )


_SUBS = {
    "j09a_invalid_mmsi": "invalid_mmsi", "j09b_impossible_speed": "impossible_speed", "j09c_teleport": "teleport",
    "j09d_heading": "heading", "j09e_coordinates": "coordinates", "j09g_imo_change": "imo_change",
    "j09h_uncommon_mid": "uncommon_mid", "j09i_name_change": "name_change",
}


# No derived report has wrong coordinates, so some are moved for that check: off the globe, and near 0, 0.
_MOVED = """p as materialized (select * replace (
  case row_id % 40 when 0 then latitude + 90 when 1 then 0.01 else latitude end as latitude,
  case row_id % 40 when 1 then -0.02 when 2 then -180.5 else longitude end as longitude) from ({}))"""


def _moved(positions):
    at = F.col("row_id") % 40
    return positions.withColumns({
        "latitude": F.when(at == 0, F.col("latitude") + 90).when(at == 1, 0.01).otherwise(F.col("latitude")),
        "longitude": F.when(at == 1, -0.02).when(at == 2, -180.5).otherwise(F.col("longitude")),
    })


def _register_checks() -> None:
    for name, check in _SUBS.items():
        moved = check == "coordinates"
        source = _MOVED.format(S.query(S.POSITIONS, "select * from p")) if moved else S.POSITIONS
        sql = S.query(source, *SPOOF_CTE, f"select row_id, mmsi, t_s, severity, points from fnd where \"check\" = '{check}'")

        def run(t: Tables, check=check, moved=moved):
            found = spoofing.spoofing_findings(_moved(t.positions) if moved else t.positions)
            return found.where(F.col("check") == check).select("row_id", "mmsi", "t_s", "severity", "points")

        register(name, sql)(run)


_register_checks()


@register(
    "f01_previous_report",
    S.query(S.POSITIONS, *SPOOF_CTE[:1],
            "select row_id, mmsi, jump_s, round(jump_nm, 4) as jump_nm, round(case when jump_s >= 10 then jump_nm / jump_s * 3600 end, 3) as jump_kts from sj"),
)
def previous_report(t: Tables):
    return spoofing.implied_jump(t.positions).select(
        "row_id", "mmsi", "jump_s", r4("jump_nm"), F.round("jump_kts", 3).alias("jump_kts")
    )


@register(
    "f04_names_so_far",
    S.query(S.POSITIONS, *SPOOF_CTE[:1], "select row_id, mmsi, t_s, nm as new_name, name_index from nmf"),
)
def names_so_far(t: Tables):
    return spoofing.name_changes(t.positions).select(
        "row_id", "mmsi", "t_s", "new_name", F.col("name_index").cast("long").alias("name_index")
    )


# ---------------------------------------------------------------- convoy

CONVOY_CTE = [
    TRACKED,
    f"""co as materialized (select *, cast(floor(t_s / 600) as bigint) as bk from tracked where speed_over_ground is not null and course_over_ground is not null),
cm as materialized (select a.row_id, a.mmsi, a.t_s, a.seq, b.mmsi as other, b.speed_over_ground as os, b.course_over_ground as oc,
   a.speed_over_ground as s, a.course_over_ground as c
  from co a join co b on {BUCKETS} and a.speed_over_ground >= 1 and abs(a.latitude - b.latitude) < 0.06 and {AS_OF}
   and {S.hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 3 and abs(a.speed_over_ground - b.speed_over_ground) <= 5
   and case when abs(a.course_over_ground - b.course_over_ground) > 180 then 360 - abs(a.course_over_ground - b.course_over_ground)
            else abs(a.course_over_ground - b.course_over_ground) end <= 30),
al as (select distinct row_id, mmsi, t_s, seq, mmsi as member, s as ms, c as mc from cm union all select row_id, mmsi, t_s, seq, other, os, oc from cm),
cr as materialized (select row_id, mmsi, t_s, seq, string_agg(member, '-' order by member) as convoy_id, count(*) as vessel_count,
   avg(ms) as mean_speed, avg(mc) as mean_course from al group by row_id, mmsi, t_s, seq),
cs as (select *, lag(seq) over w = seq - 1 and lag(convoy_id) over w = convoy_id and t_s - lag(t_s) over w <= 600 as goes_on
  from cr window w as (partition by mmsi order by t_s, row_id)),
ci as (select *, sum(case when coalesce(goes_on, false) then 0 else 1 end) over (partition by mmsi order by t_s, row_id) as isl from cs),
cd as materialized (select * from (select *, cast(floor((t_s - min(t_s) over (partition by mmsi, isl)) / 60) as bigint) as duration_minutes from ci)
  where goes_on and duration_minutes >= 3)""",
    S.throttled("cd", "cd_kept", "convoy_id", 3600),
]


@register(
    "j10_convoy",
    S.query(
        S.POSITIONS, *CONVOY_CTE,
        "select row_id, mmsi, t_s, convoy_id, vessel_count, duration_minutes, round(mean_speed, 4) as mean_speed, round(mean_course, 4) as mean_course, "
        "case when vessel_count >= 5 or duration_minutes >= 60 then 'HIGH' else 'MEDIUM' end as severity from cd_kept",
    ),
)
def convoy_(t: Tables):
    return convoy.convoy_events(t.positions).select(
        "row_id", "mmsi", "t_s", "convoy_id", F.col("vessel_count").cast("long").alias("vessel_count"), "duration_minutes",
        r4("mean_speed"), r4("mean_course"), "severity",
    )


@register(
    "e12_convoy_means",
    S.query(
        S.POSITIONS, *CONVOY_CTE,
        "select row_id, vessel_count, round(mean_speed, 4) as mean_speed, round(mean_course, 4) as mean_course from cr",
    ),
)
def convoy_means(t: Tables):
    return convoy.convoy_reports(convoy.tracked_reports(t.positions)).select(
        "row_id", "vessel_count", r4("mean_speed"), r4("mean_course")
    )


# ---------------------------------------------------------------- anchor

ANCHOR_CTE = [
    f"""an0 as (select *, coalesce(nav_status in (1, 5), false) as anch, lag(coalesce(nav_status in (1, 5), false)) over (partition by mmsi order by t_s, row_id) as before from p),
an1 as (select *, sum(case when coalesce(before, false) then 0 else 1 end) over (partition by mmsi order by t_s, row_id) as spell from an0 where anch),
spells as materialized (select *, first_value(row_id) over w as anchor_row, first_value(t_s) over w as anchored_s, first_value(latitude) over w as ala, first_value(longitude) over w as alo
  from an1 window w as (partition by mmsi, spell order by t_s, row_id)),
dr0 as (select *, {S.hav('ala', 'alo', 'latitude', 'longitude')} as drift_nm, coalesce(speed_over_ground, 0) as speed from spells where row_id <> anchor_row),
dr as materialized (select *, max(drift_nm) over (partition by mmsi, anchor_row order by t_s, row_id) as max_drift_nm from dr0),
drag as materialized (select * from (select *, case when speed > 1.5 then 'fast' when speed > 0.5 then 'moving' when drift_nm > 0.05 then 'drift' end as cause from dr) where cause is not null)""",
    S.inside("drag", "an_in", "z.zone_type = 'cable_protection'"),
    """cabn as (select row_id, min(zone_id) as zone_id from an_in group by row_id),
anc as materialized (select drag.*, z.zone_name as cable_name, cabn.zone_id is not null as near_cable from drag left join cabn using (row_id) left join z on z.zone_id = cabn.zone_id)""",
    S.throttled("anc", "anc_kept", "mmsi", 900),
]


@register(
    "j11_anchor_drag",
    S.query(
        S.POSITIONS, S.zones(), *ANCHOR_CTE,
        """select row_id, mmsi, t_s, cause, speed, round(drift_nm, 4) as drift_nm, round(max_drift_nm, 4) as max_drift_nm, near_cable, cable_name,
  cast(floor((t_s - anchored_s) / 60) as bigint) as anchor_minutes,
  row_number() over (partition by mmsi, anchor_row order by t_s, row_id) - 1 as alert_count,
  case cause when 'fast' then case when near_cable then 'CRITICAL' else 'HIGH' end when 'moving' then case when near_cable then 'HIGH' else 'MEDIUM' end
    else case when near_cable then 'CRITICAL' else 'MEDIUM' end end as severity from anc_kept""",
    ),
)
def anchor_(t: Tables):
    return anchor.anchor_events(t.positions, t.zones).select(
        "row_id", "mmsi", "t_s", "cause", "speed", r4("drift_nm"), r4("max_drift_nm"), "near_cable", "cable_name",
        "anchor_minutes", "alert_count", "severity",
    )


@register(
    "f08_anchor_spells",
    S.query(S.POSITIONS, *ANCHOR_CTE[:1], "select row_id, mmsi, anchor_row from spells"),
)
def anchor_spells(t: Tables):
    return anchor.anchor_spells(t.positions).select("row_id", "mmsi", F.col("anchor.row_id").alias("anchor_row"))


@register(
    "f15_max_drift",
    S.query(S.POSITIONS, *ANCHOR_CTE[:1], "select row_id, mmsi, round(drift_nm, 4) as drift_nm, round(max_drift_nm, 4) as max_drift_nm from dr"),
)
def max_drift(t: Tables):
    return anchor.anchor_drift(t.positions).select("row_id", "mmsi", r4("drift_nm"), r4("max_drift_nm"))


# ---------------------------------------------------------------- sanctions

# Sanctioned vessels drawn from the positions: the listed IMOs of users 9 and 49 and the MMSI of
# user 19, beside the fixed high-risk flags.
FLAGS_SQL = "flags(mid, code, country, risk, reason) as (values " + ", ".join(
    "(" + ", ".join(S._text(v) for v in r) + ")" for r in dims.HIGH_RISK_FLAG_RECORDS
) + ")"
SANCTION_SQL = [
    FLAGS_SQL,
    """listed as (select distinct imo_number as imo, null::varchar as m, ship_name as nm from p where imo_number in ('9000009', '9000049')
  union all select distinct null, mmsi, ship_name from p where mmsi = '230000019')""",
    f"""sm as materialized (
  select p.row_id, p.mmsi, p.t_s, 1 as rank, 'IMO_EXACT_MATCH' as match_type, l.nm as listed_as from p join listed l on p.imo_number = l.imo
  union all select p.row_id, p.mmsi, p.t_s, 2, 'MMSI_EXACT_MATCH', l.nm from p join listed l on p.mmsi = l.m
  union all select p.row_id, p.mmsi, p.t_s, 3, 'HIGH_RISK_FLAG', f.country from p join flags f on f.mid = substr(p.mmsi, 1, 3) where f.risk = 'critical' and {TANKER})""",
    S.throttled("sm", "sm_kept", "mmsi", 3600, tie="row_id, rank"),
]


def sanction_records(t: Tables):
    p = t.positions
    by_imo = p.where(F.col("imo_number").isin("9000009", "9000049")).select(
        "imo_number", F.lit(None).cast("string").alias("mmsi"), "ship_name"
    )
    by_mmsi = p.where(F.col("mmsi") == "230000019").select(
        F.lit(None).cast("string").alias("imo_number"), "mmsi", "ship_name"
    )
    vessels = by_imo.unionByName(by_mmsi).distinct().select(
        F.lit("SANCTIONED_VESSEL").alias("record_type"), "imo_number", "mmsi", F.col("ship_name").alias("vessel_name"),
        F.array(F.lit("EU"), F.lit("OFAC")).alias("sanctions_authorities"), F.lit("critical").alias("risk_level"),
        F.monotonically_increasing_id().alias("offset"),
    )
    flags = dims.high_risk_flags(t.spark).withColumn("offset", F.lit(0).cast("long"))
    return latest_sanctions(vessels.unionByName(flags, allowMissingColumns=True), "offset")


@register(
    "j12_shadow_fleet",
    S.query(S.POSITIONS, *SANCTION_SQL,
            "select row_id, mmsi, t_s, match_type, listed_as, case when match_type = 'HIGH_RISK_FLAG' then 'HIGH' else 'CRITICAL' end as severity from sm_kept"),
)
def shadow_fleet(t: Tables):
    out = sanctions_match.sanction_events(t.positions, sanction_records(t))
    named = F.coalesce(F.col("record.vessel_name"), F.col("record.country_name"))
    return out.select("row_id", "mmsi", "t_s", "match_type", named.alias("listed_as"), "severity")


@register(
    "d02_sanction_matches",
    S.query(S.POSITIONS, *SANCTION_SQL[:3], "select row_id, mmsi, rank, match_type, listed_as from sm"),
)
def sanction_matches(t: Tables):
    named = F.coalesce(F.col("record.vessel_name"), F.col("record.country_name"))
    return sanctions_match.sanction_matches(t.positions, sanction_records(t)).select(
        "row_id", "mmsi", "rank", "match_type", named.alias("listed_as")
    )


# ---------------------------------------------------------------- risk

_PORT = "(case " + " ".join(
    f"when {S.hav('latitude', 'longitude', f'{a}::double', f'{b}::double')} <= 5 then {i}" for i, (_, a, b) in enumerate(dims.RUSSIAN_PORTS)
) + " end)"
RISK_PORTS = [
    f"rp as materialized (select * from (select *, {_PORT} as port from p where latitude between 54 and 60.5) where port is not null)",
    S.throttled("rp", "visits", "mmsi || ':' || port", 86400, strict=True),
]
RISK_CTE = [
    *RISK_PORTS,
    f"""lives as (select row_id, mmsi, t_s, ship_name, sum(case when pt is null or t_s - pt >= 604800 then 1 else 0 end) over (partition by mmsi order by t_s, row_id) as life,
   pt is null or t_s - pt >= 604800 as fresh
  from (select *, lag(t_s) over (partition by mmsi order by t_s, row_id) as pt from p)),
counted as (select lives.*, sum(case when visits.row_id is null then 0 else 1 end) over (partition by lives.mmsi, life order by lives.t_s, lives.row_id) as port_count
  from lives left join visits on visits.row_id = lives.row_id),
scored as (select *, cast(least(100, (case when substr(mmsi, 1, 3) in {S.listed(dims.HIGH_RISK_MIDS)} then 30 else 0 end) + 25 * least(port_count, 3)) as int) as score from counted),
steps as (select *, coalesce(lag(score) over (partition by mmsi, life order by t_s, row_id), 0) as previous_score from scored),
ups as (select *, case when score >= 75 and previous_score < 75 then 'CRITICAL' when score >= 50 and previous_score < 50 then 'HIGH'
    when score >= 25 and previous_score < 25 then 'MEDIUM' end as crossed,
   row_number() over (partition by mmsi, life order by t_s, row_id) as k from steps where score > previous_score),
fired(mmsi, life, k, row_id, last_s, fires) as (
  select mmsi, life, k, row_id, case when crossed is not null then t_s end, crossed is not null from ups where k = 1
  union all
  select u.mmsi, u.life, u.k, u.row_id,
    case when u.score >= 25 and (u.crossed is not null or (u.score - u.previous_score >= 15 and (f.last_s is null or u.t_s - f.last_s >= 14400))) then u.t_s else f.last_s end,
    u.score >= 25 and (u.crossed is not null or (u.score - u.previous_score >= 15 and (f.last_s is null or u.t_s - f.last_s >= 14400)))
  from fired f join ups u on u.mmsi = f.mmsi and u.life = f.life and u.k = f.k + 1)""",
]


@register(
    "j13_vessel_risk",
    S.query(
        S.POSITIONS, *RISK_CTE,
        """select u.row_id, u.mmsi, u.t_s, u.score, u.previous_score, cast(u.port_count as bigint) as port_count,
  case when u.score >= 75 then 'CRITICAL' when u.score >= 50 then 'HIGH' else 'MEDIUM' end as severity,
  coalesce('crossed into ' || crossed || ' risk tier', 'risk score increased by ' || (u.score - u.previous_score) || ' points') as reason
  from ups u join fired f using (row_id) where f.fires""",
    ),
)
def vessel_risk(t: Tables):
    return risk.risk_events(t.positions).select(
        "row_id", "mmsi", "t_s", "score", "previous_score", "port_count", "severity", "reason"
    )


@register(
    "f14_port_visits",
    S.query(S.POSITIONS, *RISK_PORTS, "select row_id, mmsi, t_s, port from visits"),
)
def port_visits(t: Tables):
    return risk.port_visits(t.positions).select("row_id", "mmsi", "t_s", "port")


@register(
    "d04_port_within_reach",
    S.query(S.POSITIONS, RISK_PORTS[0], "select row_id, port from rp"),
)
def port_within_reach(t: Tables):
    return t.positions.withColumn("port", risk.port_of()).where("port is not null").select("row_id", "port")


# ---------------------------------------------------------------- the alerts of all detectors, for incidents

#: An alert's columns come from the detector's own SQL (`a`) and from the report that it is about (`p`).
def _alert_sql(kind: str, sql: str, subject: str | None, title: str, name: str = "p.ship_name", more: str = "") -> str:
    parts = f"'{kind}', a.mmsi, a.t_s::varchar, a.row_id::varchar" + (f", {subject}" if subject else "")
    return (
        f"select substr(sha256(concat_ws('|', {parts})), 1, 32) as alert_id, '{kind}' as alert_type, a.severity, a.mmsi, "
        f"{name} as vessel_name, p.latitude, p.longitude, a.t_s, {title} as title, a.row_id from ({sql}) a join p using (row_id) {more}"
    )


_CABLE_TITLE = (
    "case when a.risk_factor = 'STOPPED_IN_ZONE' then 'CRITICAL: Vessel Stopped in Cable Zone' "
    "when a.severity = 'CRITICAL' then 'CRITICAL: Suspicious Slow Vessel Near Cable' "
    "when a.severity = 'HIGH' then 'HIGH: Slow Vessel in Cable Zone' "
    "when a.severity = 'MEDIUM' then 'Flagged State Vessel in Cable Zone' else 'Large Vessel in Cable Zone' end"
)
_SPOOF_TITLE = (
    "case a.\"check\" when 'invalid_mmsi' then case when length(a.mmsi) <> 9 then 'Invalid MMSI Format' "
    "when regexp_full_match(a.mmsi, '0{9}|9{9}') or a.mmsi in ('123456789', '111111111') then 'Suspicious MMSI Pattern' "
    "when try_cast(substr(a.mmsi, 1, 3) as int) is null then 'Invalid MMSI Characters' else 'Invalid MID Code' end "
    "when 'impossible_speed' then 'Impossible Speed Reported' when 'teleport' then 'Position Teleportation Detected' "
    "when 'heading' then 'Heading/COG Inconsistency' when 'coordinates' then case when a.severity = 'CRITICAL' then 'Invalid Coordinates' "
    "else 'Null Island Position' end when 'imo_change' then 'IMO Number Changed - Identity Spoofing' "
    "when 'uncommon_mid' then 'Uncommon Flag State MID' else 'Multiple Vessel Names Detected' end"
)


def _fixed(value: str, places: int) -> str:
    """A number as text, halves rounded up as Spark's format_string does."""
    return f"printf('%.{places}f', round(cast({value} as decimal(24, 10)), {places})::double)"


_WHO = "coalesce(a.ship_name, 'Unknown') || ', MMSI ' || a.mmsi"
_CABLE_TEXT = (
    f"{_WHO} || ', flag ' || coalesce(a.flag, 'unknown') || ': ' || {_fixed('a.speed', 1)} || ' knots in ' || a.zone_name || '; ' || "
    "case a.risk_factor when 'STOPPED_IN_ZONE' then 'lies still and may be at anchor' "
    "when 'FLAGGED_STATE_SLOW' then 'slow under a watched flag' when 'HIGH_RISK_SHIP_SLOW' then 'slow cargo ship or tanker' "
    "when 'SLOW_IN_ZONE' then 'slow in a protected zone' when 'FLAGGED_STATE_TRANSIT' then 'passes under a watched flag' "
    "else 'cargo ship or tanker passes at reduced speed' end || '.'"
)
_PLACE = f"{_fixed('a.latitude', 4)} || ', ' || {_fixed('a.longitude', 4)}"
_TURN = "abs(a.heading - a.course_over_ground)"
_SPOOF_TEXT = (
    f"{_WHO} || ': ' || case a.\"check\" when 'invalid_mmsi' then case "
    "when length(a.mmsi) <> 9 then 'the identity has ' || length(a.mmsi) || ' characters, not nine' "
    "when regexp_full_match(a.mmsi, '0{9}|9{9}') or a.mmsi in ('123456789', '111111111') then 'the identity looks made up' "
    "when try_cast(substr(a.mmsi, 1, 3) as int) is null then 'the identity is not a number' "
    "else 'no country has the digits ' || substr(a.mmsi, 1, 3) end "
    f"when 'impossible_speed' then 'gives its speed as ' || {_fixed('a.speed_over_ground', 1)} || ' knots' "
    f"when 'teleport' then {_fixed('a.jump_nm', 1)} || ' nautical miles from its last report, ' || a.jump_s || "
    f"' seconds before; that takes ' || {_fixed('a.jump_nm / a.jump_s * 3600', 0)} || ' knots' "
    f"when 'heading' then 'points to ' || {_fixed('a.heading', 0)} || '° but travels to ' || {_fixed('a.course_over_ground', 0)} || '°, ' || "
    f"{_fixed(f'least({_TURN}, 360 - {_TURN})', 0)} || '° apart, at ' || {_fixed('a.speed_over_ground', 1)} || ' knots' "
    f"when 'coordinates' then case when a.severity = 'CRITICAL' then 'the place ' || {_PLACE} || ' is not on the globe' "
    "else 'the place is the origin of coordinates, as receivers without a fix give it' end "
    "when 'imo_change' then 'the ship''s number was IMO ' || a.first_imo || ' and is now ' || a.imo_number "
    "when 'uncommon_mid' then 'the digits ' || substr(a.mmsi, 1, 3) || ' belong to a register that ships seldom use' "
    "else 'name ' || a.name_index || ' of this identity is ' || a.ship_name || '; the first was ' || a.first_name end"
)
_REASON = "case title " + " ".join(f"when '{title}' then '{reason}'" for title, reason in dims.SPOOFING_ALERTS.values()) + " end"


@register(
    "c31_cable_texts",
    S.query(S.POSITIONS, S.zones(), *CABLE_CTE,
            f"select a.mmsi, a.t_s, a.zone_id, a.severity, {_CABLE_TITLE} as title, {_CABLE_TEXT} as description from cab_kept a"),
)
def cable_texts(t: Tables):
    alerts = cable.detect_cable_proximity(t.positions, t.zones)
    return alerts.select(
        "mmsi", F.unix_seconds("detected_at").alias("t_s"), F.get_json_object("details", "$.zone_id").alias("zone_id"),
        "severity", "title", "description",
    )


@register(
    "c31_spoofing_texts",
    S.query(
        _MOVED.format(S.query(S.POSITIONS, "select * from p")), *SPOOF_CTE,
        f"""texts as (select a.row_id, a."check", {_SPOOF_TITLE} as title, {_SPOOF_TEXT} as text from (
   select fnd.row_id, fnd."check", fnd.severity, sj.* exclude (row_id), nmf.name_index, n1.nm as first_name
     from fnd join sj using (row_id) left join nmf using (row_id) left join (select mmsi, nm from nmf where name_index = 1) n1
     on n1.mmsi = sj.mmsi) a)""",
        f"select *, {_REASON} as reason from texts",
    ),
)
def spoofing_texts(t: Tables):
    found = spoofing.spoofing_findings(_moved(t.positions))
    return found.select("row_id", "check", "title", "text", F.get_json_object("details", "$.reason").alias("reason"))


_ANCHOR_TITLE = (
    "case when not a.near_cable then 'Anchor Dragging Detected' when a.severity = 'CRITICAL' then 'CRITICAL: Anchor Dragging Near Cable!' "
    "else 'Anchor Dragging Near Infrastructure' end"
)
# The registered query rounds the minutes, the title rounds them once.
_PATH_SQL = S.query(
    S.POSITIONS, S.zones(), *TRAJECTORY_CTE,
    "select row_id, mmsi, t_s, zone_id, 'PREDICTIVE: Vessel approaching ' || zone_name || ' in ~' || cast(round(eta_minutes) as bigint) || ' min' as title, "
    "case when eta_minutes < 15 then 'HIGH' when eta_minutes < 30 then 'MEDIUM' else 'LOW' end as severity from traj_kept join z using (zone_id)",
)

ALERTS_CTE = [
    "alerts as materialized ("
    + " union all ".join([
        _alert_sql("GEOFENCE_VIOLATION", SQL["j01_geofence"], "a.zone_id", "a.title"),
        _alert_sql("DARK_EVENT", SQL["j02_gone_dark"], "'gone'", "'Vessel Gone Dark'", name="a.ship_name"),
        _alert_sql("DARK_EVENT", SQL["j03_appeared_dark"], "'appeared'", "a.title"),
        _alert_sql("RENDEZVOUS", SQL["j04_rendezvous"], "a.vessel2_mmsi", "'Potential Ship-to-Ship Transfer'"),
        _alert_sql("FISHING_IN_MPA", SQL["j05_fishing"], "a.zone_id", "a.title"),
        _alert_sql("CABLE_PROXIMITY", SQL["j06_cable_proximity"], "a.zone_id", _CABLE_TITLE),
        _alert_sql("TRAJECTORY_PREDICTION", _PATH_SQL, "a.zone_id", "a.title"),
        _alert_sql("AIS_SPOOFING", SQL["j09_spoofing"], 'a."check"', _SPOOF_TITLE),
        _alert_sql("CONVOY", SQL["j10_convoy"], "a.convoy_id", "'Convoy Detected'"),
        _alert_sql("ANCHOR_DRAGGING", SQL["j11_anchor_drag"], None, _ANCHOR_TITLE),
        _alert_sql("SANCTIONS_MATCH", SQL["j12_shadow_fleet"], "a.match_type",
                   "case when a.match_type = 'HIGH_RISK_FLAG' then 'Tanker with ' || a.listed_as || ' Flag' "
                   "else 'SHADOW FLEET: ' || coalesce(p.ship_name, 'Unknown Vessel') || ' Detected' end"),
        _alert_sql("SANCTIONS_MATCH", SQL["j13_vessel_risk"], "'risk'", "a.severity || ' Risk Vessel: ' || coalesce(p.ship_name, a.mmsi)"),
    ])
    + ")",
]
_WEIGHT = "(case t " + " ".join(f"when '{k}' then {v}" for k, v in dims.ALERT_WEIGHTS.items()) + " else 30 end)"
INCIDENT_CTE = [
    *ALERTS_CTE,
    f"""ses as materialized (select *, sum(case when pt is null or t_s - pt >= 1800 then 1 else 0 end) over (partition by mmsi order by t_s, alert_id) as session
  from (select *, lag(t_s) over (partition by mmsi order by t_s, alert_id) as pt from alerts where mmsi <> '')),
typ as (select mmsi, session, alert_type as t, min(t_s || '|' || alert_id) as f from ses group by all),
types as (select mmsi, session, list(t order by f) as alert_types, count(*) as k, sum({_WEIGHT}) as w from typ group by all),
agg as (select mmsi, session, count(*) as alert_total, min(t_s) as first_s, max(t_s) as last_s,
   arg_min(coalesce(vessel_name, 'MMSI ' || mmsi), t_s || '|' || alert_id) as ship_name,
   arg_max(coalesce(vessel_name, 'MMSI ' || mmsi), t_s || '|' || alert_id) as last_name,
   arg_max(latitude, t_s || '|' || alert_id) as lat, arg_max(longitude, t_s || '|' || alert_id) as lon from ses group by all),
inc0 as (select *, cast(least(100, floor((case when k >= 3 then floor(w * 1.3::double) when k = 2 then floor(w * 1.15::double) else w end) / k)) as int) as risk_score,
   alert_total as alert_count, last_s - first_s as secs from agg join types using (mmsi, session)),
inc as materialized (select *, substr(sha256(mmsi || '|' || first_s), 1, 32) as id,
   case when risk_score >= 85 or list_contains(alert_types, 'ANCHOR_DRAGGING') then 'CRITICAL'
        when risk_score >= 70 or list_contains(alert_types, 'CABLE_PROXIMITY') then 'HIGH' when risk_score >= 50 then 'MEDIUM' else 'LOW' end as severity,
   case when list_contains(alert_types, 'ANCHOR_DRAGGING') and list_contains(alert_types, 'CABLE_PROXIMITY') then 'Potential Cable Threat: ' || last_name || ' dragging anchor near infrastructure'
        when list_contains(alert_types, 'ANCHOR_DRAGGING') then 'Anchor Dragging Alert: ' || last_name
        when list_contains(alert_types, 'CABLE_PROXIMITY') and list_contains(alert_types, 'DARK_EVENT') then 'Suspicious Activity: ' || last_name || ' went dark near cable zone'
        when list_contains(alert_types, 'CABLE_PROXIMITY') then 'Cable Zone Intrusion: ' || last_name
        when list_contains(alert_types, 'SANCTIONS_MATCH') then 'Sanctioned Vessel Activity: ' || last_name
        when list_contains(alert_types, 'AIS_SPOOFING') then 'Potential AIS Spoofing: ' || last_name
        when list_contains(alert_types, 'DARK_EVENT') then 'AIS Transmission Gap: ' || last_name
        when list_contains(alert_types, 'RENDEZVOUS') then 'Ship-to-Ship Meeting: ' || last_name else 'Maritime Alert: ' || last_name end as title,
   alert_count || ' related alerts (' || array_to_string(alert_types, ', ') || ')' ||
     case when secs > 3600 then ' over ' || cast(round(secs / 3600.0, 1) as decimal(12, 1)) || ' hours'
          when secs > 60 then ' over ' || cast(round(secs / 60.0) as bigint) || ' minutes' else '' end as description from inc0)""",
]


def all_detector_alerts(t: Tables):
    """Alerts of all detectors, the input of the incident and serving queries; stored once per session, like the positions."""
    return t.stored("alerts", lambda: pipeline.run_pipeline(t.positions, t.zones, written(sanction_records(t), "sanctions")))


@register(
    "j14_incidents",
    S.query(
        S.POSITIONS, *INCIDENT_CTE,
        "select id, mmsi, ship_name, severity, title, description, array_to_string(alert_types, ',') as alert_types, alert_count, "
        "first_s, last_s, risk_score, lat, lon from inc",
    ),
)
def incidents_(t: Tables):
    return incidents.correlate_incidents(all_detector_alerts(t)).select(
        "id", "mmsi", "ship_name", "severity", "title", "description", F.array_join("alert_types", ",").alias("alert_types"),
        "alert_count", F.unix_seconds("first_alert_time").alias("first_s"),
        F.unix_seconds("last_alert_time").alias("last_s"), "risk_score", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"),
    )


# ---------------------------------------------------------------- investigation

INV_ZONE = "CABLE-CLION1"
INV_FROM, INV_TO = 1704067200 + 1800, 1704067200 + 14400
INV_CTE = [
    S.zones(),
    f"""nearz as materialized (select p.* from p, z where zone_id = '{INV_ZONE}' and t_s between {INV_FROM} and {INV_TO}
  and latitude between min_y - 0.5 and max_y + 0.5 and longitude between min_x - 0.5 and max_x + 0.5)""",
    S.inside("nearz", "inv_in", f"z.zone_id = '{INV_ZONE}'"),
    f"""tr0 as (select nearz.*, inv_in.row_id is not null as inside from nearz left join inv_in using (row_id)),
tr as materialized (select *, coalesce(lag(inside) over w, false) as was_inside, bool_or(inside) over w as entered
  from tr0 window w as (partition by mmsi order by t_s, row_id)),
num as (select *, row_number() over (partition by mmsi, inside order by t_s, row_id) as k from tr where inside <> was_inside),
vis as (select a.mmsi, count(*) as entries, count(b.t_s) as exits, coalesce(sum(b.t_s - a.t_s), 0) / 60.0 as minutes_in_zone, min(a.t_s) as first_entry_s,
   max(b.t_s) as last_exit_s from num a left join num b on a.mmsi = b.mmsi and a.k = b.k and not b.inside where a.inside group by a.mmsi),
zs as (select mmsi, count(*) as reports_in_zone, min(speed_over_ground) as min_speed, max(speed_over_ground) as max_speed, avg(speed_over_ground) as avg_speed,
   count(*) filter (where speed_over_ground < 0.5) as stopped, count(*) filter (where nav_status in (1, 5)) as anchored from tr where inside group by mmsi),
attr as (select mmsi, arg_min(trim(ship_name), (t_s, row_id)) filter (where ship_name <> '') as ship_name,
   arg_min(imo_number, (t_s, row_id)) filter (where imo_number <> '') as imo_number from tr where entered group by mmsi),
inv as materialized (select *, {S.INVESTIGATOR_FLAG} as flag_state from vis join zs using (mmsi) join attr using (mmsi)),
sus as materialized (select *, concat_ws(',', case when stopped >= 3 then 'STOPPED_IN_ZONE' end, case when anchored > 0 then 'ANCHOR_STATUS' end,
   case when avg_speed < 3 then 'SLOW_TRANSIT' end, case when flag_state in {S.listed(dims.FLAGS_OF_CONVENIENCE)} then 'FLAG_OF_CONVENIENCE' end,
   case when flag_state in {S.listed(dims.HIGH_RISK_FLAGS)} then 'HIGH_RISK_FLAG' end, case when minutes_in_zone > 30 then 'PROLONGED_TIME' end,
   case when max_speed > 0 and min_speed / max_speed < 0.3 then 'SPEED_VARIATION' end) as indicators from inv)""",
]


def _investigation(t: Tables):
    return investigate.investigate_zone(t.positions, t.zones, INV_ZONE, INV_FROM, INV_TO)


@register(
    "j15_zone_vessels",
    S.query(
        S.POSITIONS, *INV_CTE,
        "select mmsi, ship_name, imo_number, flag_state, entries, exits, first_entry_s, last_exit_s, round(minutes_in_zone, 4) as minutes_in_zone, "
        "reports_in_zone, min_speed, max_speed, round(avg_speed, 4) as avg_speed, indicators from sus",
    ),
)
def zone_vessels(t: Tables):
    return _investigation(t).vessels.select(
        "mmsi", "ship_name", "imo_number", "flag_state", "entries", "exits", "first_entry_s", "last_exit_s", r4("minutes_in_zone"),
        "reports_in_zone", "min_speed", "max_speed", r4("avg_speed"), F.array_join("indicators", ",").alias("indicators"),
    )


@register(
    "a20_suspicious_vessels",
    S.query(S.POSITIONS, *INV_CTE, "select mmsi, ship_name, flag_state, indicators from sus where indicators <> ''"),
)
def suspicious_vessels(t: Tables):
    return _investigation(t).suspicious.select("mmsi", "ship_name", "flag_state", F.array_join("indicators", ",").alias("indicators"))


@register(
    "g08_crossing_timeline",
    S.query(
        S.POSITIONS, *INV_CTE,
        "select num.t_s, num.row_id, case when inside then 'ENTRY' else 'EXIT' end as event, num.mmsi, attr.ship_name as vessel_name, "
        "speed_over_ground as speed, course_over_ground as heading from num join attr using (mmsi)",
    ),
)
def crossing_timeline(t: Tables):
    return _investigation(t).timeline.select("t_s", "row_id", "event", "mmsi", "vessel_name", "speed", "heading")


@register(
    "e06_flag_counts",
    S.query(
        S.POSITIONS, *INV_CTE,
        f"""select coalesce(flag_state, 'Unknown') as flag, count(*) as vessels, any_value(case when flag_state in {S.listed(dims.HIGH_RISK_FLAGS)} then 'HIGH RISK'
  when flag_state in {S.listed(dims.FLAGS_OF_CONVENIENCE)} then 'Flag of Convenience' else 'Standard' end) as category from inv group by 1""",
    ),
)
def flag_counts(t: Tables):
    return _investigation(t).flags


@register(
    "a20_report_lines",
    S.query(
        S.POSITIONS, *INV_CTE,
        "select first_entry_s, mmsi, '| ' || mmsi || ' | ' || coalesce(ship_name, 'Unknown') || ' | ' || coalesce(flag_state, '??') || ' | ' || entries || ' | ' "
        "|| cast(round(minutes_in_zone, 1) as decimal(18, 1)) || ' min | ' || coalesce(cast(round(min_speed, 1) as decimal(18, 1))::varchar, '-') || ' | ' "
        "|| coalesce(cast(round(avg_speed, 1) as decimal(18, 1))::varchar, '-') || ' | ' || case when indicators = '' then '-' else replace(indicators, ',', ', ') end || ' |' as line from sus",
    ),
)
def report_lines(t: Tables):
    return investigate.report_lines(_investigation(t))


def _track(t: Tables):
    return investigate.zone_track(t.positions, t.zones.where(F.col("zone_id") == INV_ZONE), INV_FROM, INV_TO)


@register(
    "f09_zone_crossings",
    S.query(S.POSITIONS, *INV_CTE, "select row_id, mmsi, t_s, case when inside then 'entry' else 'exit' end as crossing from num"),
)
def zone_crossings(t: Tables):
    return investigate.crossings(_track(t)).select("row_id", "mmsi", "t_s", "crossing")


@register(
    "e05_time_in_zone",
    S.query(S.POSITIONS, *INV_CTE, "select mmsi, entries, exits, round(minutes_in_zone, 4) as minutes_in_zone from vis"),
)
def time_in_zone(t: Tables):
    visits = investigate.zone_visits(_track(t), ais.flag_state("mmsi", "investigator"))
    return visits.where("entries > 0").select("mmsi", "entries", "exits", r4("minutes_in_zone"))


@register(
    "e04_zone_speeds",
    S.query(S.POSITIONS, *INV_CTE, "select mmsi, min_speed, max_speed, round(avg_speed, 4) as avg_speed from zs"),
)
def zone_speeds(t: Tables):
    visits = investigate.zone_visits(_track(t), ais.flag_state("mmsi", "investigator"))
    return visits.select("mmsi", "min_speed", "max_speed", r4("avg_speed"))


@register(
    "f11_cooldown",
    S.query(
        S.POSITIONS,
        "seen as materialized (select row_id, mmsi, t_s from p)",
        S.throttled("seen", "kept", "mmsi", 900),
        "select * from kept",
    ),
)
def cooldown(t: Tables):
    return throttle(t.positions.select("row_id", "mmsi", "t_s"), ["mmsi"], 900)


# ---------------------------------------------------------------- everything together

_PARTS = {
    "GEOFENCE_VIOLATION": ["j01_geofence"],
    "DARK_EVENT": ["j02_gone_dark", "j03_appeared_dark"],
    "RENDEZVOUS": ["j04_rendezvous"],
    "FISHING_IN_MPA": ["j05_fishing"],
    "CABLE_PROXIMITY": ["j06_cable_proximity"],
    "TRAJECTORY_PREDICTION": ["j07_trajectory"],
    "AIS_SPOOFING": ["j09_spoofing"],
    "CONVOY": ["j10_convoy"],
    "ANCHOR_DRAGGING": ["j11_anchor_drag"],
    "SANCTIONS_MATCH": ["j12_shadow_fleet", "j13_vessel_risk"],
}


_ALL_ALERTS = " union all ".join(
    f"select '{kind}' as alert_type, severity, mmsi, t_s from ({SQL[name]})" for kind, names in _PARTS.items() for name in names
)


def _all_alerts(t: Tables, positions):
    alerts = pipeline.run_pipeline(positions, t.zones, written(sanction_records(t), "sanctions"))
    return alerts.select("alert_type", "severity", "mmsi", F.unix_seconds("detected_at").alias("t_s"))


@register("j17_all_detectors", _ALL_ALERTS)
def all_detectors(t: Tables):
    return _all_alerts(t, t.positions)


@register("j17_repeated_messages", _ALL_ALERTS)
def repeated_messages(t: Tables):
    """Every report comes twice; the alerts stay the same."""
    return _all_alerts(t, t.positions.union(t.positions))


@register(
    "c34_state_tests",
    S.query(
        S.POSITIONS,
        INTERVALS,
        """last as (select o.*, m.avg_s, row_number() over (partition by o.mmsi order by o.n desc) as back
  from ord o join mean m on m.mmsi = o.mmsi and m.n = o.n),
cs as (select *, lag(course_over_ground) over (partition by mmsi order by n) as pc from last where back <= 20),
tn as (select mmsi, count(*) as points, coalesce(avg(speed_over_ground), 0) as mean_kts,
   count(*) filter (where case when abs(course_over_ground - pc) > 180 then 360 - abs(course_over_ground - pc) else abs(course_over_ground - pc) end > 30) as turns from cs group by mmsi)""",
        """select mmsi, points >= 10 and mean_kts < 5 and turns >= 5 as fishing_like, coalesce(speed_over_ground > 0.5, false) as moving,
  floor((1704100000 - t_s) / 60) >= 30 and case when n > 10 and avg_s > 0 then floor((1704100000 - t_s) / 60) > floor(avg_s / 60) * 10 else true end as maybe_dark
  from last join tn using (mmsi) where back = 1""",
    ),
)
def state_tests(t: Tables):
    return state.vessel_state(t.positions).select(
        "mmsi", state.exhibits_fishing_pattern(F.col("recent_positions")).alias("fishing_like"),
        ais.is_moving("last_speed").alias("moving"), state.is_potentially_dark(1704100000).alias("maybe_dark"),
    )
