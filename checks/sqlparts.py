"""Building blocks of the comparison SQL (DuckDB)."""

from __future__ import annotations

from harborlight import dims
from harborlight.sources.derived import REPORT_SQL, TIME_SQL

# Rectangular test zones beside the infrastructure zones: id, type, west, east, south, north.
TEST_ZONES = [
    ("TEST-MPA", "MPA", 19.0, 19.6, 56.9, 57.3),
    ("TEST-EEZ", "EEZ", 19.2, 19.8, 57.05, 57.4),
    ("TEST-SANC", "sanctioned_waters", 20.0, 20.8, 54.5, 54.9),
    ("TEST-REST", "restricted", 21.9, 22.2, 58.9, 59.1),
]

POSITIONS = (
    """e as (
  select event_id, user_id as v, cast(user_id % 10 as int) as m, cast(floor(user_id / 10.0) as int) as g,
         cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as r
  from events),
k as ("""
    + TIME_SQL
    + "), p as materialized ("
    + REPORT_SQL
    + ")"
)


def _text(v) -> str:
    return "null" if v is None else "'" + str(v).replace("'", "''") + "'"


def _zone_rows():
    for zid, name, kind, infra, severity, ring in dims.INFRASTRUCTURE_ZONES:
        yield zid, name, kind, infra, severity, False, ring
    for zid, kind, w, e, s, n in TEST_ZONES:
        rule = dims.ZONE_RULES[kind]
        ring = [(w, s), (e, s), (e, n), (w, n), (w, s)]
        yield zid, zid, kind, None, rule["severity"], rule["alert_all_vessels"], ring


def zones() -> str:
    heads, edges = [], []
    for zid, name, kind, infra, severity, everyone, ring in _zone_rows():
        xs, ys = [x for x, _ in ring], [y for _, y in ring]
        heads.append(
            f"({_text(zid)},{_text(name)},{_text(kind)},{_text(infra)},{_text(severity)},{str(everyone).lower()},"
            f"{min(xs)}::double,{min(ys)}::double,{max(xs)}::double,{max(ys)}::double)"
        )
        for i, ((x1, y1), (x2, y2)) in enumerate(zip(ring[:-1], ring[1:])):
            edges.append(f"({_text(zid)},{i},{x1}::double,{y1}::double,{x2}::double,{y2}::double)")
    return (
        "z(zone_id, zone_name, zone_type, infrastructure_type, severity, alert_all, min_x, min_y, max_x, max_y) as "
        f"(values {', '.join(heads)}), edges(zone_id, i, x1, y1, x2, y2) as (values {', '.join(edges)})"
    )


def inside(source: str = "p", name: str = "inz", where: str = "true") -> str:
    """(row_id, zone_id) of rows of `source` strictly inside a zone."""
    return f"""{name} as materialized (
  select q.row_id, z.zone_id from {source} q join z on {where}
     and q.latitude between z.min_y and z.max_y and q.longitude between z.min_x and z.max_x
   join edges on edges.zone_id = z.zone_id
  group by q.row_id, z.zone_id, q.latitude, q.longitude
  having sum(case when (y1 > q.latitude) <> (y2 > q.latitude)
              and q.longitude < (x2 - x1) * (q.latitude - y1) / nullif(y2 - y1, 0) + x1 then 1 else 0 end) % 2 = 1
     and not bool_or((x2 - x1) * (q.latitude - y1) = (y2 - y1) * (q.longitude - x1)
              and q.longitude between least(x1, x2) and greatest(x1, x2)
              and q.latitude between least(y1, y2) and greatest(y1, y2)))"""


def hav(a: str, b: str, c: str, d: str, radius: str = "3440.065") -> str:
    h = (
        f"(pow(sin(radians(({c})-({a}))/2),2) + cos(radians({a}))*cos(radians({c}))*pow(sin(radians(({d})-({b}))/2),2))"
    )
    return f"({radius} * 2 * atan2(sqrt({h}), sqrt(greatest(0, 1 - {h}))))"


def hav_m(a: str, b: str, c: str, d: str) -> str:
    return hav(a, b, c, d, "6371000.0")


def places(points) -> str:
    return ", ".join(f"({float(a)}::double, {float(b)}::double)" for a, b in points)


def throttled(source: str, name: str, key: str, cooldown: int, strict: bool = False, tie: str = "row_id") -> str:
    """Rows of `source` that survive the cooldown; `key` is an expression over it."""
    test = ">" if strict else ">="
    return f"""{name}_c as materialized (select ({key}) as _key, t_s as _t from {source} group by 1, 2),
{name}_r(_key, _t) as (
  select _key, min(_t) from {name}_c group by _key
  union all
  select c._key, min(c._t) from {name}_r r join {name}_c c on c._key = r._key and c._t {test} r._t + {cooldown} group by c._key),
{name} as materialized (
  select * exclude (_n) from (
    select s.*, row_number() over (partition by ({key}), t_s order by {tie}) as _n
    from {source} s join {name}_r on _key = ({key}) and _t = t_s) where _n = 1)"""


def mid_case(pairs, value: str, otherwise: str = "null") -> str:
    arms = " ".join(f"when '{m}' then '{c}'" for m, c in pairs)
    return f"(case {value} {arms} else {otherwise} end)"


def query(*parts: str) -> str:
    """All but the last part are CTEs."""
    return "with recursive " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def listed(values) -> str:
    return "(" + ", ".join(_text(v) if isinstance(v, str) else str(v) for v in values) + ")"


CABLE_FLAG = (
    "(case when mmsi is null or length(mmsi) < 3 then 'UNKNOWN' else "
    + mid_case(dims.mid_pairs("cable"), "substr(mmsi, 1, 3)", "substr(mmsi, 1, 3)")
    + " end)"
)
DISPLAY_FLAG = (
    "(case when mmsi is null or length(mmsi) < 3 then 'XX' else "
    + mid_case(dims.mid_pairs("display"), "substr(mmsi, 1, 3)", "substr(mmsi, 1, 3)")
    + " end)"
)
INVESTIGATOR_FLAG = mid_case(dims.mid_pairs("investigator"), "substr(mmsi, 1, 3)")
SPOOFING_FLAG = mid_case(dims.mid_pairs("spoofing"), "substr(mmsi, 1, 3)")
