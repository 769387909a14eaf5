"""Vessel positions derived from the `events` table, for tables that carry no positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.operators.history import running_sum, with_history

# The view definition shared with the SQL checks. `e` must have event_id, v, m, g
# and r (the report's number within the vessel, from 0).
REPORT_SQL = """
select event_id as row_id, t_s, message_type,
  case when m = 8 and g % 3 = 1 then '12345678' when m = 8 and g % 3 = 2 then '111111111'
       else concat(case g % 8 when 0 then '273' when 1 then '230' when 2 then '412' when 3 then '636'
                            when 4 then '265' when 5 then '613' when 6 then '571' else '209' end,
                   lpad(cast(v as varchar(6)), 6, '0')) end as mmsi,
  round(case m when 0 then 57e0 + (g % 5) * 5e-3 + r * 1.2e-2
       when 1 then 57.6e0 + (g % 5) * 5e-3
       when 2 then 57.58e0 + r * 5e-4
       when 3 then 55e0 + 2e-1 * (g % 8) + r * 8e-3
       when 4 then 55e0 + 2e-1 * (g % 8) + r * 8e-3
       when 5 then 58.5e0 + 1e-1 * (g % 8)
       when 6 then 58.5e0 + 1e-1 * (g % 8)
       when 7 then 57.1e0 + 1e-2 * ((r * 7) % 5)
       when 8 then 59e0 + case when r % 20 = 19 then 2e0 else 0e0 end
       else 54.72e0 + case when r between 5 and 39 then r * 1e-2 else 0e0 end end, 6) as latitude,
  round(case m when 0 then 21e0 + (g % 7) * 1e-2
       when 1 then 21e0
       when 2 then 21e0
       when 3 then 18e0 + (g % 5) * 5e-1
       when 4 then 18.02e0 + (g % 5) * 5e-1
       when 5 then 20e0 + (g % 11) * 1e-1
       when 6 then 20.004e0 + (g % 11) * 1e-1 + case when r % 30 >= 25 then 1e-1 else 0e0 end
       when 7 then 19.3e0 + 1e-2 * ((r * 3) % 5)
       when 8 then 22e0 + r * 1e-3
       else 20.4e0 end, 6) as longitude,
  case when m = 1 and r % 16 = 15 then null
       when m = 0 then 14e0 when m = 1 then 2e-1
       when m = 2 then case when r % 11 = 5 then 1.8e0 when r % 7 = 3 then 8e-1 else 3e-1 end
       when m = 3 then 10e0 when m = 4 then 1.05e1
       when m in (5, 6) then 1e0
       when m = 7 then round(((r * 5) % 9) * 8e-1, 1)
       when m = 8 then case when r % 13 = 0 then 1.023e2 when r % 17 = 0 then 6e1 else 5e0 end
       else 8e0 end as speed_over_ground,
  case when m = 1 and r % 16 = 15 then null when m = 7 then cast((r * 67) % 360 as double) when m = 8 then 9e1 else 0e0 end as course_over_ground,
  case when m = 8 then case when r % 9 = 0 then 2e2 else 9e1 end when m = 3 then 5.11e2 else 0e0 end as heading,
  case when m = 1 and r % 16 = 15 then null when m = 2 and r between 10 and 50 then 1 when m = 7 then 7 else 0 end as nav_status,
  case m when 7 then 30 when 5 then 80 when 6 then 70 when 2 then 70 when 9 then 80 when 0 then 79 when 8 then 37 when 1 then 52 else 60 end as ship_type,
  case when m = 8 then concat('NAME ', cast(cast(floor(r / 15.0) as int) as varchar(6))) else concat('VESSEL ', cast(v as varchar(6))) end as ship_name,
  case when m = 8 then case when r >= 30 then '7654321' else '1234567' end
       when m = 9 and g % 2 = 0 then concat('9', lpad(cast(v as varchar(6)), 6, '0')) else null end as imo_number
from k
"""
TIME_SQL = """
select *, 1704067200 + v % 60 + r * 150
         + case when m = 9 and r >= 40 then 93600 when m = 0 and r >= 30 then 2400 else 0 end as t_s,
         case when m = 1 and r % 16 = 15 then 5 else 1 end as message_type
from e
"""


def positions_from_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The position view: row_id, t_s, message_type, mmsi, latitude, longitude and attributes."""
    # The report number is a running count over a vessel's events; the slices keep a busy
    # vessel from landing in one task.
    timed = events.select(
        "event_id", "user_id", "ts", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t_s")
    )
    numbered = with_history(
        timed, running_sum("n", F.lit(1).cast("long")), key=("user_id",), order=("ts", "event_id"), seconds=86400
    )
    e = numbered.select(
        "event_id",
        F.col("user_id").alias("v"),
        (F.col("user_id") % 10).cast("int").alias("m"),
        F.floor(F.col("user_id") / 10.0).cast("int").alias("g"),
        (F.col("n") - 1).cast("int").alias("r"),
    )
    k = spark.sql("with e as (select * from {e}) " + TIME_SQL, e=e)
    return spark.sql("with k as (select * from {k}) " + REPORT_SQL, k=k)
