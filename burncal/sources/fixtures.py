"""Detection, calendar and weather tables in the shape of the engine, as views over general star-schema tables.

Each view is one SQL text that Spark and DuckDB both run; `{table}` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Area of interest of the view: west, south, east, north.
BBOX = (-74.0, -12.0, -46.0, 2.0)
BASELINE_END = "2001-01"

DETECTIONS = """
with b as (select event_id, ts, value, event_type, user_id%12 as c,
  cast(regexp_extract(props,'([0-9]+)',1) as int) as k, (event_id*7919) as h1, (event_id*104729) as h2 from {events})
select event_id as pt_seq, cast(ts as date) as day, cast(hour(ts) as int) as acq_hour,
 case event_type when 'click' then 'MODIS-Terra' when 'error' then 'MODIS-Aqua' when 'purchase' then 'VIIRS-SNPP' when 'signup' then 'VIIRS-NOAA20' else 'VIIRS-NOAA21' end as sensor,
 case when event_id%5=0 then cast(h1%2800000 as double)/100000 - 74 else cast((c*37)%28 as double) - 74 + cast(h1%200000 as double)/100000 end as lon,
 case when event_id%5=0 then cast(h2%1400000 as double)/100000 - 12 else cast((c*53)%14 as double) - 12 + cast(h2%200000 as double)/100000 end as lat,
 value as frp,
 case when event_type in ('click','error') then cast(k as string) when k<20 then 'l' when k<80 then 'n' else 'h' end as conf_raw,
 (hour(ts)<6 or hour(ts)>=18) as night
from b"""

CALENDAR = """
select r_name as region, sensor, ym, count(*) as est, cast(sum(l_quantity) as bigint) as frp,
  count(case when l_discount>=0.05 then 1 end) as hi_conf, count(case when l_linestatus='F' then 1 end) as night
from (select r_name, l_quantity, l_discount, l_linestatus, l_linenumber, substring(cast(l_shipdate as string),1,7) as ym,
   case l_returnflag when 'N' then 'MODIS-Terra' when 'A' then 'VIIRS-SNPP' else 'VIIRS-NOAA20' end as sensor
  from {lineitem} join {orders} on l_orderkey=o_orderkey join {customer} on o_custkey=c_custkey join {nation} on c_nationkey=n_nationkey join {region} on n_regionkey=r_regionkey) x
where (sensor='MODIS-Terra' and l_linenumber<=2) or (sensor='VIIRS-SNPP' and ym>='1998-01') or (sensor='VIIRS-NOAA20' and ym>='2000-01')
group by r_name, sensor, ym"""

WEATHER = """
select d as day, cast(10 + (i*7)%32 as double) as tmax, cast(18 + (i*11)%70 as double) as rh,
 cast((i*13)%50 as double) as wind, cast((i*5)%9 as double) as precip
from (select d, row_number() over (order by d) as i from (select distinct cast(ts as date) as d from {events}) y) z"""

TABLES = {"det": (DETECTIONS, ("events",)), "cal": (CALENDAR, ("lineitem", "orders", "customer", "nation", "region")), "wx": (WEATHER, ("events",))}


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, tables = TABLES[name]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pt_seq, day, acq_hour, sensor, lon, lat, frp, conf_raw, night."""
    return _view(spark, sf_dir, "det")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, sensor, ym, est, frp, hi_conf, night: one row for each month that a sensor has."""
    return _view(spark, sf_dir, "cal")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, tmax, rh, wind, precip."""
    return _view(spark, sf_dir, "wx")


def oracle(select: str, *views: str, **parts: str) -> str:
    """SQL that starts with the named views as common table expressions, then further ones, then a select."""
    ctes = [f"{v} as ({TABLES[v][0].format(**{t: t for t in TABLES[v][1]})})" for v in views]
    ctes += [f"{name} as ({text})" for name, text in parts.items()]
    return f"with {', '.join(ctes)} {select}"
