"""Queries of picks, filters and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burncal.operators import cluster, harmonize, selections, series, summary, triage
from burncal.plans.clusters import _DB, _HULL, _STATS, _recursive, cluster_stats, labelled
from burncal.plans.detections import CONF, DET_CONF, ORACLES as DETECTIONS, r, total, weather_scores
from burncal.plans.series import _FUSED, _PAIR, _PROFILE, _RATIO, _UNIFIED, BEFORE, ORACLES as SERIES
from burncal.sources.fixtures import BBOX, calendar, detections, oracle


def hot_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selections.hot_core(selections.visible(detections(spark, sf_dir), ["VIIRS-SNPP", "VIIRS-NOAA20"])).select("pt_seq", "sensor", "frp")


def display_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selections.display_points(detections(spark, sf_dir), 6000)


def extreme_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selections.extreme_points(detections(spark, sf_dir))


def busy_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selections.busy_tiles(detections(spark, sf_dir), 6, 3)


def percent_of_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selections.percent_of_typical(harmonize.unified_series(calendar(spark, sf_dir)))


def months_to_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selections.months_to_peak(series.season_outlook(harmonize.outlook_fused(calendar(spark, sf_dir)), BEFORE), "2001-11")


def hull_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selections.cells_in_hulls(cluster.cluster_hulls(labelled(spark, sf_dir)), BBOX, 0.25)


def detection_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selections.detection_questions(detections(spark, sf_dir), "amazon")


def day_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detections(spark, sf_dir)
    return selections.contexts(summary.sensor_day_summary(rows, BBOX), summary.alert_level(rows), cluster_stats(spark, sf_dir), weather_scores(spark, sf_dir))


def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return triage.intent(turns, "text").select("conv_id", "turn", "intent")


def navigation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some turns end with a directive, some with one that is no JSON."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = F.when(F.col("conv_id") % 3 == 0, F.format_string(' NAVIGATE: {"region": "r%d", "date": "2024-01-%02d"} x', "turn", F.col("conv_id") % 28 + 1)).when(F.col("conv_id") % 3 == 1, " NAVIGATE: {nothing}").otherwise("")
    found = triage.navigation(turns.withColumn("answer", F.concat(F.coalesce("text", F.lit("")), said)))
    return found.select("conv_id", "turn", "region", "date")


def last_day_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selections.split_by_last_day(detections(spark, sf_dir))[1].select("pt_seq", "day")


QUERIES = {
    "hot_core": hot_core, "display_points": display_points, "extreme_points": extreme_points, "busy_tiles": busy_tiles, "percent_of_typical": percent_of_typical, "months_to_peak": months_to_peak,
    "hull_cells": hull_cells, "detection_questions": detection_questions, "day_contexts": day_contexts, "last_day_split": last_day_split,
    "question_intents": question_intents, "navigation_targets": navigation_targets,
}

_TY = "cast(floor((1e0-asinh(tan(radians(lat)))/3.141592653589793e0)/2*64) as int)"

ORACLES = {
    "hot_core": oracle("select pt_seq, sensor, frp from det where sensor in ('VIIRS-SNPP','VIIRS-NOAA20') and frp>=150", "det"),
    "display_points": oracle(f"select pt_seq, lon, lat, least(greatest(frp,0.5e0),600e0) as frp, coalesce({CONF},60) as conf from det order by frp desc, pt_seq limit 6000", "det"),
    "extreme_points": oracle("select pt_seq, day, sensor, frp from det order by frp desc, pt_seq limit 24", "det"),
    "busy_tiles": oracle(f"select day, x, y, n, cast(rk as int) as rank from (select *, row_number() over (partition by day order by n desc, x, y) as rk from (select day, cast(floor((lon+180)/360*64) as int) as x, {_TY} as y, count(*) as n from det where not night group by 1,2,3 having count(*)>=3) t) u where rk<=5", "det"),
    "percent_of_typical": oracle(f'select region, last, typical, {r("last*100e0/greatest(typical,1)", 1)} as pct from (select region, last("count" order by ym) as last, list_sort(list("count"))[count(*)//2+1] as typical from uni group by 1) x', "cal", **_UNIFIED),
    "months_to_peak": oracle(
        "select region, peak, (cast(substring(peak,1,4) as int)-2001)*12+cast(substring(peak,6,2) as int)-11 as months from (select region, first(ym order by mean desc, ym) as peak from so group by 1) x", "cal",
        pr=_PAIR, ra=_RATIO, fu=_FUSED, pf=_PROFILE, so=SERIES["season_outlook"].rpartition(") select a.region")[2].join(("select a.region", "")),
    ),
    "hull_cells": _recursive(
        """select distinct day, i, j from (select day, label, i, cast(unnest(range(j0, j1+1)) as int) as j from (select day, label, cast(unnest(range(i0, i1+1)) as int) as i, j0, j1 from
 (select day, label, cast(floor((min(ax)+74)/0.25e0) as bigint) as i0, cast(floor((max(ax)+74)/0.25e0) as bigint) as i1, cast(floor((min(ay)+12)/0.25e0) as bigint) as j0, cast(floor((max(ay)+12)/0.25e0) as bigint) as j1 from he group by 1,2 having count(*)>=3) b) c) t
 where not exists (select 1 from he e where e.day=t.day and e.label=t.label and (e.bx-e.ax)*((-12e0+(t.j+0.5e0)*0.25e0)-e.ay)-(e.by_-e.ay)*((-74e0+(t.i+0.5e0)*0.25e0)-e.ax) < 0)""",
        "det", **_DB, hp=_HULL["hp"], he=_HULL["he"],
    ),
    "question_intents": "select conv_id, turn, case " + " ".join(f"when regexp_matches(lower(text), '{pattern}') then '{name}'" for name, pattern in triage.INTENTS) + " else 'snapshot' end as intent from conversations",
    "navigation_targets": """with said as (select conv_id, turn, coalesce(text,'') || case conv_id%3 when 0 then printf(' NAVIGATE: {"region": "r%d", "date": "2024-01-%02d"} x', turn, conv_id%28+1) when 1 then ' NAVIGATE: {nothing}' else '' end as answer from conversations),
 found as (select conv_id, turn, regexp_extract(answer, 'NAVIGATE:\\s*(\\{[^}]+\\})', 1) as j from said)
 select conv_id, turn, case when json_valid(j) then json_extract_string(j, '$.region') end as region, case when json_valid(j) then json_extract_string(j, '$.date') end as date from found""",
    "detection_questions": oracle(
        f"select pt_seq, printf('Fire detection at %.2f, %.2f in amazon on %s, %s overpass: sensor %s, %.1f MW, confidence %d. What does it mean and what should be watched?', {r('lat', 2)}, {r('lon', 2)}, cast(day as varchar), case when night then 'night' else 'day' end, sensor, {r('frp', 1)}, coalesce({CONF},60)) as question from det", "det"
    ),
    "day_contexts": _recursive(
        f"""select day, cast(to_json({{'day': cast(day as varchar), 'total': total, 'frp': {r('frp', 0)}, 'level': level, 'sensors': sensors, 'clusters': clusters, 'classes': classes, 'top': coalesce(top, []), 'weather': weather}}) as varchar) as context from al
 join (select day, list({{'sensor': sensor, 'n': n, 'mean_frp': mean_frp, 'max_frp': max_frp, 'hi_pct': {r('hi_conf*100e0/n', 0)}, 'night_pct': night_pct}} order by sensor) as sensors from sd group by 1) x using (day)
 join (select day, count(label) as clusters, {{'MEGAFIRE': count(case when class='MEGAFIRE' then 1 end), 'ESTABLISHED': count(case when class='ESTABLISHED' then 1 end), 'EMERGING': count(case when class='EMERGING' then 1 end), 'SCATTERED': count(case when class='SCATTERED' then 1 end)}} as classes from al2 left join st using (day) group by 1) g using (day)
 join (select day, list({{'id': cluster_id, 'cls': class, 'n': n, 'frp_sum': {r('frp_sum', 0)}, 'spread_km': spread_km, 'night_pct': {r('night_pct', 0)}}} order by rn) filter (label is not null) as top from (select al2.day, st.* exclude (day), row_number() over (partition by al2.day order by frp_sum desc, label) as rn from al2 left join st on st.day=al2.day) q where rn<=5 group by 1) t using (day)
 join (select day, {{'score': score, 'verdict': verdict}} as weather from ws) w using (day)""",
        "det", "wx", dc=DET_CONF, **_DB, **_STATS,
        sd=f"select day, sensor, count(*) as n, {r(total('frp') + '/count(*)', 1)} as mean_frp, {r('max(frp)', 1)} as max_frp, count(case when conf>=80 then 1 end) as hi_conf, {r('count(case when night then 1 end)*100e0/count(*)', 1)} as night_pct from dc where lon between -74 and -46 and lat between -12 and 2 group by 1,2",
        al=f"select day, total, frp, case when total>=150 or frp>=2500 then 'RED' when total>=60 or frp>=1200 then 'ORANGE' when total>=20 then 'AMBER' else 'GREEN' end as level from (select day, count(*) as total, {total('frp')} as frp from det group by 1) q",
        al2="select day from al",
        ws="select day, score, verdict from (" + DETECTIONS["weather_scores"] + ") v",
    ),
    "last_day_split": oracle("select pt_seq, day from det where day=(select max(day) from det)", "det"),
}
