"""Queries over the monthly record, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burncal.functions.constants import EVENT_MODEL, PROTOTYPES, REGIONS
from burncal.functions.scalars import rounded
from burncal.operators import exports, harmonize, models, series
from burncal.plans.detections import r, total
from burncal.sources.fixtures import BASELINE_END, calendar, detections, oracle

BEFORE = "2001-06"


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(spark, sf_dir)


def sampled_month_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonize.month_rows(detections(spark, sf_dir))


def overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonize.overlap_ratio(calendar(spark, sf_dir))


def unified_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonize.unified_series(calendar(spark, sf_dir))


def outlook_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonize.outlook_fused(calendar(spark, sf_dir))


def allsensor_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonize.all_sensor_months(calendar(spark, sf_dir))


def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonize.lag_features(calendar(spark, sf_dir))


def train_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = harmonize.train_climatology(calendar(spark, sf_dir), 1999)
    return found.select("region", "month", *(rounded(c, 6).alias(c) for c in ("clim_mean", "clim_std")))


def extreme_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonize.extreme_months(calendar(spark, sf_dir), 1999, 1.0).withColumn("z_next", rounded("z_next", 6))


def climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.climatology(unified_series(spark, sf_dir), BASELINE_END)


def anomaly_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.anomaly_z(unified_series(spark, sf_dir), BASELINE_END)


def latest_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.latest_anomalies(unified_series(spark, sf_dir), 3, BASELINE_END)


def notebook_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.notebook_anomaly(allsensor_month(spark, sf_dir))
    return found.withColumn("z", rounded("z", 6))


def annual_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.annual_totals(unified_series(spark, sf_dir))


def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.decomposition(unified_series(spark, sf_dir)).withColumn("trend", rounded("trend", 6))


def theil_sen(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.theil_sen(unified_series(spark, sf_dir))
    return found.select("region", "n", *(rounded(c, 6).alias(c) for c in ("slope", "intercept", "per_decade")))


def cusum_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.cusum_points(unified_series(spark, sf_dir))


def season_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.season_outlook(outlook_fused(spark, sf_dir), BEFORE)


def peak_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.peak_months(outlook_fused(spark, sf_dir), BEFORE)


def regime_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar(spark, sf_dir)
    return series.regime_features(harmonize.unified_series(rows), rows, BASELINE_END)


def regime_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.regime_match(regime_features(spark, sf_dir))


def calendar_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.calendar_heatmap(unified_series(spark, sf_dir))


def harmonic_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.harmonic_forecast(unified_series(spark, sf_dir))


def regime_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.regime_matrix(calendar(spark, sf_dir))


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture has no sample counts; a third of the estimate stands for them."""
    return exports.emissions(calendar(spark, sf_dir).withColumn("sampled", F.floor(F.col("est") / 3)))


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.event_scores(calendar(spark, sf_dir))


def calendar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.calendar_json(calendar(spark, sf_dir))


def outlook_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = outlook_fused(spark, sf_dir)
    return exports.outlook_json(fused, series.season_outlook(fused, BEFORE), series.peak_months(fused, BEFORE))


QUERIES = {
    "calendar_view": view, "sampled_month_rows": sampled_month_rows, "overlap_ratio": overlap_ratio, "unified_series": unified_series, "outlook_fused": outlook_fused, "allsensor_month": allsensor_month,
    "lag_features": lag_features, "train_climatology": train_climatology, "extreme_months": extreme_months, "climatology": climatology, "anomaly_z": anomaly_z, "latest_anomalies": latest_anomalies,
    "notebook_anomaly": notebook_anomaly, "annual_totals": annual_totals, "decomposition": decomposition, "theil_sen": theil_sen, "cusum_points": cusum_points, "season_outlook": season_outlook,
    "peak_months": peak_months, "regime_features": regime_features, "regime_match": regime_match, "calendar_heatmap": calendar_heatmap, "harmonic_forecast": harmonic_forecast, "regime_matrix": regime_matrix,
    "emissions": emissions, "event_scores": event_scores, "calendar_documents": calendar_documents, "outlook_documents": outlook_documents,
}

_PAIR = "select region, ym, max(case when sensor='MODIS-Terra' then est end) as m_est, max(case when sensor='VIIRS-SNPP' then est end) as v_est, max(case when sensor='MODIS-Terra' then frp end) as m_frp, max(case when sensor='VIIRS-SNPP' then frp end) as v_frp from cal where sensor in ('MODIS-Terra','VIIRS-SNPP') group by region, ym"
_RATIO = f"""select region, quantile_cont(cast(v_est as double)/m_est, 0.5) as ratio_count, quantile_cont(cast(v_frp as double)/greatest(1,m_frp), 0.5) as ratio_frp,
 {r('stddev_pop(cast(v_est as double)/m_est)/greatest(1e-6, avg(cast(v_est as double)/m_est))', 3)} as ratio_cv, count(*) as overlap_months,
 {r('cast(sum(cast(' + r('cast(v_est as double)/m_est', 3) + ' as decimal(18,3))) as double)/count(*)', 3)} as mean_ratio from pr where m_est>0 and v_est>0 group by region"""
_UNI = f"""select region, ym, "count", frp, scaled from (select region, ym, case when v_est is not null then v_est else {r('m_est*coalesce(ratio_count,1e0)', 0)} end as "count",
 case when v_est is not null then v_frp else {r('m_frp*coalesce(ratio_frp,1e0)', 0)} end as frp, v_est is null as scaled from pr left join ra using (region)) x where "count">0 or frp>0"""
_FUSED = f"select region, ym, coalesce(m_est, {r('cast(v_est as double)/coalesce(nullif(mean_ratio,0),8e0)', 0)}, 0) as est from pr left join ra using (region)"
_ALL = "select region, ym, est, frp, hi_conf, night, cast(hi_conf as double)/greatest(est,1) as hi_share, cast(night as double)/greatest(est,1) as night_share from (select region, ym, cast(sum(est) as bigint) as est, cast(sum(frp) as bigint) as frp, cast(sum(hi_conf) as bigint) as hi_conf, cast(sum(night) as bigint) as night from cal group by region, ym) x"
_MONTH, _YEAR = "cast(substring(ym,6,2) as int)", "cast(substring(ym,1,4) as int)"
_UNIFIED = {"pr": _PAIR, "ra": _RATIO, "uni": _UNI}
_CLIM = f"""select region, mo as month, {r('m', 0)} as mean, {r('s', 0)} as std, cast(first_value(mo) over (partition by region order by m desc, mo) as int) as peak_month, m>=0.7e0*max(m) over (partition by region) as in_window from
 (select a.region, a.mo, coalesce(avg("count"),0) as m, coalesce(stddev_pop("count"),0) as s from (select distinct region, cast(g.mo as int) as mo from uni, range(12) g(mo)) a left join (select * from uni where ym<'{BASELINE_END}') u on a.region=u.region and a.mo={_MONTH}-1 group by a.region, a.mo) x"""
_Z = f"""select u.region, ym, "count", {r('("count"-mean)/case when std<>0 then cast(std as double) else greatest(1e0, mean*0.3e0) end', 2)} as z from uni u join cl on u.region=cl.region and {_MONTH}-1=cl.month"""
_ANNUAL = f"""select *, total/(months/12e0) as normalized from (select region, {_YEAR} as year, cast(sum("count") as bigint) as total, count(*) as months from uni group by 1,2) y where months>=10"""
_LAG = """select region, ym, est, lag(est,1) over w as est_lag1, avg(lag3) over (partition by region order by ym rows between 2 preceding and current row) as est_lag3, lag(est,12) over w as est_lag12,
 lag(frp,1) over w as frp_lag1, lag(hi_share,1) over w as hic_lag1, lag(night_share,1) over w as night_lag1, lead(est,1) over w as est_next from (select *, lag(est,3) over (partition by region order by ym) as lag3 from am) x window w as (partition by region order by ym)"""
_TC = f"select region, {_MONTH} as month, avg(est) as clim_mean, greatest(1e0, coalesce(stddev_samp(est), avg(est)*0.6e0)) as clim_std from am where {_YEAR}<=1999 group by 1,2"
_PROFILE = f"select region, month, avg(x) as mean, coalesce(stddev_samp(x),0.6e0) as std from (select region, {_MONTH} as month, ln(1e0+est) as x, row_number() over (partition by region, {_MONTH} order by ym desc) as rn from fu where ym<'{BEFORE}') p where rn<=15 group by 1,2"
_BACK = lambda x: f"greatest(0, {r('exp(' + x + ')-1', 0)})"
_FEATURES = f"""select c.region, peak_month, {r('peak/greatest(1e0,med)', 2)} as seasonality, {r('sd/greatest(1e0,mn)', 3)} as interannual_cv, {r('nf', 3)} as night_fraction, {r('cast(frp as double)/greatest(1,cnt)', 1)} as mean_frp, {r('log10(greatest(1e0,med))', 2)} as log_median_count from
 (select region, max(peak_month) as peak_month, max(mean) as peak from cl group by 1) c join (select region, stddev_pop(t) as sd, avg(t) as mn from (select region, sum("count") as t from uni group by region, {_YEAR}) y group by 1) a using (region)
 join (select region, quantile_cont("count",0.5) as med, sum(frp) as frp, sum("count") as cnt from uni group by 1) w using (region) join (select region, cast(sum(night) as double)/greatest(1,sum(est)) as nf from cal where sensor='MODIS-Terra' group by 1) n using (region)"""
_F = ("seasonality", "interannual_cv", "night_fraction", "mean_frp", "log_median_count")
_PROTO = "select * from (values " + ", ".join(f"('{p[0]}',{p[2]},{','.join(f'{v}e0' for v in p[3:])})" for p in PROTOTYPES) + ") v(key,p_peak_month," + ",".join(f"p_{c}" for c in _F) + ")"
_MATCH1 = "select f.*, p.*, " + ", ".join(f"(sum(p_{c}) over w + {c})/9 as mean_{c}" for c in _F) + " from ft f, proto p window w as (partition by region)"
_MATCH2 = "select *, " + ", ".join(f"sqrt((sum((p_{c}-mean_{c})*(p_{c}-mean_{c})) over w + ({c}-mean_{c})*({c}-mean_{c}))/9) as sd_{c}" for c in _F) + " from m1 window w as (partition by region)"
_DIST = "sqrt((power(least(abs(peak_month-p_peak_month), 12-abs(peak_month-p_peak_month))/6e0, 2) + " + " + ".join(f"power(({c}-p_{c})/case when sd_{c}>0 then sd_{c} else 1 end, 2)" for c in _F) + ")/6)"
_X = ["ln(1e0+est)", "ln(1e0+mean3)", "ln(1e0+coalesce(ago,est))", "ln(1e0+frp)", "hi_share", "night_share", "sin(6.283185307179586e0*(mo%12+1)/12)", "cos(6.283185307179586e0*(mo%12+1)/12)"]
_X += [f"case when lower(region)='{k}' then 1e0 else 0e0 end" for k in list(REGIONS)[1:]]
_LOGIT = f"{EVENT_MODEL['intercept']!r}e0" + "".join(f" + ({c!r}e0)*(({x})-({m!r}e0))/({s!r}e0)" for x, m, s, c in zip(_X, EVENT_MODEL["mean"], EVENT_MODEL["scale"], EVENT_MODEL["coef"]))

ORACLES = {
    "calendar_view": oracle("select * from cal", "cal"),
    "sampled_month_rows": oracle(
        f"""select sensor, ym, n as sampled, cast(d as bigint) as days, {r('n*(d/2e0)', 0)} as est, {r('f*(d/2e0)', 0)} as frp, {r('f/n', 1)} as mean_frp, {r('hi*(d/2e0)', 0)} as hi_conf, {r('ni*(d/2e0)', 0)} as night from
 (select sensor, strftime(day,'%Y-%m') as ym, count(*) as n, max(day(last_day(day))) as d, {total('frp')} as f, count(case when coalesce(case when try_cast(conf_raw as double) is not null then try_cast(conf_raw as double)>=80 else trim(conf_raw)<>'' end, false) then 1 end) as hi, count(case when night then 1 end) as ni
  from det where day(day) in (least(8,day(last_day(day))), least(22,day(last_day(day)))) group by 1,2) x""",
        "det",
    ),
    "overlap_ratio": oracle("select * from ra", "cal", pr=_PAIR, ra=_RATIO),
    "unified_series": oracle("select * from uni", "cal", **_UNIFIED),
    "outlook_fused": oracle("select * from fu", "cal", pr=_PAIR, ra=_RATIO, fu=_FUSED),
    "allsensor_month": oracle("select * from am", "cal", am=_ALL),
    "lag_features": oracle(_LAG, "cal", am=_ALL),
    "train_climatology": oracle(f"select region, month, {r('clim_mean', 6)} as clim_mean, {r('clim_std', 6)} as clim_std from tc", "cal", am=_ALL, tc=_TC),
    "extreme_months": oracle(
        f"select region, ym, {r('z_next', 6)} as z_next, coalesce(cast(z_next>=1 as int),0) as y from (select l.region, l.ym, (est_next-coalesce(clim_mean,region_mean,cast(est as double)))/greatest(1e0, coalesce(clim_std, coalesce(clim_mean,region_mean,cast(est as double))*0.6e0)) as z_next from lg l left join tc on tc.region=l.region and tc.month=cast(substring(l.ym,6,2) as int) left join (select region, avg(est) as region_mean from am where cast(substring(ym,1,4) as int)<=1999 group by 1) rm on rm.region=l.region) q",
        "cal", am=_ALL, tc=_TC, lg=_LAG,
    ),
    "climatology": oracle("select * from cl", "cal", **_UNIFIED, cl=_CLIM),
    "anomaly_z": oracle("select *, abs(z)>=2 as unusual from zz", "cal", **_UNIFIED, cl=_CLIM, zz=_Z),
    "latest_anomalies": oracle('select region, ym, "count", z from (select *, row_number() over (partition by region order by ym desc) as rn from zz) q where rn<=3', "cal", **_UNIFIED, cl=_CLIM, zz=_Z),
    "notebook_anomaly": oracle(f"select region, ym, est, {r('(est-avg(est) over w)/(stddev_pop(est) over w+1e-9)', 6)} as z from am window w as (partition by region, {_MONTH})", "cal", am=_ALL),
    "annual_totals": oracle(_ANNUAL, "cal", **_UNIFIED),
    "decomposition": oracle(
        f"""select region, ym, observed, {r('trend', 6)} as trend, {r('s', 0)} as seasonal, {r('observed-trend-s', 0)} as resid from (select *, coalesce(avg(observed-trend) over (partition by region, {_MONTH}),0e0) as s from
 (select region, ym, "count" as observed, case when i>6 and i<=n-6 then a end as trend from (select *, row_number() over w as i, count(*) over (partition by region) as n, avg("count") over (partition by region order by ym rows between 6 preceding and 5 following) as a from uni window w as (partition by region order by ym)) x) y) z""",
        "cal", **_UNIFIED,
    ),
    "theil_sen": oracle(
        f"select region, n, {r('case when n<4 then 0 else s end', 6)} as slope, {r('case when n<4 then m else c end', 6)} as intercept, {r('(case when n<4 then 0 else s end)*120', 6)} as per_decade from (select x.region, count(*) as n, max(slope) as s, quantile_cont(y-slope*i,0.5) as c, avg(y) as m from x join sl using (region) group by 1) q",
        "cal", **_UNIFIED, x='select region, row_number() over (partition by region order by ym)-1 as i, cast("count" as double) as y from uni',
        sl="select a.region, quantile_cont((b.y-a.y)/(b.i-a.i),0.5) as slope from x a join x b on a.region=b.region and a.i<b.i group by 1",
    ),
    "cusum_points": oracle(
        f"""select region, year, score, {r('bf', 0)} as before, {r('af', 0)} as after from (select *, row_number() over (partition by region order by score desc, o) as rn from (select *, {r('least(0.99e0, abs(bf-af)/(sd+1e-9)/1.5e0)', 2)} as score from
 (select c.region, s.o, avg(case when k<=split then v end) as bf, avg(case when k>split then v end) as af, max(case when k=split+1 then year end) as year, max(sd) as sd from cu c join
 (select region, first(k order by cum, k) as split, 0 as o from cu group by 1 having min(cum)<0 union all select region, first(k order by cum desc, k), 1 from cu group by 1 having max(cum)>0) s on c.region=s.region and s.split<c.n group by c.region, s.split, s.o) p) q where score>0.25) z where rn<=2""",
        "cal", **_UNIFIED, an=_ANNUAL,
        cu="select * from (select region, year, v, k, n, sd, sum(v-m) over (partition by region order by year rows unbounded preceding) as cum from (select region, year, normalized as v, row_number() over (partition by region order by year) as k, count(*) over (partition by region) as n, avg(normalized) over (partition by region) as m, stddev_pop(normalized) over (partition by region) as sd from an) a where n>=6) b",
    ),
    "season_outlook": oracle(
        f"select a.region, a.ym, {_BACK('coalesce(mean,0e0)')} as mean, {_BACK('coalesce(mean,0e0)-coalesce(std,0.6e0)')} as lo, {_BACK('coalesce(mean,0e0)+coalesce(std,0.6e0)')} as hi from (select region, strftime(cast(last||'-01' as date) + to_months(cast(h as int)),'%Y-%m') as ym from (select region, max(ym) as last from fu group by 1) l, range(1,13) g(h)) a left join pf on pf.region=a.region and pf.month=cast(substring(a.ym,6,2) as int)",
        "cal", pr=_PAIR, ra=_RATIO, fu=_FUSED, pf=_PROFILE,
    ),
    "peak_months": oracle("select region, cast(rk as int) as rank, month from (select *, row_number() over (partition by region order by mean desc, month) as rk from pf) q where rk<=3", "cal", pr=_PAIR, ra=_RATIO, fu=_FUSED, pf=_PROFILE),
    "regime_features": oracle(_FEATURES, "cal", **_UNIFIED, cl=_CLIM),
    "regime_match": oracle(f"select region, key, {r('1e0/(1e0+d)', 3)} as similarity, cast(row_number() over (partition by region order by d, key) as int) as rank from (select *, {_DIST} as d from m2) q", "cal", **_UNIFIED, cl=_CLIM, ft=_FEATURES, proto=_PROTO, m1=_MATCH1, m2=_MATCH2),
    "calendar_heatmap": oracle(
        f'select u.region, {_YEAR} as year, ' + ", ".join(f'max(case when {_MONTH}={m} then "count" end) as m{m:02d}' for m in range(1, 13)) + ', max(mx) as max_count from uni u join (select region, max("count") as mx from uni group by 1) t using (region) group by 1,2',
        "cal", **_UNIFIED,
    ),
    "regime_matrix": oracle(
        f"""select region, months, total, {r('mean', 1)} as mean_monthly, peak_month, {r('pm', 1)} as peak_month_mean, {r('frp/1e6', 1)} as frp_millions, {r('season', 2)} as seasonality_index, {r('active', 1)} as active_months_pct from
 (select region, count(*) as months, cast(sum(est) as bigint) as total, avg(est) as mean, cast(sum(frp) as double) as frp, (max(est)-min(est))/greatest(avg(est),1e0) as season, count(case when est>mn*0.1e0 then 1 end)*100e0/count(*) as active from (select *, avg(est) over (partition by region) as mn from am) a group by 1) w
 join (select region, max(m) as pm, first(month order by m desc, month) as peak_month from (select region, {_MONTH} as month, avg(est) as m from am group by 1,2) b group by 1) p using (region)""",
        "cal", am=_ALL,
    ),
    "emissions": oracle(
        f"select *, {r('dry_matter_kt*1.613e-3', 2)} as co2_mt from (select *, {r('fre_tj*0.223e0', 1)} as dry_matter_kt from (select *, {r('frp_scaled_mw*1800e0/1e6', 1)} as fre_tj from (select region, {_YEAR} as year, cast(sum(frp) as bigint) as frp_mw, cast(sum(cast(frp*case when sampled>0 then cast(est as double)/sampled else 1e0 end as decimal(28,6))) as double) as frp_scaled_mw, cast(sum(est) as bigint) as est from (select *, est//3 as sampled from cal) s group by 1,2) a) b) c",
        "cal",
    ),
    "event_scores": oracle(
        f"""select region, strftime(cast(ym||'-01' as date)+to_months(1),'%Y-%m') as target_ym, {r('1e0/(1e0+exp(-z))', 3)} as p, case when 1e0/(1e0+exp(-z))>=0.5 then 'high' when 1e0/(1e0+exp(-z))>=0.25 then 'elevated' else 'low' end as band from (select *, {_LOGIT} as z from
 (select l.*, {_MONTH} as mo, a.est as ago from (select *, row_number() over w as i, count(*) over (partition by region) as n, cast(sum(est) over (partition by region order by ym rows between 2 preceding and current row) as double)/least(row_number() over w,3) as mean3 from am window w as (partition by region order by ym)) l
 left join (select region, strftime(cast(ym||'-01' as date)+to_months(12),'%Y-%m') as ym, est from am) a using (region, ym) where i=n and n>=15) q) e""",
        "cal", am=_ALL,
    ),
}


_SO = "select a.region" + ORACLES["season_outlook"].rpartition(") select a.region")[2]
ORACLES["calendar_documents"] = oracle(
    """select region, '{"region":"'||region||'","sensors":{'||sensors||'}'||coalesce(',"harmonization":'||block,'')||'}' as document from
 (select region, string_agg('"'||sensor||'":'||m, ',' order by sensor) as sensors from (select region, sensor, cast(to_json({'monthly': list({'ym': ym, 'est': est, 'frp': frp, 'hi_conf': hi_conf, 'night': night} order by ym)}) as varchar) as m from cal group by 1,2) x group by 1) s
 left join (select region, cast(to_json({'overlapMonths': any_value(overlap_months), 'meanRatioSNPPtoMODIS': any_value(mean_ratio), 'sample': list({'ym': ym, 'ratio': q, 'm': m_est, 's': v_est} order by ym)}) as varchar) as block from
 (select *, floor(cast(v_est as double)/m_est*1e3+0.5e0)/1e3 as q, row_number() over (partition by region order by ym desc) as rn from pr where m_est>0 and v_est>0) p join ra using (region) where rn<=6 group by 1) h using (region)""",
    "cal", pr=_PAIR, ra=_RATIO,
)
ORACLES["outlook_documents"] = oracle(
    """select region, cast(to_json({'region': region, 'history': hs, 'forecast': fo, 'peakMonths': pk}) as varchar) as document from
 (select region, list({'ym': ym, 'est': est} order by ym) as hs from (select *, row_number() over (partition by region order by ym desc) as rn from fu) x where rn<=36 group by 1) a
 join (select region, list({'ym': ym, 'mean': mean, 'lo': lo, 'hi': hi} order by ym) as fo from so group by 1) b using (region)
 join (select region, list(lpad(cast(month as varchar),2,'0') order by rk) as pk from (select *, row_number() over (partition by region order by mean desc, month) as rk from pf) q where rk<=3 group by 1) c using (region)""",
    "cal", pr=_PAIR, ra=_RATIO, fu=_FUSED, pf=_PROFILE, so=_SO,
)


def _regression() -> dict[str, str]:
    """CTEs that end in `fit`: the harmonic model by making its six columns orthogonal one after the other over the months that are known (w=1);
    the months ahead (w=0) go through the same steps."""
    angle = "2*pi()*(month-1)/12e0"
    columns = ["1e0", "cast(i as double)", f"sin({angle})", f"cos({angle})", f"sin(2*{angle})", f"cos(2*{angle})"]
    parts = {
        "hm": "select *, row_number() over (partition by region order by ym desc) as back, count(*) over (partition by region) as months from uni",
        "hk": 'select region, ym, ln(1e0+"count") as y, 1 as w, row_number() over (partition by region order by ym)-1 as i from hm where back<=216 and months>=36',
        "hr": "select region, ym, y, w, i, cast(substring(ym,6,2) as int) as month from hk union all select region, strftime(cast(last||'-01' as date)+to_months(cast(h as int)),'%Y-%m'), null, 0, n-1+h, month(cast(last||'-01' as date)+to_months(cast(h as int))) from (select region, max(ym) as last, count(*) as n from hk group by 1) l, range(1,13) g(h)",
        "h0": "select *, " + ", ".join(f"{c} as x{k}" for k, c in enumerate(columns)) + " from hr",
    }
    for k in range(6):
        less = "".join(f" - q{j}*(sum(w*x{k}*q{j}) over p)/(sum(w*q{j}*q{j}) over p)" for j in range(k))
        parts[f"h{k + 1}"] = f"select *, x{k}{less} as q{k} from h{k} window p as (partition by region)"
    said = " + ".join(f"q{j}*(sum(w*coalesce(y,0)*q{j}) over p)/(sum(w*q{j}*q{j}) over p)" for j in range(6))
    parts["h7"] = f"select *, {said} as z from h6 window p as (partition by region)"
    parts["h8"] = "select *, sqrt(avg(case when w=1 then (y-z)*(y-z) end) over p) as sd, sum(case when w=1 then (y-z)*(y-z) end) over p as rest, var_pop(y) over p * count(y) over p as spread from h7 window p as (partition by region)"
    return parts


ORACLES["harmonic_forecast"] = oracle(
    f"select region, ym, {r('greatest(0e0, exp(z)-1)', 0)} as mean, {r('greatest(0e0, exp(z-1.96e0*sd)-1)', 0)} as lo, {r('exp(z+1.96e0*sd)-1', 0)} as hi, {r('sd', 3)} as sigma, {r('greatest(0e0, 1-rest/spread)', 3)} as r2 from h8 where w=0",
    "cal", **_UNIFIED, **_regression(),
)
