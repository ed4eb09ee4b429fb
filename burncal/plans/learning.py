"""Queries of what is learnt from the tables: regimes, logistic steps, footprints by day, votes of the forest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burncal.functions.constants import FOOTPRINT_MODEL
from burncal.functions.scalars import rounded
from burncal.operators import cluster, harmonize, logistic, models, raster, selections
from burncal.operators import regimes as groups
from burncal.plans import clusters
from burncal.plans.detections import CONF, r, total
from burncal.plans.series import ORACLES as SERIES
from burncal.session import cut
from burncal.sources.fixtures import BBOX, calendar, detections, oracle

LAGS = ["est_lag1", "est_lag12", "hic_lag1", "night_lag1"]
CELL = 0.25


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.regimes(groups.regime_features(detections(spark, sf_dir))).select("pt_seq", "regime", "distance")


def regime_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups.silhouette(cut(groups.regimes(groups.regime_features(detections(spark, sf_dir)))))
    return found.withColumn("silhouette", rounded("silhouette", 6))


def regime_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.group_profile(detections(spark, sf_dir).join(regimes(spark, sf_dir), "pt_seq"), "regime")


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags of each month and whether an extreme one follows."""
    rows = calendar(spark, sf_dir)
    return cut(harmonize.lag_features(rows).join(harmonize.extreme_months(rows, 1999, 1.0), ["region", "ym"]).select(*LAGS, "y").na.drop())


def logistic_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first step of the training of extreme months adds up: half the second derivatives, and the first ones on the diagonal."""
    rows = months(spark, sf_dir)
    mean, scale, weights = logistic.standards(rows, LAGS, "y")
    found = logistic.step_sums(rows, LAGS, "y", mean, scale, weights, np.zeros(len(LAGS) + 1))
    return found.select("i", "j", rounded("hessian", 6).alias("hessian"), rounded("gradient", 6).alias("gradient"))


def event_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the fitted model ranks the months that it has learnt."""
    rows = months(spark, sf_dir)
    return models.ranking_metrics(rows.select("y", logistic.fit(rows, LAGS).probability().alias("p")))


def footprint_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of every day against the hulls of its fires, on a raster of a quarter degree."""
    hulls = selections.cells_in_hulls(cluster.cluster_hulls(clusters.labelled(spark, sf_dir)), BBOX, CELL)
    west, south, east, north = BBOX
    inside = cut(hulls.filter(F.col("i").between(0, int((east - west) / CELL)) & F.col("j").between(0, int((north - south) / CELL))).withColumn("day", F.date_add("day", clusters.SEASON_DAYS)))
    cells = cut(raster.training_cells(clusters.in_season(spark, sf_dir), BBOX, cell=CELL, inside=inside))
    found = raster.footprint_overlap(cells, inside)
    return found.withColumns({"iou": rounded("iou", 6), "persistence_iou": rounded("persistence_iou", 6)})


def forest_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes in each cluster by what the forest says of its members."""
    said = clusters.forest_scores(spark, sf_dir).select("pt_seq", "behavior")
    return cluster.behavior_votes(clusters.labels_alone(spark, sf_dir).join(said, "pt_seq"))


QUERIES = {
    "regimes": regimes, "regime_silhouette": regime_silhouette, "regime_profile": regime_profile, "logistic_sums": logistic_sums, "event_training": event_training,
    "footprint_overlap": footprint_overlap, "forest_votes": forest_votes,
}

_CT = f"coalesce(case lower(trim(conf_raw)) when 'l' then 20 when 'n' then 50 when 'h' then 90 else {CONF} end, 50)"


def _regimes(k: int = groups.K, rounds: int = groups.ROUNDS) -> dict[str, str]:
    """CTEs that end in rg: start, rounds and groups, all on whole numbers."""
    u = [f"u{n}" for n in range(4)]
    d = "+".join(f"(p.{c}-g.{c})*(p.{c}-g.{c})" for c in u)
    whole = lambda x: f"cast(floor(coalesce({x}, 0e0)*1000000+0.5e0) as bigint)"
    parts = {"rf": f"select pt_seq, {whole('ln(1e0+frp)')} as u0, {whole(_CT + '/100e0')} as u1, {whole('acq_hour/23e0')} as u2, {whole('cast(cast(night as int) as double)')} as u3 from det"}
    parts["g0_0"] = f"select {', '.join(u)}, 0 as k from rf order by pt_seq limit 1"
    for n in range(1, k):
        before = " union all ".join(f"select * from g0_{m}" for m in range(n))
        parts[f"g0_{n}"] = f"select {', '.join(u)}, {n} as k from (select p.pt_seq, {', '.join(f'p.{c}' for c in u)}, min({d}) as d from rf p, ({before}) g group by all) x order by d desc, pt_seq limit 1"
    parts["g0"] = " union all ".join(f"select * from g0_{m}" for m in range(k))
    near = f"select * from (select p.*, g.k, {d} as d, row_number() over (partition by p.pt_seq order by {d}, g.k) as rn from rf p, {{0}} g) x where rn=1"
    for n in range(rounds):
        means = ", ".join(f"cast(sum({c})//count(*) as bigint) as {c}" for c in u)
        parts[f"a{n}"] = near.format(f"g{n}")
        parts[f"g{n + 1}"] = f"select {', '.join(f'coalesce(m.{c}, g.{c}) as {c}' for c in u)}, g.k from g{n} g left join (select k, {means} from a{n} group by k) m on m.k=g.k"
    parts["rg"] = near.format(f"g{rounds}")
    return parts


def _materialized(sql: str, parts: dict[str, str], *more: str) -> str:
    for name in (*parts, *more):
        sql = sql.replace(f" {name} as (", f" {name} as materialized (")
    return sql


def _grouped(select: str, **more: str) -> str:
    parts = _regimes()
    return _materialized(oracle(select, "det", **parts, **more), parts)


_OWN = "+".join(f"cast(p.u{n} as double)*cast(p.u{n} as double)" for n in range(4))
_TO = f"greatest({_OWN.replace('+', ' + ')} - 2*({' + '.join(f'cast(p.u{n} as double)*s.u{n}' for n in range(4))})/cast(s.n as double) + s.q/cast(s.n as double), 0e0)"
_SILHOUETTE = {
    "ss": f"select k, count(*) as n, cast(sum({'+'.join(f'cast(u{n} as hugeint)*u{n}' for n in range(4))}) as double) as q, {', '.join(f'cast(sum(u{n}) as double) as u{n}' for n in range(4))} from rg group by k",
    "sm": f"select p.pt_seq, max(case when s.k=p.k then s.n end) as n, max(case when s.k=p.k and s.n>1 then {_TO}*(cast(s.n as double)/(s.n-1)) end) as a, min(case when s.k<>p.k then {_TO} end) as b from rg p, ss s group by 1",
    "si": "select case when n>1 and greatest(a,b)>0 then (b-a)/greatest(a,b) else 0e0 end as s from sm",
}

#: Sums of the first step, row by row: place 0 is the intercept, 1 to 4 the standardized lags.
_STEP = {
    "ms": f"select row_number() over () as id, {', '.join(LAGS)}, y from (select l.*, e.y from ({SERIES['lag_features'].rpartition(') select')[2].join(('select', ''))}) l join ex e on e.region=l.region and e.ym=l.ym) x where {' and '.join(f'{c} is not null' for c in LAGS)}",
    "sd": "select " + ", ".join(f"avg({c}) as m{n}, case when stddev_pop({c})>0 then stddev_pop({c}) else 1e0 end as s{n}" for n, c in enumerate(LAGS)) + ", count(*) as n, count(case when y=1 then 1 end) as ones, count(case when y=0 then 1 end) as zeros from ms",
    "lx": "select id, y, n/(2e0*greatest(1, case when y=1 then ones else zeros end)) as w, unnest([0,1,2,3,4]) as i, unnest([1e0, " + ", ".join(f"({c}-m{n})/s{n}" for n, c in enumerate(LAGS)) + "]) as x from ms, sd",
}


def _overlap() -> dict[str, str]:
    """CTEs that end in fc: every raster cell of every target day with its layers, label and probability. Places beyond the ends are mirrored."""
    west, south, east, north = BBOX
    wide, high = int((east - west) / CELL) + 1, int((north - south) / CELL) + 1
    mirrored = lambda n: f"case when abs(v+o)>{n - 1} then {2 * (n - 1)}-abs(v+o) else abs(v+o) end"
    line = lambda v, c, n: f"select b, v as {v}, {mirrored(n)} as {c}, sum(k) as w from (select fk.*, unnest(range({n})) as v from fk) q group by 1, 2, 3"
    values = ("n", "frp", "last", "before")
    spec = ((1, "n"), (2, "n"), (3, "n"), (2, "frp"), (2, "last"), (2, "before"))
    layer = [f"coalesce(max(case when v.b={b} then v.{c}/case when m.{c}>0 then m.{c} else 1e0 end end), 0e0) as q{k}" for k, (b, c) in enumerate(spec)]
    features = [*(f"ln(1e0+q{k})" for k in range(6)), f"x*{CELL}e0/{east - west}e0", f"y*{CELL}e0/{north - south}e0", "sin(2e0*pi()*dayofyear(target)/365)", "cos(2e0*pi()*dayofyear(target)/365)"]
    z = " + ".join(f"({c!r}e0)*(({f})-({m!r}e0))/({d!r}e0)" for f, m, d, c in zip(features, FOOTPRINT_MODEL["mean"], FOOTPRINT_MODEL["scale"], FOOTPRINT_MODEL["coef"]))
    return {
        "hin": f"select day + {clusters.SEASON_DAYS} as day, i, j from hull where i between 0 and {wide - 1} and j between 0 and {high - 1}",
        "dc0": f"select day + {clusters.SEASON_DAYS} as day, i, j, count(*) as n, {total('frp')} as frp from (select day, frp, cast(floor((lon-({west}e0))/{CELL}e0) as int) as i, cast(floor((lat-({south}e0))/{CELL}e0) as int) as j from det) x where i between 0 and {wide - 1} and j between 0 and {high - 1} group by 1,2,3",
        "ah": "select day + age as target, age, min(age) over (partition by day + age) as young, i, j, n, frp from (select *, unnest([1,2,3,4]) as age from dc0) x",
        "cs": f"select target, i, j, cast(sum(n) as double) as n, {total('frp')} as frp, cast(sum(case when age=young then n else 0 end) as double) as last, cast(sum(case when age=2 then n else 0 end) as double) as before from ah where target in (select day from dc0) group by 1,2,3",
        "fk": f"select b, o, exp(-(o*o)/(2*g*g))/sum(exp(-(o*o)/(2*g*g))) over (partition by b) as k from (select *, unnest(range(-r, r+1)) as o from (select *, greatest(1, cast(floor(4*g+0.5e0) as bigint)) as r from (select b, width/{CELL}e0 as g from (values (1, 0.10e0), (2, 0.35e0), (3, 0.80e0)) b(b, width)) x) y) q",
        "fx": line("x", "i", wide),
        "fy": line("y", "j", high),
        "fh": f"select target, b, x, j, {', '.join(f'sum({c}*fx.w) as {c}' for c in values)} from cs join fx on fx.i=cs.i group by 1,2,3,4",
        "fv": f"select target, fh.b, x, y, {', '.join(f'sum({c}*fy.w) as {c}' for c in values)} from fh join fy on fy.b=fh.b and fy.j=fh.j group by 1,2,3,4",
        "fm": f"select target, b, {', '.join(f'max({c}) as {c}' for c in values)} from fv group by 1,2",
        "fl": f"select v.target, x, y, {', '.join(layer)} from fv v join fm m on m.target=v.target and m.b=v.b where v.target in (select target from cs group by 1 having sum(n)>=30) group by 1,2,3",
        "fc": f"select f.target, x, y, 1e0/(1e0+exp(-({FOOTPRINT_MODEL['intercept']!r}e0 + {z})))>=0.5e0 as said, floor(ln(1e0+q4)*1e9+0.5e0) as density, h.i is not null as hit from fl f left join hin h on h.day=f.target and h.i=x and h.j=y where greatest(q0, q1, q2, q3, q4, q5)>0.01e0",
        "fb": "select target, coalesce(quantile_cont(density, 0.6) filter (hit), quantile_cont(density, 0.95)) as bound from fc group by 1",
    }


def _hull_cells() -> str:
    from burncal.plans.selections import ORACLES as SELECTED

    return SELECTED["hull_cells"].rpartition(") select distinct")[2].join(("select distinct", ""))


def _overlapped() -> str:
    parts = _overlap()
    select = f"""select target, predicted, overlap, persisted, persisted_overlap, coalesce(fires, 0) as fires, {r('coalesce(overlap*1e0/nullif(predicted+coalesce(fires, 0)-overlap, 0), 0e0)', 6)} as iou, {r('coalesce(persisted_overlap*1e0/nullif(persisted+coalesce(fires, 0)-persisted_overlap, 0), 0e0)', 6)} as persistence_iou
 from (select target, count(case when said then 1 end) as predicted, count(case when said and hit then 1 end) as overlap, count(case when density>=bound then 1 end) as persisted, count(case when density>=bound and hit then 1 end) as persisted_overlap from fc join fb using (target) group by 1) a left join (select day as target, count(*) as fires from hin group by 1) b using (target)"""
    sql = clusters._recursive(select, "det", **clusters._DB, hp=clusters._HULL["hp"], he=clusters._HULL["he"], hull=_hull_cells(), **parts)
    return _materialized(sql, parts, "hull")


ORACLES = {
    "regimes": _grouped("select pt_seq, k as regime, d as distance from rg"),
    "regime_silhouette": _grouped(f"select (select count(*) from ss) as groups, count(*) as n, (select cast(sum(d) as double) from rg) as inertia, {r(total('s') + '/count(*)', 6)} as silhouette from si", **_SILHOUETTE),
    "regime_profile": _grouped(
        f"select k as regime, count(*) as n, {r(total('frp') + '/count(*)', 3)} as mean_frp, {r(f'cast(sum({_CT}) as double)/count(*)', 3)} as mean_conf, {r('count(case when night then 1 end)*1e0/count(*)', 3)} as night_frac, {r('cast(sum(acq_hour) as double)/count(*)', 3)} as mean_hour from det join rg using (pt_seq) group by 1"
    ),
    "logistic_sums": SERIES["extreme_months"].rpartition(") select region, ym")[0]
    + "), ex as (select region, ym" + SERIES["extreme_months"].rpartition(") select region, ym")[2] + "), "
    + ", ".join(f"{n} as materialized ({t})" for n, t in _STEP.items())
    + f" select cast(a.i as int) as i, cast(b.i as int) as j, {r('sum(a.w*0.25e0*a.x*b.x)', 6)} as hessian, {r('case when a.i=b.i then sum(a.w*(0.5e0-a.y)*a.x) else 0e0 end', 6)} as gradient from lx a join lx b on a.id=b.id and a.i<=b.i group by a.i, b.i",
    "footprint_overlap": _overlapped(),
}
