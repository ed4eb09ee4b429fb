"""Scalar functions as Column expressions; `register` gives some of them SQL names."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_LON, KM_LAT = 111.32, 110.57

#: Sensor names in display order.
SENSORS = ("MODIS-Terra", "MODIS-Aqua", "VIIRS-SNPP", "VIIRS-NOAA20", "VIIRS-NOAA21")
MODIS, VIIRS = SENSORS[:2], SENSORS[2:]


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x, digits: int = 0) -> Column:
    """floor(x * 10^n + 0.5) / 10^n, the half-up rounding of the whole engine; a long for no digits."""
    if not digits:
        return F.floor(col(x) + F.lit(0.5)).cast("long")
    return F.floor(col(x) * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def exact_sum(x) -> Column:
    """A sum that does not depend on the order of rows: of decimals with ten fractional digits, more than any feed carries."""
    return F.sum(col(x).cast("decimal(28,10)")).cast("double")


def clamped(x, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance."""
    a = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    b = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    s = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(s)))


def cos_lat(lat) -> Column:
    return F.greatest(F.lit(0.2), F.cos(F.radians(lat)))


def confidence(raw, low: int = 30, nominal: int = 60, high: int = 90) -> Column:
    """0 to 100 from a number or l/n/h; null where there is neither."""
    text = F.lower(F.trim(raw))
    number = F.floor(text.try_cast("double") + 0.5).cast("int")
    return F.when(text == "l", low).when(text == "n", nominal).when(text == "h", high).otherwise(number)


def confidence_training(raw) -> Column:
    """The map of the training snapshot: l/n/h are 20/50/90, anything else that is no number is 50."""
    return F.coalesce(confidence(raw, 20, 50, 90), F.lit(50))


def counts_as_high(raw) -> Column:
    """The rule of the monthly calendar: numbers of at least 80, and any letter."""
    number = F.trim(raw).try_cast("double")
    return F.coalesce(F.when(number.isNotNull(), number >= 80).otherwise(F.trim(raw) != ""), F.lit(False))


def sensor_of(satellite, feed_sensor) -> Column:
    """A feed of two satellites in one: names that start with T or A are Terra or Aqua."""
    first = F.upper(F.substring(F.trim(satellite), 1, 1))
    is_modis = col(feed_sensor).startswith("MODIS")
    return F.when(is_modis & (first == "T"), "MODIS-Terra").when(is_modis & (first == "A"), "MODIS-Aqua").otherwise(col(feed_sensor))


def time_label(hhmm) -> Column:
    """HHMM or HMM as HH:MM UTC."""
    padded = F.lpad(F.trim(hhmm), 4, "0")
    return F.concat(F.substring(padded, 1, 2), F.lit(":"), F.substring(padded, 3, 2), F.lit(" UTC"))


def hour_bucket(acquired) -> Column:
    """The first two digits if they are an hour, else null."""
    hour = F.regexp_extract(F.regexp_replace(acquired, ":", ""), r"^(\d{2})", 1).try_cast("int")
    return F.when(hour.between(0, 23), hour)


def in_box(lon, lat, box) -> Column:
    """Inclusive on all sides; plain comparisons, so they reach the scan."""
    west, south, east, north = box
    return col(lon).between(west, east) & col(lat).between(south, north)


def threat_score(frp, conf, night) -> Column:
    """0 to 100: up to 60 for power, 25 for confidence, 15 at night or 8 by day."""
    power = F.least(F.lit(60.0), F.log10(F.lit(1.0) + F.greatest(col(frp), F.lit(0.0))) / F.log10(F.lit(501.0)) * 60)
    sure = clamped(conf, 0, 100) / 100 * 25
    return rounded(power + sure + F.when(col(night), 15).otherwise(8))


def threat_label(score) -> Column:
    s = col(score)
    return F.when(s >= 80, "EXTREME").when(s >= 62, "HIGH").when(s >= 42, "MODERATE").otherwise("LOW")


def frp_band(frp) -> Column:
    f = col(frp)
    return F.when(f < 10, "SMOULDERING").when(f < 100, "SURFACE FIRE").when(f < 250, "INTENSE FRONT").otherwise("CONFLAGRATION")


VERDICTS = ("LOW", "MODERATE", "HIGH", "EXTREME")


def rule_verdict(frp, night) -> Column:
    """Bands 25, 120, 250; a moderate fire at night is high."""
    f = col(frp)
    by_power = F.when(f >= 250, "EXTREME").when(f >= 120, "HIGH").when(f >= 25, "MODERATE").otherwise("LOW")
    return F.when(col(night) & (by_power == "MODERATE"), "HIGH").otherwise(by_power)


def highest_verdict(a, b) -> Column:
    """The graver of two verdicts; one that is no verdict gives way."""
    rank = {v: i for i, v in enumerate(VERDICTS)}
    order = F.create_map(*(x for v, i in rank.items() for x in (F.lit(v), F.lit(i))))
    ra, rb = F.coalesce(order[col(a)], F.lit(-1)), F.coalesce(order[col(b)], F.lit(-1))
    return F.when(rb > ra, col(b)).otherwise(col(a))


def weather_score(tmax, rh, wind, rain3) -> Column:
    """0 to 100 from heat, dryness of the air, wind and rain of three days."""
    heat = clamped((col(tmax) - 10) / 32, 0.0, 1.0)
    dry_air = clamped((F.lit(88.0) - col(rh)) / 70, 0.0, 1.0)
    gale = clamped((col(wind) - 8) / 45, 0.0, 1.0)
    dry = clamped(F.lit(1.0) - col(rain3) / 12, 0.0, 1.0)
    return rounded(F.lit(100.0) * (F.lit(0.34) * heat + F.lit(0.24) * dry_air + F.lit(0.16) * gale + F.lit(0.26) * dry))


def weather_label(score) -> Column:
    s = col(score)
    return F.when(s >= 78, "EXTREME").when(s >= 62, "HIGH").when(s >= 45, "ELEVATED").when(s >= 28, "MODERATE").otherwise("LOW")


def cluster_class(n, frp_sum) -> Column:
    """Class of a fire object at run time."""
    n, s = col(n), col(frp_sum)
    return F.when((n >= 150) | (s >= 5000), "MEGAFIRE").when((n >= 40) | (s >= 1200), "ESTABLISHED").when(n >= 8, "EMERGING").otherwise("SCATTERED")


def complex_class(n, frp_sum) -> Column:
    """Class of a fire complex in the training exports."""
    n, s = col(n), col(frp_sum)
    return F.when((n >= 500) | (s >= 20000), "megafire").when((n >= 150) | (s >= 5000), "major").when(n >= 40, "active").otherwise("smoldering")


def weak_label(n, frp_sum) -> Column:
    """Training label of a cluster; both bounds count for the largest."""
    n, s = col(n), col(frp_sum)
    return F.when((n >= 800) & (s >= 25000), "MEGAFIRE").when(n >= 150, "ESTABLISHED").when(n >= 40, "EMERGING").otherwise("SCATTERED")


def month_distance(a, b) -> Column:
    """Distance of two months on the circle of twelve."""
    d = F.abs(col(a) - col(b))
    return F.least(d, F.lit(12) - d)


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(z)))


def linear(features: list[Column], mean: list[float], scale: list[float], coef: list[float], intercept: float) -> Column:
    """Logit of a standardized linear model as one expression."""
    z = F.lit(float(intercept))
    for x, m, s, c in zip(features, mean, scale, coef):
        z = z + F.lit(float(c)) * ((x - F.lit(float(m))) / F.lit(float(s or 1.0)))
    return z


def cosine(a, b) -> Column:
    """Cosine similarity of two arrays, with 1e-9 in the denominator."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-9))


def geo_score(distance) -> Column:
    """1 at the place, 0 from 60 degrees on, 0.25 where the distance is unknown."""
    return F.when(col(distance).isNull(), 0.25).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - col(distance) / 60))


def tile_x(lon, zoom: int) -> Column:
    return F.floor((col(lon) + 180) / 360 * (1 << zoom)).cast("int")


def tile_y(lat, zoom: int) -> Column:
    return F.floor((F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / F.lit(3.141592653589793)) / 2 * (1 << zoom)).cast("int")


def tile_lon(x, zoom: int) -> Column:
    return col(x) / (1 << zoom) * 360 - 180


def tile_lat(y, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (F.lit(1.0) - col(y) * 2 / (1 << zoom)))))


def elevation(red, green, blue) -> Column:
    """Metres from a terrain tile's pixel; the sea floor counts as 0."""
    return F.greatest(F.lit(0.0), col(red) * 256 + col(green) + col(blue) / 256 - 32768)


def bilinear(h00, h10, h01, h11, fx, fy) -> Column:
    top = col(h00) * (F.lit(1.0) - col(fx)) + col(h10) * col(fx)
    low = col(h01) * (F.lit(1.0) - col(fx)) + col(h11) * col(fx)
    return top * (F.lit(1.0) - col(fy)) + low * col(fy)


def surface_temperature(raw) -> Column:
    """Kelvin from the stored number; 0 is no value."""
    return F.when(col(raw) != 0, col(raw) * 0.02)


def emissivity(raw) -> Column:
    return F.when(col(raw) != 0, col(raw) * 0.02 + 0.49)


def short_number(x) -> Column:
    """1.2M, 3.4k, 56."""
    v = col(x)
    return F.when(v >= 1e6, F.concat(F.format_string("%.1f", v / 1e6), F.lit("M"))).when(v >= 1e3, F.concat(F.format_string("%.1f", v / 1e3), F.lit("k"))).otherwise(F.format_string("%d", rounded(v)))


def month_label(ym) -> Column:
    """2024-09 as Sep 2024."""
    return F.date_format(F.to_date(F.concat(col(ym), F.lit("-01"))), "MMM yyyy")


def next_month(ym, n: int = 1) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(col(ym), F.lit("-01"))), n), "yyyy-MM")


def month_of(ym) -> Column:
    """1 to 12."""
    return F.substring(ym, 6, 2).cast("int")


def year_of(ym) -> Column:
    return F.substring(ym, 1, 4).cast("int")


def adaptive_eps(box) -> float:
    """Search radius in degrees for an area."""
    span = max(box[2] - box[0], box[3] - box[1], 1)
    return min(0.9, max(0.14, float(f"{span / 45:.2f}")))


def without_thoughts(text) -> Column:
    """A model's answer without its marked thoughts."""
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def json_part(text) -> Column:
    """From the first { to the last }."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def register(spark: SparkSession) -> None:
    """SQL functions burncal_haversine_km, _cluster_class, _threat_score, _frp_band and _weather_score."""
    spark.sql("create or replace temporary function burncal_frp_band(frp double) returns string return case when frp < 10 then 'SMOULDERING' when frp < 100 then 'SURFACE FIRE' when frp < 250 then 'INTENSE FRONT' else 'CONFLAGRATION' end")
    spark.sql("create or replace temporary function burncal_cluster_class(n bigint, s double) returns string return case when n >= 150 or s >= 5000 then 'MEGAFIRE' when n >= 40 or s >= 1200 then 'ESTABLISHED' when n >= 8 then 'EMERGING' else 'SCATTERED' end")
    spark.sql("create or replace temporary function burncal_threat_score(frp double, conf double, night boolean) returns bigint return floor(least(60d, log10(1 + greatest(frp, 0d)) / log10(501d) * 60) + least(greatest(conf, 0d), 100d) / 100 * 25 + if(night, 15, 8) + 0.5d)")
    spark.sql("create or replace temporary function burncal_haversine_km(a double, b double, c double, d double) returns double return 2 * 6371d * asin(least(1d, sqrt(pow(sin((radians(c) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin((radians(d) - radians(b)) / 2), 2))))")
    spark.sql("create or replace temporary function burncal_weather_score(t double, rh double, w double, r double) returns bigint return floor(100 * (0.34d * least(greatest((t - 10) / 32, 0d), 1d) + 0.24d * least(greatest((88 - rh) / 70, 0d), 1d) + 0.16d * least(greatest((w - 8) / 45, 0d), 1d) + 0.26d * least(greatest(1 - r / 12, 0d), 1d)) + 0.5d)")
