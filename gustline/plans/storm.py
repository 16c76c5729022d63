"""Queries over the storm operators, each with the SQL that a second engine answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.functions import geo, physics
from gustline.operators import catalog, gauges, grids, radar, skill
from gustline.sources.adapters import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
GRID = geo.Grid(0.01, -119.75, -0.01, 39.60, 32, 32)
BOX = (-119.65, 39.40, -119.55, 39.50)


def query(name: str, sql: str | None = None):
    """Register a function of (v), v(name) being a view or table, under this name."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda n: view(spark, sf_dir, n))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return put


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def scaled_r6(c: Column | str) -> Column:
    """Six places as DuckDB rounds a double: scaled, to a whole number, scaled back. r6 rounds the decimal instead, which differs where the seventh place is a 5 that the double falls just short of."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 1e6) / 1e6


_WIN = "CASE WHEN count(*) OVER w{n} = {n} THEN {e} END"
_TRAIL = (
    "a AS (SELECT ts, cell, greatest(coalesce(rate, 0), 0) * 2 / 60 AS a2, epoch(ts) AS s FROM v_scans), "
    "w AS (SELECT ts, cell, a2, CASE WHEN count(*) OVER w8 = 8 THEN (sum(a2) OVER w8 * 60 / 16 + sum(a2) OVER w7 * 60 / 14) / 2 END AS i15, "
    "CASE WHEN count(*) OVER w15 = 15 THEN sum(a2) OVER w15 * 2 END AS i30, CASE WHEN count(*) OVER w30 = 30 THEN sum(a2) OVER w30 END AS i60 FROM a WINDOW "
    + ", ".join(f"w{n} AS (PARTITION BY cell ORDER BY s RANGE BETWEEN {(n - 1) * 120} PRECEDING AND CURRENT ROW)" for n in (7, 8, 15, 30))
    + ")"
)


@query("win_01_i15", f"WITH {_TRAIL} SELECT ts, cell, round(a2, 6) AS a2, round(i15, 6) AS i15, round(i30, 6) AS i30, round(i60, 6) AS i60 FROM w")
def _(v):
    return radar.trailing_intensity(v("v_scans")).select("ts", "cell", r6("a2").alias("a2"), r6("i15").alias("i15"), r6("i30").alias("i30"), r6("i60").alias("i60"))


@query("agg_01_storm_fields", f"WITH {_TRAIL}, p AS (SELECT cell, ts, i15, row_number() OVER (PARTITION BY cell ORDER BY round(i15, 9) DESC, ts) AS k FROM w WHERE i15 > 0) SELECT w.cell, round(max(w.i15), 6) AS i15, round(max(w.i30), 6) AS i30, round(max(w.i60), 6) AS i60, round(max(w.a2) * 30, 6) AS i2, round(sum(w.a2), 6) AS total, round(any_value(hour(p.ts) + minute(p.ts) / 60.0), 6) AS tpki15 FROM w LEFT JOIN p ON p.cell = w.cell AND p.k = 1 GROUP BY w.cell")
def _(v):
    return radar.storm_fields(v("v_scans")).select("cell", *(r6(c).alias(c) for c in ("i15", "i30", "i60", "i2", "total", "tpki15")))


@query("agg_02_wet_hours", "WITH q AS (SELECT t, coalesce(max(value), 0) AS qmax FROM v_hours GROUP BY t) SELECT t, round(qmax, 6) AS qmax FROM q WHERE qmax > 2.5 ORDER BY qmax DESC, t LIMIT 24")
def _(v):
    h = v("v_hours")
    return radar.wet_hours(h.select("t", "value"), h.select("t").distinct(), 2.5, 24).select("t", r6("qmax").alias("qmax"))


_RUNS = "wet AS (SELECT DISTINCT t FROM v_hours WHERE value > 4), g AS (SELECT t, CASE WHEN epoch(t) - epoch(lag(t) OVER (ORDER BY t)) > 3600 THEN 1 ELSE 0 END AS gap FROM wet), r AS (SELECT t, CAST(sum(gap) OVER (ORDER BY t) AS INT) AS run FROM g)"


@query("win_09_runs", f'WITH {_RUNS} SELECT run, min(t) AS "start", max(t) AS "end", count(*) AS n FROM r GROUP BY run')
def _(v):
    return radar.contiguous_runs(v("v_hours").where("value > 4").select("t").distinct())


@query("win_16_spans", f"WITH {_RUNS}, b AS (SELECT run, min(t) AS a, max(t) AS z FROM r GROUP BY run) SELECT run, unnest(generate_series(a - INTERVAL 74 MINUTE, z, INTERVAL 2 MINUTE)) AS ts FROM b")
def _(v):
    return radar.stack_spans(radar.contiguous_runs(v("v_hours").where("value > 4").select("t").distinct()))


@query("win_14_wet_window", 'SELECT min(t) - INTERVAL 90 MINUTE AS "start", max(t) + INTERVAL 30 MINUTE AS "end" FROM v_hours WHERE value > 4')
def _(v):
    return radar.wet_window(v("v_hours"), 4.0)


@query("agg_03_multisensor_total", "SELECT cell, round(sum(greatest(coalesce(value, 0), 0)), 6) AS total, count(DISTINCT t) AS n_hours FROM v_hours GROUP BY cell")
def _(v):
    return radar.multisensor_total(v("v_hours")).select("cell", r6("total").alias("total"), "n_hours")


@query("agg_04_composite", "WITH t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM v_scans)) SELECT cell, max(rate) AS peak, count(DISTINCT ts) AS n_scans FROM v_scans WHERE ts IN (SELECT ts FROM t WHERE rn % ceil(n / 40.0) = 0) GROUP BY cell")
def _(v):
    return radar.composite(v("v_scans"), 40)


@query("agg_21_equal_scans", "SELECT cell, date_trunc('hour', ts) AS ts, CASE WHEN count(rate) = count(*) THEN round(avg(rate), 6) END AS rate FROM v_scans GROUP BY 1, 2")
def _(v):
    return radar.merge_equal_scans(v("v_scans").withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))).select("cell", "ts", r6("rate").alias("rate"))


@query("agg_12_report_min", "WITH g AS (SELECT station_id, (epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY station_id ORDER BY ts)))) / 60 AS gap FROM v_gauge_obs WHERE precip IS NOT NULL) SELECT station_id, round(median(gap), 6) AS report_min FROM g GROUP BY 1")
def _(v):
    return gauges.report_minutes(v("v_gauge_obs")).select("station_id", r6("report_min").alias("report_min"))


_MINUTES = (
    "o AS (SELECT station_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, sum(greatest(precip, 0)) AS p FROM v_gauge_obs WHERE precip IS NOT NULL GROUP BY 1, 2), "
    "c AS (SELECT *, sum(p) OVER (PARTITION BY station_id ORDER BY s) AS c, min(s) OVER (PARTITION BY station_id) AS s0, lead(s) OVER (PARTITION BY station_id ORDER BY s) AS s2 FROM o), "
    "d AS (SELECT *, lead(c) OVER (PARTITION BY station_id ORDER BY s) AS c2, max(s) OVER (PARTITION BY station_id) AS sn FROM c), "
    "n AS (SELECT station_id, any_value(s0) AS s0, CAST(ceil((max(sn) - any_value(s0)) / 60) AS BIGINT) AS last FROM d GROUP BY 1), "
    "k AS (SELECT station_id, s0, unnest(range(0, last + 1)) AS k FROM n), "
    "m AS (SELECT k.station_id, k.k, k.s0 + k.k * 60 AS s, CASE WHEN d.s2 IS NULL THEN d.c ELSE d.c + (d.c2 - d.c) * (k.s0 + k.k * 60 - d.s) / (d.s2 - d.s) END AS total FROM k ASOF JOIN d ON k.station_id = d.station_id AND k.s0 + k.k * 60 >= d.s), "
    "i AS (SELECT *, coalesce(total - lag(total) OVER (PARTITION BY station_id ORDER BY k), 0) AS mm FROM m)"
)


@query("ts_01_minutes", f"WITH {_MINUTES} SELECT station_id, count(*) AS n, round(sum(mm), 4) AS mm, round(max(total), 4) AS total, round(max(mm), 6) AS peak, min(s) AS first_s, max(s) AS last_s FROM i GROUP BY 1")
def _(v):
    return gauges.per_minute(v("v_gauge_obs")).groupBy("station_id").agg(F.count("*").alias("n"), F.round(F.sum("mm"), 4).alias("mm"), F.round(F.max("total"), 4).alias("total"), r6(F.max("mm")).alias("peak"), F.min("s").alias("first_s"), F.max("s").alias("last_s"))


_ROWS = "sum(mm) OVER (PARTITION BY station_id ORDER BY k ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


@query("agg_05_intensities", f"WITH {_MINUTES}, w AS (SELECT station_id, k, CASE WHEN k >= 4 THEN {_ROWS.format(n=4)} * 12 END AS i5, CASE WHEN k >= 15 THEN ({_ROWS.format(n=15)} * 60 / 16 + {_ROWS.format(n=13)} * 60 / 14) / 2 END AS i15, CASE WHEN k >= 29 THEN {_ROWS.format(n=29)} * 2 END AS i30, CASE WHEN k >= 59 THEN {_ROWS.format(n=59)} END AS i60 FROM i), p AS (SELECT station_id, count(*) AS n_min, max(i5) AS i5, max(i15) AS i15, max(i30) AS i30, max(i60) AS i60 FROM w GROUP BY 1), b AS (SELECT station_id, count(precip) AS n_obs, sum(greatest(precip, 0)) FILTER (precip IS NOT NULL) AS total FROM v_gauge_obs GROUP BY 1) SELECT b.station_id, n_obs, round(total, 5) AS total, n_min, round(i5, 5) AS i5, round(i15, 5) AS i15, round(i30, 5) AS i30, round(i60, 5) AS i60 FROM b LEFT JOIN p USING (station_id)")
def _(v):
    return gauges.intensities(v("v_gauge_obs")).select("station_id", "n_obs", "n_min", *(F.round(c, 5).alias(c) for c in ("total", "i5", "i15", "i30", "i60")))


@query("win_06_series", f"WITH {_MINUTES}, e AS (SELECT station_id, k, total, (total - lag(total, 5) OVER w) * 12 AS i5, ((total - lag(total, 16) OVER w) * 60 / 16 + (total - lag(total, 14) OVER w) * 60 / 14) / 2 AS i15, (total - lag(total, 60) OVER w) AS i60 FROM i WINDOW w AS (PARTITION BY station_id ORDER BY k)) SELECT station_id, count(i5) AS n5, count(i15) AS n15, count(i60) AS n60, round(max(i5), 5) AS i5, round(max(i15), 5) AS i15, round(max(i60), 5) AS i60 FROM e GROUP BY 1")
def _(v):
    s = gauges.report_series(v("v_gauge_obs"))
    return s.groupBy("station_id").agg(*(F.count(f"i{d}").alias(f"n{d}") for d in (5, 15, 60)), *(F.round(F.max(f"i{d}"), 5).alias(f"i{d}") for d in (5, 15, 60)))


def _scalar(name: str, source: str, columns: dict[str, tuple[Callable[[], Column], str]], keys: tuple[str, ...] = ("id", "line")) -> None:
    """A query of expressions row by row, rounded to six places; columns: name -> (Spark, SQL)."""
    sql = f"SELECT {', '.join(keys)}, {', '.join(f'round(CAST({s} AS DOUBLE), 6) AS {c}' for c, (_, s) in columns.items())} FROM {source}"
    query(name, sql)(lambda v: v(source).select(*keys, *(r6(c().cast("double")).alias(n) for n, (c, _) in columns.items())))


_Z = "pow(pow(10, least(dbz, 53.0) / 10) / 300, 1 / 1.4)"
_Z = f"CASE WHEN dbz IS NOT NULL THEN {_Z} END"
_ZZ = "CASE WHEN dbz IS NOT NULL AND zdr IS NOT NULL THEN 0.0142 * pow(pow(10, least(dbz, 53.0) / 10), 0.770) * pow(pow(10, least(greatest(zdr, 0), 4) / 10), -1.67) END"
_K = "44 * pow(least(greatest(kdp, 0), 7), 0.822)"
_scalar("prj_01_accumulation", "v_gates", {"mm": (lambda: physics.to_accumulation(F.col("kdp"), 15), "kdp * 15 / 60"), "back": (lambda: physics.from_accumulation(F.col("kdp"), 15), "kdp * 60 / 15")})
_scalar("prj_03_z_to_rate", "v_gates", {"rate": (lambda: physics.z_to_rate(F.col("dbz"), cap=53.0), _Z), "tropical": (lambda: physics.z_to_rate(F.col("dbz"), *physics.RATE_RELATIONS["tropical"]), "pow(pow(10, dbz / 10) / 250, 1 / 1.2)")})
_scalar("prj_04_zzdr_to_rate", "v_gates", {"rate": (lambda: physics.zzdr_to_rate(F.col("dbz"), F.col("zdr"), 53.0), _ZZ)})
_scalar("prj_05_kdp_to_rate", "v_gates", {"rate": (lambda: physics.kdp_to_rate(F.col("kdp")), _K)})
_scalar("prj_06_blend", "v_gates", {"rate": (lambda: physics.blend(physics.kdp_to_rate(F.col("kdp")), physics.z_to_rate(F.col("dbz"), cap=53.0), F.col("dbz"), True), f"CASE WHEN dbz >= 35 AND {_K} > 0 THEN {_K} ELSE {_Z} END")})
_scalar("prj_16_severity", "v_dnbr", {"usgs": (lambda: physics.severity(F.col("v")), "CASE WHEN v IS NOT NULL THEN (v >= 0.1)::INT + (v >= 0.27)::INT + (v >= 0.44)::INT + (v >= 0.66)::INT END"), "barc4": (lambda: physics.severity(F.col("v"), "barc4"), "CASE WHEN v IS NOT NULL THEN (v >= 0.125)::INT + (v >= 0.25)::INT + (v >= 0.5)::INT END")})
_scalar("prj_17_severity_mask", "v_dnbr", {"burnt": (lambda: physics.severity_mask(F.col("v"), ["moderate", "high"]).cast("int"), "coalesce((v >= 0.25)::INT, 0)")})
_scalar("prj_13_humidity", "v_gates", {"rh": (lambda: physics.relative_humidity(F.col("kdp") * 6, F.col("kdp") * 6 - F.col("rhohv") * 9), "exp(17.625 * (kdp * 6 - rhohv * 9) / (243.04 + kdp * 6 - rhohv * 9)) / exp(17.625 * kdp * 6 / (243.04 + kdp * 6))")})
_scalar("prj_14_evaporation", "v_gates", {"f": (lambda: physics.evaporation_factor(F.col("dbz") / 2, F.col("kdp"), F.col("rhohv")), "CASE WHEN dbz IS NULL THEN NULL WHEN dbz <= 0 THEN 1 ELSE least(1, greatest(0, pow(greatest(pow(greatest(dbz / 2, 0), 0.35) - 0.35 * (1 - rhohv) * kdp, 0), 1 / 0.35) / (dbz / 2))) END")})
_scalar("prj_15_beam_height", "v_gates", {"h": (lambda: physics.beam_height_m(F.lit(1500.0), F.col("kdp") * 20000, F.lit(0.5)), "1500 + kdp * 20000 * sin(radians(0.5)) + pow(kdp * 20000, 2) / (2 * 4.0 / 3 * 6371000)")})
_scalar("prj_23_climate_depth", "v_gates", {"i": (lambda: physics.depth_to_intensity(F.col("kdp") * 1000, 15), "kdp * 25.4 * 60 / 15")})
_scalar("prj_22_units", "v_flow", {"cms": (lambda: F.col("cfs") * 0.028316846592, "cfs * 0.028316846592"), "stage_m": (lambda: F.col("stage") * 0.3048, "stage * 0.3048")}, ("site", "seq"))
_HAV = "2 * 6371 * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"
_scalar("prj_24_distances", "v_points", {"km": (lambda: geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(39.5), F.lit(-119.6)), _HAV.format(a="lat", b="39.5", c="lon", d="-119.6")), "box_km": (lambda: geo.bbox_distance_km(F.col("lon"), F.col("lat"), BOX), f"sqrt(pow(greatest({BOX[0]} - lon, 0, lon - ({BOX[2]})), 2) + pow(greatest({BOX[1]} - lat, 0, lat - {BOX[3]}), 2)) * 111.32"), "utm": (lambda: geo.utm_epsg(F.col("lon"), F.col("lat")), "floor((lon + 180) / 6) + 1 + 32600")}, ("id",))
_scalar("flt_04_stations", "v_points", {"keep": (lambda: ((geo.bbox_distance_km(F.col("lon"), F.col("lat"), BOX) <= 5) & (F.col("val") > 1) & F.coalesce(F.col("report_min") <= 60, F.lit(True))).cast("int"), f"(sqrt(pow(greatest({BOX[0]} - lon, 0, lon - ({BOX[2]})), 2) + pow(greatest({BOX[1]} - lat, 0, lat - {BOX[3]}), 2)) * 111.32 <= 5 AND val > 1 AND coalesce(report_min <= 60, true))::INT")}, ("id",))


def _hydro(v):
    return v("v_gates").withColumn("h", physics.hydro_select(F.col("dbz"), F.col("zdr"), F.col("rhohv"), physics.z_to_rate(F.col("dbz"), cap=53.0), physics.kdp_to_rate(F.col("kdp")), physics.zzdr_to_rate(F.col("dbz"), F.col("zdr"), 53.0)))


_HYDRO = f"b AS (SELECT *, {_Z} AS rz, {_ZZ} AS rzz, {_K} AS rk FROM v_gates), h AS (SELECT *, CASE WHEN dbz IS NULL THEN 0 WHEN rhohv < 0.85 THEN 4 WHEN dbz >= 45 AND zdr <= 0.8 THEN 3 WHEN dbz >= 35 AND rzz IS NOT NULL THEN 2 ELSE 1 END AS class, CASE WHEN rk > 0 THEN least(rk, 1.5 * rz) ELSE rz END AS rh FROM b), s AS (SELECT *, CASE class WHEN 1 THEN rz WHEN 2 THEN rzz WHEN 3 THEN rh WHEN 4 THEN 0 END AS rate, CASE class WHEN 1 THEN rz WHEN 2 THEN least(rz, rzz) WHEN 3 THEN least(rh, rz) WHEN 4 THEN 0 END AS lo, CASE class WHEN 1 THEN rz WHEN 2 THEN greatest(rz, rzz) WHEN 3 THEN greatest(rh, rz) WHEN 4 THEN 0 END AS hi FROM h)"


@query("prj_07_hydro_select", f"WITH {_HYDRO} SELECT id, line, class, round(rate, 6) AS rate, round(lo, 6) AS lo, round(hi, 6) AS hi FROM s")
def _(v):
    return _hydro(v).select("id", "line", "h.class", r6("h.rate").alias("rate"), r6("h.lo").alias("lo"), r6("h.hi").alias("hi"))


@query("agg_20_hydro_usage", f"WITH {_HYDRO}, u AS (SELECT line, count(*) FILTER (class = 1 AND rate > 1) AS n1, count(*) FILTER (class = 2 AND rate > 1) AS n2, count(*) FILTER (class = 3 AND rate > 1) AS n3, count(*) FILTER (class = 4) AS n4 FROM s GROUP BY line) SELECT *, CASE greatest(n1, n2, n3, n4) WHEN 0 THEN 0 WHEN n1 THEN 1 WHEN n2 THEN 2 WHEN n3 THEN 3 ELSE 4 END AS relmode FROM u")
def _(v):
    return radar.hydro_usage(_hydro(v).select("line", "h.class", "h.rate"), ["line"])


_AB = "j AS (SELECT coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col, a.v AS a, b.v AS b FROM v_field_a a FULL JOIN v_field_b b ON a.row = b.row AND a.col = b.col)"
_VIRGA = "CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) < 10 THEN 255 WHEN greatest(a, 0.1) <= b / 1.2 THEN 2 WHEN a / greatest(b, 0.1) >= 1.2 THEN 1 ELSE 0 END"


def _both(v):
    return v("v_field_a").withColumnRenamed("v", "a").join(v("v_field_b").withColumnRenamed("v", "b"), ["row", "col"], "full")


@query("prj_10_virga", f"WITH {_AB} SELECT row, col, {_VIRGA} AS class, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round(a / greatest(b, 0.1), 6) END AS ratio FROM j")
def _(v):
    return _both(v).select("row", "col", physics.virga_class(F.col("a"), F.col("b"), 10.0, 1.2).alias("class"), r6(physics.support_ratio(F.col("a"), F.col("b"))).alias("ratio"))


@query("agg_19_virga_summary", f"WITH {_AB}, c AS (SELECT {_VIRGA} AS class FROM j) SELECT class, count(*) AS n, CASE WHEN class < 255 THEN round(count(*) * 100.0 / sum(CASE WHEN class < 255 THEN count(*) END) OVER (), 6) END AS percent FROM c GROUP BY class")
def _(v):
    c = _both(v).select(physics.virga_class(F.col("a"), F.col("b"), 10.0, 1.2).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    total = c.where("class < 255").agg(F.sum("n").alias("all"))
    return c.crossJoin(F.broadcast(total)).select("class", "n", r6(F.when(F.col("class") < 255, F.col("n") * 100.0 / F.col("all"))).alias("percent"))


@query("prj_34_anomaly", f"WITH {_AB} SELECT row, col, CASE WHEN b > 0.1 THEN round(a / b, 6) END AS anom FROM j")
def _(v):
    return _both(v).select("row", "col", r6(physics.anomaly(F.col("a"), F.col("b"))).alias("anom"))


_RI = "p AS (SELECT point, ari, i, lead(ari) OVER w AS ari2, lead(i) OVER w AS i2, row_number() OVER w AS k, max(i) OVER (PARTITION BY point) AS top, count(*) OVER (PARTITION BY point) AS n FROM v_pf WINDOW w AS (PARTITION BY point ORDER BY ari)), x AS (SELECT id, val, id % 25 AS point FROM v_points)"


@query("prj_35_recurrence", f"WITH {_RI} SELECT x.id, round(max(CASE WHEN x.val > 0 AND x.val <= p.top AND p.k < p.n AND (x.val >= p.i OR p.k = 1) AND (x.val < p.i2 OR p.k = p.n - 1) THEN exp(ln(p.ari) + (ln(x.val) - ln(p.i)) * (ln(p.ari2) - ln(p.ari)) / (ln(p.i2) - ln(p.i))) END), 6) AS years, coalesce(bool_or(x.val > p.top), false) AS above_top FROM x LEFT JOIN p USING (point) GROUP BY x.id")
def _(v):
    curves = v("v_pf").groupBy("point").agg(F.array_sort(F.collect_list(F.struct("ari", "i"))).alias("curve"))  # ten rows a point
    t = v("v_points").withColumn("point", (F.col("id") % 25).cast("int")).join(curves, "point", "left")
    ri = physics.recurrence_interval(F.col("val"), F.col("curve"))
    return t.select("id", r6(F.when(ri != float("inf"), ri)).alias("years"), F.coalesce(ri == float("inf"), F.lit(False)).alias("above_top"))


_AT = "s AS (SELECT p.*, f.v AS radar FROM v_points p LEFT JOIN v_field_b f ON f.row = floor((lat - 39.60) / -0.01) AND f.col = floor((lon + 119.75) / 0.01))"


def _sampled(v):
    return skill.sample_points(v("v_points"), v("v_field_b").withColumnRenamed("v", "radar"), GRID, ["radar"])


@query("jon_01_sample", f"WITH {_AT} SELECT id, round(radar, 6) AS radar, round(radar - val, 6) AS resid FROM s")
def _(v):
    return _sampled(v).select("id", r6("radar").alias("radar"), r6(F.col("radar") - F.col("val")).alias("resid"))


@query("agg_06_comparison_stats", f"WITH {_AT}, l AS (SELECT 'i15' AS metric, val AS g, radar AS r FROM s WHERE report_min <= 30 UNION ALL SELECT 'total', val * 2, radar FROM s UNION ALL SELECT 'none', NULL, radar FROM s), m AS (SELECT unnest(['i15', 'total', 'none']) AS metric) SELECT m.metric, count(l.g + l.r) AS n, round(avg(g) FILTER (r IS NOT NULL), 6) AS gauge_mean, round(avg(r) FILTER (g IS NOT NULL), 6) AS radar_mean, round(avg(r - g), 6) AS bias, round(sqrt(avg(pow(r - g, 2))), 6) AS rmse, round(avg(abs(r - g)), 6) AS mae, round(CASE WHEN stddev_pop(g) FILTER (r IS NOT NULL) > 0 THEN corr(g, r) END, 6) AS corr, round(sum(r) FILTER (g IS NOT NULL) / nullif(sum(g) FILTER (r IS NOT NULL), 0), 6) AS ratio FROM m LEFT JOIN l USING (metric) GROUP BY 1")
def _(v):
    t = _sampled(v).withColumn("v2", F.col("val") * 2).withColumn("nil", F.lit(None).cast("double"))
    s = skill.comparison_stats(t, {"i15": ("val", "radar"), "total": ("v2", "radar"), "none": ("nil", "radar")}, max_report_min=30)
    return s.select("metric", "n", *(r6(c).alias(c) for c in ("gauge_mean", "radar_mean", "bias", "rmse", "mae", "corr", "ratio")))


@query("agg_09_mean_field_bias", f"WITH {_AT} SELECT round(greatest(coalesce(sum(val) / nullif(sum(radar), 0), 1), 0), 6) AS factor FROM s WHERE radar > 0 AND val IS NOT NULL")
def _(v):
    return skill.mean_field_bias(_sampled(v)).select(r6("factor").alias("factor"))


_XY = "(lon + 119.6) * (111320 * cos(radians(39.5))) AS x, (lat - 39.5) * 111320 AS y"


def _in_metres(df):
    x, y = geo.local_metres(F.col("lon"), F.col("lat"), -119.6, 39.5)
    return df.withColumn("x", x).withColumn("y", y)


@query("agg_10_leave_one_out", f"WITH {_AT}, g AS (SELECT id, val, radar, {_XY} FROM s WHERE radar IS NOT NULL AND val IS NOT NULL), o AS (SELECT a.id, a.val, a.radar, b.val AS v, b.radar AS r, 1 / pow(greatest(1, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 2) AS w, b.val > 0 AND b.radar > 0 AS wet FROM g a JOIN g b ON a.id <> b.id), p AS (SELECT id, any_value(val) AS val, any_value(radar) AS radar, CASE WHEN sum(r) > 0 THEN sum(v) / sum(r) ELSE 1 END AS f, count(*) FILTER (wet) AS nw, sum(CASE WHEN wet THEN least(2.5, greatest(-2.5, ln(v / r))) * w END) / nullif(sum(CASE WHEN wet THEN w END), 0) AS l, sum(w * ln(1 + greatest(r, 0))) / sum(w) AS lr, sum(w * ln(1 + greatest(v, 0))) / sum(w) AS lv FROM o GROUP BY id), e AS (SELECT 'raw' AS method, val, radar AS est FROM p UNION ALL SELECT 'mfb', val, radar * f FROM p UNION ALL SELECT 'lbc', val, CASE WHEN nw >= 3 THEN radar * exp(l) ELSE radar * f END FROM p UNION ALL SELECT 'cm', val, greatest(exp(ln(1 + greatest(radar, 0)) - lr + lv) - 1, 0) FROM p) SELECT method, count(*) AS n, round(sqrt(avg(pow(est - val, 2))), 6) AS rmse, round(avg(abs(est - val)), 6) AS mae, round(avg(est - val), 6) AS bias, round(sum(est) / nullif(sum(val), 0), 6) AS ratio FROM e GROUP BY 1")
def _(v):
    return skill.leave_one_out(_in_metres(_sampled(v))).select("method", "n", *(r6(c).alias(c) for c in ("rmse", "mae", "bias", "ratio")))


def _cells(v):
    c = v("v_field_b").withColumnRenamed("v", "radar").withColumn("lon", GRID.x(F.col("col"))).withColumn("lat", GRID.y(F.col("row")))
    return _in_metres(c).select("row", "col", "x", "y", "radar")


_CELLS = f"{_AT}, g AS (SELECT id, val, radar, {_XY} FROM s), c AS (SELECT row, col, v AS radar, {_XY} FROM (SELECT *, -119.75 + (col + 0.5) * 0.01 AS lon, 39.60 - (row + 0.5) * 0.01 AS lat FROM v_field_b))"
_W = "1 / pow(greatest(1, sqrt(pow(c.x - g.x, 2) + pow(c.y - g.y, 2))), 2)"


@query("arr_09_local_bias", f"WITH {_CELLS} SELECT c.row, c.col, round(any_value(c.radar) * exp(sum({_W} * least(2.5, greatest(-2.5, ln(g.val / g.radar)))) / sum({_W})), 6) AS merged FROM c, g WHERE g.val > 0 AND g.radar > 0 GROUP BY 1, 2")
def _(v):
    return skill.local_bias(_cells(v), _in_metres(_sampled(v))).select("row", "col", r6("merged").alias("merged"))


@query("arr_10_conditional_merge", f"WITH {_CELLS}, w AS (SELECT c.row, c.col, any_value(c.radar) AS radar, sum({_W} * ln(1 + g.radar)) / sum(CASE WHEN g.radar IS NOT NULL THEN {_W} END) AS a, sum({_W} * ln(1 + g.val)) / sum(CASE WHEN g.val IS NOT NULL THEN {_W} END) AS b FROM c, g GROUP BY 1, 2) SELECT row, col, round(greatest(exp(ln(1 + radar) - a + b) - 1, 0), 6) AS merged FROM w")
def _(v):
    return skill.conditional_merge(_cells(v), _in_metres(_sampled(v))).select("row", "col", r6("merged").alias("merged"))


def _smoothed(name: str, method: str, radius: float) -> None:
    k = grids.kernel(method, radius, 1.0, 32)
    values = ", ".join(f"({i}, {j}, {w!r})" for i, j, w in k)
    value = "median(f.v)" if method == "median" else "sum(k.w * f.v) / sum(k.w)"
    sql = f"WITH k(i, j, w) AS (VALUES {values}), e AS (SELECT f.row + k.i AS row, f.col + k.j AS col, {value} AS s FROM v_field_a f, k WHERE f.v IS NOT NULL GROUP BY 1, 2) SELECT a.row, a.col, round(e.s, 6) AS smooth FROM v_field_a a LEFT JOIN e ON e.row = a.row AND e.col = a.col"
    query(name, sql)(lambda v: grids.smooth(v("v_field_a"), method, radius, 1.0, 32).select("row", "col", r6("smooth").alias("smooth")))


for _name, _method, _radius in (("arr_02_gaussian", "gaussian", 1.3), ("arr_03_uniform", "uniform", 2.0), ("arr_04_median", "median", 2.0), ("arr_05_idw", "idw", 1.5)):
    _smoothed(_name, _method, _radius)


@query("arr_11_regrid_average", "SELECT CAST(floor(row / 4) AS INT) AS row, CAST(floor(col / 4) AS INT) AS col, round(avg(v), 6) AS v FROM v_field_a GROUP BY 1, 2")
def _(v):
    return grids.regrid_nearest(v("v_field_a"), 4).select("row", "col", r6("v").alias("v"))


@query("arr_11_regrid_bilinear", "WITH t AS (SELECT row, col, row * 0.9 + 0.3 AS fr, col * 0.8 + 0.15 AS fc FROM v_field_b), n AS (SELECT t.row, t.col, (1 - abs(t.fr - a.row)) * (1 - abs(t.fc - a.col)) AS w, a.v FROM t JOIN v_field_a a ON abs(t.fr - a.row) < 1 AND abs(t.fc - a.col) < 1 WHERE a.v IS NOT NULL), s AS (SELECT row, col, sum(w * v) / sum(w) AS v FROM n GROUP BY 1, 2) SELECT t.row, t.col, round(s.v, 6) AS v FROM t LEFT JOIN s ON s.row = t.row AND s.col = t.col")
def _(v):
    t = v("v_field_b").select("row", "col", (F.col("row") * 0.9 + 0.3).alias("fr"), (F.col("col") * 0.8 + 0.15).alias("fc"))
    return grids.regrid_bilinear(v("v_field_a"), t).select("row", "col", r6("v").alias("v"))


@query("agg_13_density", "SELECT (floor(x / 1000) + 0.5) * 1000 AS cx, (floor(y / 1000) + 0.5) * 1000 AS cy, count(*) AS n, CAST(count(*) AS DOUBLE) AS per_km2 FROM v_mines GROUP BY 1, 2")
def _(v):
    return grids.density(v("v_mines"), 1000.0)


@query("agg_14_density_raster", "WITH g AS (SELECT r.range AS row, c.range AS col FROM range(13) r, range(17) c), n AS (SELECT 12 - CAST(floor(y / 1000) AS BIGINT) AS row, CAST(floor(x / 1000) AS BIGINT) AS col, count(*) AS n FROM v_mines GROUP BY 1, 2) SELECT CAST(g.row AS INT) AS row, CAST(g.col AS INT) AS col, coalesce(n.n, 0) AS n FROM g LEFT JOIN n ON g.row = n.row AND g.col = n.col")
def _(v):
    m = v("v_mines")
    return grids.density_raster(m.sparkSession, m, 1000.0, (0.0, 0.0, 17000.0, 13000.0))


_GROUP = "CASE WHEN trim(lower(ftr_type)) = 'mine dump' THEN 'waste' WHEN trim(lower(ftr_type)) IN ('adit', 'mine shaft') THEN 'openings' WHEN trim(lower(ftr_type)) = 'strip mine' THEN 'surface' WHEN trim(lower(ftr_type)) = 'gravel pit' THEN 'aggregate' WHEN trim(lower(ftr_type)) IN ('prospect pit', 'trench') THEN 'prospect' WHEN lower(ftr_type) LIKE 'tailings%' THEN 'waste' WHEN lower(ftr_type) LIKE 'quarry%' THEN 'surface' ELSE 'other' END"


@query("prj_19_feature_group", f'SELECT id, {_GROUP} AS "group" FROM v_mines')
def _(v):
    return v("v_mines").select("id", catalog.feature_group(F.col("ftr_type")).alias("group"))


@query("flt_06_kinds", f"SELECT id FROM v_mines WHERE {_GROUP} IN ('waste', 'openings') OR lower(trim(ftr_type)) = 'trench'")
def _(v):
    return v("v_mines").where(catalog.kinds_filter(F.col("ftr_type"), "waste,openings trench")).select("id")


@query("agg_15_group_counts", f"SELECT {_GROUP} AS \"group\", count(*) AS n, coalesce(string_agg(DISTINCT ftr_type, '; ' ORDER BY ftr_type), '') AS types FROM v_mines GROUP BY 1")
def _(v):
    return catalog.group_counts(v("v_mines"))


_PARSED = "p AS (SELECT filename, regexp_extract(filename, '^(.+?)-dNBR_(\\d{8})_(\\d{6})\\.tif$', 1) AS raw, strptime(regexp_extract(filename, '^(.+?)-dNBR_(\\d{8})_(\\d{6})\\.tif$', 2), '%Y%m%d')::DATE AS date FROM (SELECT DISTINCT filename FROM v_scenes) WHERE regexp_matches(filename, '^(.+?)-dNBR_(\\d{8})_(\\d{6})\\.tif$')), q AS (SELECT filename, date, regexp_replace(regexp_replace(raw, '-prelim$', ''), '-[A-Z]{2}$', '') AS fire, nullif(regexp_extract(regexp_replace(raw, '-prelim$', ''), '-([A-Z]{2})$', 1), '') AS state FROM p)"


def _scenes(v):
    return v("v_scenes").distinct().withColumn("p", catalog.parse_scene(F.col("filename"))).where("p is not null").select("filename", "p.*")


@query("src_20_parse_name", f"WITH {_PARSED} SELECT filename, fire, state, date FROM q")
def _(v):
    return _scenes(v)


@query("jon_15_latest_scene", f"WITH {_PARSED}, f AS (SELECT *, min(date) OVER (PARTITION BY fire) AS first_seen FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY fire ORDER BY date DESC, filename DESC) AS k FROM f WHERE date <= DATE '1999-06-30') SELECT filename, fire, state, date, first_seen, CAST(date - first_seen AS INT) AS age_days FROM r WHERE k = 1 AND date - first_seen >= 14")
def _(v):
    return catalog.latest_scenes(_scenes(v), as_of="1999-06-30", min_age_days=14)


@query("src_19_hrefs", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def _(v):
    return v("pages").select("page_id", F.explode(catalog.hrefs(F.col("html"))).alias("href"))


@query("agg_16_class_table", "WITH c AS (SELECT (v >= 0.1)::INT + (v >= 0.27)::INT + (v >= 0.44)::INT + (v >= 0.66)::INT AS class FROM v_dnbr WHERE v IS NOT NULL) SELECT class, count(*) AS pixels, round(CAST(count(*) * 0.0036 AS DOUBLE), 6) AS area_km2, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM c GROUP BY 1")
def _(v):
    t = catalog.class_table(v("v_dnbr").select(physics.severity(F.col("v")).alias("class")), 0.0036)
    return t.select("class", "pixels", r6("area_km2").alias("area_km2"), r6("fraction").alias("fraction"))


@query("agg_18_burn_meta", "SELECT round(max(v), 6) AS top, round(quantile_cont(v, 0.98), 6) AS p98, round(avg((v >= 0.27)::INT), 6) AS burnt FROM v_dnbr WHERE v IS NOT NULL")
def _(v):
    return v("v_dnbr").where("v is not null").agg(r6(F.max("v")).alias("top"), r6(F.percentile("v", F.lit(0.98))).alias("p98"), r6(F.avg((F.col("v") >= 0.27).cast("int"))).alias("burnt"))


@query("agg_11_flow_summary", "WITH f AS (SELECT site, time, max(cfs) AS cfs, max(stage) AS stage FROM v_flow GROUP BY 1, 2), g AS (SELECT *, (epoch(time) - epoch(lag(time) OVER (PARTITION BY site ORDER BY time))) / 60 AS gap FROM f), a AS (SELECT site, max(cfs) AS peak_cfs, arg_min(cfs, time) AS start_cfs, max(stage) AS peak_stage, count(*) AS n_obs, median(gap) AS report_min, max(time) AS last FROM g GROUP BY 1), b AS (SELECT a.*, (SELECT min(time) FROM f WHERE f.site = a.site AND f.cfs = a.peak_cfs) AS peak_time FROM a) SELECT s.site, name, drain_km2, round(peak_cfs, 6) AS peak_cfs, peak_time, round(start_cfs, 6) AS start_cfs, round(peak_stage, 6) AS peak_stage, n_obs, round(report_min, 6) AS report_min, round(peak_cfs - start_cfs, 6) AS rise_cfs, round(CASE WHEN start_cfs > 0 THEN peak_cfs / start_cfs END, 6) AS ratio, epoch(last) - epoch(peak_time) <= 90 * greatest(coalesce(report_min, 1), 1) AS peak_at_edge, round(peak_cfs * 0.028316846592 / nullif(drain_km2, 0), 6) AS unit_cms_km2 FROM v_sites s LEFT JOIN b USING (site)")
def _(v):
    f = v("v_flow").groupBy("site", "time").agg(F.max("cfs").alias("cfs"), F.max("stage").alias("stage"))
    s = catalog.flow_summary(v("v_sites"), f)
    rounded = {"peak_cfs", "start_cfs", "peak_stage", "report_min", "rise_cfs", "ratio", "unit_cms_km2"}
    return s.select(*(r6(c).alias(c) if c in rounded else c for c in s.columns))


@query("jon_09_nearest_site", f"WITH d AS (SELECT p.id, s.id AS sid, {_HAV.format(a='p.lat', b='s.lat', c='p.lon', d='s.lon')} AS km FROM v_points p, v_radars s) SELECT id, arg_min(sid, (km, sid)) AS sid, round(min(km), 6) AS km FROM d GROUP BY 1")
def _(v):
    sites = v("v_radars").select(F.col("id").alias("sid"), F.col("lon").alias("slon"), F.col("lat").alias("slat"))
    return catalog.nearest_site(v("v_points").select("id", "lon", "lat"), sites, geo.haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))).withColumn("km", r6("km"))


@query("jon_12_nearest_gate", "WITH t AS (SELECT row * 32 + col AS tid, col * 531.0 + 3 AS x, row * 404.0 + 7 AS y FROM v_field_b), d AS (SELECT t.tid, b.id AS sid, sqrt(pow(t.x - b.x, 2) + pow(t.y - b.y, 2)) AS d FROM t, v_mines b), m AS (SELECT tid, arg_min(sid, (d, sid)) AS sid, min(d) AS d FROM d WHERE d <= 150 GROUP BY 1) SELECT t.tid, m.sid, round(m.d, 6) AS d FROM t LEFT JOIN m USING (tid)")
def _(v):
    t = v("v_field_b").select((F.col("row") * 32 + F.col("col")).alias("tid"), (F.col("col") * 531.0 + 3).alias("x"), (F.col("row") * 404.0 + 7).alias("y"))
    s = v("v_mines").select(F.col("id").alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    return grids.nearest_source(t, s, 150.0).select("tid", "sid", r6("d").alias("d"))


@query("jon_11_nearest_scan", "WITH t AS (SELECT o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) % 100000 AS t FROM orders), s AS (SELECT DISTINCT l_partkey % 500 AS scan, (l_partkey % 500) * 199 AS ts FROM lineitem), j AS (SELECT t.id, t.t, s.scan, abs(t.t - s.ts) AS dt, s.ts FROM t LEFT JOIN s ON abs(t.t - s.ts) <= 90) SELECT id, t, arg_min(scan, (dt, ts)) AS scan, min(dt) AS dt FROM j GROUP BY 1, 2")
def _(v):
    t = v("orders").select(F.col("o_orderkey").alias("id"), (radar.epoch(F.col("o_orderdate")) % 100000).alias("t")).distinct()
    s = v("lineitem").select((F.col("l_partkey") % 500).alias("scan")).distinct().withColumn("ts", F.col("scan") * 199)
    return catalog.nearest_in_time(t, s, 90)


@query("snk_05_safe_names", "WITH n AS (SELECT DISTINCT p_name AS name, regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g') AS stem FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY name) AS k FROM n) SELECT name, CASE WHEN k = 1 THEN stem ELSE stem || '_' || k END AS safe FROM r")
def _(v):
    return catalog.safe_names(v("part").select(F.col("p_name").alias("name")))


@query("agg_08_best_radius", "WITH s AS (SELECT l_returnflag AS method, CAST(l_linenumber - 1 AS DOUBLE) AS radius_km, avg(l_quantity) AS rmse FROM lineitem GROUP BY 1, 2) SELECT method, arg_min(radius_km, (rmse, radius_km)) AS radius_km FROM s WHERE radius_km > 0 GROUP BY 1")
def _(v):
    s = v("lineitem").groupBy(F.col("l_returnflag").alias("method"), (F.col("l_linenumber") - 1).cast("double").alias("radius_km")).agg(F.avg("l_quantity").alias("rmse"))
    return skill.best_radius(s)


@query("agg_24_median_cadence", "SELECT median(d) AS cadence_s FROM (SELECT epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts)) AS d FROM (SELECT DISTINCT ts FROM v_scans))")
def _(v):
    from pyspark.sql import Window

    t = v("v_scans").select(radar.epoch(F.col("ts")).alias("s")).distinct()
    return t.select((F.col("s") - F.lag("s").over(Window.orderBy("s"))).alias("d")).agg(F.median("d").alias("cadence_s"))
