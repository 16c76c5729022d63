"""Queries over labels, virtual gauges, climatology, comparison, stream gauges and parsers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustline.functions import geo, labels, physics
from gustline.operators import catalog, climate, gauges, grids, radar, skill, virtual
from gustline.plans.storm import _AT, _HAV, _RI, BOX, GRID, QUERIES, SQL, _in_metres, _sampled, _scalar, query, r6, scaled_r6
from gustline.sources import parsers

__all__ = ["QUERIES", "SQL"]

# --- labels, names, dates ---------------------------------------------------


@query("prj_27_cadence_label", "SELECT id, CASE WHEN m IS NULL THEN NULL WHEN m >= 1440 THEN 'daily' WHEN m = 60 THEN 'hourly' ELSE '~' || CAST(round(m) AS INT) || '-min' END AS label FROM (SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE report_min * 30 END AS m FROM v_points)")
def _(v):
    return v("v_points").select("id", labels.cadence_label(F.when(F.col("id") % 9 != 0, F.col("report_min") * 30)).alias("label"))


@query("prj_28_shorten", "SELECT p_partkey AS id, CASE WHEN length(n) <= 16 THEN n ELSE CASE WHEN regexp_replace(n[1:15], ' [^ ]*$', '') <> '' THEN regexp_replace(n[1:15], ' [^ ]*$', '') ELSE n[1:15] END || '…' END AS name FROM (SELECT p_partkey, p_name || ' ' || p_type AS n FROM part)")
def _(v):
    return v("part").select(F.col("p_partkey").alias("id"), labels.shorten(F.concat_ws(" ", "p_name", "p_type"), 16).alias("name"))


@query("prj_30_parse_date", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS plain, CAST(o_orderdate AS DATE) AS dashed, CAST(NULL AS DATE) AS none FROM orders")
def _(v):
    return v("orders").select(F.col("o_orderkey").alias("id"), labels.parse_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("plain"), labels.parse_date(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("dashed"), labels.parse_date(F.date_format("o_orderdate", "MM/yyyy")).alias("none"))


_CODES = "CASE p_size " + " ".join(f"WHEN {m} THEN '{c}'" for m, c in labels.DURATION_CODES.items()) + " END"


@query("prj_36_grid_name", f"SELECT p_partkey AS id, 'sw' || p_size || 'yr' || {_CODES} || 'au.zip' AS upper, 'ne2yr' || {_CODES} || 'a_ams.zip' AS mean FROM part")
def _(v):
    return v("part").select(F.col("p_partkey").alias("id"), labels.grid_name(F.lit("sw"), F.col("p_size"), F.col("p_size"), "upper").alias("upper"), labels.grid_name(F.lit("ne"), F.lit(2), F.col("p_size"), partial=False).alias("mean"))


@query("prj_18_colour", "SELECT id, line, CASE WHEN v < 0.1 THEN '#AABB00' WHEN v < 0.44 THEN '#00FFCC' WHEN v >= 0.44 THEN '#123ABC' END AS colour FROM v_dnbr")
def _(v):
    return v("v_dnbr").select("id", "line", labels.colour(F.col("v"), [0.1, 0.44], ["aabb00", "#00ffcc", "123abc"]).alias("colour"))


@query("prj_09_rate_cap", "SELECT id, line, least(kdp, 3) AS rate FROM v_gates")
def _(v):
    return v("v_gates").select("id", "line", F.when(F.col("kdp") > 3, 3.0).otherwise(F.col("kdp")).alias("rate"))


@query("prj_29_midnight", "WITH c AS (SELECT id, CAST(id * 7 % 24 AS DOUBLE) AS h FROM v_points), m AS (SELECT median(h) AS m FROM c) SELECT id, CASE WHEN h < m - 12 THEN h + 24 ELSE h END AS tpki15 FROM c, m")
def _(v):
    return climate.midnight_unwrap(v("v_points").select("id", (F.col("id") * 7 % 24).cast("double").alias("tpki15")))


@query("src_36_names", "SELECT id, CASE WHEN id % 3 = 0 THEN 'VG' || row_number() OVER (ORDER BY id) ELSE 'p' || id END AS name FROM v_points")
def _(v):
    return catalog.named_points(v("v_points").select("id", F.when(F.col("id") % 3 != 0, F.concat(F.lit("p"), "id")).alias("name"), "lon", "lat"), "id").select("id", "name")


# --- geometry and joins -----------------------------------------------------

_scalar("prj_25_cell_size", "v_points", {"km": (lambda: geo.cell_km(F.col("lat"), 0.01, 0.01), "(0.01 * 111.32 * cos(radians(lat)) + 0.01 * 111.32) / 2")}, ("id",))


@query("jon_20_in_box", f"SELECT id FROM v_points WHERE lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}")
def _(v):
    return v("v_points").where(geo.bbox_distance_km(F.col("lon"), F.col("lat"), BOX) == 0).select("id")


@query("jon_20_in_ring", f"SELECT id, (lon + 119.6) + (lat - 39.5) * 2 < 0.1 AND lon > {BOX[0]} AND lat > {BOX[1]} AS inside FROM v_points")
def _(v):
    corners = [(BOX[0], BOX[1]), (-119.5 + (39.5 - BOX[1]) * 2, BOX[1]), (BOX[0], 39.5 + (-119.5 - BOX[0]) / 2), (BOX[0], BOX[1])]
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners))
    return v("v_points").select("id", geo.in_ring(F.col("lon"), F.col("lat"), ring).alias("inside"))


@query("jon_14_scenes_in", f"WITH s AS (SELECT id, lon AS w, lat AS s, lon + id % 7 * 0.02 AS e, lat + id % 5 * 0.03 AS n FROM v_points) SELECT id, round((least(e, {BOX[2]}) - greatest(w, {BOX[0]})) * (least(n, {BOX[3]}) - greatest(s, {BOX[1]})) / ({BOX[2] - BOX[0]} * {BOX[3] - BOX[1]}), 6) AS overlap FROM s WHERE e >= {BOX[0]} AND w <= {BOX[2]} AND n >= {BOX[1]} AND s <= {BOX[3]}")
def _(v):
    s = v("v_points").select("id", F.col("lon").alias("w"), F.col("lat").alias("s"), (F.col("lon") + F.col("id") % 7 * 0.02).alias("e"), (F.col("lat") + F.col("id") % 5 * 0.03).alias("n"))
    return catalog.scenes_in(s, *BOX).select("id", r6("overlap").alias("overlap"))


_REGIONS = "r AS (SELECT n_name AS region, -119.9 + n_nationkey % 5 * 0.08 AS west, -119.72 + n_nationkey % 5 * 0.08 AS east, 39.2 + n_nationkey // 5 * 0.07 AS south, 39.35 + n_nationkey // 5 * 0.07 AS north FROM nation)"


@query("jon_16_region", f"WITH {_REGIONS}, a AS (SELECT id, lon - 0.03 AS w, lat - 0.02 AS s, lon + 0.03 AS e, lat + 0.02 AS n FROM v_points), j AS (SELECT a.id, r.region, CASE WHEN west <= w AND east >= e AND south <= s AND north >= n THEN 0 ELSE 1 END AS tier, pow((west + east) / 2 - (w + e) / 2, 2) + pow((south + north) / 2 - (s + n) / 2, 2) AS far FROM a, r WHERE west <= w AND east >= e AND south <= s AND north >= n OR west <= (w + e) / 2 AND east >= (w + e) / 2 AND south <= (s + n) / 2 AND north >= (s + n) / 2), k AS (SELECT id, region, row_number() OVER (PARTITION BY id ORDER BY tier, far, region) AS rn FROM j) SELECT a.id, k.region FROM a LEFT JOIN k ON k.id = a.id AND k.rn = 1")
def _(v):
    a = v("v_points").select("id", (F.col("lon") - 0.03).alias("w"), (F.col("lat") - 0.02).alias("s"), (F.col("lon") + 0.03).alias("e"), (F.col("lat") + 0.02).alias("n"))
    k = F.col("n_nationkey")
    r = v("nation").select(F.col("n_name").alias("region"), (k % 5 * 0.08 - 119.9).alias("west"), (k % 5 * 0.08 - 119.72).alias("east"), (F.floor(k / 5) * 0.07 + 39.2).alias("south"), (F.floor(k / 5) * 0.07 + 39.35).alias("north"))
    return climate.region_of(a, r)


@query("jon_10_radar_lookup", "SELECT c.c_custkey AS id, r.lon, r.lat, r.elev_m FROM customer c JOIN v_radars r ON r.id = c.c_nationkey")
def _(v):
    return catalog.radar_location(v("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("radar")), v("v_radars").withColumnRenamed("id", "radar"), "radar").select("id", "lon", "lat", "elev_m")


@query("agg_26_longest_per_name", "SELECT name, max(len) AS len FROM (SELECT ftr_type AS name, sqrt(x * x + y * y) AS len FROM v_mines WHERE ftr_type IS NOT NULL) GROUP BY 1")
def _(v):
    m = v("v_mines").where("ftr_type is not null").select("id", F.col("ftr_type").alias("name"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("len"))
    return catalog.first_per_name(m, [F.desc("len"), "id"]).select("name", "len")


@query("srt_06_top_values", "SELECT id, val FROM v_points ORDER BY val DESC, id LIMIT 5")
def _(v):
    return catalog.top_values(v("v_points"), "val", "id", 5).select("id", "val")


# --- stream gauges ----------------------------------------------------------

_READ = "r AS (SELECT site, time, seq, cfs, stage FROM v_flow), l AS (SELECT site, time, arg_max(cfs, seq) AS discharge_cfs, arg_max(stage, seq) AS stage_ft FROM r GROUP BY 1, 2)"


@query("jon_08_flow_and_stage", f"WITH {_READ} SELECT site, time, round(discharge_cfs, 6) AS discharge_cfs, round(stage_ft, 6) AS stage_ft FROM l")
def _(v):
    f = v("v_flow")
    readings = f.select("site", F.lit("00060").alias("code"), "time", "seq", F.col("cfs").alias("value")).unionByName(f.select("site", F.lit("00065").alias("code"), "time", "seq", F.col("stage").alias("value")))
    return catalog.latest_reading(readings).select("site", "time", r6("discharge_cfs").alias("discharge_cfs"), r6("stage_ft").alias("stage_ft"))


@query("flt_12_panels", "SELECT s.site, f.peak FROM v_sites s LEFT JOIN (SELECT site, max(cfs) AS peak FROM v_flow GROUP BY 1) f USING (site) WHERE f.peak IS NULL OR f.peak >= 400")
def _(v):
    return catalog.panels(v("v_sites"), v("v_flow"), 400.0).select("site", "peak")


@query("jon_23_wettest_gauge", "SELECT s.site, p.id AS gauge FROM v_sites s LEFT JOIN (SELECT id % 20 AS site, arg_min(id, (-val, id)) AS id FROM v_points GROUP BY 1) p USING (site)")
def _(v):
    g = v("v_points").select((F.col("id") % 20).alias("site"), F.col("id").alias("gauge"), "val")
    return catalog.wettest(v("v_sites").select("site"), g, "site", "gauge", "val")


@query("jon_21_by_name", "WITH a AS (SELECT 'p' || id AS name, val FROM v_points WHERE id % 3 > 0), b AS (SELECT 'p' || (id + 10) AS name, report_min AS r FROM v_points) SELECT coalesce(a.name, b.name) AS name, a.val AS gauge, b.r AS radar FROM a FULL JOIN b ON a.name = b.name")
def _(v):
    p = v("v_points")
    a = p.where("id % 3 > 0").select(F.concat(F.lit("p"), "id").alias("name"), F.col("val").alias("gauge"))
    b = p.select(F.concat(F.lit("p"), (F.col("id") + 10).cast("string")).alias("name"), F.col("report_min").alias("radar"))
    return a.join(b, "name", "full")


# --- virtual gauges and stacks ----------------------------------------------

_LINE = (
    "x AS (SELECT cell, CAST(epoch(ts) AS BIGINT) + cell * 7 AS s, rate FROM v_scans), p AS (SELECT * FROM x WHERE rate IS NOT NULL), b AS (SELECT min(s) AS a, max(s) AS z FROM x), "
    "m AS (SELECT c.cell, k.k, b.a + k.k * 60 AS s FROM (SELECT DISTINCT cell FROM x) c, b, (SELECT unnest(range(0, (SELECT (z - a) // 60 + 1 FROM b))) AS k) k), "
    "l AS (SELECT m.cell, m.k, m.s, p.s AS s1, p.rate AS r1 FROM m ASOF LEFT JOIN p ON m.cell = p.cell AND m.s >= p.s), n AS (SELECT l.*, p.s AS s2, p.rate AS r2 FROM l ASOF LEFT JOIN p ON l.cell = p.cell AND l.s <= p.s), "
    "v AS (SELECT cell, k, s, CASE WHEN s2 IS NULL OR s2 <= s1 THEN r1 ELSE r1 + (r2 - r1) * (s - s1) / (s2 - s1) END AS rate FROM n)"
)


def _lines(v):
    """Samples of each cell at its own seconds, interpolated to minutes of the whole time."""
    x = v("v_scans").select("cell", (radar.epoch(F.col("ts")) + F.col("cell") * 7).alias("s"), "rate")
    span = x.select("cell").distinct().crossJoin(F.broadcast(x.agg(F.min("s").alias("start"), F.max("s").alias("end"))))
    return virtual.at_minutes(x, "cell", span)


@query("ts_05_at_minutes", f"WITH {_LINE} SELECT cell, k, s, round(rate, 6) AS rate FROM v")
def _(v):
    return _lines(v).select("cell", "k", "s", r6("rate").alias("rate"))


@query("ts_06_virtual_series", f"WITH {_LINE}, t AS (SELECT *, CASE WHEN rate IS NOT NULL THEN sum(rate / 60) OVER (PARTITION BY cell ORDER BY k) END AS total FROM v) SELECT cell, k, round(total + 3e-6, 4) AS total, round((total - lag(total, 5) OVER w) * 12 + 3e-6, 4) AS i5, round(((total - lag(total, 16) OVER w) * 60 / 16 + (total - lag(total, 14) OVER w) * 60 / 14) / 2 + 3e-6, 4) AS i15, round((total - lag(total, 60) OVER w) + 3e-6, 4) AS i60 FROM t WINDOW w AS (PARTITION BY cell ORDER BY k)")
def _(v):
    s = virtual.series(_lines(v), "cell")
    # some values are exact halves at four places, which the order of a sum would decide: a little is added
    return s.select("cell", "k", *(F.round(F.col(c) + 3e-6, 4).alias(c) for c in ("total", "i5", "i15", "i60")))


@query("ts_02_whole_window", f"WITH {_LINE}, b2 AS (SELECT 1704067200 - 600 AS a), w AS (SELECT c.cell, u.k, b2.a + u.k * 60 AS s FROM (SELECT DISTINCT cell FROM v) c, b2, (SELECT unnest(range(0, 1441)) AS k) u) SELECT w.cell, CAST(w.k AS INT) AS k, w.s, round(coalesce(v.rate / 60, 0), 6) AS mm FROM w LEFT JOIN v ON v.cell = w.cell AND v.s = w.s")
def _(v):
    m = _lines(v).withColumn("mm", F.col("rate") / 60)
    return virtual.whole_window(m, "cell", 1704067200 - 600, 1704067200 - 600 + 1440 * 60).withColumn("mm", r6("mm"))


@query("win_13_storm_window", f"WITH {_LINE}, i AS (SELECT s, sum(coalesce(rate, 0) / 60) AS mm FROM v GROUP BY 1), c AS (SELECT s, sum(mm) OVER (ORDER BY s) / sum(mm) OVER () AS c FROM i) SELECT min(s) FILTER (c >= 0.005) - 1800 AS start_s, max(s) FILTER (c <= 0.995) + 1800 AS end_s FROM c")
def _(v):
    return gauges.storm_window(_lines(v).select(F.col("cell").alias("station_id"), "s", F.coalesce(F.col("rate") / 60, F.lit(0.0)).alias("mm")))


@query("win_17_window_hours", "SELECT s_suppkey AS id, unnest(generate_series(date_trunc('day', TIMESTAMP '2024-01-01' + to_hours(CAST(s_suppkey * 5 AS BIGINT))) + INTERVAL 4 HOUR, date_trunc('day', TIMESTAMP '2024-01-01' + to_hours(CAST(s_suppkey * 5 AS BIGINT))) + INTERVAL 33 HOUR, INTERVAL 1 HOUR)) AS t FROM supplier")
def _(v):
    day = F.expr("timestampadd(HOUR, CAST(s_suppkey * 5 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    start, end = virtual.storm_day(day)
    return virtual.window_hours(v("supplier").select(F.col("s_suppkey").alias("id"), start.cast("timestamp_ntz").alias("a"), end.cast("timestamp_ntz").alias("z")), F.col("a"), F.col("z")).select("id", F.col("t").cast("timestamp_ntz").alias("t"))


@query("jon_22_first_product", "WITH h AS (SELECT *, CAST(epoch(t) AS BIGINT) // 3600 % 3 AS m FROM v_hours) SELECT t, cell, round(CASE m WHEN 0 THEN value WHEN 1 THEN value * 2 ELSE value * 3 END, 6) AS value, CAST(m AS INT) AS rank FROM h")
def _(v):
    h = v("v_hours").withColumn("m", F.floor(radar.epoch(F.col("t")) / 3600) % 3)
    products = [h.where("m = 0"), h.where("m <= 1").withColumn("value", F.col("value") * 2), h.withColumn("value", F.col("value") * 3)]
    return virtual.first_product(products).select("t", "cell", r6("value").alias("value"), "rank")


@query("win_08_hourly_reference", f"WITH {_LINE}, h AS (SELECT cell, CAST(epoch(t) AS BIGINT) AS s, value, sum(value) OVER w - first_value(value) OVER w AS total_qpe FROM v_hours WINDOW w AS (PARTITION BY cell ORDER BY t)) SELECT v.cell, v.s, round(h.value, 6) AS i60_qpe, round(CASE WHEN h.value IS NOT NULL THEN h.total_qpe END, 4) AS total_qpe FROM v LEFT JOIN h ON h.cell = v.cell AND h.s = v.s")
def _(v):
    h = v("v_hours").select("cell", radar.epoch(F.col("t")).alias("s"), "value")
    return virtual.hourly_reference(_lines(v), h, "cell").select("cell", "s", r6("i60_qpe").alias("i60_qpe"), F.round("total_qpe", 4).alias("total_qpe"))


_STACK = (
    "x AS (SELECT cell, CAST(epoch(ts) AS BIGINT) AS s, coalesce(rate, 0) AS r FROM v_scans), y AS (SELECT *, lead(s) OVER w AS s2, lead(r) OVER w AS r2, min(s) OVER (PARTITION BY cell) AS s0, max(s) OVER (PARTITION BY cell) AS sn FROM x WINDOW w AS (PARTITION BY cell ORDER BY s)), "
    "g AS (SELECT cell, unnest(range(0, (sn - s0) // 60 + 1)) AS k, s0 FROM (SELECT DISTINCT cell, s0, sn FROM y)), a AS (SELECT g.cell, g.k, CASE WHEN y.s2 IS NULL THEN y.r ELSE y.r + (y.r2 - y.r) * (g.s0 + g.k * 60 - y.s) / (y.s2 - y.s) END / 60 AS a FROM g ASOF JOIN y ON g.cell = y.cell AND g.s0 + g.k * 60 >= y.s), "
    "c AS (SELECT *, sum(a) OVER (PARTITION BY cell ORDER BY k) AS c, count(*) OVER (PARTITION BY cell) AS m FROM a), d AS (SELECT *, c - coalesce(lag(c, 16) OVER w, 0) AS d16, c - coalesce(lag(c, 14) OVER w, 0) AS d14, c - coalesce(lag(c, 30) OVER w, 0) AS d30, c - coalesce(lag(c, 60) OVER w, 0) AS d60 FROM c WINDOW w AS (PARTITION BY cell ORDER BY k))"
)


@query("win_05_stack_peaks", f"WITH {_STACK} SELECT cell, any_value(m) AS minutes, round(max(CASE WHEN m > 16 AND k >= 15 THEN (d16 * 60 / 16 + d14 * 60 / 14) / 2 END), 5) AS i15, round(max(CASE WHEN m > 30 AND k >= 29 THEN d30 * 2 END), 5) AS i30, round(max(CASE WHEN m > 60 AND k >= 59 THEN d60 END), 5) AS i60, round(sum(a), 4) AS total FROM d GROUP BY cell")
def _(v):
    s = v("v_scans").select("cell", radar.epoch(F.col("ts")).alias("s"), "rate")
    return virtual.stack_peaks(s).select("cell", "minutes", *(F.round(c, 5).alias(c) for c in ("i15", "i30", "i60")), F.round("total", 4).alias("total"))


@query("agg_29_intensity_stack", f"WITH v_capped AS (SELECT ts, cell, CASE WHEN rate > 30 THEN 30 ELSE rate END AS rate FROM v_scans), {_STACK.replace('FROM v_scans', 'FROM v_capped')}, e AS (SELECT cell, round(max(CASE WHEN m > 16 AND k >= 15 THEN (d16 * 60 / 16 + d14 * 60 / 14) / 2 END), 5) AS i15, round(max(a), 5) AS pk FROM d GROUP BY cell) SELECT cell, i15, round(i15 * 0.5, 4) AS i15_lo, round(i15 * 1.5, 4) AS i15_hi FROM e")
def _(v):
    s = virtual.intensity_stack(v("v_scans"), 30.0, (0.5, 1.5))
    return s.select("cell", F.round("i15", 5).alias("i15"), F.round(F.round("i15", 5) * 0.5, 4).alias("i15_lo"), F.round(F.round("i15", 5) * 1.5, 4).alias("i15_hi"))


# --- climatology and comparison ---------------------------------------------


def _curves(v):
    pf = v("v_pf")
    return climate.curves_of(pf.withColumn("duration", F.lit(15)).unionByName(pf.withColumn("duration", F.lit(60)).withColumn("i", F.col("i") * 0.4)))


_YEARS = "max(CASE WHEN x.{c} > 0 AND x.{c} <= p.top{f} AND p.k < p.n AND (x.{c} >= p.i{f} OR p.k = 1) AND (x.{c} < p.i2{f} OR p.k = p.n - 1) THEN exp(ln(p.ari) + (ln(x.{c}) - ln(p.i{f})) * (ln(p.ari2) - ln(p.ari)) / (ln(p.i2{f}) - ln(p.i{f}))) END)"
_BOX_KM = f"sqrt(pow(greatest({BOX[0]} - lon, 0, lon - ({BOX[2]})) * 111.32 * cos(radians(lat)), 2) + pow(greatest({BOX[1]} - lat, 0, lat - {BOX[3]}) * 111.32, 2))"


@query(
    "agg_23_recurrence_table",
    f"WITH {_RI.replace('x AS (SELECT id, val, id % 25 AS point FROM v_points)', 'x AS (SELECT id, lon, lat, val, val * 0.5 AS v60, id % 25 AS point FROM v_points WHERE val > 0)')}, "
    f"y AS (SELECT x.id, any_value(lon) AS lon, any_value(lat) AS lat, any_value(x.val) AS val, any_value(x.v60) AS v60, {_YEARS.format(c='val', f='')} AS y15, {_YEARS.format(c='v60', f=' * 0.4')} AS y60, max(top) AS top, max(CASE WHEN p.ari = 1 THEN p.i END) AS c15 FROM x LEFT JOIN p USING (point) GROUP BY x.id) "
    f"SELECT id, round(val, 6) AS i15, round({_BOX_KM}, 2) AS dist_to_aoi_km, {_BOX_KM} <= 0 AS in_aoi, round(c15, 6) AS clim1yr_i15, round(val / c15, 6) AS anom_i15, round(y15, 6) AS years_i15, round(v60 / (c15 * 0.4), 6) AS anom_i60, round(y60, 6) AS years_i60, CASE WHEN val > top THEN '>1000' WHEN y15 IS NULL THEN '' WHEN y15 >= 1 THEN printf('%.1f', y15) ELSE printf('%.2g', y15) END AS label_i15 FROM y",
)
def _(v):
    g = v("v_points").select("id", "lon", "lat", (F.col("id") % 25).cast("int").alias("point"), F.col("val").alias("i15"), (F.col("val") * 0.5).alias("i60"))
    t = climate.recurrence_table(g, _curves(v), (15, 60), BOX)
    return t.select("id", "dist_to_aoi_km", "in_aoi", *(scaled_r6(c).alias(c) for c in ("i15", "clim1yr_i15", "anom_i15", "years_i15", "anom_i60", "years_i60")), "label_i15")


_A_AT = "s AS (SELECT p.*, f.v AS radar, q.v AS rqi FROM v_points p LEFT JOIN v_field_b f ON f.row = floor((lat - 39.60) / -0.01) AND f.col = floor((lon + 119.75) / 0.01) LEFT JOIN v_field_a q ON q.row = floor((lat - 39.60) / -0.01) AND q.col = floor((lon + 119.75) / 0.01))"


@query("jon_04_radar_vs_gauge", f"WITH {_A_AT} SELECT id, round(radar, 6) AS radar_i15, round(radar - val, 6) AS resid_i15, round(rqi, 6) AS rqi FROM s")
def _(v):
    t = climate.radar_vs_gauge(v("v_points"), {"i15": v("v_field_b")}, {"i15": "val"}, GRID, v("v_field_a"))
    return t.select("id", r6("radar_i15").alias("radar_i15"), r6("resid_i15").alias("resid_i15"), r6("rqi").alias("rqi"))


@query("flt_02_compare_storm", f"WITH {_A_AT} SELECT 'i15' AS metric, count(val + radar) AS n, round(avg(radar - val), 6) AS bias, round(avg(abs(radar - val)), 6) AS mae FROM s WHERE rqi >= 25 AND report_min <= 50")
def _(v):
    t = climate.compare_storm(v("v_points"), {"i15": v("v_field_b")}, {"i15": "val"}, GRID, v("v_field_a"), 25.0, 50.0)
    return t.select("metric", "n", r6("bias").alias("bias"), r6("mae").alias("mae"))


def _sweep_sql() -> str:
    arms = []
    for m in ("uniform", "idw"):
        for r in (0.0, 1.0, 2.0):
            if r:
                values = ", ".join(f"({i}, {j}, {w!r})" for i, j, w in grids.kernel(m, r, 1.0, 32))
                field = f"SELECT f.row + k.i AS row, f.col + k.j AS col, sum(k.w * f.v) / sum(k.w) AS v FROM v_field_b f, (VALUES {values}) k(i, j, w) WHERE f.v IS NOT NULL GROUP BY 1, 2"
            else:
                field = "SELECT row, col, v FROM v_field_b"
            arms.append(f"SELECT '{m}' AS method, CAST({r} AS DOUBLE) AS radius_km, 15 AS duration, val, f.v AS radar FROM v_points p JOIN ({field}) f ON f.row = floor((lat - 39.60) / -0.01) AND f.col = floor((lon + 119.75) / 0.01) JOIN v_field_b o ON o.row = f.row AND o.col = f.col")
    return f"SELECT method, radius_km, duration, count(radar) AS n, round(avg(radar - val), 6) AS bias, round(sqrt(avg(pow(radar - val, 2))), 6) AS rmse FROM ({' UNION ALL '.join(arms)}) GROUP BY 1, 2, 3"


@query("agg_07_skill_sweep", _sweep_sql())
def _(v):
    s = climate.skill_sweep(v("v_points"), {15: v("v_field_b")}, {15: "val"}, GRID, ("uniform", "idw"), (0.0, 1.0, 2.0), 1.0, 32)
    return s.select("method", "radius_km", "duration", "n", r6("bias").alias("bias"), r6("rmse").alias("rmse"))


@query("agg_25_agreement", "SELECT a.row % 2 AS half, count(*) AS n, round(corr(a.v, b.v), 6) AS r, round(regr_slope(b.v, a.v), 6) AS slope, round(regr_intercept(b.v, a.v), 6) AS intercept, round(avg(b.v - a.v), 6) AS bias, round(median(b.v / a.v), 6) AS ratio FROM v_field_a a JOIN v_field_b b ON a.row = b.row AND a.col = b.col WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1 HAVING count(*) >= 100")
def _(v):
    p = v("v_field_a").withColumnRenamed("v", "a").join(v("v_field_b").withColumnRenamed("v", "b"), ["row", "col"]).withColumn("half", F.col("row") % 2)
    t = climate.agreement(p, ["half"])
    return t.select("half", "n", *(r6(c).alias(c) for c in ("r", "slope", "intercept", "bias", "ratio")))


@query("agg_22_layer_humidity", "WITH l AS (SELECT s_nationkey AS site, s_suppkey % 97 * 30.0 AS z_m, (s_acctbal + 1000) / 12000 AS rh FROM supplier), n AS (SELECT site, count(*) FILTER (z_m BETWEEN 700 AND 1700) AS n, avg(rh) FILTER (z_m BETWEEN 700 AND 1700) AS m FROM l GROUP BY 1), t AS (SELECT site, avg(rh) AS m FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY abs(z_m - 1200), z_m, rh) AS k FROM l) WHERE k <= 3 GROUP BY 1) SELECT site, round(CASE WHEN n.n >= 2 THEN n.m ELSE t.m END, 6) AS rh FROM n JOIN t USING (site)")
def _(v):
    l = v("supplier").select(F.col("s_nationkey").alias("site"), (F.col("s_suppkey") % 97 * 30.0).alias("z_m"), ((F.col("s_acctbal") + 1000) / 12000).alias("rh"))
    return climate.layer_humidity(l, ["site"], F.lit(1500.0), F.lit(900.0)).select("site", r6("rh").alias("rh"))


@query("jon_24_nearest_scene", "WITH s AS (SELECT o_custkey % 40 AS fire, CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey AS VARCHAR) AS filename FROM orders), f AS (SELECT fire, min(date) AS d0 FROM s GROUP BY 1) SELECT f.fire, f.d0, arg_min(filename, (abs(date - (d0 + 14)), date, filename)) AS filename, CAST(min(abs(date - (d0 + 14))) AS INT) AS off_days FROM f JOIN s USING (fire) GROUP BY 1, 2")
def _(v):
    s = v("orders").select((F.col("o_custkey") % 40).alias("fire"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").cast("string").alias("filename"))
    return climate.nearest_scene(s.groupBy("fire").agg(F.min("date").alias("d0")), s, 14)


# --- rasters ----------------------------------------------------------------


@query("agg_17_mosaic", "SELECT row, col, max(v) AS v FROM (SELECT row, col, v FROM v_field_a UNION ALL SELECT row + 5, col, v FROM v_field_b) GROUP BY 1, 2")
def _(v):
    return grids.mosaic(v("v_field_a"), v("v_field_b").withColumn("row", F.col("row") + 5))


@query("agg_27_stretch", "SELECT round(quantile_cont(v, 0.02), 6) AS vmin, round(greatest(quantile_cont(v, 0.99), 10), 6) AS vmax FROM v_field_a WHERE v IS NOT NULL")
def _(v):
    return grids.stretch(v("v_field_a")).select(r6("vmin").alias("vmin"), r6("vmax").alias("vmax"))


@query("arr_11_regrid_near", "SELECT t.row, t.col, a.v FROM v_field_b t LEFT JOIN v_field_a a ON a.row = floor(t.row * 0.9 + 0.3 + 0.5) AND a.col = floor(t.col * 0.8 + 0.15 + 0.5)")
def _(v):
    t = v("v_field_b").select("row", "col", (F.col("row") * 0.9 + 0.3).alias("fr"), (F.col("col") * 0.8 + 0.15).alias("fc"))
    return grids.regrid_near(v("v_field_a"), t).select("row", "col", "v")


_CELL = "39.60 - (row + 0.5) * 0.01 AS lat, -119.75 + (col + 0.5) * 0.01 AS lon"


@query(
    "cmp_06_virga_mask",
    "WITH t AS (SELECT row, col, row * 0.9 + 0.3 AS fr, col * 0.8 + 0.15 AS fc, v AS b, " + _CELL + " FROM v_field_b), n AS (SELECT t.row, t.col, (1 - abs(t.fr - a.row)) * (1 - abs(t.fc - a.col)) AS w, a.v FROM t JOIN v_field_a a ON abs(t.fr - a.row) < 1 AND abs(t.fc - a.col) < 1 WHERE a.v IS NOT NULL), "
    "s AS (SELECT row, col, sum(w * v) / sum(w) AS a FROM n GROUP BY 1, 2), j AS (SELECT t.*, s.a FROM t LEFT JOIN s ON s.row = t.row AND s.col = t.col) "
    f"SELECT row, col, CASE WHEN {_HAV.format(a='lat', b='39.5', c='lon', d='-119.6')} < 4 THEN 255 WHEN a IS NULL OR b IS NULL OR greatest(a, b) < 10 THEN 255 WHEN greatest(a, 0.1) <= b / 1.1 THEN 2 WHEN a / greatest(b, 0.1) >= 1.1 THEN 1 ELSE 0 END AS class, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round(a / greatest(b, 0.1), 6) END AS ratio FROM j",
)
def _(v):
    t = v("v_field_b").select("row", "col", (F.col("row") * 0.9 + 0.3).alias("fr"), (F.col("col") * 0.8 + 0.15).alias("fc"), GRID.x(F.col("col")).alias("lon"), GRID.y(F.col("row")).alias("lat"))
    m = grids.virga_mask(v("v_field_a"), v("v_field_b"), t, (-119.6, 39.5), 4.0, 10.0, 1.1)
    return m.select("row", "col", "class", r6("ratio").alias("ratio"))


@query("prj_33_shade", "WITH z AS (SELECT row, col, v * 10 AS v FROM v_field_b), g AS (SELECT *, CASE WHEN lag(v) OVER r IS NULL THEN lead(v) OVER r - v WHEN lead(v) OVER r IS NULL THEN v - lag(v) OVER r ELSE (lead(v) OVER r - lag(v) OVER r) / 2 END / 30 AS gy, CASE WHEN lag(v) OVER c IS NULL THEN lead(v) OVER c - v WHEN lead(v) OVER c IS NULL THEN v - lag(v) OVER c ELSE (lead(v) OVER c - lag(v) OVER c) / 2 END / 30 AS gx FROM z WINDOW r AS (PARTITION BY col ORDER BY row), c AS (PARTITION BY row ORDER BY col)) SELECT row, col, round(least(1, greatest(0, (-gx * cos(radians(-225)) * cos(radians(45)) + gy * sin(radians(-225)) * cos(radians(45)) + sin(radians(45))) / sqrt(1 + gx * gx + gy * gy))), 6) AS shade FROM g")
def _(v):
    return grids.shade(v("v_field_b").withColumn("v", F.col("v") * 10), 30.0).select("row", "col", r6("shade").alias("shade"))


@query("arr_18_blockage", "SELECT id, line, max(1 - rhohv) OVER (PARTITION BY id ORDER BY line ROWS UNBOUNDED PRECEDING) AS cbb FROM (SELECT id, line, any_value(rhohv) AS rhohv FROM (SELECT id, line, min(rhohv) AS rhohv FROM v_gates GROUP BY 1, 2) GROUP BY 1, 2)")
def _(v):
    g = v("v_gates").groupBy(F.col("id").alias("ray"), F.col("line").alias("gate")).agg(F.min("rhohv").alias("rhohv")).withColumn("pbb", 1 - F.col("rhohv"))
    return radar.cumulative_blockage(g).select(F.col("ray").alias("id"), F.col("gate").alias("line"), "cbb")


# --- parsers ----------------------------------------------------------------


@query("src_10_sites", "SELECT CAST(s_suppkey AS VARCHAR) AS site_no, s_name AS name, CAST(39.0 + s_suppkey % 100 / 100.0 AS DOUBLE) AS lat, CAST(-119 AS DOUBLE) AS lon, round(CAST(s_suppkey AS DOUBLE) * 2.589988110336, 6) AS drain_area_km2 FROM supplier WHERE s_suppkey % 4 > 0")
def _(v):
    line = F.concat_ws("\t", "s_suppkey", "s_name", F.when(F.col("s_suppkey") % 4 > 0, (39.0 + F.col("s_suppkey") % 100 / 100.0).cast("string")).otherwise(""), F.lit("-119.0"), "s_suppkey")
    body = v("supplier").select(F.explode(F.array(line, line, F.lit("# comment"), F.lit("15s\t50s\t16s\t16s\t8s"), F.lit("site_no\tstation_nm\tdec_lat_va\tdec_long_va\tdrain_area_va"))).alias("value"))
    return parsers.rdb_sites(body).withColumn("drain_area_km2", r6("drain_area_km2"))


@query("src_15_instant_values", "SELECT CAST(site AS VARCHAR) AS site, '00060' AS code, time + INTERVAL 7 HOUR AS time, round(cfs, 3) AS value FROM v_flow WHERE seq % 5 > 0")
def _(v):
    f = v("v_flow")
    value = F.struct(F.concat(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000-07:00")).alias("dateTime"), F.when(F.col("seq") % 5 > 0, F.round("cfs", 3).cast("string")).otherwise("-999999").alias("value"))
    s = f.groupBy("site").agg(F.collect_list(value).alias("value"))
    one = F.struct(F.struct(F.array(F.struct(F.col("site").cast("string").alias("value"))).alias("siteCode")).alias("sourceInfo"), F.struct(F.array(F.struct(F.lit("00060").alias("value"))).alias("variableCode")).alias("variable"), F.array(F.struct("value")).alias("values"))
    payload = s.select(F.to_json(F.struct(F.struct(F.array(one).alias("timeSeries")).alias("value"))).alias("value"))
    return parsers.instant_values(payload).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("src_32_sounding", "SELECT CAST(500 + s_suppkey % 400 AS DOUBLE) AS p_hpa, CAST(s_suppkey * 2 AS DOUBLE) AS z_m, CAST(s_suppkey % 30 - 5 AS DOUBLE) AS t_c, CAST(s_suppkey % 20 - 15 AS DOUBLE) AS td_c, CAST(s_suppkey % 90 AS DOUBLE) / 100 AS rh FROM supplier WHERE s_suppkey % 6 > 0")
def _(v):
    k = F.col("s_suppkey")
    line = F.concat_ws("  ", (500 + k % 400).cast("string"), (k * 2).cast("string"), (k % 30 - 5).cast("string"), (k % 20 - 15).cast("string"), F.when(k % 6 > 0, (k % 90).cast("string")).otherwise("777"))
    return parsers.sounding(v("supplier").select(F.explode(F.array(line, F.lit("PRES HGHT TEMP DWPT RELH"), F.lit("1 2"))).alias("value")))


@query("src_18_frequency_table", "SELECT 15 AS duration, ari, round(i, 2) AS intensity FROM v_pf WHERE point = 3 UNION ALL SELECT 60, ari, round(i / 2, 2) FROM v_pf WHERE point = 3")
def _(v):
    p = v("v_pf").where("point = 3").groupBy().agg(F.array_sort(F.collect_list(F.struct("ari", "i"))).alias("a"))
    head = F.concat(F.lit("by duration for ARI (years):, "), F.array_join(F.transform("a", lambda x: x["ari"].cast("int").cast("string")), ", "))
    row = lambda d, f: F.concat(F.lit(f"{d}:, "), F.array_join(F.transform("a", lambda x: F.round(x["i"] * f, 2).cast("string")), ", "))
    return parsers.pf_table(p.select(F.explode(F.array(head, row("15-min", 1.0), row("1-hr", 0.5), F.lit("notes"))).alias("value")))


@query("src_17_ascii_grid", "SELECT row, col, round(v, 3) AS value FROM v_field_a")
def _(v):
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "v"))), lambda x: F.coalesce(F.round(x["v"], 3), F.lit(-9.0)).cast("string")), " ")
    rows = v("v_field_a").groupBy("row").agg(line.alias("line")).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return parsers.ascii_grid(rows.select(F.concat(F.lit("ncols 32\nnrows 32\nNODATA_value -9.0\n"), "body").alias("value")))


# --- filters ----------------------------------------------------------------


@query("flt_07_named", "SELECT p_partkey AS id FROM part WHERE trim(p_name) <> '' AND p_partkey % 4 > 0")
def _(v):
    return catalog.named_only(v("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_name")).when(F.col("p_partkey") % 8 == 0, " ").alias("name"))).select("id")


@query("flt_10_valid_classes", "SELECT id, line, CASE WHEN line BETWEEN 1 AND 4 THEN line END AS class FROM v_gates")
def _(v):
    return v("v_gates").select("id", "line", physics.valid_class(F.col("line")).alias("class"))


@query("flt_11_fires", "SELECT DISTINCT filename FROM v_scenes WHERE lower(regexp_extract(filename, '^(Fire-[0-9]+)-', 1)) IN ('fire-7', 'fire-12') AND regexp_matches(filename, '^(.+?)-dNBR_')")
def _(v):
    s = v("v_scenes").distinct().withColumn("p", catalog.parse_scene(F.col("filename"))).where("p is not null").select("filename", "p.*")
    return catalog.of_fires(s, ["FIRE-7", "fire-12"]).select("filename")


@query("flt_13_wet_display", "SELECT row, col, CASE WHEN v >= 25 THEN v END AS v FROM v_field_a")
def _(v):
    return grids.wet_only(v("v_field_a"), 25.0)
