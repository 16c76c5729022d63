"""Known answers, and every registered storm query against its SQL in a second engine."""

import glob
import math
import os

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from gustline.functions import labels, physics
from gustline.operators import catalog, climate, gauges, grids, radar, skill, virtual
from gustline.plans import events


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows_of(names, rows):
    names = sorted(names)

    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "NULL"
        return f"{float(x):.5g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return names, sorted(tuple(plain(r[n]) for n in names) for r in rows)


@pytest.mark.parametrize("name", [n for n in events.SQL if n != "arr_09_local_bias"])  # three wet gauges at least: not at this size
def test_same_as_sql(spark, duck, name):
    table = events.QUERIES[name](spark, SF).toArrow()
    ours = rows_of(table.column_names, table.to_pylist())
    cur = duck.execute(events.SQL[name])
    columns = [d[0] for d in cur.description]
    theirs = rows_of(columns, [dict(zip(columns, r)) for r in cur.fetchall()])
    assert ours == theirs


def scans(spark, rates, missing=()):
    rows = [(i, 0, r) for i, r in enumerate(rates) if i not in missing]
    return spark.createDataFrame(rows, "i int, cell int, rate double").select(F.expr("timestamp_seconds(1767225600 + i * 120)").alias("ts"), "cell", "rate")


def test_constant_rate_round_trips(spark):
    out = radar.storm_fields(scans(spark, [60.0] * 31)).first()
    assert [round(out[c], 6) for c in ("i15", "i30", "i60")] == [60.0] * 3


def test_gap_resets_and_missing_cell_counts_as_dry(spark):
    assert radar.storm_fields(scans(spark, [60.0] * 15, missing=(7,))).first()["i15"] is None
    out = radar.trailing_intensity(scans(spark, [60.0] * 7 + [None])).orderBy(F.desc("ts")).first()
    assert round(out["i15"], 6) == round((14 * 60 / 16 + 12 * 60 / 14) / 2, 6)


def test_first_increment_is_in_the_total_only(spark):
    obs = spark.createDataFrame([(1, 300 * i, 5.0) for i in range(12)], "station_id int, s long, precip double").select("station_id", F.timestamp_seconds("s").alias("ts"), "precip")
    m = gauges.per_minute(obs)
    assert m.agg(F.round(F.sum("mm"), 6)).first()[0] == 55.0 and m.agg(F.max("total")).first()[0] == 60.0
    assert gauges.intensities(obs).first()["i15"] == pytest.approx(60.0)


def test_dry_gauge_is_zero_and_no_sensor_is_null(spark):
    obs = spark.sql("select station_id, timestamp_seconds(s) ts, cast(p as double) precip from values (1, 0, 0.0), (1, 3600, 0.0), (2, 0, null), (2, 600, null) t(station_id, s, p)")
    got = {r["station_id"]: r for r in gauges.intensities(obs).collect()}
    assert got[1]["i15"] == 0 and got[2]["i15"] is None and got[2]["total"] is None


def test_hydro_gates(spark):
    rows = [(28.0, 1.0, 0.98, 1), (50.0, 2.3, 0.98, 2), (55.0, 0.2, 0.98, 3), (50.0, 2.3, 0.70, 4), (None, 1.0, 0.9, 0), (50.0, None, 0.98, 1)]
    df = spark.createDataFrame(rows, "dbz double, zdr double, rhohv double, want int")
    h = physics.hydro_select(F.col("dbz"), F.col("zdr"), F.col("rhohv"), physics.z_to_rate(F.col("dbz"), cap=53.0), F.lit(40.0), physics.zzdr_to_rate(F.col("dbz"), F.col("zdr"), 53.0))
    assert all(r["c"] == r["want"] for r in df.select("want", h["class"].alias("c")).collect())


def test_virga_truth_table(spark):
    rows = [(34.0, 1.2, 1), (3.3, 22.1, 2), (20.0, 18.0, 0), (1.0, 1.0, 255), (0.0, 30.0, 2), (None, 15.0, 255)]
    df = spark.createDataFrame(rows, "m double, s double, want int").select("want", physics.virga_class(F.col("m"), F.col("s")).alias("c"))
    assert all(r["c"] == r["want"] for r in df.collect())


def test_severity_and_recurrence(spark):
    vals = [0, 0.09, 0.10, 0.26, 0.27, 0.43, 0.44, 0.65, 0.66, 0.9]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i int, v double").orderBy("i")
    assert [r[0] for r in df.select(physics.severity(F.col("v"))).collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    curve = F.array(*(F.struct(F.lit(float(a)).alias("ari"), F.lit(float(i)).alias("i")) for a, i in zip((1, 2, 5, 10, 25, 50, 100, 200, 500, 1000), (18, 24, 32, 40, 52, 62, 73, 85, 103, 118))))
    got = spark.range(1).select(*(physics.recurrence_interval(F.lit(float(x)), curve) for x in (18, 40, 118, 119))).first()
    assert [round(x, 6) for x in got[:3]] == [1, 10, 1000] and got[3] == float("inf")
    with pytest.raises(ValueError):
        physics.severity(F.lit(1.0), "none")


def test_best_scene_names(spark):
    names = ["Stony-Creek-NV-dNBR_20240809_235959.tif", "Two-Pines-OR-prelim-dNBR_20230702_000000.tif", "readme.txt"]
    got = spark.createDataFrame([(n,) for n in names], "f string").select(catalog.parse_scene(F.col("f")).alias("p")).collect()
    assert [(r.p.fire, r.p.state, str(r.p.date)) if r.p else None for r in got] == [("Stony-Creek", "NV", "2024-08-09"), ("Two-Pines", "OR", "2023-07-02"), None]


def test_greedy_low_sweeps(spark):
    df = spark.createDataFrame([("a", 0.5, float(t), True) for t in (0, 60, 90, 170, 185)] + [("a", 2.0, 95.0, True)], "volume string, angle double, t double, has_echo boolean")
    assert radar.low_sweeps(df).first()["times"] == [0.0, 90.0, 185.0]


def test_stats_of_known_pairs(spark):
    t = spark.createDataFrame([(10.0, 25.0), (20.0, 50.0), (30.0, 75.0)], "g double, r double")
    s = skill.comparison_stats(t, {"i15": ("g", "r")}).first()
    assert (s["ratio"], s["bias"], round(s["corr"], 9)) == (2.5, 30.0, 1.0)


def test_smoothing_keeps_constants(spark):
    cells = spark.createDataFrame([(r, c, None if (r, c) == (5, 5) else 7.0) for r in range(11) for c in range(11)], "row int, col int, v double")
    for m in grids.METHODS:
        assert all(abs(r["smooth"] - 7) < 1e-9 for r in grids.smooth(cells, m, 1.5, 1.0, 11).where("smooth is not null").collect())
    with pytest.raises(ValueError):
        grids.smooth(cells, "other", 1.0, 1.0, 11)


def test_flat_shade_is_the_sun_height(spark):
    cells = spark.createDataFrame([(r, c, 100.0) for r in range(4) for c in range(4)], "row int, col int, v double")
    assert all(r["shade"] == pytest.approx(math.sin(math.radians(45))) for r in grids.shade(cells, 10.0).collect())


def test_peaks_at_reports_are_those_of_the_minutes(spark):
    import random

    r = random.Random(4)
    rows = []
    for station, n in ((1, 1), (2, 2), (3, 40), (4, 200), (5, 3)):
        s = r.randint(0, 1000)
        for _ in range(n):
            rows.append((station, s, r.choice([0.0, 0.0, 0.3, 2.0, -1.0])))
            s += r.choice([7, 60, 61, 290, 300, 900, 4000]) if station < 5 else 280
    obs = spark.createDataFrame(rows, "station_id int, s long, precip double").select("station_id", F.timestamp_seconds("s").alias("ts"), "precip")
    slow = {x["station_id"]: x for x in gauges.peaks(gauges.per_minute(obs)).collect()}
    fast = {x["station_id"]: x for x in gauges.report_peaks(obs).collect()}
    assert slow.keys() == fast.keys()
    for k in slow:
        for c in ("n_min", "i5", "i15", "i30", "i60"):
            assert fast[k][c] == (None if slow[k][c] is None else pytest.approx(slow[k][c], abs=1e-9)), (k, c)


def test_few_wet_gauges_take_the_mean_field_factor(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0, 40.0)], "row int, col int, x double, y double, radar double")
    g = spark.createDataFrame([(0.0, 1.0, 10.0, 40.0), (5.0, 1.0, 10.0, 40.0)], "x double, y double, val double, radar double")
    assert skill.local_bias(cells, g).first()["merged"] == 10.0


def test_interpolation_in_several_arrays(spark, monkeypatch):
    t = spark.createDataFrame([(i, float(i), 0.0) for i in range(5)], "id int, x double, y double")
    s = spark.createDataFrame([(float(i * 7 % 11), 3.0, float(i)) for i in range(30)], "sx double, sy double, val double")
    one = sorted(skill.idw(t, s, ["id"], {"v": F.col("val")}).collect())
    monkeypatch.setattr(skill, "BLOCK", 8)
    several = sorted(skill.idw(t, s, ["id"], {"v": F.col("val")}).collect())
    assert [x.id for x in one] == [x.id for x in several] and all(a.v == pytest.approx(b.v) for a, b in zip(one, several))


def test_an_hour_is_dry_or_the_best_stands(spark):
    h = spark.sql("select t, double(value) value from values (1, 0.5), (2, 1.5), (3, null) v(t, value)")
    assert [tuple(x) for x in radar.wet_hours(h, h.select("t")).collect()] == [(2, 1.5)]


def test_labels(spark):
    row = spark.range(1).select(
        labels.interval_label(F.lit(None).cast("double"), F.lit(False)).alias("none"), labels.interval_label(F.lit(1.0), F.lit(True)).alias("above"),
        *(labels.interval_label(F.lit(x), F.lit(False)).alias(str(i)) for i, x in enumerate((12.34, 0.5, 0.256, 0.0123, 0.0000065))),
        labels.shorten(F.lit("Upper Branch Of The Long River")).alias("name"), labels.shorten(F.lit("A" * 30)).alias("word"),
        labels.colour(F.lit(float("nan")), [1.0], ["#a", "#b"]).alias("nan"), labels.parse_date(F.lit("2024-13-45")).alias("bad"),
    ).first()
    assert list(row) == ["", ">1000", "12.3", "0.5", "0.26", "0.012", "6.5e-06", "Upper Branch Of The Long…", "A" * 25 + "…", None, None]
    assert labels.class_labels([0.1, 2], "mm") == ["< 0.1 mm", "0.1 - 2 mm", ">= 2 mm"]
    with pytest.raises(ValueError):
        labels.colour(F.lit(1.0), [1.0], ["#a"])
    with pytest.raises(ValueError):
        grids.smooth(spark.createDataFrame([(0, 0, 1.0)], "row int, col int, v double"), "median", 1.0, 1.0, 9, field="burn_class")


def test_minutes_of_a_virtual_gauge(spark):
    s = spark.sql("select * from values (1, 0L, double(null)), (1, 120L, 6d), (1, 240L, double(null)), (1, 360L, 12d) v(key, s, rate)")
    span = spark.sql("select 1 key, 0L start, 480L end")
    assert [x.rate for x in virtual.at_minutes(s, "key", span).orderBy("k").collect()] == [None, None, 6.0, 7.5, 9.0, 10.5, 12.0, 12.0, 12.0]


def test_a_stack_needs_a_minute_more(spark):
    rows = lambda n: spark.range(n).select(F.lit(1).alias("cell"), (F.col("id") * 60).alias("s"), F.lit(60.0).alias("rate"))
    assert virtual.stack_peaks(rows(16)).first()["i15"] is None and virtual.stack_peaks(rows(17)).first()["i15"] == pytest.approx(60)
    assert virtual.stack_peaks(rows(30)).first()["i30"] is None and virtual.stack_peaks(rows(31)).first()["i30"] == pytest.approx(60)


def test_own_peak_time_comes_first(spark):
    g = spark.sql("select * from values ('a', timestamp_ntz'2024-01-01 00:00:00'), ('b', cast(null as timestamp_ntz)) v(name, i15_peak_time)")
    t = spark.sql("select * from values ('a', timestamp_ntz'2024-02-02 00:00:00'), ('b', timestamp_ntz'2024-02-02 00:00:00') v(name, t)")
    assert [x.i15_peak_time.month for x in climate.peak_time(g, t).orderBy("name").collect()] == [1, 2]


def test_an_unknown_radar_is_an_error(spark):
    w, s = spark.sql("select 1 id, 'X' radar"), spark.sql("select 'Y' radar, 1.0 lat")
    with pytest.raises(Exception, match="unknown radar"):
        catalog.radar_location(w, s, "radar").collect()


def test_recurrence_table_to_the_last_place_and_order(spark, tmp_path):
    c = duckdb.connect()
    c.execute(f"copy (select k::bigint as s_suppkey, b::double as s_acctbal from (values (10268, 5388.66), (10043, 5749.74), (35293, 5388.66), (268, 5388.66), (49732, 9121.18)) v(k, b)) to '{tmp_path}/supplier.parquet'")
    c.execute(f"copy (select * from '{SF}/nation.parquet') to '{tmp_path}/nation.parquet'")
    for t in ("supplier", "nation"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = events.QUERIES["agg_23_recurrence_table"](spark, str(tmp_path)).collect()
    assert [r.id for r in got] == [49732, 10043, 268, 10268, 35293]  # equal ones in order
    cur = c.execute(events.SQL["agg_23_recurrence_table"])
    columns = [d[0] for d in cur.description]
    assert sorted(tuple(r[n] for n in columns) for r in got) == sorted(cur.fetchall())


@pytest.fixture(scope="module")
def uneven(spark):
    import random

    r = random.Random(7)
    rows = []
    for station, n in ((1, 1), (2, 2), (3, 60), (4, 200), (5, 300)):
        s = r.randint(0, 1000)
        for _ in range(n):
            rows.append((station, s, r.choice([0.0, 0.3, 2.0, -1.0, None])))
            s += r.choice([7, 60, 61, 290, 900, 4000]) if station < 5 else r.choice([1, 20, 59, 60])
    return spark.createDataFrame(rows, "station_id int, s long, precip double").select("station_id", F.timestamp_seconds("s").alias("ts"), "precip")


def sorts_of_minutes(df):
    """Sorts above the operator that makes minutes of reports."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    prepared = df._jdf.queryExecution().executedPlan().toString()
    assert "explode" in plan
    return prepared[: prepared.index("Generate explode")].count("Sort [") + prepared[: prepared.index("Generate explode")].count("Exchange ")


def test_minutes_are_not_sorted(spark, uneven):
    m = gauges.per_minute(uneven)
    assert sorts_of_minutes(m) == 0
    rows = m.orderBy("station_id", "k").collect()
    for a, b in zip([None, *rows], rows):
        first = a is None or a.station_id != b.station_id
        assert b.k == (0 if first else a.k + 1) and b.mm == (0 if first else b.total - a.total)


def test_a_series_of_reports_is_that_of_their_minutes(spark, uneven):
    from pyspark.testing import assertDataFrameEqual

    got = gauges.report_series(uneven)
    assert sorts_of_minutes(got) == 0
    assertDataFrameEqual(got, gauges.series(gauges.per_minute(uneven)), rtol=0, atol=1e-9)


def test_leave_one_out_by_place(spark, monkeypatch):
    import random

    r = random.Random(5)
    rows = [(i, *(r.choice([(0.0, 0.0), (900.0, 40.0), (3000.0, -7.0)]) if i < 30 else (50.0 * i, 3.0)), r.choice([0.0, 1.5, 7.0, None]), r.choice([0.0, 2.0, 9.0])) for i in range(40)]
    g = [x for x in rows if x[3] is not None]
    want = {m: [] for m in ("raw", "mfb", "lbc", "cm")}
    for i, x, y, v, d in g:
        rest = [(1 / max(1.0, math.hypot(x - q[1], y - q[2])) ** 2, q[3], q[4]) for q in g if q[0] != i]
        wet = [(w, math.log(a / b)) for w, a, b in rest if a > 0 and b > 0]
        f, total = sum(q[1] for q in rest) / sum(q[2] for q in rest), sum(q[0] for q in rest)
        want["raw"].append(d - v)
        want["mfb"].append(d * f - v)
        want["lbc"].append(d * math.exp(sum(w * max(-2.5, min(2.5, a)) for w, a in wet) / sum(w for w, _ in wet)) - v)
        want["cm"].append(max(0.0, math.expm1(math.log1p(d) + sum(w * (math.log1p(a) - math.log1p(b)) for w, a, b in rest) / total)) - v)
    df = spark.createDataFrame(rows, "id int, x double, y double, val double, radar double")
    met = []
    beside = skill._beside
    monkeypatch.setattr(skill, "_beside", lambda t, s: (met.append((t.count(), s.count())), beside(t, s))[1])
    for block in (4096, 4):
        monkeypatch.setattr(skill, "BLOCK", block)
        got = {x.method: x for x in skill.leave_one_out(df).collect()}
        for m, e in want.items():
            assert got[m].n == len(g) and got[m].bias == pytest.approx(sum(e) / len(e)) and got[m].rmse == pytest.approx(math.sqrt(sum(x * x for x in e) / len(e)))
    there = len({x[1:3] for x in g})
    assert met == [(there, there)] * 2 and there < len(g)  # places are paired, not gauges
