"""Observations against climatology and against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.functions import physics
from gustline.functions.geo import KM_A_DEGREE, Grid
from gustline.functions.labels import interval_label
from gustline.operators import grids, skill


def curves_of(table: DataFrame) -> DataFrame:
    """(point, duration, curve, clim1yr) from (point, duration, ari, i): the ascending curve, and its value at one year, or its first."""
    c = table.groupBy("point", "duration").agg(F.array_sort(F.collect_list(F.struct("ari", "i"))).alias("curve"))  # ten or so rows each
    one = F.filter("curve", lambda p: p["ari"] == 1.0)
    return c.withColumn("clim1yr", F.when(F.size(one) > 0, F.get(one, F.lit(0))["i"]).otherwise(F.get("curve", F.lit(0))["i"]))


def recurrence_table(gauges: DataFrame, curves: DataFrame, durations: tuple[int, ...] = (15, 30, 60), box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Wet gauges (point, lon, lat, i15, ..; i15 over 0), wettest first and equal ones by their other columns in order, with clim1yr, anom, years and label for each duration; with a box their distance to it and whether they lie in it.

    years is NULL without a curve and above its top, where the label says so.
    """
    out = gauges.where(F.coalesce("i15", F.lit(0.0)) > 0)
    if box:
        w, s, e, n = box
        dx = F.greatest(w - F.col("lon"), F.lit(0.0), F.col("lon") - e) * KM_A_DEGREE * F.cos(F.radians("lat"))
        dy = F.greatest(s - F.col("lat"), F.lit(0.0), F.col("lat") - n) * KM_A_DEGREE
        far = F.sqrt(dx * dx + dy * dy)
        out = out.withColumn("dist_to_aoi_km", F.round(far, 2)).withColumn("in_aoi", far <= 0)
    for d in durations:
        c = curves.where(F.col("duration") == d).select("point", F.col("curve").alias("__c"), F.col("clim1yr").alias(f"clim1yr_i{d}"))
        years = physics.recurrence_interval(F.col(f"i{d}"), F.col("__c"))
        out = out.join(c, "point", "left").withColumn(f"anom_i{d}", F.when(F.col(f"clim1yr_i{d}") > 0, F.col(f"i{d}") / F.col(f"clim1yr_i{d}")))
        above = F.coalesce(years == float("inf"), F.lit(False))
        out = out.withColumn(f"years_i{d}", F.when(~above, years)).withColumn(f"label_i{d}", interval_label(F.when(~above, years), above)).drop("__c")
    return out.orderBy(F.desc_nulls_last("i15"), *gauges.columns)


def peak_time(gauges: DataFrame, times: DataFrame) -> DataFrame:
    """gauges (name, ..[, i15_peak_time]) with the time of the peak: their own, else that of (name, t)."""
    own = F.col("i15_peak_time") if "i15_peak_time" in gauges.columns else F.lit(None).cast("timestamp_ntz")
    return gauges.join(times.select("name", F.col("t").alias("__t")), "name", "left").withColumn("i15_peak_time", F.coalesce(own, "__t")).drop("__t")


def radar_vs_gauge(points: DataFrame, fields: dict[str, DataFrame], pairs: dict[str, str], grid: Grid, rqi: DataFrame | None = None) -> DataFrame:
    """points with radar_<name> and resid_<name> of each field (row, col, v) against the gauge column that pairs names, and rqi."""
    out = points
    for name, cells in fields.items():
        out = skill.sample_points(out, cells.select("row", "col", F.col("v").alias(f"radar_{name}")), grid, [f"radar_{name}"]).drop("row", "col")
        out = out.withColumn(f"resid_{name}", F.col(f"radar_{name}") - F.col(pairs[name]))
    if rqi is not None:
        out = skill.sample_points(out, rqi.select("row", "col", F.col("v").alias("rqi")), grid, ["rqi"]).drop("row", "col")
    return out


def compare_storm(points: DataFrame, fields: dict[str, DataFrame], pairs: dict[str, str], grid: Grid, rqi: DataFrame | None = None, rqi_min: float | None = None, max_report_min: float | None = None) -> DataFrame:
    """comparison_stats of every field with its gauge column, screened by rqi and cadence; a field that is not there has no row."""
    table = radar_vs_gauge(points, fields, pairs, grid, rqi)
    return skill.comparison_stats(table, {n: (pairs[n], f"radar_{n}") for n in fields}, rqi_min if rqi is not None else None, max_report_min)


def skill_sweep(points: DataFrame, fields: dict[int, DataFrame], gauge: dict[int, str], grid: Grid, methods: tuple[str, ...], radii: tuple[float, ...], cell_km: float, size: int, **screens) -> DataFrame:
    """comparison_stats for each method, radius and duration: the duration's field smoothed, sampled at the gauges and compared; radius 0 is the field as it is."""
    out = None
    for d, cells in fields.items():
        for m in methods:
            for r in radii:
                s = grids.smooth(cells, m, r, cell_km, size).select("row", "col", F.col("smooth").alias("radar"))
                one = skill.comparison_stats(skill.sample_points(points, s, grid, ["radar"]), {f"i{d}": (gauge[d], "radar")}, **screens)
                one = one.select(F.lit(m).alias("method"), F.lit(float(r)).alias("radius_km"), F.lit(d).alias("duration"), *one.columns)
                out = one if out is None else out.unionByName(one)
    return out


def agreement(pairs: DataFrame, by: list[str], least: int = 100) -> DataFrame:
    """(by, n, r, slope, intercept, bias, rmse, ratio) of pairs (a, b) that are both known, b on a; groups of fewer than ``least`` are left out. ratio is the median of b / a."""
    p = pairs.where("a is not null and b is not null")
    d = F.col("b") - F.col("a")
    out = p.groupBy(*by).agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"), F.regr_slope("b", "a").alias("slope"), F.regr_intercept("b", "a").alias("intercept"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.median(F.try_divide("b", "a")).alias("ratio"))
    return out.where(F.col("n") >= least)


def nearest_scene(fires: DataFrame, scenes: DataFrame, days: int) -> DataFrame:
    """fires (fire, d0) with the scene (fire, date, filename) nearest to ``days`` after d0, the earlier on ties."""
    off = F.abs(F.datediff("date", F.date_add("d0", days)))
    return fires.join(scenes, "fire").groupBy("fire", "d0").agg(F.min_by("filename", F.struct(off, "date", "filename")).alias("filename"), F.min(off).alias("off_days"))


def region_of(areas: DataFrame, regions: DataFrame) -> DataFrame:
    """areas (id, w, s, e, n) with the region (region, west, south, east, north) that holds them whole, else their centre; of several the one with the nearest centre, then the first by name; NULL if none does.

    regions are the volumes of an atlas, a few dozen: counted, then broadcast.
    """
    if regions.count() > 10_000:
        raise ValueError("too many regions to broadcast")
    x, y = (F.col("w") + F.col("e")) / 2, (F.col("s") + F.col("n")) / 2
    whole = (F.col("west") <= F.col("w")) & (F.col("east") >= F.col("e")) & (F.col("south") <= F.col("s")) & (F.col("north") >= F.col("n"))
    centre = (F.col("west") <= x) & (F.col("east") >= x) & (F.col("south") <= y) & (F.col("north") >= y)
    far = F.pow((F.col("west") + F.col("east")) / 2 - x, 2) + F.pow((F.col("south") + F.col("north")) / 2 - y, 2)
    order = F.struct(F.when(whole, 0).otherwise(1).alias("tier"), far.alias("far"), "region")
    best = areas.join(F.broadcast(regions), whole | centre).groupBy("id").agg(F.min(order)["region"].alias("region"))
    return areas.join(best, "id", "left").select("id", "region")


def layer_humidity(levels: DataFrame, by: list[str], z0: Column, z1: Column) -> DataFrame:
    """(by, rh): the mean over the levels (by, z_m, rh) from 200 m under z0 to 200 m over z1; over the three nearest to the middle if there are fewer than two."""
    low, high = F.least(z0, z1), F.greatest(z0, z1)
    inside = (F.col("z_m") >= low - 200) & (F.col("z_m") <= high + 200)
    near = F.struct(F.abs(F.col("z_m") - (low + high) / 2).alias("far"), F.col("z_m"), F.col("rh"))
    g = levels.groupBy(*by).agg(F.count_if(inside).alias("n"), F.avg(F.when(inside, F.col("rh"))).alias("mean"), F.slice(F.array_sort(F.collect_list(near)), 1, 3).alias("three"))  # one sounding's levels
    nearest = F.aggregate("three", F.lit(0.0), lambda a, x: a + x["rh"]) / F.size("three")
    return g.select(*by, F.when(F.col("n") >= 2, F.col("mean")).otherwise(nearest).alias("rh"))


def midnight_unwrap(cells: DataFrame, hour: str = "tpki15") -> DataFrame:
    """Hours of day more than twelve before the median are of the next day: 24 is added."""
    middle = cells.agg(F.median(hour).alias("__m"))
    return cells.crossJoin(F.broadcast(middle)).withColumn(hour, F.when(F.col(hour) < F.col("__m") - 12, F.col(hour) + 24).otherwise(F.col(hour))).drop("__m")
