"""Radar against gauges: sampling, statistics, bias and merging, leave-one-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions.geo import Grid
from gustline.functions.nulls import pearson


def sample_points(points: DataFrame, cells: DataFrame, grid: Grid, fields: list[str]) -> DataFrame:
    """points (lon, lat, ..) with the fields of the cell they fall in; NULL off the grid. An equi-join on (row, col)."""
    at = points.withColumn("row", grid.row(F.col("lat"))).withColumn("col", grid.col(F.col("lon")))
    return at.join(cells.select("row", "col", *fields), ["row", "col"], "left")


def residuals(table: DataFrame, gauge: str, radar: str, name: str) -> DataFrame:
    return table.withColumn(f"radar_{name}", F.col(radar)).withColumn(f"resid_{name}", F.col(radar) - F.col(gauge))


def comparison_stats(table: DataFrame, pairs: dict[str, tuple[str, str]], rqi_min: float | None = None, max_report_min: float | None = None) -> DataFrame:
    """One row per metric: n, means, bias, rmse, mae, corr and ratio; a metric without pairs has n = 0 and NULLs.

    pairs: metric -> (gauge column, radar column). rqi_min screens by column rqi,
    max_report_min by column report_min for all metrics but total.
    """
    arms = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(g).cast("double").alias("g"), F.col(r).cast("double").alias("r")) for m, (g, r) in pairs.items()))
    keep = F.lit(True)
    if rqi_min is not None:
        keep = keep & F.coalesce(F.col("rqi") >= rqi_min, F.lit(False))
    if max_report_min is not None:
        keep = keep & ((F.col("__p.metric") == "total") | F.coalesce(F.col("report_min") <= max_report_min, F.lit(False)))
    long = table.withColumn("__p", F.explode(arms)).where(keep).select("__p.*").where("g is not null and r is not null")
    d = F.col("r") - F.col("g")
    some = long.groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("g").alias("gauge_mean"), F.avg("r").alias("radar_mean"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.abs(d)).alias("mae"), pearson(F.col("g"), F.col("r")).alias("corr"), F.try_divide(F.sum("r"), F.sum("g")).alias("ratio"),
    )
    names = table.sparkSession.createDataFrame([(m,) for m in pairs], "metric string")
    return names.join(some, "metric", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def mean_field_bias(pairs: DataFrame) -> DataFrame:
    """(factor): sum of gauges over sum of radar where both are known and radar is wet; 1 if there is none."""
    ok = pairs.where("val is not null and radar > 0")
    return ok.agg(F.greatest(F.coalesce(F.try_divide(F.sum("val"), F.sum("radar")), F.lit(1.0)), F.lit(0.0)).alias("factor"))


#: Sources that one row holds as an array, and over which they are no longer broadcast.
BLOCK, BROADCAST = 4096, 200_000


def _beside(targets: DataFrame, sources: DataFrame) -> tuple[DataFrame, bool]:
    """Each target with all sources as one array, or with one array after the other; the latter is told.

    The sources are counted first. Their arrays are broadcast unless they are
    very many; then Spark pairs targets and arrays without a copy for every task.
    """
    n = sources.count()
    parts = sources.select(F.struct(*sources.columns).alias("s"), F.pmod(F.xxhash64(*sources.columns), F.lit(-(-n // BLOCK) or 1)).alias("b"))
    if n <= BLOCK:
        return targets.crossJoin(F.broadcast(parts.agg(F.collect_list("s").alias("__s")))), False
    parts = parts.groupBy("b").agg(F.collect_list("s").alias("__s")).select("__s")
    return targets.crossJoin(F.broadcast(parts) if n <= BROADCAST else parts), True


def _sums(rows: DataFrame, keys: list[str], several: bool, terms: dict[str, Callable]) -> DataFrame:
    """rows with the sum of each term (a function of a source, NULL: left out) over the array, or over the arrays of equal keys."""
    start = F.struct(*(F.lit(0.0).alias(k) for k in terms))
    total = F.aggregate("__s", start, lambda a, x: F.struct(*((a[k] + F.coalesce(f(x).cast("double"), F.lit(0.0))).alias(k) for k, f in terms.items())))
    out = rows.withColumn("__t", total).drop("__s")
    if not several:
        return out.select(*(c for c in out.columns if c != "__t"), *(F.col(f"__t.{k}").alias(k) for k in terms))
    rest = [c for c in out.columns if c != "__t" and c not in keys]
    return out.groupBy(*keys).agg(*(F.first(c).alias(c) for c in rest), *(F.sum(f"__t.{k}").alias(k) for k in terms))


def _weight(x: Column, y: Column, sx: Column, sy: Column, p: float, eps: float) -> Column:
    return 1 / F.pow(F.greatest(F.sqrt(F.pow(x - sx, 2) + F.pow(y - sy, 2)), F.lit(eps)), F.lit(p))


def idw(targets: DataFrame, sources: DataFrame, keys: list[str], values: dict[str, Column], p: float = 2.0, eps: float = 1.0) -> DataFrame:
    """targets (keys, x, y, ..) with each value interpolated from the sources (sx, sy and what the values need): sum(w v) / sum(w), w = max(d, eps) ** -p.

    Every target meets every source, as the method has it, but as an array: nothing is exploded, and nothing shuffled up to ``BLOCK`` sources.
    """
    rows, several = _beside(targets, sources.select("sx", "sy", *(v.alias(k) for k, v in values.items())))
    terms = {}
    for k in values:
        terms[f"__n_{k}"] = lambda s, k=k: _weight(F.col("x"), F.col("y"), s["sx"], s["sy"], p, eps) * s[k]
        terms[f"__d_{k}"] = lambda s, k=k: F.when(s[k].isNotNull(), _weight(F.col("x"), F.col("y"), s["sx"], s["sy"], p, eps))
    out = _sums(rows, keys, several, terms)
    return out.select(*targets.columns, *(F.try_divide(F.col(f"__n_{k}"), F.col(f"__d_{k}")).alias(k) for k in values))


def local_bias(cells: DataFrame, gauges: DataFrame) -> DataFrame:
    """cells (row, col, x, y, radar) with ``merged``: radar times the exponential of interpolated log ratios; the mean-field factor below three wet gauges."""
    wet = gauges.where("val > 0 and radar > 0").select(F.col("x").alias("sx"), F.col("y").alias("sy"), "val", "radar")
    if wet.count() < 3:
        return cells.crossJoin(F.broadcast(mean_field_bias(gauges))).withColumn("merged", F.col("radar") * F.col("factor")).drop("factor")
    log_ratio = F.greatest(F.lit(-2.5), F.least(F.lit(2.5), F.log(F.col("val") / F.col("radar"))))
    return idw(cells, wet, ["row", "col"], {"__bias": log_ratio}).withColumn("merged", F.col("radar") * F.exp("__bias")).drop("__bias")


def conditional_merge(cells: DataFrame, gauges: DataFrame) -> DataFrame:
    """cells with ``merged``: radar less interpolated radar at the gauges plus interpolated gauges, in logarithms, not below 0."""
    s = gauges.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "val", "radar")
    both = idw(cells, s, ["row", "col"], {"__at": F.log1p("radar"), "__of": F.log1p("val")})
    merged = F.expm1(F.log1p("radar") - F.col("__at") + F.col("__of"))
    return both.withColumn("merged", F.when(merged < 0, 0.0).otherwise(merged)).drop("__at", "__of")


def leave_one_out(gauges: DataFrame) -> DataFrame:
    """(method, n, rmse, mae, bias, ratio) of raw radar (raw), the mean-field (mfb) and local corrections (lbc) and the conditional merge (cm) at each held-out gauge (id, x, y, val, radar).

    A weight depends on where two gauges stand, so places meet places, each with
    the sums of its gauges: gauges at one place cost no more than one. Every
    other id counts, those at the same place too.
    """
    g = gauges.where("val is not null and radar is not null and id is not null").select("id", "x", "y", "val", "radar")
    val, radar = F.col("val"), F.col("radar")
    wet = (val > 0) & (radar > 0)
    ratio = F.greatest(F.lit(-2.5), F.least(F.lit(2.5), F.log(F.when(wet, val) / F.when(wet, radar))))
    of = {
        "n": F.lit(1), "n_wet": F.when(wet, 1).otherwise(0), "sum_val": val, "sum_radar": radar, "l": F.when(wet, ratio).otherwise(0.0),
        "at": F.log1p(F.greatest(radar, F.lit(0.0))), "of": F.log1p(F.greatest(val, F.lit(0.0))),
    }
    places = g.groupBy("x", "y").agg(*(F.sum(c.cast("double")).alias(k) for k, c in of.items()))
    rows, several = _beside(places, places)

    def elsewhere(s: Column, value: Column) -> Column:
        return F.when(~(s["x"].eqNullSafe(F.col("x")) & s["y"].eqNullSafe(F.col("y"))), value)

    def weighted(s: Column, k: str) -> Column:
        return _weight(F.col("x"), F.col("y"), s["x"], s["y"], 2.0, 1.0) * s[k]

    plain = ("n_wet", "sum_val", "sum_radar")
    heavy = {"w": "n", "w_wet": "n_wet", "l": "l", "at": "at", "of": "of"}
    terms = {f"__{k}": (lambda s, k=k: elsewhere(s, s[k])) for k in plain} | {f"__w_{k}": (lambda s, k=k: elsewhere(s, weighted(s, k))) for k in heavy.values()}
    others = _sums(rows, ["x", "y"], several, terms).select(F.col("x").alias("__x"), F.col("y").alias("__y"), *(F.col(k).alias(f"__at_{k}") for k in of), *terms)
    own = Window.partitionBy("id", "x", "y")
    for k, c in of.items():
        g = g.withColumn(f"__own_{k}", F.sum(c.cast("double")).over(own))
    per = g.join(others, F.col("x").eqNullSafe(F.col("__x")) & F.col("y").eqNullSafe(F.col("__y")))
    beside = {k: F.col(f"__at_{k}") - F.col(f"__own_{k}") for k in of}
    here = F.coalesce(_weight(F.col("x"), F.col("y"), F.col("x"), F.col("y"), 2.0, 1.0), F.lit(0.0))
    per = per.select("val", "radar", *((F.col(f"__{k}") + beside[k]).alias(k) for k in plain), *((F.col(f"__w_{k}") + here * beside[k]).alias(name) for name, k in heavy.items())).where("w > 0")
    factor = F.when(F.col("sum_radar") > 0, F.col("sum_val") / F.col("sum_radar")).otherwise(1.0)
    radar = F.greatest("radar", F.lit(0.0))
    merged = F.expm1(F.log1p(radar) - F.col("at") / F.col("w") + F.col("of") / F.col("w"))
    arms = {"raw": F.col("radar"), "mfb": F.col("radar") * factor, "lbc": F.when(F.col("n_wet") >= 3, radar * F.exp(F.try_divide("l", "w_wet"))).otherwise(F.col("radar") * factor), "cm": F.greatest(merged, F.lit(0.0))}
    long = per.select("val", F.explode(F.array(*(F.struct(F.lit(m).alias("method"), x.alias("est")) for m, x in arms.items()))).alias("a")).select("val", "a.*")
    e = F.col("est") - F.col("val")
    return long.groupBy("method").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.try_divide(F.sum("est"), F.sum("val")).alias("ratio"))


def best_radius(sweep: DataFrame, by: str = "rmse") -> DataFrame:
    """(method, radius_km): the radius over 0 with the smallest rmse or mae, or the largest of any other statistic; the smallest radius on ties."""
    s = sweep.where(F.col("radius_km") > 0)
    best = F.expr(f"min_by(radius_km, struct({'' if by in ('rmse', 'mae') else '-'}{by}, radius_km)) FILTER (WHERE {by} IS NOT NULL)")
    return s.groupBy("method").agg(best.alias("radius_km"))
