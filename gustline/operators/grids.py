"""Neighbourhood operators on cell tables (row, col, v): explode to a small kernel's offsets, then group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gustline.functions import geo, physics
from gustline.functions.labels import may_smooth

METHODS = ("gaussian", "uniform", "median", "idw")


def kernel(method: str, radius_km: float, cell_km: float, size: int) -> list[tuple[int, int, float]]:
    """(d_row, d_col, weight); size is the grid's shorter side. Rounding is to even on halves."""
    most = max(1, (size - 1) // 2)
    out = []
    if method == "gaussian":
        sigma = min(radius_km / cell_km, most / 2)
        r = int(2 * sigma + 0.5)
        out = [(i, j, math.exp(-(i * i + j * j) / (2 * sigma * sigma))) for i in range(-r, r + 1) for j in range(-r, r + 1)]
    elif method == "uniform":
        r = max(1, min(round(math.sqrt(3) * radius_km / cell_km), most))
        out = [(i, j, 1.0) for i in range(-r, r + 1) for j in range(-r, r + 1)]
    elif method == "median":
        r = max(1, min(round(radius_km / cell_km), most))
        out = [(i, j, 1.0) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= r * r]
    elif method == "idw":
        px = min(2 * radius_km / cell_km, most)
        r = math.floor(px)
        out = [(i, j, 1 / max(1.0, math.hypot(i, j)) ** 2) for i in range(-r, r + 1) for j in range(-r, r + 1) if math.hypot(i, j) <= px]
    else:
        raise ValueError(f"unknown method {method!r}")
    return out


def smooth(cells: DataFrame, method: str, radius_km: float, cell_km: float, size: int, largest: int = 4096, field: str = "") -> DataFrame:
    """cells (row, col, v) with ``smooth``: the weighted mean (or median) of the cells with data under the kernel.

    A radius of 0 changes nothing. Cells without data get none from a mean
    without any data near; the kernel, at most ``largest`` offsets, is broadcast.
    field: the name of what v holds; classes and times are refused.
    """
    if not may_smooth(field):
        raise ValueError(f"{field!r} can't be smoothed")
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if radius_km <= 0:
        return cells.withColumn("smooth", F.col("v"))
    offsets = kernel(method, radius_km, cell_km, size)
    if len(offsets) > largest:
        raise ValueError("the kernel is too wide for this grid")
    k = cells.sparkSession.createDataFrame(offsets, "dr int, dc int, w double")
    each = cells.where("v is not null").crossJoin(F.broadcast(k)).select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), "v", "w")
    value = F.median("v") if method == "median" else F.sum(F.col("w") * F.col("v")) / F.sum("w")
    return cells.join(each.groupBy("row", "col").agg(value.alias("smooth")), ["row", "col"], "left")


def regrid_nearest(cells: DataFrame, factor: int) -> DataFrame:
    """Block average onto a grid ``factor`` times coarser."""
    return cells.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.avg("v").alias("v"))


def regrid_bilinear(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (row, col, fr, fc: fractional source row and col) with ``v``: the four neighbours with data, their weights made to sum to one."""
    corners = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    t = targets.withColumn("r0", F.floor("fr").cast("int")).withColumn("c0", F.floor("fc").cast("int")).withColumn("__k", corners)
    wr = F.when(F.col("__k.i") == 1, F.col("fr") - F.col("r0")).otherwise(1 - (F.col("fr") - F.col("r0")))
    wc = F.when(F.col("__k.j") == 1, F.col("fc") - F.col("c0")).otherwise(1 - (F.col("fc") - F.col("c0")))
    t = t.select("row", "col", (F.col("r0") + F.col("__k.i")).alias("sr"), (F.col("c0") + F.col("__k.j")).alias("sc"), (wr * wc).alias("w"))
    s = cells.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "v")
    j = t.join(s, ["sr", "sc"], "left").where("w > 0")
    return j.groupBy("row", "col").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum(F.when(F.col("v").isNotNull(), F.col("w")))).alias("v"))


def regrid_near(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (row, col, fr, fc) with ``v`` of the nearest source cell, halves upwards; NULL off the grid. For classes, which have no mean."""
    s = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), "v")
    t = targets.withColumn("__r", F.floor(F.col("fr") + 0.5).cast("int")).withColumn("__c", F.floor(F.col("fc") + 0.5).cast("int"))
    return t.join(s, ["__r", "__c"], "left").drop("__r", "__c")


def mosaic(*scenes: DataFrame) -> DataFrame:
    """(row, col, v): the largest value of any scene (row, col, v) at each cell that one has; NULL where none has a value."""
    out = scenes[0].select("row", "col", "v")
    for s in scenes[1:]:
        out = out.unionByName(s.select("row", "col", "v"))
    return out.groupBy("row", "col").agg(F.max("v").alias("v"))


def stretch(cells: DataFrame, least: float = 10.0, by: str | None = None) -> DataFrame:
    """(vmin, vmax) for display: the 2nd percentile and the 99th, ``least`` at least, of the values."""
    p = cells.where("v is not null")
    agg = [F.percentile("v", F.lit(0.02)).alias("vmin"), F.greatest(F.percentile("v", F.lit(0.99)), F.lit(least)).alias("vmax")]
    return p.groupBy(by).agg(*agg) if by else p.agg(*agg)


def virga_mask(mosaic_: DataFrame, support: DataFrame, targets: DataFrame, radar: tuple[float, float] | None = None, exclude_km: float = 0.0, least: float = 10.0, ratio: float = 3.0) -> DataFrame:
    """targets (row, col, fr, fc, lon, lat: cells of the support grid) with ``class`` and ``ratio``: the mosaic is brought onto them bilinearly; cells nearer than exclude_km to the radar (lon, lat) have no class."""
    m = regrid_bilinear(mosaic_, targets).withColumnRenamed("v", "mosaic")
    j = targets.join(m, ["row", "col"], "left").join(support.select("row", "col", F.col("v").alias("support")), ["row", "col"], "left")
    kind = physics.virga_class(F.col("mosaic"), F.col("support"), least, ratio)
    if radar and exclude_km > 0:
        near = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(radar[1]), F.lit(radar[0])) < exclude_km
        kind = F.when(near, physics.NO_DATA).otherwise(kind)
    return j.select("row", "col", "mosaic", "support", kind.alias("class"), physics.support_ratio(F.col("mosaic"), F.col("support")).alias("ratio"))


def gradient(cells: DataFrame, cell_m: float) -> DataFrame:
    """cells with gy and gx: central differences, one-sided at the edges."""

    def slope(along: str, across: str) -> Column:
        w = Window.partitionBy(across).orderBy(along)
        a, b = F.lag("v").over(w), F.lead("v").over(w)
        return F.when(a.isNull(), b - F.col("v")).when(b.isNull(), F.col("v") - a).otherwise((b - a) / 2) / cell_m

    return cells.withColumn("gy", slope("row", "col")).withColumn("gx", slope("col", "row"))


def shade(cells: DataFrame, cell_m: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """cells with ``shade`` between 0 and 1: the cosine between surface normal and light, no stretch."""
    az, alt = math.radians(90 - azimuth), math.radians(altitude)
    lx, ly, lz = math.cos(az) * math.cos(alt), math.sin(az) * math.cos(alt), math.sin(alt)
    g = gradient(cells, cell_m)
    dot = (-F.col("gx") * lx + F.col("gy") * ly + lz) / F.sqrt(1 + F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    return g.withColumn("shade", F.when(dot < 0, 0.0).when(dot > 1, 1.0).otherwise(dot)).drop("gx", "gy")


def fill_mean(cells: DataFrame) -> DataFrame:
    return cells.crossJoin(F.broadcast(cells.agg(F.avg("v").alias("__m")))).withColumn("v", F.coalesce("v", "__m")).drop("__m")


def density(points: DataFrame, cell: float) -> DataFrame:
    """(cx, cy, n, per_km2) per equal-area cell of points (x, y) in metres, by count."""
    if cell <= 0:
        raise ValueError("cell must be positive")
    g = points.groupBy(F.floor(F.col("x") / cell).alias("ix"), F.floor(F.col("y") / cell).alias("iy")).agg(F.count("*").alias("n"))
    return g.select(((F.col("ix") + 0.5) * cell).alias("cx"), ((F.col("iy") + 0.5) * cell).alias("cy"), "n", (F.col("n") / (cell / 1000) ** 2).alias("per_km2")).orderBy(F.desc("n"), "cx", "cy")


def density_raster(spark: SparkSession, points: DataFrame, cell: float, bounds: tuple[float, float, float, float]) -> DataFrame:
    """(row, col, n) of a dense grid snapped outward around bounds, zeros included, row 0 in the north."""
    x0, y0 = math.floor(bounds[0] / cell), math.floor(bounds[1] / cell)
    nx, ny = math.ceil(bounds[2] / cell) - x0, math.ceil(bounds[3] / cell) - y0
    grid = spark.range(nx * ny).select(F.floor(F.col("id") / nx).cast("int").alias("row"), (F.col("id") % nx).cast("int").alias("col"))
    n = points.groupBy((ny - 1 - (F.floor(F.col("y") / cell) - y0)).cast("int").alias("row"), (F.floor(F.col("x") / cell) - x0).cast("int").alias("col")).agg(F.count("*").alias("n"))
    return grid.join(n, ["row", "col"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def nearest_source(targets: DataFrame, sources: DataFrame, tolerance: float) -> DataFrame:
    """targets (tid, x, y) with the id and distance of the nearest source (sid, sx, sy) within tolerance; the smaller sid on ties.

    An equi-join on square bins of the tolerance's side, each target looking into nine.
    """
    bins = F.explode(F.array(*(F.struct((F.floor(F.col("x") / tolerance) + i).alias("bx"), (F.floor(F.col("y") / tolerance) + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    t = targets.withColumn("__b", bins).select("tid", "x", "y", "__b.bx", "__b.by")
    s = sources.select("sid", "sx", "sy", F.floor(F.col("sx") / tolerance).alias("bx"), F.floor(F.col("sy") / tolerance).alias("by"))
    d = F.sqrt(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2))
    best = t.join(s, ["bx", "by"]).withColumn("d", d).where(F.col("d") <= tolerance).groupBy("tid").agg(F.min(F.struct("d", "sid")).alias("m"))
    return targets.join(best, "tid", "left").select("tid", "x", "y", F.col("m.sid").alias("sid"), F.col("m.d").alias("d"))


def wet_only(cells: DataFrame, least: float) -> DataFrame:
    """cells with v NULL where it is under ``least``: what a map leaves blank."""
    return cells.withColumn("v", F.when(F.col("v") >= least, F.col("v")))
