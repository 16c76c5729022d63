"""Peak rainfall intensity from a time stack of scans, one row per scan and cell.

A scan that is missing has no rows; a cell without data in a scan has a row with
a NULL rate. The first breaks a window, the second counts as no rain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 120  # seconds between scans


def epoch(ts: Column) -> Column:
    """Whole seconds of a timestamp with or without a zone, read as UTC."""
    return F.unix_timestamp(ts.cast("timestamp"))


def depth_2min(rate: Column) -> Column:
    return F.coalesce(F.greatest(rate, F.lit(0.0)), F.lit(0.0)) * 2 / 60


def trailing_intensity(scans: DataFrame) -> DataFrame:
    """scans (ts, cell, rate) with a2, i15, i30 and i60 in mm/h; NULL where the window has a gap.

    i15 is the mean of the 16- and the 14-minute intensity. One exchange, by cell.
    """
    s = scans.withColumn("a2", depth_2min(F.col("rate"))).withColumn("__s", epoch(F.col("ts")))
    by = Window.partitionBy("cell").orderBy("__s")

    def back(n: int) -> Window:
        return by.rangeBetween(-(n - 1) * STEP, 0)

    def whole(n: int, value: Column) -> Column:
        return F.when(F.count(F.lit(1)).over(back(n)) == n, value)

    i15 = (F.sum("a2").over(back(8)) * 60 / 16 + F.sum("a2").over(back(7)) * 60 / 14) / 2
    return s.select(*scans.columns, "a2", whole(8, i15).alias("i15"), whole(15, F.sum("a2").over(back(15)) * 2).alias("i30"), whole(30, F.sum("a2").over(back(30))).alias("i60"))


def storm_fields(scans: DataFrame) -> DataFrame:
    """Per cell: the peaks of i15, i30, i60 and of the 2-minute rate, the total, and the hour of day of the first i15 peak."""
    w = trailing_intensity(scans)
    first = F.expr("min_by(ts, struct(-i15, ts)) FILTER (WHERE i15 > 0)")
    peak = F.hour(F.col("__peak")) + F.minute(F.col("__peak")) / 60
    out = w.groupBy("cell").agg(F.max("i15").alias("i15"), F.max("i30").alias("i30"), F.max("i60").alias("i60"), F.max(F.col("a2") * 30).alias("i2"), F.sum("a2").alias("total"), first.alias("__peak"))
    return out.withColumn("tpki15", peak).drop("__peak")


def wet_hours(hourly: DataFrame, hours: DataFrame, threshold: float = 2.5, most: int | None = None) -> DataFrame:
    """(t, qmax) of the hours whose areal maximum exceeds the threshold; the best hour if none does; the ``most`` wettest, by time.

    hours (t): those to look at; hourly (t, value): an hour without rows or data is dry.
    """
    q = hours.join(hourly, "t", "left").groupBy("t").agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("qmax"))
    # one row an hour: sorted and cut as one array, in one pass over the scans
    hours_ = q.agg(F.array_sort(F.collect_list(F.struct((-F.col("qmax")).alias("dry"), "t"))).alias("all"))
    wet = F.filter("all", lambda x: x["dry"] < -threshold)
    top = F.when(F.size(wet) > 0, F.slice(wet, 1, most) if most else wet).otherwise(F.slice("all", 1, 1))
    return hours_.select(F.explode(top).alias("x")).select("x.t", (-F.col("x.dry")).alias("qmax")).orderBy("t")


def contiguous_runs(hours: DataFrame) -> DataFrame:
    """(run, start, end, n) of hours t no more than an hour apart."""
    by = Window.orderBy("t")  # the wet hours of one storm window
    gap = F.coalesce((epoch(F.col("t")) - epoch(F.lag("t").over(by)) > 3600).cast("int"), F.lit(0))
    marked = hours.withColumn("__gap", gap).withColumn("run", F.sum("__gap").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.groupBy("run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"))


def stack_spans(runs: DataFrame) -> DataFrame:
    """(run, ts): each 2-minute step from an hour and 14 minutes before a run's first hour to its last."""
    first = F.col("start") - F.expr("INTERVAL '1:14' HOUR TO MINUTE")
    return runs.select("run", F.explode(F.sequence(first, F.col("end"), F.expr("INTERVAL 2 MINUTES"))).alias("ts"))


def wet_window(hourly: DataFrame, threshold: float = 2.5, pad_minutes: int = 30) -> DataFrame:
    """(start, end) from an hour before the first wet hour to the last, padded; no row if all are dry."""
    wet = hourly.where(F.col("value") > threshold)
    pad = F.make_dt_interval(mins=F.lit(pad_minutes))
    out = wet.agg(F.min("t").alias("a"), F.max("t").alias("b")).where(F.col("a").isNotNull())
    return out.select((F.col("a") - F.expr("INTERVAL 1 HOUR") - pad).alias("start"), (F.col("b") + pad).alias("end"))


def multisensor_total(hourly: DataFrame) -> DataFrame:
    """Per cell the sum of hourly amounts, and over how many hours."""
    return hourly.groupBy("cell").agg(F.sum(F.coalesce(F.greatest("value", F.lit(0.0)), F.lit(0.0))).alias("total"), F.countDistinct("t").alias("n_hours"))


def hydro_usage(gates: DataFrame, by: list[str]) -> DataFrame:
    """How often each relation was used (class; rate), and the commonest of classes 1 to 4: the lowest on ties, 0 if none."""
    n = [F.count_if((F.col("class") == k) & ((F.col("rate") > 1) if k < 4 else F.lit(True))).alias(f"n{k}") for k in range(1, 5)]
    counts = F.array(*(F.col(f"n{k}") for k in range(1, 5)))
    return gates.groupBy(*by).agg(*n).withColumn("relmode", F.when(F.array_max(counts) > 0, F.array_position(counts, F.array_max(counts))).otherwise(0).cast("int"))


def merge_equal_scans(scans: DataFrame) -> DataFrame:
    """One value per (cell, ts): the mean of equal times, NULL if one of them is."""
    return scans.groupBy("cell", "ts").agg(F.when(F.count("rate") == F.count(F.lit(1)), F.avg("rate")).alias("rate"))


def composite(scans: DataFrame, most: int) -> DataFrame:
    """Per cell the maximum over at most ``most`` evenly spaced scans."""
    times = scans.select("ts").distinct()
    ranked = times.withColumn("__rn", F.row_number().over(Window.orderBy("ts")) - 1).crossJoin(F.broadcast(times.agg(F.ceil(F.count("*") / most).alias("__step"))))
    kept = ranked.where(F.col("__rn") % F.col("__step") == 0).select("ts")
    return scans.join(kept, "ts").groupBy("cell").agg(F.max("rate").alias("peak"), F.count_distinct("ts").alias("n_scans"))


def low_sweeps(sweeps: DataFrame, least_gap: float = 90.0, tilt: float = 0.25) -> DataFrame:
    """(volume, times): the low sweeps with echo, each at least least_gap seconds after the one kept before."""
    low = F.min("angle").over(Window.partitionBy("volume"))
    rows = sweeps.withColumn("__low", low).where((F.col("angle") <= F.col("__low") + tilt) & F.col("has_echo"))
    times = rows.groupBy("volume").agg(F.array_sort(F.collect_list("t")).alias("t"))  # the sweeps of one volume
    keep = F.aggregate("t", F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, -1) >= least_gap), F.concat(a, F.array(x))).otherwise(a))
    return times.select("volume", keep.alias("times"))


def cumulative_blockage(gates: DataFrame) -> DataFrame:
    """cbb: the largest partial blockage pbb from the radar out to each gate."""
    return gates.withColumn("cbb", F.max("pbb").over(Window.partitionBy("ray").orderBy("gate").rowsBetween(Window.unboundedPreceding, 0)))
