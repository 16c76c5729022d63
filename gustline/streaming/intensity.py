"""The peak intensity window on a stream of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_peaks(scans: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(cell, day, i15): the day's peak of the 15-minute intensity per cell, from a stream (ts, cell, rate) in append mode.

    Sixteen minutes every two hold eight scans or are left out; i15 is the mean
    of the 16- and the 14-minute intensity, the latter without the window's
    first scan. Events later than ``late`` are dropped by the watermark.
    """
    a2 = F.coalesce(F.greatest("rate", F.lit(0.0)), F.lit(0.0)) * 2 / 60
    w = scans.withColumn("a2", a2).withWatermark("ts", late).groupBy("cell", F.window("ts", "16 minutes", "2 minutes").alias("w"))
    each = w.agg(F.sum("a2").alias("s16"), F.min(F.struct("ts", "a2")).alias("first"), F.count(F.lit(1)).alias("n")).where("n = 8")
    i15 = (F.col("s16") * 60 / 16 + (F.col("s16") - F.col("first.a2")) * 60 / 14) / 2
    daily = each.select("cell", i15.alias("i15"), F.window_time("w").alias("t")).groupBy("cell", F.window("t", "1 day").alias("d"))
    return daily.agg(F.max("i15").alias("i15")).select("cell", F.col("d.start").alias("day"), "i15")
