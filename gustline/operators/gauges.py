"""Rain gauges: irregular reports to minutes, peaks, cadence and storm windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.operators.radar import epoch


def report_minutes(obs: DataFrame) -> DataFrame:
    """(station_id, report_min): median gap between reports that carry rain; NULL below two."""
    s = obs.where("precip is not null").withColumn("__s", epoch(F.col("ts")))
    gap = (F.col("__s") - F.lag("__s").over(Window.partitionBy("station_id").orderBy("__s"))) / 60
    return s.withColumn("__gap", gap).groupBy("station_id").agg(F.median("__gap").alias("report_min"))


def _reports(obs: DataFrame) -> DataFrame:
    """(station_id, s, c, s0, s2, c2): the cumulative depth c at each report, the first report's time, the next report's time and depth."""
    o = obs.where("precip is not null").select("station_id", epoch(F.col("ts")).alias("s"), F.greatest("precip", F.lit(0.0)).alias("p"))
    o = o.groupBy("station_id", "s").agg(F.sum("p").alias("p"))
    by = Window.partitionBy("station_id").orderBy("s")
    o = o.withColumn("c", F.sum("p").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("s0", F.min("s").over(Window.partitionBy("station_id")))
    return o.withColumn("s2", F.lead("s").over(by)).withColumn("c2", F.lead("c").over(by))


def _between(at: Column, s: Column, c: Column, s2: Column, c2: Column) -> Column:
    """The depth at a time from s on: on the line to the next report, the last one's depth after it."""
    return F.when(s2.isNull(), c).otherwise(c + (c2 - c) * (at - s) / (s2 - s))


def _segments(obs: DataFrame, back: int = 0) -> DataFrame:
    """(station_id, s0, low, high, s, c, s2, c2, before): a report with the steps from low to high that lie from it to the next, one at least, of a minute each from the first report on.

    before holds the depths at the ``back`` steps before low, or as many as
    there are, the last one last. Segments are looked back at, ``back`` at most,
    never minutes.
    """
    o = _reports(obs)
    low = F.ceil((F.col("s") - F.col("s0")) / 60)
    high = F.when(F.col("s2").isNull(), low).otherwise(F.ceil((F.col("s2") - F.col("s0")) / 60) - 1)
    o = o.withColumn("low", low).withColumn("high", high).where("high >= low")
    by = Window.partitionBy("station_id").orderBy("low")
    if back == 1:
        o = o.withColumn("__at", _between(F.col("s0") + F.col("high") * 60, F.col("s"), F.col("c"), F.col("s2"), F.col("c2")))
        return o.withColumn("before", F.lag("__at").over(by)).drop("__at")
    # the steps have no gap, so what reaches back to low - back comes before what begins at low - back + 1
    o = o.withColumn("__before", F.lag(F.struct("low", "high", "s", "c", "s2", "c2")).over(by))
    o = o.withColumn("__before", F.collect_list("__before").over(by.rangeBetween(1 - back, 0)))
    steps = lambda g: F.sequence(F.greatest(g["low"], F.col("low") - back), g["high"])
    depths = lambda g: F.transform(steps(g), lambda k: _between(F.col("s0") + k * 60, g["s"], g["c"], g["s2"], g["c2"]))
    return o.withColumn("before", F.flatten(F.transform("__before", depths))).drop("__before")


def _total(k: Column) -> Column:
    return _between(F.col("s0") + k * 60, F.col("s"), F.col("c"), F.col("s2"), F.col("c2"))


def per_minute(obs: DataFrame) -> DataFrame:
    """(station_id, k, s, total, mm): the cumulative depth, interpolated every 60 s from each station's first report.

    s is in epoch seconds, k counts from 0. The last step may lie beyond the
    last report and then takes its depth. mm is the step's increment, 0 at first.
    Reports are sorted, the minutes are not: none is kept, spilled or exchanged.
    """
    o = _segments(obs, 1).withColumn("k", F.explode(F.sequence("low", "high")))
    total = _total(F.col("k"))
    mm = total - F.when(F.col("k") > F.col("low"), _total(F.col("k") - 1)).otherwise(F.col("before"))
    return o.select("station_id", "k", (F.col("s0") + F.col("k") * 60).alias("s"), total.alias("total"), F.coalesce(mm, F.lit(0.0)).alias("mm"))


def peaks(minutes: DataFrame, durations: tuple[int, ...] = (5, 15, 30, 60)) -> DataFrame:
    """Per station n_min and the peak intensities in mm/h; NULL where the series is shorter than the duration.

    i15 is the mean of the 16- and 14-minute intensities from 16 minutes on, else the plain one.
    """
    by = Window.partitionBy("station_id").orderBy("k")
    s = minutes.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("station_id"))).withColumn("__k", F.row_number().over(by))
    s = s.withColumn("__c", F.sum("mm").over(by.rowsBetween(Window.unboundedPreceding, 0)))

    def fall(d: int) -> Column:
        return (F.col("__c") - F.coalesce(F.lag("__c", d).over(by), F.lit(0.0))) * 60 / d

    for d in durations:
        plain = F.when(F.col("__k") >= d, fall(d))
        s = s.withColumn(f"__i{d}", F.when(F.col("__n") >= 16, F.when(F.col("__k") >= 16, (fall(16) + fall(14)) / 2)).otherwise(plain) if d == 15 else plain)
    return s.groupBy("station_id").agg(F.count("*").alias("n_min"), *(F.max(f"__i{d}").alias(f"i{d}") for d in durations))


def report_peaks(obs: DataFrame, durations: tuple[int, ...] = (5, 15, 30, 60)) -> DataFrame:
    """peaks(per_minute(obs)) without the minutes.

    The depth is linear between reports, so a trailing intensity can peak only
    where its window begins or ends at a minute beside a report: the depth is
    worked out there and a duration away, a few dozen rows a report however long
    the dry spells. One exchange, by station; a station is sorted, never collected.
    """
    reach = {0, *(x for d in durations if d != 15 for x in (d, -d)), *((1, -1, 2, -2, 14, -14, 15, 16, -16) if 15 in durations else ())}
    o = _reports(obs)
    minute = (F.col("s") - F.col("s0")) / 60
    o = o.withColumn("last", F.max(F.ceil(minute)).over(Window.partitionBy("station_id")))
    report = F.struct("s", "c", "s2", "c2")
    beside = o.select("station_id", "s0", "last", F.explode(F.array_distinct(F.array(F.floor(minute), F.ceil(minute)))).alias("e"))
    asked = beside.select("station_id", "last", "e", "s0", F.explode(F.array(*map(F.lit, sorted(reach)))).alias("o")).where(F.col("e") + F.col("o") <= F.col("last"))
    asked = asked.select("station_id", (F.col("s0") + 60 * F.greatest(F.col("e") + F.col("o"), F.lit(0))).alias("at"), F.lit(1).alias("asks"), F.lit(None).cast(o.select(report).schema[0].dataType).alias("r"), "last", "e", "o")
    told = o.select("station_id", F.col("s").alias("at"), F.lit(0).alias("asks"), report.alias("r"), "last", F.lit(None).cast("long").alias("e"), F.lit(None).cast("int").alias("o"))
    before = Window.partitionBy("station_id").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    both = told.unionByName(asked).withColumn("r", F.last("r", ignorenulls=True).over(before)).where("asks = 1")
    both = both.withColumn("t", _between(F.col("at"), F.col("r.s"), F.col("r.c"), F.col("r.s2"), F.col("r.c2")))
    name = {x: f"t{x}".replace("-", "_") for x in reach}
    at = both.groupBy("station_id", "e").agg(F.max("last").alias("last"), *(F.max(F.when(F.col("o") == x, F.col("t"))).alias(name[x]) for x in sorted(reach)))

    def fall(end: int, start: int, minutes: int) -> Column:
        return (F.col(name[end]) - F.col(name[start])) * 60 / minutes

    def ends(k: int, from_: int, value: Column) -> Column:
        return F.when((F.col("e") + k >= from_) & (F.col("e") + k <= F.col("last")), value)

    best = {}
    for d in durations:
        if d == 15:
            tries = [ends(k, 15, (fall(k, k - 16, 16) + fall(k, k - 14, 14)) / 2) for k in (0, 14, 15, 16)]
            tries.append(F.when((F.col("last") == 14) & (F.col("e") == 14), fall(0, -14, 15)))
        else:
            tries = [ends(0, d - 1, fall(0, -d, d)), ends(d, d - 1, fall(d, 0, d))]
        best[d] = F.greatest(*tries)
    return at.groupBy("station_id").agg((F.max("last") + 1).alias("n_min"), *(F.max(x).alias(f"i{d}") for d, x in best.items()))


def intensities(obs: DataFrame) -> DataFrame:
    """Per station: n_obs, total, report_min, n_min and the peaks; a station that never reports rain keeps NULLs."""
    base = obs.groupBy("station_id").agg(F.count("precip").alias("n_obs"), F.sum(F.greatest("precip", F.lit(0.0)) + F.lit(0.0) * F.col("precip")).alias("total"))
    return base.join(report_minutes(obs), "station_id", "left").join(report_peaks(obs), "station_id", "left")


def storm_window(minutes: DataFrame, pad_minutes: int = 30, cover: float = 0.99) -> DataFrame:
    """(start_s, end_s) of the minutes that hold ``cover`` of all gauges' rain, padded; no row if dry."""
    tail = (1 - cover) / 2
    by_minute = minutes.groupBy("s").agg(F.sum("mm").alias("mm"))
    w = Window.orderBy("s")  # one row a minute, all stations summed
    c = by_minute.withColumn("c", F.sum("mm").over(w.rowsBetween(Window.unboundedPreceding, 0))).crossJoin(F.broadcast(by_minute.agg(F.sum("mm").alias("all")))).where("all > 0").withColumn("c", F.col("c") / F.col("all"))
    out = c.agg(F.min(F.when(F.col("c") >= tail, F.col("s"))).alias("a"), F.max(F.when(F.col("c") <= 1 - tail, F.col("s"))).alias("b")).where("a is not null")
    return out.select((F.col("a") - pad_minutes * 60).alias("start_s"), (F.coalesce("b", "a") + pad_minutes * 60).alias("end_s"))


def series(minutes: DataFrame) -> DataFrame:
    """rate and trailing intensities by differences of the total; NULL until a window is full. It sorts the minutes; see report_series."""
    by = Window.partitionBy("station_id").orderBy("k")

    def diff(d: int) -> Column:
        return (F.col("total") - F.lag("total", d).over(by)) * 60 / d

    return minutes.select("station_id", "k", "s", "total", (F.col("mm") * 60).alias("rate"), diff(5).alias("i5"), ((diff(16) + diff(14)) / 2).alias("i15"), diff(30).alias("i30"), diff(60).alias("i60"))


def report_series(obs: DataFrame) -> DataFrame:
    """series(per_minute(obs)) without a sort of the minutes: all intensities of a window on one report's line are the line's, an earlier depth is among the 60 before it."""
    line = F.coalesce((F.col("c2") - F.col("c")) * 3600 / (F.col("s2") - F.col("s")), F.lit(0.0))
    o = _segments(obs, 60).withColumn("line", line).withColumn("n", F.size("before")).withColumn("k", F.explode(F.sequence("low", "high")))
    out = o.select("station_id", "k", "low", "n", "line", "before", (F.col("s0") + F.col("k") * 60).alias("s"), _total(F.col("k")).alias("total"), (F.col("k") - F.col("low")).cast("int").alias("j"))

    def diff(d: int) -> Column:
        crossing = F.when(F.col("n") + F.col("j") >= d, (F.col("total") - F.get("before", F.col("n") + F.col("j") - d)) * 60 / d)
        return F.when(F.col("j") >= d, F.col("line")).otherwise(crossing)

    return out.select("station_id", "k", "s", "total", F.coalesce(diff(1), F.lit(0.0)).alias("rate"), diff(5).alias("i5"), ((diff(16) + diff(14)) / 2).alias("i15"), diff(30).alias("i30"), diff(60).alias("i60"))
