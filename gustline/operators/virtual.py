"""Rain series at points of a stack of scans, and peaks of stacks with irregular times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.operators.radar import epoch, merge_equal_scans


def window_hours(hours: DataFrame, start: Column, end: Column) -> DataFrame:
    """hours with ``t`` for each hour from the one that start falls in to end, one at least."""
    first = F.date_trunc("hour", start)
    last = F.greatest(F.date_trunc("hour", end), first)
    return hours.withColumn("t", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))))


def storm_day(day: Column, from_hour: int = 4, to_hour: int = 9) -> tuple[Column, Column]:
    """From ``from_hour`` of a day to ``to_hour`` of the next, in UTC: what covers a local calendar day."""
    midnight = F.date_trunc("day", day)
    return midnight + F.make_dt_interval(hours=F.lit(from_hour)), midnight + F.make_dt_interval(days=F.lit(1), hours=F.lit(to_hour))


def first_product(products: list[DataFrame]) -> DataFrame:
    """(t, cell, value, rank) from hourly products (t, cell, value), the best first: an hour comes from the first product that has any of it."""
    ranked = products[0].select("t", "cell", "value", F.lit(0).alias("rank"))
    for i, p in enumerate(products[1:], 1):
        ranked = ranked.unionByName(p.select("t", "cell", "value", F.lit(i).alias("rank")))
    best = ranked.groupBy("t").agg(F.min("rank").alias("rank"))
    return ranked.join(best, ["t", "rank"])


def at_minutes(samples: DataFrame, key: str, span: DataFrame) -> DataFrame:
    """(key, k, s, rate) of every minute of each key's span, interpolated in time between the samples.

    samples: (key, s: epoch seconds, rate); those without a rate don't count,
    the first of equal times does. span: (key, start, end) in seconds. Gaps are
    bridged, the last rate goes on to the end, and before the first it is NULL.
    One exchange, by key.
    """
    known = samples.where("rate is not null").groupBy(key, "s").agg(F.min_by("rate", F.col("nth") if "nth" in samples.columns else F.lit(0)).alias("rate"))
    spine = span.select(key, F.col("start"), F.explode(F.sequence("start", "end", F.lit(60))).alias("s"))
    both = spine.select(key, "s", ((F.col("s") - F.col("start")) / 60).cast("long").alias("k"), F.lit(None).cast("struct<s:bigint,rate:double>").alias("p"))
    both = both.unionByName(known.select(key, "s", F.lit(None).cast("long").alias("k"), F.struct(F.col("s").cast("long").alias("s"), F.col("rate").cast("double").alias("rate")).alias("p")))
    by = Window.partitionBy(key).orderBy("s", F.asc_nulls_first("k"))
    both = both.withColumn("a", F.last("p", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("b", F.last("p", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc("s"), F.desc_nulls_last("k")).rowsBetween(Window.unboundedPreceding, 0)))
    a, b = F.col("a"), F.col("b")
    rate = F.when(b["s"].isNull() | (b["s"] <= a["s"]), a["rate"]).otherwise(a["rate"] + (b["rate"] - a["rate"]) * (F.col("s") - a["s"]) / (b["s"] - a["s"]))
    return both.where("k is not null").select(key, "k", "s", rate.alias("rate"))


def series(minutes: DataFrame, key: str, durations: tuple[int, ...] = (5, 15, 30, 60)) -> DataFrame:
    """minutes (key, k, s, rate) with the cumulative total and the trailing intensities by its differences; NULL until a window is full."""
    by = Window.partitionBy(key).orderBy("k")
    out = minutes.withColumn("total", F.when(F.col("rate").isNotNull(), F.sum(F.col("rate") / 60).over(by.rowsBetween(Window.unboundedPreceding, 0))))

    def diff(d: int) -> Column:
        return (F.col("total") - F.lag("total", d).over(by)) * 60 / d

    return out.select("*", *(((diff(16) + diff(14)) / 2 if d == 15 else diff(d)).alias(f"i{d}") for d in durations))


def hourly_reference(minutes: DataFrame, hourly: DataFrame, key: str) -> DataFrame:
    """minutes with i60_qpe and total_qpe (the sum less the first hour) of hourly amounts (key, s, value), on the hours' rows alone."""
    by = Window.partitionBy(key).orderBy("s")
    total = F.sum("value").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.first("value").over(by.rowsBetween(Window.unboundedPreceding, 0))
    h = hourly.select(key, "s", F.col("value").alias("i60_qpe"), F.when(F.col("value").isNotNull(), total).alias("total_qpe"))
    return minutes.join(h, [key, "s"], "left")


def whole_window(minutes: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """(key, k, s, mm) of every minute from start to end (epoch seconds): no rain where a key has no row at just that time."""
    keys = minutes.select(key).distinct()
    spine = keys.select(key, F.posexplode(F.sequence(F.lit(start).cast("long"), F.lit(end).cast("long"), F.lit(60).cast("long"))).alias("k", "s"))
    return spine.join(minutes.select(key, "s", "mm"), [key, "s"], "left").select(key, "k", "s", F.coalesce("mm", F.lit(0.0)).alias("mm"))


def stack_peaks(scans: DataFrame, rates: tuple[str, ...] = ("rate",), durations: tuple[int, ...] = (15, 30, 60)) -> DataFrame:
    """Per cell the peaks of scans (cell, s, rates) at irregular times: for each rate column i15, i30, i60, total and peak (suffixed but for the first).

    No echo is no rain. Rates are interpolated to a minute's grid from the first
    scan on; a duration needs one minute more than it has, else it is NULL. One
    exchange, by cell.
    """
    by = Window.partitionBy("cell").orderBy("s")
    rows = scans.select("cell", "s", *(F.coalesce(F.col(r), F.lit(0.0)).cast("double").alias(f"r_{r}") for r in rates))
    rows = rows.withColumn("s0", F.min("s").over(Window.partitionBy("cell"))).withColumn("s2", F.lead("s").over(by))
    for r in rates:
        rows = rows.withColumn(f"n_{r}", F.lead(f"r_{r}").over(by))
    low = F.ceil((F.col("s") - F.col("s0")) / 60)
    high = F.when(F.col("s2").isNull(), low).otherwise(F.ceil((F.col("s2") - F.col("s0")) / 60) - 1)
    # the last scan is a minute of its own only if it falls on the grid
    on_grid = F.col("s2").isNotNull() | (F.pmod(F.col("s") - F.col("s0"), F.lit(60)) == 0)
    m = rows.withColumn("k", F.explode(F.when(on_grid & (high >= low), F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    at = F.col("s0") + F.col("k") * 60
    for r in rates:
        here = F.when(F.col("s2").isNull(), F.col(f"r_{r}")).otherwise(F.col(f"r_{r}") + (F.col(f"n_{r}") - F.col(f"r_{r}")) * (at - F.col("s")) / (F.col("s2") - F.col("s")))
        m = m.withColumn(f"a_{r}", here / 60)
    by = Window.partitionBy("cell").orderBy("k")
    m = m.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("cell")))
    for r in rates:
        m = m.withColumn(f"c_{r}", F.sum(f"a_{r}").over(by.rowsBetween(Window.unboundedPreceding, 0)))

    def fall(r: str, d: int) -> Column:
        return (F.col(f"c_{r}") - F.coalesce(F.lag(f"c_{r}", d).over(by), F.lit(0.0))) * 60 / d

    out = []
    for i, r in enumerate(rates):
        tail = f"_{r}" if i else ""
        for d in durations:
            value = (fall(r, 16) + fall(r, 14)) / 2 if d == 15 else fall(r, d)
            full = 16 if d == 15 else d
            m = m.withColumn(f"i{d}{tail}", F.when((F.col("m") > full) & (F.col("k") >= full - 1), value))
            out.append(F.max(f"i{d}{tail}").alias(f"i{d}{tail}"))
        out += [F.sum(f"a_{r}").alias(f"total{tail}"), F.max(f"r_{r}").alias(f"peak{tail}")]
    return m.groupBy("cell").agg(F.max("m").alias("minutes"), *out)


def intensity_stack(scans: DataFrame, cap: float | None = None, spread: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """stack_peaks of scans (cell, ts, rate): equal times merged, rates clipped to ``cap``, with the peaks of the lower and upper rates (_lo, _hi)."""
    merged = merge_equal_scans(scans)
    rate = F.col("rate") if cap is None else F.when(F.col("rate") > cap, cap).otherwise(F.col("rate"))
    s = merged.select("cell", epoch(F.col("ts")).alias("s"), rate.alias("rate"), (rate * spread[0]).alias("lo"), (rate * spread[1]).alias("hi"))
    return stack_peaks(s, ("rate", "lo", "hi"))
