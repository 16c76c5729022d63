"""Scene catalogs, features and stream gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.operators.radar import epoch

#: Feature type -> group (fixed values).
FEATURE_GROUPS = {
    "waste": ["mine dump", "slag pile", "ore stockpile/storage", "leach pond", "settling pond"],
    "openings": ["adit", "mine shaft", "air shaft", "glory hole"],
    "surface": ["open pit mine", "open pit mine or quarry", "strip mine", "placer mine", "hydraulic mine", "mine", "coal mine", "uranium mine", "silica mine", "iron pit", "lignite pit", "evaporation pond", "salt evaporator"],
    "aggregate": ["borrow pit", "gravel pit", "sand pit", "sand and gravel pit", "gravel/borrow pit - undifferentiated", "cinder pit", "scoria pit", "clay pit", "marl pit", "caliche pit", "chert pit", "bentonite pit", "shale pit", "shell pit"],
    "prospect": ["prospect pit", "diggings", "trench"],
    "other": ["mill site", "tipple"],
}
#: Beginnings of feature types not listed above -> group (fixed values).
FEATURE_FAMILIES = {"tailings": "waste", "quarry": "surface", "disturbed surface": "surface"}


def parse_scene(filename: Column, token: str = "dNBR") -> Column:
    """struct(fire, state, date) from ``<Fire>[-ST][-prelim]-<token>_<yyyymmdd>_<hhmmss>.tif``; NULL for other names."""
    shape = rf"^(.+?)-{token}_(\d{{8}})_(\d{{6}})\.tif$"
    name = F.regexp_replace(F.regexp_extract(filename, shape, 1), "(?i)-prelim$", "")
    state = F.regexp_extract(name, "^(.+)-([A-Za-z]{2})$", 2)
    fire = F.when(state != "", F.regexp_extract(name, "^(.+)-([A-Za-z]{2})$", 1)).otherwise(name)
    return F.when(filename.rlike(shape), F.struct(fire.alias("fire"), F.nullif(F.upper(state), F.lit("")).alias("state"), F.to_date(F.regexp_extract(filename, shape, 2), "yyyyMMdd").alias("date")))


def hrefs(html: Column, pattern: str = r'href="([^"]*)"') -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def latest_scenes(scenes: DataFrame, as_of: str | None = None, since: str | None = None, min_age_days: int | None = None) -> DataFrame:
    """The last scene per fire up to as_of, with age_days since the fire's first scene in the whole catalog."""
    s = scenes.withColumn("first_seen", F.min("date").over(Window.partitionBy("fire")))
    if as_of:
        s = s.where(F.col("date") <= F.lit(as_of).cast("date"))
    if since:
        s = s.where(F.col("date") >= F.lit(since).cast("date"))
    last = s.withColumn("__rn", F.row_number().over(Window.partitionBy("fire").orderBy(F.desc("date"), F.desc("filename")))).where("__rn = 1").drop("__rn")
    last = last.withColumn("age_days", F.datediff("date", "first_seen"))
    return last.where(F.col("age_days") >= min_age_days) if min_age_days is not None else last


def scenes_in(scenes: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Scenes (w, s, e, n) that meet the area, with the share of it they cover, the largest first."""
    dx = F.least("e", F.lit(east)) - F.greatest("w", F.lit(west))
    dy = F.least("n", F.lit(north)) - F.greatest("s", F.lit(south))
    meets = (F.col("e") >= west) & (F.col("w") <= east) & (F.col("n") >= south) & (F.col("s") <= north)
    return scenes.where(meets).withColumn("overlap", dx * dy / ((east - west) * (north - south))).orderBy(F.desc("overlap"))


def feature_group(ftr_type: Column) -> Column:
    """Group of a feature type: the list first, then the families, else other."""
    t = F.lower(F.trim(ftr_type))
    out = F.lit("other")
    for prefix, group in FEATURE_FAMILIES.items():
        out = F.when(t.startswith(prefix), group).otherwise(out)
    for group, types in FEATURE_GROUPS.items():
        out = F.when(t.isin(types), group).otherwise(out)
    return F.coalesce(out, F.lit("other"))


def kinds_filter(ftr_type: Column, kinds: list[str] | str) -> Column:
    """Rows of these groups or exact types; a string is cut at commas and spaces; "all" keeps everything."""
    wanted = kinds.replace(",", " ").split() if isinstance(kinds, str) else list(kinds)
    if "all" in wanted:
        return F.lit(True)
    groups = [k for k in wanted if k in FEATURE_GROUPS]
    types = [k.lower() for k in wanted if k not in FEATURE_GROUPS]
    return feature_group(ftr_type).isin(groups) | F.coalesce(F.lower(F.trim(ftr_type)).isin(types), F.lit(False))


def group_counts(features: DataFrame) -> DataFrame:
    """(group, n, types) in the fixed order of the groups; types is joined by "; "."""
    g = features.groupBy(feature_group(F.col("ftr_type")).alias("group")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("ftr_type")), "; ").alias("types"))
    order = F.array_position(F.array(*map(F.lit, FEATURE_GROUPS)), F.col("group"))
    return g.orderBy(order)


def flow_summary(sites: DataFrame, flow: DataFrame) -> DataFrame:
    """sites with peak, its first time, start, rise, ratio, stage peak, cadence, whether the peak is at the record's edge, and unit discharge."""
    f = flow.where("cfs is not null").withColumn("__s", epoch(F.col("time")))
    gap = (F.col("__s") - F.lag("__s").over(Window.partitionBy("site").orderBy("__s"))) / 60
    a = f.withColumn("__g", gap).groupBy("site").agg(
        F.max("cfs").alias("peak_cfs"), F.expr("min_by(time, struct(-cfs, time))").alias("peak_time"), F.expr("min_by(cfs, time)").alias("start_cfs"),
        F.max("stage").alias("peak_stage"), F.count("*").alias("n_obs"), F.median("__g").alias("report_min"), F.max("__s").alias("__last"),
    )
    edge = F.col("__last") - epoch(F.col("peak_time")) <= 1.5 * F.greatest(F.coalesce("report_min", F.lit(1.0)), F.lit(1.0)) * 60
    a = a.withColumn("rise_cfs", F.col("peak_cfs") - F.col("start_cfs")).withColumn("ratio", F.when(F.col("start_cfs") > 0, F.col("peak_cfs") / F.col("start_cfs"))).withColumn("peak_at_edge", edge).drop("__last")
    out = sites.join(a, "site", "left")
    return out.withColumn("unit_cms_km2", F.try_divide(F.col("peak_cfs") * 0.028316846592, F.col("drain_km2")))


def latest_reading(readings: DataFrame) -> DataFrame:
    """(site, time, discharge_cfs, stage_ft): the last arrival of each (site, code, time), codes side by side, -999999 dropped."""
    r = readings.where("value <> -999999")
    r = r.withColumn("__rn", F.row_number().over(Window.partitionBy("site", "code", "time").orderBy(F.desc("seq")))).where("__rn = 1")
    return r.groupBy("site", "time").agg(F.max(F.when(F.col("code") == "00060", F.col("value"))).alias("discharge_cfs"), F.max(F.when(F.col("code") == "00065", F.col("value"))).alias("stage_ft"))


def nearest_site(points: DataFrame, sites: DataFrame, distance: Column, largest: int = 10_000) -> DataFrame:
    """points with the nearest of a few sites (sid): the first sid on ties. Sites are counted, then broadcast."""
    if sites.count() > largest:
        raise ValueError("too many sites to broadcast")
    return points.crossJoin(F.broadcast(sites)).groupBy("id").agg(F.min(F.struct(distance.alias("km"), F.col("sid"))).alias("m")).select("id", F.col("m.sid").alias("sid"), F.col("m.km").alias("km"))


def nearest_in_time(wanted: DataFrame, scans: DataFrame, within_s: int) -> DataFrame:
    """wanted (id, t) with the scan (scan, ts: seconds) nearest in time, the earlier on ties; NULL if none is near enough.

    Joined on bins of within_s seconds, each request looking into three.
    """
    w = wanted.withColumn("__b", F.explode(F.array(*((F.floor(F.col("t") / within_s) + i) for i in (-1, 0, 1)))))
    s = scans.withColumn("__b", F.floor(F.col("ts") / within_s))
    j = w.join(s, "__b").withColumn("dt", F.abs(F.col("t") - F.col("ts"))).where(F.col("dt") <= within_s)
    best = j.groupBy("id").agg(F.min(F.struct("dt", "ts", "scan")).alias("m"))
    return wanted.join(best, "id", "left").select("id", "t", F.col("m.scan").alias("scan"), F.col("m.dt").alias("dt"))


def first_per_name(places: DataFrame, order: list[str]) -> DataFrame:
    return places.withColumn("__rn", F.row_number().over(Window.partitionBy("name").orderBy(*order))).where("__rn = 1").drop("__rn")


def safe_names(names: DataFrame) -> DataFrame:
    """(name, safe): other characters become "_", and equal stems get _2, _3 .. in order of name."""
    stem = F.regexp_replace("name", "[^A-Za-z0-9]+", "_")
    rn = F.row_number().over(Window.partitionBy(F.lower("stem")).orderBy("name"))
    return names.select("name").distinct().withColumn("stem", stem).withColumn("rn", rn).select("name", F.when(F.col("rn") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), F.col("rn"))).alias("safe"))


def class_table(values: DataFrame, cell_km2: float) -> DataFrame:
    """(class, pixels, area_km2, fraction) of column class, NULL left out."""
    g = values.where("class is not null").groupBy("class").agg(F.count("*").alias("pixels"))
    all_ = g.agg(F.sum("pixels").alias("all"))
    return g.crossJoin(F.broadcast(all_)).select("class", "pixels", (F.col("pixels") * cell_km2).alias("area_km2"), (F.col("pixels") / F.col("all")).alias("fraction"))


def named_points(points: DataFrame, order: str) -> DataFrame:
    """points with a name each: VG and the point's place in ``order`` where it has none."""
    rn = F.row_number().over(Window.orderBy(order))  # the points that a user asks for
    return points.withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("VG"), rn)))


def radar_location(wanted: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """wanted with the site of its radar; one that is unknown raises when the rows are read."""
    s = sites.withColumn("__known", F.lit(True))
    j = wanted.join(s, key, "left")
    known = F.when(F.col("__known"), True).otherwise(F.raise_error(F.concat(F.lit("unknown radar "), F.col(key).cast("string"))).cast("boolean"))
    return j.where(known).drop("__known")


def top_values(rows: DataFrame, value: str, key: str, most: int) -> DataFrame:
    """The ``most`` largest values, ties by key."""
    return rows.orderBy(F.desc_nulls_last(value), key).limit(most)


def panels(sites: DataFrame, flow: DataFrame, min_peak: float | None = None) -> DataFrame:
    """sites with their peak, the highest first and those without data last; with min_peak lower ones are left out."""
    p = sites.join(flow.groupBy("site").agg(F.max("cfs").alias("peak")), "site", "left")
    p = p if min_peak is None else p.where(F.col("peak").isNull() | (F.col("peak") >= min_peak))
    return p.orderBy(F.desc_nulls_last("peak"), "site")


def wettest(sites: DataFrame, gauges: DataFrame, key: str, gauge: str, value: str) -> DataFrame:
    """sites with the gauge of the largest value beside them, the first on ties."""
    best = gauges.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(gauge, F.struct(-F.col(value), F.col(gauge))).alias(gauge))
    return sites.join(best, key, "left")


def named_only(features: DataFrame) -> DataFrame:
    return features.where(F.coalesce(F.trim("name"), F.lit("")) != "")


def of_fires(scenes: DataFrame, names: list[str]) -> DataFrame:
    """Scenes of these fires, whatever the case."""
    return scenes.where(F.lower("fire").isin([n.lower() for n in names]))
