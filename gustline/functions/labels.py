"""Names, labels, dates and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes -> the code that grid files carry (fixed values).
DURATION_CODES = {5: "05m", 10: "10m", 15: "15m", 30: "30m", 60: "60m", 120: "02h", 180: "03h", 360: "06h", 720: "12h", 1440: "24h", 2880: "48h", 4320: "03d"}
#: Estimate -> suffix of a grid file (fixed values).
ESTIMATES = {"mean": "a", "lower": "al", "upper": "au"}
#: Beginnings of field names that are classes or times and must never be smoothed (fixed values).
NEVER_SMOOTH = ("tpk", "class", "relmode", "severity", "virga")


def two_digits(x: Column) -> Column:
    """A number from 0 to 1 with two significant digits, without zeros at its end; with an exponent below 0.0001."""
    places = 1 - F.floor(F.log10(x)).cast("int")
    text = F.element_at(F.array(*(F.format_string(f"%.{p}f", x) for p in range(1, 7))), F.greatest(F.lit(1), F.least(F.lit(6), places)))
    plain = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return F.when(x <= 0, "0").when(x < 1e-4, F.replace(F.format_string("%.1e", x), F.lit(".0e"), F.lit("e"))).otherwise(plain)


def interval_label(years: Column, above: Column) -> Column:
    """Blank without a value, >1000 above the curve, one decimal from a year on, else two significant digits."""
    return F.when(above, ">1000").when(years.isNull(), "").when(years >= 1, F.format_string("%.1f", years)).otherwise(two_digits(years))


def cadence_label(minutes: Column) -> Column:
    """NULL without a cadence, daily from 1440 minutes on, hourly at 60, else ~N-min."""
    return F.when(minutes.isNull(), F.lit(None).cast("string")).when(minutes >= 1440, "daily").when(minutes == 60, "hourly").otherwise(F.concat(F.lit("~"), F.round(minutes).cast("int").cast("string"), F.lit("-min")))


def shorten(name: Column, limit: int = 26) -> Column:
    """A name over ``limit`` characters cut at its last space within them, or within a word if it has none, and an ellipsis."""
    head = F.substring(name, 1, limit - 1)
    cut = F.regexp_replace(head, r" [^ ]*$", "")
    return F.when(F.length(name) <= limit, name).otherwise(F.concat(F.when(cut != "", cut).otherwise(head), F.lit("…")))


def parse_date(text: Column) -> Column:
    """A date from yyyymmdd or yyyy-mm-dd; NULL for anything else."""
    plain = F.replace(F.trim(text), F.lit("-"), F.lit(""))
    return F.when(plain.rlike(r"^\d{8}$"), F.try_to_timestamp(plain, F.lit("yyyyMMdd")).cast("date"))


def duration_code(minutes: Column) -> Column:
    """The code of a duration in minutes; NULL if grids have none."""
    out = F.lit(None).cast("string")
    for m, code in DURATION_CODES.items():
        out = F.when(minutes == m, code).otherwise(out)
    return out


def grid_name(region: Column, ari: Column, minutes: Column, estimate: str = "mean", partial: bool = True) -> Column:
    """File name of a precipitation-frequency grid; partial: of the partial-duration series, else of annual maxima."""
    return F.concat(region, ari.cast("string"), F.lit("yr"), duration_code(minutes), F.lit(ESTIMATES[estimate] + ("" if partial else "_ams") + ".zip"))


def colour(value: Column, breaks: list[float], colours: list[str]) -> Column:
    """The colour of the class that a value falls in, as #RRGGBB; NULL without a value."""
    if len(colours) != len(breaks) + 1:
        raise ValueError("one colour more than breaks")
    at = sum((F.when(value >= b, 1).otherwise(0) for b in breaks), F.lit(1))
    names = F.array(*(F.lit("#" + c.lstrip("#").upper()) for c in colours))
    return F.when(value.isNotNull() & ~F.isnan(value), F.element_at(names, at))


def class_labels(breaks: list[float], unit: str = "") -> list[str]:
    """What the classes between the breaks are called, the lowest first."""
    tail = f" {unit}" if unit else ""
    return [f"< {breaks[0]:g}{tail}", *(f"{a:g} - {b:g}{tail}" for a, b in zip(breaks, breaks[1:])), f">= {breaks[-1]:g}{tail}"]


def may_smooth(field: str) -> bool:
    """Whether a field of this name holds amounts, not classes or times."""
    return not any(x in field for x in NEVER_SMOOTH)
