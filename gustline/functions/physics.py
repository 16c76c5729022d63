"""Rain, evaporation and classification formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gustline.functions.nulls import clip

#: Z = a R^b relations (fixed values).
RATE_RELATIONS = {"convective": (300.0, 1.4), "stratiform": (200.0, 1.6), "tropical": (250.0, 1.2), "marshall_palmer": (200.0, 1.6)}
#: Class breaks by scheme (fixed values).
SEVERITY_BREAKS = {"usgs": (0.10, 0.27, 0.44, 0.66), "brisk": (0.10, 0.40, 0.70), "barc4": (0.125, 0.25, 0.50)}
SEVERITY_NAMES = {"usgs": ("unburned", "low", "moderate-low", "moderate-high", "high"), "brisk": ("unburned", "low", "moderate", "high"), "barc4": ("unburned", "low", "moderate", "high")}
HYDRO_DRY, HYDRO_ZR, HYDRO_RAIN, HYDRO_HAIL, HYDRO_CENSORED = range(5)
NO_DATA, SUPPORTED, VIRGA, UNDERREAD = 255, 0, 1, 2


def to_accumulation(intensity: Column, minutes: float) -> Column:
    if minutes <= 0:
        raise ValueError("minutes must be positive")
    return intensity * minutes / 60


def from_accumulation(depth: Column, minutes: float) -> Column:
    if minutes <= 0:
        raise ValueError("minutes must be positive")
    return depth * 60 / minutes


def z_to_rate(dbz: Column, a: float = 300.0, b: float = 1.4, cap: float | None = None) -> Column:
    """Rain rate in mm/h from reflectivity; NULL stays NULL."""
    return F.pow(F.pow(F.lit(10.0), clip(dbz, None, cap) / 10) / a, F.lit(1 / b))


def zzdr_to_rate(dbz: Column, zdr: Column, cap: float | None = None) -> Column:
    """Rate from reflectivity and differential reflectivity, the latter held within 0 to 4 dB."""
    z = F.pow(F.lit(10.0), clip(dbz, None, cap) / 10)
    return 0.0142 * F.pow(z, F.lit(0.770)) * F.pow(F.pow(F.lit(10.0), clip(zdr, 0.0, 4.0) / 10), F.lit(-1.67))


def kdp_to_rate(kdp: Column) -> Column:
    return 44.0 * F.pow(clip(kdp, 0.0, 7.0), F.lit(0.822))


def blend(dual: Column, capped: Column, dbz: Column, positive: bool = False, z_blend: float = 35.0) -> Column:
    """The dual-polarisation rate where it is known and the echo strong, else the capped one."""
    use = dual.isNotNull() & (dbz >= z_blend)
    return F.when(use & (dual > 0) if positive else use, dual).otherwise(capped)


def hydro_select(dbz: Column, zdr: Column, rhohv: Column, r_z: Column, r_kdp: Column, r_zzdr: Column, z_blend: float = 35.0) -> Column:
    """struct(rate, lo, hi, class): censored over hail over rain over the plain relation."""
    dry = dbz.isNull()
    rain = (dbz >= z_blend) & r_zzdr.isNotNull() & zdr.isNotNull()
    hail = (dbz >= 45.0) & (zdr <= 0.8)
    r_hail = F.when(r_kdp > 0, F.least(r_kdp, 1.5 * r_z)).otherwise(r_z)

    def pack(rate: Column, lo: Column, hi: Column, kind: int) -> Column:
        return F.struct(rate.alias("rate"), lo.alias("lo"), hi.alias("hi"), F.lit(kind).alias("class"))

    zero, none = F.lit(0.0), F.lit(None).cast("double")
    return (
        F.when(~dry & (rhohv < 0.85), pack(zero, zero, zero, HYDRO_CENSORED))
        .when(~dry & hail, pack(r_hail, F.least(r_hail, r_z), F.greatest(r_hail, r_z), HYDRO_HAIL))
        .when(~dry & rain, pack(r_zzdr, F.least(r_z, r_zzdr), F.greatest(r_z, r_zzdr), HYDRO_RAIN))
        .when(~dry, pack(r_z, r_z, r_z, HYDRO_ZR))
        .otherwise(pack(none, none, none, HYDRO_DRY))
    )


def virga_class(mosaic: Column, support: Column, least: float = 10.0, ratio: float = 3.0) -> Column:
    """255 without data or where both are small; under-reading goes before virga, which goes before support."""
    ok = mosaic.isNotNull() & support.isNotNull()
    big = ok & ((mosaic >= least) | (support >= least))
    return (
        F.when(big & (F.greatest(mosaic, F.lit(0.1)) <= support / ratio), UNDERREAD)
        .when(big & (mosaic / F.greatest(support, F.lit(0.1)) >= ratio), VIRGA)
        .when(big, SUPPORTED)
        .otherwise(NO_DATA)
    )


def support_ratio(mosaic: Column, support: Column) -> Column:
    return F.when(mosaic.isNotNull() & support.isNotNull(), mosaic / F.greatest(support, F.lit(0.1)))


def relative_humidity(t_c: Column, td_c: Column) -> Column:
    """Magnus form, between 0 and 1."""
    e = lambda t: F.exp(17.625 * t / (243.04 + t))
    return clip(e(td_c) / e(t_c), 0.0, 1.0)


def evaporation_factor(rate: Column, depth_km: Column, rh: Column, a: float = 1.0, b: float = 0.65) -> Column:
    """Share of the rain that reaches the ground after falling depth_km through air of humidity rh."""
    core = F.pow(F.greatest(rate, F.lit(0.0)), F.lit(1 - b)) - (1 - b) * a * (1 - rh) * depth_km
    left = F.pow(F.greatest(core, F.lit(0.0)), F.lit(1 / (1 - b)))
    return F.when(rate.isNull() | depth_km.isNull() | rh.isNull(), F.lit(None).cast("double")).when(rate <= 0, 1.0).otherwise(clip(left / F.when(rate > 0, rate), 0.0, 1.0))


def beam_height_m(elev_m: Column, range_m: Column, tilt_deg: Column) -> Column:
    return elev_m + range_m * F.sin(F.radians(tilt_deg)) + range_m * range_m / (2 * 4 / 3 * 6371000.0)


def severity(dnbr: Column, scheme: str = "usgs") -> Column:
    """How many breaks of the scheme dnbr reaches; no observation has no class."""
    if scheme not in SEVERITY_BREAKS:
        raise ValueError(f"unknown scheme {scheme!r}")
    return F.when(dnbr.isNotNull(), sum((F.when(dnbr >= b, 1).otherwise(0) for b in SEVERITY_BREAKS[scheme]), F.lit(0)))


def severity_mask(dnbr: Column, classes: list, scheme: str = "barc4") -> Column:
    names = SEVERITY_NAMES.get(scheme, ())
    wanted = [names.index(c) if isinstance(c, str) else int(c) for c in classes]
    return F.coalesce(severity(dnbr, scheme).isin(wanted), F.lit(False))


def anomaly(observed: Column, climate: Column, least: float = 0.1) -> Column:
    return F.when(climate > least, observed / climate)


def depth_to_intensity(mils: Column, minutes: float) -> Column:
    """Climate grids come in thousandths of an inch over the duration; mm/h."""
    return mils / 1000 * 25.4 * 60 / minutes


def recurrence_interval(intensity: Column, curve: Column) -> Column:
    """Years by log-log interpolation on an ascending array of (ari, i) structs.

    Infinity above the curve; below it the first segment is extended, NULL if flat.
    """
    n = F.size(curve)
    at = F.greatest(F.lit(1), F.least(n - 1, F.aggregate(curve, F.lit(0), lambda a, p: a + F.when(p["i"] <= intensity, 1).otherwise(0))))
    p, q = F.element_at(curve, at), F.element_at(curve, at + 1)
    rise = F.try_divide((F.log(intensity) - F.log(p["i"])) * (F.log(q["ari"]) - F.log(p["ari"])), F.log(q["i"]) - F.log(p["i"]))
    return F.when(intensity > F.element_at(curve, -1)["i"], float("inf")).when(intensity > 0, F.exp(F.log(p["ari"]) + rise))


def valid_class(c: Column) -> Column:
    """A soil burn severity class from 1 to 4; anything else is no class."""
    return F.when(c.between(1, 4), c)
