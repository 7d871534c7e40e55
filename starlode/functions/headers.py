"""Frame metadata from a header MAP<STRING,STRING>: exposure dialects, spans, times, unit, scale and airmass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import finite

#: Columns of the server's own quality figures and their header keys: fixed values.
ONBOARD = {
    "onboard_zp_R": "ZPR", "onboard_zp_G": "ZPG", "onboard_zp_B": "ZPB",
    "onboard_rms_R": "ZPSCTR", "onboard_rms_G": "ZPSCTG", "onboard_rms_B": "ZPSCTB",
    "onboard_ct_R": "ZPCTR", "onboard_ct_G": "ZPCTG", "onboard_ct_B": "ZPCTB",
    "onboard_fwhm_R_arcsec": "FWHMR", "onboard_fwhm_G_arcsec": "FWHMG", "onboard_fwhm_B_arcsec": "FWHMB",
    "onboard_sky_G": "SKYRMSG", "onboard_sqm": "SQMPHOT", "onboard_n_cal": "ZPNSTAR", "onboard_pixscale": "PIXSCALE",
}


def text(header: Column | str, key: str) -> Column:
    return F.try_element_at(F.col(header) if isinstance(header, str) else header, F.lit(key))


def number(header: Column | str, key: str) -> Column:
    return finite(text(header, key).try_cast("double"))


def exposure(header: str = "header") -> dict[str, Column]:
    """n_exp, exptime (of a sub) and total_exptime by the dialect that the header speaks: TOTALEXP native, NIMAGES re-stacked, else sparse."""
    n_native, total = number(header, "STACKCNT"), number(header, "TOTALEXP")
    n_server, single = number(header, "NIMAGES"), F.coalesce(number(header, "EXPTIME"), number(header, "EXPOSURE"))
    native, server = text(header, "TOTALEXP").isNotNull(), text(header, "NIMAGES").isNotNull()
    n_exp = F.when(native, n_native).when(server, n_server).otherwise(n_native)
    per_sub = F.when(native, single).when(server, F.when(n_server > 0, single / n_server)).otherwise(single)
    whole = F.when(native, total).when(server, single).otherwise(n_native * single)
    return {"n_exp": n_exp, "exptime": per_sub, "total_exptime": whole}


def iso(header: str, key: str) -> Column:
    return F.replace(F.trim(text(header, key)), F.lit(" "), F.lit("T"))


def exposure_span(header: str = "header") -> dict[str, Column]:
    return {"obs_start": F.coalesce(iso(header, "OB-START"), iso(header, "DATE-OBS")), "obs_end": iso(header, "OB-END")}


def mjd(stamp: Column) -> Column:
    """Modified Julian date (UTC) of an ISO time."""
    whole = F.unix_micros(F.try_to_timestamp(F.concat(stamp, F.lit("Z"))))
    return whole / F.lit(86400e6) + 40587.0


def model_of(header: str = "header") -> Column:
    return F.when(F.coalesce(text(header, "TELESCOP"), F.lit("")).contains("S50"), "S50").otherwise("S30pro")


def unit_id(header: str = "header") -> Column:
    name = F.coalesce(text(header, "TELESCOP"), F.lit(""))
    return F.when(name.contains("_"), F.element_at(F.split(name, "_", 2), 2)).otherwise("")


def pixel_scale(header: str = "header") -> Column:
    """Arcseconds of a pixel: the measured one if it is positive, else that of pixel size and focal length."""
    measured = [F.when(number(header, k) > 0, number(header, k)) for k in ("PIXSCALE", "PLTSCALE")]
    return F.coalesce(*measured, F.when(number(header, "FOCALLEN") > 0, 206.265 * number(header, "XPIXSZ") / number(header, "FOCALLEN")))


def sidereal_deg(mjd_utc: Column) -> Column:
    """Greenwich mean sidereal time in degrees, UT1 taken as UTC."""
    d = mjd_utc - 51544.5
    return F.pmod(280.46061837 + 360.98564736629 * d, F.lit(360.0))


def airmass(ra: Column, dec: Column, lat: Column, lon: Column, mjd_utc: Column) -> Column:
    """sec z at a site; NULL without a site or time, or at and below the horizon."""
    hour = F.radians(sidereal_deg(mjd_utc) + lon - ra)
    sin_alt = F.sin(F.radians(lat)) * F.sin(F.radians(dec)) + F.cos(F.radians(lat)) * F.cos(F.radians(dec)) * F.cos(hour)
    return F.when(sin_alt > 0, 1.0 / sin_alt)


def frame_times(header: str = "header", ra=None, dec=None) -> dict[str, Column]:
    """mjd_obs, mjd_mid, bjd_tdb and where the mid-time comes from: the span, else start and half the exposure."""
    span, exp = exposure_span(header), exposure(header)
    start, end = mjd(span["obs_start"]), mjd(span["obs_end"])
    mid = F.when(end.isNotNull(), (start + end) / 2).otherwise(start + F.coalesce(exp["total_exptime"], F.lit(0.0)) / 2 / 86400.0)
    source = F.when(start.isNull(), F.lit(None)).when(end.isNotNull(), "span").when(exp["total_exptime"].isNotNull(), "start+half").otherwise("start")
    out = {"mjd_obs": start, "mjd_mid": mid, "time_source": source}
    ra = number(header, "RA") if ra is None else ra
    dec = number(header, "DEC") if dec is None else dec
    site = number(header, "SITELAT").isNotNull() & number(header, "SITELONG").isNotNull()
    out["bjd_tdb"] = F.when(site, bjd_tdb(mid, ra, dec))
    out["airmass"] = airmass(number(header, "RA"), number(header, "DEC"), number(header, "SITELAT"), number(header, "SITELONG"), start)
    return out


def bjd_tdb(mjd_utc: Column, ra: Column, dec: Column) -> Column:
    """Barycentric Julian date from a low-precision solar position and Jupiter's and Saturn's pull on the Sun (good to about 2 s).

    TDB - UTC is taken as 69.184 s, as since 2017.
    """
    jd = mjd_utc + 2400000.5 + 69.184 / 86400.0
    n = jd - 2451545.0
    g = F.radians(F.pmod(357.528 + 0.98560028 * n, F.lit(360.0)))
    lon = F.radians(F.pmod(280.460 + 0.98564736 * n, F.lit(360.0)) + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    r = 1.00014 - 0.01671 * F.cos(g) - 0.00014 * F.cos(2 * g)
    eps = F.radians(23.439 - 4e-7 * n)
    # Earth from the Sun is minus the Sun from the Earth; the Sun from the barycentre by the two largest planets.
    x, y = -r * F.cos(lon), -r * F.sin(lon)
    for share, axis, at, rate in ((1 / 1047.35, 5.203, 34.40, 0.0830853), (1 / 3497.9, 9.537, 49.94, 0.0334597)):
        angle = F.radians(F.pmod(at + rate * n, F.lit(360.0)))
        x, y = x - share * axis * F.cos(angle), y - share * axis * F.sin(angle)
    ex, ey, ez = x, y * F.cos(eps), y * F.sin(eps)
    a, d = F.radians(ra), F.radians(dec)
    along = ex * F.cos(d) * F.cos(a) + ey * F.cos(d) * F.sin(a) + ez * F.sin(d)
    return jd + along * 499.004784 / 86400.0


def onboard_quality(columns_present: list[str], header: str = "header") -> dict[str, Column]:
    """The server's figures of those header keys that the frames have."""
    return {name: number(header, key) for name, key in ONBOARD.items() if key in columns_present}


def frame_metadata(header: str = "header") -> dict[str, Column]:
    exp, span, times = exposure(header), exposure_span(header), frame_times(header)
    return exp | {
        "site_lat": number(header, "SITELAT"), "site_lon": number(header, "SITELONG"), "ccd_temp": number(header, "CCD-TEMP"), "ra": number(header, "RA"), "dec": number(header, "DEC"),
        "eqmode": number(header, "EQMODE"), "airmass": times["airmass"], "date_obs": iso(header, "DATE-OBS"), "obs_start": span["obs_start"], "obs_end": span["obs_end"],
        "unit": unit_id(header), "model": model_of(header), "filter": text(header, "FILTER"),
        "object": F.coalesce(F.replace(F.upper(text(header, "OBJECT")), F.lit(" "), F.lit("")), F.lit("")),
    }
