"""Photometric scalars as Column expressions.

An undefined result (a logarithm of nothing, a missing input) is NULL, and NaN inputs count
as missing, so results never hold NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Magnitudes per unit of 1 / SNR.
MAG_PER_SNR = 1.0857
#: Reference exposure (s) and the grid of exposures of depth tables.
EXPTIME_REF = 900.0
EXPTIME_GRID = (60.0, 900.0, 3600.0, 14400.0, 57600.0)
#: The frame-to-frame scatter (mag) below which a frame is photometric.
RMS_PHOTOMETRIC = 0.06
#: 95 % of a 16-bit range.
SAT_LEVEL = 0.95 * 65535
#: Sky brightness (mag / arcsec^2) down to which each Bortle class reaches: fixed values.
BORTLE = ((21.75, 1.0), (21.5, 2.0), (21.25, 3.0), (20.5, 4.0), (19.5, 5.0), (18.75, 6.0), (18.0, 7.0), (17.0, 8.0))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite(c: Column | str) -> Column:
    """The value, or NULL if it is NaN or infinite."""
    return F.when(is_finite(c), col(c))


def log10_of(c: Column | str) -> Column:
    return F.when(is_finite(c) & (col(c) > 0), F.log10(col(c)))


def instrumental_mag(flux: Column | str) -> Column:
    return -2.5 * log10_of(flux)


def mag_error(snr: Column | str) -> Column:
    return F.when(is_finite(snr) & (col(snr) > 0), MAG_PER_SNR / col(snr))


def apply_calibration(m_inst, zeropoint, colour_term=None, colour=None, colour0=None) -> Column:
    """Calibrated magnitude; the colour term counts only where colour and colour0 are known."""
    base = col(m_inst) + col(zeropoint)
    if colour is None:
        return base
    term = col(colour_term) * (col(colour) - col(colour0))
    return base + F.when(is_finite(colour0), term).otherwise(0.0)


def limiting_mag(zeropoint, sigma_aper, nsigma: float = 5.0) -> Column:
    return col(zeropoint) - 2.5 * log10_of(nsigma * col(sigma_aper))


def sky_surface_brightness(pedestal, zeropoint, pixscale, bias: Column | float = 0.0) -> Column:
    sky = (col(pedestal) - bias) / (col(pixscale) * col(pixscale))
    return col(zeropoint) - 2.5 * log10_of(sky)


def effective_bortle(sqm: Column | str) -> Column:
    out = F.when(~is_finite(sqm), F.lit(None).cast("double"))
    for bound, level in BORTLE:
        out = out.when(col(sqm) >= bound, level)
    return out.otherwise(9.0)


def scale_limit(v_lim, t_from, t_to: Column | float = EXPTIME_REF) -> Column:
    t_to = t_to if isinstance(t_to, Column) else F.lit(float(t_to))
    ratio = F.when(col(t_from) > 0, t_to / col(t_from))
    return col(v_lim) + 1.25 * log10_of(ratio)


def phase_fold(t, period, t0) -> Column:
    p = period if isinstance(period, Column) else F.lit(float(period))
    return F.pmod((col(t) - (t0 if isinstance(t0, Column) else F.lit(float(t0)))) / p, F.lit(1.0))


def slug(text: Column | str) -> Column:
    """A file name's part: lower case, other characters than letters, digits, - and _ as _, none of these at the ends."""
    plain = F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}_-]", "_")
    trimmed = F.regexp_replace(plain, r"^_+|_+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", "field").otherwise(trimmed)


def hpx_of(source_id: Column | str) -> Column:
    """The level-5 nested HEALPix pixel that a catalogue id starts with."""
    return F.shiftright(col(source_id), 49).cast("int")


def conform_flag(c: Column | str) -> Column:
    """t, true, 1 and yes as true, whatever the type."""
    return F.coalesce(F.lower(col(c).cast("string")).isin("true", "t", "1", "yes"), F.lit(False))


def vote_threshold(n_detections, n_catalogue, half_px, bin_px: float = 32.0) -> Column:
    """Votes that a bin of offsets needs to stand out from chance."""
    bins = F.pow(2 * col(half_px) / bin_px, 2)
    expected = col(n_detections) * col(n_catalogue) / bins
    return F.greatest(F.lit(8.0), expected + 8 * F.sqrt(expected))
