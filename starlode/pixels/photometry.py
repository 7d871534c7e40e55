"""Background, detection, apertures, curves of growth and forced photometry of one frame."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..sources.fits import BANDS, Frame
from .mosaic import smooth

SNR_MIN, SNR_PSF = 5.0, 50.0
FWHM_PER_HALF_LIGHT = 2.0
COG_RADII = np.arange(1.0, 21.0)
COG_MAX_SIZE_RATIO, MIN_COG_STARS = 3.0, 5
FLAG_MASKED, FLAG_EDGE = 0x40, 0x10
DETECT_KERNEL = np.array([[1, 2, 1], [2, 4, 2], [1, 2, 1]], np.float32) / 16


@dataclass
class Extraction:
    """What a frame gives: backgrounds, noise, widths and apertures by band, curves of growth and the sources' columns."""

    frame: Frame
    background: np.ndarray
    rms: np.ndarray
    fwhm: np.ndarray
    aperture: np.ndarray
    cogs: list
    sources: dict = field(default_factory=dict)


def background(data: np.ndarray, mask: np.ndarray | None = None, mesh: int = 64) -> tuple[np.ndarray, float]:
    """A smooth background from clipped medians of a mesh, and the noise: the median of the cells' scatters."""
    ny, nx = data.shape
    gy, gx = -(-ny // mesh), -(-nx // mesh)
    level, noise = np.full((gy, gx), np.nan), np.full((gy, gx), np.nan)
    for j in range(gy):
        for i in range(gx):
            cell = data[j * mesh : (j + 1) * mesh, i * mesh : (i + 1) * mesh]
            v = cell[~mask[j * mesh : (j + 1) * mesh, i * mesh : (i + 1) * mesh]] if mask is not None else cell.ravel()
            v = v[np.isfinite(v)]
            for _ in range(6):
                if len(v) < 8:
                    break
                m, s = np.median(v), v.std()
                kept = v[np.abs(v - m) < 3 * s]
                if len(kept) == len(v):
                    break
                v = kept
            if len(v) >= 8:
                level[j, i] = 2.5 * np.median(v) - 1.5 * v.mean() if abs(v.mean() - np.median(v)) < 0.3 * max(v.std(), 1e-12) else np.median(v)
                noise[j, i] = v.std()
    good = np.isfinite(level)
    if not good.any():
        return np.zeros(data.shape, np.float32), float("nan")
    level[~good] = np.median(level[good])
    padded = np.pad(level, 1, "edge")
    level = np.median([padded[y : y + gy, x : x + gx] for y in range(3) for x in range(3)], axis=0)
    # Bilinear between the cells' centres.
    def at(n, g):
        p = np.clip((np.arange(n) + 0.5) / mesh - 0.5, 0, g - 1)
        lo = np.minimum(p.astype(int), max(g - 2, 0))
        return lo, np.minimum(lo + 1, g - 1), p - lo

    y0, y1, fy = at(ny, gy)
    x0, x1, fx = at(nx, gx)
    rows = level[y0] * (1 - fy)[:, None] + level[y1] * fy[:, None]
    out = rows[:, x0] * (1 - fx) + rows[:, x1] * fx
    return out.astype(np.float32), float(np.median(noise[np.isfinite(noise)]))


def label(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """8-connected components of a mask as runs: (row, start, stop) of each run with its component, and how many there are."""
    ny, nx = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    up = np.arange(len(row))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first = np.searchsorted(row, np.arange(ny + 1))
    for y in range(1, ny):
        a, b, c = first[y - 1], first[y], first[y + 1]
        j = a
        for i in range(b, c):
            while j < b and stop[j] < start[i]:
                j += 1
            k = j
            while k < b and start[k] <= stop[i]:
                x, z = root(i), root(k)
                if x != z:
                    up[max(x, z)] = min(x, z)
                k += 1
    roots = np.array([root(i) for i in range(len(row))], int)
    names, comp = np.unique(roots, return_inverse=True)
    return row, np.stack([start, stop], 1), comp, len(names)


def detect(data: np.ndarray, thresh: float, mask: np.ndarray | None = None, minarea: int = 5) -> tuple[np.ndarray, np.ndarray, float, dict]:
    """(subtracted, background, rms, objects): groups of smoothed pixels above thresh x rms, split at saddles between peaks, with moments of the plain pixels."""
    back, rms = background(data, mask)
    sub = (data - back).astype(np.float32)
    names = ("x", "y", "a", "b", "theta", "flux", "peak", "npix", "flag")
    empty = {n: np.zeros(0) for n in names}
    if not np.isfinite(rms) or rms <= 0:
        return sub, back, rms, empty
    conv = smooth(np.nan_to_num(sub), DETECT_KERNEL)
    on = conv > thresh * rms
    row, span, comp, n = label(on)
    if not n:
        return sub, back, rms, empty
    size = span[:, 1] - span[:, 0]
    ys, owner = np.repeat(row, size), np.repeat(comp, size)
    xs = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(span[:, 0], size)
    # A pixel belongs to the local peak that steepest ascent reaches, if the peak stands out of its group.
    owner = split_peaks(conv, on, ys, xs, owner, rms)
    _, owner = np.unique(owner, return_inverse=True)
    n = owner.max() + 1
    w = np.maximum(sub[ys, xs], 1e-6).astype(np.float64)
    total = np.bincount(owner, w, n)
    npix = np.bincount(owner, minlength=n)
    x, y = np.bincount(owner, w * xs, n) / total, np.bincount(owner, w * ys, n) / total
    dx, dy = xs - x[owner], ys - y[owner]
    xx, yy, xy = (np.bincount(owner, w * v, n) / total for v in (dx * dx, dy * dy, dx * dy))
    xx, yy = np.maximum(xx, 1 / 12), np.maximum(yy, 1 / 12)
    half, diff = (xx + yy) / 2, np.sqrt(((xx - yy) / 2) ** 2 + xy**2)
    a, b = np.sqrt(half + diff), np.sqrt(np.maximum(half - diff, 1 / 144))
    peak = np.zeros(n)
    np.maximum.at(peak, owner, sub[ys, xs])
    ny, nx = data.shape
    flag = np.where((np.bincount(owner, (xs == 0) | (ys == 0) | (xs == nx - 1) | (ys == ny - 1), n) > 0), FLAG_EDGE, 0)
    keep = npix >= minarea
    objs = dict(zip(names, (x, y, a, b, 0.5 * np.arctan2(2 * xy, xx - yy), total, peak, npix, flag)))
    if mask is not None:
        keep &= ~centroid_masked(x, y, mask)
    return sub, back, rms, {k: v[keep] for k, v in objs.items()}


def split_peaks(conv: np.ndarray, on: np.ndarray, ys, xs, owner, rms: float, contrast: float = 0.02) -> np.ndarray:
    ny, nx = conv.shape
    index = np.full((ny + 2, nx + 2), -1, np.int64)
    index[ys + 1, xs + 1] = np.arange(len(ys))
    value = conv[ys, xs]
    best, to = value.copy(), np.arange(len(ys))
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            k = index[ys + 1 + dy, xs + 1 + dx]
            v = np.where(k >= 0, value[k], -np.inf)
            better = v > best
            best, to = np.where(better, v, best), np.where(better, k, to)
    while True:
        jump = to[to]
        if (jump == to).all():
            break
        to = jump
    # Peaks too weak against their group's brightest join it.
    top = np.full(owner.max() + 1, -np.inf)
    np.maximum.at(top, owner, value)
    share = np.bincount(to, np.maximum(value, 0), len(ys)) / np.bincount(owner, np.maximum(value, 0))[owner]
    strong = (share[to] > contrast) & (value[to] > 5 * rms)
    lead = np.full(len(top), -1)
    lead[owner[value >= top[owner]]] = np.flatnonzero(value >= top[owner])
    return np.where(strong, to, lead[owner])


def centroid_masked(x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> np.ndarray:
    finite = np.isfinite(x) & np.isfinite(y)
    xi = np.clip(np.nan_to_num(np.rint(x)).astype(int), 0, mask.shape[1] - 1)
    yi = np.clip(np.nan_to_num(np.rint(y)).astype(int), 0, mask.shape[0] - 1)
    return ~finite | mask[yi, xi]


def circle_weights(dx: np.ndarray, dy: np.ndarray, r, sub: int = 5) -> np.ndarray:
    """The covered part of unit pixels at offsets from a circle's centre, edge pixels sampled sub x sub; r is one radius or one for each pixel."""
    d, r = np.hypot(dx, dy), np.broadcast_to(r, np.broadcast_shapes(dx.shape, dy.shape))
    out = (d <= r - 0.7072).astype(np.float32)
    edge = np.abs(d - r) < 0.7072
    if edge.any():
        s = (np.arange(sub) + 0.5) / sub - 0.5
        ex, ey, er = np.broadcast_to(dx, d.shape)[edge], np.broadcast_to(dy, d.shape)[edge], r[edge]
        hits = np.zeros(len(ex), np.float32)
        for u in s:
            for v in s:
                hits += (ex + u) ** 2 + (ey + v) ** 2 <= er * er
        out[edge] = hits / (sub * sub)
    return out


def sum_circle(data: np.ndarray, x, y, r, err: float, mask: np.ndarray | None = None, bkgann: tuple[float, float] | None = None):
    """(flux, fluxerr, flag) in circles of radius r (one or one for each); centres off the image have no flux and the edge flag.

    Sources whose windows are of one size are summed together, some hundred thousand pixels at a time.
    """
    ny, nx = data.shape
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    r = np.broadcast_to(np.asarray(r, float), (n,))
    flux, area, flag = np.zeros(n), np.zeros(n), np.zeros(n, int)
    finite = np.isfinite(x) & np.isfinite(y)
    flux[~finite], flag[~finite] = np.nan, FLAG_EDGE
    big = r if bkgann is None else np.maximum(r, bkgann[1])
    half = np.ceil(big).astype(int) + 1
    for h in np.unique(half[finite]):
        group, step = np.flatnonzero(finite & (half == h)), max(1, 400_000 // (2 * h + 1) ** 2)
        offsets = np.arange(-h, h + 1)
        for k in range(0, len(group), step):
            at = group[k : k + step]
            px, py = np.floor(x[at]).astype(int)[:, None] + offsets, np.floor(y[at]).astype(int)[:, None] + offsets
            dx, dy = (px - x[at, None])[:, None, :], (py - y[at, None])[:, :, None]
            on = ((px >= 0) & (px < nx))[:, None, :] & ((py >= 0) & (py < ny))[:, :, None]
            where = np.clip(py, 0, ny - 1)[:, :, None], np.clip(px, 0, nx - 1)[:, None, :]
            cell = data[where]
            w = circle_weights(dx, dy, r[at, None, None]) * on
            out = (np.floor(x[at] - big[at]) < 0) | (np.floor(y[at] - big[at]) < 0) | (np.ceil(x[at] + big[at]) + 1 > nx) | (np.ceil(y[at] + big[at]) + 1 > ny)
            flag[at[out]] |= FLAG_EDGE
            if mask is not None:
                hidden = mask[where] & (w > 0)
                touched = hidden.any((1, 2))
                flag[at[touched]] |= FLAG_MASKED
                whole = w.sum((1, 2))
                w = np.where(hidden, 0, w)
                left = w.sum((1, 2))
                w = w * np.where(touched & (left > 0), whole / np.where(left > 0, left, 1), 1)[:, None, None]
            flux[at], area[at] = (w * cell).sum((1, 2), dtype=np.float64), w.sum((1, 2), dtype=np.float64)
            if bkgann is not None:
                ring = (circle_weights(dx, dy, bkgann[1]) - circle_weights(dx, dy, bkgann[0])) * on
                flux[at] -= (ring * cell).sum((1, 2), dtype=np.float64) / np.maximum(ring.sum((1, 2), dtype=np.float64), 1e-9) * area[at]
    return flux, err * np.sqrt(area), flag


def flux_radius(data: np.ndarray, x, y, rmax, frac: float = 0.5) -> np.ndarray:
    """The radius that holds a fraction of the flux within rmax, from 40 circles."""
    rmax = np.asarray(rmax, float)
    steps = np.arange(1, 41) / 40
    flux = np.stack([sum_circle(data, x, y, rmax * k, 0.0)[0] for k in steps], 1) if len(rmax) else np.zeros((0, 40))
    out, good = np.full(len(rmax), np.nan), flux[:, -1] > 0
    k = np.argmax(flux >= frac * flux[:, -1:], axis=1)
    row = np.arange(len(rmax))
    low, high = np.where(k > 0, flux[row, np.maximum(k - 1, 0)], 0.0), flux[row, k]
    r0, r1 = np.where(k > 0, rmax * steps[np.maximum(k - 1, 0)], 0.0), rmax * steps[k]
    value = r0 + (r1 - r0) * (frac * flux[:, -1] - low) / np.maximum(high - low, 1e-12)
    out[good] = value[good]
    return out


def max_in_aperture(data: np.ndarray, x, y, r: float) -> np.ndarray:
    """The largest pixel within r of the nearest pixel to each position; NaN where none is on the image."""
    ny, nx = data.shape
    n = int(np.ceil(r))
    gy, gx = np.mgrid[-n : n + 1, -n : n + 1]
    disc = gx**2 + gy**2 <= r * r
    out, finite = np.full(len(x), np.nan), np.flatnonzero(np.isfinite(x) & np.isfinite(y))
    step = max(1, 1_000_000 // max(int(disc.sum()), 1))
    for k in range(0, len(finite), step):
        at = finite[k : k + step]
        yy, xx = np.rint(np.asarray(y)[at]).astype(int)[:, None] + gy[disc], np.rint(np.asarray(x)[at]).astype(int)[:, None] + gx[disc]
        on = (yy >= 0) & (yy < ny) & (xx >= 0) & (xx < nx)
        value = np.where(on, data[np.clip(yy, 0, ny - 1), np.clip(xx, 0, nx - 1)], -np.inf)
        top = np.fmax.reduce(value, axis=1)
        out[at] = np.where(np.isfinite(top), top, np.nan)
    return out


def bright_round(sub, objs, rms, snr_min, radius: float = 10.0, mask=None) -> np.ndarray:
    flux, err, flag = sum_circle(sub, objs["x"], objs["y"], radius, rms, mask)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (flux / err > snr_min) & (objs["b"] / objs["a"] > 0.7) & ((flag & FLAG_MASKED) == 0)


def measure_fwhm(sub, objs, rms, snr_min: float = SNR_PSF, mask=None) -> float:
    """Twice the median half-light radius of bright, round, clean sources."""
    good = np.flatnonzero(bright_round(sub, objs, rms, snr_min, mask=mask) & (objs["flag"] == 0))
    if not len(good):
        return float("nan")
    r = flux_radius(sub, objs["x"][good], objs["y"][good], 6 * objs["a"][good])
    return float(FWHM_PER_HALF_LIGHT * np.nanmedian(r))


def point_like(objs, reference: np.ndarray, ratio: float = COG_MAX_SIZE_RATIO) -> np.ndarray:
    if not reference.any():
        return np.ones(len(objs["a"]), bool)
    return objs["a"] <= ratio * np.median(objs["a"][reference])


def alone(x: np.ndarray, y: np.ndarray, pick: np.ndarray, far: float) -> np.ndarray:
    """Whether each picked position has no other one within ``far``, by cells of that size."""
    cells: dict[tuple[int, int], list[int]] = {}
    cx, cy = np.floor(x / far).astype(int).tolist(), np.floor(y / far).astype(int).tolist()
    for i, key in enumerate(zip(cx, cy)):
        cells.setdefault(key, []).append(i)
    out = np.ones(len(pick), bool)
    for k, i in enumerate(pick.tolist()):
        near = np.array([j for u in (-1, 0, 1) for v in (-1, 0, 1) for j in cells.get((cx[i] + u, cy[i] + v), ()) if j != i], int)
        out[k] = not len(near) or np.hypot(x[near] - x[i], y[near] - y[i]).min() > far
    return out


def growth_curve(sub, objs, rms, radii=COG_RADII, snr_min: float = SNR_PSF, mask=None, size_ratio: float = COG_MAX_SIZE_RATIO, isolation: float | None = None) -> dict:
    """radius, flux_frac, flux_frac_std over isolated bright point sources, and how many they were."""
    far = isolation if isolation is not None else 2 * radii[-1]
    bright = bright_round(sub, objs, rms, snr_min, mask=mask)
    pick = np.flatnonzero(bright & point_like(objs, bright, size_ratio))
    none = {"radius": radii, "flux_frac": np.full(len(radii), np.nan), "flux_frac_std": np.full(len(radii), np.nan), "n_stars": 0}
    if not len(pick):
        return none
    x, y = objs["x"], objs["y"]
    pick = pick[alone(x, y, pick, far)]
    curves = np.zeros((len(pick), len(radii)))
    clean = np.ones(len(pick), bool)
    for k, r in enumerate(radii):
        f, _, flag = sum_circle(sub, x[pick], y[pick], r, rms, mask)
        curves[:, k] = f
        clean &= flag == 0
    curves = curves[clean & (curves[:, -1] > 0)] if len(pick) else curves
    if not len(curves):
        return none
    frac = curves / curves[:, -1:]
    return {"radius": radii, "flux_frac": np.median(frac, axis=0), "flux_frac_std": frac.std(axis=0), "n_stars": len(frac)}


def aperture_for(cog: dict, enclosed: float = 0.9) -> float:
    return float(np.interp(enclosed, cog["flux_frac"], cog["radius"]))


def aperture_correction(cog: dict, radius: float) -> float:
    return float(2.5 * np.log10(np.interp(radius, cog["radius"], cog["flux_frac"])))


def size_aperture(cog: dict, fwhm: float, aperture=None, enclosed: float = 0.9, n_fwhm=None) -> float:
    """Explicit, else a multiple of the width, else from the curve of growth; with too few stars 1.2 widths; ValueError if none is finite."""
    if aperture is not None:
        return float(aperture)
    if n_fwhm is not None:
        out = n_fwhm * fwhm
    else:
        out = aperture_for(cog, enclosed) if cog["n_stars"] >= MIN_COG_STARS else float("nan")
        out = out if np.isfinite(out) else 1.2 * fwhm
    if not np.isfinite(out):
        raise ValueError("no stars to size an aperture with")
    return float(out)


def band_setup(frame: Frame, thresh: float, aperture, enclosed, n_fwhm, mask=None, isolation=None):
    """Per band: subtracted plane, background, noise, objects, width, curve and aperture. Detection and forced photometry share it."""
    for band in BANDS:
        sub, back, rms, objs = detect(frame.plane(band), thresh, mask)
        fwhm = measure_fwhm(sub, objs, rms, mask=mask)
        cog = growth_curve(sub, objs, rms, mask=mask, isolation=isolation)
        yield band, sub, back, rms, objs, fwhm, cog, size_aperture(cog, fwhm, aperture, enclosed, n_fwhm)


def extract_sources(frame: Frame, thresh: float = 2.0, aperture=None, enclosed: float = 0.9, n_fwhm=None, bkgann=None, mask=None, isolation=None) -> Extraction:
    """Sources above SNR 5 in each band: band, x, y, flux, fluxerr, snr, flag, max_pix_value, a, b, theta."""
    rows: dict[str, list] = {k: [] for k in ("band", "x", "y", "flux", "fluxerr", "snr", "flag", "max_pix_value", "a", "b", "theta")}
    backs, noise, widths, radii, cogs = [], [], [], [], []
    for band, sub, back, rms, objs, fwhm, cog, r in band_setup(frame, thresh, aperture, enclosed, n_fwhm, mask, isolation):
        flux, err, flag = sum_circle(sub, objs["x"], objs["y"], r, rms, mask, bkgann)
        snr = np.where(err > 0, flux / np.maximum(err, 1e-12), 0)
        keep = snr > SNR_MIN
        peak = max_in_aperture(frame.plane(band), objs["x"][keep], objs["y"][keep], r)
        for k, v in zip(rows, (np.full(keep.sum(), band), objs["x"][keep], objs["y"][keep], flux[keep], err[keep], snr[keep], flag[keep] | objs["flag"][keep].astype(int), peak, objs["a"][keep], objs["b"][keep], objs["theta"][keep])):
            rows[k].append(v)
        for column, value in zip((backs, noise, widths, radii, cogs), (back, rms, fwhm, r, cog)):
            column.append(value)
    return Extraction(frame, np.stack(backs), np.array(noise), np.array(widths), np.array(radii), cogs, {k: np.concatenate(v) for k, v in rows.items()})


def forced_photometry(frame: Frame, x, y, source_id, thresh: float = 2.0, aperture=None, enclosed: float = 0.95, n_fwhm=None, bkgann=None, mask=None, isolation=None) -> Extraction:
    """Every position in every band, none dropped: SNR is NaN where the error isn't positive, on_chip tells the rest."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    ny, nx = frame.shape
    on_chip = (x >= 0) & (x < nx) & (y >= 0) & (y < ny)
    rows: dict[str, list] = {k: [] for k in ("source_id", "band", "x", "y", "flux", "fluxerr", "snr", "flag", "max_pix_value", "on_chip")}
    backs, noise, widths, radii, cogs = [], [], [], [], []
    for band, sub, back, rms, _, fwhm, cog, r in band_setup(frame, thresh, aperture, enclosed, n_fwhm, mask, isolation):
        flux, err, flag = sum_circle(sub, x, y, r, rms, mask, bkgann)
        snr = np.where(err > 0, flux / np.where(err > 0, err, 1), np.nan)
        for k, v in zip(rows, (np.asarray(source_id), np.full(len(x), band), x, y, flux, err, snr, flag, max_in_aperture(frame.plane(band), x, y, r), on_chip)):
            rows[k].append(v)
        for column, value in zip((backs, noise, widths, radii, cogs), (back, rms, fwhm, r, cog)):
            column.append(value)
    return Extraction(frame, np.stack(backs), np.array(noise), np.array(widths), np.array(radii), cogs, {k: np.concatenate(v) for k, v in rows.items()})


def fit_background(back: np.ndarray) -> dict:
    """Six coefficients (1, x, y, x^2, x y, y^2 over [-1, 1)), the pedestal and the scatter about the surface."""
    ny, nx = back.shape
    y, x = np.mgrid[0:ny:4, 0:nx:4]
    u, v = (2 * x / nx - 1).ravel(), (2 * y / ny - 1).ravel()
    z = back[::4, ::4].ravel().astype(float)
    terms = np.stack([np.ones_like(u), u, v, u * u, u * v, v * v], 1)
    coeffs = np.linalg.lstsq(terms, z, rcond=None)[0]
    return {"coeffs": coeffs, "pedestal": float(np.median(z)), "resid_std": float((z - terms @ coeffs).std())}


def sky_mask(shape, wcs, ra, dec, radius_arcsec) -> np.ndarray:
    """Pixels within sky circles; circles without a finite centre are skipped."""
    x, y = wcs.to_pixel(np.atleast_1d(ra), np.atleast_1d(dec))
    r = np.broadcast_to(np.atleast_1d(radius_arcsec), x.shape) / wcs.scale_arcsec
    gy, gx = np.mgrid[: shape[0], : shape[1]]
    out = np.zeros(shape, bool)
    for xi, yi, ri in zip(x, y, r):
        if np.isfinite(xi) and np.isfinite(yi):
            out |= np.hypot(gx - xi, gy - yi) < ri
    return out


# ------------------------------------------------------------------ Kron and host light


def kron_flux(sub, objs, err: float, k: float = 2.5, r_min: float = 1.75):
    """(flux, fluxerr, flag, radius) in ellipses of k Kron radii, circles of r_min where those are smaller (flagged)."""
    flux, error, flag, radius = (np.zeros(len(objs["x"])) for _ in range(4))
    ny, nx = sub.shape
    for i in range(len(flux)):
        a, b, t = objs["a"][i], objs["b"][i], np.clip(objs["theta"][i], -np.pi / 2, np.pi / 2)
        n = int(np.ceil(6 * a)) + 1
        x0, x1, y0, y1 = max(int(objs["x"][i]) - n, 0), min(int(objs["x"][i]) + n + 1, nx), max(int(objs["y"][i]) - n, 0), min(int(objs["y"][i]) + n + 1, ny)
        gx, gy = np.meshgrid(np.arange(x0, x1) - objs["x"][i], np.arange(y0, y1) - objs["y"][i])
        e = np.hypot((gx * np.cos(t) + gy * np.sin(t)) / a, (-gx * np.sin(t) + gy * np.cos(t)) / b)
        cell, inside = sub[y0:y1, x0:x1], e <= 6
        total = cell[inside].sum()
        radius[i] = (e[inside] * cell[inside]).sum() / total if total > 0 else 0
        if k * radius[i] * np.sqrt(a * b) < r_min:
            (flux[i],), (error[i],), _ = sum_circle(sub, objs["x"][i : i + 1], objs["y"][i : i + 1], r_min, err)
            flag[i] = 1
        else:
            on = e <= k * radius[i]
            flux[i], error[i] = cell[on].sum(), err * np.sqrt(on.sum())
    return flux, error, flag.astype(int), radius


def extract_kron(frame: Frame, thresh: float = 2.0, mask=None) -> dict:
    rows: dict[str, list] = {k: [] for k in ("band", "x", "y", "flux", "fluxerr", "flag", "kron_radius")}
    for band in BANDS:
        sub, _, rms, objs = detect(frame.plane(band), thresh, mask)
        flux, err, flag, radius = kron_flux(sub, objs, rms)
        for k, v in zip(rows, (np.full(len(flux), band), objs["x"], objs["y"], flux, err, flag, radius)):
            rows[k].append(v)
    return {k: np.concatenate(v) for k, v in rows.items()}


def star_mask(sub, rms: float, nucleus, thresh: float = 5.0, keep_radius: float = 6.0, grow: float = 3.5) -> np.ndarray:
    """Ellipses around detections that are not the host's nucleus."""
    objs = detect(sub, thresh)[3]
    gy, gx = np.mgrid[: sub.shape[0], : sub.shape[1]]
    out = np.zeros(sub.shape, bool)
    for x, y, a, b, t in zip(*(objs[c] for c in ("x", "y", "a", "b", "theta"))):
        if np.hypot(x - nucleus[0], y - nucleus[1]) >= keep_radius:
            dx, dy = gx - x, gy - y
            out |= ((dx * np.cos(t) + dy * np.sin(t)) / (grow * a)) ** 2 + ((-dx * np.sin(t) + dy * np.cos(t)) / (grow * b)) ** 2 <= 1
    return out


def galaxy_contamination(sub, nucleus, target, aperture: float, mask=None, step_deg: float = 15.0, min_azimuths: int = 4) -> dict:
    """Host light in the target's aperture: the median over apertures at the same distance from the nucleus, clean azimuths only."""
    dx, dy = target[0] - nucleus[0], target[1] - nucleus[1]
    dist, start = np.hypot(dx, dy), np.arctan2(dy, dx)
    angles = start + np.radians(np.arange(0, 360, step_deg))
    x, y = nucleus[0] + dist * np.cos(angles), nucleus[1] + dist * np.sin(angles)
    ny, nx = sub.shape
    ok = (np.hypot(x - target[0], y - target[1]) >= 2 * aperture) & (x >= aperture) & (x < nx - aperture) & (y >= aperture) & (y < ny - aperture)
    flux, _, flag = sum_circle(sub, x[ok], y[ok], aperture, 0.0, mask)
    flux = flux[(flag & FLAG_MASKED) == 0]
    return {"flux": float(np.median(flux)) if len(flux) >= min_azimuths else 0.0, "std": float(flux.std()) if len(flux) > 1 else float("nan"), "n": len(flux)}


def cutout(sub, nucleus, target, half: int = 70) -> dict:
    ny, nx = sub.shape
    cx, cy = int(round(nucleus[0])), int(round(nucleus[1]))
    x0, x1, y0, y1 = max(cx - half, 0), min(cx + half + 1, nx), max(cy - half, 0), min(cy + half + 1, ny)
    return {"stamp": sub[y0:y1, x0:x1], "nucleus": (nucleus[0] - x0, nucleus[1] - y0), "target": (target[0] - x0, target[1] - y0), "origin": (x0, y0)}


def background_tiles(back: np.ndarray, fitted: dict, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(background, model) at every ``step``-th pixel, the model being fit_background's surface."""
    ny, nx = back.shape
    y, x = np.mgrid[0:ny:step, 0:nx:step]
    u, v = (2 * x / nx - 1).ravel(), (2 * y / ny - 1).ravel()
    return back[::step, ::step].ravel().astype(float), np.stack([np.ones_like(u), u, v, u * u, u * v, v * v], 1) @ fitted["coeffs"]


def mask_of(circles):
    """A mask hook of pixel tasks for sky circles (ra, dec, radius in arcseconds)."""
    ra, dec, radius = (np.array(c, float) for c in zip(*circles)) if len(circles) else (np.zeros(0),) * 3

    def mask(frame, wcs):
        return sky_mask(frame.shape, wcs, ra, dec, radius)

    return mask
