"""Colour mosaics: demosaicing, half-resolution green and channel medians."""

from __future__ import annotations

import numpy as np

#: Rows and columns of each colour in the 2 x 2 cell, by pattern: fixed values.
PATTERNS = {"RGGB": "RGGB", "GRBG": "GRBG", "GBRG": "GBRG", "BGGR": "BGGR"}
DEFAULT_PATTERN = "GRBG"


def pattern_of(header: dict, default: str = DEFAULT_PATTERN) -> str:
    name = str(header.get("BAYERPAT", default)).strip().upper()
    return name if name in PATTERNS else default


def is_bayer(header: dict, data: np.ndarray | None) -> bool:
    return data is not None and data.ndim == 2 and bool(header.get("BAYERPAT"))


def masks(shape: tuple[int, int], pattern: str) -> np.ndarray:
    """(3, ny, nx): where each colour is sampled."""
    out = np.zeros((3, *shape), bool)
    for i, c in enumerate(PATTERNS[pattern]):
        out["RGB".index(c), i // 2 :: 2, i % 2 :: 2] = True
    return out


KERNEL = np.array([[0.25, 0.5, 0.25], [0.5, 1.0, 0.5], [0.25, 0.5, 0.25]], np.float32)


def smooth(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Convolution by a small symmetric kernel, edges repeated."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    padded = np.pad(x, ((ry, ry), (rx, rx)), "edge")
    out = np.zeros(x.shape, np.float32)
    for dy in range(kernel.shape[0]):
        for dx in range(kernel.shape[1]):
            out += kernel[dy, dx] * padded[dy : dy + x.shape[0], dx : dx + x.shape[1]]
    return out


def debayer(raw: np.ndarray, pattern: str = DEFAULT_PATTERN) -> np.ndarray:
    """(3, ny, nx): bilinear interpolation of each colour from its own samples, which stay as they are."""
    if raw.ndim != 2:
        raise ValueError("a mosaic has two axes")
    raw, out = raw.astype(np.float32), []
    for mask in masks(raw.shape, pattern):
        weight = smooth(mask.astype(np.float32), KERNEL)
        out.append(np.where(mask, raw, smooth(np.where(mask, raw, 0), KERNEL) / np.maximum(weight, 1e-6)))
    return np.stack(out).astype(np.float32)


def green_half(raw: np.ndarray, pattern: str = DEFAULT_PATTERN) -> np.ndarray:
    greens = [raw[i // 2 :: 2, i % 2 :: 2] for i, c in enumerate(PATTERNS[pattern]) if c == "G"]
    ny, nx = min(g.shape[0] for g in greens), min(g.shape[1] for g in greens)
    return np.mean([g[:ny, :nx].astype(np.float32) for g in greens], axis=0)


def channel_medians(raw: np.ndarray, pattern: str = DEFAULT_PATTERN) -> np.ndarray:
    return np.array([np.median(raw[m]) for m in masks(raw.shape, pattern)])
