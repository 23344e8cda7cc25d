"""Made-up scenes for trials: textured ground seen by overlapping scenes, with gains, offsets and shifts of one's choice."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from . import tiff


def ground(rows: int, cols: int, seed: int = 42, rounds: int = 2) -> np.ndarray:
    """Smoothed noise between 0 and 1: enough texture to match blocks by."""
    x = np.random.default_rng(seed).random((rows, cols))
    for _ in range(rounds):
        x = (x + np.roll(x, 1, 0) + np.roll(x, 1, 1)) / 3
    return (x - x.min()) / (x.max() - x.min())


def scenes(n: int = 2, rows: int = 64, cols: int = 64, step: int = 32, gains: Sequence[float] = (), offsets: Sequence[float] = (), shifts: Sequence[tuple[int, int]] = (), n_bands: int = 1, nodata_rows: int = 0, nodata: float | None = None, seed: int = 42) -> list[tiff.Raster]:
    """n scenes of n_bands, step columns apart: gain x (1000 + 2000 ground x band) + offset; a scene's content is moved by its (rows, columns)."""
    pad = max([0, *(abs(k) for s in shifts for k in s)])
    base, out = ground(rows + 2 * pad, cols + step * (n - 1) + 2 * pad, seed), []
    for k in range(n):
        dy, dx = shifts[k] if k < len(shifts) else (0, 0)
        part = base[pad + dy : pad + dy + rows, pad + dx + k * step : pad + dx + k * step + cols]
        data = np.stack([(gains[k] if k < len(gains) else 1.0) * (1000 + 2000 * (b + 1) / n_bands * part) + (offsets[k] if k < len(offsets) else 0.0) for b in range(n_bands)]).astype("float32")
        if nodata is not None:
            data[:, :nodata_rows] = nodata
        out.append(tiff.Raster(data, (1.0, 0.0, float(k * step), 0.0, -1.0, float(rows)), "EPSG:32650", nodata))
    return out


def pair(rows: int = 512, cols: int = 512, overlap: int = 256, seed: int = 42) -> list[tiff.Raster]:
    """Two scenes, the second under a gain of 0.85 to 1.15 across its columns and an offset of -150 to 150 down its rows."""
    one, two = scenes(2, rows, cols, cols - overlap, seed=seed)
    two.data = (two.data * np.linspace(0.85, 1.15, cols) + np.linspace(-150, 150, rows)[:, None]).astype("float32")
    return [one, two]
