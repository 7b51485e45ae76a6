"""Whole-image kernels on stacks (frames, rows, cols): cubic resampling and filters."""

from __future__ import annotations

import math

import numpy as np


def keys(x: np.ndarray) -> np.ndarray:
    d = np.abs(x)
    return np.where(d <= 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0.0))


def sample(stack: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cubic samples of every frame at (x, y) (row, col); NaN where a footprint leaves the image or holds a NaN."""
    a, b = np.floor(x).astype(int), np.floor(y).astype(int)
    rows, cols = stack.shape[-2:]
    out = np.zeros((*stack.shape[:-2], *x.shape))
    ok = (a >= 1) & (a + 2 < rows) & (b >= 1) & (b + 2 < cols)
    for i in range(-1, 3):
        for j in range(-1, 3):
            w = keys(i - (x - a)) * keys(j - (y - b))
            out += w * stack[..., np.clip(a + i, 0, rows - 1), np.clip(b + j, 0, cols - 1)]
    return np.where(ok, out, np.nan)


def rotate(frame: np.ndarray, angle: float) -> np.ndarray:
    """Counter-clockwise by ``angle`` radians about the centre; an angle of exactly 0 changes nothing."""
    if angle == 0:
        return frame.copy()
    rows, cols = frame.shape
    dr, dc = np.meshgrid(np.arange(rows) - (rows - 1) / 2, np.arange(cols) - (cols - 1) / 2, indexing="ij")
    s, k = math.sin(angle), math.cos(angle)
    return sample(frame, dr * k + dc * s + (rows - 1) / 2, -dr * s + dc * k + (cols - 1) / 2)


def rotate_planes(frame: np.ndarray, mode: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, missing: np.ndarray, still: np.ndarray, s: np.ndarray, k: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(frame, mode, row, col, value, missing) of the planes (frame, mode) of pixel rows, each turned by its frame's sine and cosine.

    ``still`` frames keep their rows. A sample needs 16 values; a plane has a row and column of -1 besides, with a missing value.
    """
    side, grid = size + 2, size * size
    keys_of, plane = np.unique(np.stack([frame, mode]), axis=1, return_inverse=True)
    plane = plane.ravel()
    owner, kind = keys_of
    n_planes = len(owner)
    as_is = still[frame]
    cell = plane * (side * side) + (row + 1) * side + col + 1
    use = ~missing & (row >= 0) & (row < size) & (col >= 0) & (col < size)
    total = np.bincount(cell[use], value[use], n_planes * side * side).reshape(n_planes, -1)
    count = np.bincount(cell[use], minlength=n_planes * side * side).reshape(n_planes, -1)
    turning = np.flatnonzero(~still[owner] & np.isfinite(s[owner]) & np.isfinite(k[owner]))
    place = np.arange(grid)
    c = (size - 1) / 2
    dr, dc = place % size - c, place // size - c
    of, back = np.unique(owner[turning], return_inverse=True)
    x, y = dr * k[of, None] + dc * s[of, None] + c, -dr * s[of, None] + dc * k[of, None] + c
    a, b = np.floor(x).astype(int), np.floor(y).astype(int)
    wx, wy = [keys(i - (x - a)) for i in range(-1, 3)], [keys(i - (y - b)) for i in range(-1, 3)]
    out, seen = np.zeros((len(turning), grid)), np.zeros((len(turning), grid), int)
    for i in range(-1, 3):
        for j in range(-1, 3):
            tap = ((np.clip(a + i, -1, size) + 1) * side + np.clip(b + j, -1, size) + 1)[back]
            out += (wx[i + 1] * wy[j + 1])[back] * total[turning[:, None], tap]
            seen += count[turning[:, None], tap]
    p, q = np.nonzero(seen == 16)
    p, out = turning[p], out[p, q]
    none = np.full(n_planes, -1)
    return (
        np.concatenate([owner, owner[p], frame[as_is]]), np.concatenate([kind, kind[p], mode[as_is]]), np.concatenate([none, q % size, row[as_is]]), np.concatenate([none, q // size, col[as_is]]),
        np.concatenate([np.zeros(n_planes), out, value[as_is]]), np.concatenate([np.ones(n_planes, bool), np.zeros(len(out), bool), missing[as_is]]),
    )


def shift(stack: np.ndarray, d_row: float, d_col: float) -> np.ndarray:
    rows, cols = stack.shape[-2:]
    r, c = np.meshgrid(np.arange(rows, dtype=float), np.arange(cols, dtype=float), indexing="ij")
    return sample(stack, r - d_row, c - d_col)


def median_unsharp(frame: np.ndarray, width: int) -> np.ndarray:
    before = width // 2
    after = width - before - 1
    out = np.zeros_like(frame, float)
    windows = np.lib.stride_tricks.sliding_window_view(frame, (width, width))
    inner = slice(before, frame.shape[0] - after), slice(before, frame.shape[1] - after)
    out[inner] = frame[inner] - np.median(windows, axis=(2, 3))
    return out


def masked_gauss(frame: np.ndarray, fwhm: float, width: float) -> np.ndarray:
    """Gaussian means over the finite pixels in reach, with the weights that are left normalised."""
    size = max(3, int(width))
    half = (size + (size % 2 == 0)) // 2
    sigma = fwhm / (2 * math.sqrt(2 * math.log(2)))
    good = np.isfinite(frame)
    value, top, bottom = np.where(good, frame, 0.0), np.zeros_like(frame, float), np.zeros_like(frame, float)
    rows, cols = frame.shape
    for a in range(-half, half + 1):
        for b in range(-half, half + 1):
            w = math.exp(-(a * a + b * b) / (2 * sigma * sigma))
            to = slice(max(0, a), rows + min(0, a)), slice(max(0, b), cols + min(0, b))
            of = slice(max(0, -a), rows + min(0, -a)), slice(max(0, -b), cols + min(0, -b))
            top[to] += w * value[of]
            bottom[to] += w * good[of]
    return np.where(bottom > 0, top / np.where(bottom > 0, bottom, 1), np.nan)
