"""Raster kernels: pictures as width, height and RGBA bytes, changed by an ordered list of operations in numpy."""

from __future__ import annotations

import json

import numpy as np


def _number(params: dict, name: str, other: float) -> float:
    try:
        v = float(params.get(name, other))
    except (TypeError, ValueError):
        return other
    return v if np.isfinite(v) else other


def _round(x):
    return np.floor(np.asarray(x) + 0.5)


def _table(img: np.ndarray, values) -> np.ndarray:
    """A picture with each colour looked up in 256 values; alpha stays."""
    out = img.copy()
    out[..., :3] = np.clip(_round(values), 0, 255).astype(np.uint8)[img[..., :3]]
    return out


def luma(img: np.ndarray) -> np.ndarray:
    r, g, b = (img[..., k].astype(np.float64) for k in range(3))
    return 0.299 * r + 0.587 * g + 0.114 * b  # in this order, so that halves round alike everywhere


def crop(img: np.ndarray, params: dict) -> np.ndarray:
    h, w = img.shape[:2]
    x, y = (int(np.clip(_round(_number(params, c, 0)), 0, n - 1)) for c, n in (("x", w), ("y", h)))
    cw = int(np.clip(_round(_number(params, "width", w - x)), 1, w - x))
    ch = int(np.clip(_round(_number(params, "height", h - y)), 1, h - y))
    return img[y : y + ch, x : x + cw].copy()


def rotate(img: np.ndarray, params: dict) -> np.ndarray:
    """Quarter turns are exact; any other angle takes the nearest pixel and keeps the size."""
    turn = _number(params, "degrees", _number(params, "angle", 0)) % 360
    if turn % 90 == 0:
        return np.rot90(img, -int(turn // 90)).copy()
    h, w = img.shape[:2]
    a = np.deg2rad(turn)
    y, x = np.mgrid[0:h, 0:w]
    dx, dy = x - (w - 1) / 2, y - (h - 1) / 2
    sx = _round(np.cos(a) * dx + np.sin(a) * dy + (w - 1) / 2).astype(int)
    sy = _round(-np.sin(a) * dx + np.cos(a) * dy + (h - 1) / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(img, 255)
    out[inside] = img[sy[inside], sx[inside]]
    return out


def brightness(img: np.ndarray, params: dict) -> np.ndarray:
    return _table(img, np.arange(256) + _number(params, "amount", 0) / 100 * 255)


def contrast(img: np.ndarray, params: dict) -> np.ndarray:
    a = np.clip(_number(params, "amount", 0) / 100 * 255, -255, 254)
    return _table(img, 259 * (a + 255) / (255 * (259 - a)) * (np.arange(256) - 128) + 128)


def levels(img: np.ndarray, params: dict) -> np.ndarray:
    black, white, gamma = _number(params, "black", 0), _number(params, "white", 255), _number(params, "gamma", 1)
    share = np.clip((np.arange(256) - black) / max(1e-9, white - black), 0, 1)
    return _table(img, 255 * share ** (1 / (gamma if gamma > 0 else 1)))


def curves(img: np.ndarray, params: dict) -> np.ndarray:
    """Straight lines between the points of a JSON list; a list that isn't one changes nothing."""
    try:
        points = sorted((float(x), float(y)) for x, y in json.loads(params.get("points", "")))
    except (TypeError, ValueError):
        return img.copy()
    if len(points) < 2:
        return img.copy()
    x, y = zip(*points)
    return _table(img, np.interp(np.arange(256), x, y))


def grayscale(img: np.ndarray, params: dict | None = None) -> np.ndarray:
    out = img.copy()
    out[..., :3] = _round(luma(img)).astype(np.uint8)[..., None]
    return out


def threshold(img: np.ndarray, params: dict) -> np.ndarray:
    out = img.copy()
    out[..., :3] = np.where(luma(img) >= _number(params, "level", 128), 255, 0).astype(np.uint8)[..., None]
    return out


def despeckle(img: np.ndarray, params: dict | None = None) -> np.ndarray:
    """A pixel unlike its neighbours' median, of whom few agree with it, takes that median's colour."""
    grey, (h, w) = luma(img), img.shape[:2]
    padded = np.pad(grey, 1, constant_values=np.nan)
    around = np.stack([padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    with np.errstate(invalid="ignore"):
        n = np.isfinite(around).sum(0)
        agree = (np.abs(around - grey) <= 32).sum(0)
        middle = np.nanmedian(around, axis=0) if h * w > 1 else grey
    lone = (n > 0) & (agree <= 0.2 * n) & (np.abs(grey - middle) > 64)
    out = img.copy()
    out[lone, :3] = _round(middle[lone]).astype(np.uint8)[:, None]
    return out


def remove_background(img: np.ndarray, params: dict) -> np.ndarray:
    """What joins a corner within a tolerance of its colour becomes clear."""
    h, w = img.shape[:2]
    near = _number(params, "tolerance", 24)
    seen, out = np.zeros((h, w), bool), img.copy()
    for y, x in ((0, 0), (0, w - 1), (h - 1, 0), (h - 1, w - 1)):
        if seen[y, x]:
            continue
        like = (np.abs(img[..., :3].astype(int) - img[y, x, :3].astype(int)).max(-1) <= near) & ~seen
        found = np.zeros((h, w), bool)
        found[y, x] = like[y, x]
        while True:  # grown by one pixel at a time until it stays
            grown = found.copy()
            grown[1:] |= found[:-1]
            grown[:-1] |= found[1:]
            grown[:, 1:] |= found[:, :-1]
            grown[:, :-1] |= found[:, 1:]
            grown &= like
            if (grown == found).all():
                break
            found = grown
        seen |= found
    out[seen, 3] = 0
    return out


KERNELS = {
    "crop": crop, "rotate": rotate, "straighten": rotate, "brightness": brightness, "contrast": contrast, "levels": levels, "curves": curves,
    "grayscale": grayscale, "threshold": threshold, "despeckle": despeckle, "removeBackground": remove_background,
}


def apply_ops(img: np.ndarray, ops: list[tuple[str, dict]]) -> np.ndarray:
    """Operations in order; unknown ones change nothing; the source stays as it is."""
    for name, params in ops:
        if name in KERNELS:
            img = KERNELS[name](img, params)
    return img.copy()


def size_after(width: int, height: int, ops: list[tuple[str, dict]]) -> tuple[int, int]:
    """Width and height without the pixels: only crops and quarter turns matter."""
    for name, params in ops:
        if name == "crop":
            x, y = (min(max(int(_round(_number(params, c, 0))), 0), n - 1) for c, n in (("x", width), ("y", height)))
            width = min(max(int(_round(_number(params, "width", width - x))), 1), width - x)
            height = min(max(int(_round(_number(params, "height", height - y))), 1), height - y)
        elif name in ("rotate", "straighten") and (_number(params, "degrees", _number(params, "angle", 0)) % 180) == 90:
            width, height = height, width
    return width, height
