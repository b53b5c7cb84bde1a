"""Charts by their pixels: accent colours, bounding box, column histogram, bars or a line.

Pixel arithmetic has no form in the engine's functions, so images go in Arrow batches to numpy.
"""

from __future__ import annotations

import numpy as np


def shrink(rgb: np.ndarray, widest: int = 960) -> np.ndarray:
    """Bilinear reduction with a triangle filter that widens with the factor, if the image is wider."""
    h, w, _ = rgb.shape
    if w <= widest:
        return rgb
    return resize(rgb, widest, max(1, round(h * (widest / w))), lambda x: np.maximum(1 - np.abs(x), 0), 1.0)


def weights(size: int, new: int, kernel, support: float) -> np.ndarray:
    """new x size matrix of filter weights."""
    scale = size / new
    wide = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / wide
    w = kernel(x) * (np.abs(x) <= support)
    return w / w.sum(1, keepdims=True)


def resize(a: np.ndarray, width: int, height: int, kernel, support: float) -> np.ndarray:
    x = a.astype(np.float64).reshape(a.shape[0], a.shape[1], -1)
    x = np.einsum("nw,hwc->hnc", weights(a.shape[1], width, kernel, support), x, optimize=True)
    x = np.clip(np.rint(x), 0, 255)
    x = np.einsum("mh,hnc->mnc", weights(a.shape[0], height, kernel, support), x, optimize=True)
    return np.clip(np.rint(x), 0, 255).astype(np.uint8).reshape(height, width, *a.shape[2:])


def segments(counts: np.ndarray, threshold: int, narrowest: int) -> list[tuple[int, int]]:
    on = np.concatenate([[False], counts > threshold, [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= narrowest]


def direction(values: list[float], threshold: float) -> str:
    if len(values) < 2 or abs(values[-1] - values[0]) < threshold:
        return ""
    step = np.diff(values)
    up, down = int((step > 0).sum()), int((step < 0).sum())
    if values[-1] < values[0]:
        return "upward" if down >= up else ""
    return "downward" if up >= down else ""


def bars(mask: np.ndarray, found: list[tuple[int, int]]) -> list[tuple[int, int, int, float]]:
    """(bottom, width, height, fill) of the high enough components."""
    out = []
    for a, b in found:
        rows = np.flatnonzero(mask[:, a : b + 1].any(1))
        height, width = int(rows[-1] - rows[0]) + 1, b - a + 1
        if height >= int(mask.shape[0] * 0.18):
            out.append((int(rows[-1]), width, height, float(mask[:, a : b + 1].sum()) / (width * height)))
    return out


def chart_visual(rgb: np.ndarray) -> dict | None:
    """What chart an RGB image (height x width x 3 bytes) shows, or None."""
    a = shrink(rgb)
    mean = a.mean(2)
    mask = (a.max(2) - a.min(2) > 40) & (mean > 35) & (mean < 245)
    if mask.sum() < 200:
        return None
    ys, xs = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    m = mask[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
    h, w = m.shape
    if w < int(a.shape[1] * 0.22) or h < int(a.shape[0] * 0.12):
        return None
    counts = m.sum(0)

    def result(kind: str, trend: str, series: int) -> dict:
        return {"chart_like": True, "kind": kind, "trend": trend, "series_count": series, "bbox": {"width": w, "height": h}}

    found = bars(m, segments(counts, max(8, int(h * 0.05)), max(12, int(w * 0.04))))
    if len(found) >= 3:
        bottom, width, height, fill = zip(*found, strict=True)
        if max(bottom) - min(bottom) <= max(12, int(h * 0.12)) and max(width) <= int(w * 0.28) and min(fill) >= 0.55:
            return result("bar", direction([-float(x) for x in height], max(16.0, h * 0.12)), len(found))
    low = segments(counts, max(2, int(h * 0.012)), max(10, int(w * 0.04)))
    if len(low) == 1:
        region = m[:, low[0][0] : low[0][1] + 1]
        at = [np.nonzero(part)[0] for part in np.array_split(region, 8, axis=1)]
        centres = [float(y.mean()) for y in at if len(y) >= max(10, int(h * 0.01))]
        trend = direction(centres, max(14.0, h * 0.12)) if len(centres) >= 4 else ""
        if trend:
            return result("line", trend, 1)
    return None
