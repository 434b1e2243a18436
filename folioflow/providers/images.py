"""Image kernels on numpy arrays: RGB uint8 (h, w, 3) or grey uint8 (h, w). No image library is needed."""

from __future__ import annotations

import numpy as np


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb if rgb.ndim == 2 else np.floor(rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114 + 0.5).astype(np.uint8)


def otsu(g: np.ndarray, low: int = 0, high: int = 255, default: int = 160) -> int:
    """Threshold with the greatest variance between the two sides, held within bounds."""
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    w = np.cumsum(n)
    s = np.cumsum(n * np.arange(256))
    other = w[-1] - w
    ok = (w > 0) & (other > 0)
    if not ok.any():
        return int(np.clip(default, low, high))
    between = np.where(ok, w * other * (s / np.maximum(w, 1) - (s[-1] - s) / np.maximum(other, 1)) ** 2, -1)
    return int(np.clip(between.argmax(), low, high))


def binary(g: np.ndarray, low: int = 80, high: int = 210) -> np.ndarray:
    return g < otsu(g, low, high)


def projection_score(g: np.ndarray) -> float:
    """Variance of dark pixels by row; 0 on a page with next to none."""
    rows = (g < 165).sum(axis=1)
    return 0.0 if rows.sum() < 0.003 * g.size else float(rows.var())


def rotate(g: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """Rotated about the middle, same size, nearest pixel, on white."""
    h, w = g.shape[:2]
    a = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w]
    dy, dx = y - h / 2 + 0.5, x - w / 2 + 0.5
    sx = np.rint(np.cos(a) * dx + np.sin(a) * dy + w / 2 - 0.5).astype(int)
    sy = np.rint(-np.sin(a) * dx + np.cos(a) * dy + h / 2 - 0.5).astype(int)
    ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(g, fill)
    out[ok] = g[sy[ok], sx[ok]]
    return out


def deskew_angle(g: np.ndarray, span: int = 4) -> int:
    """Whole angle at which the rows stand out best; a single degree is left alone."""
    best = max(range(-span, span + 1), key=lambda a: (projection_score(rotate(g, a)), -abs(a)))
    return 0 if abs(best) < 1 else best


def upscale(g: np.ndarray, k: int) -> np.ndarray:
    return g.repeat(k, axis=0).repeat(k, axis=1)


def box_mean(g: np.ndarray, radius: int) -> np.ndarray:
    """Mean over a square around each pixel, by an integral image."""
    h, w = g.shape
    s = np.zeros((h + 1, w + 1))
    s[1:, 1:] = g.cumsum(0, dtype=float).cumsum(1)
    y0, y1 = np.maximum(np.arange(h) - radius, 0), np.minimum(np.arange(h) + radius + 1, h)
    x0, x1 = np.maximum(np.arange(w) - radius, 0), np.minimum(np.arange(w) + radius + 1, w)
    total = s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]
    return total / ((y1 - y0)[:, None] * (x1 - x0)[None])


def _u8(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def flattened(g: np.ndarray, radius: int = 12) -> np.ndarray:
    return _u8(128 + (g - box_mean(g, radius)) * 2.25)


def adaptive(g: np.ndarray, radius: int = 12, bias: float = 9) -> np.ndarray:
    return np.where(g < box_mean(g, radius) - bias, 0, 255).astype(np.uint8)


def mean_threshold(g: np.ndarray, below: float = 8) -> np.ndarray:
    return np.where(g < g.mean() - below, 0, 255).astype(np.uint8)


def text_mask(g: np.ndarray, away: float = 28) -> np.ndarray:
    """Black where a pixel is well under the mean, white elsewhere."""
    return np.where(g < g.mean() - away, 0, 255).astype(np.uint8)


def dark_near(dark: np.ndarray, radius: int = 1) -> np.ndarray:
    """Share of dark pixels in the square around each pixel, as far as it lies in the image."""
    return box_mean(dark.astype(float), radius)


def contrast(g: np.ndarray, gain: float = 1.4, bright: float = 1.0) -> np.ndarray:
    return _u8((g * bright - 128.0) * gain + 128)


def sharpen(g: np.ndarray) -> np.ndarray:
    p = np.pad(g.astype(float), 1, mode="edge")
    return _u8(2.8 * p[1:-1, 1:-1] - 0.45 * (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]))


def blue(rgb: np.ndarray) -> np.ndarray:
    x = rgb.astype(float)
    return _u8(128 + (x[..., 2] - (x[..., 0] + x[..., 1]) / 2) * 1.8)


def equalised(g: np.ndarray, limit: float = 3.0) -> np.ndarray:
    """Histogram equalisation with clipped counts."""
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    top = limit * n.mean()
    n = np.minimum(n, top) + np.maximum(n - top, 0).sum() / 256
    c = n.cumsum()
    return _u8(c[g] / c[-1] * 255)


def colour_mask(rgb: np.ndarray) -> np.ndarray:
    """White, gold-brown and dark pixels as ink on white."""
    r, g, b = (rgb[..., i].astype(int) for i in range(3))
    ink = ((r > 205) & (g > 205) & (b > 205)) | ((r > 120) & (r - b > 45) & (g > 70)) | ((r < 90) & (g < 90) & (b < 90))
    return np.where(ink, 0, 255).astype(np.uint8)


def variant(rgb: np.ndarray, name: str) -> np.ndarray:
    g = grey(rgb)
    makers = {
        "original": lambda: g, "upscale2": lambda: upscale(g, 2), "upscale4": lambda: upscale(g, 4), "upscale6": lambda: upscale(g, 6), "clahe": lambda: equalised(g), "small_mark": lambda: mean_threshold(g, 8), "soft_mask": lambda: mean_threshold(g, 12),
        "color_isolation": lambda: upscale(colour_mask(rgb), 4) if rgb.ndim == 3 else upscale(g, 4), "flattened": lambda: flattened(g), "adaptive": lambda: adaptive(g), "sharpen": lambda: sharpen(g), "contrast": lambda: contrast(g), "threshold": lambda: np.where(g < otsu(g), 0, 255).astype(np.uint8),
    }
    return makers[name]()


def longest_run(line: np.ndarray, gap: int = 0) -> int:
    """Longest run of dark pixels, bridging gaps of up to ``gap``."""
    at = np.flatnonzero(line)
    if not len(at):
        return 0
    ends = np.flatnonzero(np.diff(at) > gap + 1)
    first, last = np.append(0, ends + 1), np.append(ends, len(at) - 1)
    return int((at[last] - at[first] + 1).max())


def cluster(values: np.ndarray, tolerance: float) -> list[int]:
    """Rounded means of sorted values that lie within the tolerance of each other, one after the other."""
    v = np.sort(np.asarray(values, float))
    return [int(np.floor(p.mean() + 0.5)) for p in np.split(v, np.flatnonzero(np.diff(v) > tolerance) + 1) if len(p)]


def grid_lines(dark: np.ndarray, share: float = 0.22) -> tuple[list[int], list[int]]:
    """Rows and columns of ruled lines."""
    h, w = dark.shape
    rows = [y for y in range(h) if longest_run(dark[y]) >= share * w]
    cols = [x for x in range(w) if longest_run(dark[:, x]) >= share * h]
    return cluster(np.array(rows), 3), cluster(np.array(cols), 3)


def table_score(rows: list[int], cols: list[int], height: int, width: int) -> float:
    spread = lambda v, n: (max(v) - min(v)) / max(1, n) if len(v) > 1 else 0.0
    return min(1.0, min(1, len(rows) / 5) * 0.42 + min(1, len(cols) / 4) * 0.38 + min(1, spread(rows, height)) * 0.10 + min(1, spread(cols, width)) * 0.10)


def border_density(dark: np.ndarray, vertical: bool, at: int, begin: int, end: int) -> float:
    strip = dark[begin:end, max(0, at - 1) : at + 2] if vertical else dark[max(0, at - 1) : at + 2, begin:end]
    return float(strip.any(axis=1 if vertical else 0).mean()) if strip.size else 0.0


def merged_cells(dark: np.ndarray, rows: list[int], cols: list[int], least: float = 0.28) -> list[tuple[int, int, int, int]]:
    """(row, column, row span, column span) of cells, joined where the border between is missing."""
    n, m = len(rows) - 1, len(cols) - 1
    parent = list(range(max(0, n * m)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for r in range(n):
        for c in range(m):
            if c + 1 < m and border_density(dark, True, cols[c + 1], rows[r] + 2, rows[r + 1] - 1) < least:
                parent[root(r * m + c + 1)] = root(r * m + c)
            if r + 1 < n and border_density(dark, False, rows[r + 1], cols[c] + 2, cols[c + 1] - 1) < least:
                parent[root((r + 1) * m + c)] = root(r * m + c)
    groups: dict[int, list[int]] = {}
    for i in range(n * m):
        groups.setdefault(root(i), []).append(i)
    out = []
    for g in groups.values():
        rs, cs = [i // m for i in g], [i % m for i in g]
        out.append((min(rs), min(cs), max(rs) - min(rs) + 1, max(cs) - min(cs) + 1))
    return sorted(out)


def components(dark: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of connected dark pixels, four neighbours."""
    seen, out = np.zeros_like(dark), []
    for y, x in zip(*np.nonzero(dark), strict=True):
        if seen[y, x]:
            continue
        stack, box = [(y, x)], [x, y, x, y]
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            box = [min(box[0], b), min(box[1], a), max(box[2], b), max(box[3], a)]
            for i, j in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= i < dark.shape[0] and 0 <= j < dark.shape[1] and dark[i, j] and not seen[i, j]:
                    seen[i, j] = True
                    stack.append((i, j))
        out.append((int(box[0]), int(box[1]), int(box[2] - box[0] + 1), int(box[3] - box[1] + 1)))
    return out


def checkboxes(dark: np.ndarray, least: int = 8, most: int = 60) -> list[tuple[int, int, int, int, bool]]:
    """Square outlines with whether something is inside; 40 at most, from the top."""
    out = []
    for x, y, w, h in components(dark):
        if least <= w <= most and least <= h <= most and 0.75 <= w / h <= 1.25:
            box = dark[y : y + h, x : x + w]
            edge = (box[0].mean() + box[-1].mean() + box[:, 0].mean() + box[:, -1].mean()) / 4
            inner = box[2:-2, 2:-2]
            if edge > 0.7 and inner.size and inner.mean() < 0.9:
                out.append((x, y, w, h, bool(inner.mean() > 0.17)))
    return sorted(out, key=lambda b: (b[1], b[0]))[:40]


def runs(values: np.ndarray, threshold: float, least: int, gap: int) -> list[tuple[int, int]]:
    """Stretches [begin, end) over the threshold, bridging short gaps, at least so long."""
    at = np.flatnonzero(np.asarray(values) >= threshold)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > gap + 1)
    return [(int(a), int(b) + 1) for a, b in zip(at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)], strict=True) if b - a + 1 >= least]


def nearest_rank(values: np.ndarray, q: float) -> float:
    v = np.sort(values)
    return float(v[min(len(v) - 1, int(len(v) * q))]) if len(v) else 0.0


def text_bands(g: np.ndarray) -> list[dict]:
    """Horizontal bands that look like lines of text, with the features that rules ask for."""
    edge = np.abs(np.diff(g.astype(int), axis=1))
    energy, flips = edge.mean(axis=1), (edge > 28).sum(axis=1)
    level = max(1.5, nearest_rank(energy, 0.58))
    out = []
    for a, b in runs((energy >= level) & (flips >= max(2, nearest_rank(flips.astype(float), 0.54))), 1, 4, 2):
        band = g[a:b]
        dark = band < otsu(band)
        cols = np.flatnonzero(dark.any(axis=0))
        if not len(cols):
            continue
        x0, x1 = int(cols[0]), int(cols[-1]) + 1
        inside = dark[:, x0:x1].any(axis=0)
        glyphs = len(runs(inside, 1, 1, 0))
        gaps = np.diff([r[0] for r in runs(inside, 1, 1, 0)])
        out.append({
            "left": x0, "top": a, "width": x1 - x0, "height": b - a, "glyph_count": glyphs, "foreground_contrast": float((np.percentile(band, 95) - np.percentile(band, 5)) / 255),
            "baseline_evidence": float(min(1.0, dark[int((b - a) * 0.6) :, x0:x1].mean() * 3)), "spacing_consistency": float(1 / (1 + (gaps.std() / max(gaps.mean(), 1e-9) if len(gaps) else 1))), "connected_component_score": min(1.0, glyphs / 12),
        })
    return out


def barcode_score(g: np.ndarray) -> float:
    """Many even black-white changes along rows of a wide box."""
    flips = (np.abs(np.diff((g < otsu(g)).astype(int), axis=1))).sum(axis=1)
    if not len(flips) or not flips.mean():
        return 0.0
    many = min(1.0, flips.mean() / (g.shape[1] * 0.25))
    even = max(0.0, 1 - flips.std() / flips.mean())
    return float(many * 0.48 + even * 0.34 + min(1.0, g.shape[1] / max(1, g.shape[0]) / 2.2) * 0.18)


#: Zones of a cover as the preprocessing step cuts it; the review rules have bands of their own.
CROP_ZONES = [("top_illustration", 0.0, 0.44), ("main_title", 0.43, 0.61), ("subtitle", 0.57, 0.68), ("author_name", 0.66, 0.77), ("school_name", 0.75, 0.87), ("footer_text", 0.86, 1.0)]


def looks_like_cover(g: np.ndarray) -> bool:
    """Portrait, and busier above than below."""
    h, w = g.shape
    edge = np.abs(np.diff(g.astype(int), axis=1))
    return h > w * 1.15 and edge[: h // 2].mean() > 1.25 * edge[h // 2 :].mean() + 1e-9


def crop(rgb: np.ndarray, left: int, top: int, width: int, height: int, pad: float = 0.18) -> np.ndarray:
    p = int(round(height * pad))
    return rgb[max(0, top - p) : top + height + p, max(0, left - p) : left + width + p]


def region_hash(parts: list) -> str:
    """FNV-1a over the UTF-16 units of the parts joined by bars: a key for work already done."""
    h = 0x811C9DC5
    raw = "|".join("" if p is None else str(p) for p in parts).encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = ((h ^ (raw[i] | raw[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    return f"r{h:x}"
