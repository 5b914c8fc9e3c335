"""Dense image kernels on grey bytes, vectorised with numpy; Arrow-batched over a table.

An image is (height, width) uint8. Spark rows hold ``gray`` (binary, row by row)
with ``w`` and ``h``. These are the only functions that cannot be columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MOST_POINTS, ANGLE_STEP = 20_000, 0.5
SMALL, EDGE_SHARE, ANGLE_SPREAD, LEAST_LINE, LEAST_AREA, OUTSIDE, PEAKS = 360, 0.15, 3, 0.4, 0.3, 0.08, 8


def round_half_up(x):
    return np.floor(np.asarray(x, float) + 0.5)


def to_gray(rgba: np.ndarray) -> np.ndarray:
    """Weighted grey, cut to a byte."""
    return (rgba[..., :3].astype(np.float64) @ [299, 587, 114] / 1000).astype(np.uint8)


def histogram(gray: np.ndarray) -> np.ndarray:
    return np.bincount(gray.ravel(), minlength=256)


def stretch_bounds(gray: np.ndarray, clip: float = 0.02) -> tuple[int, int]:
    """Levels beyond which more than a share ``clip`` of the pixels lies."""
    counts, cut = histogram(gray), gray.size * clip
    low = np.flatnonzero(np.cumsum(counts[:255]) > cut)
    high = np.flatnonzero(np.cumsum(counts[:0:-1]) > cut)
    lo = int(low[0]) if len(low) else 255
    return lo, max(lo + 1, 255 - int(high[0]) if len(high) else 0)


def stretch(gray: np.ndarray, lo: int, hi: int, gain: float = 1.0) -> np.ndarray:
    level = (np.arange(256) - lo) * 255 / max(1, hi - lo)
    table = np.clip(round_half_up(128 + (level - 128) * (gain or 1)), 0, 255).astype(np.uint8)
    return table[gray]


def box_blur(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r + 1) squares with repeated edges, by running sums."""
    out = x.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(r + 1, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        sums = np.cumsum(padded, axis)
        n = out.shape[axis]
        out = (np.take(sums, np.arange(2 * r + 1, 2 * r + 1 + n), axis) - np.take(sums, np.arange(n), axis)) / (2 * r + 1)
    return out


def unsharp(gray: np.ndarray, amount: float, r: int) -> np.ndarray:
    if not amount:
        return gray.copy()
    return np.clip(round_half_up(gray + amount * (gray - box_blur(gray, max(1, int(r))))), 0, 255).astype(np.uint8)


def top_level(counts: np.ndarray, share: float) -> int:
    """The level under which all but the top ``share`` of counted values lie."""
    from_top = np.cumsum(counts[::-1])
    return max(0, len(counts) - 2 - int(np.searchsorted(from_top, share)))


def sharpness(gray: np.ndarray) -> float:
    lo, hi = stretch_bounds(gray, 0.01)
    g = gray.astype(np.int64)
    m = np.minimum(1024, round_half_up(np.hypot(g[1:-1, 2:] - g[1:-1, :-2], g[2:, 1:-1] - g[:-2, 1:-1]))).astype(int)
    m = m[m >= 4]
    if m.size < 20:
        return 1.0
    return min(1.0, top_level(np.bincount(m, minlength=1025), m.size * 0.01) / max(8, hi - lo))


def auto_params(gray: np.ndarray) -> dict:
    lo, hi = stretch_bounds(gray)
    s = sharpness(gray)
    return {"lo": lo, "hi": hi, "contrast": 1.0, "sharp": 0.0 if s >= 0.5 else min(1.5, float(round_half_up((0.5 - s) / 0.3 * 10)) / 10), "sharpness": s}


def enhance(gray: np.ndarray, params: dict, r: int | None = None) -> np.ndarray:
    out = stretch(gray, params["lo"], params["hi"], params["contrast"])
    return unsharp(out, params["sharp"], r or max(2, int(round_half_up(gray.shape[1] / 300)))) if params["sharp"] else out


def flatten(gray: np.ndarray, r: int, gain: float = 3.0) -> np.ndarray:
    """Differences from the neighbourhood's mean around middle grey."""
    return np.clip(np.rint(128 + (gray - box_blur(gray, r)) * gain), 0, 255).astype(np.uint8)


def otsu(gray: np.ndarray) -> int:
    counts = histogram(gray).astype(np.float64)
    n, below = counts.sum(), np.cumsum(counts)
    mass = np.cumsum(counts * np.arange(256))
    use = (below > 0) & (below < n)
    if not use.any():
        return 127
    above = np.where(use, n - below, 1)
    gap = mass / np.where(use, below, 1) - (mass[-1] - mass) / above
    between = np.where(use, below * above * gap * gap, 0)
    return int(between.argmax()) if between.max() > 0 else 127


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of 4-connected parts by repeated minima along rows and columns."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    far = mask.size + 1
    while True:
        before = label
        for axis in (0, 1):
            for flip in (False, True):
                x = np.flip(label, axis) if flip else label
                x = np.moveaxis(x, axis, 0)
                out = x.copy()
                for i in range(1, len(out)):
                    both = (out[i] > 0) & (out[i - 1] > 0)
                    out[i] = np.where(both, np.minimum(out[i], np.where(both, out[i - 1], far)), out[i])
                x = np.moveaxis(out, 0, axis)
                label = np.flip(x, axis) if flip else x
        if np.array_equal(before, label):
            return label


def screen_box(gray: np.ndarray) -> tuple[float, float, float, float] | None:
    """The largest bright part as a box of fractions with a small margin, or None."""
    h, w = gray.shape
    label = components(gray > otsu(gray))
    if not label.any():
        return None
    counts = np.bincount(label.ravel())
    counts[0] = 0
    ys, xs = np.nonzero(label == counts.argmax())
    x0, x1, y0, y1 = xs.min(), xs.max(), ys.min(), ys.max()
    bw, bh = x1 - x0 + 1, y1 - y0 + 1
    if not 0.05 <= bw * bh / (w * h) <= 0.8 or len(xs) < 0.6 * bw * bh:
        return None
    x, y = max(0.0, x0 / w - 0.03 * bw / w), max(0.0, y0 / h - 0.03 * bh / h)
    return x, y, min(1 - x, bw / w * 1.06), min(1 - y, bh / h * 1.06)


def sobel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inner pixels."""
    smooth = lambda a, b, c: a + 2 * b + c
    gx = smooth(x[:-2, 2:], x[1:-1, 2:], x[2:, 2:]) - smooth(x[:-2, :-2], x[1:-1, :-2], x[2:, :-2])
    gy = smooth(x[2:, :-2], x[2:, 1:-1], x[2:, 2:]) - smooth(x[:-2, :-2], x[:-2, 1:-1], x[:-2, 2:])
    return gx, gy


def strong(m: np.ndarray, pixels: int, share: float, least: int) -> int:
    return max(least, top_level(np.bincount(np.minimum(1024, m.astype(int)).ravel(), minlength=1025), pixels * share))


def skew_angle(gray: np.ndarray, most: float = 45.0) -> tuple[float, float]:
    """Degrees by which text leans, and how sharp that orientation stands out."""
    h, w = gray.shape
    x = gray.astype(np.float64)
    x[1:-1, 1:-1] = box_blur(gray, 1)[1:-1, 1:-1]
    gx, gy = sobel(x)
    m = np.hypot(gx, gy)
    ys, xs = np.nonzero(m >= strong(m, w * h, 0.12, 24))
    if len(xs) < 30:
        return 0.0, 1.0
    n_bins = int(90 / ANGLE_STEP)
    at = np.degrees(np.arctan2(gy[ys, xs], gx[ys, xs])) % 90 / ANGLE_STEP
    j, part, weight = np.floor(at).astype(int), at - np.floor(at), m[ys, xs]
    bins = np.bincount(j % n_bins, weight * (1 - part), n_bins) + np.bincount((j + 1) % n_bins, weight * part, n_bins)
    smooth = sum(k * np.roll(bins, -q) for q, k in zip(range(-3, 4), (1, 2, 3, 4, 3, 2, 1)))
    peak = int(smooth.argmax())
    start = peak * ANGLE_STEP - (90 if peak * ANGLE_STEP >= 45 else 0)
    stride = max(1, -(-len(xs) // MOST_POINTS))
    px, py = xs[::stride] + 1 - w / 2, ys[::stride] + 1 - h / 2
    reach = int(np.ceil(np.hypot(w, h) / 2)) + 2

    def stacked(deg: float) -> float:
        rows = np.bincount((round_half_up(py * np.cos(np.radians(deg)) - px * np.sin(np.radians(deg))) + reach).astype(int), minlength=2 * reach + 1).astype(float)
        return float(((rows[:-2] + 2 * rows[1:-1] + rows[2:]) ** 2).sum())

    tries = [start, *(start - 1.5 + 0.1 * i for i in range(31))]
    scores = [stacked(d) for d in tries]
    deg = float(round_half_up(tries[int(np.argmax(scores))] * 10)) / 10
    return (0.0, 1.0) if abs(deg) > most else (deg + 0.0, float(smooth[peak] / smooth.mean()))


def homography(src, dst) -> np.ndarray | None:
    """The nine numbers that send four points to four others; None where there are none."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -x * u, -y * u], [0, 0, 0, x, y, 1, -x * v, -y * v]]
        right += [u, v]
    try:
        return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0)
    except np.linalg.LinAlgError:
        return None


def project(h: np.ndarray, x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    d = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / d, (h[3] * x + h[4] * y + h[5]) / d


def inverse(h: np.ndarray) -> np.ndarray | None:
    m = np.asarray(h, float).reshape(3, 3)
    return None if abs(np.linalg.det(m)) < 1e-12 else np.linalg.inv(m).ravel()


def warp(image: np.ndarray, back: np.ndarray, width: int, height: int, fill: int = 0) -> np.ndarray:
    """Bilinear resampling: each output pixel looks up where ``back`` sends it."""
    h, w = image.shape[:2]
    ys, xs = np.mgrid[0:height, 0:width]
    x, y = project(back, xs + 0.5, ys + 0.5)
    x, y = x - 0.5, y - 0.5
    inside = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    x, y = np.where(inside, x, 0), np.where(inside, y, 0)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1, fx, fy = np.minimum(w - 1, x0 + 1), np.minimum(h - 1, y0 + 1), x - x0, y - y0
    src = image.astype(np.float64)
    if image.ndim == 3:
        fx, fy, inside = fx[..., None], fy[..., None], inside[..., None]
    out = (src[y0, x0] * (1 - fx) + src[y0, x1] * fx) * (1 - fy) + (src[y1, x0] * (1 - fx) + src[y1, x1] * fx) * fy
    return np.where(inside, np.clip(np.rint(out), 0, 255), fill).astype(np.uint8)


def rect_for(quad, most: float | None = None) -> tuple[int, int]:
    """Width and height of the rectangle with a quad's mean sides."""
    q = np.array(quad, float)
    side = lambda a, b: np.hypot(*(q[a] - q[b]))
    w, h = (side(0, 1) + side(3, 2)) / 2, (side(0, 3) + side(1, 2)) / 2
    k = min(1.0, most / max(w, h)) if most else 1.0
    return max(8, int(round_half_up(w * k))), max(8, int(round_half_up(h * k)))


def grow(quad, share: float) -> np.ndarray:
    q = np.array(quad, float)
    return q.mean(0) + (q - q.mean(0)) * (1 + share)


def tilt_of(quad) -> float:
    q = np.array(quad, float)
    flat = [np.degrees(np.arctan2(*(q[b] - q[a])[::-1])) for a, b in ((0, 1), (3, 2))]
    upright = [np.degrees(np.arctan2(*(q[b] - q[a]))) for a, b in ((0, 3), (1, 2))]
    return float(np.abs(flat + upright).max())


def area(quad) -> float:
    q = np.array(quad, float)
    n = np.roll(q, -1, 0)
    return float(abs((q[:, 0] * n[:, 1] - n[:, 0] * q[:, 1]).sum()) / 2)


def convex(quad) -> bool:
    q = np.array(quad, float)
    a, b = np.roll(q, -1, 0) - q, np.roll(q, -2, 0) - np.roll(q, -1, 0)
    z = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
    return bool((z > 0).all() or (z < 0).all())


def shrink(gray: np.ndarray, most: int = SMALL) -> tuple[np.ndarray, float]:
    """Means of blocks, so that the longest side is at most ``most``; the scale."""
    h, w = gray.shape
    s = min(1.0, most / max(w, h))
    if s == 1:
        return gray, 1.0
    sw, sh = max(2, int(round_half_up(w * s))), max(2, int(round_half_up(h * s)))
    sums = np.pad(np.cumsum(np.cumsum(gray.astype(np.float64), 0), 1), ((1, 0), (1, 0)))
    edge = lambda n, m: (np.arange(n) * m // n, np.maximum(np.arange(n) * m // n + 1, np.arange(1, n + 1) * m // n))
    (y0, y1), (x0, x1) = edge(sh, h), edge(sw, w)
    total = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    return (total / np.outer(y1 - y0, x1 - x0)).astype(np.uint8), sw / w


def chord(theta: float, rho: float, w: int, h: int) -> float:
    """Length of the line x cos + y sin = rho inside the image about its centre."""
    c, s = np.cos(theta), np.sin(theta)
    # the line is (rho c, rho s) + t (-s, c); each side bounds t
    low, high = -np.inf, np.inf
    for start, step, half in ((rho * c, -s, w / 2), (rho * s, c, h / 2)):
        if abs(step) < 1e-9:
            if abs(start) > half + 1e-6:
                return 0.0
        else:
            a, b = sorted(((-half - start) / step, (half - start) / step))
            low, high = max(low, a), min(high, b)
    return max(0.0, float(high - low))


def meeting(a: tuple, b: tuple) -> np.ndarray | None:
    m = np.array([[np.cos(a[0]), np.sin(a[0])], [np.cos(b[0]), np.sin(b[0])]])
    return None if abs(np.linalg.det(m)) < 1e-6 else np.linalg.solve(m, [a[1], b[1]])


def find_quad(gray: np.ndarray) -> dict | None:
    """The bright screen's frame: corners from top left clockwise, gain, tilt and cover."""
    g, scale = shrink(gray)
    h, w = g.shape
    gx, gy = sobel(g.astype(np.float64))
    m = np.hypot(gx, gy)
    mean = m.mean() or 1.0
    ys, xs = np.nonzero(m >= strong(m, w * h, EDGE_SHARE, 16))
    weight, px, py = m[ys, xs], xs + 1 - w / 2, ys + 1 - h / 2
    turn = round_half_up(np.degrees(np.arctan2(gy[ys, xs], gx[ys, xs]))).astype(int)
    reach = int(np.ceil(np.hypot(w, h) / 2)) + 1
    votes = np.zeros((180, 2 * reach + 1))
    rad = np.radians(np.arange(180))
    for d in range(-ANGLE_SPREAD, ANGLE_SPREAD + 1):
        t = (turn + d) % 180
        rho = round_half_up(px * np.cos(rad[t]) + py * np.sin(rad[t])).astype(int) + reach
        np.add.at(votes, (t, rho), weight)
    # peaks: nothing larger within three degrees and four pixels; the first of equals
    peak = votes > 0
    padded = np.pad(votes, ((0, 0), (4, 4)), constant_values=-1.0)
    for dt in range(-3, 4):
        for dr in range(-4, 5):
            if dt or dr:
                other = np.roll(padded, -dt, 0)[:, 4 + dr : 4 + dr + votes.shape[1]]
                peak &= (other < votes) | ((other == votes) & (dt > 0 or (dt == 0 and dr > 0)))
    families: dict[str, list] = {"flat": [], "upright": []}
    for t, r in zip(*np.nonzero(peak)):
        name = "flat" if 60 <= t <= 120 else "upright" if t <= 30 or t >= 150 else None
        length = chord(rad[t], r - reach, w, h) if name else 0.0
        if name and length >= LEAST_LINE * min(w, h):
            families[name].append((rad[t], float(r - reach), votes[t, r] / length))
    flat, upright = (sorted(f, key=lambda x: -x[2])[:PEAKS] for f in families.values())
    best, limit = None, np.array([w, h]) * (0.5 + OUTSIDE)
    for a, b in combinations(flat, 2):
        top, bottom = sorted((a, b), key=lambda x: x[1] / np.sin(x[0]))
        for c, d in combinations(upright, 2):
            left, right = sorted((c, d), key=lambda x: x[1] / np.cos(x[0]))
            corners = [meeting(*pair) for pair in ((top, left), (top, right), (bottom, right), (bottom, left))]
            if any(p is None or (np.abs(p) > limit).any() for p in corners) or not convex(corners):
                continue
            size, gain = area(corners), min(x[2] for x in (a, b, c, d)) / mean
            if size >= LEAST_AREA * w * h and (best is None or gain * np.sqrt(size) > best[0]):
                best = gain * np.sqrt(size), corners, gain, size
    if best is None:
        return None
    quad = (np.array(best[1]) + [w / 2, h / 2]) / scale
    return {"quad": quad.tolist(), "gain": float(best[2]), "tilt": tilt_of(quad), "cover": best[3] / (w * h)}


def level_step(gray: np.ndarray) -> dict:
    """Straighten the perspective if a frame stands out, else the lean of the text."""
    found = find_quad(gray)
    if found and found["gain"] >= 3 and found["cover"] < 0.97 and found["tilt"] >= 0.4:
        w, h = rect_for(found["quad"])
        back = homography([(0, 0), (w, 0), (w, h), (0, h)], found["quad"])
        if back is not None:
            return {"step": "quad", "deg": 0.0, "gain": found["gain"], "gray": warp(gray, back, w, h)}
    deg, gain = skew_angle(gray)
    if gain >= 1.5 and abs(deg) >= 0.3:
        deg = float(np.clip(round_half_up(deg * 10) / 10, -45, 45))
        return {"step": "lean", "deg": deg, "gain": gain, "gray": rotate(gray, -deg)}
    return {"step": "none", "deg": 0.0, "gain": gain, "gray": gray}


def rotate(gray: np.ndarray, deg: float) -> np.ndarray:
    """The image turned about its centre on a canvas that holds all of it, in its mean grey."""
    h, w = gray.shape
    c, s = np.cos(np.radians(deg)), np.sin(np.radians(deg))
    ow, oh = int(np.ceil(abs(w * c) + abs(h * s) - 1e-9)), int(np.ceil(abs(w * s) + abs(h * c) - 1e-9))
    back = np.array([c, s, w / 2 - c * ow / 2 - s * oh / 2, -s, c, h / 2 + s * ow / 2 - c * oh / 2, 0, 0, 1])
    return warp(gray, back, ow, oh, int(gray.mean()))


def map_images(df: DataFrame, kernel: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """Apply a kernel to (id, gray, w, h) rows; its dict gives the columns after id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"id": i, **kernel(np.frombuffer(g, np.uint8).reshape(h, w))} for i, g, w, h in zip(b["id"], b["gray"], b["w"], b["h"])], columns=None if len(b) else ["id"])

    return df.select("id", "gray", "w", "h").mapInPandas(run, schema)


def display_tone(v) -> np.ndarray:
    """Grey values in an S for the eye: a logistic curve about the middle."""
    return np.floor(255 / (1 + np.exp(-(np.asarray(v, float) - 128) / 30)) + 0.5).astype(np.uint8)


def cropped(g: np.ndarray, box: tuple[float, float, float, float], width: int) -> np.ndarray:
    """A box of fractions (x, y, w, h) of an image, at ``width`` pixels by nearest neighbours."""
    h, w = g.shape
    x0, y0 = int(box[0] * w), int(box[1] * h)
    part = g[y0 : max(y0 + 1, int(np.ceil((box[1] + box[3]) * h))), x0 : max(x0 + 1, int(np.ceil((box[0] + box[2]) * w)))]
    height = max(1, round(part.shape[0] * width / part.shape[1]))
    rows = np.minimum((np.arange(height) + 0.5) * part.shape[0] / height, part.shape[0] - 1).astype(int)
    columns = np.minimum((np.arange(width) + 0.5) * part.shape[1] / width, part.shape[1] - 1).astype(int)
    return part[np.ix_(rows, columns)]


def zone_display(g: np.ndarray, box: tuple[float, float, float, float], width: int = 1400) -> np.ndarray:
    """A zone for the eye: cropped, sharpened, in the tones of ``display_tone``."""
    part = cropped(g, box, width)
    return display_tone(enhance(part, {"lo": 0, "hi": 255, "contrast": 1, "sharp": 1.2}, max(2, round(part.shape[1] / 300))))


FULL = (0.0, 0.0, 1.0, 1.0)


def zone_views(g: np.ndarray) -> list[dict]:
    """The views in which a photo is searched: whole and its screen if it shows one, each as it is and with an even background."""
    found = screen_box(cropped(g, FULL, min(160, g.shape[1])))
    boxes = [("whole", FULL)] + ([("screen", found)] if found is not None else [])
    return [{"name": name, "box": box, "flat": flat} for name, box in boxes for flat in (False, True)]
