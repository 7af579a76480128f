"""Page images as whole arrays: one Arrow batch of pages at a time through numpy.

A page is a row (w, h, gray bytes); geometry, thresholds, rotation and rule detection work on it as one
array. ``clean_pages`` is the operator; the rest are its steps.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values.
INK, SAUVOLA_K, SAUVOLA_R = 128, 0.34, 128.0
QUAD_LONGEST, SKEW_LONGEST, REBINARISE = 640, 900, 200
MIN_AREA, MAX_COMPONENT, MAX_QUAD, MIN_EDGE = 0.10, 0.985, 0.97, 0.05


def luma(rgb: np.ndarray) -> np.ndarray:
    """8-bit gray of an RGB array by integer weights 77, 150, 29 of 256."""
    weights = np.array([77, 150, 29], dtype=np.uint32)
    return ((rgb[..., :3].astype(np.uint32) @ weights) >> 8).astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    h, w = image.shape
    lines = np.concatenate([np.zeros((h, 1), dtype=np.uint8), image], axis=1)
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def _edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    start = np.arange(m) * n // m
    return start, np.maximum(np.arange(1, m + 1) * n // m, start + 1)


def downscale(image: np.ndarray, longest: int) -> tuple[np.ndarray, float]:
    h, w = image.shape
    if longest <= 0 or max(w, h) <= longest:
        return image, 1.0
    dw, dh = (max(1, int(n * longest / max(w, h))) for n in (w, h))
    (y0, y1), (x0, x1) = _edges(h, dh), _edges(w, dw)
    table = np.pad(image.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    sums = table[np.ix_(y1, x1)] - table[np.ix_(y0, x1)] - table[np.ix_(y1, x0)] + table[np.ix_(y0, x0)]
    return (sums // np.outer(y1 - y0, x1 - x0)).astype(np.uint8), dw / w


def window_size(w: int, h: int, requested: int = 0) -> int:
    n = max(3, requested if requested > 0 else max(w, h) // 40)
    return n + (n % 2 == 0)


def window_moments(image: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    h, w = image.shape
    r = window // 2
    y0, y1 = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r + 1, h)
    x0, x1 = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r + 1, w)
    area = np.outer(y1 - y0, x1 - x0)

    def total(values: np.ndarray) -> np.ndarray:
        t = np.pad(values.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return (t[np.ix_(y1, x1)] - t[np.ix_(y0, x1)] - t[np.ix_(y1, x0)] + t[np.ix_(y0, x0)]) / area

    v = image.astype(np.float64)
    mean = total(v)
    return mean, np.sqrt(np.maximum(total(v * v) - mean * mean, 0.0))


def sauvola(image: np.ndarray, window: int = 0, k: float = SAUVOLA_K) -> np.ndarray:
    h, w = image.shape
    mean, std = window_moments(image, window_size(w, h, window))
    return np.where(image <= mean * (1 + k * (std / SAUVOLA_R - 1)), 0, 255).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    n = np.bincount(image.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    some = (below > 0) & (above > 0)
    if not some.any():
        return 127
    gap = np.zeros(256)
    gap[some] = mass[some] / below[some] - (mass[-1] - mass[some]) / above[some]
    return int(np.argmax(np.where(some, below * above * gap * gap, -1.0)))


def valley(image: np.ndarray) -> int:
    n = np.bincount(image.ravel(), minlength=256).astype(np.float64)
    reach = np.convolve(np.ones(256), np.ones(9), "same")
    for _ in range(3):
        n = np.convolve(n, np.ones(9), "same") / reach
    first = int(np.argmax(n))
    far = np.abs(np.arange(256) - first) >= 40
    if not far.any():
        return otsu(image)
    second = int(np.argmax(np.where(far, n, -1.0)))
    if n[second] <= 0 or n[second] < 0.01 * n[first]:
        return otsu(image)
    low, high = sorted((first, second))
    return low + int(np.argmin(n[low : high + 1]))


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The largest 4-connected part of a mask (the first in reading order of equal ones): runs by row, joined where they touch."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), dtype=np.int8)
    padded[:, 1:-1] = mask
    change = np.diff(padded, axis=1)
    row, start = np.nonzero(change == 1)
    _, end = np.nonzero(change == -1)
    if not len(row):
        return np.zeros_like(mask)
    first = np.searchsorted(row, np.arange(h + 1))
    a, b = [], []
    for y in range(1, h):  # runs of two rows touch where their columns overlap
        up, here = slice(first[y - 1], first[y]), slice(first[y], first[y + 1])
        lo = np.searchsorted(end[up], start[here], "right") + first[y - 1]
        hi = np.searchsorted(start[up], end[here], "left") + first[y - 1]
        n = np.maximum(hi - lo, 0)
        a.append(np.repeat(np.arange(first[y], first[y + 1]), n))
        b.append(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
    label = np.arange(len(row))
    a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, b))
    while True:
        after = label.copy()
        low = np.minimum(label[a], label[b])
        for side in (label[a], label[b], a, b):
            np.minimum.at(after, side, low)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    sizes = np.bincount(label, weights=end - start, minlength=len(row))
    best = int(np.argmax(sizes))
    out = np.zeros((h, w + 1), dtype=np.int32)
    some = label == best
    np.add.at(out, (row[some], start[some]), 1)
    np.add.at(out, (row[some], end[some]), -1)
    return out.cumsum(1)[:, :w].astype(bool)


def quad_area(q: np.ndarray) -> float:
    n = np.roll(q, -1, axis=0)
    return float(abs((q[:, 0] * n[:, 1] - n[:, 0] * q[:, 1]).sum()) / 2)


def quad_size(q: np.ndarray) -> tuple[int, int]:
    edge = lambda i, j: float(np.hypot(*(q[i] - q[j])))
    return max(1, int(max(edge(0, 1), edge(3, 2)) + 0.5)), max(1, int(max(edge(0, 3), edge(1, 2)) + 0.5))


def page_quad(image: np.ndarray) -> np.ndarray | None:
    """Corners (upper left, upper right, lower right, lower left) of a bright page on a darker ground, or None."""
    h, w = image.shape
    if w < 16 or h < 16:
        return None
    small, scale = downscale(image, QUAD_LONGEST)
    mask = largest_component(small > valley(small))
    area, whole = int(mask.sum()), small.size
    if area < whole // 10 or area > int(whole * MAX_COMPONENT):
        return None
    y, x = np.nonzero(mask)
    at = [np.argmin(x + y), np.argmax(x - y), np.argmax(x + y), np.argmin(x - y)]
    q = np.stack([x[at], y[at]], axis=1) / scale
    sides = np.hypot(*(q - np.roll(q, -1, axis=0)).T)
    if sides.min() < MIN_EDGE * min(w, h) or not MIN_AREA * w * h <= quad_area(q) <= MAX_QUAD * w * h:
        return None
    return q


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """3 x 3 matrix (last entry 1) that takes four points to four others; None if they don't fix one."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    m = np.array(rows, dtype=np.float64)
    if np.linalg.matrix_rank(m) < 8:
        return None
    return np.append(np.linalg.solve(m, np.array(right, dtype=np.float64)), 1.0).reshape(3, 3)


def apply_homography(m: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    d = np.where(np.abs(d) < 1e-12, 1e-12, d)
    return (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / d, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / d


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray, fallback: int = 255) -> np.ndarray:
    h, w = image.shape
    outside = (x < -0.5) | (y < -0.5) | (x > w - 0.5) | (y > h - 0.5)
    x0, y0 = np.floor(x), np.floor(y)
    fx, fy = x - x0, y - y0
    column = lambda d: np.clip(x0 + d, 0, w - 1).astype(np.int64)
    line = lambda d: np.clip(y0 + d, 0, h - 1).astype(np.int64)
    v = image.astype(np.float64)
    upper = v[line(0), column(0)] * (1 - fx) + v[line(0), column(1)] * fx
    lower = v[line(1), column(0)] * (1 - fx) + v[line(1), column(1)] * fx
    return np.where(outside, fallback, np.clip(upper * (1 - fy) + lower * fy, 0, 255) + 0.5).astype(np.uint8)


def warp(image: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    w, h = quad_size(q)
    m = homography(np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], dtype=np.float64), q)
    if m is None:
        return None
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    return sample(image, *apply_homography(m, x, y))


def rotate(image: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    h, w = image.shape
    s, c = math.sin(math.radians(degrees)), math.cos(math.radians(degrees))
    ow, oh = max(1, int(abs(w * c) + abs(h * s) + 0.5)), max(1, int(abs(w * s) + abs(h * c) + 0.5))
    y, x = np.mgrid[0:oh, 0:ow].astype(np.float64)
    dx, dy = x - (ow - 1) / 2, y - (oh - 1) / 2
    return sample(image, dx * c + dy * s + (w - 1) / 2, -dx * s + dy * c + (h - 1) / 2, fill)


def skew_score(x: np.ndarray, y: np.ndarray, w: int, h: int, degrees: float) -> float:
    s, c = math.sin(math.radians(degrees)), math.cos(math.radians(degrees))
    span = int(abs(w * s) + abs(h * c)) + 2
    bins = (-(x - w // 2) * s + (y - h // 2) * c + span // 2 + 0.5).astype(np.int64)
    profile = np.bincount(bins[(bins >= 0) & (bins < span)], minlength=span).astype(np.float64)
    return float((np.diff(profile) ** 2).sum())


def estimate_skew(binary: np.ndarray, limit: float = 10.0) -> float | None:
    """Degrees, by a sweep in quarters and one in twentieths around its best; None for too little ink."""
    ink = int((binary < INK).sum())
    if ink < 200 or ink / binary.size < 0.0005:
        return None
    small, _ = downscale(binary, SKEW_LONGEST)
    h, w = small.shape
    mx, my = w // 50 + 1, h // 50 + 1
    y, x = np.nonzero(small[my : h - my, mx : w - mx] < REBINARISE)
    y, x = y + my, x + mx
    coarse = [-limit + 0.25 * i for i in range(int(2 * limit / 0.25) + 1)]
    scores = [skew_score(x, y, w, h, a) for a in coarse]
    best = int(np.argmax(scores))
    fine = [a for a in (coarse[best] - 0.25 + 0.05 * i for i in range(11)) if abs(a) <= limit]
    found = [(scores[best], coarse[best])]
    for a in fine:
        score = skew_score(x, y, w, h, a)
        if score > found[0][0]:
            found[0] = (score, a)
    return found[0][1]


@dataclass(frozen=True)
class RuleParams:
    min_length: int
    max_thickness: int
    max_angle: float = 6.0
    step: float = 0.5
    min_fill: float = 0.75
    min_aspect: float = 18.0
    max_lines: int = 64

    @classmethod
    def of(cls, w: int, h: int) -> RuleParams:
        return cls(max(24, w // 15), min(14, max(3, h // 150)))


@dataclass(frozen=True)
class Rule:
    x0: float
    y0: float
    x1: float
    y1: float
    thickness: float
    angle_deg: float
    votes: int


def _toward_zero(v: np.ndarray) -> np.ndarray:
    return np.trunc(v).astype(np.int64)


def _runs_on_line(ink: np.ndarray, slope: float, intercept: float, angle: float, votes: int, p: RuleParams) -> list[Rule]:
    h, w = ink.shape
    x = np.arange(w)
    y = _toward_zero(slope * x + intercept + 0.5)
    get = lambda yy, xx: np.where((yy >= 0) & (yy < h), ink[np.clip(yy, 0, h - 1), xx], False)
    hits = np.flatnonzero(get(y, x) | get(y - 1, x) | get(y + 1, x))
    if not len(hits):
        return []
    # Runs end where a gap is longer than a quarter of the least length.
    cuts = np.flatnonzero(np.diff(hits) - 1 > p.min_length // 4 + 2)
    out = []
    for a, b in zip(hits[np.concatenate([[0], cuts + 1])], hits[np.concatenate([cuts, [len(hits) - 1]])], strict=True):
        length = int(b - a + 1)
        if length < p.min_length:
            continue
        sx = np.arange(a, b + 1, max(1, length // 32))
        sy = _toward_zero(slope * sx + intercept + 0.5)
        at = np.where(get(sy, sx), sy, np.where(get(sy - 1, sx), sy - 1, np.where(get(sy + 1, sx), sy + 1, -1)))
        on = at >= 0
        thick = []
        for xx, yy in zip(sx[on][:64], at[on][:64], strict=True):
            column, reach = ink[:, xx], p.max_thickness * 3 + 2
            above = column[max(0, yy - reach) : yy][::-1]
            below = column[yy + 1 : yy + 1 + reach]
            thick.append(1 + sum(int(part.argmin()) if not part.all() else len(part) for part in (above, below) if len(part)))
        if len(thick) < 3 or on.mean() < p.min_fill:
            continue
        median = sorted(thick)[len(thick) // 2]
        if median > p.max_thickness or length / median < p.min_aspect:
            continue
        out.append(Rule(float(a), slope * a + intercept, float(b), slope * b + intercept, float(median), angle, votes))
    return out


def distinct_rules(rules: list[Rule], p: RuleParams) -> list[Rule]:
    """The longest of each bundle: a shorter one that shares half its width and runs close by there is the same ink."""
    kept: list[Rule] = []
    for r in sorted(rules, key=lambda r: r.x0 - r.x1):

        def same(k: Rule, r: Rule = r) -> bool:
            lo, hi = max(r.x0, k.x0), min(r.x1, k.x1)
            if hi <= lo or hi - lo < 0.5 * (r.x1 - r.x0):
                return False
            height = lambda s: s.y0 + (s.y1 - s.y0) * (((lo + hi) / 2 - s.x0) / (s.x1 - s.x0) if s.x1 > s.x0 else 0.0)
            return abs(height(r) - height(k)) <= p.max_thickness * 2.5 + 1

        if not any(map(same, kept)):
            kept.append(r)
    return kept


def horizontal_rules(binary: np.ndarray, params: RuleParams | None = None) -> list[Rule]:
    """Near-horizontal strokes: votes by angle and intercept, peaks by votes, runs along them, one of each bundle."""
    h, w = binary.shape
    p = params or RuleParams.of(w, h)
    ink = binary < INK
    bx, by = w // 50 + 1, h // 50 + 1
    y, x = np.nonzero(ink[by : h - by, bx : w - bx])
    y, x = y + by, x + bx
    margin = int(w * math.tan(math.radians(p.max_angle))) + 2
    n = h + 2 * margin
    angles = [-p.max_angle + t * p.step for t in range(int(2 * p.max_angle / p.step) + 1)]
    slopes = [math.tan(math.radians(a)) for a in angles]
    votes = np.zeros((len(angles), n), dtype=np.int64)
    for t, slope in enumerate(slopes):
        c = _toward_zero(y - slope * x + 0.5) + margin
        votes[t] = np.bincount(c[(c >= 0) & (c < n)], minlength=n)
    t, c = np.nonzero(votes >= int(p.min_length * p.min_fill))
    order = np.lexsort((c, t, -votes[t, c]))
    free = np.ones(n, dtype=bool)
    rules: list[Rule] = []
    taken, reach = 0, 2 * p.max_thickness + 2
    for i in order:
        if taken >= p.max_lines or len(rules) >= p.max_lines:
            break
        if not free[c[i]]:
            continue
        free[max(0, c[i] - reach) : c[i] + reach + 1] = False
        taken += 1
        rules += _runs_on_line(ink, slopes[t[i]], float(c[i] - margin), angles[t[i]], int(votes[t[i], c[i]]), p)
    return distinct_rules(rules[: p.max_lines], p)


def clean_page(image: np.ndarray, k: float = SAUVOLA_K, window: int = 0, max_skew: float = 10.0) -> dict:
    """Rectify, binarise, straighten, find rules; the report's fields and the cleaned array."""
    quad = page_quad(image)
    page = warp(image, quad) if quad is not None else None
    applied = page is not None
    page = page if applied else image
    used = window_size(page.shape[1], page.shape[0], window)
    binary = sauvola(page, used, k)
    skew = estimate_skew(binary, max_skew)
    turn = skew is not None and abs(skew) > 0.1
    if turn:
        binary = np.where(rotate(binary, -skew) < INK, 0, 255).astype(np.uint8)
    rules = horizontal_rules(binary)
    h, w = binary.shape
    return {
        "source_width": image.shape[1], "source_height": image.shape[0], "width": w, "height": h, "perspective_applied": applied,
        "quad": quad.ravel().tolist() if applied else None, "deskew_applied": turn, "rotation_deg": -skew if turn else 0.0, "window": used,
        "ink_fraction": float((binary <= INK).mean()), "rules": [vars(r) for r in rules], "cleaned": binary,
    }


_RULES = pa.list_(pa.struct([(n, pa.int32() if n == "votes" else pa.float64()) for n in ("x0", "y0", "x1", "y1", "thickness", "angle_deg", "votes")]))
CLEAN_SCHEMA = (
    "page_id long, source_width int, source_height int, width int, height int, perspective_applied boolean, quad array<double>, deskew_applied boolean, rotation_deg double, window int, "
    "ink_fraction double, rules array<struct<x0:double,y0:double,x1:double,y1:double,thickness:double,angle_deg:double,votes:int>>, cleaned binary"
)


def clean_pages(pages: DataFrame) -> DataFrame:
    """(page_id, w, h, gray) to the report of each page; ``cleaned`` is a PNG. A page is one row, so nothing is shuffled."""
    names = [x.split()[0] for x in CLEAN_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w, h = batch.column("w")[i].as_py(), batch.column("h")[i].as_py()
                report = clean_page(np.frombuffer(batch.column("gray")[i].as_py(), dtype=np.uint8).reshape(h, w))
                report["cleaned"] = png(report["cleaned"])
                kinds = [pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.list_(pa.float64()), pa.bool_(), pa.float64(), pa.int32(), pa.float64(), _RULES, pa.binary()]
                values = [batch.column("page_id")[i].as_py(), *(report[n] for n in names[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    return pages.select("page_id", "w", "h", "gray").mapInArrow(run, CLEAN_SCHEMA)


def synthetic_page(w: int = 900, h: int = 1200, *, lines: int = 14, margin: int = 60, skew: float = 0.0, noise: float = 0.02, seed: int = 7, strike: bool = False) -> tuple[np.ndarray, dict]:
    """A page of word-like bars with known truth: where the lines are, the skew, and the struck word."""
    rng = np.random.default_rng(seed)
    image = np.full((h, w), 235, dtype=np.uint8)
    pitch, truth = (h - 2 * margin) // lines, {"skew": skew, "lines": lines, "strike": None}
    for i in range(lines):
        y, x = margin + i * pitch, margin
        while x < w - margin - 60:
            n = int(rng.integers(3, 9))
            for _ in range(n):
                image[y + 6 : y + 22, x : x + 3] = 30
                image[y + 18 : y + 21, x : x + 7] = 30
                x += 10
            x += 14
    if strike:
        y = margin + (lines // 2) * pitch + 14
        image[y : y + 3, margin : margin + 200] = 30
        truth["strike"] = (margin, y + 1, margin + 200)
    if skew:
        image = rotate(image, skew, 235)
    speckle = rng.random(image.shape) < noise * 0.1
    image[speckle] = np.where(rng.random(int(speckle.sum())) < 0.5, 60, 250).astype(np.uint8)
    return image, truth
