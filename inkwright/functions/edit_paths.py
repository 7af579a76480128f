"""Edit paths of many string pairs at once, in arrays.

Of all shortest ways to turn a source into a target one is taken, from the ends back: a step over both
strings if it can be on a shortest way, else one over the source alone, else one over the target alone.
Short pairs are solved together by size, longer ones together within a band, and the longest one by one
within a band. A band is widened until it holds the distance; for a pair alone its rows are kept at
intervals and worked out again, so memory stays linear.
"""

from __future__ import annotations

import numpy as np

MATCH, SUB, INS, DEL = range(4)
KINDS = ("match", "sub", "ins", "del")
#: Greatest lengths of the pairs that are solved together.
SIZES = (4, 8, 16, 32, 64)
_FAR = np.int32(1 << 29)
#: Longer pairs up to this length are solved together within a band, as many as this many cells hold; none alone needs more.
BANDED, CELLS = 8000, 1 << 23
_FAR_16 = np.int16(20000)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts one after another, offsets)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return flat, np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)]).astype(np.int64)


def _band_row(above: np.ndarray, i: int, s: int, padded: np.ndarray, m: int, band: int, place: np.ndarray) -> np.ndarray:
    """Row i of the table for columns i - band to i + band, from row i - 1."""
    row = above + (padded[i - 1 : i + 2 * band] != s)
    np.minimum(row[:-1], above[1:] + 1, out=row[:-1])
    first = band - i  # column 0
    if first >= 0:
        row[:first] = _FAR
        row[first] = i
    row[max(0, m - i + band + 1) :] = _FAR
    row -= place
    np.minimum.accumulate(row, out=row)
    row += place
    row[max(0, m - i + band + 1) :] = _FAR
    return row


def path(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, source place, target place) of the steps, in order, for one pair."""
    n, m = len(source), len(target)
    k = min(n, m)
    tail = source[n - k :][::-1] == target[m - k :][::-1]
    same = k if tail.all() else int(np.argmin(tail))  # a common end is always walked through
    n, m = n - same, m - same
    out: list[tuple[int, int, int]] = [(MATCH, n + x, m + x) for x in range(same - 1, -1, -1)]
    band = max(abs(n - m), 32)
    while n or m:
        band = min(band, max(n, m))
        every = max(1, int(np.sqrt(n)))
        place = np.arange(2 * band + 1, dtype=np.int32)
        padded = np.concatenate([np.full(band, 1 << 31, dtype="<u4"), target[:m], np.full(band + n + 1, 1 << 31, dtype="<u4")])
        row = np.where((place >= band) & (place <= m + band), place - band, _FAR).astype(np.int32)
        kept = [row]
        for i in range(1, n + 1):
            row = _band_row(row, i, source[i - 1], padded, m, band, place)
            if i % every == 0:
                kept.append(row)
        cost = int(row[m - n + band])
        if cost <= 2 * band + 1 - abs(n - m) or band >= max(n, m):
            break
        # A wider band finds no greater cost, so the band that allows for this one holds the distance.
        band = (cost + abs(n - m)) // 2 + 1
    i, j, rows, low = n, m, [], n + 1
    while i or j:
        if i - 1 < low and i:
            low = (i - 1) // every * every
            rows = [kept[low // every]]
            for r in range(low + 1, i + 1):
                rows.append(_band_row(rows[-1], r, source[r - 1], padded, m, band, place))
        if not i:
            out.append((DEL, 0, j - 1))
            j -= 1
            continue
        at = j - i + band
        cost, above = rows[i - low][at], rows[i - 1 - low]
        if j and above[at] + (source[i - 1] != target[j - 1]) == cost:
            i, j = i - 1, j - 1
            out.append((MATCH if source[i] == target[j] else SUB, i, j))
        elif at + 1 <= 2 * band and above[at + 1] + 1 == cost:
            i -= 1
            out.append((INS, i, j))
        else:
            j -= 1
            out.append((DEL, i, j))
    steps = np.array(out[::-1], dtype=np.int64).reshape(-1, 3)
    return steps[:, 0], steps[:, 1], steps[:, 2]


def _together(s: np.ndarray, n: np.ndarray, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, step from the end, kind, source place, target place) for padded pairs."""
    pairs, rows, columns = len(s), s.shape[1], t.shape[1]
    place = np.arange(columns + 1, dtype=np.int16)
    table = np.empty((rows + 1, pairs, columns + 1), dtype=np.int16)
    table[0] = place
    for i in range(1, rows + 1):
        above, row = table[i - 1], table[i]
        row[:, 0] = i
        np.minimum(above[:, :-1] + (s[:, i - 1 : i] != t), above[:, 1:] + 1, out=row[:, 1:])
        row -= place
        np.minimum.accumulate(row, axis=1, out=row)
        row += place
    who, i, j, step, out = np.arange(pairs), n.copy(), m.copy(), 0, []
    while True:
        live = (i > 0) | (j > 0)
        who, i, j = who[live], i[live], j[live]
        if not len(who):
            break
        up, left = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        cost, other = table[i, who, j], s[who, up] != t[who, left]
        both = (i > 0) & (j > 0) & (table[up, who, left] + other == cost)
        only = ~both & (i > 0) & (table[up, who, j] + 1 == cost)
        kind = np.where(both, np.where(other, SUB, MATCH), np.where(only, INS, DEL))
        i, j = np.where(kind == DEL, i, up), np.where(kind == INS, j, left)
        out.append((who, np.full(len(who), step), kind, i, j))
        step += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 5


def _banded(s: np.ndarray, n: np.ndarray, t: np.ndarray, m: np.ndarray, band: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(which pairs are solved, their steps as of ``_together``) of padded pairs, within a band.

    A path that leaves the band has over 2 * band + 1 - abs(n - m) steps over one string alone. A pair
    that takes no more edits than that has all its shortest paths inside, and is solved.
    """
    pairs, rows, wide = len(s), s.shape[1], 2 * band + 1
    place = np.arange(wide, dtype=np.int16)
    padded = np.zeros((pairs, band + max(t.shape[1], rows) + wide), dtype=t.dtype)
    padded[:, band : band + t.shape[1]] = t
    table = np.empty((rows + 1, pairs, wide), dtype=np.int16)
    table[0] = np.where(place >= band, place - band, _FAR_16)
    for i in range(1, rows + 1):
        above, row = table[i - 1], table[i]
        np.add(above, padded[:, i - 1 : i + 2 * band] != s[:, i - 1 : i], out=row)
        np.minimum(row[:, :-1], above[:, 1:] + np.int16(1), out=row[:, :-1])
        if i <= band:
            row[:, : band - i] = _FAR_16
            row[:, band - i] = i
        row -= place
        np.minimum.accumulate(row, axis=1, out=row)
        row += place
    apart, who = np.abs(m - n), np.arange(pairs)
    cost = table[n, who, np.clip(m - n + band, 0, 2 * band)]
    solved = (apart <= band) & (cost <= 2 * band + 1 - apart)
    who, step, out = who[solved], 0, []
    i, j = n[who], m[who]
    while True:
        live = (i > 0) | (j > 0)
        if not live.all():
            who, i, j = who[live], i[live], j[live]
        if not len(who):
            break
        up, left, at = np.maximum(i - 1, 0), np.maximum(j - 1, 0), j - i + band
        cost, other = table[i, who, at], s[who, up] != t[who, left]
        both = (i > 0) & (j > 0) & (table[up, who, at] + other == cost)
        only = ~both & (i > 0) & (at < 2 * band) & (table[up, who, np.minimum(at + 1, 2 * band)] + 1 == cost)
        kind = np.where(both, np.where(other, SUB, MATCH), np.where(only, INS, DEL))
        i, j = np.where(kind == DEL, i, up), np.where(kind == INS, j, left)
        out.append((who, np.full(len(who), step), kind, i, j))
        step += 1
    return solved, tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 5


def paths(sources: list[str], targets: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Steps of all pairs one after another: (offsets by pair, kind, source place, target place), code points of both sides' steps, 0 for none.

    Returns (offsets, kind, source place, target place, source code, target code, pair).
    """
    s, so = code_points(sources)
    t, to = code_points(targets)
    n, m = np.diff(so), np.diff(to)
    found: list[tuple[np.ndarray, ...]] = []
    equal = np.array([a == b for a, b in zip(sources, targets, strict=True)], dtype=bool)
    which = np.flatnonzero(equal)
    pair = np.repeat(which, n[which])
    place = np.arange(len(pair)) - np.repeat(np.cumsum(n[which]) - n[which], n[which])
    found.append((pair, n[pair] - 1 - place, np.full(len(pair), MATCH), place, place))
    size, below = np.maximum(n, m), -1
    for most in SIZES:
        which = np.flatnonzero(~equal & (size <= most) & (size > below))
        below = most
        for a in range(0, len(which), 1 << 15):
            some = which[a : a + (1 << 15)]
            grid = np.arange(most)
            fill = lambda flat, first, length: np.where(grid < length[:, None], flat[np.minimum(first[:, None] + grid, max(len(flat) - 1, 0))] if len(flat) else 0, 0)  # noqa: B023, E731
            who, step, kind, i, j = _together(fill(s, so[some], n[some]), n[some], fill(t, to[some], m[some]), m[some])
            found.append((some[who], step, kind, i, j))
    long_ = np.flatnonzero(~equal & (size > below))
    band, together = 16, long_[size[long_] <= BANDED]
    alone = [long_[size[long_] > BANDED]]
    while len(together):
        fits = (size[together] + 1) * (2 * band + 1) <= CELLS
        alone.append(together[~fits])
        together = together[fits]
        order, at, left = together[np.argsort(size[together], kind="stable")], 0, []
        while at < len(order):
            # Sizes rise: the first bounds how many there may be, then the last how many there are.
            some = order[at : at + max(1, CELLS // int((size[order[at]] + 1) * (2 * band + 1)))]
            some = some[: max(1, CELLS // int((size[some[-1]] + 1) * (2 * band + 1)))]
            at += len(some)
            fill = lambda flat, first, length: np.where(np.arange(int(length.max())) < length[:, None], flat[np.minimum(first[:, None] + np.arange(int(length.max())), len(flat) - 1)], 0)
            if not (n[some].min() and m[some].min()):
                alone.append(some)
                continue
            solved, (who, step, kind, i, j) = _banded(fill(s, so[some], n[some]), n[some], fill(t, to[some], m[some]), m[some], band)
            found.append((some[who], step, kind, i, j))
            left.append(some[~solved])
        together, band = np.concatenate(left) if left else np.zeros(0, dtype=np.int64), band * 2
    for p in np.concatenate(alone).tolist():
        kind, i, j = path(s[so[p] : so[p + 1]], t[to[p] : to[p + 1]])
        found.append((np.full(len(kind), p), np.arange(len(kind))[::-1], kind, i, j))
    pair, step, kind, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    counts = np.bincount(pair, minlength=len(sources))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    order = np.empty(len(pair), dtype=np.int64)
    order[offsets[pair + 1] - 1 - step] = np.arange(len(pair))
    pair, kind, i, j = pair[order], kind[order], i[order], j[order]
    side = lambda flat, first, place, none: np.where(kind == none, 0, flat[np.minimum(first[pair] + place, max(len(flat) - 1, 0))]) if len(flat) else np.zeros(len(kind), dtype=np.int64)
    return offsets, kind, i, j, side(s, so, i, DEL), side(t, to, j, INS), pair
