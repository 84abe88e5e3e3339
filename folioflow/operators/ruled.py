"""Tables drawn with rules, rebuilt page by page on arrays.

Positions, spans and glyph places are arrays; what lies between two cells is
one boolean per edge, so merging cells is labelling runs of a boolean grid.
Coordinates are points of the frame in which the page is read.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow import config as C
from folioflow.operators.flow import fragments_of, line_numbers
from folioflow.operators.grouped import per_group_arrays

CELLS = "table_no int, n_rows int, n_cols int, `row` int, col int, rowspan int, colspan int, text string, header string, x0 double, y0 double, x1 double, y1 double, char_ids array<bigint>, reject string"


@dataclass
class Segments:
    """Rules of one axis: where they lie and from where to where."""

    pos: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def take(self, keep) -> Segments:
        return Segments(self.pos[keep], self.start[keep], self.end[keep])

    def rows(self) -> list[tuple[float, float, float]]:
        return list(zip(self.pos.tolist(), self.start.tolist(), self.end.tolist()))


@dataclass
class Glyphs:
    char_id: np.ndarray
    text: np.ndarray
    box: np.ndarray  # n x 4
    baseline: np.ndarray
    size: np.ndarray
    bold: np.ndarray
    blank: np.ndarray

    def take(self, keep) -> Glyphs:
        return Glyphs(*(getattr(self, f)[keep] for f in self.__dataclass_fields__))

    @property
    def cx(self) -> np.ndarray:
        return (self.box[:, 0] + self.box[:, 2]) / 2

    @property
    def cy(self) -> np.ndarray:
        return (self.box[:, 1] + self.box[:, 3]) / 2


#: Up to so many rules or edges, lists are faster than arrays, whose calls cost more than their few numbers.
FEW = 64


def among(values: np.ndarray, own) -> np.ndarray:
    """Which values are among ``own``."""
    held = set(np.asarray(own).tolist())
    return np.array([v in held for v in values.tolist()], bool) if held else np.zeros(len(values), bool)


# --- rules -------------------------------------------------------------------------


def clusters(values: np.ndarray, step: float) -> np.ndarray:
    """Means of the runs of sorted values with steps of at most ``step``."""
    values = np.sort(values)
    if not len(values):
        return values
    first = np.flatnonzero(np.concatenate([[True], np.diff(values) > step]))
    return np.add.reduceat(values, first) / np.diff(np.append(first, len(values)))


def merged(s: Segments) -> Segments:
    """Rules on one line that nearly touch, as one: positions chained by 1.5, spans joined over 3, at the mean position."""
    if not len(s.pos):
        return s
    if len(s.pos) <= FEW:
        return _merged_few(s.rows())
    s = s.take(np.argsort(s.pos, kind="stable"))
    chain = np.concatenate([[0], np.cumsum(np.diff(s.pos) > C.SNAP)])
    order = np.lexsort((s.end, s.start, chain))
    s, chain = s.take(order), chain[order]
    shift = chain * (np.ptp(np.concatenate([s.start, s.end])) + C.JOIN_GAP + 1.0)  # chains apart, so one running maximum serves all
    reach = np.maximum.accumulate(s.end + shift)
    first = np.flatnonzero(np.concatenate([[True], (s.start + shift)[1:] > reach[:-1] + C.JOIN_GAP]))
    count = np.diff(np.append(first, len(chain)))
    return Segments(np.add.reduceat(s.pos, first) / count, s.start[first], np.maximum.reduceat(s.end, first))


def _merged_few(rows: list[tuple[float, float, float]]) -> Segments:
    chained, chain, was = [], 0, None
    for pos, start, end in sorted(rows, key=lambda r: r[0]):
        chain += was is not None and pos - was > C.SNAP
        was = pos
        chained.append((chain, start, end, pos))
    chained.sort(key=lambda r: r[:3])
    first, start, end, was = [], [], [], None
    for k, (chain, a, b, _) in enumerate(chained):
        if chain == was and not a > end[-1] + C.JOIN_GAP:
            end[-1] = max(end[-1], b)
        else:
            first.append(k)
            start.append(a)
            end.append(b)
        was = chain
    return Segments(np.add.reduceat([r[3] for r in chained], first) / np.diff([*first, len(chained)]), np.array(start), np.array(end))


def regions(h: Segments, v: Segments) -> list[tuple[Segments, Segments]]:
    """Groups of rules that touch within 2 points and hold both axes."""
    n = len(h.pos)
    order = np.argsort(v.pos)
    lo = np.searchsorted(v.pos[order], h.start - C.TOUCH, "left")
    hi = np.searchsorted(v.pos[order], h.end + C.TOUCH, "right")
    i = np.repeat(np.arange(n), hi - lo)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)] if len(i) else np.zeros(0, np.int64)
    met = (v.start[j] - C.TOUCH <= h.pos[i]) & (h.pos[i] <= v.end[j] + C.TOUCH)
    label = spread(n + len(v.pos), i[met], n + j[met])
    out = []
    for k in np.intersect1d(label[:n], label[n:]):
        out.append((h.take(label[:n] == k), v.take(label[n:] == k)))
    return out


def spread(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of n nodes over the links (a, b)."""
    if n <= FEW:
        return _spread_few(n, a.tolist(), b.tolist())
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def _spread_few(n: int, a: list[int], b: list[int]) -> np.ndarray:
    up = list(range(n))  # never a larger number than one's own
    for i, j in zip(a, b):
        while up[i] != i:
            i = up[i]
        while up[j] != j:
            j = up[j]
        up[max(i, j)] = min(i, j)
    for k in range(n):
        up[k] = up[up[k]]
    return np.array(up, np.int64)


def cover(s: Segments, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Share of the edges (pos, lo to hi) that rules within 1.5 of them cover; 1 for an edge without length."""
    if len(pos) <= FEW and len(s.pos) <= FEW:
        return _cover_few(s.rows(), list(zip(pos.tolist(), lo.tolist(), hi.tolist())))
    out = np.zeros(len(pos))
    order = np.lexsort((s.start, s.pos))
    s = s.take(order)
    for p in np.unique(pos):
        a, b = np.searchsorted(s.pos, p - C.SNAP, "left"), np.searchsorted(s.pos, p + C.SNAP, "right")
        own = np.flatnonzero(pos == p)
        if a == b:
            continue
        start, end = s.start[a:b], s.end[a:b]
        by = np.argsort(start, kind="stable")
        start, end = start[by], np.maximum.accumulate(end[by])
        first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
        start, end = start[first], end[np.append(first[1:], len(end)) - 1]  # apart and in order
        total = np.concatenate([[0.0], np.cumsum(end - start)])

        def before(x, start=start, end=end, total=total):
            k = np.searchsorted(start, x, "right") - 1
            return np.where(k >= 0, total[np.maximum(k, 0)] + np.minimum(x, end[np.maximum(k, 0)]) - start[np.maximum(k, 0)], 0.0)

        out[own] = before(hi[own]) - before(lo[own])
    length = hi - lo
    return np.where(length > 0, out / np.where(length > 0, length, 1.0), 1.0)


def _cover_few(rules: list[tuple], edges: list[tuple]) -> np.ndarray:
    known: dict[float, tuple[list, list, list]] = {}  # what the rules near a position cover, apart and in order
    out = []
    for pos, lo, hi in edges:
        if pos not in known:
            start, end, total = [], [], [0.0]
            for _, a, b in sorted((r for r in rules if pos - C.SNAP <= r[0] <= pos + C.SNAP), key=lambda r: r[1]):
                if start and not a > end[-1]:
                    end[-1] = max(end[-1], b)
                else:
                    start.append(a)
                    end.append(b)
            for a, b in zip(start, end):
                total.append(total[-1] + (b - a))
            known[pos] = start, end, total
        start, end, total = known[pos]

        def before(x, start=start, end=end, total=total):
            k = bisect_right(start, x) - 1
            return total[k] + min(x, end[k]) - start[k] if k >= 0 else 0.0

        out.append((before(hi) - before(lo)) / (hi - lo) if hi > lo else 1.0)
    return np.array(out, float)


# --- the grid -----------------------------------------------------------------------


def grid_of(h: Segments, v: Segments) -> tuple[np.ndarray, np.ndarray] | None:
    """Positions of columns and rows: outer sides at the outermost ends, rules strictly within as inner lines."""
    top, bottom = h.pos.min(), h.pos.max()
    left, right = min(h.start.min(), v.pos.min()), max(h.end.max(), v.pos.max())
    if bottom - top <= C.SNAP or right - left <= C.SNAP:
        return None

    def inner(values, lo, hi):
        c = clusters(values, C.SNAP)
        return np.concatenate([[lo], c[(c > lo + C.SNAP) & (c < hi - C.SNAP)], [hi]])

    return inner(v.pos, left, right), inner(h.pos, top, bottom)


class Places:
    """Glyphs by the grid place that holds their centre (the last places are closed); glyphs outside are left out."""

    def __init__(self, xs: np.ndarray, ys: np.ndarray, box: np.ndarray):
        self.xs, self.ys = xs, ys
        cx, cy = (box[:, 0] + box[:, 2]) / 2, (box[:, 1] + box[:, 3]) / 2
        inside = (cx >= xs[0]) & (cx <= xs[-1]) & (cy >= ys[0]) & (cy <= ys[-1])
        col = np.minimum(np.searchsorted(xs, cx[inside], "right") - 1, len(xs) - 2)
        row = np.minimum(np.searchsorted(ys, cy[inside], "right") - 1, len(ys) - 2)
        code = row * (len(xs) - 1) + col
        order = np.argsort(code, kind="stable")
        self.box, self.code = box[inside][order], code[order]
        self.cut = np.searchsorted(self.code, np.arange((len(xs) - 1) * (len(ys) - 1) + 1))

    def at(self, r: int, c: int) -> np.ndarray:
        k = r * (len(self.xs) - 1) + c
        return self.box[self.cut[k] : self.cut[k + 1]]

    def counts(self) -> np.ndarray:
        return np.diff(self.cut).reshape(len(self.ys) - 1, len(self.xs) - 1)

    def lines(self, size: float) -> tuple[np.ndarray, np.ndarray]:
        """(place, box) of the text lines of every place at once, by place and top to bottom; see :func:`text_line_boxes`."""
        if not len(self.box):
            return self.code, self.box
        cy = (self.box[:, 1] + self.box[:, 3]) / 2
        order = np.lexsort((cy, self.code))
        own, code = self.box[order], self.code[order]
        first = _line_starts(code, cy[order], C.LINE_STEP * size)
        return code[first], _united(own, first)


def _united(box: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Boxes around the runs of rows that begin at ``first``."""
    return np.stack([f.reduceat(box[:, k], first) for k, f in enumerate((np.minimum, np.minimum, np.maximum, np.maximum))], 1)


def _line_starts(code: np.ndarray, cy: np.ndarray, reach: float) -> np.ndarray:
    """Where lines begin among glyphs sorted by place and centre: a line ends more than ``reach`` below its first centre.

    All places step from line to line together, so there are as many steps
    as lines in the fullest place.
    """
    n = len(cy)
    place = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
    stop = np.append(place[1:], n)
    span = float(np.ptp(cy)) + reach + 1.0
    key = np.repeat(np.arange(len(place)) * span, stop - place) + (cy - cy.min())
    starts, at = [place], place
    while len(at):
        after = np.minimum(np.searchsorted(key, key[at] + reach, "right"), stop)
        # the shared key rounds: settle by the centres themselves
        while (back := (after - 1 > at) & (cy[after - 1] - cy[at] > reach)).any():
            after = after - back
        while (on := (after < stop) & ~(cy[np.minimum(after, n - 1)] - cy[at] > reach)).any():
            after = after + on
        more = after < stop
        at, stop = after[more], stop[more]
        starts.append(at)
    return np.sort(np.concatenate(starts))


def text_line_boxes(box: np.ndarray, size: float) -> np.ndarray:
    """Boxes of the lines of some glyphs, top to bottom: a line ends half a size below its first glyph's centre."""
    if not len(box):
        return box
    cy = (box[:, 1] + box[:, 3]) / 2
    order = np.argsort(cy, kind="stable")
    first = np.flatnonzero(np.diff(line_numbers(cy[order], np.full(len(box), size)), prepend=-1))
    return _united(box[order], first)


def word_runs(box: np.ndarray, size: float) -> list[tuple[float, float]]:
    """Spans of the glyphs of each line that stand closer than one size."""
    out = []
    cy = (box[:, 1] + box[:, 3]) / 2
    for line in text_line_boxes(box, size):
        own = box[(cy >= line[1]) & (cy <= line[3])]
        own = own[np.argsort(own[:, 0], kind="stable")]
        reach = np.maximum.accumulate(own[:, 2])
        first = np.flatnonzero(np.concatenate([[True], own[1:, 0] - reach[:-1] >= C.COL_GAP * size]))
        out += list(zip(own[first, 0], reach[np.append(first[1:], len(own)) - 1]))
    return out


#: Passes over a grid for columns that text makes: least width in sizes, rows that share it, whether all with text must.
TEXT_COLUMNS = ((C.COL_GAP, C.MIN_GAP_ROWS, False), (C.NARROW_GAP, C.NARROW_ROWS, True))


def text_columns(ink: Places, blanks: Places, size: float, gap: float, least: int, every: bool) -> list[float]:
    """Column lines that the text itself makes: middles of blank stretches that rows of a ruled column share.

    A stretch is at least ``gap`` sizes wide with text on both sides; it is
    shared by ``least`` rows (and by all with text if ``every``), no glyph
    crosses its middle, and it is neither always between single glyphs nor
    always over a blank glyph.
    """
    if len(ink.box) < 2:
        return []
    cols = len(ink.xs) - 1
    order = np.lexsort((ink.box[:, 2], ink.box[:, 0], ink.code))
    box, code = ink.box[order], ink.code[order]
    reach = _running_most(box[:, 2], code)
    inner = code[1:] == code[:-1]
    at = np.flatnonzero(inner & (box[1:, 0] - reach[:-1] >= gap * size))
    # glyphs between stretches: from the last stretch, or the place's first glyph, to the next or its last
    edges = np.sort(np.concatenate([at, np.flatnonzero(~inner), [-1, len(box) - 1]]))
    part = np.diff(edges)
    k = np.searchsorted(edges, at)
    single = (part[k - 1] == 1) & (part[k] == 1)
    texted = (ink.counts() > 0).sum(0)
    found: dict[int, list] = {}
    for i, alone in zip(at.tolist(), single.tolist()):
        r, c = divmod(int(code[i]), cols)
        lo, hi = float(reach[i]), float(box[i + 1, 0])
        middle = blanks.at(r, c)
        middle = (middle[:, 0] + middle[:, 2]) / 2
        found.setdefault(c, []).append((lo, hi, alone, bool(((middle >= lo) & (middle <= hi)).any())))
    out = []
    for c, own in sorted(found.items()):
        column = box[code % cols == c]
        for lo, hi, shared, alone, spaced in _shared(sorted(own)):
            x = (lo + hi) / 2
            crossed = ((column[:, 0] < x) & (x < column[:, 2])).any()
            if shared >= least and not crossed and not alone and not spaced and (not every or shared == texted[c]):
                out.append(x)
    return out


def _running_most(values: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The greatest value so far of each run of equal codes (in ascending order)."""
    kinds, rank = np.unique(values, return_inverse=True)
    shift = code * len(kinds)
    return kinds[np.maximum.accumulate(rank + shift) - shift]


def _shared(stretches: list[tuple]):
    """(lo, hi, how many, single, spaced) of what sorted stretches have in common: each goes to the first that it still meets."""
    while stretches:
        (lo, hi, single, spaced), rest, n = stretches[0], [], 1
        for a, b, s, p in stretches[1:]:
            if max(lo, a) < min(hi, b):
                lo, hi, single, spaced, n = max(lo, a), min(hi, b), single and s, spaced and p, n + 1
            else:
                rest.append((a, b, s, p))
        yield lo, hi, n, single, spaced
        stretches = rest


def text_rows(ink: Places, size: float) -> list[float]:
    """Row lines that aligned text makes within ruled rows.

    Most columns with text (two at least) have the same n >= 2 lines whose
    tops agree within a tenth of a size, far enough apart (0.8 sizes, or 0.85
    of the middle height of one-line rows); the other columns hold one line
    that every cut crosses.
    """
    rows, cols = len(ink.ys) - 1, len(ink.xs) - 1
    place, boxes = ink.lines(size)
    count = np.bincount(place, minlength=rows * cols).reshape(rows, cols)
    cut = np.concatenate([[0], np.cumsum(count.ravel())])
    single = np.sort(np.diff(ink.ys)[(count.max(1) == 1)])
    pitch = C.ROW_PITCH * float(single[len(single) // 2]) if len(single) else np.inf
    out = []
    for r in np.flatnonzero(count.max(1) >= 2):
        columns = [boxes[cut[k] : cut[k + 1]] for k in range(r * cols, (r + 1) * cols) if cut[k + 1] > cut[k]]
        sizes = [len(x) for x in columns if len(x) >= 2]
        n = max(set(sizes), key=lambda k: (sizes.count(k), k))
        if sizes.count(n) < 2 or 2 * sizes.count(n) <= len(columns):
            continue
        lines = np.stack([x for x in columns if len(x) == n])  # columns x lines x sides
        tops, feet = lines[:, :, 1], lines[:, :, 3]
        gap = tops[:, 1:].min(0) - feet[:, :-1].max(0)
        step = tops[:, 1:].min(0) - tops[:, :-1].max(0)
        if np.ptp(tops, axis=0).max() > C.ROW_ALIGN * size or ((gap < C.ROW_GAP * size) & (step < pitch)).any():
            continue
        cuts = (feet[:, :-1].max(0) + tops[:, 1:].min(0)) / 2
        others = [x for x in columns if len(x) != n]
        if all(len(x) == 1 and (x[0, 1] < cuts).all() and (cuts < x[0, 3]).all() for x in others):
            out += cuts.tolist()
    return out


# --- edges and cells ------------------------------------------------------------------


class Edges:
    """For each edge between neighbouring places of the grid, whether it parts them."""

    def __init__(self, xs, ys, made_x: set, made_y: set, h: Segments, v: Segments, ink: Places, size: float):
        self.xs, self.ys, self.ink, self.size = xs, ys, ink, size
        rows, cols = len(ys) - 1, len(xs) - 1
        grid = lambda a, b: tuple(x.ravel() for x in np.meshgrid(a, b, indexing="ij"))
        r, c = grid(np.arange(rows), np.arange(1, cols))
        self.ruled_x = (cover(v, xs[c], ys[r], ys[r + 1]) >= C.EDGE_COVER).reshape(rows, cols - 1)
        r, c = grid(np.arange(1, rows), np.arange(cols))
        self.ruled_y = (cover(h, ys[r], xs[c], xs[c + 1]) >= C.EDGE_COVER).reshape(rows - 1, cols)
        self.made_x, self.made_y = (np.array([x in made for x in at[1:-1].tolist()], bool) for at, made in ((xs, made_x), (ys, made_y)))
        self.filled = ink.counts() > 0
        self.split_x, self.split_y = self.ruled_x.copy(), self.ruled_y.copy()
        box, col, row = ink.box, ink.code % cols, ink.code // cols
        self._columns(box, row)
        self._rows(box, col)

    def _columns(self, box, row):
        eps, xs = C.CROSS_EPS, self.xs
        # glyphs that cross a column line count for their whole row
        crossed = np.zeros((len(self.ys) - 1, len(xs) - 2), bool)
        first, last = np.searchsorted(xs, box[:, 0] + eps, "right"), np.searchsorted(xs, box[:, 2] - eps, "left")
        for k in np.flatnonzero(last > first):
            crossed[row[k], max(first[k] - 1, 0) : max(last[k] - 1, 0)] = True
        for r, c in zip(*np.nonzero(~self.ruled_x & ~crossed)):
            a, b = self.filled[r, c], self.filled[r, c + 1]
            if self.made_x[c]:
                self.split_x[r, c] = True
            elif a and b:
                x = xs[c + 1]
                runs = word_runs(np.concatenate([self.ink.at(r, c), self.ink.at(r, c + 1)]), self.size)
                self.split_x[r, c] = not any(lo < x - eps and hi > x + eps for lo, hi in runs)

    def _rows(self, box, col):
        eps, ys, xs = C.CROSS_EPS, self.ys, self.xs
        stacked = self._stacked()
        order = np.argsort(col, kind="stable")
        cut = np.searchsorted(col[order], np.arange(len(xs)))
        for r, c in zip(*np.nonzero(~self.ruled_y)):
            if stacked[r, c]:
                continue
            y, own = ys[r + 1], box[order[cut[c] : cut[c + 1]]]
            if self.made_y[r]:
                core = C.CORE * (own[:, 3] - own[:, 1])
                self.split_y[r, c] = not (np.abs((own[:, 1] + own[:, 3]) / 2 - y) < core).any()
                continue
            if ((own[:, 1] < y - eps) & (own[:, 3] > y + eps)).any():
                continue
            a, b = self.filled[r, c], self.filled[r + 1, c]
            if a and b:
                self.split_y[r, c] = True
            elif a or b:
                at = r if a else r + 1
                text = self.ink.at(at, c)
                middle = (text[:, 1].min() + text[:, 3].max()) / 2
                self.split_y[r, c] = abs(middle - (ys[at] + ys[at + 1]) / 2) <= C.CENTER_TOL * (ys[at + 1] - ys[at])

    def _stacked(self) -> np.ndarray:
        """Edges within runs of rows of a column, not parted by rules or text, that hold single glyphs in two places or more."""
        n = self.ink.counts()
        out = np.zeros(self.split_y.shape, bool)
        part = self.ruled_y | self.made_y[:, None]
        for c in range(n.shape[1]):
            edges = np.concatenate([[0], np.flatnonzero(part[:, c]) + 1, [n.shape[0]]])
            for a, b in zip(edges[:-1], edges[1:]):
                own = n[a:b, c]
                own = own[own > 0]
                if len(own) >= 2 and (own == 1).all():
                    out[a : b - 1, c] = True
        return out


def rectangles(split_x: np.ndarray, split_y: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Cells (row, col, rowspan, colspan): places that no edge parts, cut into rectangles where they are none."""
    rows, cols = split_x.shape[0], split_y.shape[1]
    number = np.arange(rows * cols).reshape(rows, cols)
    a = np.concatenate([number[:, :-1][~split_x], number[:-1][~split_y]])
    b = np.concatenate([number[:, 1:][~split_x], number[1:][~split_y]])
    label = spread(rows * cols, a, b).reshape(rows, cols)
    kinds, inverse, count = np.unique(label, return_inverse=True, return_counts=True)
    inverse = inverse.reshape(rows, cols)
    r, c = np.indices((rows, cols))
    lo_r, hi_r, lo_c, hi_c = (np.full(len(kinds), x) for x in (rows, -1, cols, -1))
    np.minimum.at(lo_r, inverse, r)
    np.maximum.at(hi_r, inverse, r)
    np.minimum.at(lo_c, inverse, c)
    np.maximum.at(hi_c, inverse, c)
    h, w = hi_r - lo_r + 1, hi_c - lo_c + 1
    whole = h * w == count
    out = list(zip(lo_r[whole].tolist(), lo_c[whole].tolist(), h[whole].tolist(), w[whole].tolist()))
    for k in np.flatnonzero(~whole):
        mask = inverse[lo_r[k] : hi_r[k] + 1, lo_c[k] : hi_c[k] + 1] == k
        out += [(int(lo_r[k]) + r, int(lo_c[k]) + c, n, m) for r, c, n, m in _peeled(mask.copy())]
    return sorted(out)


def _peeled(mask: np.ndarray):
    """Rectangles of a mask, the largest first (topmost, leftmost, lowest on ties), until single places are left."""
    while mask.any():
        best = _largest(mask)
        if best[2] * best[3] == 1:
            yield from ((int(r), int(c), 1, 1) for r, c in zip(*np.nonzero(mask)))
            return
        yield best
        r, c, n, m = best
        mask[r : r + n, c : c + m] = False


def _largest(mask: np.ndarray) -> tuple[int, int, int, int]:
    """For every height of a window of rows, the longest run of columns that are set in all of it."""
    rows, cols = mask.shape
    high = np.zeros((rows, cols), np.int64)  # set places from here downward
    for r in range(rows - 1, -1, -1):
        high[r] = np.where(mask[r], (high[r + 1] if r + 1 < rows else 0) + 1, 0)
    # each maximal rectangle is as high as its lowest column: spread left and right over columns at least as high
    left, right = np.zeros((rows, cols), np.int64), np.zeros((rows, cols), np.int64)
    for side, columns in ((left, range(cols)), (right, range(cols - 1, -1, -1))):
        step = 1 if side is right else -1
        for c in columns:
            at = np.full(rows, c)
            open_ = np.ones(rows, bool)
            while open_.any():
                near = at[open_] + step
                ok = (near >= 0) & (near < cols)
                rows_open = np.flatnonzero(open_)
                ok[ok] = high[rows_open[ok], near[ok]] >= high[rows_open[ok], c]
                jump = rows_open[ok]
                at[jump] = side[jump, near[ok]]  # its own reach is known already
                open_[:] = False
                open_[jump] = True
            side[:, c] = at
    area = high * (right - left + 1)
    top = area.max()
    r, c = np.nonzero(area == top)
    return min((int(a), int(left[a, b]), int(high[a, b]), int(right[a, b] - left[a, b] + 1)) for a, b in zip(r, c))


def compacted(xs, ys, cells):
    """Lines at which no cell starts are left out."""
    r, c, h, w = np.array(cells, np.int64).reshape(-1, 4).T
    keep_x, keep_y = np.unique(np.concatenate([[0], c, [len(xs) - 1]])), np.unique(np.concatenate([[0], r, [len(ys) - 1]]))
    top, left = np.searchsorted(keep_y, r), np.searchsorted(keep_x, c)
    rows, cols = np.searchsorted(keep_y, r + h) - top, np.searchsorted(keep_x, c + w) - left
    return xs[keep_x], ys[keep_y], list(zip(top.tolist(), left.tolist(), rows.tolist(), cols.tolist()))


# --- tables ----------------------------------------------------------------------------


def cell_text(g: Glyphs) -> str:
    """Lines of a cell by line feeds, fragments of a line by blanks; NFC."""
    if len(g.text) == 1:
        return unicodedata.normalize("NFC", str(g.text[0])).strip()
    order = np.lexsort((g.box[:, 0], g.baseline))
    own = g.take(order)
    parts, was = [], None
    for f in fragments_of({"text": own.text, "x0": own.box[:, 0], "y0": own.box[:, 1], "x1": own.box[:, 2], "y1": own.box[:, 3], "baseline": own.baseline, "size": own.size, "bold": own.bold, "char_id": own.char_id}):
        if was is not None:
            parts.append(" " if abs(f["baseline"] - was["baseline"]) <= C.LINE_STEP * max(f["size"], was["size"]) else "\n")
        parts.append(f["text"])
        was = f
    return unicodedata.normalize("NFC", "".join(parts))


def cell_texts(inside: Glyphs, own: np.ndarray, cells: int) -> list[str]:
    """:func:`cell_text` of every cell: ``own`` is the cell of each glyph, cells of blanks alone are empty.

    A cell is one plain word where its glyphs share a baseline and a size,
    none is blank, and no gap, whatever the usual one, can be wide; the text of
    such cells is read off one sort of all glyphs.
    """
    order = np.lexsort((inside.box[:, 0], inside.baseline, own))
    g, at = inside.take(order), own[order]
    cut = np.searchsorted(at, np.arange(cells + 1))
    full = np.flatnonzero(np.diff(cut))
    first = cut[full]
    least, most = (lambda x: np.minimum.reduceat(x, first)), (lambda x: np.maximum.reduceat(x, first))
    gap = np.append(g.box[1:, 0] - g.box[:-1, 2], 0.0)
    gap[cut[full + 1] - 1] = 0.0  # behind the last glyph of a cell
    plain = (least(g.baseline) == most(g.baseline)) & (least(g.size) == most(g.size)) & ~most(g.blank) & (most(gap) - np.minimum(least(gap), 0.0) <= C.SPACE_GAP * least(g.size))
    blank = least(g.blank)
    text, out = g.text.tolist(), [""] * cells
    for k, easy, empty in zip(full.tolist(), plain.tolist(), blank.tolist()):
        a, b = cut[k], cut[k + 1]
        if easy:
            out[k] = unicodedata.normalize("NFC", "".join(text[a:b]).strip())
        elif not empty:
            out[k] = cell_text(g.take(np.arange(a, b)))
    return out


def table_of(h: Segments, v: Segments, fills: Segments, glyphs: Glyphs, page_area: float) -> dict | None:
    """One region as a table, or None; ``reject`` names a table beyond a limit, whose text stays with the page."""
    grid = grid_of(h, v)
    if grid is None:
        return None
    xs, ys = grid
    if (len(xs) - 1) * (len(ys) - 1) > C.MAX_CELLS:
        return {"reject": "cells", "box": (xs[0], ys[0], xs[-1], ys[-1])}
    inside = glyphs.take((glyphs.cx >= xs[0]) & (glyphs.cx <= xs[-1]) & (glyphs.cy >= ys[0]) & (glyphs.cy <= ys[-1]))
    ink = inside.take(~inside.blank)
    if not len(ink.text):
        return None
    sizes, n = np.unique(np.round(ink.size / C.SIZE_STEP) * C.SIZE_STEP, return_counts=True)
    size = float(sizes[np.argmax(n)])
    first = Places(xs, ys, ink.box)
    frame = (xs[-1] - xs[0]) * (ys[-1] - ys[0])
    if len(xs) <= 4 and len(ys) <= 4 and frame > C.LAYOUT_AREA * page_area and any(len(text_line_boxes(first.at(r, c), size)) >= C.LAYOUT_LINES for r in range(len(ys) - 1) for c in range(len(xs) - 1)):
        return None
    blank = inside.box[inside.blank]
    made_x: set[float] = set()
    placed, spaces = first, Places(xs, ys, blank)  # made again where lines come to the grid
    for gap, least, every in TEXT_COLUMNS:
        if new := set(text_columns(placed, spaces, size, gap, least, every)) - made_x:
            made_x |= new
            xs = np.unique([*xs, *made_x])
            placed, spaces = Places(xs, ys, ink.box), Places(xs, ys, blank)
    if made_y := set(text_rows(placed, size)):
        ys = np.unique([*ys, *made_y])
        placed = Places(xs, ys, ink.box)
    if len(xs) < 3 or len(ys) < 3:
        return None
    if (len(xs) - 1) * (len(ys) - 1) > C.MAX_CELLS:
        return {"reject": "cells", "box": (xs[0], ys[0], xs[-1], ys[-1])}
    edges = Edges(xs, ys, made_x, made_y, h, v, placed, size)
    xs, ys, cells = compacted(xs, ys, rectangles(edges.split_x, edges.split_y))
    if len(xs) < 3 or len(ys) < 3:
        return None
    owner = np.zeros((len(ys) - 1, len(xs) - 1), np.int64)
    for k, (r, c, n, m) in enumerate(cells):
        owner[r : r + n, c : c + m] = k
    col = np.clip(np.searchsorted(xs, inside.cx, "right") - 1, 0, len(xs) - 2)
    row = np.clip(np.searchsorted(ys, inside.cy, "right") - 1, 0, len(ys) - 2)
    texts = cell_texts(inside, owner[row, col], len(cells))
    if sum(map(bool, texts)) < C.MIN_FILLED * len(cells):
        return None
    box = (float(xs[0]), float(ys[0]), float(xs[-1]), float(ys[-1]))
    if sum(len(t) * n * m for t, (_, _, n, m) in zip(texts, cells)) > C.MAX_EXPANDED_CHARS:
        return {"reject": "chars", "box": box}
    head = _has_header(xs, ys, cells, fills)
    return {"reject": None, "box": box, "n_rows": len(ys) - 1, "n_cols": len(xs) - 1, "cells": [(*cell, t, "column" if head and cell[0] == 0 else "none") for cell, t in zip(cells, texts)], "char_ids": np.sort(inside.char_id)}


def _has_header(xs, ys, cells, fills: Segments) -> bool:
    """The first row is a head if all its cells are one row high and shaded, and those that start in the second are not all."""
    upper, lower = [c for c in cells if c[0] == 0], [c for c in cells if c[0] == 1]
    if any(n != 1 for _, _, n, _ in upper):
        return False

    def shaded(own):
        r, c, n, m = (np.array(x) for x in zip(*own))
        both = [cover(fills, ys[at], xs[c], xs[c + m]) >= C.HEADER_COVER for at in (r, r + n)]
        return both[0] & both[1]

    return bool(shaded(upper).all()) and not (bool(shaded(lower).all()) if lower else True)


def tables_of(axis: np.ndarray, pos: np.ndarray, start: np.ndarray, end: np.ndarray, fill: np.ndarray, glyphs: Glyphs, page_area: float) -> list[dict]:
    """Tables of a page, top to bottom; none that holds another, none that shares a glyph with an earlier one."""
    good = end > start
    sides = {a: Segments(*(x[good & (axis == a)].astype(float) for x in (pos, start, end))) for a in ("h", "v")}
    shade = good & fill & (axis == "h")
    fills = Segments(pos[shade].astype(float), start[shade].astype(float), end[shade].astype(float))
    found = [t for h, v in regions(merged(sides["h"]), merged(sides["v"])) if (t := table_of(h, v, fills, glyphs, page_area))]
    made = [t for t in found if not t["reject"]]
    boxes = np.array([t["box"] for t in made]).reshape(-1, 4)
    out, used = [], np.zeros(0, np.int64)
    for t in sorted(made, key=lambda t: (t["box"][1], t["box"][0])):
        b = np.array(t["box"])
        holds = (b[:2] <= boxes[:, :2]).all(1) & (b[2:] >= boxes[:, 2:]).all(1) & (boxes != b).any(1)
        if not holds.any() and not among(t["char_ids"], used).any():
            out.append(t)
            used = np.concatenate([used, t["char_ids"]])
    return out + [t for t in found if t["reject"]]


def ruled_tables(rules: DataFrame, chars: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the tables drawn with rules: ``keys`` and the columns of ``CELLS``.

    rules: keys, axis ('h' or 'v'), pos, start, end and, if there, fill;
    chars: keys, text, x0..y1, baseline and, if there, char_id, size, bold,
    invisible, page_area.  The glyphs of a table are listed with its first
    cell.  A table beyond the limits of cells or text is one row with
    ``reject``; its glyphs stay with the page.
    """
    has = lambda df, c, other: F.col(c) if c in df.columns else other
    number = lambda c: F.col(c).cast("double").alias(c)
    r = rules.select(*keys, "axis", number("pos"), F.col("start").cast("double").alias("x0"), F.col("end").cast("double").alias("x1"), has(rules, "fill", F.lit(False)).alias("fill"))
    g = chars.where(~has(chars, "invisible", F.lit(False)))
    g = g.select(*keys, F.coalesce("text", F.lit(" ")).alias("text"), *map(number, ("x0", "y0", "x1", "y1", "baseline")), has(chars, "char_id", F.monotonically_increasing_id()).cast("bigint").alias("char_id"), has(chars, "size", F.col("y1") - F.col("y0")).cast("double").alias("size"), has(chars, "bold", F.lit(False)).alias("bold"), has(chars, "page_area", F.lit(float("inf"))).cast("double").alias("page_area"))
    pages = g.join(r.select(*keys).distinct(), keys, "left_semi").unionByName(r, allowMissingColumns=True)

    def one(page) -> list[dict]:
        drawn = np.array([a is not None for a in page["axis"]], bool)
        of = lambda c: page[c][~drawn]
        text = of("text")
        if drawn.all():
            return []
        glyphs = Glyphs(of("char_id").astype(np.int64), text, np.stack([of(c).astype(float) for c in ("x0", "y0", "x1", "y1")], 1), of("baseline").astype(float), of("size").astype(float), of("bold").astype(bool), np.array([t.isspace() or not t for t in text], bool))
        out = []
        for no, t in enumerate(tables_of(page["axis"][drawn].astype(str), page["pos"][drawn].astype(float), page["x0"][drawn], page["x1"][drawn], page["fill"][drawn].astype(bool), glyphs, float(of("page_area")[0]))):
            base = {"table_no": no, "reject": t["reject"], **dict(zip(("x0", "y0", "x1", "y1"), map(float, t["box"])))}
            if t["reject"]:
                out.append(base)
                continue
            for k, (row, col, n, m, txt, head) in enumerate(t["cells"]):
                out.append({**base, "n_rows": t["n_rows"], "n_cols": t["n_cols"], "row": row, "col": col, "rowspan": n, "colspan": m, "text": txt, "header": head, "char_ids": t["char_ids"].tolist() if k == 0 else None})
        return out

    return per_group_arrays(pages, keys, ["char_id", "axis", "pos", "x0"], one, CELLS)
