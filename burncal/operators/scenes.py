"""Labels of one scene in memory, by the rule of cells.

A cell is so small that all its points are neighbours. A cell of min_pts points holds core points only, so its points are never compared with each other;
only points of emptier cells look for neighbours, in the cells around. Components are those of cells: two are linked for certain if the boxes of
their core points lie within eps as a whole, not at all if the boxes are further apart, and in between if their closest points are near enough, which
halves of the boxes decide where there are many. The work grows with the points, however dense they lie.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np

PAIRS = 1 << 20  # tested at once
FEW = 4096  # pairs of points of two cells that are tested without halving their boxes
SLACK = 1e-9


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (the smallest member) after the components of a and b have become one."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def squared(d: np.ndarray) -> np.ndarray:
    """Sum of squares over the last axis, dimension by dimension, as the SQL adds them."""
    total = d[..., 0] * d[..., 0]
    for k in range(1, d.shape[-1]):
        total = total + d[..., k] * d[..., k]
    return total


def box_gap(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Squared distance between boxes, 0 where they meet."""
    return squared(np.maximum(0.0, np.maximum(low_b - high_a, low_a - high_b)))


def box_span(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Squared distance of the two furthest places of boxes."""
    return squared(np.maximum(high_b - low_a, high_a - low_b))


def products(size_a: np.ndarray, size_b: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, place in a, place in b) for all combinations of the members of pairs, at most about `most` of them at once; what one pair alone
    has beyond that comes in slices."""
    total, first = np.cumsum(size_a * size_b), 0
    while first < len(total):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + most, "right")))
        each = (size_a * size_b)[first:last]
        whole = int(each.sum())
        for begin in range(0, whole, most):
            at = np.arange(begin, min(whole, begin + most))
            pair = np.searchsorted(np.cumsum(each), at, "right")
            inside = at - (np.cumsum(each) - each)[pair]
            yield pair + first, inside // size_b[first:last][pair], inside % size_b[first:last][pair]
        first = last


def meet(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether a point of a lies within eps of one of b."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if box_span(a.min(0), a.max(0), b.min(0), b.max(0)) <= eps * eps * (1 - SLACK):
            return True
        reach = eps * eps * (1 + SLACK)
        a = a[box_gap(a, a, b.min(0), b.max(0)) <= reach]
        if not len(a):
            continue
        b = b[box_gap(b, b, a.min(0), a.max(0)) <= reach]
        if not len(b):
            continue
        if len(a) * len(b) <= FEW:
            if (squared(a[:, None] - b[None]) <= eps * eps).any():
                return True
            continue
        swap = len(b) > len(a)
        long, other = (b, a) if swap else (a, b)
        widths = np.ptp(long, axis=0)
        if not widths.max():  # one place
            stack.append((other, long[:1]) if swap else (long[:1], other))
            continue
        axis = int(widths.argmax())
        left = long[:, axis] <= long[:, axis].min() + widths[axis] / 2
        for half in (long[left], long[~left]):
            stack.append((other, half) if swap else (half, other))
    return False


class _Cells:
    """Points ordered by their cells; cells are numbered in the order of their keys."""

    def __init__(self, x: np.ndarray, side: float):
        at = np.floor(x / side).astype(np.int64)
        reach = reach_of(x.shape[1])
        at -= at.min(0) - reach
        spans = [int(s) for s in at.max(0) + reach + 1]
        if math.prod(spans) < 1 << 62:
            base = np.append(np.cumprod(spans[:0:-1])[::-1], 1).astype(np.int64)
            key = at @ base
            self.steps = {o: int(np.array(o) @ base) for o in itertools.product(range(-reach, reach + 1), repeat=x.shape[1])}
            self.order = np.argsort(key, kind="stable")
            self.keys, self.first = np.unique(key[self.order], return_index=True)
        else:  # too wide for one number: cells by rank, and neighbours by a dictionary
            rows, inverse = np.unique(at, axis=0, return_inverse=True)
            self.order = np.argsort(inverse.ravel(), kind="stable")
            self.first = np.searchsorted(inverse.ravel()[self.order], np.arange(len(rows)))
            self.keys, self.rows = None, rows
            self.number = {tuple(r): k for k, r in enumerate(rows.tolist())}
            self.steps = dict.fromkeys(itertools.product(range(-reach, reach + 1), repeat=x.shape[1]))
        self.size = np.diff(np.append(self.first, len(x)))
        self.cell = np.empty(len(x), np.int64)
        self.cell[self.order] = np.repeat(np.arange(len(self.size)), self.size)

    def beside(self, cells: np.ndarray, offset: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Those of the cells that have a neighbour at the offset, and the neighbours."""
        if self.keys is None:
            found = np.array([self.number.get(tuple(r), -1) for r in (self.rows[cells] + np.array(offset)).tolist()], np.int64)
            return cells[found >= 0], found[found >= 0]
        wanted = self.keys[cells] + self.steps[offset]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        there = self.keys[at] == wanted
        return cells[there], at[there]


class _Linked:
    """Core places of a scene, and which of their cells form one component. A place counts as `weight` points."""

    def __init__(self, x: np.ndarray, eps: float, min_pts: int, weight: np.ndarray):
        self.x, self.eps, d = x, eps, x.shape[1]
        self.cells = cells = _Cells(x, side_of(eps, d))
        self.around = [o for o in cells.steps if any(o)]
        points = np.add.reduceat(weight[cells.order], cells.first)
        self.core = core = points[cells.cell] >= min_pts
        seekers = np.flatnonzero(~core)
        degree = points[cells.cell[seekers]].astype(np.int64)  # itself and the others of its cell
        for a, b in self.near(seekers):
            degree += np.bincount(a, weights=weight[b], minlength=len(seekers)).astype(np.int64)
        core[seekers] = degree >= min_pts
        self.ordered = ordered = cells.order[core[cells.order]]  # core places, cell by cell
        self.held, self.first = np.unique(cells.cell[ordered], return_index=True)  # cells that have any
        held, first = self.held, self.first
        self.number = number = np.full(len(cells.size), -1)
        number[held] = np.arange(len(held))
        self.size = size = np.diff(np.append(first, len(ordered)))
        self.root = root = np.arange(len(held))
        if not len(held):
            return
        low, high = np.minimum.reduceat(x[ordered], first), np.maximum.reduceat(x[ordered], first)
        for offset in sorted((o for o in self.around if o > (0,) * d), key=lambda o: sum(c * c for c in o)):  # what near cells link needs no test of far ones
            own, other = cells.beside(held, offset)
            p, q = number[own], number[other]
            p, q = p[q >= 0], q[q >= 0]
            p, q = p[root[p] != root[q]], q[root[p] != root[q]]
            sure = box_span(low[p], high[p], low[q], high[q]) <= eps * eps * (1 - SLACK)
            root = joined(root, p[sure], q[sure])
            maybe = (root[p] != root[q]) & (box_gap(low[p], high[p], low[q], high[q]) <= eps * eps * (1 + SLACK))
            p, q = p[maybe], q[maybe]
            few = size[p] * size[q] <= FEW
            hit = np.zeros(len(p), bool)
            at = np.flatnonzero(few)
            for pair, i, j in products(size[p[at]], size[q[at]]):
                close = squared(x[ordered[first[p[at[pair]]] + i]] - x[ordered[first[q[at[pair]]] + j]]) <= eps * eps
                hit[at[pair[close]]] = True
            for k in np.flatnonzero(~few):
                hit[k] = meet(x[ordered[first[p[k]] : first[p[k]] + size[p[k]]]], x[ordered[first[q[k]] : first[q[k]] + size[q[k]]]], eps)
            root = joined(root, p[hit], q[hit])
        self.root = root

    def near(self, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position in `of`, place) of the places of other cells within eps."""
        cells, x = self.cells, self.x
        for offset in self.around:
            own, other = cells.beside(np.arange(len(cells.size)), offset)
            beside = np.full(len(cells.size), -1)
            beside[own] = other
            at = np.flatnonzero(beside[cells.cell[of]] >= 0)
            there = beside[cells.cell[of[at]]]
            for pair, _, k in products(np.ones(len(at), np.int64), cells.size[there]):
                b = cells.order[cells.first[there[pair]] + k]
                close = squared(x[of[at[pair]]] - x[b]) <= self.eps * self.eps
                yield at[pair[close]], b[close]

    def adjacent(self, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position in `of`, number of a cell with core places) of the core places within eps; those of one's own cell are."""
        own = self.number[self.cells.cell[of]]
        yield np.flatnonzero(own >= 0), own[own >= 0]
        for a, b in self.near(of):
            good = self.core[b]
            yield a[good], self.number[self.cells.cell[b[good]]]


def side_of(eps: float, d: int) -> float:
    """Of a cell whose points are all neighbours."""
    return eps / d**0.5 * (1 - SLACK)


def reach_of(d: int) -> int:
    """How many cells away neighbours may be, as a side is a little less than eps / sqrt(d)."""
    return math.floor(d**0.5) + 1


def label_scene(x: np.ndarray, eps: float, min_pts: int) -> tuple[np.ndarray, np.ndarray]:
    """Component (position of its first core point, -1 for noise) and label (from 1, 0 for noise) of points in the order of their ids."""
    n = x.shape[0] if x.ndim == 2 else 0
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = _Linked(x, eps, min_pts, np.ones(n, np.int64))
    component = np.full(n, n)
    if len(s.held):
        least = np.full(len(s.held), n)
        np.minimum.at(least, s.root, np.minimum.reduceat(s.ordered, s.first))
        component[s.ordered] = least[s.root][np.repeat(np.arange(len(s.held)), s.size)]
        border = np.flatnonzero(~s.core)
        for a, cell in s.adjacent(border):
            np.minimum.at(component, border[a], least[s.root[cell]])
    found, label = np.unique(component[component < n], return_inverse=True)
    out = np.zeros(n, np.int64)
    out[component < n] = label + 1
    return np.where(component == n, -1, component), out


def label_tile(x: np.ndarray, weight: np.ndarray, eps: float, min_pts: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What one tile of a scene, cells low to high (exclusive), can tell of components: (place, root) of its places that are in any, and links (node, root) of cells that
    other tiles see too. Nodes and roots are places, the first core place of a cell and of the cells here that are linked. Places come in the order of
    their ids, with those of twice `reach_of` cells around the tile.

    Neighbours of places up to `reach` cells around the tile are all here, so these are core or not for certain; further out a place may be core unnoticed, which
    loses links there, but the tiles of those cells find them. So links are true, and all tiles together have all of them. A border place may have several roots.
    """
    n, d = x.shape
    none = np.zeros(0, np.int64)
    at, reach = np.floor(x / side_of(eps, d)).astype(np.int64), reach_of(d)
    within = lambda margin: ((at >= low - margin) & (at < high + margin)).all(1)
    own, known = within(0), within(reach)
    if not own.any():
        return none, none, none, none
    s = _Linked(x, eps, min_pts, weight)
    if not len(s.held):
        return none, none, none, none
    node, sample = np.minimum.reduceat(s.ordered, s.first), s.ordered[s.first]
    sure, shared = known[sample], known[sample] & ~within(-reach)[sample]
    least = np.full(len(s.held), n)
    np.minimum.at(least, s.root[sure], node[sure])
    root = least[s.root]
    mine = own[s.ordered]
    places, roots = [s.ordered[mine]], [np.repeat(root, s.size)[mine]]
    border = np.flatnonzero(~s.core & own)
    for a, cell in s.adjacent(border):
        pairs = np.unique(border[a] * np.int64(n) + root[cell])
        places.append(pairs // n)
        roots.append(pairs % n)
    pairs = np.unique(np.concatenate(places) * np.int64(n) + np.concatenate(roots))
    linked = shared & (node != root)
    return pairs // n, pairs % n, node[linked], root[linked]


def unsure_boxes(x: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray, eps: float, min_pts: int) -> np.ndarray:
    """Which boxes of places have to be known place by place before components can be told; of the others one place that stands for all is enough. A box is a part of a cell, low to
    high, with a place x and `weight` points in it.

    Boxes that lie within eps as a whole are neighbours, whatever their places, those further apart are not, and what lies in between decides only for three kinds: boxes
    that may or may not be core, cells that no chain of sure neighbours connects, and borders that no sure neighbour ties to the same component.
    """
    d, near, far = x.shape[1], eps * eps * (1 + SLACK), eps * eps * (1 - SLACK)
    cells = _Cells(x, side_of(eps, d))
    around = sorted((o for o in cells.steps if any(o)), key=lambda o: sum(c * c for c in o))
    points = np.add.reduceat(weight[cells.order], cells.first)
    core = points[cells.cell] >= min_pts
    needed, seekers = np.zeros(len(x), bool), np.flatnonzero(~core)
    at_least = points[cells.cell[seekers]].astype(np.int64)
    at_most, every = at_least.copy(), np.arange(len(cells.size))
    sure_of, unsure_of = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
    for offset in around:
        own, other = cells.beside(every, offset)
        beside = np.full(len(every), -1)
        beside[own] = other
        at = np.flatnonzero(beside[cells.cell[seekers]] >= 0)
        there = beside[cells.cell[seekers[at]]]
        for pair, _, k in products(np.ones(len(at), np.int64), cells.size[there]):
            a, b = at[pair], cells.order[cells.first[there[pair]] + k]
            p = seekers[a]
            sure = box_span(low[p], high[p], low[b], high[b]) <= far
            maybe = box_gap(low[p], high[p], low[b], high[b]) <= near
            at_least += np.bincount(a[sure], weights=weight[b[sure]], minlength=len(seekers)).astype(np.int64)
            at_most += np.bincount(a[maybe], weights=weight[b[maybe]], minlength=len(seekers)).astype(np.int64)
            sure_of.append(np.stack([a[sure], b[sure]]))
            unsure_of.append(np.stack([a[maybe & ~sure], b[maybe & ~sure]]))
    certain, never = at_least >= min_pts, at_most < min_pts
    core[seekers] = certain
    needed[seekers] = ~certain & (weight[seekers] > 1)
    (a, b), (s, t) = np.concatenate(unsure_of, 1), np.concatenate(sure_of, 1)
    open_ = ~certain & ~never
    needed[b[open_[a]]] = True
    ordered = cells.order[core[cells.order]]
    held, first = np.unique(cells.cell[ordered], return_index=True)
    if not len(held):
        return needed
    size, number = np.diff(np.append(first, len(ordered))), np.full(len(every), -1)
    number[held], root = np.arange(len(held)), np.arange(len(held))

    def apart(offset: tuple[int, ...]) -> Iterator[tuple[np.ndarray, ...]]:
        own, other = cells.beside(held, offset)
        p, q = number[own], number[other]
        p, q = p[q >= 0], q[q >= 0]
        p, q = p[root[p] != root[q]], q[root[p] != root[q]]
        for pair, i, j in products(size[p], size[q]):
            yield p[pair], q[pair], ordered[first[p[pair]] + i], ordered[first[q[pair]] + j]

    ahead = [o for o in around if o > (0,) * d]
    for offset in ahead:
        hits = [np.zeros((2, 0), np.int64)]
        for p, q, i, j in apart(offset):
            sure = box_span(low[i], high[i], low[j], high[j]) <= far
            hits.append(np.stack([p[sure], q[sure]]))
        root = joined(root, *np.concatenate(hits, 1))
    for offset in ahead:
        for _, _, i, j in apart(offset):
            maybe = box_gap(low[i], high[i], low[j], high[j]) <= near
            needed[i[maybe]] = needed[j[maybe]] = True
    tied = lambda of, box: of * np.int64(len(held)) + root[number[cells.cell[box]]]
    own = np.flatnonzero(number[cells.cell[seekers]] >= 0)
    known = np.append(tied(s[core[t]], t[core[t]]), tied(own, seekers[own]))
    rim = never[a] & core[b]
    a, b = a[rim], b[rim]
    needed[b[~np.isin(tied(a, b), known)]] = True
    return needed


class _Tree:
    """Places halved along their wider sides, again and again: nodes are runs of an order, with boxes."""

    LEAF = 8

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        first, last, left, right, stack = [0], [len(x)], [-1], [-1], [0]
        while stack:
            node = stack.pop()
            own = self.order[first[node] : last[node]]
            if len(own) <= self.LEAF:
                continue
            axis, middle = int(np.ptp(x[own], axis=0).argmax()), len(own) // 2
            self.order[first[node] : last[node]] = own[np.argpartition(x[own, axis], middle)]
            for bounds, child in (((first[node], first[node] + middle), left), ((first[node] + middle, last[node]), right)):
                child[node] = len(first)
                first.append(bounds[0])
                last.append(bounds[1])
                left.append(-1)
                right.append(-1)
                stack.append(child[node])
        self.first, self.last, self.left, self.right = map(np.array, (first, last, left, right))
        ordered = x[self.order]
        ordered, ends = np.append(ordered, ordered[-1:], 0), np.stack([self.first, self.last], 1).ravel()
        self.low, self.high = (f.reduceat(ordered, ends)[::2] for f in (np.minimum, np.maximum))


def count_scene(x: np.ndarray, radii, weight: np.ndarray | None = None, asked: np.ndarray | None = None) -> np.ndarray:
    """For each point how many points of the scene (it counts too) lie within each radius: [points, radii]. Pairs of nodes of a tree are judged by their boxes; where
    these don't decide, the larger one is halved, and places are compared only between leaves. Points at one place are one place with a number; a row may stand for `weight` points.
    Where `asked` says which rows need their counts, those of the others are not complete."""
    if not len(x):
        return np.zeros((0, len(radii)), np.int64)
    places, of = np.unique(x, axis=0, return_inverse=True)
    of = of.ravel()
    weight = np.bincount(of, weights=weight).astype(np.int64)
    tree, out = _Tree(places), []
    ordered, held = places[tree.order], weight[tree.order]
    total = np.append(0, np.cumsum(held))
    inside = total[tree.last] - total[tree.first]
    wanted = np.bincount(of, weights=asked, minlength=len(places)) > 0
    wanting = np.append(0, np.cumsum(wanted[tree.order]))
    wanting = wanting[tree.last] > wanting[tree.first]  # nodes with places whose counts are asked for
    size = tree.last - tree.first
    for r in radii:
        stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
        given, found = np.zeros(len(places) + 1, np.int64), np.zeros(len(places), np.int64)
        while stack:
            a, b = stack.pop()
            if len(a) > PAIRS:  # the deeper ones first, so that there are never many
                stack += [(a[PAIRS:], b[PAIRS:])]
                a, b = a[:PAIRS], b[:PAIRS]
            sure = box_span(tree.low[a], tree.high[a], tree.low[b], tree.high[b]) <= r * r * (1 - SLACK)
            for p, q in ((a[sure], b[sure]), (b[sure & (a != b)], a[sure & (a != b)])):
                np.add.at(given, tree.first[p], inside[q])
                np.add.at(given, tree.last[p], -inside[q])
            rim = ~sure & (wanting[a] | wanting[b]) & (box_gap(tree.low[a], tree.high[a], tree.low[b], tree.high[b]) <= r * r * (1 + SLACK))
            a, b = a[rim], b[rim]
            leaves = (tree.left[a] < 0) & (tree.left[b] < 0)
            p, q = a[leaves], b[leaves]
            for pair, i, j in products(size[p], size[q]):
                i, j = tree.first[p[pair]] + i, tree.first[q[pair]] + j
                close = squared(ordered[i] - ordered[j]) <= r * r
                np.add.at(found, i[close], held[j[close]])
                other = close & (p[pair] != q[pair])
                np.add.at(found, j[other], held[i[other]])
            a, b = a[~leaves], b[~leaves]
            same = a == b
            wide = (size[a] >= size[b]) & (tree.left[a] >= 0) | (tree.left[b] < 0)
            one, two, own = ~same & wide, ~same & ~wide, a[same]
            parts = [(tree.left[a[one]], b[one]), (tree.right[a[one]], b[one]), (a[two], tree.left[b[two]]), (a[two], tree.right[b[two]])]
            parts += [(tree.left[own], tree.left[own]), (tree.left[own], tree.right[own]), (tree.right[own], tree.right[own])]
            a, b = (np.concatenate(c) for c in zip(*parts))
            if len(a):
                stack.append((a, b))
        counts = np.empty(len(places), np.int64)
        counts[tree.order] = found + np.cumsum(given)[:-1]
        out.append(counts[of])
    return np.stack(out, 1)
