"""Breadth-first search from many nodes of one small graph at once, on integer arrays.

The result is a predecessor graph in disguise: depths and numbers of tied shortest
paths. A node's predecessors towards a source are its neighbours one level nearer,
so a path, or all tied ones, are listed only for the pairs that ask for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Cells (sources times nodes) that are searched at once.
CELLS = 1 << 22
#: Neighbours of a node that is taken away, at most.
MOST = 4
#: Nodes of a graph that is worth taking apart, at least, and cells of what is left of it, at most.
SMALL, HELD = 24, 1 << 24
#: Graphs whose figures are kept.
KNOWN = 1 << 14
#: Stands for no way in tables of distances.
FAR = 1 << 14


class Graph:
    """Nodes 0 .. n - 1 and their distinct neighbours in ascending order; no node is its own neighbour."""

    def __init__(self, n: int, start: np.ndarray, end: np.ndarray, directed: bool = False):
        start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
        if not directed:
            start, end = np.concatenate([start, end]), np.concatenate([end, start])
        key = np.sort((start * n + end)[start != end])
        key = key[np.diff(key, prepend=-1) != 0]
        self.n, self.near = n, key % n
        self.first = np.searchsorted(key, np.arange(n + 1) * n)

    def neighbours(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of nodes, and for each the place in ``at`` that it is of."""
        size = self.first[at + 1] - self.first[at]
        of = np.repeat(np.arange(len(at)), size)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        return self.near[self.first[at][of] + inside], of

    def search(self, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each source a row: depth of each node, -1 where there is no way, and its number of tied shortest paths.

        Numbers are exact up to 2 ** 53, the nearest double beyond.
        """
        sources = np.asarray(sources, np.int64)
        depth = np.full((len(sources), self.n), -1, np.int32)
        ties = np.zeros((len(sources), self.n))
        key, count, level = np.arange(len(sources)) * self.n + sources, np.ones(len(sources)), 0
        while len(key):
            depth.ravel()[key], ties.ravel()[key] = level, count
            row, at = np.divmod(key, self.n)
            found, of = self.neighbours(at)
            found = row[of] * self.n + found
            new = depth.ravel()[found] < 0
            found, weight = found[new], count[of][new]
            order = np.argsort(found, kind="stable")
            found, weight = found[order], weight[order]
            opens = np.flatnonzero(np.diff(found, prepend=-1))
            key, count, level = found[opens], np.add.reduceat(weight, opens) if len(opens) else weight, level + 1
        return depth, ties

    def searches(self, sources: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Sources in blocks of bounded size, each with its ``search``."""
        step = max(1, CELLS // max(self.n, 1))
        for lo in range(0, len(sources), step):
            yield sources[lo : lo + step], *self.search(sources[lo : lo + step])

    def each_search(self, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``searches`` from all nodes of many graphs side by side: (source, node, depth, ties) of every connected pair source < node.

        The graphs have ``size`` nodes each, one after the other. A source has
        cells for the nodes of its own graph alone, and the sources of a block
        ``CELLS`` of them, or one source; all graphs of a block are searched at once.
        """
        first, width = np.repeat(np.cumsum(size) - size, size), np.repeat(size, size)
        ends, lo = np.cumsum(width), 0
        while lo < self.n:
            hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, "right")), lo + 1)
            sources = np.arange(lo, hi)
            base = np.cumsum(width[lo:hi]) - width[lo:hi] - first[lo:hi]
            depth, ties = np.full(int(width[lo:hi].sum()), -1, np.int32), np.zeros(int(width[lo:hi].sum()))
            row, at, count, level = np.arange(hi - lo), sources, np.ones(hi - lo), 0
            while len(at):
                depth[base[row] + at], ties[base[row] + at] = level, count
                found, of = self.neighbours(at)
                cell = base[row[of]] + found
                new = np.flatnonzero(depth[cell] < 0)
                new = new[np.argsort(cell[new], kind="stable")]
                opens = np.flatnonzero(np.diff(cell[new], prepend=-1))
                weight = count[of[new]]
                row, at, count, level = row[of[new[opens]]], found[new[opens]], np.add.reduceat(weight, opens) if len(opens) else weight, level + 1
            row = np.repeat(np.arange(hi - lo), width[lo:hi])
            node = np.arange(len(depth)) - base[row]
            some = np.flatnonzero((depth > 0) & (node > sources[row]))
            yield sources[row[some]], node[some], depth[some], ties[some]
            lo = hi

    def taken_apart(self) -> tuple[np.ndarray, np.ndarray]:
        """The round in which each node is taken away, -1 for those that stay, and its neighbours at that time, -1 where it has less than ``MOST``.

        A node goes if its neighbours are neighbours of each other: no shortest
        path between others needs it. Nodes of one round are no neighbours.
        """
        start = np.repeat(np.arange(self.n), np.diff(self.first))
        end, key = self.near, start * self.n + self.near
        rounds, near = np.full(self.n, -1, np.int32), np.full((self.n, MOST), -1, np.int64)
        alive, now = np.arange(self.n), 0
        while len(alive):
            degree = np.bincount(start, minlength=self.n)
            some = alive[degree[alive] <= MOST]
            mine = np.zeros(self.n, bool)
            mine[some] = True
            edge = np.flatnonzero(mine[start])
            place = np.arange(len(edge)) - np.repeat(np.flatnonzero(np.diff(start[edge], prepend=-1)), degree[some][degree[some] > 0])
            near[some] = -1
            near[start[edge], place] = end[edge]
            for j in range(MOST):
                for k in range(j + 1, MOST):
                    both = some[degree[some] > k]
                    asked = near[both, j] * self.n + near[both, k]
                    mine[both[key[np.minimum(np.searchsorted(key, asked), len(key) - 1)] != asked]] = False
            clash = edge[mine[start[edge]] & mine[end[edge]] & (end[edge] > start[edge])]
            mine[start[clash]] = False
            some = some[mine[some]]
            if not len(some):
                break
            rounds[some], now = now, now + 1
            kept = ~(mine[start] | mine[end])
            start, end, alive = start[kept], end[kept], alive[~mine[alive]]
        near[rounds < 0] = -1
        return rounds, near

    def totals(self, size: np.ndarray, known: dict[bytes, np.ndarray] | None = None) -> np.ndarray:
        """Of graphs side by side, of ``size`` nodes each: the number of connected pairs, the sums of their depths, the deepest, and the sums of their ties.

        Rows of the four figures. Equal graphs are looked at once; ``known`` holds
        the figures of ``KNOWN`` of them from one call to the next. Graphs that can
        be taken apart aren't searched but put together again, a round of nodes at
        once; the others are searched.
        """
        size = np.asarray(size, np.int64)
        known = {} if known is None else known
        out, first = np.zeros((4, len(size)), np.int64), np.cumsum(size) - size
        degree, inner = np.diff(self.first), self.near - np.repeat(np.repeat(first, size), np.diff(self.first))
        new: dict[bytes, list[int]] = {}
        for i, (lo, n) in enumerate(zip(first.tolist(), size.tolist(), strict=True)):
            same = hashlib.sha256(degree[lo : lo + n].tobytes() + inner[self.first[lo] : self.first[lo + n]].tobytes()).digest()
            if same in known:
                out[:, i] = known[same]
            else:
                new.setdefault(same, []).append(i)
        one = np.array([x[0] for x in new.values()], np.int64)
        some = self._part(np.flatnonzero(np.isin(np.repeat(np.arange(len(size)), size), one)))
        order = np.sort(one)
        found = some._totals(size[order])
        for same, equal in new.items():
            sums = found[:, np.searchsorted(order, equal[0])]
            out[:, equal] = sums[:, None]
            if len(known) < KNOWN:
                known[same] = sums
        return out

    def _totals(self, size: np.ndarray) -> np.ndarray:
        out = np.zeros((4, len(size)), np.int64)
        owner, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        apart = size >= SMALL
        if apart.any():
            rounds, near = self.taken_apart()
            left = size - np.bincount(owner[rounds == 0], minlength=len(size))
            stay = np.bincount(owner[rounds < 0], minlength=len(size))
            apart &= (left**2 <= HELD) & (size < FAR) & (stay * 2 <= size)
            for i in np.flatnonzero(apart):
                mine = slice(first[i], first[i] + size[i])
                out[:, i] = self._together(rounds[mine], near[mine], int(first[i]))
        rest = np.flatnonzero(~apart)
        part, of = self._part(np.flatnonzero(~apart[owner])), np.repeat(np.arange(len(rest)), size[rest])
        for source, _, depth, ties in part.each_search(size[rest]):
            opens = np.flatnonzero(np.diff(of[source], prepend=-1))
            if len(opens):
                at = rest[of[source[opens]]]  # a graph may go on in the next block
                out[0, at] += np.diff(opens, append=len(source))
                out[1, at] += np.add.reduceat(depth.astype(np.int64), opens)
                out[2, at] = np.maximum(out[2, at], np.maximum.reduceat(depth, opens))
                out[3, at] += np.add.reduceat(counts(ties), opens)
        return out

    def _part(self, nodes: np.ndarray) -> Graph:
        """The graph of some nodes, in their order."""
        place = np.full(self.n, -1, np.int64)
        place[nodes] = np.arange(len(nodes))
        found, of = self.neighbours(nodes)
        inside = place[found] >= 0
        return Graph(len(nodes), of[inside], place[found[inside]])

    def _together(self, rounds: np.ndarray, near: np.ndarray, first: int) -> np.ndarray:
        """The figures of ``totals`` of one graph, the nodes of which begin at ``first``; ``HELD`` cells are held at most.

        A node's row of distances is that of its nearest neighbour, and one more.
        Nodes of the first round are in no other's way: equal ones are counted
        once with their number, and their rows aren't kept.
        """
        order = np.argsort(np.where(rounds < 0, np.iinfo(np.int32).max, rounds), kind="stable")[::-1]
        ends = np.flatnonzero(np.diff(rounds[order], append=-2)) + 1
        last = int((rounds != 0).sum())
        place = np.empty(len(order) + 1, np.int64)
        place[order], place[-1] = np.arange(len(order)), last  # row ``last`` leads nowhere
        near = place[np.where(near < 0, len(order), near - first)][order]
        far, ways = np.full((last + 1, last), FAR, np.int16), np.zeros((last + 1, last))
        lo = int((rounds < 0).sum())
        if lo:
            core = self._part(first + order[:lo])
            for sources, depth, ties in core.searches(np.arange(lo)):
                far[sources, :lo], ways[sources, :lo] = np.where(depth < 0, FAR, depth), ties
        for hi in ends[(ends > lo) & (ends <= last)].tolist():
            far[lo:hi, :lo], ways[lo:hi, :lo] = _rows(near[lo:hi], far[:, :lo], ways[:, :lo])
            far[:lo, lo:hi], ways[:lo, lo:hi] = far[lo:hi, :lo].T, ways[lo:hi, :lo].T
            far[lo:hi, lo:hi], ways[lo:hi, lo:hi] = _rows(near[lo:hi], far[:, lo:hi], ways[:, lo:hi])
            far[np.arange(lo, hi), np.arange(lo, hi)], ways[np.arange(lo, hi), np.arange(lo, hi)] = 0, 1
            lo = hi
        total = _Total()
        ones, step = np.ones(last), max(1, CELLS // max(len(order), 1))
        for k in range(0, last, step):
            total.add(far[k : min(k + step, last)], ways[k : min(k + step, last)], ones[k : k + step], ones, k)
        leaves = np.sort(near[last:], axis=1)
        leaves, number = np.unique(leaves, axis=0, return_counts=True)
        degree = (leaves < last).sum(axis=1)
        twins = np.where(degree > 0, number * (number - 1) // 2, 0)
        if twins.any():
            total.sums += [twins.sum(), 2 * twins.sum(), 0, (twins * degree).sum()]
            total.sums[2] = max(total.sums[2], 2)
        blocks = [slice(k, min(k + step, len(leaves))) for k in range(0, len(leaves), step)]
        for w in blocks:
            depth, ties = _rows(leaves[w], far, ways)
            total.add(depth, ties, number[w].astype(float), ones)
            up, up_ways = np.full((last + 1, depth.shape[0]), FAR, np.int16), np.zeros((last + 1, depth.shape[0]))
            up[:last], up_ways[:last] = depth.T, ties.T
            for v in blocks:
                if v.start >= w.start:
                    total.add(*_rows(leaves[v], up, up_ways), number[v].astype(float), number[w].astype(float), 0 if v == w else None)
        return total.sums

    def first_paths(self, depth: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first shortest path from each of ``start`` to the source of its ``row`` of depths, by its places: its nodes, and where each begins.

        Of an undirected graph; every start must reach its source.
        """
        return self._first_paths(depth.ravel(), np.asarray(row, np.int64) * self.n, np.asarray(start, np.int64))

    def _first_paths(self, depth: np.ndarray, base: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``first_paths``; the depth of a node is that in its place behind ``base``."""
        left = depth[base + start].astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(left + 1)])
        nodes = np.empty(offsets[-1], np.int64)
        open_, at, step = np.arange(len(start)), np.array(start, np.int64), 0
        nodes[offsets[:-1]] = at
        while len(open_ := open_[left[open_] > step]):
            found, of = self.neighbours(at[open_])
            nearer = depth[base[open_][of] + found] == (left[open_] - step - 1)[of]
            found, of = found[nearer], of[nearer]
            at[open_] = found[np.flatnonzero(np.diff(of, prepend=-1))]
            step += 1
            nodes[offsets[open_] + step] = at[open_]
        return nodes, offsets

    def asked_paths(self, size: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For graphs side by side of ``size`` nodes each: which of the stated pairs are connected, the nodes of their ``first_paths``, and where each begins.

        In blocks of bounded size, sorted by ``end``. A search from an end stops
        when it has met all its starts; nodes are connected with themselves by no path.
        """
        first, width = np.repeat(np.cumsum(size) - size, size), np.repeat(size, size)
        sources, row = np.unique(end, return_inverse=True)
        order = np.argsort(row, kind="stable")
        cuts, ends, lo = np.searchsorted(row[order], np.arange(len(sources) + 1)), np.cumsum(width[sources]), 0
        while lo < len(sources):
            hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, "right")), lo + 1)
            mine, some = order[cuts[lo] : cuts[hi]], sources[lo:hi]
            base = np.cumsum(width[some]) - width[some] - first[some]
            depth = np.full(int(width[some].sum()), -1, np.int32)
            cell, of_row = base[row[mine] - lo] + start[mine], row[mine] - lo
            at_row, at, level = np.arange(hi - lo), some, 0
            while len(at):
                depth[base[at_row] + at] = level
                asking = np.zeros(hi - lo, bool)
                asking[of_row[depth[cell] < 0]] = True
                fine = asking[at_row]
                at_row, at, level = at_row[fine], at[fine], level + 1
                found, of = self.neighbours(at)
                key = base[at_row[of]] + found
                new = np.flatnonzero(depth[key] < 0)
                new = new[np.unique(key[new], return_index=True)[1]]
                at_row, at = at_row[of[new]], found[new]
            near = depth[cell] > 0
            mine = mine[near]
            yield mine, *self._first_paths(depth, base[of_row[near]], start[mine])
            lo = hi

    def tied_paths(self, depth: np.ndarray, start: int) -> Iterator[list[int]]:
        """All shortest paths from ``start`` to the source of this row of depths, in the order of their places, one at a time."""
        stack = [[start]] if depth[start] >= 0 else []
        while stack:
            path = stack.pop()
            if depth[path[-1]] == 0:
                yield path
                continue
            near = self.near[self.first[path[-1]] : self.first[path[-1] + 1]]
            stack += [[*path, int(v)] for v in near[::-1] if depth[v] == depth[path[-1]] - 1]


def _rows(near: np.ndarray, far: np.ndarray, ways: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ties of nodes from those of their neighbours."""
    used = max(1, int((near < len(far) - 1).sum(axis=1).max(initial=0)))
    near = near if used == near.shape[1] else np.sort(near, axis=1)[:, :used]
    each = [far[near[:, j]] for j in range(used)]
    best = each[0] if used == 1 else np.minimum(each[0], each[1])
    for d in each[2:]:
        np.minimum(best, d, out=best)
    ties = ways[near[:, 0]]
    if used > 1:
        ties *= each[0] == best
        for j in range(1, used):
            more = ways[near[:, j]]
            more *= each[j] == best
            ties += more
    return np.minimum(best + np.int16(1), np.int16(FAR)), ties


class _Total:
    """Sums over pairs of nodes."""

    def __init__(self):
        self.sums = np.zeros(4, np.int64)

    def add(self, depth: np.ndarray, ties: np.ndarray, rows: np.ndarray, columns: np.ndarray, at: int | None = None) -> None:
        """Cells of a table, counted as often as ``rows`` and ``columns`` say; with ``at`` only those left of the diagonal, which begins in that column."""
        if not depth.size:
            return
        if at is not None:
            left = np.tri(*depth.shape, at - 1, dtype=bool)
            depth, ties = np.where(left, depth, np.int16(FAR)), np.where(left, ties, 0.0)
        near = depth < FAR
        depth = depth * near
        weighed = lambda x: int(round(float(rows @ (x @ columns))))
        n, length = weighed(near.astype(float)), weighed(depth.astype(float))
        if ties.max(initial=0.0) * rows.sum() * columns.sum() < 2.0**53:
            sums = weighed(ties)
        else:
            with np.errstate(over="ignore"):
                sums = int((rows.astype(np.int64) * (counts(ties) * columns.astype(np.int64)).sum(axis=1)).sum())
        longest = max(int(self.sums[2]), int(depth.max(initial=0)))
        self.sums += [n, length, 0, sums]
        self.sums[2] = longest


def counts(ties: np.ndarray) -> np.ndarray:
    """Numbers of paths as integers, 2 ** 62 at most."""
    return np.minimum(ties, 2.0**62).astype(np.int64)
