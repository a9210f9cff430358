"""Proximity graphs over unit vectors in numpy: pruned directed graphs, small worlds of several levels, beam search.

All functions work on many queries at once. Nearness is the inner product of unit vectors. A graph is an array with the
neighbours of each node, padded with -1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Queries that are searched at a time, and nodes that are compared with them at a time.
TOGETHER, CHUNK = 256, 8192


class Visits:
    """Which nodes each query of a search has come to: a stamp for each query and node. A new search raises the stamp that
    counts, so nothing is cleared, and a step costs what it reads and not the size of the graph."""

    def __init__(self, nodes: int, queries: int = TOGETHER):
        self.nodes, self.now, self.floor = nodes, 0, 0
        self.stamps = np.zeros(nodes * queries, np.int32)

    def begin(self) -> None:
        if self.now > 2**30:
            self.stamps[:] = self.now = 0
        self.floor = self.now

    def fresh(self, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Places of the pairs that are seen for the first time, each pair once; they are marked."""
        flat = rows * self.nodes + nodes
        at = np.flatnonzero(self.stamps[flat] <= self.floor)
        flat = flat[at]
        stamp = np.arange(self.now + 1, self.now + 1 + len(flat), dtype=np.int32)
        self.stamps[flat] = stamp
        self.now += len(flat)
        return at[self.stamps[flat] == stamp]


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, spread: int = 4, visits: Visits | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The width nearest nodes that a beam search finds for each query, nearest first: node numbers (-1: none) and inner
    products. entry gives start nodes for each query, (queries, entries). In each step every query opens the spread best
    nodes of its beam that it has not opened yet; it ends when there are none."""
    q = len(queries)
    ids = np.full((q, width), -1, np.int64)
    near = np.full((q, width), -np.inf, np.float32)
    opened = np.ones((q, width), bool)
    visits = visits or Visits(len(x), q)
    visits.begin()

    def add(rows: np.ndarray, nodes: np.ndarray) -> None:
        """Puts nodes (len(rows), k), -1 for none, into the beams of rows."""
        flat_r, flat_n = np.repeat(rows, nodes.shape[1]), nodes.ravel()
        at = np.flatnonzero(flat_n >= 0)
        at = at[visits.fresh(flat_r[at], flat_n[at])]
        d = np.einsum("ij,ij->i", queries[flat_r[at]], x[flat_n[at]])
        better = d > near[flat_r[at], -1]
        at, d = at[better], d[better]
        if not len(at):
            return
        r, v = flat_r[at], flat_n[at]
        start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        some, count = r[start], np.diff(np.append(start, len(r)))
        k = int(count.max())
        col = np.arange(len(r)) - np.repeat(start, count)
        new_ids, new_near = np.full((len(some), k), -1, np.int64), np.full((len(some), k), -np.inf, np.float32)
        row = np.repeat(np.arange(len(some)), count)
        new_ids[row, col], new_near[row, col] = v, d
        all_near = np.concatenate([near[some], new_near], axis=1)
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
        near[some] = np.take_along_axis(all_near, best, 1)
        ids[some] = np.take_along_axis(np.concatenate([ids[some], new_ids], axis=1), best, 1)
        opened[some] = np.take_along_axis(np.concatenate([opened[some], new_ids < 0], axis=1), best, 1)

    add(np.arange(q), entry)
    live = np.arange(q)
    while len(live):
        closed = ~opened[live]
        some = closed.any(axis=1)
        live, closed = live[some], closed[some]
        if not len(live):
            break
        order = np.argsort(~closed, axis=1, kind="stable")[:, :spread]
        pick = np.take_along_axis(ids[live], order, 1)
        pick[~np.take_along_axis(closed, order, 1)] = -1
        opened[live[:, None], order] = True
        nodes = np.where(pick[:, :, None] >= 0, graph[pick], -1).reshape(len(live), -1)
        add(live, nodes)
    return ids, near


def prune(x: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: for each node of of, up to degree of its candidates (rows padded with -1), the nearest first; a
    kept one drops every candidate to which it is nearer, alpha times, than the node is, by squared distance."""
    b, c = candidates.shape
    candidates = np.where(candidates == of[:, None], -1, candidates)
    d = np.where(candidates >= 0, 2 - 2 * np.einsum("bd,bcd->bc", x[of], x[candidates]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    twice = np.zeros_like(candidates, bool)
    twice[:, 1:] = (candidates[:, 1:] == candidates[:, :-1]) & (candidates[:, 1:] >= 0)
    v = x[candidates]
    between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    between *= alpha * alpha
    open_ = (candidates >= 0) & ~twice
    kept = np.full((b, degree), -1, np.int64)
    count, live = np.zeros(b, np.int64), np.arange(b)
    for _ in range(degree):
        first = open_.argmax(axis=1)
        has = open_[np.arange(len(live)), first]
        if not has.all():
            live, first, open_, between, d = live[has], first[has], open_[has], between[has], d[has]
            if not len(live):
                break
        rows = np.arange(len(live))
        kept[live, count[live]] = candidates[live, first]
        count[live] += 1
        open_ &= between[rows, first] > d
        open_[rows, first] = False
    return kept


def build(x: np.ndarray, degree: int, width: int, alpha: float, rounds: tuple[float, ...] | None = None, seed: int = 0) -> tuple[np.ndarray, int]:
    """A pruned directed graph and its entry node, the one nearest the mean. Nodes are inserted in a random order in
    growing batches: greedy beam searches from the entry propose neighbours, prune() keeps diverse ones, and edges back
    are added, pruned where a node gets more than degree. Each round goes over all nodes, with its own alpha."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    entry = int(np.argmax(x @ x.mean(axis=0)))
    visits, order = Visits(n), np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    for k, a in enumerate(rounds or (alpha,)):
        at, batch = (1, 1) if k == 0 else (0, TOGETHER)
        while at < n:
            of = order[at : at + batch]
            found, _ = beam_search(x, graph, x[of], np.full((len(of), 1), entry), width, visits=visits)
            graph[of] = prune(x, of, np.concatenate([found, graph[of]], axis=1), degree, a)
            src, dst = np.repeat(of, degree), graph[of].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            _back(x, graph, dst, src, degree, a)
            at += len(of)
            batch = min(TOGETHER, max(1, at))
    return graph, entry


def _back(x: np.ndarray, graph: np.ndarray, node: np.ndarray, new: np.ndarray, degree: int, alpha: float) -> None:
    """Adds edges node -> new."""
    order = np.argsort(node, kind="stable")
    node, new = node[order], new[order]
    some, start, count = np.unique(node, return_index=True, return_counts=True)
    for lo in range(0, len(some), TOGETHER):
        part = slice(lo, lo + TOGETHER)
        k = int(count[part].max())
        extra = np.full((len(some[part]), k), -1, np.int64)
        row = np.repeat(np.arange(len(some[part])), count[part])
        first = start[part][0]
        m = int(count[part].sum())
        col = np.arange(m) - np.repeat(start[part] - first, count[part])
        extra[row, col] = new[first : first + m]
        have = graph[some[part]]
        extra = np.where((extra[:, :, None] == have[:, None, :]).any(axis=2), -1, extra)
        total = (have >= 0).sum(axis=1) + (extra >= 0).sum(axis=1)
        both = np.concatenate([have, extra], axis=1)
        fits = total <= degree
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :degree]
        graph[some[part][fits]] = packed[fits]
        if not fits.all():
            graph[some[part][~fits]] = prune(x, some[part][~fits], both[~fits], degree, alpha)


def repair(x: np.ndarray, graph: np.ndarray, search, most: int = 4) -> np.ndarray:
    """The graph with edges added, in columns of their own, until the search for each node's own vector finds the node:
    pruning can cut a tight group off from the rest. A node that is missed gets an edge from the nearest node found; a
    node gives most of them a round. A node that is still missed after two edges is one of many equal ones, which hold
    the whole beam. search(graph, queries) gives node numbers, nearest first."""
    todo, given = np.arange(len(x)), np.zeros(len(x), np.int64)
    while len(todo):
        found = np.concatenate([search(graph, x[todo[lo : lo + TOGETHER]]) for lo in range(0, len(todo), TOGETHER)])
        missed = ~(found == todo[:, None]).any(axis=1) & (given[todo] < 2)
        todo, host = todo[missed], found[missed, 0]
        if not len(todo):
            break
        order = np.argsort(host, kind="stable")
        _, start, count = np.unique(host[order], return_index=True, return_counts=True)
        nth = np.arange(len(order)) - np.repeat(start, count)
        give = nth < most
        extra = np.full((len(x), int(nth[give].max()) + 1), -1, np.int64)
        extra[host[order][give], nth[give]] = todo[order][give]
        given[todo[order][give]] += 1
        graph = np.concatenate([graph, extra], axis=1)
    return graph


@dataclass
class SmallWorld:
    """A hierarchy of graphs: level 0 has all nodes, each level above a share of the one below. Searches go down from the
    top, and the nearest node of a level is where the next begins."""

    x: np.ndarray
    degree: int = 16
    width: int = 64
    shrink: int = 16
    seed: int = 0
    levels: list[tuple[np.ndarray, np.ndarray, int]] = field(default_factory=list)
    visits: dict[int, Visits] = field(default_factory=dict)

    def build(self) -> SmallWorld:
        n, rng = len(self.x), np.random.default_rng(self.seed)
        nodes = rng.permutation(n)
        while True:
            at = np.sort(nodes)
            graph, entry = build(self.x[at], self.degree * (2 if len(at) == n else 1), self.width, 1.0, seed=self.seed)
            self.levels.append((at, graph, entry))
            if len(nodes) <= 2 * self.shrink:
                break
            nodes = nodes[: len(nodes) // self.shrink]

        at, graph, entry = self.levels[0]

        def search(graph: np.ndarray, queries: np.ndarray) -> np.ndarray:
            self.levels[0] = (at, graph, entry)
            return self.search(queries, self.width // 2)[0]

        self.levels[0] = (at, repair(self.x, graph, search), entry)
        return self

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        start = None
        for at, graph, entry in reversed(self.levels):
            begin = np.full((len(queries), 1), entry) if start is None else np.stack([np.full(len(queries), entry), np.searchsorted(at, start)], axis=1)
            base = len(at) == len(self.x)
            marks = self.visits.setdefault(len(at), Visits(len(at)))
            ids, near = beam_search(self.x if base else self.x[at], graph, queries, begin, width if base else 4, visits=marks)
            start = at[ids[:, 0]]
        return ids, near

    def _both_ways(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges of level 0 in both directions: ends[starts[v]:starts[v + 1]] are the neighbours of v."""
        graph = self.levels[0][1]
        a, b = np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()
        a, b = a[b >= 0], b[b >= 0]
        code = np.unique(np.concatenate([a * len(graph) + b, b * len(graph) + a]))
        return np.searchsorted(code, np.arange(len(graph) + 1) * len(graph)), code % len(graph)

    def near_ones(self, queries: np.ndarray, least: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Groups (queries, nodes), as numbers, such that every query of a group has all its near nodes that are found in
        the group: near ones have an inner product of least or more. Each query beam-searches for itself. Queries that
        find near nodes are put in order of the components of what they find, TOGETHER at a time; such a slice also
        follows the edges of level 0, either way, from every node that is near one of its queries. A query that finds
        nothing near is in no group."""
        found_q, found_v = [], []
        for lo in range(0, len(queries), TOGETHER):
            ids, near = self.search(queries[lo : lo + TOGETHER], width)
            q, c = np.nonzero(near >= least)
            found_q.append(q + lo)
            found_v.append(ids[q, c])
        q, v = np.concatenate(found_q or [np.zeros(0, np.int64)]), np.concatenate(found_v or [np.zeros(0, np.int64)])
        if not len(q):
            return
        label = np.full(len(queries), -1)
        node, root = forest(q, v + len(queries))
        label[node[node < len(queries)]] = root[node < len(queries)]
        hit = np.unique(q)
        label[hit] = np.where(label[hit] < 0, hit, label[hit])
        hit = hit[np.argsort(label[hit], kind="stable")]
        by = np.argsort(q, kind="stable")
        q, v = q[by], v[by]
        starts, ends = self._both_ways()
        known = np.zeros(len(self.x), np.int64)
        for nth, lo in enumerate(range(0, len(hit), TOGETHER), 1):
            part = hit[lo : lo + TOGETHER]
            i, j = np.searchsorted(q, part), np.searchsorted(q, part, "right")
            front = np.unique(v[np.repeat(i - (np.cumsum(j - i) - (j - i)), j - i) + np.arange((j - i).sum())])
            group, mine = [front], queries[part]
            known[front] = nth
            while len(front):
                n = starts[front + 1] - starts[front]
                to = ends[np.repeat(starts[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                to = np.unique(to[known[to] != nth])
                known[to] = nth
                good = [(self.x[to[k : k + CHUNK]] @ mine.T).max(axis=1) >= least for k in range(0, len(to), CHUNK)]
                front = to[np.concatenate(good)] if good else to
                group.append(front)
            yield part, np.concatenate(group)

    def within(self, queries: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of near_ones() with an inner product of least or more."""
        found = [np.nonzero(queries[part] @ self.x[group].T >= least) + (part, group) for part, group in self.near_ones(queries, least, width)]
        pairs = [(part[i], group[j]) for i, j, part, group in found] or [(np.zeros(0, np.int64),) * 2]
        return tuple(map(np.concatenate, zip(*pairs, strict=True)))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, label): stars over the components of the pairs, to the smallest node of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def linked_groups(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) pairs that join what the true cells of a matrix join: at most one for each row and each column."""
    rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    m = linked[np.ix_(rows, cols)]
    # a row's first column, and a column's first row, join all but the components that meet in neither
    a, b = np.concatenate([np.arange(len(rows)), m.argmax(axis=0) if len(cols) else cols]), np.concatenate([m.argmax(axis=1) if len(rows) else rows, np.arange(len(cols))])
    more_a, more_b = [a], [b]
    while len(rows):
        node, root = forest(np.concatenate(more_a), np.concatenate(more_b) + len(rows))
        label = np.arange(len(rows) + len(cols))
        label[node] = root
        apart = m & (label[: len(rows), None] != label[None, len(rows) :])
        if not apart.any():
            break
        r = np.flatnonzero(apart.any(axis=1))
        more_a.append(r)
        more_b.append(apart[r].argmax(axis=1))
    a, b = np.concatenate(more_a), np.concatenate(more_b)
    return rows[a], cols[b]
