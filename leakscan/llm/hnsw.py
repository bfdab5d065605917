"""Navigable small-world graphs in layers, searched many queries at a time.

A layer holds the nodes of the one above it and more.  A search starts at the
top, finds the nearest node of each layer and takes it as the entry to the next
one; on the lowest layer a beam of nodes is widened by the neighbours of its
best unexpanded member until every member is expanded.  Queries advance in
step, so that each step is a handful of array operations.
"""

from __future__ import annotations

import numpy as np

LINKS = 12  # chosen for a new node
KEPT = 24  # of a node that has gathered too many
ROOM = 48
BATCH = 512
BUILD_BEAM = 48
VISITED_BYTES = 64 << 20


class Layer:
    """Nodes 0 to n of ``x`` (unit rows) in insertion order, with their links (-1: none)."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.links = np.full((len(x), ROOM), -1, np.int32)
        self.degree = np.zeros(len(x), np.int32)
        self.size = 0

    def search(self, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query up to ``beam`` nodes (-1: none) and their cosines, best first."""
        step = max(1, min(1024, VISITED_BYTES // max(1, self.size)))
        parts = [self._search(queries[k : k + step], entry[k : k + step], beam) for k in range(0, len(queries), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(queries)
        every = np.arange(n)
        node = np.full((n, beam), -1, np.int32)
        near = np.full((n, beam), -np.inf, np.float32)
        todo = np.zeros((n, beam), bool)
        seen = np.zeros((n, self.size), bool)
        node[:, 0], near[:, 0], todo[:, 0] = entry, np.einsum("nd,nd->n", self.x[entry], queries), True
        seen[every, entry] = True
        active = every
        while len(active):
            best = np.where(todo[active], near[active], -np.inf).argmax(axis=1)
            todo[active, best] = False
            linked = self.links[node[active, best]]
            i, j = np.nonzero((linked >= 0) & ~seen[active[:, None], linked])
            found, row = linked[i, j], active[i]
            seen[row, found] = True
            cosine = np.full(linked.shape, -np.inf, np.float32)
            cosine[i, j] = np.einsum("nd,nd->n", self.x[found], queries[row])
            wide_near = np.concatenate([near[active], cosine], axis=1)
            top = np.argpartition(-wide_near, beam - 1, axis=1)[:, :beam]
            near[active] = np.take_along_axis(wide_near, top, 1)
            node[active] = np.take_along_axis(np.concatenate([node[active], linked], axis=1), top, 1)
            todo[active] = np.take_along_axis(np.concatenate([todo[active], np.isfinite(cosine)], axis=1), top, 1)
            active = active[todo[active].any(axis=1)]
        node[~np.isfinite(near)] = -1
        order = np.argsort(-near, axis=1, kind="stable")
        return np.take_along_axis(node, order, 1), np.take_along_axis(near, order, 1)

    def insert(self, count: int, entry: np.ndarray) -> None:
        """Add the next ``count`` nodes; ``entry`` has a node already added for each, while there is any."""
        a, b = self.size, self.size + count
        fresh = self.x[a:b]
        among = fresh @ fresh.T
        np.fill_diagonal(among, -np.inf)
        width = min(BUILD_BEAM, count)
        top = np.argpartition(-among, width - 1, axis=1)[:, :width]
        node, near = (top + a).astype(np.int32), np.take_along_axis(among, top, 1)
        if a:
            old_node, old_near = self.search(fresh, entry, BUILD_BEAM)
            node, near = np.concatenate([old_node, node], axis=1), np.concatenate([old_near, near], axis=1)
        node[~np.isfinite(near)] = -1
        self.size = b
        self.links[a:b, :LINKS] = self._diverse(node, near, LINKS)
        self.degree[a:b] = (self.links[a:b] >= 0).sum(axis=1)
        # The other way: nodes chosen get a link back, and are thinned when they run out of room.
        i, j = np.nonzero(self.links[a:b, :LINKS] >= 0)
        to, back = self.links[a:b][i, j], (i + a).astype(np.int32)
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        while len(to):
            first = np.concatenate([[True], to[1:] != to[:-1]])
            now, new = to[first], back[first]
            to, back = to[~first], back[~first]
            known = (self.links[now] == new[:, None]).any(axis=1)
            now, new = now[~known], new[~known]
            full = now[self.degree[now] >= ROOM]
            if len(full):
                self._thin(full)
            self.links[now, self.degree[now]] = new
            self.degree[now] += 1

    def _thin(self, nodes: np.ndarray) -> None:
        linked = self.links[nodes]
        near = np.einsum("nkd,nd->nk", self.x[linked], self.x[nodes])
        self.links[nodes] = -1
        self.links[nodes, :KEPT] = self._diverse(linked, near, KEPT)
        self.degree[nodes] = (self.links[nodes] >= 0).sum(axis=1)

    def _diverse(self, node: np.ndarray, near: np.ndarray, count: int) -> np.ndarray:
        """Per row ``count`` of the candidates: near ones, but first those nearer to the row than to one chosen."""
        order = np.argsort(-near, axis=1, kind="stable")[:, :ROOM]
        node, near = np.take_along_axis(node, order, 1), np.take_along_axis(near, order, 1)
        out = np.full((len(node), count), -1, np.int32)
        taken = np.zeros(len(node), np.int64)
        chosen = np.zeros(node.shape, bool)
        for k in range(node.shape[1]):
            row = np.flatnonzero((taken < count) & (node[:, k] >= 0))
            if not len(row):
                continue
            width = int(taken[row].max())
            if width:
                kept = out[row, :width]
                between = np.einsum("nkd,nd->nk", self.x[kept], self.x[node[row, k]])
                row = row[np.where(kept >= 0, between, -np.inf).max(axis=1) < near[row, k]]
            out[row, taken[row]] = node[row, k]
            chosen[row, k] = True
            taken[row] += 1
        # Places left go to the nearest of the rest.
        for k in range(node.shape[1]):
            row = np.flatnonzero((taken < count) & (node[:, k] >= 0) & ~chosen[:, k])
            out[row, taken[row]] = node[row, k]
            taken[row] += 1
        return out


class Graph:
    """An index of unit rows."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        draw = np.random.default_rng(seed).random(len(x))
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int)
        self.order = np.argsort(-level, kind="stable")  # place in the graph -> row of x
        self.x = np.ascontiguousarray(x[self.order], np.float32)
        sizes = [int((level >= k).sum()) for k in range(level.max(initial=0), -1, -1)]
        self.layers: list[Layer] = []
        for size in sizes:
            layer = Layer(self.x[:size])
            while layer.size < size:
                count = min(BATCH, size - layer.size)
                entry = self._entry(layer.x[layer.size : layer.size + count], layer.size)
                layer.insert(count, entry)
            self.layers.append(layer)

    def _entry(self, queries: np.ndarray, below: int) -> np.ndarray:
        """The nearest node found in the layers above, or the first one if that isn't below ``below``."""
        entry = np.zeros(len(queries), np.int64)
        for layer in self.layers:
            entry = layer.search(queries, entry, 1)[0][:, 0].astype(np.int64)
        return np.where(entry < below, entry, 0)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query up to ``beam`` rows of x (-1: none) and their cosines, best first."""
        bottom = self.layers[-1]
        entry = np.zeros(len(queries), np.int64)
        for layer in self.layers[:-1]:
            entry = layer.search(queries, entry, 1)[0][:, 0].astype(np.int64)
        node, near = bottom.search(queries, entry, min(beam, bottom.size))
        return np.where(node >= 0, self.order[node], -1), near
