"""Hierarchical navigable small-world graphs in flat neighbour arrays.

Nearness is the largest inner product. Vectors get one more component, which makes all equally
long, so that nearest by angle is nearest by inner product and the graph's usual pruning holds.
A layer's graph is made in bulk: each node's nearest CANDIDATES, thinned to those that are nearer
to it than to a kept one, and links back, thinned again where they are too many.

How many nodes a search must keep in view depends on the vectors. So it is doubled until a sample of
the queries at hand, held against all nodes of the graph, finds the wanted share of its nearest.
"""

from __future__ import annotations

import numpy as np

LINKS, BASE_LINKS = 16, 32
CANDIDATES = 64
#: Queries that are searched side by side, and nodes that each expands at once (more where many are kept in view).
SIDE, WIDE = 256, 8
#: Numbers that are multiplied at once.
PIECE = 4_000_000


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row by inner product, nearest first."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        near = x[a : a + 1024] @ x.T
        near[np.arange(len(near)), a + np.arange(len(near))] = -np.inf
        some = np.argpartition(-near, k - 1, axis=1)[:, :k]
        out[a : a + 1024] = np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)
    return out


def _products(x: np.ndarray, rows: np.ndarray, y: np.ndarray, others: np.ndarray) -> np.ndarray:
    """x[rows] times y[others], in pieces of bounded memory."""
    out = np.empty(len(rows), np.result_type(x, y))
    step = max(1, PIECE // max(1, x.shape[1]))
    for a in range(0, len(rows), step):
        out[a : a + step] = np.einsum("md,md->m", x[rows[a : a + step]], y[others[a : a + step]])
    return out


def _thinned(x: np.ndarray, rows: np.ndarray, candidates: np.ndarray, links: int) -> np.ndarray:
    """The candidates of each row, nearest first and -1 where there is none, that stay its neighbours.

    A candidate stays if it is nearer to the row than to any that stayed before it. The nearest of
    the rest fill up what this leaves.
    """
    out = np.full((len(rows), links), -1, np.int64)
    for a in range(0, len(rows), 256):
        own = candidates[a : a + 256]
        c = x[np.maximum(own, 0)]
        mine = np.einsum("bd,bkd->bk", x[rows[a : a + 256]], c)
        among = c @ c.transpose(0, 2, 1)
        kept = np.zeros(own.shape, bool)
        count = np.zeros(len(own), np.int64)
        for j in range(own.shape[1]):
            kept[:, j] = (own[:, j] >= 0) & (count < links) & ~np.any(kept & (among[:, j] > mine[:, j : j + 1]), axis=1)
            count += kept[:, j]
        got = np.take_along_axis(own, np.argsort(np.where(kept, 0, np.where(own >= 0, 1, 2)), axis=1, kind="stable")[:, :links], 1)
        out[a : a + len(own), : got.shape[1]] = got
    return out


def layer(x: np.ndarray, links: int) -> np.ndarray:
    """Neighbours of each row as a rectangle of row numbers, -1 where there is none."""
    n = len(x)
    if n < 2:
        return np.full((n, links), -1, np.int32)
    half = _thinned(x, np.arange(n), _nearest(x, min(CANDIDATES, n - 1)), links // 2)
    # Links hold both ways; a row with too many is thinned again.
    ahead, behind = np.repeat(np.arange(n), half.shape[1])[half.ravel() >= 0], half.ravel()[half.ravel() >= 0]
    both = np.unique(np.concatenate([ahead * n + behind, behind * n + ahead]))
    rows, others = both // n, both % n
    order = np.lexsort((others, -_products(x, rows, x, others), rows))
    rows, others = rows[order], others[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    near = rank < 2 * CANDIDATES
    out = np.full((n, max(links, int(rank[near].max()) + 1)), -1, np.int64)
    out[rows[near], rank[near]] = others[near]
    if out.shape[1] > links:
        full = np.flatnonzero(out[:, links] >= 0)
        out[full, :links] = _thinned(x, full, out[full], links)
    return out[:, :links].astype(np.int32)


class Graph:
    """layers: (members, neighbours) from the base up; neighbours are numbers of vectors."""

    def __init__(self, vectors: np.ndarray, layers):
        self.vectors, self.layers = vectors, layers
        self.small = vectors.astype(np.float32)

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 7) -> "Graph":
        norms = np.einsum("ij,ij->i", vectors, vectors)
        x = np.concatenate([vectors, np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0))[:, None]], 1).astype(np.float32)
        height = (-np.log(1 - np.random.default_rng(seed).random(len(x))) / np.log(LINKS)).astype(int)
        layers = []
        for level in range(int(height.max(initial=0)) + 1):
            members = np.flatnonzero(height >= level)
            own = layer(x[members], LINKS if level else BASE_LINKS)
            layers.append((members.astype(np.int32), np.where(own >= 0, members[own], -1).astype(np.int32)))
        return cls(vectors, layers)

    def flat(self) -> dict[str, bytes | int]:
        sizes = np.array([len(m) for m, _ in self.layers], np.int32)
        return {
            "n": len(self.vectors), "vectors": self.vectors.astype("<f8").tobytes(), "layer_sizes": sizes.tobytes(),
            "members": np.concatenate([m for m, _ in self.layers]).astype("<i4").tobytes(), "neighbours": b"".join(x.astype("<i4").tobytes() for _, x in self.layers),
        }

    @classmethod
    def from_flat(cls, n: int, vectors: bytes, layer_sizes: bytes, members: bytes, neighbours: bytes) -> "Graph":
        sizes = np.frombuffer(layer_sizes, "<i4")
        names = np.split(np.frombuffer(members, "<i4"), np.cumsum(sizes)[:-1])
        widths = [BASE_LINKS, *[LINKS] * (len(sizes) - 1)]
        parts = np.split(np.frombuffer(neighbours, "<i4"), np.cumsum(sizes * widths)[:-1])
        return cls(np.frombuffer(vectors, "<f8").reshape(n, -1), [(m, p.reshape(-1, w)) for m, p, w in zip(names, parts, widths)])

    def search(self, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and inner products of the k nearest found of each query, -1 where there are fewer."""
        n, k_out = len(self.vectors), k
        k, ef = min(k, n), min(max(k, ef), n)
        ids, scores = np.full((len(queries), k_out), -1, np.int64), np.full((len(queries), k_out), -np.inf)
        for a in range(0, len(queries), SIDE):
            q = queries[a : a + SIDE]
            start = np.repeat(self.layers[-1][0][:1][None, :], len(q), 0).astype(np.int64)
            for members, neighbours in self.layers[:0:-1]:
                place = np.full(n, -1, np.int64)
                place[members] = np.arange(len(members))
                start = self._beam(q, start, neighbours, place, min(16, len(members)))
            found = self._beam(q, start, self.layers[0][1], None, ef)
            rows, cols = np.nonzero(found >= 0)
            exact = np.full(found.shape, -np.inf)
            exact[rows, cols] = _products(q, rows, self.vectors, found[rows, cols])
            order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
            ids[a : a + SIDE, :k] = np.take_along_axis(found, order, 1)
            scores[a : a + SIDE, :k] = np.take_along_axis(exact, order, 1)
        return ids, scores

    def enough(self, queries: np.ndarray, k: int, ef: int, recall: float, sample: int) -> int:
        """ef, doubled until a sample of the queries finds this share of its k nearest nodes (equally near ones count)."""
        n = len(self.vectors)
        some = queries[np.linspace(0, len(queries) - 1, min(sample, len(queries))).astype(np.int64)]
        k = min(k, n)
        near = some @ self.vectors.T
        least = np.partition(near, n - k, axis=1)[:, n - k]
        slack = 1e-9 * np.abs(near).max(axis=1, initial=1e-300)
        while ef < n:
            _, scores = self.search(some, k, ef)
            if np.mean(scores >= (least - slack)[:, None]) >= recall:
                break
            ef *= 2
        return min(ef, n)

    def _beam(self, queries, start, neighbours, place, ef: int) -> np.ndarray:
        """The ef nearest that a best-first walk from start finds, nearest first."""
        n, b = len(self.vectors), len(queries)
        q = queries.astype(np.float32)
        seen = np.zeros((b, n), bool)
        pool = np.full((b, ef), -1, np.int64)
        near = np.full((b, ef), -np.inf, np.float32)
        done = np.ones((b, ef), bool)
        wide = max(WIDE, ef // 20)

        def merge(rows, nodes):
            """Each row's new nodes, scored once and put in its pool."""
            flat = np.unique(rows * n + nodes)
            flat = flat[~seen.ravel()[flat]]
            seen.ravel()[flat] = True
            rows, nodes = flat // n, flat % n
            score = _products(self.small, nodes, q, rows)
            keep = score > near[rows, -1]
            rows, nodes, score = rows[keep], nodes[keep], score[keep]
            if not len(rows):
                return
            touched, first, count = np.unique(rows, return_index=True, return_counts=True)
            at, col = np.repeat(np.arange(len(touched)), count), np.arange(len(rows)) - np.repeat(first, count)
            more, more_near = np.full((len(touched), int(count.max())), -1, np.int64), np.full((len(touched), int(count.max())), -np.inf, np.float32)
            more[at, col], more_near[at, col] = nodes, score
            all_near = np.concatenate([near[touched], more_near], 1)
            order = np.argsort(-all_near, axis=1, kind="stable")[:, :ef]
            near[touched] = np.take_along_axis(all_near, order, 1)
            pool[touched] = np.take_along_axis(np.concatenate([pool[touched], more], 1), order, 1)
            done[touched] = np.take_along_axis(np.concatenate([done[touched], more < 0], 1), order, 1)

        rows, cols = np.nonzero(start >= 0)
        merge(rows, start[rows, cols])
        while not done.all():
            ready = ~done
            ready &= np.cumsum(ready, axis=1) <= wide
            rows, cols = np.nonzero(ready)
            done[rows, cols] = True
            nodes = pool[rows, cols]
            linked = neighbours[nodes if place is None else place[nodes]]
            rows = np.repeat(rows, linked.shape[1])
            nodes = linked.ravel().astype(np.int64)
            merge(rows[nodes >= 0], nodes[nodes >= 0])
        return pool
