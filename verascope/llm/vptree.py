"""A vantage-point tree over norm-augmented integer vectors, for exact searches by inner product.

Every vector x gets one more component, sqrt(M * M - |x| * |x|) with M the greatest norm, so that all have the
norm M; a query q gets zero there. Then |q - x|^2 = |q|^2 + M^2 - 2 q.x: higher inner products are nearer, and
a window of scores is an annulus around the query. Distances only steer the search; scores are exact integers.
"""

from __future__ import annotations

import heapq

import numpy as np

LEAF = 128
#: Sums of products below this are exact as doubles.
EXACT = 1 << 53


def matrix(values: np.ndarray, sizes: np.ndarray, dims: int) -> np.ndarray:
    """Rows of flattened vectors as one int64 matrix; shorter ones end in zeros."""
    if len(sizes) and (sizes == dims).all():
        return values.astype(np.int64).reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as int64; rows may be doubles where their products stay exact."""
    return rows @ query if rows.dtype == np.int64 else (rows @ query.astype(np.float64)).astype(np.int64)


def exact(rows: np.ndarray, norm2: int) -> np.ndarray:
    """rows in the type whose products with vectors of squared norm norm2 or less are exact and fastest."""
    return rows.astype(np.float64) if norm2 < EXACT else rows


class VPTree:
    """Points in leaf order; a node has the range of distances from its vantage point to either child's points."""

    def __init__(self, points: np.ndarray, norm2: int, leaf: int = LEAF, depth: int = 64) -> None:
        self.norm2 = norm2
        self.slack = 1e-9 * (1.0 + float(norm2) ** 0.5)
        x = points.astype(np.float64)
        rest = np.sqrt(np.maximum(0.0, float(norm2) - np.einsum("ij,ij->i", x, x)))
        self.order = np.arange(len(x))
        # (vantage, its last component, near node, its least and greatest distance, far node, ...) or (start, end)
        self.nodes: list[tuple] = [()] if len(x) else [(0, 0)]
        todo = [(0, 0, len(x), 0)] if len(x) else []
        while todo:
            node, a, b, level = todo.pop()
            at = self.order[a:b]
            cut = None
            if b - a > leaf and level < depth:
                middle = x[at].mean(axis=0)
                off = x[at] - middle
                v = at[int(np.argmax(np.einsum("ij,ij->i", off, off)))]
                off = x[at] - x[v]
                far = np.sqrt(np.einsum("ij,ij->i", off, off) + (rest[at] - rest[v]) ** 2)
                cut = float(np.median(far))
                if cut >= far.max():  # many copies lie outermost: they go out together, or all points are copies
                    below = far[far < cut]
                    cut = float(below.max()) if len(below) else None
            if cut is None:
                self.nodes[node] = (a, b)
                continue
            near = far <= cut
            m = a + int(near.sum())
            self.order[a:b] = np.concatenate([at[near], at[~near]])
            left, right = len(self.nodes), len(self.nodes) + 1
            self.nodes += [(), ()]
            self.nodes[node] = (x[v], rest[v], left, float(far[near].min()), float(far[near].max()), right, float(far[~near].min()), float(far[~near].max()), cut)
            todo += [(left, a, m, level + 1), (right, m, b, level + 1)]
        self.rows = exact(points[self.order], norm2)

    def leaves(self) -> int:
        return sum(len(x) == 2 for x in self.nodes)

    def distance(self, score: int, query_norm2: int) -> float:
        return max(0.0, float(query_norm2 + self.norm2 - 2 * score)) ** 0.5

    def _from(self, query: np.ndarray, node: tuple) -> float:
        off = query - node[0]
        return float(np.sqrt(off @ off + node[1] ** 2))

    def routes(self, points: np.ndarray) -> np.ndarray:
        """The leaf node that each point, of the tree or not, belongs to by the cuts."""
        x = points.astype(np.float64)
        rest = np.sqrt(np.maximum(0.0, float(self.norm2) - np.einsum("ij,ij->i", x, x)))
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            n, at = todo.pop()
            node = self.nodes[n]
            if len(node) == 2 or not len(at):
                out[at] = n
                continue
            off = x[at] - node[0]
            near = np.sqrt(np.einsum("ij,ij->i", off, off) + (rest[at] - node[1]) ** 2) <= node[8]
            todo += [(node[2], at[near]), (node[5], at[~near])]
        return out

    def reached(self, query: np.ndarray, low: int, high: int) -> list[int]:
        """Leaf nodes where points routed by the cuts may have a score from low to high."""
        q = query.astype(np.float64)
        q2 = int(query @ query)
        inner, outer = self.distance(high, q2) - self.slack, self.distance(low, q2) + self.slack
        out, todo = [], [(0, 0.0, np.inf)]
        while todo:
            n, least, most = todo.pop()
            node = self.nodes[n]
            if least > outer or most < inner:
                continue
            if len(node) == 2:
                out.append(n)
                continue
            d, cut = self._from(q, node), node[8] + self.slack
            todo += [(node[2], max(least, d - cut), min(most, d + cut)), (node[5], max(least, node[8] - self.slack - d), most)]
        return out

    def search(self, query: np.ndarray, low: int, high: int, k: int, wanted: np.ndarray, ids: np.ndarray, seen: dict[int, np.ndarray]) -> list[tuple[int, int]]:
        """The first k (score, id) with a score from low to high among wanted points; higher scores first, then lesser ids.

        wanted, ids: in leaf order. Nodes come nearest first; the search ends when the next one lies beyond the k-th hit
        or beyond the annulus; nodes inside its hole are skipped. seen keeps scores of this query's leaves between windows.
        """
        q = query.astype(np.float64)
        q2 = int(query @ query)
        inner, outer = self.distance(high, q2) - self.slack, self.distance(low, q2) + self.slack
        found: list[tuple[int, int]] = []
        heap = [(0.0, 0, np.inf)]
        while heap:
            least, n, most = heapq.heappop(heap)
            if least > outer:
                break
            node = self.nodes[n]
            if len(node) > 2:
                d = self._from(q, node)
                for child, lo, hi in ((node[2], node[3], node[4]), (node[5], node[6], node[7])):
                    nearest, farthest = max(least, d - hi - self.slack, lo - d - self.slack), min(most, d + hi + self.slack)
                    if nearest <= outer and farthest >= inner:
                        heapq.heappush(heap, (nearest, child, farthest))
                continue
            a, b = node
            s = seen.get(n)
            if s is None:
                s = seen[n] = scores(self.rows[a:b], query)
            at = np.flatnonzero((s >= low) & (s <= high) & wanted[a:b])
            if not len(at):
                continue
            if len(at) > k:  # the k-th best score, then all that reach it
                at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
            best = at[np.lexsort((ids[a:b][at], -s[at]))[:k]]
            found = sorted(found + list(zip((-s[best]).tolist(), ids[a:b][best].tolist(), strict=True)))[:k]
            if len(found) == k:
                outer = min(outer, self.distance(-found[-1][0], q2) + self.slack)
        return [(-s, i) for s, i in found]
