"""Cover trees of unit vectors, and all pairs within a distance by walking two of them at once.

A node holds the points within its radius of its center. The children's centers are a net of half
the radius (halved again while nothing would be divided), so levels are nested and radii halve. A
pair of nodes is left out if the distance of their centers is more than both radii and the
threshold together, taken whole if it is at most the threshold less both radii, and divided otherwise.
"""

from __future__ import annotations

import numpy as np

#: Points of a node whose children are the points themselves.
LEAF = 8
#: Bounds are trusted down to this distance; what lies nearer is decided point by point.
SLACK = 1e-6
#: Rows and columns of a block of distances.
TILE = 512
#: Undecided pairs of a block of nodes, a 64th of it or more, are divided together, fewer row by row.
DENSE = 64
#: Points that are tried as centers of a net at once.
BATCH = 256
#: Cosines nearer to the threshold than this are computed again from the vectors as they came.
NEAR = 1e-9


def normalized(raw: np.ndarray) -> np.ndarray:
    """Rows of finite vectors that are not zero, divided by their lengths without overflow."""
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def _net(points: np.ndarray, center: int, rest: np.ndarray, near: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(child, distance, members): a net of `radius` that starts with the center; `near` are distances to it."""
    first = near <= radius
    members, child, away = [rest[first]], [np.zeros(first.sum(), np.int64)], [near[first]]
    rest, made = rest[~first], 1
    while len(rest):
        tried = rest[:BATCH]
        apart = distances(points[tried], points[tried])
        free, taken = np.ones(len(tried), bool), []
        for i in range(len(tried)):
            if free[i]:
                taken.append(i)
                free &= apart[i] > radius
        centers = tried[taken]
        to, dist = np.empty(len(rest), np.int64), np.empty(len(rest))
        for at in range(0, len(rest), 16 * TILE):
            d = distances(points[rest[at : at + 16 * TILE]], points[centers])
            to[at : at + 16 * TILE] = d.argmin(1)
            dist[at : at + 16 * TILE] = d[np.arange(len(d)), to[at : at + 16 * TILE]]
        to[taken], dist[taken] = np.arange(len(taken)), -1.0
        inside = dist <= radius
        members.append(rest[inside])
        child.append(to[inside] + made)
        away.append(dist[inside])
        rest, made = rest[~inside], made + len(centers)
    return np.concatenate(child), np.concatenate(away), np.concatenate(members)


class CoverTree:
    """Nodes over `points[order]`: the points of a node are a range of `order`, its center the first of them."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.order = np.empty(n, np.int64)
        start, end, radius, kids = [0], [n], [0.0], [(0, 0)]
        near = distances(points, points[:1])[:, 0]
        near[0] = -1.0
        radius[0] = max(float(near.max()), 0.0)
        todo = [(0, np.arange(n), near, 2.0)]
        while todo:
            node, members, near, level = todo.pop()
            if len(members) == 1 or radius[node] <= SLACK:
                self.order[start[node] : end[node]] = members
                continue
            if len(members) <= LEAF:
                child, away = np.arange(len(members)), np.zeros(len(members))
            else:
                while level >= radius[node]:
                    level /= 2
                child, away, members = _net(points, members[0], members, near, level)
                by = np.lexsort((away, child))
                child, away, members = child[by], away[by], members[by]
            cuts = np.flatnonzero(np.r_[True, child[1:] != child[:-1]])
            ends = np.r_[cuts[1:], len(child)]
            first, at = len(start), start[node]
            start.extend((at + cuts).tolist())
            end.extend((at + ends).tolist())
            radius.extend(np.maximum(np.maximum.reduceat(away, cuts), 0.0).tolist())
            kids[node] = (first, first + len(cuts))
            kids.extend([(0, 0)] * len(cuts))
            self.order[at : at + len(members)] = members
            for k in np.flatnonzero(ends - cuts > 1):
                todo.append((first + int(k), members[cuts[k] : ends[k]], away[cuts[k] : ends[k]], level))
        self.points = points[self.order]
        self.start, self.end, self.radius = np.array(start), np.array(end), np.array(radius)
        self.kids = np.array(kids)
        self.centers = self.points[self.start]


class Links:
    """What two trees (or one with itself) have in common: numbers of links and connected points."""

    def __init__(self, a: CoverTree, b: CoverTree, weights: tuple[np.ndarray, np.ndarray], raw: tuple[np.ndarray, np.ndarray], cosine: float):
        self.trees, self.same, self.cosine = (a, b), a is b, cosine
        self.limit = float(np.sqrt(2.0 - 2.0 * cosine))
        self.weights = [w[t.order] for w, t in zip(weights, self.trees)]
        self.raw = [r[t.order] for r, t in zip(raw, self.trees)]
        self.below = [np.r_[0, np.cumsum(w)] for w in self.weights]
        self.steps = [np.zeros(len(w) + 1, np.int64) for w in self.weights]
        self.single = [np.zeros(len(w), np.int64) for w in self.weights]
        self.whole = [np.zeros(len(t.start), bool) for t in self.trees]
        # Points of the second tree follow those of the first.
        self.shift = (0, 0 if self.same else len(a.points))
        self.parent = np.arange(len(a.points) + (0 if self.same else len(b.points)))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self._walk()

    def _weight(self, side: int, nodes):
        t = self.trees[side]
        return self.below[side][t.end[nodes]] - self.below[side][t.start[nodes]]

    def _connect(self, a: np.ndarray, b: np.ndarray) -> None:
        self.edges.append((a, b))
        self.waiting += len(a)
        if self.waiting > 1 << 20:
            self._merge()

    def _merge(self) -> None:
        p = self.parent
        for a, b in self.edges:
            while True:
                x, y = p[a], p[b]
                open_ = x != y
                if not open_.any():
                    break
                a, b = a[open_], b[open_]
                np.minimum.at(p, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
                while (p[p] != p).any():
                    p[:] = p[p]
        self.edges, self.waiting = [], 0

    def _take(self, p: np.ndarray, q: np.ndarray) -> None:
        """All points of nodes `p` are linked with all of nodes `q`."""
        if not len(p):
            return
        for side, nodes, others in ((0, p, q), (1, q, p)):
            t, more = self.trees[side], self._weight(1 - side, others)
            steps = self.steps[0 if self.same else side]
            np.add.at(steps, t.start[nodes], more)
            np.subtract.at(steps, t.end[nodes], more)
            self.whole[0 if self.same else side][nodes] = True
        self._connect(self.trees[0].start[p] + self.shift[0], self.trees[1].start[q] + self.shift[1])

    def _compare(self, p: int, q: int) -> None:
        """Points of two nodes that are not divided further, each pair by its cosine."""
        a, b = self.trees
        i, j = slice(a.start[p], a.end[p]), slice(b.start[q], b.end[q])
        cos = a.points[i] @ b.points[j].T
        linked = cos >= self.cosine
        for x, y in zip(*np.nonzero(np.abs(cos - self.cosine) < NEAR)):
            u, v = self.raw[0][i][x], self.raw[1][j][y]
            linked[x, y] = np.dot(u, v) / (np.sqrt(np.dot(u, u)) * np.sqrt(np.dot(v, v))) >= self.cosine
        x, y = np.nonzero(linked)
        if len(x):
            self.single[0][i] += linked @ self.weights[1][j]
            self.single[0 if self.same else 1][j] += linked.T @ self.weights[0][i]
            self._connect(x + a.start[p] + self.shift[0], y + b.start[q] + self.shift[1])

    def _open(self, side: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of all nodes, and which node each is of; a node without any stands for itself."""
        low, high = self.trees[side].kids[nodes].T
        n = np.where(high > 0, high - low, 1)
        first = np.where(high > 0, low, nodes) - (np.cumsum(n) - n)
        of = np.repeat(np.arange(len(nodes)), n)
        return first[of] + np.arange(len(of)), of

    def _cross(self, rows: np.ndarray, cols: np.ndarray, once: bool = False, asked=None) -> None:
        """Row nodes with column nodes; `once`: each pair of one list of nodes once.

        `asked` (mask, parents of rows, parents of columns) leaves out pairs whose parents are settled.
        """
        a, b = self.trees
        for r in range(0, len(rows), TILE):
            for c in range(r if once else 0, len(cols), TILE):
                i, j = rows[r : r + TILE], cols[c : c + TILE]
                d = distances(a.centers[i], b.centers[j])
                both = a.radius[i][:, None] + b.radius[j][None, :]
                near = d <= both + (self.limit + SLACK)
                if once:
                    near &= i[:, None] < j[None, :]
                if asked:
                    near &= asked[0][np.ix_(asked[1][r : r + TILE], asked[2][c : c + TILE])]
                x, y = np.nonzero(near)
                sure = d[x, y] + both[x, y] <= self.limit - SLACK
                del d, both, near
                self._take(i[x[sure]], j[y[sure]])
                x, y = x[~sure], y[~sure]
                ends = (a.kids[i[x], 1] == 0) & (b.kids[j[y], 1] == 0)
                for p, q in zip(i[x[ends]], j[y[ends]]):
                    self._compare(p, q)
                x, y = x[~ends], y[~ends]
                if not len(x):
                    continue
                some, at = np.unique(x, return_inverse=True)
                others, to = np.unique(y, return_inverse=True)
                if DENSE * len(x) >= len(some) * len(others):
                    mask = np.zeros((len(some), len(others)), bool)
                    mask[at, to] = True
                    left, of_left = self._open(0, i[some])
                    right, of_right = self._open(1, j[others])
                    self._cross(left, right, asked=(mask, of_left, of_right))
                else:
                    for k, part in enumerate(np.split(y, np.flatnonzero(np.diff(x)) + 1)):
                        self._cross(self._open(0, i[some[k : k + 1]])[0], self._open(1, j[part])[0])

    def _walk(self) -> None:
        a = self.trees[0]
        if not self.same:
            self._cross(np.array([0]), np.array([0]))
            return
        todo = [0]
        while todo:
            p = todo.pop()
            # Points nearer than SLACK to each other are linked: no threshold below 1 - 1e-11 can part them.
            if not a.kids[p][1] or 2 * a.radius[p] <= self.limit - SLACK:
                # Every two points of the node are linked; a point is not linked with itself.
                self.whole[0][p] = True
                here = slice(a.start[p], a.end[p])
                self.single[0][here] += self._weight(0, p) - self.weights[0][here]
                continue
            kids = np.arange(*a.kids[p])
            self._cross(kids, kids, once=True)
            todo.extend(kids[a.end[kids] - a.start[kids] > 1].tolist())

    def counts(self) -> list[np.ndarray]:
        """Links of every point, in the order the points were given, by tree."""
        out = []
        for side, t in enumerate(self.trees[:1] if self.same else self.trees):
            found = np.empty(len(t.points), np.int64)
            found[t.order] = self.single[side] + np.cumsum(self.steps[side])[:-1]
            out.append(found)
        return out

    def roots(self) -> list[np.ndarray]:
        """Place of one point (those of the second tree follow) that stands for each point's component."""
        for side, t in enumerate(self.trees[:1] if self.same else self.trees):
            for k in np.flatnonzero(self.whole[side]):
                here = np.arange(t.start[k], t.end[k]) + self.shift[side]
                self._connect(here, np.full(len(here), here[0]))
        self._merge()
        places = np.concatenate([t.order + s for t, s in zip(self.trees[:1] if self.same else self.trees, self.shift)])
        out = []
        for t, s in zip(self.trees[:1] if self.same else self.trees, self.shift):
            found = np.empty(len(t.points), np.int64)
            found[t.order] = places[self.parent[s : s + len(t.points)]]
            out.append(found)
        return out
