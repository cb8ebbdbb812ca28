"""Algorithms over whole arrays of edges, without a Python loop over nodes. Run inside tasks.

An adjacency is (first, to): the targets of node v are to[first[v] : first[v + 1]].
"""

from __future__ import annotations

import numpy as np


def adjacency(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(src, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dst[order].astype(np.int32)


def dense(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers that occur, in order, and the edges by place among them."""
    ids = np.unique(np.concatenate([src, dst]))
    return ids, np.searchsorted(ids, src).astype(np.int32), np.searchsorted(ids, dst).astype(np.int32)


def _targets(first: np.ndarray, to: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many edges each node has, and their targets."""
    counts = first[nodes + 1] - first[nodes]
    return counts, to[np.repeat(first[nodes] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's part, where a and b are in one: roots hook to lesser ones, then all pointers jump."""
    root = np.arange(n, dtype=np.int32)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            far = root[root]
            if np.array_equal(far, root):
                break
            root = far
    return root


def strong(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The largest member of each node's strong component: the largest node that reaches it colours it, and what reaches back to that within its colour is with it."""
    label = np.arange(n, dtype=np.int32)
    src, dst = src[src != dst], dst[src != dst]
    while True:
        while len(src):  # nodes without edges in or out are alone
            inner = (np.bincount(src, minlength=n) > 0) & (np.bincount(dst, minlength=n) > 0)
            kept = inner[src] & inner[dst]
            if kept.all():
                break
            src, dst = src[kept], dst[kept]
        if not len(src):
            return label
        first, to = adjacency(src, dst, n)
        colour, active = np.arange(n, dtype=np.int32), np.unique(src)
        while len(active):
            counts, near = _targets(first, to, active)
            told = np.repeat(colour[active], counts)
            up = told > colour[near]
            near, told = near[up], told[up]
            np.maximum.at(colour, near, told)
            active = np.unique(near)
        same = colour[src] == colour[dst]
        first, to = adjacency(dst[same], src[same], n)
        here = np.unique(np.concatenate([src, dst]))
        done = np.zeros(n, bool)
        active = here[colour[here] == here]
        done[active] = True
        while len(active):
            _, near = _targets(first, to, active)
            active = np.unique(near[~done[near]])
            done[active] = True
        label[done] = colour[done]
        kept = ~(done[src] | done[dst])
        src, dst = src[kept], dst[kept]


def blocks(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(child, parent, block) of a spanning forest's edges, block being the same number for edges of one biconnected component (Tarjan and Vishkin).

    Every node of a biconnected component is at an end of one of its forest edges. Breadth first, so all other edges are between nodes of which neither is above the other.
    """
    keys = np.unique(np.minimum(src, dst)[src != dst].astype(np.int64) * n + np.maximum(src, dst)[src != dst])
    a, b = (keys // n).astype(np.int32), (keys % n).astype(np.int32)
    del keys
    first, to = adjacency(np.concatenate([a, b]), np.concatenate([b, a]), n)
    roots = np.unique(joined(n, a, b))
    parent, levels = np.full(n, -1, np.int32), [roots]
    parent[roots] = roots
    while len(levels[-1]):
        counts, near = _targets(first, to, levels[-1])
        above = np.repeat(levels[-1], counts)
        new = parent[near] < 0
        near, above = near[new], above[new]
        parent[near] = above
        near = np.unique(near)
        levels.append(near[np.argsort(parent[near], kind="stable")].astype(np.int32))
    size = np.ones(n, np.int32)
    for level in reversed(levels[1:]):
        np.add.at(size, parent[level], size[level])
    pre = np.zeros(n, np.int32)
    pre[roots] = np.cumsum(size[roots]) - size[roots]
    for level in levels[1:]:
        if len(level):
            above = parent[level]
            before = np.cumsum(size[level]) - size[level]
            start = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
            before -= np.repeat(before[start], np.diff(np.concatenate([start, [len(level)]])))
            pre[level] = pre[above] + 1 + before
    low, high = pre.copy(), pre.copy()
    for x, y in ((a, b), (b, a)):
        np.minimum.at(low, x, pre[y])
        np.maximum.at(high, x, pre[y])
    for level in reversed(levels[1:]):
        np.minimum.at(low, parent[level], low[level])
        np.maximum.at(high, parent[level], high[level])
    x, y = np.where(pre[a] < pre[b], a, b), np.where(pre[a] < pre[b], b, a)
    across = pre[x] + size[x] <= pre[y]
    child = np.flatnonzero(parent != np.arange(n)).astype(np.int32)
    up = parent[child]
    on = (parent[up] != up) & ((low[child] < pre[up]) | (high[child] >= pre[up] + size[up]))
    block = joined(n, np.concatenate([x[across], child[on]]), np.concatenate([y[across], up[on]]))
    return child, up, block[child]


def reach_sums(first: np.ndarray, to: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each node, how many of the nodes low to high it reaches, and the sum of its distances to them: breadth first from all of them at once, a bit for each."""
    n = len(first) - 1
    words = int(min(16, max(1, 16_000_000 // max(n, len(to)))))
    r, total, origin = np.zeros(n, np.int64), np.zeros(n, np.int64), np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    for at in range(low, high, 64 * words):
        j = np.arange(min(high, at + 64 * words) - at)
        seen = np.zeros((n, words), np.uint64)
        seen[at + j, j // 64] = np.uint64(1) << (j % 64).astype(np.uint64)
        front, active, depth = seen.copy(), at + j, 0
        while len(active):
            depth += 1
            mark = np.zeros(n, bool)
            mark[active] = True
            e = np.flatnonzero(mark[to])
            if not len(e):
                break
            rows = origin[e]
            start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            rows = rows[start]
            got = np.bitwise_or.reduceat(front[to[e]], start, axis=0)
            got &= ~seen[rows]
            count = np.bitwise_count(got).sum(1, dtype=np.int64)
            new = count > 0
            rows, got, count = rows[new], got[new], count[new]
            seen[rows] |= got
            r[rows] += count
            total[rows] += count * depth
            front[active] = 0
            front[rows] = got
            active = rows
    return r, total


def dependencies(first: np.ndarray, to: np.ndarray, low: int, high: int) -> np.ndarray:
    """What the sources low to high add to each node's betweenness (Brandes); several sources go at once, as copies of the graph."""
    n = len(first) - 1
    together, sums = int(min(64, max(1, 2_000_000 // n))), np.zeros(n)
    sources = low + np.flatnonzero(np.diff(first[low : high + 1]))  # others reach nothing
    for i in range(0, len(sources), together):
        batch = sources[i : i + together]
        starts = np.arange(len(batch)) * n + batch
        dist, ways, delta, mark = np.full(len(batch) * n, -1, np.int32), np.zeros(len(batch) * n), np.zeros(len(batch) * n), np.zeros(len(batch) * n, np.int32)
        dist[starts], ways[starts] = 0, 1
        now, steps = starts, []
        while len(now):
            v = now % n
            counts, near = _targets(first, to, v)
            a, b = np.repeat(now, counts), np.repeat(now - v, counts) + near
            down = dist[b] < 0
            a, b = a[down], b[down]
            dist[b] = len(steps) + 1
            np.add.at(ways, b, ways[a])
            steps.append((a, b))
            turn = np.arange(len(b), dtype=np.int32)
            mark[b] = turn
            now = b[mark[b] == turn]  # each once
        for a, b in reversed(steps):
            np.add.at(delta, a, ways[a] / ways[b] * (1 + delta[b]))
        delta[starts] = 0
        sums += delta.reshape(len(batch), n).sum(0)
    return sums
