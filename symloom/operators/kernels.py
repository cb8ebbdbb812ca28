"""Depth-first algorithms over lists of edges, without recursion: the plain versions that tests hold `arrays` against."""

from __future__ import annotations

import pandas as pd


def _numbered(src: list[str], dst: list[str]) -> tuple[list[str], list[list[int]]]:
    names = sorted({*src, *dst})
    at = {p: i for i, p in enumerate(names)}
    out: list[list[int]] = [[] for _ in names]
    for s, d in zip(src, dst):
        out[at[s]].append(at[d])
    return names, out


def strong(src: list[str], dst: list[str]) -> pd.DataFrame:
    """path, label (the component's least path)."""
    names, out = _numbered(src, dst)
    n = len(names)
    index, low, on, stack, label, clock = [-1] * n, [0] * n, [False] * n, [], [0] * n, 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, 0)]
        while work:
            v, i = work.pop()
            if i == 0:
                index[v] = low[v] = clock
                clock += 1
                stack.append(v)
                on[v] = True
            descended = False
            while i < len(out[v]):
                w = out[v][i]
                i += 1
                if index[w] < 0:
                    work += [(v, i), (w, 0)]
                    descended = True
                    break
                if on[w]:
                    low[v] = min(low[v], index[w])
            if descended:
                continue
            if low[v] == index[v]:
                members = []
                while True:
                    w = stack.pop()
                    on[w] = False
                    members.append(w)
                    if w == v:
                        break
                least = min(members)
                for w in members:
                    label[w] = least
            if work:
                u = work[-1][0]
                low[u] = min(low[u], low[v])
    return pd.DataFrame({"path": names, "label": [names[i] for i in label]})


def _lows(src: list[str], dst: list[str]):
    """Undirected depth-first search over distinct neighbours: names, cut vertices, tree edges with nothing around them, blocks."""
    names, out = _numbered(src, dst)
    near: list[list[int]] = [[] for _ in names]
    for v, ws in enumerate(out):
        for w in ws:
            if v != w:
                near[v].append(w)
                near[w].append(v)
    near = [sorted(set(ws)) for ws in near]
    n = len(names)
    index, low, clock = [-1] * n, [0] * n, 0
    cuts, tight, blocks, edges = set(), [], [], []
    for root in range(n):
        if index[root] >= 0:
            continue
        index[root] = low[root] = clock
        clock += 1
        kids, work = 0, [(root, -1, iter(near[root]))]
        while work:
            v, parent, it = work[-1]
            for w in it:
                if index[w] < 0:
                    index[w] = low[w] = clock
                    clock += 1
                    edges.append((v, w))
                    work.append((w, v, iter(near[w])))
                    break
                if w != parent and index[w] < index[v]:
                    edges.append((v, w))
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if not work:
                    continue
                u = work[-1][0]
                low[u] = min(low[u], low[v])
                if low[v] > index[u]:
                    tight.append((u, v))
                if low[v] >= index[u]:
                    if u == root:
                        kids += 1
                    else:
                        cuts.add(u)
                    block: set[int] = set()
                    while True:
                        e = edges.pop()
                        block |= {*e}
                        if e == (u, v):
                            break
                    blocks.append(sorted(block))
        if kids > 1:
            cuts.add(root)
    return names, cuts, tight, blocks


def cut_vertices(src: list[str], dst: list[str]) -> pd.DataFrame:
    names, cuts, _, _ = _lows(src, dst)
    return pd.DataFrame({"path": [names[i] for i in sorted(cuts)]}, dtype="object")


def bridges(src: list[str], dst: list[str]) -> pd.DataFrame:
    names, _, tight, _ = _lows(src, dst)
    given = set(zip(src, dst))
    pairs = [tuple(sorted((names[a], names[b]))) for a, b in tight]
    pairs = sorted((a, b) for a, b in pairs if not ((a, b) in given and (b, a) in given))
    return pd.DataFrame({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}, dtype="object")


def biconnected(src: list[str], dst: list[str]) -> pd.DataFrame:
    names, _, _, blocks = _lows(src, dst)
    return pd.DataFrame({"members": [[names[i] for i in b] for b in blocks]}, dtype="object")
