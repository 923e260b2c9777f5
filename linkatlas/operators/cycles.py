"""Strong and plain components of one group of links in memory."""

from __future__ import annotations

import numpy as np


def joined_up(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, least): each end of a link and the least id of its component, directions ignored; roots join their least neighbour."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(ids))
    while True:
        a, b = up[a], up[b]
        apart = a != b
        if not apart.any():
            return ids, ids[up]
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]


def components(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, least): each end of a link and the least id of its strong component; Tarjan's walk, without recursion."""
    ids, at = np.unique(np.concatenate((src, dst)), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    n = len(ids)
    by = np.argsort(a, kind="stable")
    to, end = b[by].tolist(), np.cumsum(np.bincount(a, minlength=n)).tolist()
    nxt = [0, *end[:-1]]
    low, index, root = [0] * n, [0] * n, [-1] * n
    stack: list[int] = []
    count = 0
    for start in range(n):
        if index[start]:
            continue
        path = [start]
        count += 1
        index[start] = low[start] = count
        stack.append(start)
        while path:
            u = path[-1]
            k, stop, least = nxt[u], end[u], low[u]
            while k < stop:
                v = to[k]
                k += 1
                if not index[v]:
                    break
                if root[v] < 0 and index[v] < least:
                    least = index[v]
            else:
                v = -1
            nxt[u], low[u] = k, least
            if v >= 0 and not index[v]:
                count += 1
                index[v] = low[v] = count
                stack.append(v)
                path.append(v)
                continue
            path.pop()
            if least == index[u]:
                cut = len(stack) - 1
                while stack[cut] != u:
                    cut -= 1
                members = stack[cut:]
                del stack[cut:]
                r = min(members)
                for v in members:
                    root[v] = r
            if path and low[u] < low[path[-1]]:
                low[path[-1]] = low[u]
    return ids, ids[np.array(root, np.int64)]
