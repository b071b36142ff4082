"""Plain numpy versions of the operators, for comparison on small tables."""

from __future__ import annotations

import numpy as np


def euclid(rows):
    x = np.array(rows, dtype=float)
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def tanimoto(sets):
    n = len(sets)
    out = np.ones((n, n))
    for i in range(n):
        for j in range(n):
            union = len(set(sets[i]) | set(sets[j]))
            if union:
                out[i, j] = 1.0 - len(set(sets[i]) & set(sets[j])) / union
    return out


def butina(dist, cutoff):
    n = len(dist)
    near = (dist <= cutoff) & ~np.eye(n, dtype=bool)
    counts = near.sum(1)
    order = sorted(range(n), key=lambda i: (-counts[i], -i))
    label, centers = {}, []
    for i in order:
        if i not in label:
            label[i] = len(centers)
            centers.append(i)
            for j in np.flatnonzero(near[i]):
                label.setdefault(int(j), len(centers) - 1)
    return label, centers


def maxmin(dist, k, start=0):
    picks, far = [start], dist[start].copy()
    while len(picks) < min(k, len(dist)):
        far[picks] = -1
        best = int(np.flatnonzero(far == far.max())[0])
        picks.append(best)
        far = np.minimum(far, dist[best])
    return picks


def density(dist, min_cluster_size, min_samples):
    """Condensed tree and excess of mass over a sorted single-linkage tree; edges ordered by (weight, ids)."""
    n = len(dist)
    core = np.sort(dist + np.diag(np.full(n, -1.0)), axis=1)[:, min_samples]
    reach = np.maximum(dist, np.maximum(core[:, None], core[None]))
    edges = sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    members, node_of, children, level = {i: [i] for i in range(n)}, {i: i for i in range(n)}, {}, {}
    top = n
    for w, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            children[top], level[top] = (node_of[a], node_of[b]), w
            members[top] = members[node_of[a]] + members[node_of[b]]
            parent[b] = a
            node_of[a] = top
            top += 1
    clusters = {}  # id -> birth rate, rows [(row, rate)], child ids

    def walk(node, cluster):
        stack = [node]
        while stack:
            node = stack.pop()
            if node < n:
                continue
            rate = 1.0 / max(level[node], 1e-12)
            left, right = children[node]
            big = [c for c in (left, right) if len(members[c]) >= min_cluster_size]
            if len(big) == 2:
                for c in big:
                    number = len(clusters)
                    clusters[number] = {"birth": rate, "rows": [], "kids": [], "size": len(members[c]), "all": members[c]}
                    clusters[cluster]["kids"].append(number)
                    clusters[cluster].setdefault("split", rate)
                    walk(c, number)
                return
            for c in (left, right):
                if c in big:
                    stack.append(c)
                else:
                    clusters[cluster]["rows"] += [(r, rate) for r in members[c]]

    clusters[0] = {"birth": 0.0, "rows": [], "kids": [], "size": n, "all": list(range(n))}
    walk(top - 1, 0)
    chosen, value = {}, {}
    for number in sorted(clusters, reverse=True):
        c = clusters[number]
        own = sum(rate - c["birth"] for _, rate in c["rows"])
        own += sum(clusters[k]["size"] * (c["split"] - c["birth"]) for k in c["kids"])
        below = sum(value[k] for k in c["kids"])
        if number == 0:
            continue
        chosen[number] = not c["kids"] or below <= own
        value[number] = own if chosen[number] else below
    labels = np.full(n, -1)

    def paint(number):
        for k in clusters[number]["kids"]:
            if chosen[k]:
                labels[clusters[k]["all"]] = k
            else:
                paint(k)

    paint(0)
    return labels


def same_partition(a, b) -> bool:
    """Equal up to renaming, with -1 kept."""
    seen = {}
    for x, y in zip(a, b):
        if (x == -1) != (y == -1) or seen.setdefault(x, y) != y:
            return False
    return len(set(seen.values())) == len(seen)
