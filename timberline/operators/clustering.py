"""HDBSCAN (Campello, Moulavi and Sander 2013) on the points of one group, in numpy: Prim's tree needs memory in proportion
to the points only. A DataFrame wrapper runs it group by group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def core_distances(xyz: np.ndarray, k: int) -> np.ndarray:
    """Distance of each point to its k-th nearest other one."""
    n = len(xyz)
    xyz = xyz - xyz.mean(0)  # else map coordinates leave the squares below too few digits
    out = np.empty(n)
    k = min(k, n - 1)
    step = max(1, (1 << 22) // max(n, 1))
    norm = np.einsum("ij,ij->i", xyz, xyz)
    for at in range(0, n, step):
        d2 = norm[at : at + step, None] + norm[None] - 2 * xyz[at : at + step] @ xyz.T
        out[at : at + step] = np.sqrt(np.maximum(np.partition(d2, k, axis=1)[:, k], 0))
    return out


def spanning_tree(xyz: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of the mutual reachability graph: both ends and length of each edge, shortest first."""
    n = len(xyz)
    inside = np.zeros(n, bool)
    best, parent = np.full(n, np.inf), np.zeros(n, np.int64)
    a, b, w = np.empty(n - 1, np.int64), np.empty(n - 1, np.int64), np.empty(n - 1)
    at = 0
    for k in range(n - 1):
        inside[at] = True
        step = xyz - xyz[at]
        d = np.maximum(np.maximum(np.sqrt(np.einsum("ij,ij->i", step, step)), core), core[at])
        closer = (d < best) & ~inside
        best[closer], parent[closer] = d[closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        a[k], b[k], w[k] = parent[at], at, best[at]
    order = np.argsort(w, kind="stable")
    return a[order], b[order], w[order]


def hdbscan(xyz: np.ndarray, min_size: int = 10) -> np.ndarray:
    """Cluster labels, -1 for noise; clusters by excess of mass, never the whole, numbered by their least point."""
    n = len(xyz)
    if not np.isfinite(xyz).all():
        raise ValueError("coordinates must be finite")
    if n < 2 * min_size:
        return np.full(n, -1, np.int64)
    a, b, w = spanning_tree(xyz, core_distances(xyz, min_size))
    # the dendrogram: node n + k joins two nodes at height w[k]
    top, size = np.arange(2 * n - 1), np.ones(2 * n - 1, np.int64)
    left, right = np.empty(n - 1, np.int64), np.empty(n - 1, np.int64)

    def find(x: int) -> int:
        root = x
        while top[root] != root:
            root = top[root]
        while top[x] != root:
            top[x], x = root, top[x]
        return int(root)

    for k in range(n - 1):
        x, y = find(a[k]), find(b[k])
        left[k], right[k] = x, y
        top[x] = top[y] = n + k
        size[n + k] = size[x] + size[y]
    # from the root down: a split into two sides of min_size makes two clusters, otherwise points fall out of the one
    cluster_of = {2 * n - 2: 0}
    birth, parents, mass = [0.0], [-1], [0.0]
    leave = np.zeros(n, np.int64)
    for node in range(2 * n - 2, n - 1, -1):
        own = cluster_of.get(node)
        if own is None:
            continue
        k = node - n
        rate = 1 / w[k] if w[k] > 0 else 1e12
        sides = (int(left[k]), int(right[k]))
        large = [size[s] >= min_size for s in sides]
        if all(large):
            mass[own] += (rate - birth[own]) * size[node]
            for s in sides:
                cluster_of[s] = len(birth)
                birth.append(rate), parents.append(own), mass.append(0.0)
        else:
            for s, keep in zip(sides, large, strict=True):
                if keep:
                    cluster_of[s] = own
                else:
                    mass[own] += (rate - birth[own]) * size[s]
                    stack = [s]
                    while stack:
                        x = stack.pop()
                        if x < n:
                            leave[x] = own
                        else:
                            stack += [int(left[x - n]), int(right[x - n])]
    for x in range(n):
        if x in cluster_of:
            leave[x] = cluster_of[x]
    # keep a cluster if it holds more than the best of what is below it
    count = len(birth)
    best, kept = list(mass), [True] * count
    below = [0.0] * count
    for c in range(count - 1, 0, -1):
        if below[c] > mass[c]:
            kept[c], best[c] = False, below[c]
        below[parents[c]] += best[c]
    kept[0] = False
    chosen = np.full(count, -1, np.int64)
    for c in range(1, count):
        up = chosen[parents[c]]
        chosen[c] = up if up >= 0 else (c if kept[c] else -1)
    found = chosen[leave]
    labels = np.full(n, -1, np.int64)
    for k, c in enumerate(dict.fromkeys(found[found >= 0].tolist())):
        labels[found == c] = k
    return labels


def cluster_points(df: DataFrame, min_size: int = 10) -> DataFrame:
    """Add ``cluster`` to each point, cloud by cloud; memory is in proportion to a cloud's points, time to their square.

    A cloud that can't be clustered (a coordinate that isn't finite) has null in every row and doesn't fail the others."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id", ignore_index=True)
        try:
            found = pd.array(hdbscan(pdf[["x", "y", "z"]].to_numpy(float), min_size), "Int64")
        except ValueError:
            found = pd.array([None] * len(pdf), "Int64")
        return pd.DataFrame({"cloud_id": pdf["cloud_id"], "point_id": pdf["point_id"], "cluster": found})

    kind = df.schema["cloud_id"].dataType.simpleString()
    found = df.select("cloud_id", "point_id", "x", "y", "z").groupBy("cloud_id").applyInPandas(label, f"cloud_id {kind}, point_id long, cluster long")
    return df.join(found, ["cloud_id", "point_id"])


def reachability(df: DataFrame, min_size: int = 10) -> DataFrame:
    """cloud_id, points, core_sum and tree_sum: the core distances of each cloud and the lengths of its spanning tree, added up."""

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz = pdf.sort_values("point_id")[["x", "y", "z"]].to_numpy(float)
        core = core_distances(xyz, min_size)
        return pd.DataFrame({"cloud_id": [pdf["cloud_id"].iloc[0]], "points": [len(xyz)], "core_sum": [core.sum()], "tree_sum": [spanning_tree(xyz, core)[2].sum() if len(xyz) > 1 else 0.0]})

    kind = df.schema["cloud_id"].dataType.simpleString()
    return df.select("cloud_id", "point_id", "x", "y", "z").groupBy("cloud_id").applyInPandas(measure, f"cloud_id {kind}, points long, core_sum double, tree_sum double")
