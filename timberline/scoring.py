"""Scores of point clusters: how likely a cluster is a trunk.

The trained weights of the classifier aren't public, so the default scorer is a geometric rule. A network of the same
architecture (set abstraction with farthest points and ball queries, then dense layers) can be run instead from an archive
of weights; it is evaluated in numpy, once loaded per task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from timberline.operators.circle import geometric_circle
from timberline.operators.sampling import farthest_indices

SAMPLE = 512
#: Fixed values of the architecture: centroids, radius, neighbours and layer widths of each set abstraction; dense layers.
ABSTRACTIONS = [(512, 0.2, 32, [64, 64, 128]), (128, 0.4, 64, [128, 128, 256]), (None, None, None, [256, 512, 1024])]
DENSE = [512, 256]


def tree_normalized(xyz: np.ndarray) -> np.ndarray:
    """x and y less their means, z less the middle of its range, all over half the range of z."""
    half = (xyz[:, 2].max() - xyz[:, 2].min()) / 2
    out = xyz - np.array([xyz[:, 0].mean(), xyz[:, 1].mean(), (xyz[:, 2].max() + xyz[:, 2].min()) / 2])
    return out / half if half > 0 else np.zeros_like(out)


def geometric_score(xyz: np.ndarray) -> float:
    """In (0, 1): near 1 for an upright cylinder; falls with the spread about the fitted circle and with width against height."""
    rise = np.ptp(xyz[:, 2])
    slope = np.polyfit(xyz[:, 2], xyz[:, :2], 1) if rise > 0 else np.zeros((2, 2))
    straight = xyz[:, :2] - xyz[:, 2:] * slope[0]
    circle = geometric_circle(straight[:, 0], straight[:, 1])
    if circle is None or rise <= 0:
        return 1e-6
    off = np.abs(np.hypot(straight[:, 0] - circle[0], straight[:, 1] - circle[1]) - circle[2])
    return float(np.clip(np.exp(-3 * off.mean() / max(circle[2], 1e-9)) * np.exp(-circle[2] / rise), 1e-6, 1 - 1e-6))


class PointNet:
    """Forward pass of the single-scale grouping classifier from named arrays (batch norm folded by ``fold``)."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.arrays = arrays

    def _dense(self, name: str, x: np.ndarray, last: bool = False) -> np.ndarray:
        y = x @ self.arrays[f"{name}.weight"].reshape(self.arrays[f"{name}.weight"].shape[0], -1).T + self.arrays[f"{name}.bias"]
        return y if last else np.maximum(y, 0)

    def features(self, xyz: np.ndarray) -> np.ndarray:
        points, places = None, xyz
        for k, (count, radius, near, widths) in enumerate(ABSTRACTIONS, 1):
            if count is None:
                group = places[None] if points is None else np.concatenate((places, points), 1)[None]
                centres = np.zeros((1, 3))
            else:
                centres = places[farthest_indices(places, count)]
                picked = ball_indices(centres, places, radius, near)
                group = places[picked] - centres[:, None]
                if points is not None:
                    group = np.concatenate((group, points[picked]), 2)
            for j in range(len(widths)):
                group = self._dense(f"sa{k}.{j}", group)
            places, points = centres, group.max(1)
        return points[0]

    def log_probabilities(self, xyz: np.ndarray) -> np.ndarray:
        x = self.features(xyz)
        for j in range(len(DENSE)):
            x = self._dense(f"fc{j + 1}", x)
        x = self._dense(f"fc{len(DENSE) + 1}", x, last=True)
        return x - x.max() - np.log(np.exp(x - x.max()).sum())

    def __call__(self, xyz: np.ndarray) -> float:
        return float(np.exp(self.log_probabilities(xyz)[0]))


def ball_indices(centres: np.ndarray, places: np.ndarray, radius: float, k: int) -> np.ndarray:
    """The first k indices within the radius of each centre, filled with the first one; a centre is itself one of the places."""
    out = np.empty((len(centres), k), np.int64)
    for i, c in enumerate(centres):
        d = places - c
        found = np.flatnonzero(np.einsum("ij,ij->i", d, d) <= radius * radius)[:k]
        out[i] = np.pad(found, (0, k - len(found)), constant_values=found[0] if len(found) else 0)
    return out


def group_features(places: np.ndarray, points: np.ndarray | None, count: int, radius: float, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres by farthest points, and the neighbours of each relative to it with their features."""
    centres = places[farthest_indices(places, count)]
    picked = ball_indices(centres, places, radius, near)
    group = places[picked] - centres[:, None]
    return centres, group if points is None else np.concatenate((points[picked], group), 2)


def dense_stack(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Dense layers (weight, bias; batch norm folded in), each with a rectifier."""
    for weight, bias in layers:
        x = np.maximum(x @ weight.T + bias, 0)
    return x


def multi_scale_abstraction(places: np.ndarray, points: np.ndarray | None, count: int, scales: list[tuple[float, int, list]]) -> tuple[np.ndarray, np.ndarray]:
    """Set abstraction over several radii about the same centres; the scales' features side by side."""
    out, centres = [], places[farthest_indices(places, count)]
    for radius, near, layers in scales:
        picked = ball_indices(centres, places, radius, near)
        group = places[picked] - centres[:, None]
        if points is not None:
            group = np.concatenate((points[picked], group), 2)
        out.append(dense_stack(group, layers).max(1))
    return centres, np.concatenate(out, 1)


def propagate_features(places: np.ndarray, points: np.ndarray | None, sampled: np.ndarray, features: np.ndarray, layers: list) -> np.ndarray:
    """Features of sampled places carried to all places: the mean of the three nearest weighted by 1 / (d2 + 1e-8), then dense layers."""
    if len(sampled) == 1:
        carried = np.repeat(features, len(places), 0)
    else:
        d2 = ((places[:, None] - sampled[None]) ** 2).sum(2)
        near = np.argsort(d2, 1, kind="stable")[:, :3]
        weight = 1 / (np.take_along_axis(d2, near, 1) + 1e-8)
        carried = (features[near] * (weight / weight.sum(1, keepdims=True))[:, :, None]).sum(1)
    return dense_stack(carried if points is None else np.concatenate((points, carried), 1), layers)


def fold(weight: np.ndarray, bias: np.ndarray, mean: np.ndarray, var: np.ndarray, gain: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weight and bias of a layer with its batch norm folded in."""
    s = gain / np.sqrt(var + eps)
    return weight * s.reshape(-1, *[1] * (weight.ndim - 1)), (bias - mean) * s + shift


def nll_loss(log_probabilities: np.ndarray, target: np.ndarray) -> float:
    return float(-log_probabilities[np.arange(len(target)), target].mean())


def load_weights(path: str) -> PointNet:
    """From an .npz archive of arrays named sa1.0.weight, sa1.0.bias, ..., fc3.bias."""
    with np.load(path) as held:
        return PointNet(dict(held))


def score_clusters(df: DataFrame, scorer: Callable[[np.ndarray], float] = geometric_score, sample: int = SAMPLE) -> DataFrame:
    """cloud_id, cluster, probability: each cluster is sampled to ``sample`` farthest points, normalised and scored."""

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id", ignore_index=True)
        xyz = pdf[["x", "y", "z"]].to_numpy(float)
        own = tree_normalized(xyz[farthest_indices(xyz, sample)])
        return pd.DataFrame({"cloud_id": [pdf["cloud_id"].iloc[0]], "cluster": [pdf["cluster"].iloc[0]], "probability": [float(scorer(own))]})

    kind = df.schema["cloud_id"].dataType.simpleString()
    return df.select("cloud_id", "cluster", "point_id", "x", "y", "z").groupBy("cloud_id", "cluster").applyInPandas(score, f"cloud_id {kind}, cluster long, probability double")
