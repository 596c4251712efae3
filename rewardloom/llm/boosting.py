"""Gradient-boosted trees for two classes, in numpy: logistic loss, quantile bins, trees grown level by level."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Model(NamedTuple):
    """``edges`` of the bins of each feature; for each tree the feature and bin asked at each inner node, and the leaves."""

    edges: list[np.ndarray]
    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray
    start: float


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint8)


def _leaves(bins: np.ndarray, feature: np.ndarray, split: np.ndarray, depth: int) -> np.ndarray:
    """The leaf that each row reaches; inner nodes are numbered as in a heap."""
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for _ in range(depth):
        node = 2 * node + 1 + (bins[rows, feature[node]] > split[node])
    return node - (2**depth - 1)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 70, depth: int = 4, rate: float = 0.25, most_bins: int = 24, penalty: float = 2.0) -> Model:
    quantiles = np.linspace(0, 1, most_bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], quantiles, method="lower")) for j in range(x.shape[1])]
    bins = binned(x, edges)
    width = most_bins + 1
    flat = bins.astype(np.int64) + np.arange(x.shape[1]) * width
    p0 = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    start = float(np.log(p0 / (1 - p0)))
    score = np.full(len(y), start)
    inner, cells = 2**depth - 1, x.shape[1] * width
    features, splits, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, split = np.zeros(inner, np.int64), np.full(inner, 255)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            low = 2**level - 1
            keys = ((node - low)[:, None] * cells + flat).ravel()
            size = 2**level * cells
            sums = [np.bincount(keys, np.repeat(v, x.shape[1]), size).reshape(2**level, x.shape[1], width) for v in (g, h)]
            left_g, left_h = (s.cumsum(axis=2) for s in sums)
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty)
            gain[(left_h < 1) | (right_h < 1)] = 0
            best = gain.reshape(2**level, -1).argmax(axis=1)
            useful = gain.reshape(2**level, -1)[np.arange(2**level), best] > 1e-6
            feature[low : low + 2**level] = best // width
            split[low : low + 2**level] = np.where(useful, best % width, 255)
            node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > split[node])
        leaf = node - inner
        total_g, total_h = (np.bincount(leaf, v, 2**depth) for v in (g, h))
        value = -rate * total_g / (total_h + penalty)
        score += value[leaf]
        features.append(feature)
        splits.append(split)
        values.append(value)
    return Model(edges, np.array(features), np.array(splits), np.array(values), start)


def predict(model: Model, x: np.ndarray) -> np.ndarray:
    """The log-odds of class 1."""
    bins = binned(x, model.edges)
    depth = int(np.log2(model.leaf.shape[1]))
    out = np.full(len(x), model.start)
    for feature, split, leaf in zip(model.feature, model.split, model.leaf, strict=True):
        out += leaf[_leaves(bins, feature, split, depth)]
    return out
