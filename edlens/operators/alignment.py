"""Second-order alignment (CORAL) and kernel distances between two domains.

The data side is additive: every task sums moments of its rows, and only features x features
matrices reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _matrix(pdf: pd.DataFrame, features: list[str]) -> np.ndarray:
    if len(features) == 1 and pdf[features[0]].dtype == object:
        return np.stack([np.asarray(v, dtype=float) for v in pdf[features[0]]]) if len(pdf) else np.zeros((0, 0))
    return pdf[features].to_numpy(dtype=float)


def vector_sums(df: DataFrame, features: list[str], fn) -> dict[int, np.ndarray]:
    """Sum over rows of ``fn(matrix) -> vector`` per ``domain``; tasks emit one partial vector per domain."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            for d, part in pdf.groupby("domain"):
                v = fn(_matrix(part, features))
                acc[d] = acc[d] + v if d in acc else v
        if acc:
            yield pd.DataFrame({"domain": list(acc), "v": [a.tolist() for a in acc.values()]})

    parts = df.select("domain", *features).mapInPandas(partial, "domain int, v array<double>")
    sums = parts.select("domain", F.posexplode("v").alias("i", "x")).groupBy("domain", "i").agg(F.sum("x").alias("x"))
    out: dict[int, dict[int, float]] = {}
    for r in sums.collect():
        out.setdefault(r["domain"], {})[r["i"]] = r["x"]
    return {d: np.array([m[i] for i in range(len(m))]) for d, m in out.items()}


@dataclass
class Moments:
    n: float
    mean: np.ndarray
    cov: np.ndarray  # sample covariance


def domain_moments(df: DataFrame, features: list[str]) -> dict[int, Moments]:
    """Count, mean and covariance per domain, in two additive passes (the second one centred)."""
    first = vector_sums(df, features, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]))
    means = {d: v[1:] / v[0] for d, v in first.items()}

    def centred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            for d, part in pdf.groupby("domain"):
                c = _matrix(part, features) - means[d]
                acc[d] = acc.get(d, 0) + c.T @ c
        if acc:
            yield pd.DataFrame({"domain": list(acc), "v": [a.ravel().tolist() for a in acc.values()]})

    parts = df.select("domain", *features).mapInPandas(centred, "domain int, v array<double>")
    sums = parts.select("domain", F.posexplode("v").alias("i", "x")).groupBy("domain", "i").agg(F.sum("x").alias("x")).collect()
    out = {}
    for d, v in first.items():
        k = len(means[d])
        g = np.zeros(k * k)
        for r in sums:
            if r["domain"] == d:
                g[r["i"]] = r["x"]
        out[d] = Moments(v[0], means[d], g.reshape(k, k) / max(v[0] - 1, 1))
    return out


def matrix_power(m: np.ndarray, power: float, floor: float = 0.0) -> np.ndarray:
    """Power of a symmetric matrix through its eigenvalues, floored."""
    w, v = np.linalg.eigh(m)
    return (v * np.maximum(w, floor or 1e-12) ** power) @ v.T


@dataclass
class Coral:
    source_mean: np.ndarray
    target_mean: np.ndarray
    source_cov: np.ndarray
    target_cov: np.ndarray
    matrix: np.ndarray  # applied to centred source columns


def coral_fit(df: DataFrame, features: list[str], *, regularization: float = 1e-3, strength: float = 1.0, variant: str = "power", floor: float = 0.0, centre: bool = True) -> Coral:
    """Ct^(1/2) Cs^(-1/2) mixed with the identity by ``strength``.

    ``variant='cholesky'`` uses triangular factors instead of symmetric roots; ``floor`` bounds the
    eigenvalues from below.
    """
    m = domain_moments(df, features)
    k = len(m[0].mean)
    cs, ct = m[0].cov + regularization * np.eye(k), m[1].cov + regularization * np.eye(k)
    if variant == "power":
        a = matrix_power(ct, 0.5, floor) @ matrix_power(cs, -0.5, floor)
    elif variant == "cholesky":
        a = np.linalg.cholesky(ct) @ np.linalg.inv(np.linalg.cholesky(cs))
    else:
        raise ValueError(f"unknown variant {variant}")
    a = (1 - strength) * np.eye(k) + strength * a
    zero = np.zeros(k)
    return Coral(m[0].mean if centre else zero, m[1].mean if centre else zero, cs, ct, a)


def coral_apply(df: DataFrame, features: list[str], model: Coral, domain: int = 0) -> DataFrame:
    """Centre, and map the source side; pure column expressions."""
    mean = model.source_mean if domain == 0 else model.target_mean
    centred = [F.col(c) - F.lit(float(m)) for c, m in zip(features, mean)]

    def row(weights: np.ndarray) -> Column:
        return reduce(lambda x, y: x + y, [c * F.lit(float(w)) for c, w in zip(centred, weights)])

    new = [row(model.matrix[i]) if domain == 0 else centred[i] for i in range(len(features))]
    keep = [c for c in df.columns if c not in features]
    return df.select(*keep, *[e.alias(c) for c, e in zip(features, new)])


def coral_loss(df: DataFrame, features: list[str]) -> DataFrame:
    m = domain_moments(df, features)
    return df.sparkSession.createDataFrame([(float(np.linalg.norm(m[0].cov - m[1].cov)),)], "coral_loss double")


def alignment_metrics(df: DataFrame, model: Coral) -> DataFrame:
    """Frobenius distance of the covariances before and after, and condition numbers."""
    before = float(np.linalg.norm(model.source_cov - model.target_cov))
    after = float(np.linalg.norm(model.matrix @ model.source_cov @ model.matrix.T - model.target_cov))
    row = (before, after, before - after, (before - after) / before if before > 0 else 0.0, float(np.linalg.cond(model.source_cov)), float(np.linalg.cond(model.target_cov)))
    names = "frobenius_before double, frobenius_after double, improvement double, relative_improvement double, source_condition double, target_condition double"
    return df.sparkSession.createDataFrame([row], names)


def mmd_linear(df: DataFrame, features: list[str]) -> DataFrame:
    """Squared distance of the domain means."""
    side = lambda d, c: F.avg(F.when(F.col("domain") == d, F.col(c)))
    return df.agg(reduce(lambda a, b: a + b, [F.pow(side(0, c) - side(1, c), F.lit(2)) for c in features]).alias("mmd_linear"))


def mmd_polynomial(df: DataFrame, features: list[str], degree: int = 2, coef0: float = 1.0, gamma: float | None = None) -> float:
    """Exact polynomial-kernel discrepancy without pairs.

    (g x.y + c)^d is a sum over k of C(d, k) c^(d-k) g^k <x^(k), y^(k)> with x^(k) the k-fold outer
    product, so the mean over all pairs only needs the mean outer products of both sides.
    """
    if degree > 3:
        raise ValueError("outer products beyond the third power are not kept")

    def powers(x: np.ndarray) -> np.ndarray:
        parts = [np.array([float(len(x))]), x.sum(axis=0)]
        if degree >= 2:
            parts.append((x.T @ x).ravel())
        if degree >= 3:
            parts.append(np.einsum("ni,nj,nk->ijk", x, x, x).ravel())
        return np.concatenate(parts)

    s = vector_sums(df, features, powers)
    k = round(_feature_count(len(s[0]), degree))
    g = gamma if gamma is not None else 1.0 / k
    total, at = 0.0, 1
    for p in range(1, degree + 1):
        size = k**p
        diff = s[0][at : at + size] / s[0][0] - s[1][at : at + size] / s[1][0]
        total += math.comb(degree, p) * coef0 ** (degree - p) * g**p * float(diff @ diff)
        at += size
    return max(0.0, total)


def _feature_count(length: int, degree: int) -> int:
    k = 1
    while 1 + sum(k**p for p in range(1, degree + 1)) < length:
        k += 1
    return k


def mmd_rbf(df: DataFrame, features: list[str], gamma: float = 1.0, components: int = 4096, seed: int = 42) -> float:
    """RBF-kernel discrepancy over all rows in one pass, by random Fourier features.

    exp(-g |x - y|^2) is the mean of cos(w.(x - y)) over normal w, so the value is estimated as the
    mean over ``components`` frequencies of the squared distance of the sides' mean sines and
    cosines. The error falls with 1 / sqrt(components); the rows are never sampled or paired.
    """
    head = df.select(*features).limit(1).toPandas()
    k = _matrix(head, features).shape[1]
    w = np.random.default_rng(seed).normal(0.0, math.sqrt(2 * gamma), (k, components))

    def waves(x: np.ndarray) -> np.ndarray:
        out = np.zeros(2 * components + 1)
        for at in range(0, len(x), 512):
            z = x[at : at + 512] @ w
            out[1 : components + 1] += np.cos(z).sum(axis=0)
            out[components + 1 :] += np.sin(z).sum(axis=0)
        out[0] = len(x)
        return out

    s = vector_sums(df, features, waves)
    diff = s[0][1:] / s[0][0] - s[1][1:] / s[1][0]
    return max(0.0, float(diff @ diff) / components)
