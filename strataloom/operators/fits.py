"""Closed-form fits from sums over all rows, and their iteration against nearest points.

Only sums of products leave the executors, a fixed number whatever the rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators import nearest, spatial, stats
from strataloom.session import discard, durable


def moments(rows: DataFrame, src: list[str], dst: list[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float]:
    """Rows, means of src and dst, the covariance of dst and src, and the variance of src in all; rows with nulls are left out."""
    rows = rows.dropna(subset=[*src, *dst])
    cross = [F.covar_pop(d, s) for d in dst for s in src]
    got = rows.agg(F.count("*"), *[F.avg(c) for c in (*src, *dst)], *cross, sum(F.var_pop(s) for s in src)).first()
    n, k, m = got[0], len(src), len(dst)
    if not n:
        return 0, np.zeros(k), np.zeros(m), np.zeros((m, k)), 0.0
    means = np.array(got[1 : 1 + k + m], float)
    return n, means[:k], means[k:], np.array(got[1 + k + m : -1], float).reshape(m, k), float(got[-1])


def similarity(rows: DataFrame, src: list[str], dst: list[str], scale: float | None = None) -> np.ndarray:
    """The matrix (an affine one, shift last) of the similarity that takes src nearest to dst; ``scale`` fixes its scale.

    Without rows, or where all src are one point, it is the identity with the shift between the means.
    """
    n, mean_s, mean_d, cov, spread = moments(rows, src, dst)
    k = len(src)
    turn, size = np.eye(k), 1.0 if scale is None else scale
    if n and spread > 0:
        u, value, vt = np.linalg.svd(cov)
        flip = np.ones(k)
        flip[-1] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
        turn = u @ np.diag(flip) @ vt
        size = float((value * flip).sum() / spread) if scale is None else scale
    return np.column_stack([size * turn, mean_d - size * turn @ mean_s])


def moved(rows: DataFrame, axes: list[str], matrix: np.ndarray, names: list[str]) -> DataFrame:
    to = spatial.affine([F.col(a) for a in axes], matrix.tolist())
    return rows.withColumns(dict(zip(names, to)))


def icp(points: DataFrame, refs: DataFrame, key: str, ref: str, axes: list[str], rounds: int, trim: float = 0.9, scale: float | None = None) -> tuple[np.ndarray, float]:
    """Fit points to refs by turns: nearest refs, the ``trim`` share of smallest distance, a similarity fit.

    Returns the matrix and the root mean square of the trimmed distances under
    it.  The limit is the linear percentile.  Points and the index of refs are
    written once; each round is written and the one before it goes.
    """
    matrix = np.column_stack([np.eye(len(axes)), np.zeros(len(axes))])
    names, target = [f"m_{a}" for a in axes], [f"t_{a}" for a in axes]
    points, refs = durable(points, "moving"), durable(refs, "fixed")
    known = refs.select(F.col(ref), *[F.col(a).alias(t) for a, t in zip(axes, target)])
    fixed = nearest.index(refs, ref, axes)

    def met() -> DataFrame:
        at = moved(points, axes, matrix, names).select(key, *[F.col(m).alias(a) for m, a in zip(names, axes)])
        near = nearest.search(fixed, at, key) if fixed else nearest.nearest(at, refs, key, ref, axes)
        now = durable(near.join(known, ref).join(points, key), "icp")
        if fixed:
            discard(near)
        return now

    for _ in range(rounds):
        now = met()
        limit = stats.exact_quantile(now, "distance", trim)
        matrix = similarity(now.filter(F.col("distance") <= limit), axes, target, scale)
        discard(now)
    now = met()
    count = now.count()
    n = int(count * trim)
    # the n smallest distances: those below the last of them, and it for the rest; no task sorts the table
    last = stats.exact_quantile(now, "distance", (n - 1) / (count - 1) if count > 1 else 0.0) if n else None
    below = F.col("distance") < F.lit(last)
    held, total = now.agg(F.count_if(below), F.coalesce(F.sum(F.when(below, F.col("distance") ** 2)), F.lit(0.0))).first()
    least = math.sqrt((total + (n - held) * last**2) / n) if n else None
    discard(now, points, refs, *([fixed.blocks] if fixed else []))
    return matrix, least
