"""Distances together with their gradient in the first vector, for numpy rows and for DataFrames.

Each function takes matrices of equal shape and gives the distances of their
rows and the gradients, without changing its input. Rows where a formula has no
value (a zero denominator) get NaN there unless a rule is stated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructType

from karst.functions.metrics import _ratio

GRADIENTS: dict[str, Callable] = {}
_TINY = 1e-6


def _named(*names: str):
    def add(f):
        for n in names:
            GRADIENTS[n] = f
        return f

    return add


def _col(v):
    return v[:, None]


def _side(v):
    return np.where(v < 0, -1.0, 1.0)


@_named("euclidean", "l2")
def euclidean(x, y):
    d = np.sqrt(((x - y) ** 2).sum(1))
    return d, (x - y) / _col(_TINY + d)


@_named("seuclidean", "standardised_euclidean")
def standardised_euclidean(x, y, c=1.0):
    d = np.sqrt(((x - y) ** 2 / c).sum(1))
    return d, (x - y) / (_TINY + _col(d) * c)


@_named("manhattan", "l1", "taxicab")
def manhattan(x, y):
    return np.abs(x - y).sum(1), _side(x - y)


@_named("chebyshev", "linfinity", "linfty", "linf")
def chebyshev(x, y):
    d = np.abs(x - y)
    at = d.argmax(1)
    grad = np.zeros_like(d)
    rows = np.arange(len(d))
    grad[rows, at] = _side(x - y)[rows, at]
    return d.max(1, initial=0.0), grad


@_named("minkowski")
def minkowski(x, y, p=2.0):
    return weighted_minkowski(x, y, 1.0, p)


@_named("wminkowski", "weighted_minkowski")
def weighted_minkowski(x, y, c=1.0, p=2.0):
    """The outer exponent of the gradient is 1 / (p - 1); p = 1 has none."""
    e, w = np.abs(x - y), np.broadcast_to(np.asarray(c, float) ** p, x.shape)
    total = (w * e**p).sum(1)
    return total ** (1 / p), w * e ** (p - 1) * _side(x - y) * _col(total ** (1 / (p - 1)))


@_named("mahalanobis")
def mahalanobis(x, y, c=None):
    e = x - y
    g = e @ (np.eye(x.shape[1]) if c is None else c).T
    d = np.sqrt((e * g).sum(1))
    return d, g / _col(_TINY + d)


@_named("canberra")
def canberra(x, y):
    e, t = np.abs(x - y), np.abs(x) + np.abs(y)
    return _ratio(e, t).sum(1), _ratio(np.sign(x - y), t) - _ratio(e * np.sign(x), t * t)


@_named("braycurtis")
def bray_curtis(x, y):
    t = np.abs(x + y).sum(1)
    d = _ratio(np.abs(x - y).sum(1), t)
    return d, _ratio(np.sign(x - y) - _col(d), np.broadcast_to(_col(t), x.shape))


@_named("haversine")
def haversine(x, y):
    """Radians, the latitude measured from the pole."""
    if x.shape[1] != 2:
        raise ValueError("haversine is only defined for 2 dimensional data")
    lat, lon = x[:, 0] - y[:, 0], x[:, 1] - y[:, 1]
    cx, cy = np.cos(x[:, 0] + np.pi / 2), np.cos(y[:, 0] + np.pi / 2)
    a = np.sin(lat / 2) ** 2 + cx * cy * np.sin(lon / 2) ** 2
    d = 2 * np.arcsin(np.sqrt(np.clip(np.abs(a), 0, 1)))
    scale = np.sqrt(np.abs(a - 1)) * np.sqrt(np.abs(a))
    g = np.stack([np.sin(lat / 2) * np.cos(lat / 2) - np.sin(x[:, 0] + np.pi / 2) * cy * np.sin(lon / 2) ** 2, cx * cy * np.sin(lon / 2) * np.cos(lon / 2)], 1)
    return d, g / _col(scale + _TINY)


@_named("cosine")
def cosine(x, y):
    """Both zero: 0; one zero: 1; without gradient."""
    nx, ny, dot = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
    some = (nx > 0) & (ny > 0)
    d = np.where(some, 1 - _ratio(dot, np.sqrt(nx * ny)), np.where((nx == 0) & (ny == 0), 0.0, 1.0))
    g = -_ratio(x * _col(dot) - y * _col(nx), np.broadcast_to(_col(np.sqrt(nx**3 * ny)), x.shape))
    return d, np.where(_col(some), g, 0.0)


@_named("hellinger")
def hellinger(x, y):
    nx, ny, s = x.sum(1), y.sum(1), np.sqrt(x * y).sum(1)
    norm = np.sqrt(nx * ny)
    d = np.where((nx == 0) & (ny == 0), 0.0, np.where((nx == 0) | (ny == 0), 1.0, np.sqrt(np.maximum(0, 1 - _ratio(s, norm)))))
    with np.errstate(divide="ignore", invalid="ignore"):
        grad = (_col(_ratio(s, 2 * nx * norm)) - np.sqrt(y / x) / _col(2 * norm)) / _col(2 * d)
    return d, np.where(_col((nx == 0) | (ny == 0)), 0.0, grad)


@_named("symmetric_kl")
def symmetric_kl(x, y):
    x, y = x + 1e-11, y + 1e-11
    x, y = x / _col(x.sum(1)), y / _col(y.sum(1))
    return ((x - y) * np.log(x / y)).sum(1) / 2, (np.log(y / x) - x / y + 1) / 2


@_named("correlation")
def correlation(x, y):
    n = x.shape[1]
    x, y = x - _col(x.sum(1) / n), y - _col(y.sum(1) / n)
    nx, ny, dot = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
    some = (nx > 0) & (ny > 0) & (dot != 0)
    d = np.where((nx == 0) & (ny == 0), 0.0, np.where(dot == 0, 1.0, 1 - _ratio(dot, np.sqrt(nx * ny))))
    wide = lambda v: np.broadcast_to(_col(v), x.shape)
    return d, np.where(_col(some), (_ratio(x, wide(nx)) - _ratio(y, wide(dot))) * _col(d), 0.0)


@_named("hyperboloid")
def hyperboloid(x, y):
    """Points of the hyperboloid by their space coordinates."""
    s, t = np.sqrt(1 + (x * x).sum(1)), np.sqrt(1 + (y * y).sum(1))
    b = np.maximum(s * t - (x * y).sum(1), 1 + 1e-8)
    scale = 1 / (np.sqrt(b - 1) * np.sqrt(b + 1))
    return np.arccosh(b), _col(scale) * (x * _col(t / s) - y)


@_named("spherical_gaussian_energy")
def spherical_gaussian_energy(x, y):
    """Rows (mean 1, mean 2, spread); the energy of two round Gaussians."""
    m1, m2, s = x[:, 0] - y[:, 0], x[:, 1] - y[:, 1], np.abs(x[:, 2]) + np.abs(y[:, 2])
    q = m1 * m1 + m2 * m2
    return q / (2 * s) + np.log(s) + np.log(2 * np.pi), np.stack([m1 / s, m2 / s, np.sign(x[:, 2]) * (1 / s - q / (2 * s * s))], 1)


@_named("diagonal_gaussian_energy")
def diagonal_gaussian_energy(x, y):
    """Rows (mean 1, mean 2, spread 1, spread 2)."""
    m, s = x[:, :2] - y[:, :2], np.abs(x[:, 2:4]) + np.abs(y[:, 2:4])
    flat = (s[:, 0] * s[:, 1]) == 0
    with np.errstate(divide="ignore", invalid="ignore"):
        d = ((m * m / s).sum(1) + np.log(np.abs(s[:, 0] * s[:, 1]))) / 2 + np.log(2 * np.pi)
        g = np.concatenate([m / s, np.sign(x[:, 2:4]) * (1 / s - m * m / (s * s)) / 2], 1)
    return np.where(flat, (m * m).sum(1), d), np.where(_col(flat), np.array([0.0, 0.0, 1.0, 1.0]), g)


def _covariance(w, h, angle):
    c, s = np.cos(angle), np.sin(angle)
    return np.abs(w) * c * c + np.abs(h) * s * s, (np.abs(w) - np.abs(h)) * c * s, np.abs(w) * s * s + np.abs(h) * c * c


@_named("gaussian_energy")
def gaussian_energy(x, y):
    """Rows (mean 1, mean 2, width, height, angle), angles folded into a half turn: q / det + log det + log 2 pi of the summed covariances.

    The gradient is that of q / det alone, with ``1e-8`` in its denominator, and takes the mixed terms of height and angle with a minus: not a true derivative, but the rule this value is used with.
    """
    x, y = (np.c_[z[:, :4], np.arcsin(np.sin(z[:, 4]))] for z in (x, y))
    m1, m2 = (x[:, :2] - y[:, :2]).T
    a, b, c = (u + v for u, v in zip(_covariance(*x[:, 2:].T), _covariance(*y[:, 2:].T)))
    det = np.abs(a * c - b * b)
    flat = det < 1e-32
    q = c * m1 * m1 - 2 * b * m1 * m2 + a * m2 * m2
    w, h, angle = np.abs(x[:, 2]), np.abs(x[:, 3]), x[:, 4]
    cc, ss, cs = np.cos(angle) ** 2, np.sin(angle) ** 2, np.cos(angle) * np.sin(angle)
    turn = (h - w) * np.sin(2 * angle)
    # of width, height and angle: changes of a and c, the mixed term of q, the mixed term of the determinant
    ways = ((cc, ss, -2 * m1 * m2 * cs, -2 * b * cs), (ss, cc, -2 * m1 * m2 * cs, 2 * b * cs), (turn, -turn, 2 * m1 * m2 * (h - w) * np.cos(2 * angle), -2 * b * (h - w) * np.cos(2 * angle)))
    with np.errstate(divide="ignore", invalid="ignore"):
        d = q / det + np.log(det) + np.log(2 * np.pi)
        g = [2 * (c * m1 - b * m2) / det, 2 * (a * m2 - b * m1) / det]
        g += [((da * m2 * m2 + dc * m1 * m1 + mixed) * det - q * (da * c + dc * a + turned)) / (det * det + 1e-8) for da, dc, mixed, turned in ways]
    return np.where(flat, m1 * m1 + m2 * m2, d), np.where(_col(flat), np.array([0.0, 0, 1, 1, 0]), np.stack(g, 1))


def spherical_gaussian(x, y):
    """As the energy, with the signed sum of the spreads; a sum of 0 gives 10 and (0, 0, -1)."""
    m1, m2, s = x[:, 0] - y[:, 0], x[:, 1] - y[:, 1], x[:, 2] + y[:, 2]
    side, flat = _side(s), s == 0
    q = m1 * m1 + m2 * m2
    safe = np.where(flat, 1.0, s)
    d = q / np.abs(safe) + 2 * np.log(np.abs(safe)) + np.log(2 * np.pi)
    g = np.stack([2 * m1 / np.abs(safe), 2 * m2 / np.abs(safe), side * (-q / safe**2 + 2 / np.abs(safe))], 1)
    return np.where(flat, 10.0, d), np.where(_col(flat), np.array([0.0, 0.0, -1.0]), g)


def with_gradient(pairs: DataFrame, name: str, x: str, y: str, out: str = "gradient", **params) -> DataFrame:
    """``pairs`` with ``out: struct<d, grad>``; one narrow Arrow pass."""
    f = GRADIENTS[name]
    schema = StructType([*pairs.schema.fields]).add(out, StructType().add("d", DoubleType()).add("grad", ArrayType(DoubleType())))
    names = [*pairs.columns, out]
    at = (names.index(x), names.index(y))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            a, c = (np.asarray(b.column(i).flatten(), float).reshape(b.num_rows, -1) for i in at)
            d, g = f(a, c, **params)
            grad = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * g.shape[1]), pa.array(g.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays([pa.array(d), grad], ["d", "grad"])], names=names)

    return pairs.mapInArrow(rows, schema)
