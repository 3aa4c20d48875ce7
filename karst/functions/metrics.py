"""Distances between dense vectors, each as a SQL expression and as a numpy block function.

A metric is declared once as named sums over the coordinates ``a`` of x and ``b``
of y (``e = a - b``, ``c`` the metric's own parameter at that coordinate) and a
formula over them; steps may use earlier names. The declaration gives a Spark
expression of higher-order functions; the block functions are separate numpy
code for nearest-neighbour scans, and tests hold the two against each other.

Edge rules: a zero vector is at cosine distance 1 from any other and 0 from
another zero vector; metrics of vectors of unequal length are null (SQL) or an
error (blocks); parameters must have the vectors' length.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    name: str
    steps: tuple[tuple[str, str], ...]  # name, sum over coordinates of a term (or "max: term", "= expression")
    formula: str
    block: Callable[..., np.ndarray]
    aliases: tuple[str, ...] = ()
    params: tuple[str, ...] = ()
    angular: bool = False
    needs: str = "any"  # any, nonnegative, ball, pair (2-d), counts, bits


REGISTRY: dict[str, Metric] = {}


def _metric(name: str, steps: str, formula: str, aliases: str = "", **more) -> Callable:
    def register(block: Callable) -> Callable:
        parsed = tuple(tuple(p.strip() for p in s.split(":=")) for s in steps.split(";") if s.strip())
        m = Metric(name, parsed, formula, block, tuple(aliases.split()), **more)
        for n in (name, *m.aliases):
            REGISTRY[n] = m
        return block

    return register


_NE = "ne := if((a <> 0) <> (b <> 0), 1D, 0D)"
_TT = "tt := if(a <> 0 and b <> 0, 1D, 0D)"


def _sum(x):
    return x.sum(axis=-1)


def _bits(x, y):
    x, y = np.broadcast_arrays(x != 0, y != 0)
    return _sum(x & y), _sum(x != y), x.shape[-1]


def _ratio(top, bottom, empty=0.0):
    top, bottom = np.broadcast_arrays(np.asarray(top, float), np.asarray(bottom, float))
    return np.divide(top, bottom, out=np.full(top.shape, empty), where=bottom != 0)


@_metric("euclidean", "s := e * e", "sqrt(s)", "l2")
def _(x, y):
    return np.sqrt(_sum((x - y) ** 2))


@_metric("manhattan", "s := abs(e)", "s", "taxicab l1")
def _(x, y):
    return _sum(np.abs(x - y))


@_metric("chebyshev", "m := max: abs(e)", "m", "linfinity linfty linf")
def _(x, y):
    return np.abs(x - y).max(axis=-1, initial=0.0)


@_metric("minkowski", "s := pow(abs(e), {p})", "pow(s, 1D / {p})", params=("p",))
def _(x, y, p=2.0):
    return _sum(np.abs(x - y) ** p) ** (1 / p)


@_metric("poincare", "s := e * e; nx := a * a; ny := b * b", "acosh(1 + 2 * s / ((1 - nx) * (1 - ny)))", needs="ball")
def _(x, y):
    return np.arccosh(1 + 2 * _sum((x - y) ** 2) / ((1 - _sum(x * x)) * (1 - _sum(y * y))))


@_metric("seuclidean", "s := e * e / c", "sqrt(s)", "standardised_euclidean", params=("c",))
def _(x, y, c=1.0):
    return np.sqrt(_sum((x - y) ** 2 / c))


@_metric("wminkowski", "s := pow(c * abs(e), {p})", "pow(s, 1D / {p})", "weighted_minkowski", params=("c", "p"))
def _(x, y, c=1.0, p=2.0):
    return _sum((c * np.abs(x - y)) ** p) ** (1 / p)


@_metric("mahalanobis", "s := e * rowdot(c)", "sqrt(s)", params=("c",))
def _(x, y, c=None):
    d = x - y
    return np.sqrt(_sum(d * (d @ (np.eye(d.shape[-1]) if c is None else c).T)))


@_metric("canberra", "s := if(abs(a) + abs(b) > 0, abs(e) / (abs(a) + abs(b)), 0D)", "s")
def _(x, y):
    return _sum(_ratio(np.abs(x - y), np.abs(x) + np.abs(y)))


@_metric("cosine", "dot := a * b; nx := a * a; ny := b * b", "case when nx = 0 and ny = 0 then 0D when nx = 0 or ny = 0 then 1D else 1 - dot / sqrt(nx * ny) end", angular=True)
def _(x, y):
    nx, ny = _sum(x * x), _sum(y * y)
    return np.where((nx == 0) & (ny == 0), 0.0, 1 - _ratio(_sum(x * y), np.sqrt(nx * ny)))


@_metric("correlation", "mx := a / d; my := b / d; dot := (a - mx) * (b - my); nx := (a - mx) * (a - mx); ny := (b - my) * (b - my)", "case when nx = 0 and ny = 0 then 0D when dot = 0 then 1D else 1 - dot / sqrt(nx * ny) end", angular=True)
def _(x, y):
    n = x.shape[-1]
    x, y = x - _sum(x / n)[..., None], y - _sum(y / n)[..., None]
    nx, ny, dot = _sum(x * x), _sum(y * y), _sum(x * y)
    return np.where((nx == 0) & (ny == 0), 0.0, np.where(dot == 0, 1.0, 1 - _ratio(dot, np.sqrt(nx * ny))))


@_metric("hellinger", "s := sqrt(a * b); nx := a; ny := b", "case when nx = 0 and ny = 0 then 0D when nx = 0 or ny = 0 then 1D else sqrt(greatest(0D, 1 - s / sqrt(nx * ny))) end", needs="nonnegative", angular=True)
def _(x, y):
    nx, ny = _sum(x), _sum(y)
    return np.where((nx == 0) & (ny == 0), 0.0, np.sqrt(np.maximum(0, 1 - _ratio(_sum(np.sqrt(x * y)), np.sqrt(nx * ny)))))


@_metric("haversine", "", "2 * asin(sqrt(pow(sin((x1 - y1) / 2), 2) + cos(x1) * cos(y1) * pow(sin((x2 - y2) / 2), 2)))", needs="pair")
def _(x, y):
    if x.shape[-1] != 2:
        raise ValueError("haversine is only defined for 2 dimensional data")
    h = np.sin((x - y) / 2) ** 2
    return 2 * np.arcsin(np.sqrt(h[..., 0] + np.cos(x[..., 0]) * np.cos(y[..., 0]) * h[..., 1]))


@_metric("braycurtis", "s := abs(e); t := abs(a + b)", "if(t > 0, s / t, 0D)")
def _(x, y):
    return _ratio(_sum(np.abs(x - y)), _sum(np.abs(x + y)))


@_metric("symmetric_kl", "nx := a + 1e-11; ny := b + 1e-11; s := ((a + 1e-11) / nx - (b + 1e-11) / ny) * ln(((a + 1e-11) / nx) / ((b + 1e-11) / ny))", "s / 2", needs="nonnegative")
def _(x, y):
    x, y = x + 1e-11, y + 1e-11
    x, y = x / _sum(x)[..., None], y / _sum(y)[..., None]
    return _sum((x - y) * np.log(x / y)) / 2


@_metric("hamming", "s := if(a <> b, 1D, 0D)", "s / d", needs="bits")
def _(x, y):
    return _sum(x != y) / x.shape[-1]


@_metric("jaccard", f"{_NE}; {_TT}", "if(ne + tt > 0, ne / (ne + tt), 0D)", angular=True, needs="bits")
def _(x, y):
    tt, ne, _ = _bits(x, y)
    return _ratio(ne, ne + tt)


@_metric("dice", f"{_NE}; {_TT}", "if(ne > 0, ne / (2 * tt + ne), 0D)", angular=True, needs="bits")
def _(x, y):
    tt, ne, _ = _bits(x, y)
    return _ratio(ne, 2 * tt + ne)


@_metric("matching", _NE, "ne / d", needs="bits")
def _(x, y):
    _, ne, d = _bits(x, y)
    return ne / d


@_metric("kulsinski", f"{_NE}; {_TT}", "if(ne > 0, (ne - tt + d) / (ne + d), 0D)", needs="bits")
def _(x, y):
    tt, ne, d = _bits(x, y)
    return np.where(ne == 0, 0.0, (ne - tt + d) / (ne + d))


@_metric("rogerstanimoto", _NE, "2 * ne / (d + ne)", "sokalmichener", needs="bits")
def _(x, y):
    _, ne, d = _bits(x, y)
    return 2 * ne / (d + ne)


@_metric("russellrao", f"{_TT}; nx := if(a <> 0, 1D, 0D); ny := if(b <> 0, 1D, 0D)", "if(tt = nx and tt = ny, 0D, (d - tt) / d)", needs="bits")
def _(x, y):
    tt, _, d = _bits(x, y)
    return np.where((tt == _sum(x != 0)) & (tt == _sum(y != 0)), 0.0, (d - tt) / d)


@_metric("sokalsneath", f"{_NE}; {_TT}", "if(ne > 0, ne / (0.5D * tt + ne), 0D)", needs="bits")
def _(x, y):
    tt, ne, _ = _bits(x, y)
    return _ratio(ne, 0.5 * tt + ne)


@_metric("yule", f"{_TT}; tf := if(a <> 0 and b = 0, 1D, 0D); ft := if(a = 0 and b <> 0, 1D, 0D)", "if(tf = 0 or ft = 0, 0D, 2 * tf * ft / (tt * (d - tt - tf - ft) + tf * ft))", needs="bits")
def _(x, y):
    tt, ne, d = _bits(x, y)
    tf = _sum(np.logical_and(x != 0, y == 0))
    ft = ne - tf
    return np.where((tf == 0) | (ft == 0), 0.0, _ratio(2 * tf * ft, tt * (d - tt - ne) + tf * ft))


def log_gamma(x):
    """Stirling's series to 1 / (12 x), and 0 at 1."""
    return np.where(x == 1, 0.0, x * np.log(x) - x + 0.5 * np.log(2 * np.pi / x) + 1 / (12 * x))


def log_beta(x, y):
    """Of the pair's smaller a and larger b: the product form for b under 5, else by log_gamma."""
    a, b = np.minimum(x, y), np.maximum(x, y)
    small = -np.log(b)
    for i in range(1, 5):
        small = small + np.where(i <= np.floor(a) - 1, np.log(i) - np.log(b + i), 0.0)
    return np.where(b < 5, small, log_gamma(a) + log_gamma(b) - log_gamma(a + b))


def log_single_beta(x):
    return np.log(2.0) * (-2 * x + 0.5) + 0.5 * np.log(2 * np.pi / x) + 0.125 / x


def _lg(x):
    return f"if({x} = 1, 0D, {x} * ln({x}) - {x} + 0.5D * ln(2 * pi() / {x}) + 1 / (12 * {x}))"


def _lb(x, y):
    a, b = f"least({x}, {y})", f"greatest({x}, {y})"
    terms = "".join(f" + if({i} <= floor({a}) - 1, ln({i}D) - ln({b} + {i}), 0D)" for i in range(1, 5))
    return f"if({b} < 5, -ln({b}){terms}, {_lg(a)} + {_lg(b)} - ({_lg(f'({x} + {y})')}))"


def _ls(x):
    return f"(ln(2D) * (-2 * {x} + 0.5D) + 0.5D * ln(2 * pi() / {x}) + 0.125D / {x})"


@_metric(
    "ll_dirichlet",
    f"nx := a; ny := b; lb := if(a * b > 0.9D, {_lb('a', 'b')}, 0D); sx := if(a > 0.9D, {_ls('a')}, 0D); sy := if(b > 0.9D, {_ls('b')}, 0D)",
    f"sqrt((lb - ({_lb('nx', 'ny')}) - (sy - {_ls('ny')})) / ny + (lb - ({_lb('nx', 'ny')}) - (sx - {_ls('nx')})) / nx)",
    needs="counts",
    angular=True,
)
def _(x, y):
    x, y = np.broadcast_arrays(x, y)
    nx, ny = _sum(x), _sum(y)
    safe = lambda v: np.where(v > 0.9, v, 1.0)
    lb = _sum(np.where(x * y > 0.9, log_beta(safe(x), safe(y)), 0.0))
    sx, sy = (_sum(np.where(v > 0.9, log_single_beta(safe(v)), 0.0)) for v in (x, y))
    both = log_beta(nx, ny)
    return np.sqrt((lb - both - (sy - log_single_beta(ny))) / ny + (lb - both - (sx - log_single_beta(nx))) / nx)


#: Distances of plain values, by function below.
SCALAR = ("categorical", "ordinal", "hierarchical_categorical", "count", "string")


def names() -> list[str]:
    """All names of vector metrics, aliases included."""
    return sorted(REGISTRY)


def lookup(name: str) -> Metric:
    if name not in REGISTRY:
        raise ValueError(f"unknown metric {name!r}")
    return REGISTRY[name]


def distance(name: str, x: str, y: str, size: int | None = None, **params) -> Column:
    """The distance of two array columns; see ``expression``."""
    return F.expr(expression(name, x, y, size, **params))


def expression(name: str, x: str, y: str, size: int | None = None, **params) -> str:
    """SQL for the distance of two array columns.

    ``c`` (array, or matrix) and ``p`` are the metric's parameters; ``size`` is
    the number of dimensions where the arrays leave out common zeros.
    """
    m = lookup(name)
    if unknown := set(params) - set(m.params):
        raise ValueError(f"{name} takes no {sorted(unknown)}")
    p = repr(float(params.get("p", 2.0))) + "D"
    known = {"d": f"size({x})" if size is None else f"{size}", "x1": f"{x}[0]", "x2": f"{x}[1]", "y1": f"{y}[0]", "y2": f"{y}[1]"}

    for name_, _ in m.steps:
        known[name_] = f"v_{name_}"

    def bound(text: str) -> str:
        return re.sub(r"\b[a-z]\w*\b", lambda w: known.get(w[0], w[0]), text.replace("{p}", p))

    c = params.get("c")
    out = bound(m.formula)
    for name_, term in reversed(m.steps):  # each step is bound once: the formula stands inside a lambda over it
        best, term = term.startswith("max:"), bound(term.removeprefix("max:").strip())
        if "rowdot(c)" in term and c is None:
            values = f"zip_with({x}, {y}, (a, b) -> (a - b) * (a - b))"  # the identity
        elif "rowdot(c)" in term:
            diff = f"zip_with({x}, {y}, (a, b) -> a - b)"
            rows = "array(" + ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in row) + ")" for row in np.asarray(c)) + ")"
            values = f"zip_with({diff}, {rows}, (e, r) -> e * aggregate(zip_with(r, {diff}, (u, v) -> u * v), 0D, (s, t) -> s + t))"
        elif "c" in m.params and c is not None:
            weights = "array(" + ", ".join(f"{float(v)!r}D" for v in c) + ")"
            values = f"zip_with(zip_with({x}, {y}, (a, b) -> a - b), {weights}, (e, c) -> {term})"
        else:
            plain = term.replace("c * ", "").replace(" / c", "")
            values = f"zip_with({x}, {y}, (a, b) -> {re.sub(chr(92) + 'be' + chr(92) + 'b', '(a - b)', plain)})"
        fold = f"aggregate({values}, 0D, (s, t) -> {'greatest(s, t)' if best else 's + t'})"
        out = f"transform(array({fold}), v_{name_} -> {out})[0]"
    return out


def block(name: str, x: np.ndarray, y: np.ndarray, **params) -> np.ndarray:
    """Distances of all rows of x to all rows of y, row by row of x so that memory stays at ``len(y) * d``."""
    m = lookup(name)
    if x.shape[-1] != y.shape[-1]:
        raise ValueError("vectors of unequal length")
    out = np.empty((len(x), len(y)))
    for i, row in enumerate(x):
        out[i] = m.block(row[None, :], y, **params)
    return out


# scalar values -----------------------------------------------------------------


def categorical(x: Column, y: Column) -> Column:
    return F.when(x == y, 0.0).otherwise(1.0)


def ordinal(x: Column, y: Column, support: float | Column = 1.0) -> Column:
    return F.abs(x - y) / support


def hierarchical_categorical(levels: list[tuple[Column, Column]]) -> Column:
    """``levels`` from the finest: the share of levels below the first at which both agree; 1 if none."""
    out = F.lit(1.0)
    for n, (x, y) in reversed(list(enumerate(levels))):
        out = F.when(x == y, n / len(levels)).otherwise(out)
    return out


def count_distance(x: Column, y: Column, rate: float | Column = 1.0, norm: float | Column = 1.0) -> Column:
    """Sum of Poisson log-likelihoods of the counts from the lower up to but without the higher."""
    lo, hi = F.least(x, y).cast("int"), F.greatest(x, y).cast("int")
    rate, norm = (v if isinstance(v, Column) else F.lit(float(v)) for v in (rate, norm))
    log_factorial = lambda k: F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda s, i: s + F.log(F.greatest(i, F.lit(1)).cast("double")))
    return F.when(hi == lo, 0.0).otherwise(F.aggregate(F.sequence(lo, hi - 1), F.lit(0.0), lambda s, k: s + k * F.log(rate) - rate - log_factorial(k))) / norm


def string_distance(x: Column, y: Column, normalisation: float = 1.0, longest_gap: int = 20) -> Column:
    """Levenshtein distance; strings whose lengths differ by more than ``longest_gap`` are that many apart."""
    gap = F.abs(F.length(x) - F.length(y))
    return F.when(gap > longest_gap, gap).otherwise(F.levenshtein(x, y)) / F.lit(float(normalisation))


def sign(x: Column) -> Column:
    """-1 below zero, else 1."""
    return F.when(x < 0, -1.0).otherwise(1.0)


def sinkhorn(x: np.ndarray, y: np.ndarray, kernel: np.ndarray, cost: np.ndarray, rounds: int = 64) -> float:
    """Transport cost after ``rounds`` scalings of ``kernel`` towards the marginals x and y (scaled to sum 1)."""
    p, q = x / x.sum(), y / y.sum()
    u, v = np.ones_like(p), np.ones_like(q)
    for _ in range(rounds):
        t = kernel @ v
        u = np.where(t > 0, _ratio(p, t), u)
        t = kernel.T @ u
        v = np.where(t > 0, _ratio(q, t), v)
    plan = v[:, None] * kernel * u[None, :]
    return float((plan * cost)[plan > 0].sum())


def register(spark, prefix: str = "dist_") -> list[str]:
    """Makes every vector metric a SQL function of two arrays, ``dist_euclidean(x, y)`` and so on; gives their names."""
    made = []
    for name in names():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x ARRAY<DOUBLE>, y ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {expression(name, 'x', 'y')}")
        made.append(prefix + name)
    return made
