"""Sparse vectors as ``struct<indices: array<int>, values: array<float>>`` and distances between them.

Sums, differences and products are merged maps; zeros never stay. A metric of
two sparse vectors is the dense metric of their dense forms: coordinates outside
the union of the index sets add nothing, so the dense declaration is folded over
the union and given the true number of dimensions where it needs it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from karst.functions import metrics

#: Metrics whose formula uses the number of dimensions.
NEED_FEATURES = ("hamming", "matching", "kulsinski", "rogerstanimoto", "russellrao", "sokalmichener", "correlation", "yule")
#: Metrics that have a sparse form: those whose terms vanish where both values are zero.
SPARSE = tuple(n for n in metrics.names() if metrics.REGISTRY[n].name not in ("haversine", "symmetric_kl", "seuclidean", "wminkowski", "mahalanobis"))


def as_map(v: Column) -> Column:
    return F.map_from_arrays(v["indices"], F.transform(v["values"], lambda z: z.cast("double")))


def union(x: Column, y: Column) -> Column:
    return F.array_sort(F.array_union(x, y))


def intersect(x: Column, y: Column) -> Column:
    return F.array_sort(F.array_intersect(x, y))


def unique(x: Column) -> Column:
    return F.array_sort(F.array_distinct(x))


def _merged(x: Column, y: Column, combine) -> Column:
    zero = F.lit(0.0)
    both = F.map_zip_with(as_map(x), as_map(y), lambda k, a, b: combine(F.coalesce(a, zero), F.coalesce(b, zero)))
    return from_map(F.map_filter(both, lambda k, v: v != 0))


def from_map(m: Column) -> Column:
    entries = F.array_sort(F.map_entries(m))
    return F.struct(F.transform(entries, lambda e: e["key"]).alias("indices"), F.transform(entries, lambda e: e["value"]).alias("values"))


def add(x: Column, y: Column) -> Column:
    return _merged(x, y, lambda a, b: a + b)


def subtract(x: Column, y: Column) -> Column:
    return _merged(x, y, lambda a, b: a - b)


def multiply(x: Column, y: Column) -> Column:
    return _merged(x, y, lambda a, b: a * b)


def sparsify(dense: Column, least: float = 0.0) -> Column:
    """Coordinates with magnitude over ``least``."""
    kept = F.filter(F.transform(dense, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: F.abs(e["v"]) > least)
    return F.struct(F.transform(kept, lambda e: e["i"]).alias("indices"), F.transform(kept, lambda e: e["v"]).alias("values"))


def densify(v: Column, n_features: int) -> Column:
    m = as_map(v)
    return F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda i: F.coalesce(m[i], F.lit(0.0)))


def aligned(x: Column, y: Column) -> tuple[Column, Column]:
    """Both vectors as dense arrays over the union of their indices."""
    keys, a, b = union(x["indices"], y["indices"]), as_map(x), as_map(y)
    return F.transform(keys, lambda k: F.coalesce(a[k], F.lit(0.0))), F.transform(keys, lambda k: F.coalesce(b[k], F.lit(0.0)))


def distance(df, name: str, x: str, y: str, out: str = "distance", n_features: int | None = None, **params):
    """``df`` with the distance of two sparse columns; ``n_features`` is needed by ``NEED_FEATURES``."""
    m = metrics.lookup(name)
    if name not in SPARSE:
        raise ValueError(f"{name} has no sparse form")
    if m.name in NEED_FEATURES and n_features is None:
        raise ValueError(f"{name} needs n_features")
    a, b = aligned(F.col(x), F.col(y))
    wide = df.withColumns({"__x": a, "__y": b})
    if m.name == "correlation":
        value = _correlation("__x", "__y", n_features)
    else:
        value = metrics.distance(name, "__x", "__y", size=n_features, **params)
    return wide.withColumn(out, value).drop("__x", "__y")


def _correlation(x: str, y: str, n: int) -> Column:
    """Centred sums of the stored coordinates, corrected for those that are zero in both."""
    s = lambda z: f"aggregate({z}, 0D, (s, t) -> s + t)"
    dot = s(f"zip_with({x}, {y}, (a, b) -> a * b)")
    nx, ny = (s(f"transform({v}, a -> a * a)") for v in (x, y))
    sx, sy = s(x), s(y)
    c = lambda q, u, v: f"({q} - {u} * {v} / {n})"
    vx, vy, cov = c(nx, sx, sx), c(ny, sy, sy), c(dot, sx, sy)
    return F.expr(f"case when {vx} <= 0 and {vy} <= 0 then 0D when {cov} = 0 or {vx} <= 0 or {vy} <= 0 then 1D else 1 - {cov} / sqrt({vx} * {vy}) end")
