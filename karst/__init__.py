"""Neighbourhood analytics, manifold projection and corpus operators on Spark."""

from importlib.metadata import PackageNotFoundError, version

try:
    __version__ = version("karst")
except PackageNotFoundError:
    __version__ = "0.1.0"
