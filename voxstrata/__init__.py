"""Volumetric analytics on Spark: volumes are relations of (c, z, y, x, v)."""

__version__ = "0.1.0"
