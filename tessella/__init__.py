"""Raster-tile analytics on Spark: image collections as tables of tiles."""

__version__ = "0.1.0"
