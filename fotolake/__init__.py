"""Image collections as Spark tables: catalog, tags, geotags, rasters, plans."""

__version__ = "0.1.0"
