"""Spark jobs over large image libraries: catalogs, caches, raster pyramids and view logs."""
