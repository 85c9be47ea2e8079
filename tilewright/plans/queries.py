"""All registered queries over the given tables and their DuckDB SQL."""

from . import file_queries, header_queries, io_queries, library_queries, raster_queries, stream_queries, view_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
