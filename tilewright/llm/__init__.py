"""Training-data operators: packing, deduplication, tokenisation, filtering, WARC, sharding.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; the
registered queries and their SQL are in ``queries``.
"""
