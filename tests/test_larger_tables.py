"""Queries on keys as they are in larger tables, against their SQL: images that share a path, sizes of a terabyte."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

#: Of one directory; many of them have the same name.
PARTS = [21 * 700 * 24 // 7 * k + r for k in range(6) for r in (3, 6, 7, 8, 9, 12, 14, 18, 22, 28, 33, 36, 42)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("larger"))
    parts = [(k, f"name {k % 5}", "Brand#1", "STEEL", 1 + k % 50) for k in sorted(PARTS, reverse=True)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{folder}/part.parquet")
    lines = [(k, line) for k in (0, 1, 150_000, 785_000, 900_000, 36_000_000) for line in range(1, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def both(spark, folder, name):
    """The query's rows and its SQL's, as bags."""
    db = duckdb.connect()
    for table in ("part", "lineitem"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    return Counter(map(tuple, entry.queries()[name](spark, folder).select(*columns).collect())), Counter(found.fetchall())


@pytest.mark.parametrize("name", ["format_size", "open_paths", "preload_delta"])
def test_same_as_sql(spark, tables, name):
    got, want = both(spark, tables, name)
    assert got == want


def test_images_of_one_path_are_listed_by_number(spark, tables):
    """SQL leaves the order of rows with one path open; here they are numbered the same way in every run."""
    from tilewright.plans.library_queries import _placed

    rows = _placed(spark, tables).select("path", "image_id", "position").collect()
    assert len({r["path"] for r in rows}) < len(rows)
    ordered = sorted(rows, key=lambda r: r["position"])
    assert [r["position"] for r in ordered] == list(range(len(rows)))
    assert all(a["image_id"] < b["image_id"] for a, b in zip(ordered, ordered[1:]) if a["path"] == b["path"])
    got, want = both(spark, tables, "catalog_listing")
    untied = lambda bag: Counter(k[:3] for k in bag.elements())
    assert untied(got) == untied(want)
