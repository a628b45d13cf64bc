"""Registered queries beside their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from odweave.plans.oracle import all_oracles
from odweave.plans.queries import all_queries
from odweave.session import TABLES

SF = "/root/testdata/sf0.001"


def _same(x):
    if isinstance(x, float):
        return f"{x:.8g}"
    return str(x)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, con, name):
    df = all_queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(_same(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(all_oracles()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(_same(r[i]) for i in at) for r in rel.fetchall())


@pytest.fixture(scope="module")
def many_lines(tmp_path_factory):
    """Tables with a region of over 10,000 suppliers, so as many lines, and their views."""
    d, c = tmp_path_factory.mktemp("many_lines"), duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem"):
        os.symlink(f"{SF}/{t}.parquet", d / f"{t}.parquet")
    c.sql(f"CREATE TABLE ten AS SELECT * FROM '{SF}/supplier.parquet'")
    c.sql(f"COPY (SELECT * FROM ten UNION ALL SELECT * EXCLUDE (i) REPLACE (100 + i AS s_suppkey, 0 AS s_nationkey) FROM range(10_030) r(i), (SELECT * FROM ten LIMIT 1)) TO '{d}/supplier.parquet' (FORMAT parquet)")
    for t in os.listdir(d):
        c.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{d}/{t}'")
    return str(d), c


@pytest.mark.parametrize("name", ["package_line_attributes", "package_segment_results", "package_transit_lines", "package_transit_segments"])
def test_lines_past_four_digits(spark, many_lines, name):
    sf, con = many_lines
    df, rel = all_queries()[name](spark, sf), con.sql(all_oracles()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(_same(r[i]) for i in at) for r in rel.fetchall())
    assert len(want) > 10_000 and sorted(tuple(_same(r[c]) for c in cols) for r in df.collect()) == want


def _counted(df, seen):
    """df, adding its rows to `seen` each time they are made."""

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema)


@pytest.mark.parametrize("name", ["matrix_file_round_trip", "balance_2d_converged", "balance_2d_k_iters", "od_coerce_square", "zone_indexers", "bucket_round_hundreds"])
def test_flows_are_made_once(spark, monkeypatch, name):
    from odweave.plans import queries

    seen, flows = spark.sparkContext.accumulator(0), queries.nation_flows
    monkeypatch.setattr(queries, "nation_flows", lambda s, d: _counted(flows(s, d), seen))
    assert all_queries()[name](spark, SF).collect()
    assert seen.value == flows(spark, SF).count()
