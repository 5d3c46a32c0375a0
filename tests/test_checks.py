"""Every registered query against its SQL on the smallest data folder, a family at a time."""

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from check import kinds, rows_of
from tracelode.plans import CHECKS, QUERIES
from tracelode.plans.registry import tables
from tracelode.sources.views import BASE_TABLES

FOLDER = "/root/testdata/sf0.001"
FAMILIES = defaultdict(list)
for _name in sorted(CHECKS):
    FAMILIES[_name.split("_")[0]].append(_name)


@pytest.fixture(scope="module")
def duck(spark):
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    for stored in ("v_unit", "v_locator", "v_embedding", "v_visible", "v_dense"):
        tables(spark, FOLDER)(stored)
    return con


@pytest.mark.parametrize("family", FAMILIES)
def test_queries_equal_sql(spark, duck, family):
    def run(name):
        frame = QUERIES[name](spark, FOLDER)
        return frame.columns, [tuple(r) for r in frame.collect()]

    with ThreadPoolExecutor(6) as pool:
        found = dict(zip(FAMILIES[family], pool.map(run, FAMILIES[family]), strict=True))
    for name, (columns, got) in found.items():
        result = duck.execute(CHECKS[name])
        wanted = [d[0] for d in result.description]
        want = result.fetchall()
        assert sorted(wanted) == sorted(columns), name
        assert rows_of(columns, got) == rows_of(wanted, want), name
        assert kinds(got, columns) == kinds(want, wanted), name


def test_every_query_has_sql():
    assert set(QUERIES) == set(CHECKS)
