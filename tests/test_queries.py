"""Every registered query against its SQL, and its independence from partition counts."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from pageloom.plans.registry import PLANS  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()  # imports the modules that register queries
QUERIES = {name: entry.queries()[name] for name in PLANS}


@pytest.fixture(scope="module")
def db():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    assert name in SQL
    assert oracle.difference(QUERIES[name](spark, FOLDER), db, SQL[name]) is None


@pytest.mark.parametrize("name", ["flagship", "walk_depth", "kv_zset_open", "upsert_latest", "kw_union_except"])
def test_partition_count_changes_nothing(spark, name):
    rows = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(str, QUERIES[name](spark, FOLDER).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert rows[0] == rows[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["host", "new_urls"] and df.count() > 0
