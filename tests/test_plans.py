"""Every query against its SQL, and the plans that scale depends on."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sigloom import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    return "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    if name not in plans.ORACLE:
        assert rows
        return
    want = duck.sql(plans.ORACLE[name])
    assert columns == sorted(want.columns)
    assert rows == sorted(tuple(map(plain, r)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_reference_maps_of_places_that_are_whole_but_for_rounding(spark, tmp_path):
    """One alignment of sf0.1 where the order of two additions decides a sample."""
    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.1/lineitem.parquet' WHERE l_orderkey = 54674) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = plans.QUERIES["p15_reference_maps"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == c.sql(plans.ORACLE["p15_reference_maps"]).fetchall() != []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_read_only_what_is_used(spark):
    plan = plans.QUERIES["r1_split_by_read"](spark, FOLDER)._jdf.queryExecution().toString()
    scan = plan[plan.index("== Physical") :]
    assert "ReadSchema: struct<doc_id:bigint>" in scan
    gate = plans.QUERIES["r21_quality_gate"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice)" in gate


def test_nothing_else_needs_the_training_data_package():
    root = os.path.dirname(plans.__file__) + "/.."
    for folder, _, names in os.walk(root):
        if "llm" not in folder:
            assert not any("llm" in open(os.path.join(folder, n)).read() for n in names if n.endswith(".py"))
