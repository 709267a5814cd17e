import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_registry():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and {"p2_found", "p6_found"} <= set(q) and all(map(callable, q.values()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["p6_found", "kb_mapping", "policy_select", "summary_third_parties", "explorer_filter", "third_party_pairs"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).columns == ["field", "key_value"]
