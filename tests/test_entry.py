import duckdb
import pytest

import __spark_entry__ as entry
from spanweave.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["edge_stats", "endpoint_stats", "tumbling_ingest_drop", "window_diff", "overlay_policy_merge", "quality_dimensions"])
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in cur.fetchall())
    assert sorted(str([r[c] for c in sorted(columns)]) for r in df.collect()) == want
