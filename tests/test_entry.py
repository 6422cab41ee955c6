import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 80


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 30 and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["content_hash", "record_id_uuid5", "token_estimate", "filter_not", "upsert_replace", "stale_delete", "classify_rank_mode", "rank_metrics", "tune_gate", "usage_latency", "evidence_match"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    result = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    plain = lambda r: tuple(round(float(x), 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(repr, map(plain, df.select(columns).collect()))) == sorted(map(repr, map(plain, result)))


def test_core_does_not_import_llm():
    root = os.path.join(os.path.dirname(entry.__file__), "loam")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "loam.llm" not in f.read(), name
