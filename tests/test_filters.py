import os

import pytest

from loam.functions import filters
from loam.sources import stores
from loam.sources.stores import to_sql

ROWS = [("a", "d1", 0, "billing", 0.9, True), ("b", "d1", 1, "auth", 0.5, False), ("c", "d2", 0, "billing", 0.2, True), ("d", "d2", 1, "api", 0.7, None), ("e", "d3", 0, None, 0.1, False)]
CASES = [
    # the portable language, operators first
    ({"eq": {"tag": "billing"}}, "ac"), ({"ne": {"tag": "billing"}}, "bd"), ({"in": {"tag": ["auth", "api"]}}, "bd"), ({"nin": {"tag": ["auth", "api"]}}, "ac"),
    ({"gt": {"score": 0.5}}, "ad"), ({"gte": {"score": 0.5}}, "abd"), ({"lt": {"score": 0.2}}, "e"), ({"lte": {"score": 0.2}}, "ce"), ({"not": {"exists": "tag"}}, "e"),
    ({"eq": {"flag": True}}, "ac"), ({"eq": {"flag": False}}, "be"), ({"eq": {"chunk_index": 1}}, "bd"), ({"exists": "tag"}, "abcd"),
    ({"and": [{"eq": {"doc_id": "d1"}}, {"eq": {"tag": "auth"}}]}, "b"), ({"or": [{"eq": {"doc_id": "d3"}}, {"eq": {"tag": "api"}}]}, "de"), ({"not": {"eq": {"doc_id": "d1"}}}, "cde"),
    ({"not": {"or": [{"eq": {"doc_id": "d1"}}, {"eq": {"doc_id": "d2"}}]}}, "e"), ({"eq": {"doc_id": "d1"}, "gte": {"score": 0.6}}, "a"), ({"eq": {"doc_id": "d1", "chunk_index": 0}}, "a"), ({"eq": {"flag": 1}}, ""), ({"ne": {"flag": 1}}, "abce"),
    # the short form
    ({"tag": {"eq": "billing"}}, "ac"), ({"tag": {"in": ["auth", "api"]}}, "bd"), ({"score": {"gt": 0.2, "lt": 0.9}}, "bd"), ({"not": {"doc_id": "d1"}}, "cde"),
    ({"not": {"or": [{"doc_id": "d1"}, {"doc_id": "d2"}]}}, "e"), ({"doc_id": "d1", "score": {"gte": 0.6}}, "a"), ({"not": {"tag": "billing"}}, "bde"), ({"flag": 1}, ""), ({"chunk_index": True}, ""), ({}, "abcde"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "key string, doc_id string, chunk_index int, tag string, score double, flag boolean").cache()


@pytest.mark.parametrize(("rule", "keys"), CASES)
def test_filters(rows, rule, keys):
    assert "".join(sorted(r.key for r in filters.where(rows, rule).collect())) == keys


@pytest.mark.parametrize("bad", [{"eq": "x"}, {"eq": {}}, {"in": {"a": "x"}}, {"not": None}, {"eq": {"a": [1]}}, {"a": {"like": "x"}}, {"and": []}, {"a": {"in": []}}, {"a": [1]}, {"a": {}}, {"exists": 3}])
def test_bad_filters(bad):
    with pytest.raises(filters.FilterError):
        filters.parse(bad)


def test_pushed_to_the_scan(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    plan = filters.where(spark.read.parquet(str(tmp_path / "t")), {"tag": "api"}).select("key")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(tag,api)" in plan


def test_same_logic_on_rows_and_in_stores(rows):
    for rule, keys in CASES:
        assert "".join(r[0] for r in ROWS if stores.matches(rule, dict(zip(rows.columns, r, strict=True)))) == keys, rule


def test_filters_of_other_stores():
    rule = {"not": {"or": [{"eq": {"a": 1}}, {"exists": "b"}]}}
    assert stores.to_document_filter(rule, True) == {"$and": [{"a": {"$ne": 1}}, {"b": {"$exists": False}}]} and stores.to_document_filter({}, True) == {}
    with pytest.raises(filters.FilterError):
        stores.to_document_filter(rule, False)
    assert stores.to_qdrant({"in": {"a": [1, 2]}}) == {"key": "a", "match": {"any": [1, 2]}} and stores.to_qdrant(None) == {}
    assert stores.to_qdrant({"ne": {"a": 1}})["must"][0] == {"must_not": [{"is_empty": {"key": "a"}}]}
    sql, values = stores.postgres_search_sql("t", {"in": {"a": ["x", "y"]}})
    assert 'COALESCE("a" IN (%s, %s), FALSE)' in sql and values == ["x", "y"]


def test_own_metadata(spark):
    df = spark.createDataFrame([("a", {"team": "x"}), ("b", {"team": "y"}), ("c", None)], "key string, metadata map<string,string>")
    assert [r.key for r in filters.where(df, {"ne": {"m_team": "x"}}).collect()] == ["b"] and filters.where(df, {"exists": "m_none"}).count() == 0


def test_external_stores(spark, rows, tmp_path):
    folder = str(tmp_path)

    class Shelf:
        def add(self, rows):
            for r in rows:
                with open(f"{folder}/{r['id']}", "w") as f:
                    f.write(r["tag"] or "")

        def similar(self, vector, k):
            return [{"id": n, "tag": open(f"{folder}/{n}").read()} for n in sorted(os.listdir(folder))][:k]

        def remove(self, ids):
            for i in ids:
                os.remove(f"{folder}/{i}")

    store = stores.wrapped(lambda _: Shelf())
    store.upsert("x", rows.selectExpr("key AS id", "tag"))
    assert [r["id"] for r in store.query("x", [1.0], 1, {"eq": {"tag": "auth"}})] == ["b"]
    store.delete("x", rows.filter("key < 'c'").selectExpr("key AS id"))
    assert sorted(os.listdir(folder)) == ["c", "d", "e"]
    assert stores.make_store(spark, {"kind": "qdrant"}).dialect.kind == "qdrant" and stores.make_store(spark, {"path": folder})("y").path == f"{folder}/y"
    with pytest.raises(ValueError, match="unknown store"):
        stores.make_store(spark, {"kind": "shoebox"})


def test_helpers():
    assert filters.to_dict(filters.parse({"a": 1, "not": {"exists": "b"}})) == {"and": [{"eq": {"a": 1}}, {"not": {"exists": "b"}}]}
    with pytest.raises(filters.FilterError):
        filters.without_not(filters.parse({"not": {"exists": "b"}}), not_exists=False)
    assert filters.fields_of({"a": 1, "not": {"exists": "b"}}) == {"a", "b"}
    assert filters.without_not(filters.parse({"not": {"and": [{"a": 1}, {"b": {"gt": 2}}]}})) == ("or", [("ne", "a", 1), ("lte", "b", 2)])
    assert filters.conjunction(None, {"a": 1}) == {"a": 1}
    sql, values = to_sql({"not": {"a": {"in": [1, 2]}}, "b": "x"})
    assert "COALESCE" in sql and values == [1, 2, "x"]
