"""External stores as sinks and sources, and what each can do.

The Parquet collection is the normal store. Others are described by a ``Dialect``: how a filter is said, and how a
batch is written, searched and deleted with the store's own client, which is optional and not part of this package.
Writing happens from the tasks in slices no larger than the store takes; what a store can filter only partly is asked
for in larger numbers (``over_fetch``) and filtered again exactly.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from loam.functions.filters import NEGATED, Filter, FilterError, parse, without_not


@dataclass(frozen=True)
class Capabilities:
    native_filters: bool = True
    not_exists: bool = True
    hybrid: bool = False
    max_batch: int = 256
    max_metadata_bytes: int | None = None
    exact_stale_delete: bool = True


def write_batches(records: DataFrame, writer: Callable[[list[Row]], None], capabilities: Capabilities = Capabilities()) -> None:
    """Hand rows to ``writer`` in slices no larger than the store takes, from every partition."""
    most = capabilities.max_batch

    def send(rows: Iterator[Row]) -> None:
        batch: list[Row] = []
        for row in rows:
            batch.append(row)
            if len(batch) == most:
                writer(batch)
                batch = []
        if batch:
            writer(batch)

    records.foreachPartition(send)


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def to_sql(filter_: Filter | None) -> tuple[str, list]:
    """A filter as parameterised SQL with two-valued logic: (text, parameters)."""
    values: list = []
    signs = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}

    def name(field: str) -> str:
        return '"' + field.replace('"', '""') + '"'

    def build(node: tuple) -> str:
        kind = node[0]
        if kind in ("and", "or"):
            return "(" + f" {kind.upper()} ".join(map(build, node[1])) + ")" if node[1] else "TRUE"
        if kind == "not":
            return f"NOT {build(node[1])}"
        if kind == "exists":
            return f"({name(node[1])} IS NOT NULL)"
        if kind in ("in", "nin"):
            values.extend(node[2])
            return f"COALESCE({name(node[1])} {'NOT ' * (kind == 'nin')}IN ({', '.join('?' * len(node[2]))}), FALSE)"
        values.append(node[2])
        return f"COALESCE({name(node[1])} {signs[kind]} ?, FALSE)"

    return build(parse(filter_)), values


def over_fetch(k: int, factor: int = 4, least: int = 20) -> int:
    """How many rows to ask a store for that filters only partly, before the exact recheck."""
    return max(factor * k, k + least)


# ---------------------------------------------------------------- filters of other stores

def to_qdrant(filter_: Filter | None) -> dict:
    """A filter as must / should / must_not conditions."""

    def build(node: tuple) -> dict:
        kind = node[0]
        if kind in ("and", "or"):
            return {"must" if kind == "and" else "should": [build(n) for n in node[1]]}
        if kind == "not":
            return {"must_not": [build(node[1])]}
        present = {"must_not": [{"is_empty": {"key": node[1]}}]}
        if kind == "exists":
            return present
        if kind in ("eq", "in"):
            return {"key": node[1], "match": {"value": node[2]} if kind == "eq" else {"any": node[2]}}
        if kind in ("ne", "nin"):  # only records that have the field
            return {"must": [present, {"must_not": [build((NEGATED[kind], *node[1:]))]}]}
        return {"key": node[1], "range": {kind: node[2]}}

    tree = parse(filter_)
    return {} if tree == ("and", []) else build(tree)


def to_document_filter(filter_: Filter | None, exists: bool) -> dict:
    """A filter in the ``{"field": {"$op": value}}`` language of document stores, which has no negation.

    Negations are pushed down to the comparisons, so missing fields may differ: recheck the rows. Without ``exists`` the
    store cannot ask for a field at all, which is an error.
    """

    def build(node: tuple) -> dict:
        kind = node[0]
        if kind in ("and", "or"):
            parts = [build(n) for n in node[1]]
            return parts[0] if len(parts) == 1 else {f"${kind}": parts}
        if kind in ("exists", "not"):
            if not exists:
                raise FilterError("this store cannot ask whether a field is there")
            return {node[1] if kind == "exists" else node[1][1]: {"$exists": kind == "exists"}}
        return {node[1]: {f"${kind}": node[2]}}

    tree = without_not(parse(filter_))
    return {} if tree == ("and", []) else build(tree)


# ---------------------------------------------------------------- stores

@dataclass(frozen=True)
class Dialect:
    """How to talk to one kind of store. ``connect`` runs in every task; the others take what it returns."""

    kind: str
    capabilities: Capabilities
    connect: Callable[[dict], Any]
    write: Callable[[Any, str, list[dict]], None]
    search: Callable[[Any, str, list[float], int, Filter | None], list[dict]]
    delete: Callable[[Any, str, list[str]], None]


@dataclass(frozen=True)
class ExternalStore:
    """A store of some kind with its settings; the operations a collection has."""

    dialect: Dialect
    settings: dict = field(default_factory=dict)

    def upsert(self, name: str, records: DataFrame) -> None:
        """Write rows (id, vector, text, fields ...) from every partition."""
        dialect, settings = self.dialect, self.settings
        client: list = []

        def send(batch: list[Row]) -> None:
            if not client:
                client.append(dialect.connect(settings))
            dialect.write(client[0], name, [r.asDict(recursive=True) for r in batch])

        write_batches(records, send, dialect.capabilities)

    def query(self, name: str, vector: list[float], k: int, filter_: Filter | None = None) -> list[dict]:
        """The ``k`` nearest rows; where the store filters only partly more are asked for and filtered again."""
        exact = self.dialect.capabilities.native_filters and self.dialect.capabilities.not_exists
        found = self.dialect.search(self.dialect.connect(self.settings), name, vector, k if exact or not filter_ else over_fetch(k), filter_)
        return [r for r in found if exact or matches(filter_, r)][:k]

    def delete(self, name: str, ids: DataFrame) -> None:
        dialect, settings = self.dialect, self.settings
        write_batches(ids.select("id"), lambda batch: dialect.delete(dialect.connect(settings), name, [r.id for r in batch]), dialect.capabilities)


def matches(filter_: Filter | None, row: dict) -> bool:
    """The filter on one row, for rechecking; the same logic as ``filters.condition``."""

    def same(a: Any, b: Any) -> bool:
        return isinstance(a, bool) == isinstance(b, bool) and a == b

    def holds(node: tuple) -> bool:
        kind = node[0]
        if kind in ("and", "or"):
            return (all if kind == "and" else any)(map(holds, node[1]))
        if kind == "not":
            return not holds(node[1])
        value = row.get(node[1])
        if kind == "exists" or value is None:
            return kind == "exists" and value is not None
        if kind in ("eq", "ne"):
            return same(value, node[2]) == (kind == "eq")
        if kind in ("in", "nin"):
            return any(same(value, x) for x in node[2]) == (kind == "in")
        if isinstance(value, bool) or isinstance(node[2], bool) or isinstance(value, str) != isinstance(node[2], str):
            return False
        return {"gt": value > node[2], "gte": value >= node[2], "lt": value < node[2], "lte": value <= node[2]}[kind]

    return holds(parse(filter_))


def _client(module: str) -> Any:
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise ImportError(f"this store needs the optional package {module}") from e


def _key(settings: dict) -> str | None:
    return os.environ.get(settings["api_key_env"]) if settings.get("api_key_env") else None


def _fields(row: dict) -> dict:
    return {k: v for k, v in row.items() if k not in ("id", "vector") and v is not None}


def _qdrant(settings: dict) -> Any:
    return _client("qdrant_client").QdrantClient(url=settings.get("url"), path=settings.get("path"), api_key=_key(settings))


def _qdrant_search(client: Any, name: str, vector: list[float], k: int, filter_: Filter | None) -> list[dict]:
    points = client.query_points(name, query=vector, limit=k, query_filter=to_qdrant(filter_) or None, with_payload=True).points
    return [{"id": str(p.id), "raw_score": p.score, **p.payload} for p in points]


def _chroma(settings: dict) -> Any:
    chroma = _client("chromadb")
    return chroma.HttpClient(settings["host"], int(settings.get("port", 8000))) if settings.get("host") else chroma.PersistentClient(settings["path"])


def _chroma_write(client: Any, name: str, rows: list[dict]) -> None:
    target = client.get_or_create_collection(name, metadata={"hnsw:space": "cosine"})
    target.upsert([r["id"] for r in rows], [r["vector"] for r in rows], [_fields(r) for r in rows], [r.get("text", "") for r in rows])


def _chroma_search(client: Any, name: str, vector: list[float], k: int, filter_: Filter | None) -> list[dict]:
    try:
        said = to_document_filter(filter_, False) or None
    except FilterError:  # asked without it, rechecked afterwards
        said = None
    got = client.get_collection(name).query([vector], n_results=k, where=said)
    return [{"id": i, "raw_score": 1 - d, **m} for i, d, m in zip(got["ids"][0], got["distances"][0], got["metadatas"][0], strict=True)]


def _pinecone(settings: dict) -> Any:
    return _client("pinecone").Pinecone(api_key=_key(settings)).Index(settings["index"])


def _pinecone_search(client: Any, name: str, vector: list[float], k: int, filter_: Filter | None) -> list[dict]:
    got = client.query(vector=vector, top_k=k, namespace=name, include_metadata=True, filter=to_document_filter(filter_, True) or None)
    return [{"id": m["id"], "raw_score": m["score"], **m["metadata"]} for m in got["matches"]]


def _postgres(settings: dict) -> Any:
    return _client("psycopg").connect(settings.get("dsn") or os.environ[settings.get("dsn_env", "DATABASE_URL")], autocommit=True)


def _table(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def postgres_search_sql(name: str, filter_: Filter | None) -> tuple[str, list]:
    """Nearest rows by cosine distance among those that satisfy a filter over the columns."""
    condition, values = to_sql(filter_)
    return f"SELECT id, fields, 1 - (vector <=> %s::vector) AS raw_score FROM {_table(name)} WHERE {condition.replace('?', '%s')} ORDER BY vector <=> %s::vector, id LIMIT %s", values


def _postgres_write(client: Any, name: str, rows: list[dict]) -> None:
    import json

    with client.cursor() as cursor:
        cursor.execute(f"CREATE TABLE IF NOT EXISTS {_table(name)} (id text PRIMARY KEY, vector vector, text text, doc_id text, chunk_index int, quarantined boolean, fields jsonb)")
        cursor.executemany(
            f"INSERT INTO {_table(name)} VALUES (%s, %s::vector, %s, %s, %s, %s, %s) ON CONFLICT (id) DO UPDATE SET vector = excluded.vector, text = excluded.text, "
            "doc_id = excluded.doc_id, chunk_index = excluded.chunk_index, quarantined = excluded.quarantined, fields = excluded.fields",
            [(r["id"], str(list(r["vector"])), r.get("text"), r.get("doc_id"), r.get("chunk_index"), r.get("quarantined"), json.dumps(_fields(r), default=str)) for r in rows],
        )


def _postgres_search(client: Any, name: str, vector: list[float], k: int, filter_: Filter | None) -> list[dict]:
    sql, values = postgres_search_sql(name, filter_)
    with client.cursor() as cursor:
        cursor.execute(sql, [str(vector), *values, str(vector), k])
        return [{"id": i, "raw_score": score, **fields} for i, fields, score in cursor.fetchall()]


def _postgres_delete(client: Any, name: str, ids: list[str]) -> None:
    with client.cursor() as cursor:
        cursor.execute(f"DELETE FROM {_table(name)} WHERE id = ANY(%s)", [ids])


DIALECTS = {
    "qdrant": Dialect(
        "qdrant", Capabilities(), _qdrant,
        lambda c, name, rows: c.upsert(name, points=[{"id": r["id"], "vector": list(r["vector"]), "payload": _fields(r)} for r in rows]), _qdrant_search, lambda c, name, ids: c.delete(name, points_selector=ids),
    ),
    "chroma": Dialect("chroma", Capabilities(not_exists=False), _chroma, _chroma_write, _chroma_search, lambda c, name, ids: c.get_collection(name).delete(ids=ids)),
    "pinecone": Dialect(
        "pinecone", Capabilities(not_exists=False, max_batch=100, max_metadata_bytes=40_960, exact_stale_delete=False), _pinecone,
        lambda c, name, rows: c.upsert([(r["id"], list(r["vector"]), _fields(r)) for r in rows], namespace=name), _pinecone_search, lambda c, name, ids: c.delete(ids=ids, namespace=name),
    ),
    "pgvector": Dialect("pgvector", Capabilities(), _postgres, _postgres_write, _postgres_search, _postgres_delete),
}


def wrapped(connect: Callable[[dict], Any], capabilities: Capabilities = Capabilities(native_filters=False)) -> ExternalStore:
    """A store object of the user's with ``add(rows)``, ``similar(vector, k)`` and ``remove(ids)``, made by ``connect`` in every task."""
    return ExternalStore(Dialect("wrapped", capabilities, connect, lambda c, _, rows: c.add(rows), lambda c, _, vector, k, __: c.similar(vector, k), lambda c, _, ids: c.remove(ids)))


def make_store(spark: SparkSession, settings: dict) -> Any:
    """A store from its settings: ``{"kind": "files", "path": ...}`` gives a function from names to collections, others an ``ExternalStore``."""
    from loam.operators.collection import Collection

    kind = str(settings.get("kind", "files")).lower()
    if kind in ("files", "memory"):
        return lambda name: Collection(spark, settings.get("path", "collections"), name)
    if kind not in DIALECTS:
        raise ValueError(f"unknown store kind {kind!r}; one of files, {', '.join(DIALECTS)}")
    if kind == "pinecone" and not settings.get("index"):
        raise ValueError("a pinecone store needs the name of its index")
    return ExternalStore(DIALECTS[kind], dict(settings))
