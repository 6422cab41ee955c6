"""Record collections: upsert, delete and search over versioned, bucketed Parquet.

A collection is a folder of buckets by the hash of a record's id. A change reads and rewrites only the
buckets whose ids it touches, into a folder of its own, and then adds one numbered commit that says which
folder holds which bucket. Commits are renamed into place and never replaced: readers always see a
complete version, and of two writers that start from one version the second one fails. The pure
functions at the top are the plans of the operations and work on any DataFrames.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.filters import Filter, condition, where
from loam.functions.vectors import search

#: Rows one write slice of an external store holds.
MAX_BATCH = 256


class ManifestError(ValueError):
    """A collection and its reader or writer do not fit together."""


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The last row of every key by ``version``; ties by the row's hash, so the result is stable."""
    plain = [f.name for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    order = Window.partitionBy(*keys).orderBy(*[F.col(v).desc_nulls_last() for v in version], F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
    return df.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def upsert(target: DataFrame, source: DataFrame, key: str = "id") -> DataFrame:
    """Insert or replace by key: the untouched rows of the target and all of the source."""
    return target.join(source.select(key), key, "left_anti").unionByName(source, allowMissingColumns=True)


def delete(target: DataFrame, ids: DataFrame | None = None, filter_: Filter | None = None, key: str = "id") -> DataFrame:
    """Rows left after deleting by ids or by filter; ids win, neither deletes nothing."""
    if ids is not None:
        return target.join(ids.select(key), key, "left_anti")
    return target.filter(~condition(filter_, target.schema)) if filter_ else target


def get(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The existing rows of the given ids."""
    return target.join(ids.select(key).distinct(), key, "left_semi")


def list_ids(target: DataFrame, filter_: Filter | None = None, limit: int | None = None, key: str = "id") -> DataFrame:
    ids = where(target, filter_).select(key).orderBy(key)
    return ids if limit is None else ids.limit(limit)


def stale(target: DataFrame, fresh: DataFrame, parent: str = "doc_id", key: str = "id") -> DataFrame:
    """Stored rows of re-ingested parents that the new version no longer has."""
    return stale_of(target, fresh, fresh, parent, key)


def stale_of(target: DataFrame, parents: DataFrame, fresh: DataFrame, parent: str = "doc_id", key: str = "id") -> DataFrame:
    """Stored rows of re-ingested parents that the new version no longer has, also where it has none left at all."""
    return target.join(parents.select(parent).distinct(), parent, "left_semi").join(fresh.select(key), key, "left_anti")


def unchanged(documents: DataFrame, stored: DataFrame, key: str = "doc_id", digest: str = "doc_hash") -> DataFrame:
    """Documents whose stored digest equals their present one."""
    return documents.join(stored.select(key, digest).distinct(), [key, digest], "left_semi")


def exact_duplicates_removed(df: DataFrame, within: list[str], digest: str, order: list[str]) -> DataFrame:
    """The first row of every (within, digest) in ``order``."""
    window = Window.partitionBy(*within, digest).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


class ConcurrentUpdate(RuntimeError):
    """Another writer changed the collection first."""


#: Buckets of a new collection. A change reads and writes whole buckets; large collections take more.
BUCKETS = 16


class Collection:
    """A named collection in a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, root: str, name: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, f"{root.rstrip('/')}/{name}", buckets
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs.FileSystem.get(jvm.java.net.URI(self.path), spark._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path

    def _read_text(self, name: str) -> str | None:
        path = self._path(f"{self.path}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put_text(self, name: str, text: str) -> bool:
        """Write a file that is complete when it appears; False if there is one of that name."""
        temporary, final = self._path(f"{self.path}/.{name}.{uuid.uuid4().hex}"), self._path(f"{self.path}/{name}")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        done = not self._fs.exists(final) and self._fs.rename(temporary, final)
        if not done:
            self._fs.delete(temporary, False)
        return done

    def _names(self) -> list[str]:
        root = self._path(self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def _commits(self) -> list[str]:
        return [n for n in self._names() if n.startswith("commit-")]

    def _current(self) -> dict[str, Any] | None:
        commits = self._commits()
        return json.loads(self._read_text(commits[-1])) | {"number": int(commits[-1][7:-5])} if commits else None

    def exists(self) -> bool:
        return bool(self._commits())

    def drop(self) -> None:
        self._fs.delete(self._path(self.path), True)

    def manifest(self) -> dict[str, Any] | None:
        text = self._read_text("manifest.json")
        return json.loads(text) if text else None

    def put_manifest(self, manifest: dict[str, Any]) -> None:
        self._fs.delete(self._path(f"{self.path}/manifest.json"), False)
        self._put_text("manifest.json", json.dumps(manifest, sort_keys=True))

    def check(self, embedder: str, dim: int, create: bool, **more: Any) -> dict[str, Any]:
        """The manifest, made on the first ingest; another embedder or dimension is an error."""
        found = self.manifest()
        if found is None:
            if not create:
                raise ManifestError("the collection has no manifest")
            found = {"embedder": embedder, "dim": dim, **more}
            if not self._put_text("manifest.json", json.dumps(found, sort_keys=True)):
                found = self.manifest()
        for name, value in (("embedder", embedder), ("dim", dim)):
            if found[name] != value:
                raise ManifestError(f"the collection was made with {name} {found[name]!r}, not {value!r}")
        return found

    def ensure(self, like: DataFrame) -> None:
        """Create the collection, empty, if it does not exist."""
        if not self.exists():
            self.replace(like.limit(0))

    def _frame(self, current: dict[str, Any], buckets: list[int] | None = None) -> DataFrame:
        """Rows of some buckets, or of all."""
        schema = T.StructType.fromJson(json.loads(current["schema"]))
        wanted = {str(b) for b in buckets} if buckets is not None else current["folders"].keys()
        paths = [f"{self.path}/{folder}/_bucket={b}" for b, folder in current["folders"].items() if b in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        current = self._current()
        if current is None:
            raise FileNotFoundError(self.path)
        return self._frame(current)

    def _bucket(self, current: dict[str, Any] | None) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(current["buckets"] if current else self.buckets)).cast("int")

    def _commit(self, current: dict[str, Any] | None, rows: DataFrame, touched: list[int] | None) -> None:
        """Write the touched buckets anew (all without ``touched``) and make them the current ones."""
        folder = f"v{time.time_ns()}"
        schema = rows.schema
        if touched and current:
            before = T.StructType.fromJson(json.loads(current["schema"]))
            schema = T.StructType([*before.fields, *(f for f in rows.schema.fields if f.name not in before.names)])
        placed = rows.withColumn("_bucket", self._bucket(current)).hint("rebalance", "_bucket")
        placed.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        made = {s.getPath().getName().partition("=")[2]: folder for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if "=" in s.getPath().getName()}
        kept = {b: f for b, f in current["folders"].items() if int(b) not in touched} if touched is not None and current else {}
        number = current["number"] + 1 if current else 0
        body = {"buckets": current["buckets"] if current else self.buckets, "schema": schema.json(), "folders": kept | made}
        if not self._put_text(f"commit-{number:012d}.json", json.dumps(body)):
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            raise ConcurrentUpdate(f"{self.path}: version {number} is there already")
        used = set(body["folders"].values()) | (set(current["folders"].values()) if current else set())
        for name in self._names():
            if name.startswith("v") and name not in used:
                self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def replace(self, rows: DataFrame) -> None:
        """Make ``rows`` the whole collection."""
        self._commit(self._current(), rows, None)

    def change(self, gone: DataFrame | None, records: DataFrame | None) -> None:
        """Remove the ids of ``gone`` and insert or replace ``records``; only the buckets of these ids are read and written."""
        current = self._current()
        ids = [d.select("id") for d in (gone, records) if d is not None]
        if current is None:
            if records is not None:
                self._commit(None, records, None)
            return
        every = reduce(DataFrame.unionByName, ids).distinct()
        touched = sorted(r[0] for r in every.select(self._bucket(current).alias("b")).distinct().collect())
        if touched:
            left = self._frame(current, touched).join(every, "id", "left_anti")
            self._commit(current, left if records is None else left.unionByName(records, allowMissingColumns=True), touched)

    def upsert(self, records: DataFrame, vector: str = "vector", dim: int | None = None) -> None:
        """Insert or replace by id; of equal ids in one batch the last row counts. A vector of another dimension fails the write."""
        if dim is not None:
            records = records.withColumn(vector, F.when(F.col(vector).isNull() | (F.size(vector) == dim), F.col(vector)).otherwise(F.raise_error(F.lit(f"a vector does not have {dim} numbers"))))
        if not records.isEmpty():
            self.change(None, latest(records.withColumn("_order", F.monotonically_increasing_id()), ["id"], ["_order"]).drop("_order"))

    def delete(self, ids: DataFrame | None = None, filter_: Filter | None = None) -> None:
        if ids is not None:
            self.change(ids, None)
        elif filter_:
            self.change(where(self.read(), filter_).select("id"), None)

    def query(self, vector: list[float], k: int, metric: str = "cosine", filter_: Filter | None = None) -> DataFrame:
        return search(self.read(), vector, k, metric, filter_)
