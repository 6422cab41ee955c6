"""The most similar vectors of every vector: a forest of random-projection trees.

The trees are built on a bounded sample: a node splits its points by the hyperplane halfway between
two random ones until a leaf holds what corresponds to ``LEAF`` rows of the whole. Every vector is
indexed in its leaf of each tree. A search enters all trees at once through one shared priority
queue ordered by the smallest margin on the path, and takes the ``PROBES`` best leaves, whichever
tree they are in; branches that wait in the queue are never discarded. Leaves hold codes of a byte a
number, of which the rounding error of every vector is known exactly. One matrix product a leaf bounds
all similarities from both sides; what cannot be among the best of its query by these bounds is left
out, however many candidates that keeps, and only the rest is reranked exactly, by cosine of the vectors.

Equal vectors are searched once: a group of copies is represented by its smallest id and knows its
``k + 1`` smallest ids, which is all that anyone's list of ``k`` can need of it. A leaf that holds more
than ``LARGE_LEAF`` rows is shared out: its queries are spread over tasks and its members copied to each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.topn import complete_groups, group_numbers
from loam.plans.runtime import join_small, materialize

DIM = 64
TREES = 8
#: Leaves a search visits over all trees, its own leaf in each tree among them.
PROBES = 20
#: The same where neighbours of any similarity count; distant ones are spread over more leaves.
PROBES_ANY = 80
LEAF = 400
#: Vectors the trees are built on, at most.
SAMPLE = 60_000
LARGE_LEAF = 20_000
#: Rows searched together in the queue; bounds memory only.
BATCH = 4_096


class Forest:
    """Trees in flat arrays: node -> hyperplane, offset and two children; negative children are leaves."""

    def __init__(self, sample: np.ndarray, trees: int, leaf_rows: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.planes: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.depth = 1
        self.roots = [self._grow(sample, np.arange(len(sample)), max(leaf_rows, 2.0), rng, 0) for _ in range(trees)]
        dim = sample.shape[1] if sample.ndim == 2 else 0
        self.plane = np.array(self.planes, np.float32).reshape(len(self.planes), dim)
        self.offset = np.array(self.offsets, np.float32)
        self.child = np.array(self.children, np.int64).reshape(len(self.children), 2)
        del self.planes, self.offsets, self.children

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf_rows: float, rng: np.random.Generator, depth: int) -> int:
        if len(rows) <= leaf_rows or depth > 40:
            return self._leaf()
        for _ in range(8):
            a, b = x[rng.choice(rows, 2, replace=False)]
            plane = a - b
            norm = np.linalg.norm(plane)
            if norm < 1e-6:
                continue
            plane /= norm
            side = x[rows] @ plane
            offset = float(np.median(side))
            right = side > offset
            if 0.2 <= right.mean() <= 0.8:
                break
        else:
            return self._leaf()
        self.depth = max(self.depth, depth + 1)
        node = len(self.planes)
        self.planes.append(plane)
        self.offsets.append(offset)
        self.children.append([0, 0])
        self.children[node] = [self._grow(x, rows[~right], leaf_rows, rng, depth + 1), self._grow(x, rows[right], leaf_rows, rng, depth + 1)]
        return node

    def search(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Leaf numbers (1 ...) of the ``probes`` best leaves of every row, 0 where there are fewer; own leaves first."""
        n, trees = len(x), len(self.roots)
        width = trees + probes * self.depth
        prio = np.full((n, width), -np.inf, np.float32)
        node = np.zeros((n, width), np.int64)
        prio[:, :trees] = np.inf
        node[:, :trees] = self.roots
        used = np.full(n, trees)
        out = np.zeros((n, probes), np.int64)
        every = np.arange(n)
        for p in range(probes):
            best = np.argmax(prio, axis=1)
            level = prio[every, best]
            at = node[every, best].copy()
            prio[every, best] = -np.inf
            live = np.flatnonzero((level > -np.inf) & (at >= 0))
            while len(live):
                here = at[live]
                margin = np.einsum("ij,ij->i", x[live], self.plane[here]) - self.offset[here]
                right = (margin > 0).astype(np.int64)
                slot = used[live]  # a search passes at most depth nodes, so there is room for every branch
                prio[live, slot] = np.minimum(level[live], -np.abs(margin))
                node[live, slot] = self.child[here, 1 - right]
                used[live] += 1
                at[live] = self.child[here, right]
                live = live[at[live] >= 0]
            out[:, p] = np.where(level > -np.inf, -at, 0)
        return out


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as one binary value each, without a loop."""
    width = x.shape[1] * x.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind: type = np.float32) -> np.ndarray:
    """Binary values of one width as a matrix."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    size = dim * np.dtype(kind).itemsize
    parts = []
    for c in chunks:
        if len(c):
            first = np.frombuffer(c.buffers()[1], np.int32, 1, c.offset * 4)[0]
            parts.append(np.frombuffer(c.buffers()[2], np.uint8, len(c) * size, first))
    return np.concatenate(parts).view(kind).reshape(-1, dim) if parts else np.zeros((0, dim), kind)


def _unit(x: np.ndarray, kind: type = np.float64) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(kind)


def _usable(dim: int):
    """Rows whose vector has ``dim`` finite numbers that are not all zero, the vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sized = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False))
            flat = sized.column("vector").flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim) + np.float32(0)
            good = np.isfinite(x).all(axis=1) & x.any(axis=1)  # a null number has become NaN
            kept = sized.filter(pa.array(good))
            yield pa.record_batch([kept.column("id"), kept.column("at"), _binary(x[good])], names=["id", "at", "vec"])

    return run


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as (a byte a number, scale, norm of the rounding error)."""
    unit = _unit(x)
    scale = np.abs(unit).max(axis=1) / 127
    code = np.round(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - code * scale[:, None].astype(np.float32), axis=1)
    return code, scale.astype(np.float32), (error * 1.0001 + 1e-7).astype(np.float32)


def _probe(forest: Forest, trees: int, probes: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                x = _matrix(part.column("vec"), dim)
                leaves = forest.search(_unit(x, np.float32), probes)
                code, scale, error = encode(x)
                row, p = np.nonzero(leaves)
                yield pa.record_batch(
                    [part.column("n").take(pa.array(row)), _binary(code[row]), pa.array(scale[row]), pa.array(error[row]), pa.array(leaves[row, p].astype(np.int32)), pa.array(p < trees)],
                    names=["n", "code", "scale", "error", "leaf", "member"],
                )

    return run


def _candidates(k: int, least: float, dim: int):
    """Pairs of a leaf that may be among the ``k`` best of their query: (n, other, low, high), bounds of the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_groups(batches, ["leaf", "_slot"]):
            group = group_numbers(table, ["leaf", "_slot"])
            ids = table.column("n").to_numpy()
            near = _matrix(table.column("code"), dim, np.int8).astype(np.float32) * table.column("scale").to_numpy()[:, None]
            error = table.column("error").to_numpy()
            member, asks = table.column("member").to_numpy(), table.column("asks").to_numpy()
            found: list[tuple[np.ndarray, ...]] = []
            cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                members = np.arange(a, b)[member[a:b]]
                queries = np.arange(a, b)[asks[a:b]]
                if not len(members):
                    continue
                for s in range(0, len(queries), 1024):
                    q = queries[s : s + 1024]
                    sim = near[q] @ near[members].T
                    slack = error[q][:, None] + error[members][None, :] + error[q][:, None] * error[members][None, :] + np.float32(1e-5)
                    low = sim - slack
                    low[ids[q][:, None] == ids[members][None, :]] = -4.0
                    m = min(k, low.shape[1])
                    bar = np.maximum(np.partition(low, low.shape[1] - m, axis=1)[:, low.shape[1] - m], np.float32(least - 1e-5))
                    r, c = np.nonzero((low + 2 * slack >= bar[:, None]) & (low > -3))
                    found.append((ids[q[r]], ids[members[c]], low[r, c], (low + 2 * slack)[r, c]))
            if found:
                columns = [np.concatenate(x) for x in zip(*found, strict=True)]
                yield pa.record_batch([pa.array(x) for x in columns], names=["n", "other", "low", "high"])

    return run


def _cosines(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _unit(_matrix(batch.column("vec"), dim)), _unit(_matrix(batch.column("other_vec"), dim))
            yield pa.record_batch([batch.column("gid"), batch.column("other"), pa.array(np.einsum("ij,ij->i", a, b))], names=["gid", "other", "similarity"])

    return run


def nearest(df: DataFrame, k: int, least: float, id_: str = "id", vector: str = "vector", version: str = "ingested_at", dim: int = DIM, trees: int = TREES, probes: int = PROBES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """(id, other, similarity): up to ``k`` most similar others of every id with a cosine of ``least`` or more.

    Null, all-zero, non-finite and other than ``dim``-number vectors take no part; an id ingested
    several times counts once, with its latest vector. Equal similarities, to six decimals, go to the
    smaller id. Every usable row is indexed and searched; the search is approximate in which leaves
    it visits and exact in what it finds there. An empty input gives an empty result.
    """
    spark = df.sparkSession
    source = df.filter(F.col(id_).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector"), F.col(version).alias("version"))
    vectors = source.withColumn("at", F.coalesce(F.unix_micros(F.col("version").cast("timestamp")), F.lit(-(2**63)))).select("id", "at", "vector")
    clean = materialize(vectors.mapInArrow(_usable(dim), "id string, at long, vec binary"))
    total = clean.count()
    shape = "id string, other string, similarity double"
    if total == 0:
        return spark.createDataFrame([], shape)
    # only ids that come again and vectors that are shared are compared; the others stay where they are
    again = materialize(clean.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("id"))
    once = join_small(clean, again, ["id"], "left_anti", salt=F.xxhash64("vec")).select("id", "vec")
    last = join_small(clean, again, ["id"], "left_semi", salt=F.xxhash64("vec")).groupBy("id").agg(F.max(F.struct("at", "vec")).alias("x")).select("id", F.col("x.vec").alias("vec"))
    rows = once.unionByName(last).withColumn("digest", F.md5("vec"))
    copies = materialize(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("gid")).filter("c > 1").select("digest", "gid"))
    members = join_small(rows, copies, ["digest"], "left", salt=F.xxhash64("id")).select("id", "vec", F.coalesce("gid", "id").alias("gid"), F.col("gid").isNotNull().alias("copied"))
    members = materialize(members.withColumn("n", F.monotonically_increasing_id()))
    groups = members.filter("id = gid").select("n", "gid", "vec")

    part = min(1.0, 1.1 * sample / total)
    drawn = groups.select(F.xxhash64(F.lit(seed), "gid").alias("h"), "vec").filter(F.pmod("h", F.lit(1 << 30)) <= int(part * (1 << 30))).orderBy("h", "vec").limit(sample)
    points = _unit(np.frombuffer(b"".join(bytes(r.vec) for r in drawn.collect()), np.float32).reshape(-1, dim), np.float32)
    forest = Forest(points, trees, leaf * len(points) / total, seed)
    entries = groups.select("n", "vec").mapInArrow(_probe(forest, trees, probes, dim), "n long, code binary, scale float, error float, leaf int, member boolean")
    if total > LARGE_LEAF:
        sizes = _leaf_sizes(groups, forest, trees, dim)
        large = materialize(sizes.filter(F.col("n") > LARGE_LEAF).select(F.col("leaf").cast("int").alias("leaf"), F.ceil(F.col("n") / LARGE_LEAF).cast("int").alias("_slots")))
        entries = join_small(entries, large, ["leaf"], "left", salt=F.xxhash64("n")).withColumn("_slots", F.coalesce("_slots", F.lit(1)))
    else:
        entries = entries.withColumn("_slots", F.lit(1))
    own = F.pmod(F.xxhash64("n"), F.col("_slots").cast("long")).cast("int")
    spread = F.when(F.col("member"), F.sequence(F.lit(0), F.col("_slots") - 1)).otherwise(F.array(own))
    entries = entries.withColumn("own", own).withColumn("_slot", F.explode(spread)).withColumn("asks", F.col("own") == F.col("_slot"))
    entries = entries.select("leaf", "_slot", "n", "code", "scale", "error", "member", "asks").repartition("leaf", "_slot").sortWithinPartitions("leaf", "_slot")
    pairs = entries.mapInArrow(_candidates(k, least, dim), "n long, other long, low float, high float")
    pairs = pairs.groupBy("n", "other").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    by_query = Window.partitionBy("n")
    ranked = pairs.withColumn("rn", F.row_number().over(by_query.orderBy(F.desc("low"), "other")))
    ranked = ranked.withColumn("bar", F.max(F.when(F.col("rn") == k, F.col("low"))).over(by_query))
    kept = materialize(ranked.filter(F.col("bar").isNull() | (F.col("high") >= F.col("bar"))).select("n", "other"))
    there = groups.select(F.col("n").alias("other"), F.col("gid").alias("other_gid"), F.col("vec").alias("other_vec"))
    both = kept.join(there, "other").join(groups, "n").select("gid", F.col("other_gid").alias("other"), "vec", "other_vec")
    exact = both.mapInArrow(_cosines(dim), "gid string, other string, similarity double").filter(F.col("similarity") >= least)
    by_group = Window.partitionBy("gid").orderBy(F.round("similarity", 6).desc(), "other")
    best = materialize(exact.withColumn("rn", F.row_number().over(by_group)).filter(F.col("rn") <= k).drop("rn"))

    # copies: a group answers with its k + 1 smallest ids
    in_group = Window.partitionBy("gid").orderBy("id")
    firsts = materialize(members.filter("copied").select("gid", "id").withColumn("rn", F.row_number().over(in_group)).filter(F.col("rn") <= k + 1).drop("rn"))
    named = join_small(best, firsts.select(F.col("gid").alias("other"), F.col("id").alias("copy")), ["other"], "left", salt=F.xxhash64("gid"))
    named = named.select("gid", F.coalesce("copy", "other").alias("other"), "similarity")
    same = firsts.select("gid", F.col("id").alias("other"), F.lit(1.0).alias("similarity"))
    answers = named.unionByName(same)
    alone = answers.join(members.filter("NOT copied").select("gid"), "gid", "left_semi").withColumn("id", F.col("gid"))
    shared = join_small(members.filter("copied").select("id", "gid"), answers, ["gid"], "inner", salt=F.xxhash64("id"))
    out = alone.select("id", "other", "similarity").unionByName(shared.select("id", "other", "similarity")).filter("id <> other")
    by_id = Window.partitionBy("id").orderBy(F.round("similarity", 6).desc(), "other")
    return out.withColumn("rn", F.row_number().over(by_id)).filter(F.col("rn") <= k).drop("rn")


def _leaf_sizes(groups: DataFrame, forest: Forest, trees: int, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(forest.leaves + 1, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                leaves = forest.search(_unit(_matrix(batch.column("vec").slice(start, BATCH), dim), np.float32), trees)
                count += np.bincount(leaves.ravel(), minlength=len(count))
        some = np.flatnonzero(count[1:]) + 1
        yield pa.record_batch([pa.array(some), pa.array(count[some])], names=["leaf", "n"])

    return groups.select("vec").mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """Unordered pairs of which at least one names the other: (id_a, id_b) with id_a < id_b."""
    return neighbours.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
