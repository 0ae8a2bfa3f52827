"""Exact top-k inner-product search over KD-trees, one for each shard.

Space is cut into cells by the median splits of a tree over a bounded sample of
the vectors; a cell is one shard, or several by a hash of the id where it holds
more than about ``SHARD_ROWS`` (as of a vector that is there very often).  Every
shard's box of least and largest components is known before any query moves:
the largest inner product that it allows bounds what the shard can hold.

A shard's vectors and the queries that ask it come to one task in order, the
vectors first: its tree is built once and the queries stream through it in
batches, so a task holds one shard and one batch.  The tree splits at the median
of its widest dimension down to small leaves; every node keeps the tight box of
its vectors and the smallest id in it.  Leaves are visited from the best bound on
until it falls below the kth score found (at an equal bound, until no smaller id
is left).

The kth score is propagated: each query is first searched in the shard of the
best bound, and is then sent to those shards only whose bound reaches the kth
score found there.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; vectors are compared with those of their own
length only (empty ones score 0); rows with a query's id are its own; with
fewer than k candidates all are returned, and none from an empty table; equal
scores go by smaller id.  A vector row that occurs several times is as many
candidates, and the candidates of all query rows of an id are ranked together;
equal rows are searched once and counted afterwards.  Components beyond 64 bits
are cut to 64 bits, and so are scores, after exact comparison within a shard.
Only id and vector are read, so other columns may have any names.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window
from pyspark.sql.types import ArrayType, LongType

from tempora.llm.shared import discard, written

SHARD_ROWS, LEAF = 8192, 256
#: Vectors that the cells are made by, vectors of them to a cell at least, and bytes of all boxes up to which every task gets them.
SAMPLE, OF_CELL, BOX_BYTES = 20_000, 4, 64 << 20
#: Stands for no kth score (a null would make the column one of doubles).
SMALLEST = -(2**63)
FOUND = "query_id long, digest string, vec_id long, score long, times long"


class Cells:
    """Median splits of a sample into cells; vectors of another length than most are one cell of their own."""

    def __init__(self, sample: np.ndarray, wanted: int):
        self.length = sample.shape[1]
        self.dimension, self.at, self.child, self.number = [], [], [], []
        self.cells = 0
        self._split(sample.astype(np.float64), max(1, min(wanted, len(sample) // OF_CELL)))

    def _split(self, points: np.ndarray, wanted: int) -> int:
        node = len(self.at)
        widest = int((points.max(axis=0) - points.min(axis=0)).argmax()) if wanted > 1 and len(points) and self.length else 0
        middle = float(np.median(points[:, widest])) if wanted > 1 and self.length else 0.0
        left = points[:, widest] <= middle if self.length else np.ones(len(points), bool)
        whole = wanted == 1 or left.all() or not left.any()
        self.dimension.append(widest)
        self.at.append(middle)
        self.number.append(self.cells if whole else -1)
        self.child.append(None)
        if whole:
            self.cells += 1
        else:
            self.child[node] = (self._split(points[left], wanted // 2), self._split(points[~left], wanted - wanted // 2))
        return node

    def of(self, vectors: list) -> np.ndarray:
        """The cell of each vector."""
        out = np.full(len(vectors), self.cells)
        usual = np.array([i for i, v in enumerate(vectors) if len(v) == self.length], np.int64)
        if not len(usual):
            return out
        points = np.stack([np.asarray(vectors[i], np.float64) for i in usual])
        todo = [(0, np.arange(len(usual)))]
        while todo:
            node, rows = todo.pop()
            if self.child[node] is None:
                out[usual[rows]] = self.number[node]
                continue
            left = points[rows, self.dimension[node]] <= self.at[node]
            todo += [(self.child[node][0], rows[left]), (self.child[node][1], rows[~left])]
        return out


class Boxes:
    """The boxes of all shards, for those of each length."""

    def __init__(self, rows: list):
        self.of_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in {r.length for r in rows}:
            own = sorted((r for r in rows if r.length == length), key=lambda r: r.shard)
            self.of_length[length] = np.array([r.shard for r in own]), np.array([r.low for r in own], np.float64), np.array([r.high for r in own], np.float64)

    def bounds(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(shards, bounds)``: the largest inner product that each shard's box allows, and a margin above the error of it."""
        if len(query) not in self.of_length:
            return np.empty(0, np.int64), np.empty(0)
        shards, low, high = self.of_length[len(query)]
        q = query.astype(np.float64)
        reach = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        return shards, reach + 1e-12 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)


class Unbounded(Boxes):
    """All shards without their boxes, where these would be too many bytes: each may hold anything."""

    def __init__(self, rows: list):
        self.shards = {r.length: np.array(sorted(r.shards)) for r in rows}

    def bounds(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shards = self.shards.get(len(query), np.empty(0, np.int64))
        # the first shard is the home of none in particular
        return np.roll(shards, int(np.abs(query).sum()) % max(1, len(shards))), np.full(len(shards), np.inf)


class Tree:
    """A KD-tree over integer vectors; nodes are halves of a permutation."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, times: np.ndarray):
        self.low, self.high, self.least, self.child, self.span = [], [], [], [], []
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.times = ids[order], vectors[order], times[order]
        self.order = np.arange(len(ids))
        self._build(0, len(ids))
        self.ids, self.vectors, self.times = self.ids[self.order], self.vectors[self.order], self.times[self.order]
        self.low, self.high, self.least = np.array(self.low), np.array(self.high), np.array(self.least)

    def _build(self, start: int, end: int) -> int:
        rows = self.order[start:end]
        points = self.vectors[rows]
        node, low, high = len(self.low), points.min(axis=0), points.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.least.append(self.ids[rows].min())
        self.span.append((start, end))
        self.child.append(None)
        if end - start > LEAF:
            half = (end - start) // 2
            widest = int((high - low).argmax())
            self.order[start:end] = rows[np.argpartition(points[:, widest], half, kind="introselect")]
            self.child[node] = (self._build(start, start + half), self._build(start + half, end))
        return node

    def search(self, query_id: int, query: np.ndarray, k: int, kth: int | None) -> list[tuple[int, int, int]]:
        """Up to k of (score, id, times) by falling score, then rising id, that ``kth`` does not rule out."""
        bounds = np.where(query >= 0, self.high, self.low) @ query
        best: list[tuple[int, int, int]] = []  # a heap whose root is the worst: (score, -id, times)
        nodes = [(-int(bounds[0]), int(self.least[0]), 0)]
        while nodes:
            bound, least, node = heapq.heappop(nodes)
            bound = -bound
            if kth is not None and bound < kth:
                break
            if len(best) == k and (bound, -least) < best[0][:2]:
                if bound < best[0][0]:
                    break
                continue
            if self.child[node]:
                for c in self.child[node]:
                    heapq.heappush(nodes, (-int(bounds[c]), int(self.least[c]), c))
                continue
            start, end = self.span[node]
            ids, scores = self.ids[start:end], self.vectors[start:end] @ query
            for i in np.flatnonzero(self._may_enter(scores, ids, query_id, best, k, kth)):
                entry = (int(scores[i]), -int(ids[i]), int(self.times[start + i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(s, -i, n) for s, i, n in sorted(best, reverse=True)]

    @staticmethod
    def _may_enter(scores, ids, query_id, best, k, kth) -> np.ndarray:
        may = ids != query_id
        if kth is not None:
            may &= scores >= kth
        if len(best) == k:
            may &= scores >= best[0][0]
        return may


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in column])


def _most(rows: np.ndarray) -> int:
    """The largest size of a component."""
    return max(-int(rows.min(initial=0)), int(rows.max(initial=0)))


def _exact(most: int, of_query: int, length: int):
    """The fastest numbers in which every inner product is exact."""
    reach = most * of_query * max(length, 1)
    return np.float64 if reach < 2**52 else np.int64 if reach < 2**62 else object


class Shard:
    """The tree of one shard, in the numbers that a batch of queries needs."""

    def __init__(self, held: list[pd.DataFrame]):
        rows = pd.concat(held)
        self.ids, self.times, self.vectors = rows["vec_id"].to_numpy(np.int64), rows["times"].to_numpy(np.int64), _vectors(rows["vector"])
        self.most, self.trees = _most(self.vectors), {}

    def found(self, queries: pd.DataFrame, k: int) -> list[tuple]:
        asked = _vectors(queries["vector"])
        kind = _exact(self.most, _most(asked), asked.shape[1])
        if kind not in self.trees:
            self.trees[kind] = Tree(self.ids, self.vectors.astype(kind), self.times)
        out = []
        for query_id, digest, often, query, kth in zip(queries["vec_id"], queries["digest"], queries["times"], asked.astype(kind), queries["kth"]):
            least = None if int(kth) == SMALLEST else int(kth)
            out += [(query_id, digest, i, min(max(s, SMALLEST), -SMALLEST - 1), n * often) for s, i, n in self.trees[kind].search(int(query_id), query, k, least)]
        return out


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, shard = None, [], None
        for batch in batches:
            out: list[tuple] = []
            for (number, length, asks), rows in batch.groupby(["shard", "length", "asks"], sort=True):
                if (number, length) != key:
                    key, held, shard = (number, length), [], None
                if not asks:
                    held.append(rows)
                elif held or shard:
                    shard = shard or Shard(held)
                    held = []
                    out += shard.found(rows, k)
            yield pd.DataFrame(out, columns=["query_id", "digest", "vec_id", "score", "times"]).astype({c: "int64" for c in ("query_id", "vec_id", "score", "times")})

    return run


def integers(df: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``df`` with each component x as floor(scale * x), without unusable vectors."""
    v = F.col(f"`{vector}`")
    usable = df.filter(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return usable.withColumn(vector, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _sharded(vectors: DataFrame) -> tuple[DataFrame, Boxes]:
    """``vectors`` with their ``shard``, as a written table with the attribute ``shards``, and the boxes of all shards."""
    n = vectors.count()
    sample = [np.asarray(r.vector, np.int64) for r in vectors.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(SAMPLE).select("vector").collect()]
    usual = Counter(map(len, sample)).most_common(1)[0][0] if sample else 0
    points = np.stack([v for v in sample if len(v) == usual]) if sample else np.empty((0, 0))
    cells = Cells(points, max(1, -(-n // SHARD_ROWS)))

    @F.pandas_udf(LongType())
    def cell(vectors: pd.Series) -> pd.Series:
        return pd.Series(cells.of(list(vectors)), dtype="int64")

    placed = written(vectors.withColumn("cell", cell("vector")), "cells")
    # a row a cell, of which there are no more than the sample has
    sizes = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}
    parts, first = {}, 0
    for c in sorted(sizes):
        parts[c] = (first, max(1, -(-sizes[c] // SHARD_ROWS)))
        first += parts[c][1]

    @F.pandas_udf(LongType())
    def shard(cells: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([parts[c][0] + h % parts[c][1] for c, h in zip(cells, hashes)], dtype="int64")

    made = written(placed.withColumn("shard", shard("cell", F.xxhash64("vec_id", "vector"))).drop("cell"), "shards")
    discard(placed)

    def boxed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each batch the boxes of its shards' rows."""
        for batch in batches:
            out = [(s, n, v.min(axis=0).tolist(), v.max(axis=0).tolist()) for (s, n), rows in batch.groupby(["shard", "length"]) for v in [_vectors(rows["vector"])]]
            yield pd.DataFrame(out, columns=["shard", "length", "low", "high"])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Boxes of rows in the order of shards, drawn together; a shard's last one may come again."""
        for batch in batches:
            out = [(s, n, np.stack(rows["low"]).min(axis=0).tolist(), np.stack(rows["high"]).max(axis=0).tolist()) for (s, n), rows in batch.groupby(["shard", "length"])]
            yield pd.DataFrame(out, columns=["shard", "length", "low", "high"])

    kind = "shard long, length int, low array<long>, high array<long>"
    part = made.select("shard", "length", "vector").mapInPandas(boxed, kind)
    drawn = written(part.repartition("shard").sortWithinPartitions("shard", "length").mapInPandas(joined, kind), "boxes")
    size = drawn.agg(F.coalesce(F.sum(16 * F.size("low")), F.lit(0))).first()[0]
    rows = drawn.collect() if size <= BOX_BYTES else drawn.groupBy("length").agg(F.collect_set("shard").alias("shards")).collect()
    boxes = Boxes(rows) if size <= BOX_BYTES else Unbounded(rows)
    discard(drawn)
    made.shards = max(1, first)
    return made, boxes


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the k best ``vectors`` of every query; both hold integer vectors."""

    def narrow(df: DataFrame) -> DataFrame:
        return df.filter(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.size(vector).alias("length"))

    def counted(df: DataFrame) -> DataFrame:
        return df.groupBy("vec_id", "vector", "length").agg(F.count(F.lit(1)).alias("times"))

    vectors, queries = written(counted(narrow(vectors)), "vectors"), counted(narrow(queries))
    held, boxes = _sharded(vectors)
    shards = held.shards
    discard(vectors)
    held = held.select("shard", "length", F.lit(False).alias("asks"), "vec_id", "vector", "times", F.lit(None).cast("string").alias("digest"), F.lit(SMALLEST).alias("kth"))
    asked = queries.withColumn("digest", F.sha2(F.array_join(F.col("vector").cast("array<string>"), ","), 256))

    @F.pandas_udf(LongType())
    def home(vectors: pd.Series) -> pd.Series:
        """The shard of the best bound, or -1 where no vector has this length."""
        best = []
        for v in vectors:
            numbers, bounds = boxes.bounds(np.asarray(v, np.int64))
            best.append(int(numbers[bounds.argmax()]) if len(numbers) else -1)
        return pd.Series(best, dtype="int64")

    @F.pandas_udf(ArrayType(LongType()))
    def others(vectors: pd.Series, home: pd.Series, kth: pd.Series) -> pd.Series:
        """The other shards whose bound reaches the kth score."""
        out = []
        for v, h, least in zip(vectors, home, kth):
            numbers, bounds = boxes.bounds(np.asarray(v, np.int64))
            out.append(numbers[(bounds >= least) & (numbers != h)].tolist())
        return pd.Series(out, dtype=object)

    def searched(asking: DataFrame) -> DataFrame:
        both = held.unionByName(asking.withColumn("asks", F.lit(True)).select(held.columns))
        ordered = both.repartition(shards, "shard").sortWithinPartitions("shard", "length", "asks")
        return ordered.mapInPandas(_search(k), FOUND)

    of_row = Window.partitionBy("query_id", "digest").orderBy(F.desc("score"), "vec_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    asked = written(asked.withColumn("home", home("vector")).filter("home >= 0"), "asked")
    first = written(searched(asked.withColumn("shard", F.col("home")).withColumn("kth", F.lit(SMALLEST))), "home-shards")
    kth = first.withColumn("rank", F.row_number().over(of_row)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "digest", F.col("score").alias("kth"))
    told = asked.join(kth, ["vec_id", "digest"], "left").withColumn("kth", F.coalesce("kth", F.lit(SMALLEST)))
    rest = searched(told.withColumn("shard", F.explode(others("vector", "home", "kth"))))
    each = first.union(rest).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k).cast("long")))))
    ranked = each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
