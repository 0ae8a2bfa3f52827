"""Exact Lloyd clustering of integer vectors by two trees.

Vectors are dealt into shards of about ``SHARD_ROWS``, and each shard's cover
tree is built once and written: a node covers its vectors within its radius of
one of them, its children do so within half the next power of two, and the
children's centres lie further from each other than that.  Each round builds a
tree of balls over the centroids on the driver and goes down both trees in every
shard, a level of pairs at a time: of a pair, distances between centres and the
two radii bound the distances of all their members, and a centroid node whose
least distance exceeds the greatest one of another is left out.  A vector node
that is left with one centroid is assigned whole; the members of leaves are
compared exactly with the centroids that are left, in whole numbers.  Only sums
and counts of each cluster leave the tasks; only the centroids reach the driver.

The result is that of plain Lloyd rounds: pruning only leaves out what cannot be
nearest, and bounds have a margin above the error of their floating point.

Defined cases: vectors that are null, of another length, or hold null or
non-finite components take no part; rows without an id are clustered and begin
no cluster before all others have; equal ids begin in the order of their
vectors; repeated rows are vectors of their own; equally near centroids go by
smaller number; with fewer vectors than centroids each vector begins one, and
with none the result is empty; components, distances and their sums beyond 64
bits are cut to 64 bits after exact arithmetic; only id and vector are read, so
other columns may have any names.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tempora.llm.knn import integers
from tempora.llm.shared import discard, written

SHARD_ROWS, LEAF, PAIRS = 2048, 8, 16384
LARGEST = 2**63 - 1


def _apart(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    difference = points - centre
    return np.sqrt(np.einsum("ij,ij->i", difference, difference))


class CoverTree:
    """Nodes over rows of ``vectors``, which are put in the order of the leaves."""

    def __init__(self, vectors: np.ndarray):
        points = vectors.astype(np.float64)
        centre, radius, span, children = [], [], [], []
        order = np.arange(len(points))
        levels = [(order, _apart(points, points[0]))]
        centre.append(0)
        place = [0]
        at = 0
        while at < len(levels):  # breadth first, so children stand together
            rows, far = levels[at]
            levels[at] = ()
            radius.append(float(far.max()))
            span.append((place[at], place[at] + len(rows)))
            order[place[at] : place[at] + len(rows)] = rows
            first = len(levels)
            if len(rows) > LEAF and radius[-1] > 0:
                within = 2.0 ** (np.ceil(np.log2(radius[-1])) - 1)
                start, middle = place[at], centre[at]
                while len(rows):
                    near = far <= within
                    levels.append((rows[near], far[near]))
                    centre.append(middle)
                    place.append(start)
                    start += int(near.sum())
                    rows = rows[~near]
                    if len(rows):
                        middle = rows[0]
                        far = _apart(points[rows], points[middle])
            children.append((first, len(levels)))
            at += 1
        self.centre, self.radius, self.span, self.children, self.order = np.array(centre), np.array(radius), np.array(span), np.array(children), order

    def parts(self) -> dict[str, np.ndarray]:
        return {"centre": self.centre, "radius": self.radius, "span": self.span, "children": self.children}


class Balls:
    """Balls over centroids, halved at the median of the widest component; a leaf holds one."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = centroids
        points = np.array(centroids, np.float64)
        self.number, self.children, centre, radius = [], [], [], []
        todo = [np.arange(len(points))]
        for rows in todo:
            held = points[rows]
            middle = held.mean(axis=0) if len(rows) > 1 else held[0]
            centre.append(middle)
            radius.append(float(_apart(held, middle).max()))
            self.number.append(int(rows[0]) if len(rows) == 1 else -1)
            first = len(todo)
            if len(rows) > 1:
                widest = int((held.max(axis=0) - held.min(axis=0)).argmax())
                by = rows[np.argsort(held[:, widest], kind="stable")]
                todo += [by[: len(by) // 2], by[len(by) // 2 :]]
            self.children.append((first, len(todo)))
        self.number, self.children, self.centre, self.radius = np.array(self.number), np.array(self.children), np.array(centre), np.array(radius)


def _opened(nodes: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of ``nodes``, and which of these each belongs to."""
    first, sizes = children[nodes, 0], children[nodes, 1] - children[nodes, 0]
    of = np.repeat(np.arange(len(nodes)), sizes)
    return np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(of)), of


class Shard:
    """The vectors of one shard with their tree."""

    def __init__(self, data: bytes):
        held = np.load(io.BytesIO(data))
        self.vectors, self.centre, self.radius, self.span, self.children = (held[n] for n in ("vectors", "centre", "radius", "span", "children"))
        self.compared = 0

    @staticmethod
    def packed(vectors: np.ndarray, tree: CoverTree) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=vectors, **tree.parts())
        return out.getvalue()

    @cached_property
    def middles(self) -> np.ndarray:
        return self.vectors[self.centre].astype(np.float64)

    def nearest(self, balls: Balls) -> np.ndarray:
        """The number of the nearest centroid of every vector."""
        found = np.full(len(self.vectors), -1)
        scale = 1e-12 * (np.abs(self.middles).max() + np.abs(balls.centre).max()) * np.sqrt(self.middles.shape[1])
        v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
        leaves: list[np.ndarray] = []
        while len(v):
            apart = np.concatenate([self._between(v[i : i + PAIRS], c[i : i + PAIRS], balls) for i in range(0, len(v), PAIRS)])
            reach = self.radius[v] + balls.radius[c]
            starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))  # pairs of a vector node stand together
            sizes = np.diff(np.append(starts, len(v)))
            most = np.repeat(np.minimum.reduceat(apart + reach, starts), sizes)
            stay = apart - reach <= most + 1e-9 * most + scale
            v, c = v[stay], c[stay]
            starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            sizes = np.diff(np.append(starts, len(v)))
            single = balls.number[c] >= 0
            alone = np.repeat(sizes == 1, sizes) & single
            for node, ball in zip(v[alone], c[alone]):
                found[slice(*self.span[node])] = balls.number[ball]
            inner = self.children[v, 1] > self.children[v, 0]
            settled = np.repeat(np.logical_and.reduceat(single, starts), sizes) & ~inner & ~alone
            leaves.append(np.stack([v[settled], c[settled]]))
            more = ~alone & ~settled
            v, c, inner, single = v[more], c[more], inner[more], single[more]
            if not len(v):
                break
            starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            sizes = np.diff(np.append(starts, len(v)))
            widest = np.repeat(np.maximum.reduceat(np.where(single, -1.0, balls.radius[c]), starts), sizes)
            by_ball = (widest >= self.radius[v]) | ~inner
            by_ball &= widest >= 0
            # the larger side is opened: balls of these pairs, vector nodes of the others
            b_v, b_c = v[by_ball], c[by_ball]
            kept, opened = single[by_ball], ~single[by_ball]
            balls_of, of = _opened(b_c[opened], balls.children)
            n_v, n_c = v[~by_ball], c[~by_ball]
            nodes_of, at = _opened(n_v, self.children)
            v = np.concatenate([b_v[kept], b_v[opened][of], nodes_of])
            c = np.concatenate([b_c[kept], balls_of, n_c[at]])
            order = np.argsort(v, kind="stable")
            v, c = v[order], c[order]
        self._compare(np.concatenate(leaves, axis=1), balls, found)
        return found

    def _between(self, v: np.ndarray, c: np.ndarray, balls: Balls) -> np.ndarray:
        difference = self.middles[v] - balls.centre[c]
        return np.sqrt(np.einsum("ij,ij->i", difference, difference))

    def _compare(self, pairs: np.ndarray, balls: Balls, found: np.ndarray) -> None:
        """Members of leaves against the centroids that are left, exactly; at equal distance the smaller number."""
        order = np.lexsort((balls.number[pairs[1]], pairs[0]))
        v, number = pairs[0][order], balls.number[pairs[1][order]]
        sizes = self.span[v, 1] - self.span[v, 0]
        for part in np.array_split(np.arange(len(v)), max(1, -(-int(sizes.sum()) // PAIRS))):
            rows = np.concatenate([np.arange(*self.span[v[i]]) for i in part]) if len(part) else np.empty(0, np.int64)
            asked = np.repeat(number[part], sizes[part])
            self._keep_nearest(rows, asked, balls, found)

    def _keep_nearest(self, rows: np.ndarray, asked: np.ndarray, balls: Balls, found: np.ndarray) -> None:
        # what earlier parts found is asked again, as a leaf's centroids may be in two parts
        again = np.unique(rows[found[rows] >= 0])
        rows, asked = np.concatenate([rows, again]), np.concatenate([asked, found[again]])
        self.compared += len(rows)
        far = self.squares(rows, asked, balls)
        order = np.lexsort((asked, far, rows))
        first = np.concatenate([[True], rows[order][1:] != rows[order][:-1]]) if len(order) else np.empty(0, bool)
        found[rows[order][first]] = asked[order][first]

    def squares(self, rows: np.ndarray, numbers: np.ndarray, balls: Balls) -> np.ndarray:
        """Exact squared distances of vectors and centroids."""
        most = max((abs(int(x)) for x in (self.vectors.max(initial=0), self.vectors.min(initial=0))), default=0)
        most = max(most, max(abs(x) for centroid in balls.exact for x in centroid))
        kind = np.int64 if 4 * most * most * self.vectors.shape[1] < 2**62 else object
        centroids = np.array(balls.exact, dtype=kind)
        if kind is object:
            return np.array([sum((int(a) - b) ** 2 for a, b in zip(self.vectors[r], centroids[n])) for r, n in zip(rows, numbers)], dtype=object)
        difference = self.vectors[rows].astype(np.int64) - centroids[numbers]
        return np.einsum("ij,ij->i", difference, difference)

    def sums(self, numbers: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """``(cluster, rows, sum of each component)``."""
        order = np.argsort(numbers, kind="stable")
        of, starts = np.unique(numbers[order], return_index=True)
        for cluster, rows in zip(of, np.split(order, starts[1:])):
            # of halves of 32 bits, so that no sum leaves 64 bits
            held = self.vectors[rows].astype(np.int64)
            high, low = (held >> 32).sum(axis=0), (held & 0xFFFFFFFF).sum(axis=0)
            yield int(cluster), len(rows), [(int(h) << 32) + int(x) for h, x in zip(high, low)]


def _shards(vectors: DataFrame) -> DataFrame:
    """``(ids, tree)`` of every shard of ``vectors(vec_id, vector)``."""
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    # rows are dealt out by their place in the table, so equal rows are not one shard
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def built(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        lists = rows["vector"].combine_chunks()
        vectors = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        if np.abs(vectors.astype(np.float64)).max(initial=0) < 2**31 - 1:
            vectors = vectors.astype(np.int32)
        tree = CoverTree(vectors)
        ids = rows["vec_id"].combine_chunks().take(pa.array(tree.order))
        return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([Shard.packed(vectors[tree.order], _moved(tree))], pa.binary())], names=["ids", "tree"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1), len(number)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b and held and number[a] != of:
                    yield built(held)
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
                    of = number[a]
        if held:
            yield built(held)

    ordered = dealt.select("shard", "vec_id", "vector").repartition("shard").sortWithinPartitions("shard")
    return written(ordered.mapInArrow(build, "ids array<long>, tree binary"), "trees")


def _moved(tree: CoverTree) -> CoverTree:
    """Centres as places in the order of the leaves."""
    place = np.empty(len(tree.order), np.int64)
    place[tree.order] = np.arange(len(tree.order))
    tree.centre = place[tree.centre]
    return tree


def _round(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: exact floors of means, and those of empty clusters as they were."""
    balls = Balls(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for data in batch.column(0):
                shard = Shard(data.as_py())
                for cluster, n, sums in shard.sums(shard.nearest(balls)):
                    before, held = total.get(cluster, (0, [0] * len(sums)))
                    total[cluster] = before + n, [a + b for a, b in zip(held, sums)]
        rows = [(c, k, n, str(s)) for c, (n, sums) in total.items() for k, s in enumerate(sums)]
        columns = zip(*rows) if rows else [[]] * 4
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["cluster", "k", "n", "total"])

    parts = trees.select("tree").mapInArrow(assign, "cluster int, k int, n long, total string")
    sums = parts.groupBy("cluster", "k").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    after = [list(c) for c in centroids]
    for r in sums.collect():  # as many rows as centroids have components
        after[r.cluster][r.k] = int(r.total) // r.n
    return after


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """``(vec_id, cluster, distance)`` of every row of ``vectors(vec_id, vector)``, and the last centroids.

    The first centroids are the k vectors with the smallest SHA-256 of ``<seed>:<vec_id>``.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [list(r.vector) for r in vectors.orderBy(by.asc_nulls_last(), "vector").limit(k).collect()]
    trees = _shards(vectors)
    if centroids:
        for _ in range(rounds):
            centroids = _round(trees, centroids)
    balls = Balls(centroids) if centroids else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column(0), batch.column(1)):
                shard = Shard(data.as_py())
                numbers = shard.nearest(balls)
                far = [min(int(x), LARGEST) for x in shard.squares(np.arange(len(numbers)), numbers, balls)]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(numbers, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = written(trees.select("ids", "tree").mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    discard(trees)
    return assigned, centroids


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, length: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of the usable ``vectors``, each component x as floor(scale * x)."""
    usable = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector")).filter(F.size("vector") == length)
    assigned, centroids = lloyd(integers(usable, "vector", scale), k, rounds, seed)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # a row a centroid
    whole = min(sum(int(r.total) for r in sums), LARGEST)
    told = [(r.cluster, min(int(r.total), LARGEST), whole, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in sums]
    of_cluster = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
