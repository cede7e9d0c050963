"""Approximate nearest neighbours by cosine: low-dimensional stable projections, indexed by kd-trees, with a chi-square
stopping test.

Vectors are scaled to length 1, where the nearest by distance is the nearest by cosine, and projected on DIMENSIONS
Gaussian directions. The squared projected distance over the squared true distance then follows a chi-square
distribution. A query goes through the leaves of a kd-tree by increasing distance of their boxes, in rings that grow; of
a leaf it verifies, by true cosine, the vectors whose projected distance the chi-square test still allows: a nearer
vector would be projected so far only with a probability below MISS. It stops where no box is left that the test allows.
Queries of a shard share the work: a leaf meets all queries that ask for it as one matrix of projected distances.

The index is dealt out by the top splits of a kd-tree over the projections, fitted on a bounded sample; all rows are
indexed. A query first searches its home shard, then every other shard whose box the same test does not rule out at the
distance found. Equal vectors are one entry with their smallest ids, so a vector with a third of all rows is one point.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yieldengine.staging import stage

DIMENSIONS = 24
MISS = 0.05
LEAF = 128
#: Rows of the sample that the shards' borders are fitted on; numbers of vectors that a shard is made for; shards at least.
SAMPLE, SHARD_NUMBERS, LEAST_SHARDS = 20_000, 1 << 22, 8
#: Queries that go through a shard side by side.
QUERIES = 64
SEED = 11


@lru_cache(maxsize=16)
def _directions(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, DIMENSIONS))


def _chance_of_less(x: np.ndarray | float) -> np.ndarray | float:
    """Chi-square distribution function with DIMENSIONS (even) degrees of freedom."""
    half = np.maximum(x, 0) / 2
    term = total = np.ones_like(half)
    for i in range(1, DIMENSIONS // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


_STOP = next(x for x in np.arange(0, 100, 0.01) if _chance_of_less(x) >= 1 - MISS)


def _arrays(column: pa.Array, dtype=np.float64) -> list[np.ndarray]:
    """The lists of a column without nulls as arrays over its buffers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    ends = column.offsets.to_numpy() - (column.offsets[0].as_py() if len(column) else 0)
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _lists(values: list[np.ndarray], kind: pa.DataType = pa.float64()) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _unit(values: np.ndarray) -> np.ndarray:
    scaled = values / np.abs(values).max()
    return scaled / np.sqrt(scaled @ scaled)


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as doubles with their projections of the unit vector.

    Each is projected by itself, so that its place is the same number in whatever batch it comes.
    """
    for batch in batches:
        keys, vectors, places = [], [], []
        for key, values in zip(batch.column(0).to_pylist(), _arrays(batch.column(1))):
            if not len(values) or not np.isfinite(values).all() or not values.any():
                continue
            keys.append(key)
            vectors.append(values)
            places.append(_unit(values) @ _directions(len(values)))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), _lists(vectors), _lists(places)], names=["vec_id", "vector", "place"])


class Splits:
    """The top of a kd-tree: halving cuts of a sample, and the box of every shard."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros(1 << depth, dtype=np.int64)
        self.cut = np.zeros(1 << depth)
        self.low = np.full((1 << depth, DIMENSIONS), -np.inf)
        self.high = np.full((1 << depth, DIMENSIONS), np.inf)
        self._split(sample, 1, self.low[0].copy(), self.high[0].copy())

    def _split(self, points: np.ndarray, node: int, low: np.ndarray, high: np.ndarray) -> None:
        if node >= 1 << self.depth:
            shard = node - (1 << self.depth)
            self.low[shard], self.high[shard] = low, high
            return
        axis = int(np.argmax(points.std(axis=0))) if len(points) else 0
        cut = float(np.median(points[:, axis])) if len(points) else 0.0
        self.axis[node], self.cut[node] = axis, cut
        left, right = high.copy(), low.copy()
        left[axis] = right[axis] = cut
        self._split(points[points[:, axis] < cut], 2 * node, low, left)
        self._split(points[points[:, axis] >= cut], 2 * node + 1, right, high)

    def shard(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return node - (1 << self.depth)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared projected distance of a point to every shard's box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(axis=1)


class Tree:
    """kd-tree over the projections of one shard: leaves are runs of one permutation, with the box of each."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.points = points
        self.spans: list[tuple[int, int]] = []
        todo = [(0, len(points))]
        while todo:
            first, last = todo.pop()
            if last - first <= LEAF:
                self.spans.append((first, last))
                continue
            own = points[self.order[first:last]]
            axis, middle = int(np.argmax(own.max(axis=0) - own.min(axis=0))), (last - first) // 2
            self.order[first:last] = self.order[first:last][np.argpartition(own[:, axis], middle)]
            todo += [(first, first + middle), (first + middle, last)]
        boxes = [points[self.order[a:b]] for a, b in self.spans]
        self.low, self.high = np.stack([b.min(axis=0) for b in boxes]), np.stack([b.max(axis=0) for b in boxes])

    def rows(self, leaf: int) -> np.ndarray:
        return self.order[slice(*self.spans[leaf])]

    def distances(self, places: np.ndarray) -> np.ndarray:
        """Squared distances of points to the boxes of all leaves."""
        gap = np.maximum(np.maximum(self.low[None] - places[:, None], places[:, None] - self.high[None]), 0)
        return np.einsum("qld,qld->ql", gap, gap)


class Shard:
    """The entries of one shard: their vectors, smallest ids, and one kd-tree for each vector length."""

    def __init__(self, vectors: list[np.ndarray], ids: list[np.ndarray], places: np.ndarray):
        self.by_size: dict[int, tuple] = {}
        self.verified = self.asked = 0  # pairs of query and vector whose cosine was taken, and all of them
        for size in sorted({len(v) for v in vectors}):
            at = [i for i, v in enumerate(vectors) if len(v) == size]
            unit = np.stack([_unit(vectors[i]) for i in at])
            self.by_size[size] = (unit, [ids[i] for i in at], Tree(places[at]))

    def search(self, keys: list, vectors: list[np.ndarray], places: np.ndarray, k: int, least: np.ndarray, home: bool) -> list[list[tuple[float, int]]]:
        """Per query up to k entries' ids by cosine, ties to the smaller id.

        `least`: a cosine that k others reach already. At home a query's own row, once, is not counted.
        """
        found: list[list[tuple[float, int]]] = [[] for _ in keys]
        sizes = np.array([len(v) for v in vectors])
        for size in np.unique(sizes):
            if int(size) in self.by_size:
                of = np.flatnonzero(sizes == size)
                for x in range(0, len(of), QUERIES):
                    some = of[x : x + QUERIES]
                    best = self._rings(int(size), [keys[i] for i in some], np.stack([_unit(vectors[i]) for i in some]), places[some], k, least[some], home)
                    for i, own in zip(some, best):
                        found[i] = [(cosine, -other) for cosine, other in own]
        return found

    def _rings(self, size: int, keys: list, queries: np.ndarray, places: np.ndarray, k: int, least: np.ndarray, home: bool):
        unit, ids, tree = self.by_size[size]
        self.asked += len(keys) * len(unit)
        best: list[list[tuple[float, int]]] = [[] for _ in keys]  # (cosine, -id), heaps with the worst on top
        own = [home] * len(keys)
        reach = least.copy()
        boxes = tree.distances(places)
        order = np.argsort(boxes, axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(boxes.shape[1])[None], axis=1)

        def bound(of=slice(None)):
            return _STOP * np.maximum(2 - 2 * reach[of], 1e-12)

        first, last = 0, 1
        while first < boxes.shape[1]:
            ring = (rank >= first) & (rank < last) & (boxes <= bound()[:, None])
            if not ring.any():
                break  # boxes come by their distance, so none further on is allowed
            for leaf in np.flatnonzero(ring.any(axis=0)):
                at = np.flatnonzero(ring[:, leaf] & (boxes[:, leaf] <= bound()))
                if not len(at):
                    continue
                rows = tree.rows(leaf)
                points = tree.points[rows]
                far = (places[at] ** 2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None] - 2 * places[at] @ points.T
                near = far <= bound(at)[:, None] + 1e-9
                self.verified += int(near.sum())
                if not near.any():
                    continue
                hit, row = np.nonzero(near & (queries[at] @ unit[rows].T >= reach[at][:, None] - 1e-9))
                for q, r in zip(at[hit].tolist(), rows[row].tolist()):
                    cosine = float((unit[r] * queries[q]).sum())
                    if cosine < reach[q] - 1e-12:
                        continue
                    for other in ids[r].tolist():
                        if own[q] and other == keys[q] and np.array_equal(unit[r], queries[q]):
                            own[q] = False
                            continue
                        entry = (cosine, -other)
                        if len(best[q]) < k:
                            heapq.heappush(best[q], entry)
                        elif entry > best[q][0]:
                            heapq.heapreplace(best[q], entry)
                    if len(best[q]) == k:
                        reach[q] = max(least[q], best[q][0][0])
            first, last = last, last * 4
        return best


def _probe(k: int, home: bool):
    """Rows sorted by (shard, kind): a shard's entries (kind 0) become its trees, then queries (kind 1) search them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard = None, None
        entries: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            names = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            shards, kinds = names["shard"].to_numpy(), names["kind"].to_numpy()
            vectors, places, ids = _arrays(names["vector"]), _arrays(names["place"]), _arrays(names["ids"], np.int64)
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            out = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)]):
                if a == b:
                    continue
                if shards[a] != current:
                    current, shard, entries = shards[a], None, ([], [], [])
                if kinds[a] == 0:
                    for held, new in zip(entries, (vectors, ids, places)):
                        held += [v.copy() for v in new[a:b]]
                    continue
                if shard is None and entries[0]:
                    shard, entries = Shard(entries[0], entries[1], np.stack(entries[2])), ([], [], [])
                if shard is None:
                    continue
                keys, tags = names["key"].slice(a, b - a).to_pylist(), names["tag"].slice(a, b - a).to_pylist()
                reach = names["reach"].slice(a, b - a).to_numpy()
                found = shard.search(keys, vectors[a:b], np.stack(places[a:b]), k, reach, home)
                out += [(key, tag, other, cosine) for key, tag, own in zip(keys, tags, found) for cosine, other in own]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                names=["query_id", "tag", "vec_id", "score"],
            )

    return run


def _homes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.array(batch.column(batch.schema.get_field_index("place")).to_pylist()).reshape(-1, DIMENSIONS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shared.value.shard(places), pa.int64())], names=[*batch.schema.names, "shard"]
            )

    return run


def _others(shared):
    """The shards beside its home that a query has to search, by the cosine that its k-th neighbour at home reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            lists = []
            for place, home, reach in zip(columns["place"], columns["shard"], columns["reach"]):
                far = shared.value.distances(np.array(place))
                near = far <= _STOP * max(2 - 2 * reach, 1e-12)
                near[home] = False
                lists.append(np.flatnonzero(near).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*batch.schema.names, "others"])

    return run


def _searched(index: DataFrame, queries: DataFrame, k: int, home: bool) -> DataFrame:
    none = F.lit(None).cast("long")
    entries = index.select("shard", F.lit(0).alias("kind"), none.alias("key"), none.alias("tag"), "ids", "vector", "place", F.lit(-1.0).alias("reach"))
    asked = queries.select("shard", F.lit(1).alias("kind"), "key", "tag", F.array().cast("array<long>").alias("ids"), "vector", "place", "reach")
    return (
        entries.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")
        .mapInArrow(_probe(k, home), "query_id long, tag long, vec_id long, score double")
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per query the k nearest rows of `vectors` by cosine: query_id, rank from 1, vec_id, score (cosine, in doubles).

    Ties go to the smaller vec_id; a query's own row is no candidate, any other is, repeated rows and further vectors
    under an id included; with fewer than k candidates all are returned. Equal rows of `queries` are one query,
    different vectors under one id are ranked each by itself. Vectors that are null, empty, zero or hold a null or non-finite
    value take no part, nor do rows without an id. Only vectors of equal length are compared. Further columns are
    ignored; without queries or vectors the result is empty.
    """
    spark = vectors.sparkSession
    fields = "vec_id long, vector array<double>, place array<double>"

    def usable(table: DataFrame) -> DataFrame:
        given = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
        return given.where("vec_id is not null and vector is not null and not exists(vector, x -> x is null)")

    # equal vectors are one entry with the k + 1 smallest ids: enough even where the query is one of them; more are
    # left out before they are shuffled
    entries = stage(usable(vectors).mapInArrow(_projected, fields), "vectors")
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    numbered = (
        entries.withColumn("nth", nth).where(F.col("nth") <= k + 1)
        .groupBy("vector", "place").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    rows, size = entries.agg(F.count("*"), F.max(F.size("vector"))).first()
    sample = entries.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE).select("place").collect()
    depth = max(LEAST_SHARDS, -(-rows * (size or 1) // SHARD_NUMBERS)) - 1
    splits = Splits(np.array([r["place"] for r in sample]).reshape(-1, DIMENSIONS), depth.bit_length())
    shared = spark.sparkContext.broadcast(splits)
    index = stage(numbered.mapInArrow(_homes(shared), "vector array<double>, place array<double>, ids array<long>, shard long"), "vector-index")

    asked = usable(queries).dropDuplicates(["vec_id", "vector"]).mapInArrow(_projected, fields).withColumnRenamed("vec_id", "key")
    asked = asked.mapInArrow(_homes(shared), "key long, vector array<double>, place array<double>, shard long")
    asked = stage(asked.withColumn("tag", F.xxhash64("key", "vector")), "vector-queries")
    home = stage(_searched(index, asked.withColumn("reach", F.lit(-1.0)), k, True), "neighbours-at-home")
    reach = home.groupBy("tag").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    further = (
        asked.join(reach, "tag", "left")
        .select("key", "tag", "vector", "place", "shard", F.coalesce("least", F.lit(-1.0)).alias("reach"))
        .mapInArrow(_others(shared), "key long, tag long, vector array<double>, place array<double>, shard long, reach double, others array<long>")
        .select("key", "tag", "vector", "place", "reach", F.explode("others").alias("shard"))
    )
    found = home.unionByName(_searched(index, further, k, False))
    order = Window.partitionBy("tag").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
