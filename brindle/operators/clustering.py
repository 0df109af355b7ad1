"""Clustering of (id, features) points: Lloyd's K-Means and chunked BFR.

Centres and cluster statistics are k rows of d numbers: they are collected and go to the tasks. Points
meet centres in batches as matrices; as expressions, k times d literals took longer to plan than to run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from brindle.functions.numeric import mahalanobis
from brindle.sources.shared import written

Centres = dict[int, list[float]]


def _literal(values: list[float]) -> Column:
    return F.lit([float(v) for v in values])


def _matrix(features: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the points that have d numbers, and these."""
    whole = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(features), d), False).to_numpy(zero_copy_only=False))
    flat = features.take(pa.array(whole)).flatten()
    if flat.null_count:
        some = ~pc.is_null(flat).to_numpy(zero_copy_only=False).reshape(-1, d).any(1)
        whole = whole[some]
        flat = features.take(pa.array(whole)).flatten()
    return whole, flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squares are added dimension by dimension, as `distance` adds them, so that ties are the same."""
    total = np.zeros((len(x), len(centres)))
    for i in range(centres.shape[1]):
        apart = x[:, i, None] - centres[:, i]
        total += apart * apart
    return np.sqrt(total)


def _sorted(centres: Centres) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the clusters, and the centres."""
    return np.array(sorted(centres), np.int32), np.array([centres[k] for k in sorted(centres)], np.float64)


def assigned(points: DataFrame, centres: Centres) -> DataFrame:
    """id, features, cluster, distance. Ties go to the least cluster, and points without as many numbers as the centres
    have, at no distance."""
    numbers, at = _sorted(centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, x = _matrix(batch.column(1), at.shape[1])
            far = _distances(x, at)
            best = far.argmin(1)
            cluster, apart, none = np.full(batch.num_rows, numbers[0]), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            cluster[whole], apart[whole], none[whole] = numbers[best], far[np.arange(len(x)), best], False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster), pa.array(apart, mask=none)], names=["id", "features", "cluster", "distance"])

    points = points.select("id", "features")
    return points.mapInArrow(work, StructType([*points.schema.fields, StructField("cluster", IntegerType()), StructField("distance", DoubleType())]))


def moved(points: DataFrame, centres: Centres) -> tuple[Centres, float]:
    """The means of the points nearest to each centre, and the sum of their distances, in one pass: a task hands on
    a row per cluster. Empty clusters vanish."""
    numbers, at = _sorted(centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, cost = np.zeros(len(at), np.int64), np.zeros(at.shape), np.zeros(len(at))
        for batch in batches:
            _, x = _matrix(batch.column(0), at.shape[1])
            far = _distances(x, at)
            best = far.argmin(1)
            n += np.bincount(best, minlength=len(at))
            cost += np.bincount(best, far[np.arange(len(x)), best], len(at))
            total += (best == np.arange(len(at))[:, None]).astype(np.float64) @ x
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.float64())), pa.array(cost[some])], names=["k", "n", "total", "cost"])

    n, total, cost = np.zeros(len(at), np.int64), np.zeros(at.shape), 0.0
    for r in points.select("features").mapInArrow(work, "k long, n long, total array<double>, cost double").toLocalIterator():
        n[r.k] += r.n
        total[r.k] += r.total
        cost += r.cost
    return {int(numbers[k]): (total[k] / n[k]).tolist() for k in np.flatnonzero(n)}, float(cost)


def statistics(clustered: DataFrame) -> DataFrame:
    """(cluster, n, sum, sumsq): what a set of points leaves behind."""
    long = clustered.select("cluster", F.posexplode("features").alias("i", "x")).groupBy("cluster", "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    parts = F.array_sort(F.collect_list(F.struct("i", "s", "q")))
    return long.groupBy("cluster").agg(F.max("n").alias("n"), parts.alias("p")).select("cluster", "n", F.transform("p", lambda s: s.s).alias("sum"), F.transform("p", lambda s: s.q).alias("sumsq"))


def farthest_first(points: DataFrame, k: int, first: int | None = None) -> Centres:
    """k spread-out points: each next one maximises the distance to its nearest chosen one (ties: the
    least id). The first is given, or the one whose id hashes lowest."""
    points = points.select("id", "features")
    start = points.where(F.col("id") == first) if first is not None else points.orderBy(F.xxhash64("id"), "id")
    row = start.first()
    centres: Centres = {}
    while row is not None and len(centres) < k:
        centres[len(centres)] = list(row.features)
        row = _farthest(points, centres).orderBy(F.desc("d"), "id").first() if len(centres) < k else None
    return centres


def _farthest(points: DataFrame, centres: Centres) -> DataFrame:
    """(id, features, d): a batch's points that are farthest from their nearest centre, at more than 0."""
    _, at = _sorted(centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, x = _matrix(batch.column(1), at.shape[1])
            d = _distances(x, at).min(1)
            # as in Spark, NaN is more than any number
            order = np.where(np.isnan(d), np.inf, d)
            best = np.flatnonzero((order == order.max(initial=0)) & (order > 0))
            picked = pa.array(whole[best])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), pa.array(d[best])], names=["id", "features", "d"])

    return points.mapInArrow(work, StructType([*points.schema.fields, StructField("d", DoubleType())]))


def lloyd(points: DataFrame, centres: Centres, rounds: int = 100) -> tuple[Centres, DataFrame]:
    """Until the sum of distances stops falling, or for so many rounds. Empty clusters vanish."""
    best = float("inf")
    for _ in range(rounds):
        new, cost = moved(points, centres)
        if cost >= best:
            break
        best = cost
        centres = new
    return centres, assigned(points, centres)


def kmeans(points: DataFrame, k: int, rounds: int = 100) -> DataFrame:
    """(id, cluster) from farthest-first centres."""
    return lloyd(points, farthest_first(points, k), rounds)[1].select("id", "cluster")


def kmeans_builtin(points: DataFrame, k: int, seed: int = 2, rounds: int = 20) -> DataFrame:
    """The same by the library's distributed K-Means."""
    vectors = points.withColumn("v", array_to_vector("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="v", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).select("id", "features", "cluster")


class Cluster(NamedTuple):
    n: int
    sum: list[float]
    sumsq: list[float]

    def merged(self, other: Cluster) -> Cluster:
        return Cluster(self.n + other.n, [a + b for a, b in zip(self.sum, other.sum)], [a + b for a, b in zip(self.sumsq, other.sumsq)])

    @property
    def centre(self) -> list[float]:
        return [s / self.n for s in self.sum]

    @property
    def variance(self) -> list[float]:
        return [max(q / self.n - (s / self.n) ** 2, 0.0) for s, q in zip(self.sum, self.sumsq)]


def _near(features: Column, clusters: dict[int, Cluster], limit: float) -> Column:
    """Number of the cluster nearest by Mahalanobis distance, null beyond the limit."""
    if not clusters:
        return F.lit(None).cast("int")
    parts = [F.struct(mahalanobis(features, _literal(c.centre), _literal(c.variance)).alias("distance"), F.lit(k).alias("cluster")) for k, c in sorted(clusters.items())]
    best = F.array_min(F.array(*parts))
    return F.when(best["distance"] <= limit, best["cluster"])


class Bfr:
    """Bradley-Fayyad-Reina over chunks. `discard` and `compressed` hold statistics only; retained
    points stay as a table. Every point's membership is kept: compressed clusters that later merge,
    or end up in a discard cluster, take their points along by a mapping of cluster numbers."""

    def __init__(self, k: int, small: int = 20, sample: int = 5000, rounds: int = 200) -> None:
        self.k, self.small, self.sample, self.rounds = k, small, sample, rounds
        self.discard: dict[int, Cluster] = {}
        self.compressed: dict[int, Cluster] = {}
        self.mapping: dict[int, tuple[str, int]] = {}
        self.members: list[DataFrame] = []
        self.retained: DataFrame | None = None
        self.reports: list[tuple[int, int, int, int, int, int]] = []
        self._next = 0

    def _members(self) -> DataFrame:
        every = self.members[0]
        for m in self.members[1:]:
            every = every.unionByName(m)
        return every

    def _absorb(self, clustered: DataFrame, into: dict[int, Cluster]) -> None:
        for r in statistics(clustered).collect():
            new = Cluster(r.n, r.sum, r.sumsq)
            into[r.cluster] = into[r.cluster].merged(new) if r.cluster in into else new

    def _cluster(self, points: DataFrame, k: int) -> DataFrame:
        k = min(k, points.count())
        return written(kmeans_builtin(points, k, rounds=self.rounds), "clustered") if k >= 2 else points.withColumn("cluster", F.lit(0))

    def _start(self, points: DataFrame) -> DataFrame:
        """Discard clusters from a sample of the first chunk, without its outliers; the other points."""
        picked = written(points.orderBy(F.xxhash64("id"), "id").limit(self.sample), "sample")
        fine = self._cluster(picked, 5 * self.k)
        sizes = fine.groupBy("cluster").agg(F.count("*").alias("n"))
        core = fine.join(F.broadcast(sizes.where(F.col("n") >= self.small).select("cluster")), "cluster", "left_semi").select("id", "features")
        core = written(core if core.limit(1).count() else picked, "core")
        clustered = self._cluster(core, self.k)
        self._absorb(clustered, self.discard)
        self.members.append(clustered.select("id", F.lit("discard").alias("kind"), F.col("cluster").cast("int").alias("number")))
        return points.join(core.select("id"), "id", "left_anti")

    def add(self, points: DataFrame) -> None:
        """One chunk of (id, features)."""
        points = written(points.select("id", "features"), "chunk")
        if not points.limit(1).count():
            return
        if not self.discard:
            points = self._start(points)
        limit = 2 * len(next(iter(self.discard.values())).sum) ** 0.5
        placed = points.withColumn("d", _near(F.col("features"), self.discard, limit)).withColumn("c", _near(F.col("features"), self.compressed, limit))
        placed = written(placed, "placed")
        for kind, column, where, into in (("discard", "d", "d is not null", self.discard), ("compressed", "c", "d is null and c is not null", self.compressed)):
            taken = placed.where(where).select("id", "features", F.col(column).alias("cluster"))
            self._absorb(taken, into)
            self.members.append(taken.select("id", F.lit(kind).alias("kind"), F.col("cluster").cast("int").alias("number")))
        rest = placed.where("d is null and c is null").select("id", "features")
        rest = rest if self.retained is None else rest.unionByName(self.retained)
        self._compress(written(rest, "rest"))
        self._merge(limit)
        held = self.retained.count() if self.retained is not None else 0
        self.reports.append((len(self.reports) + 1, len(self.discard), sum(c.n for c in self.discard.values()), len(self.compressed), sum(c.n for c in self.compressed.values()), held))

    def _compress(self, rest: DataFrame) -> None:
        """Retained points that cluster become compressed clusters; single ones stay."""
        clustered = self._cluster(rest, 5 * self.k)
        sizes = clustered.groupBy("cluster").agg(F.count("*").alias("n"))
        shared = {r.cluster: i for i, r in enumerate(sizes.where("n > 1").orderBy("cluster").collect(), self._next)}
        self._next += len(shared)
        if not shared:
            self.retained = rest
            return
        number = F.create_map(*(F.lit(x) for pair in shared.items() for x in pair))
        known = clustered.withColumn("number", F.try_element_at(number, F.col("cluster")))
        taken = written(known.where("number is not null").select("id", "features", F.col("number").alias("cluster")), "compressed")
        self._absorb(taken, self.compressed)
        self.members.append(taken.select("id", F.lit("compressed").alias("kind"), F.col("cluster").cast("int").alias("number")))
        self.retained = written(known.where("number is null").select("id", "features"), "retained")

    def _merge(self, limit: float) -> None:
        """Compressed clusters whose centres are close to each other become one."""
        merged = True
        while merged:
            merged = False
            for a in sorted(self.compressed):
                for b in sorted(self.compressed):
                    if a < b and _apart(self.compressed[a], self.compressed[b]) < limit:
                        self.compressed[a] = self.compressed[a].merged(self.compressed.pop(b))
                        self.mapping[b] = ("compressed", a)
                        merged = True
                        break
                if merged:
                    break

    def finish(self, points: DataFrame | None = None) -> DataFrame:
        """(id, cluster) of all points. With `points` (id, features), every compressed or retained point
        joins the discard cluster whose centre is nearest. Without, compressed clusters join the nearest
        discard cluster within the limit, and -1 stands for outliers."""
        if not self.discard:
            raise ValueError("no points")
        if points is not None:
            fixed = written(self._members().where("kind = 'discard'").select("id", F.col("number").alias("cluster")), "fixed")
            left = points.join(fixed.select("id"), "id", "left_anti")
            return fixed.unionByName(assigned(left, {k: c.centre for k, c in self.discard.items()}).select("id", "cluster"))
        limit = 2 * len(next(iter(self.discard.values())).sum) ** 0.5
        for number, c in sorted(self.compressed.items()):
            gap, best = min((_apart(d, c), k) for k, d in self.discard.items())
            if gap < limit:
                self.mapping[number] = ("discard", best)

        def final(kind: str, number: int) -> int:
            while kind == "compressed":
                if number not in self.mapping:
                    return -1
                kind, number = self.mapping[number]
            return number

        numbers = {n: final("compressed", n) for n in range(self._next)}
        to = F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair)) if numbers else F.create_map(F.lit(-2), F.lit(-1))
        every = self._members()
        cluster = F.when(F.col("kind") == "discard", F.col("number")).otherwise(F.coalesce(F.try_element_at(to, F.col("number")), F.lit(-1)))
        out = every.select("id", cluster.alias("cluster"))
        return out.unionByName(self.retained.select("id", F.lit(-1).alias("cluster"))) if self.retained is not None else out


def _apart(a: Cluster, b: Cluster) -> float:
    return sum((x - y) ** 2 / max(v, 1e-9) for x, y, v in zip(a.centre, b.centre, a.variance)) ** 0.5
