"""Centroid clustering with adaptive lower bounds for each vector.

Beside its cluster, a vector keeps the numbers of its several next centroids, a lower bound on the distance to each of
these, one more bound that holds for all the rest, and an upper bound on the distance to its own centroid. When centroids
move, the bounds move with them: by how far its own went, by how far each of the next ones went, and for the rest by the
longest move of all. Then

* if all lower bounds lie above the upper one, the vector stays where it is and no distance is computed;
* if those from some place of its list on do, only the centroids before that place are compared, and the list is ordered
  anew up to there;
* otherwise the ordering can't be certified, and the vector is compared with all centroids.

How many centroids are kept adapts: a round keeps as many as the one before needed, between an eighth and a quarter of
all and at least two. Distances that decide are exact integers, bounds give way by more than what floating point can be
wrong, and ties are always compared, so clusters are those of comparing everything.

Scale: a round is one pass over written vectors with their bounds, partition by partition, and writes the next; the table
before goes. Only vectors that changed their cluster are read to move centroids: sums and counts by cluster are kept on the
driver as k times dim integers, and so much is sent to the tasks. No row is shuffled, so no cluster's size matters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .knn_join import SCALE, quantised

DIM, CLUSTERS, ROUNDS, SEED = 64, 8, 10, 3
#: Rows that are compared at once.
AT_ONCE = 4096
#: What bounds give way by, as a share and as a distance.
SLACK, NUDGE = 1e-12, 1e-9
STATE = "own int, before int, near array<int>, lower array<double>, rest double, upper double, needed int"


def exact_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows; by floating point only where all sums stay below 2**53."""
    most = float(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 2.0**53:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], axis=1) if len(c) else np.zeros((len(x), 0), dtype=np.int64)


def exact_to(x: np.ndarray, c: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The squared distance of each row of x to one row of c."""
    d = x - c[which]
    return np.einsum("ij,ij->i", d, d)


def _below(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK) - NUDGE


def _above(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK) + NUDGE


class Bounds:
    """The state of some vectors: own cluster, next centroids in order with lower bounds, a bound for the rest, an upper one."""

    def __init__(self, own: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray, upper: np.ndarray) -> None:
        self.own, self.near, self.lower, self.rest, self.upper = own, near, lower, rest, upper
        self.needed = np.zeros(len(own), dtype=np.int32)
        self.compared = 0

    @classmethod
    def start(cls, n: int, keep: int) -> Bounds:
        """Nothing is known yet."""
        return cls(np.full(n, -1, dtype=np.int32), np.zeros((n, keep), dtype=np.int32), np.zeros((n, keep)), np.zeros(n), np.full(n, np.inf))

    def moved(self, far: np.ndarray, keep: int) -> None:
        """Centroid j went at most far[j]; from now on, at most keep next centroids are held."""
        self.upper = _above(self.upper + far[self.own])
        self.lower = _below(self.lower - far[self.near])
        self.rest = _below(self.rest - far.max(initial=0))
        if keep < self.near.shape[1]:  # what is no longer held joins the rest
            self.rest = np.minimum(self.rest, self.lower[:, keep:].min(axis=1))
            self.near, self.lower = self.near[:, :keep].copy(), self.lower[:, :keep].copy()

    def assign(self, x: np.ndarray, c: np.ndarray) -> None:
        """The nearest of the centroids c for each row of x, the smaller number of equals."""
        keep, k = self.near.shape[1], len(c)
        ahead = np.minimum.accumulate(np.c_[self.lower, self.rest][:, ::-1], axis=1)[:, ::-1]  # the least bound from a place on
        open_ = np.flatnonzero((self.own < 0) | (self.upper >= ahead[:, 0]))
        known = open_[self.own[open_] >= 0]
        if len(known):  # the upper bound may be loose
            self.upper[known] = _above(np.sqrt(exact_to(x[known], c, self.own[known]).astype(float)))
            self.compared += len(known)
            open_ = np.r_[open_[self.own[open_] < 0], known[self.upper[known] >= ahead[known, 0]]]
        certain = self.upper[open_, None] < ahead[open_]
        place = np.where(certain.any(axis=1) & (self.own[open_] >= 0), certain.argmax(axis=1), keep + 1)
        for z in np.unique(place).tolist():
            rows = open_[place == z]
            if z <= keep:
                self._reorder(rows, x, c, z)
            else:
                self._rescan(rows, x, c, min(keep, k - 1))
        self.needed[open_] = np.minimum(place, keep)

    def _reorder(self, rows: np.ndarray, x: np.ndarray, c: np.ndarray, z: int) -> None:
        """Own centroid and the first z next ones are compared; all others are certain to be farther."""
        names = np.c_[self.own[rows], self.near[rows, :z]]
        d = np.stack([exact_to(x[rows], c, names[:, j]) for j in range(z + 1)], axis=1)
        order = np.lexsort((names, d), axis=1)
        names, root = np.take_along_axis(names, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(float))
        self.own[rows], self.upper[rows] = names[:, 0], _above(root[:, 0])
        self.near[rows, :z], self.lower[rows, :z] = names[:, 1:], _below(root[:, 1:])
        self.compared += z * len(rows)

    def _rescan(self, rows: np.ndarray, x: np.ndarray, c: np.ndarray, keep: int) -> None:
        d = exact_distances(x[rows], c)
        order = np.argsort(d, axis=1, kind="stable")
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(float))
        self.own[rows], self.upper[rows] = order[:, 0], _above(root[:, 0])
        self.near[rows, :keep], self.lower[rows, :keep] = order[:, 1 : keep + 1], _below(root[:, 1 : keep + 1])
        self.rest[rows] = _below(root[:, keep + 1]) if len(c) > keep + 1 else np.inf
        if keep < self.near.shape[1]:  # fewer centroids than places
            self.near[rows, keep:], self.lower[rows, keep:] = 0, np.inf
        self.compared += d.size


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), kind))


def _round(table: DataFrame, centroids: np.ndarray, far: np.ndarray | None, keep: int) -> DataFrame:
    """The rows of table (row, v, state) with the state after one assignment; far is None at the first."""
    dim = centroids.shape[1]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(at, AT_ONCE)
                x = _matrix(b.column("v"), dim)
                if far is None:
                    bounds = Bounds.start(len(x), keep)
                else:
                    held = len(b.column("near")[0])
                    bounds = Bounds(b.column("own").to_numpy().copy(), _matrix(b.column("near"), held).copy(), _matrix(b.column("lower"), held), b.column("rest").to_numpy(), b.column("upper").to_numpy())
                    bounds.moved(far, keep)
                before = bounds.own.copy()
                bounds.assign(x, centroids)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("v"), pa.array(bounds.own), pa.array(before), _lists(bounds.near, pa.int32()), _lists(bounds.lower, pa.float64()), pa.array(bounds.rest), pa.array(bounds.upper), pa.array(bounds.needed)],
                    names=["id", "v", "own", "before", "near", "lower", "rest", "upper", "needed"],
                )

    kind = table.schema["id"].dataType.simpleString()
    return shared.write_out(table.mapInArrow(step, f"id {kind}, v array<bigint>, {STATE}"), "round")


def _changes(table: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What changed clusters add to the counts and sums of clusters, as Python integers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=object), np.zeros((k, dim), dtype=object)
        for b in batches:
            x = _matrix(b.column("v"), dim)
            for name, sign in (("own", 1), ("before", -1)):
                where = b.column(name).to_numpy()
                for j in np.unique(where[where >= 0]).tolist():
                    rows = x[where == j]
                    count[j] += sign * len(rows)
                    high, low = (rows >> 32).sum(axis=0), (rows & 0xFFFFFFFF).sum(axis=0)
                    total[j] += sign * (high.astype(object) * (1 << 32) + low.astype(object))
        at = [(j, p) for j in range(k) for p in range(-1, dim)]
        values = [str(int(count[j] if p < 0 else total[j][p])) for j, p in at]
        yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in at], pa.int32()), pa.array([p for _, p in at], pa.int32()), pa.array(values)], names=["j", "p", "value"])

    rows = table.where("own <> before").select("v", "own", "before").mapInArrow(add, "j int, p int, value string")
    found = rows.groupBy("j", "p").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # k * (dim + 1) rows
    count, total = np.zeros(k, dtype=object), np.zeros((k, dim), dtype=object)
    for r in found:
        if r["p"] < 0:
            count[r["j"]] = int(r["value"])
        else:
            total[r["j"], r["p"]] = int(r["value"])
    return count, total


def cluster(vectors: DataFrame, first: Column, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, report: list | None = None) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of each vector of dim finite components.

    Components are floor(scale * x). Centroids start as the k vectors with the smallest first (nulls last), ties by id (null ids last),
    then by components; with fewer vectors there are fewer. Each of the rounds assigns all vectors to the nearest
    centroid (of equals the smaller number) and moves each non-empty one to the floor of its vectors' mean; then vectors are
    assigned once more. Vectors that are null, of another length, or hold null or non-finite components have no row.
    Repeated rows count each. An empty table gives an empty result. Squared distances must stay below 2**63. report, if
    given, gets a row for each assignment: next centroids kept, vectors that changed, the most that were needed.
    """
    v = quantised(F.col(vec_col), scale)
    mark = shared.written()
    slim = vectors.select(F.col(id_col).alias("id"), first.alias("first"), v.alias("v")).where(F.size("v") == dim)
    rows = shared.write_out(slim, "vectors")
    start = rows.orderBy(F.asc_nulls_last("first"), F.asc_nulls_last("id"), "v").limit(k).select("v").collect()
    kind = vectors.schema[id_col].dataType.simpleString()
    if not start:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = np.array([r["v"] for r in start], dtype=np.int64)
    k = len(centroids)
    keep, far, now = max(2, -(-k // 4)), None, rows.drop("first")
    count, total = np.zeros(k, dtype=object), np.zeros((k, dim), dtype=object)
    for n in range(rounds + 1):
        new = _round(now, centroids, far, keep)
        shared.drop(now)
        now = new
        if report is not None or n < rounds:
            used = now.agg(F.max("needed").alias("needed"), F.count(F.when(F.col("own") != F.col("before"), 1)).alias("changed")).first()
            if report is not None:
                report.append((keep, used["changed"], used["needed"]))
            if n:
                keep = min(keep, max(2, -(-k // 8), used["needed"]))
        if n == rounds:
            break
        more, sums = _changes(now, k, dim)
        count, total = count + more, total + sums
        moved = np.array([[int(t) // c for t in total[j]] if (c := int(count[j])) else centroids[j] for j in range(k)], dtype=np.int64)
        far = _above(np.sqrt(exact_to(moved, centroids, np.arange(k)).astype(float)))
        centroids = moved

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("own").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("own"), pa.array(exact_to(_matrix(b.column("v"), dim), centroids, own))], names=["id", "cluster", "distance"])

    found = shared.write_out(now.select("id", "v", "own").mapInArrow(measure, f"id {kind}, cluster int, distance bigint"), "clusters")
    shared.drop_since(mark, found)
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    figures = found.sparkSession.createDataFrame([(j, inertia.get(j, 0), sum(inertia.values()), names[j]) for j in range(k)], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(figures), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    named = F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string"))
    return cluster(shared.table(spark, sf_dir, "embeddings"), F.sha2(named.cast("binary"), 256))


def _sql() -> str:
    """The rounds one after another, in SQL."""
    distance = "CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    near = "SELECT v.vec_id, v.q, arg_min(c.j, ({d}, c.j)) AS j, min({d}) AS d FROM v JOIN c{n} c ON true GROUP BY v.vec_id, v.q"
    steps = [
        """v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS j, q FROM v ORDER BY j LIMIT 8
)"""
    ]
    for n in range(ROUNDS):
        steps.append(f"a{n} AS MATERIALIZED (\n  {near.format(d=distance, n=n)}\n)")
        steps.append(
            f"""m{n} AS (
  SELECT j, p, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x FROM (SELECT j, unnest(q) AS x, unnest(range(64)) AS p FROM a{n}) GROUP BY j, p
), c{n + 1} AS MATERIALIZED (
  SELECT c.j, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN (SELECT j, list(x ORDER BY p) AS q FROM m{n} GROUP BY j) m USING (j)
)"""
        )
    steps.append(f"z AS MATERIALIZED (\n  {near.format(d=distance, n=ROUNDS)}\n)")
    return (
        "WITH "
        + ", ".join(steps)
        + f"""
SELECT z.vec_id, CAST(z.j AS INTEGER) AS cluster, z.d AS distance, CAST(sum(z.d) OVER (PARTITION BY z.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(z.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM z JOIN c{ROUNDS} c USING (j)
"""
    )


SQL = _sql()
