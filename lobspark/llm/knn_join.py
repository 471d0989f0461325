"""Exact top-k search by a Voronoi join.

Vectors belong to the cell of their nearest pivot, queries too: those of a cell, and of near cells where these are few, are
a group. A cell's summary is its size, its radius, and the radius of its queries. For queries within s of pivot p and vectors
within r of pivot o, every score lies in <p,o> -+ (s |o| + |p| r + s r). So the summaries alone give, for the queries of
a cell, a score that at least k candidates of each of them reach, from the lower ends, and the cells that can hold winners,
those whose upper end reaches it. What a group's cells need, the group needs, and nothing else is sent to it.

Cells are put into bundles of bounded size, near cells together and large ones divided. A group meets each bundle that it needs
once: its queries are sent there once, whatever number of cells the bundle has, and the bundle's rows come along. Both are
solved locally by matrix products, and the winners of all bundles are merged.

Scale: pivots grow with the square root of the rows, up to PIVOTS, and so do the summaries. A cell that holds a third of all
vectors is many bundles, one that holds a third of all queries many blocks; no task meets more than BUNDLE_ROWS vectors and
QUERY_ROWS queries at once, and scores AT_ONCE of these against them. How much is pruned depends on how clustered vectors are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

PIVOTS = 4096
BUNDLE_ROWS, QUERY_ROWS, AT_ONCE = 16_000, 1000, 250
SCALE = 1024


def _stack(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.vstack(vectors.to_list()) if dim else np.zeros((len(vectors), 0), dtype=np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating point only where all sums stay below 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2.0**53 else a @ b.T


def quantised(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null for vectors that are null or hold null or non-finite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vec.isNotNull() & ~bad, F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def neighbours(pivots: np.ndarray) -> list[int]:
    """Pivots in an order that keeps near ones together: halves along the direction of most spread, again and again."""
    out, todo = [], [np.arange(len(pivots))]
    while todo:
        part = todo.pop()
        if len(part) <= 2:
            out += part.tolist()
            continue
        x = pivots[part].astype(float)
        x -= x.mean(axis=0)
        along = x @ np.linalg.eigh(x.T @ x)[1][:, -1] if x.shape[1] else np.zeros(len(part))
        order = part[np.argsort(along, kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]
    return out


def groups(asks: np.ndarray, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(first group, parts) of each cell's queries: cells with few join their neighbours in order, large ones are parted."""
    first, parts = np.zeros(len(asks), dtype=np.int64), np.ones(len(asks), dtype=np.int64)
    now, held = 0, 0
    for cell in order:
        n = int(asks[cell])
        if held and held + n > QUERY_ROWS:
            now, held = now + 1, 0
        first[cell] = now
        parts[cell] = max(1, -(-n // QUERY_ROWS))
        held += n
        if parts[cell] > 1:
            now, held = now + int(parts[cell]), 0
    return first, parts


def bundles(sizes: np.ndarray, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(first bundle, parts) of each cell's vectors: small cells join their neighbours in order, large ones are parted."""
    first, parts = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64)
    now, held = 0, 0
    for cell in order:
        n = int(sizes[cell])
        if held and held + n > BUNDLE_ROWS:
            now, held = now + 1, 0
        first[cell], parts[cell] = now, max(1, -(-n // BUNDLE_ROWS))
        held += n
        if parts[cell] > 1:
            now, held = now + int(parts[cell]), 0
    return first, parts


def needed(pivots: np.ndarray, size: np.ndarray, radius: np.ndarray, cells: np.ndarray, spread: np.ndarray, k: int) -> np.ndarray:
    """For each of the cells, whose queries lie within spread of its pivot, which cells can hold one of their k best."""
    p = pivots[cells]
    mid, slack = p @ pivots.T, spread[:, None] * np.linalg.norm(pivots, axis=1) + np.linalg.norm(p, axis=1)[:, None] * radius + spread[:, None] * radius
    slack = np.where(size > 0, slack * (1 + 1e-9) + 1e-3 + np.abs(mid) * 1e-12, 0.0)
    low = np.where(size > 0, mid - slack, -np.inf)
    order = np.argsort(-low, axis=1, kind="stable")
    enough = np.cumsum(size[order], axis=1) >= k + 1  # one may be the query itself
    bound = np.take_along_axis(np.take_along_axis(low, order, 1), enough.argmax(axis=1)[:, None], 1)
    bound[~enough.any(axis=1)] = -np.inf
    return (mid + slack >= bound) & (size > 0)


def knn_join(vectors: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The k highest integer inner products of each row for which query is true, against every other row.

    query_id, rank from 1, the candidate's id (named as id_col), score. Ties go to the smaller id, null ids last, then to
    the earlier of repeated rows; a repeated row is a candidate for its copies. Vectors of other lengths are never
    compared; fewer candidates than k give fewer rows, an empty table none. Integers must keep scores below 2**63.
    """
    slim = vectors.select(F.col(id_col).alias("id"), F.coalesce(query, F.lit(False)).alias("asks"), quantised(F.col(vec_col), scale).alias("v")).where("v IS NOT NULL")
    rows = shared.write_out(slim.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")
    n = rows.count()
    want = int(min(PIVOTS, max(1, n**0.5 / 4)))
    sample = [np.array(r.v, dtype=np.int64) for r in rows.orderBy(F.xxhash64("row"), "row").limit(want).select("v").collect()]
    pivots: dict[int, np.ndarray] = {}
    for dim in {len(v) for v in sample}:
        pivots[dim] = np.unique(np.vstack([v for v in sample if len(v) == dim]), axis=0) if dim else np.zeros((1, 0), dtype=np.int64)
    origin = lambda dim: pivots.get(dim, np.zeros((1, dim), dtype=np.int64))  # noqa: E731  vectors of a length that the sample lacks
    kind = slim.schema["id"].dataType.simpleString()

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, part in f.groupby("dim"):
                x, p = _stack(part["v"], dim).astype(float), origin(dim).astype(float)
                far = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)
                cell = far.argmin(1)
                yield pd.DataFrame({"row": part["row"], "dim": part["dim"], "asks": part["asks"], "cell": cell, "dist": np.linalg.norm(x - p[cell], axis=1)})

    places = shared.write_out(rows.select("row", "dim", "asks", "v").mapInPandas(assign, "row bigint, dim int, asks boolean, cell int, dist double"), "places")
    asks = F.count(F.when(F.col("asks"), F.lit(1)))
    summary = places.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("dist").alias("r"), asks.alias("asks"), F.max(F.when(F.col("asks"), F.col("dist"))).alias("spread")).toPandas()  # a row for each pivot
    spark, cells, jobs, known = vectors.sparkSession, [], [], {}
    for dim, s in summary.groupby("dim"):
        many = len(origin(int(dim)))
        size, radius, asked_of, spread = (np.zeros(many, dtype=t) for t in (np.int64, float, np.int64, float))
        for column, name in ((size, "n"), (radius, "r"), (asked_of, "asks"), (spread, "spread")):
            column[s["cell"]] = s[name].fillna(0)
        order = neighbours(origin(int(dim)))
        bundle, parts = bundles(size, order)
        block, shares = groups(asked_of, order)
        known[int(dim)] = (size, radius, spread, bundle, parts)
        cells += [(int(dim), c, int(bundle[c]), int(parts[c]), int(block[c]), int(shares[c])) for c in range(many)]
        for g in np.unique(block[asked_of > 0]).tolist():
            own = np.flatnonzero((block == g) & (asked_of > 0))
            jobs.append((int(dim), g, int(shares[own].max()), own.tolist()))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The bundles that each block of queries needs, from summaries."""
        for f in frames:
            for job in f.itertuples(index=False):
                size, radius, spread, bundle, parts = known[job.dim]
                own = np.asarray(job.cells)
                cell = np.flatnonzero(needed(origin(job.dim).astype(float), size, radius, own, spread[own], k).any(axis=0))
                at = np.unique(np.concatenate([bundle[c] + np.arange(parts[c]) for c in cell]) if len(cell) else np.zeros(0, dtype=np.int64))
                pairs = pd.DataFrame({"bundle": np.tile(at, job.shares), "block": np.repeat(job.block + np.arange(job.shares), len(at))})
                yield pairs.assign(dim=job.dim)[["dim", "block", "bundle"]]

    table = spark.createDataFrame(cells or [(0, 0, 0, 1, 0, 1)], "dim int, cell int, first int, parts int, block int, shares int")  # a row for each pivot
    groups_ = spark.createDataFrame(jobs or [(-1, 0, 0, [])], "dim int, block int, shares int, cells array<int>").where("shares > 0")
    meetings = shared.write_out(groups_.repartition(shared.many_parts(spark)).mapInPandas(meet, "dim int, block int, bundle int"), "meetings")
    placed = rows.join(places.select("row", "cell"), "row").join(F.broadcast(table), ["dim", "cell"])
    draw = lambda seed, many: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(many)).cast("int")
    asked = placed.where("asks").withColumn("block", F.col("block") + draw(2, "shares")).select("id", "row", "v", "dim", "block").join(meetings, ["dim", "block"])
    data = placed.withColumn("bundle", F.col("first") + draw(1, "parts")).select("id", "row", "v", "dim", "bundle").join(meetings, ["dim", "bundle"])

    def solve(key: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({"query": [], "query_id": [], "row": [], "id": [], "score": []})
        x = x.sort_values(["id", "row"], na_position="last")
        dim, there, out = int(key[0]), x["row"].to_numpy(), []
        stacked = _stack(x["v"], dim)
        for at in range(0, len(q), AT_ONCE):
            part = q.iloc[at : at + AT_ONCE]
            score = _products(_stack(part["v"], dim), stacked)
            own = part["row"].to_numpy()[:, None] == there
            order = np.argsort(np.where(own, np.iinfo(np.int64).max, -score), axis=1, kind="stable")[:, : k + 1]
            who = np.repeat(np.arange(len(part)), order.shape[1])
            what = order.ravel()
            keep = ~own[who, what]
            who, what = who[keep], what[keep]
            out.append(pd.DataFrame({"query": part["row"].to_numpy()[who], "query_id": part["id"].to_numpy()[who], "row": there[what], "id": x["id"].to_numpy()[what], "score": score[who, what]}))
        return pd.concat(out)

    keys = ["dim", "bundle", "block"]
    data = data.select([F.col(c).alias(c) for c in data.columns])  # columns of its own beside those of asked
    local = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(solve, f"query bigint, query_id {kind}, row bigint, id {kind}, score bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    return knn_join(shared.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
