"""Exact top-k search by integer inner product.

Vectors are packed into tiles: matrices of a few thousand rows. Each candidate tile meets each tile of queries in one
matrix product; a partial selection keeps the tile's k best for each query, a task merges its tiles, and Spark merges
the tasks' lists, first within each partition and then by query. Tiles are dealt over a grid, whose rows and columns
follow from the numbers of tiles: each tile of queries goes to every column of its row, each tile of candidates to every
row of its column, so that neither side is gathered anywhere. A task holds a tile of each at a time and the lists of one
tile of queries, which it gives out when the next one comes.

Products are made in float64 while each one is below 2**53, so that sums are exact, else in int64. A component whose
256-fold is beyond 64 bits counts as the largest number of 64 bits, and so does a score, with its sign.

Edge cases: vectors that are null, or hold a null or a non-finite component, take no part; neither do rows with a null
id, nor pairs of different lengths; ties go to the smaller id; a repeated row of a candidate is a candidate each time, a
repeated query id is answered once, by its first row in order of components; a query with fewer than k candidates gets all; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

TILE, BLOCK = 8192, 2048
PAIRS, CELLS = 16, 65_536  # pairs of tiles that a cell of the grid is to have, and its most cells
SCALE = 256
_TILE = "dim int, ids binary, rows binary"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 * x) of each component; only whole, finite vectors."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(good).select("vec_id", x.alias("v"))


def tiles(vectors: DataFrame, rows: int) -> DataFrame:
    """vec_id, v -> matrices of at most ``rows`` rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in held[dim]])
            v = np.concatenate([x[1] for x in held.pop(dim)])
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": [ids.tobytes()], "rows": [v.tobytes()]})

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            dims = lists.value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                flat = lists.take(pa.array(own)).flatten().to_numpy().reshape(len(own), dim)
                for a in range(0, len(own), rows):
                    part = (ids[own[a : a + rows]], flat[a : a + rows])
                    if sum(len(x[0]) for x in held.get(dim, [])) + len(part[0]) > rows:
                        yield out(dim)
                    held.setdefault(dim, []).append(part)
        for dim in list(held):
            yield out(dim)

    return vectors.select("vec_id", "v").mapInArrow(run, _TILE)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    high = [np.maximum(x.max(1, initial=0).astype(float), -x.min(1, initial=0).astype(float)) for x in (q, c)]
    most = high[0].max(initial=0) * high[1].max(initial=0) * q.shape[1]
    if most < 2**53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    out = q @ c.T
    if most >= 2**63:  # those pairs that may leave 64 bits, by whole numbers of any size
        wide = high[0][:, None] * high[1][None, :] * q.shape[1] >= 2**63
        i, j = np.flatnonzero(wide.any(1)), np.flatnonzero(wide.any(0))
        exact = q[i].astype(object) @ c[j].astype(object).T
        out[np.ix_(i, j)] = np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ids ascend."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        at = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs: vec_id, v (arrays of integers); a row isn't its own candidate."""

    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        tile_of = None

        def told() -> pa.RecordBatch:
            ids = np.repeat(np.array(list(top), np.int64), [len(v) for v, _ in top.values()])
            columns = [ids, *(np.concatenate(c) for c in zip(*top.values()))]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

        for batch in batches:
            for dim, qi, qv, ci, cv in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if qi != tile_of:  # the join gives all candidates of a tile of queries one after the other
                    if top:
                        yield told()
                    top, tile_of = {}, qi
                qi, ci = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                q, c = np.frombuffer(qv, np.int64).reshape(len(qi), dim), np.frombuffer(cv, np.int64).reshape(len(ci), dim)
                order = np.argsort(ci, kind="stable")
                ci, c = ci[order], c[order]
                for a in range(0, len(qi), 256):
                    scores = products(q[a : a + 256], c)
                    for i, s in zip(qi[a : a + 256].tolist(), scores):
                        own = slice(np.searchsorted(ci, i), np.searchsorted(ci, i, "right"))
                        ids = ci
                        if own.start < own.stop:
                            ids, s = np.delete(ci, own), np.delete(s, own)
                        at = best(s, ids, k)
                        found = (ids[at], s[at])
                        if i in top:
                            found = tuple(map(np.concatenate, zip(top[i], found)))
                            at = np.lexsort((found[0], -found[1]))[:k]
                            found = (found[0][at], found[1][at])
                        top[i] = found
        if top:
            yield told()

    once = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks, others = (-(-max(1, df.count()) // size) for df, size in ((once, block), (candidates, tile)))
    cells = min(CELLS, -(-blocks * others // PAIRS))
    rows = min(blocks, max(1, round(math.sqrt(cells * blocks / others))))
    columns = min(others, -(-cells // rows))
    dealt = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = tiles(once.repartition(blocks, F.xxhash64("vec_id")), block).withColumn("row", dealt(rows)).withColumn("column", every(columns))
    c = tiles(candidates, tile).withColumn("column", dealt(columns)).withColumn("row", every(rows))
    pairs = q.withColumnsRenamed({"ids": "q_ids", "rows": "q_rows"}).join(c, ["row", "column", "dim"]).select("dim", "q_ids", "q_rows", "ids", "rows")
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark, sf_dir: str) -> DataFrame:
    v = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return search(v.filter(F.col("vec_id") % 50 == 0), v)


OP3_SQL = """
WITH g AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, len(embedding) AS dim, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM g),
q AS (SELECT vec_id, dim, min(v) AS v FROM x WHERE vec_id % 50 = 0 GROUP BY vec_id, dim),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM q JOIN x c ON c.vec_id <> q.vec_id AND c.dim = q.dim),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
