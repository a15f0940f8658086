"""Exact top-k search by inner product.

Vectors are packed, where they are read, into tiles: one row holds up to `tile_rows` vectors as a
matrix. Query tiles and candidate tiles meet on a grid of cells (an equi-join), so that a cell holds
a bounded number of query tiles whatever the number of queries. One matrix product scores a pair of
tiles; partial selection keeps the k best of each query; the lists of a task are merged as it runs,
and those of different tasks by a tree of grouped merges with a fixed fan-in.

Rules. Components are integers (see `quantised`); scores are exact. Ties go to the smaller id.
Vectors that are null, or hold null or non-finite components, or have no id, take no part. Vectors
of different length have no score. Repeated candidate rows are candidates each; an id asked for
more than once is asked once, with its smallest vector. No candidates: no rows. Other columns of
the inputs are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import shuffle_partitions, table

FAN_IN = 16
CELL_TILES = 128  # query tiles in a grid cell, about: a candidate tile travels once for so many of them
HELD = 128  # query tiles whose lists a task holds at a time: 20 MB at 512 queries and k = 20
TILE_BYTES = 1 << 20  # of a tile's matrix; long vectors make tiles of fewer rows


def finite(vector: str) -> Column:
    """Neither null nor holding null or non-finite components."""
    return F.expr(
        f"coalesce({vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) "
        f"AND abs(x) < double('Infinity')), false)"
    )


def quantised(vector: str, scale: int = 64) -> Column:
    return F.expr(f"transform({vector}, x -> cast(floor({scale} * cast(x AS double)) AS double))")


def _tiles(rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        counts: dict[int, int] = {}

        def tile(dim: int) -> pa.RecordBatch:
            ids, matrix = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            counts.pop(dim)
            order = np.argsort(ids, kind="stable")
            return pa.record_batch(
                {"dim": [dim], "ids": [ids[order].tobytes()], "matrix": [np.ascontiguousarray(matrix[order]).tobytes()]},
                schema=pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary())]),
            )

        for batch in batches:
            ids = batch.column(0).to_numpy()
            vectors = batch.column(1)
            lengths = vectors.value_lengths().to_numpy()
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == dim)
                most = max(1, min(rows, TILE_BYTES // (8 * max(1, dim))))
                for at in range(0, len(mine), most):
                    part = mine[at : at + most]
                    if counts.get(dim, 0) + len(part) > most:
                        yield tile(dim)
                    matrix = flat[starts[part][:, None] + np.arange(dim)]
                    held.setdefault(dim, []).append((ids[part], matrix))
                    counts[dim] = counts.get(dim, 0) + len(part)
        for dim in list(held):
            yield tile(dim)

    return pack


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, by score and then smaller id; lists come in and go out sorted or not."""
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


MISSING = np.iinfo(np.int64).min + 1  # no candidate here


def select(queries: np.ndarray, query_ids: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int):
    """Scores and ids of the k best of one tile, whose ids ascend, for each query."""
    n = len(ids)
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * max(1, matrix.shape[1])
    exact = bound * max(n, 1) < 2.0**52
    if bound < 2.0**52:
        scores = queries @ matrix.T
    else:  # beyond what doubles hold exactly
        scores = queries.astype(np.int64) @ matrix.T.astype(np.int64)
    low, high = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    own = np.flatnonzero(high > low)
    if not exact:
        scores = scores.astype(np.int64)
        for q in own:
            scores[q, low[q] : high[q]] = MISSING
        return _best(scores, np.broadcast_to(ids, scores.shape), k)
    # One number orders score and place; the place, ascending by id, makes all numbers differ.
    keys = scores * n + np.arange(n - 1, -1, -1, dtype=np.float64)
    for q in own:
        keys[q, low[q] : high[q]] = -np.inf
    if k < n:
        keys = -np.partition(-keys, k - 1, axis=1)[:, :k]
    missing = np.isneginf(keys)
    keys[missing] = 0
    found = np.floor(keys / n)
    places = (n - 1 - (keys - found * n)).astype(np.int64)
    return np.where(missing, MISSING, found.astype(np.int64)), ids[places]


def _scored(k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[bytes, list[np.ndarray]] = {}

        def lists() -> Iterator[pa.RecordBatch]:
            for name, (scores, ids) in held.items():
                query_ids = np.frombuffer(name[4:], np.int64)
                real = scores != MISSING
                offsets = pa.array(np.concatenate([[0], np.cumsum(real.sum(1))]), pa.int32())
                best = pa.StructArray.from_arrays([pa.array(-scores[real]), pa.array(ids[real])], names=["minus", "id"])
                yield pa.record_batch(
                    [
                        pa.array(query_ids),
                        pa.array(np.full(len(query_ids), part, np.int32)),
                        pa.ListArray.from_arrays(offsets, best),
                    ],
                    names=["query_id", "part", "best"],
                )
            held.clear()

        for batch in batches:
            for dim, q_ids, q_matrix, c_ids, c_matrix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                query_ids = np.frombuffer(q_ids, np.int64)
                queries = np.frombuffer(q_matrix).reshape(len(query_ids), dim)
                ids = np.frombuffer(c_ids, np.int64)
                got = select(queries, query_ids, np.frombuffer(c_matrix).reshape(len(ids), dim), ids, k)
                name = dim.to_bytes(4, "little") + q_ids
                if name in held:
                    got = _best(*(np.concatenate(x, axis=1) for x in zip(held[name], got, strict=True)), k)
                elif len(held) >= HELD:
                    yield from lists()
                held[name] = list(got)
        yield from lists()

    return score


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    *,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    tile_rows: int = 2048,
    block_rows: int = 512,
) -> DataFrame:
    """(query_id, rank, id, score): for each query its k best candidates other than its own id."""
    spark = candidates.sparkSession
    pick = [F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")]
    valid = "id IS NOT NULL AND v IS NOT NULL"
    asked = queries.select(*pick).where(valid).where(finite("v")).groupBy("id").agg(F.min("v").alias("v"))
    given = candidates.select(*pick).where(valid).where(finite("v"))
    tile = "dim int, ids binary, matrix binary"
    blocks = asked.mapInArrow(_tiles(block_rows), tile).withColumnsRenamed({"ids": "q_ids", "matrix": "q_matrix"})
    tiles = given.mapInArrow(_tiles(tile_rows), tile)
    # The grid: candidate tiles by row, query tiles by column; a cell holds few query tiles.
    columns = max(1, round(queries.select(id_column).count() / (block_rows * CELL_TILES)))
    rows = shuffle_partitions(spark) * 2
    tiles = tiles.withColumn("r", F.expr(f"pmod(xxhash64(ids), {rows})")).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))
    )
    blocks = blocks.withColumn("c", F.expr(f"cast(pmod(xxhash64(q_ids), {columns}) AS int)")).withColumn(
        "r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long")))
    )
    # Merged, never broadcast: Spark sizes both sides as they were before their copies were made for each row or column.
    lists = (
        tiles.join(blocks.hint("merge"), ["dim", "r", "c"])
        .select("dim", "q_ids", "q_matrix", "ids", "matrix")
        .mapInArrow(_scored(k), "query_id long, part int, best array<struct<minus:long,id:long>>")
    )
    parts = rows * columns
    lists = lists.withColumn("part", F.expr(f"cast(pmod(part, {parts}) AS int)"))
    while parts > 1:
        parts = -(-parts // FAN_IN)
        lists = lists.groupBy("query_id", F.expr(f"cast(pmod(part, {parts}) AS int)").alias("part")).agg(
            F.expr(f"slice(array_sort(flatten(collect_list(best))), 1, {k})").alias("best")
        )
    return lists.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.id").alias("id"),
        (-F.col("hit.minus")).alias("score"),
    )


def op1_top_k(spark, folder: str) -> DataFrame:
    """Every twentieth embedding against all, on components floor(64 x)."""
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", F.when(finite("embedding"), quantised("embedding")).alias("embedding")
    )
    found = top_k(vectors.where("vec_id % 20 = 0"), vectors)
    return found.withColumnRenamed("id", "vec_id")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s
)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM r WHERE place <= 20
"""
