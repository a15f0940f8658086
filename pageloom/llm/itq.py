"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact reranking.

1. Equal vectors collapse to one row with a count.
2. A rotation that balances binary codes is learned from a bounded sample; several rotations give
   codes as long as the tables need.
3. A code is cut into `tables` substrings of about log2(n) bits. Two codes that differ in fewer bits
   than there are tables agree on one substring at least, and so share a bucket of that table.
4. Buckets of two or more are reranked with the original vectors in double precision. A large bucket
   is cut into blocks and its blocks meet pairwise, in cells of bounded size; no pair leaves a task.
   A pair counts in the first table where it meets, so a link counts once. What leaves is one row
   per vector: its number of links and one link of a spanning forest.
5. Links give components.

Every vector is indexed. The sample only shapes the rotation; the number of tables follows from the
wanted chance to meet (`recall`) at the threshold itself, closer pairs meet more surely. Centring widens
the angle of a pair, at most to a cosine of `1 - (1 - threshold) / (1 - |mean|)^2`. Where that is close to
the threshold, the learned tables are as many as it needs. Where vectors share a large part and it is not,
as many tables of random rotations without a mean join them as the threshold itself needs; there the
angle is that of the vectors, whatever their mean.

Rules. Vectors that are null, zero, hold null or non-finite components or have no id link with
nothing: `n_links` 0, their own component, kept. Vectors of different length never link. Repeated
rows are vectors each; different vectors under one smallest id are one node, with the links of both. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import checkpoint, components, shuffle_partitions, table
from pageloom.llm.topk import finite

BLOCK = 512
SAMPLE_VALUES = 1_000_000  # components of the vectors that the rotation is learned from, at most
SAMPLE_ROWS = 10_000
MORE_TABLES = 1.25  # learned tables alone where centring asks for no more than so many times the tables


def learn_rotation(sample: np.ndarray, seed: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection whose signs are balanced codes (Gong and Lazebnik's alternation)."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    mean = sample.mean(0) if len(sample) else np.zeros(dim)
    if len(sample) < 2:
        return mean, rotation
    centred = sample - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    projected = centred @ axes
    for _ in range(rounds):
        codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ projected)
        rotation = (left @ right).T
    return mean, axes @ rotation


def _unit(batch_vectors: pa.Array, dim: int) -> np.ndarray:
    flat = batch_vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    top = np.abs(flat).max(1, keepdims=True)
    flat = flat / top  # keeps squares in range
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def tables_for(cosine: float, bits: int, recall: float) -> float:
    """Tables of so many random bits in which vectors at this cosine meet once with this chance."""
    agree = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    meet = agree**bits
    if meet >= recall:
        return 1
    return math.ceil(math.log(1 - recall) / math.log1p(-meet)) if meet > 1e-12 else math.inf


def families(sample: np.ndarray, n: int, bits: int, threshold: float, recall: float, seed: int) -> list[tuple[list, int, int]]:
    """(rotations with their means, bits, tables) of the vectors of one length, of which these are a sample."""
    dim = sample.shape[1]
    least = int(tables_for(threshold, bits, recall))
    off = float(np.linalg.norm(sample.mean(0))) if len(sample) > 1 else 0.0
    centred = tables_for(1 - (1 - threshold) / max(1e-9, 1 - off) ** 2, bits, recall)
    enough = centred <= MORE_TABLES * least
    tables = int(centred) if enough else least
    out = [([learn_rotation(sample, seed + s) for s in range(-(-bits * tables // dim))], bits, tables)]
    if not enough:
        # More bits where unlike vectors would crowd the buckets: a vector travels once for every block it meets.
        some = sample[:1000]
        agree = 1 - np.arccos(np.clip(some @ some.T, -1, 1)[np.triu_indices(len(some), 1)]) / math.pi
        cost = {b: tables_for(threshold, b, recall) * (1 + n * float((agree**b).mean()) / BLOCK) for b in range(bits, 31)}
        wide = min(cost, key=cost.get)
        tables = int(tables_for(threshold, wide, recall))
        rng = np.random.default_rng([seed, dim])
        turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-wide * tables // dim))]
        out.append(([(np.zeros(dim), turn) for turn in turns], wide, tables))
    return out


def _coded(models: dict[int, list], bits: int, threshold: float, recall: float):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                mine = batch.filter(pa.array(lengths == dim))
                unit = _unit(mine.column(1), dim)
                got = models.get(dim) or families(np.zeros((0, dim)), 0, bits, threshold, recall, 0)
                codes = []
                for rotations, width, tables in got:
                    signs = np.concatenate([(unit - mean) @ turn >= 0 for mean, turn in rotations], axis=1)
                    codes.append(signs[:, : width * tables].reshape(len(unit), tables, width) @ (1 << np.arange(width, dtype=np.int64)))
                codes = np.concatenate(codes, axis=1)
                tables = codes.shape[1]
                keys = codes + (np.arange(tables, dtype=np.int64) << 32)
                offsets = pa.array(np.arange(len(unit) + 1) * tables, pa.int32())
                wide = pa.array([u.tobytes() for u in unit], pa.binary())
                yield pa.record_batch(
                    [mine.column(0), mine.column(2), wide, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                    names=["rep", "copies", "unit", "keys"],
                )

    return encode


def _linked(threshold: float):
    def forest(adjacent: np.ndarray) -> np.ndarray:
        """The smallest place that each reaches."""
        labels = np.arange(len(adjacent))
        while True:
            new = np.minimum(labels, np.where(adjacent, labels[None, :], len(labels)).min(1))
            new = new[new]
            if (new == labels).all():
                return labels
            labels = new

    def cell(rows: list[tuple]) -> list[tuple[int, int, int]]:
        _, low, high, block, rep, copies, unit, keys = zip(*rows, strict=True)
        reps, counts = np.array(rep, np.int64), np.array(copies, np.int64)
        if len({len(u) for u in unit}) > 1:  # lengths that share a bucket never link
            out = []
            for size in {len(u) for u in unit}:
                out += cell([r for r in rows if len(r[6]) == size])
            return out
        units = np.frombuffer(b"".join(unit)).reshape(len(rows), -1)
        codes = np.array(keys, np.int64)
        near = units @ units.T >= threshold
        np.fill_diagonal(near, False)
        if low[0] != high[0]:
            blocks = np.array(block)
            near &= blocks[:, None] != blocks[None, :]
        a, b = np.nonzero(np.triu(near))
        if not len(a):
            return []
        # Only links that no earlier table has seen.
        number = int(rows[0][0]) >> 32
        new = ~(codes[a, :number] == codes[b, :number]).any(1)
        a, b = a[new], b[new]
        near[:] = False
        near[a, b] = near[b, a] = True
        order = np.argsort(reps)
        roots = np.empty(len(reps), np.int64)
        roots[order] = reps[order][forest(near[np.ix_(order, order)])]
        links = near @ counts
        return [(int(reps[i]), int(links[i]), int(roots[i])) for i in np.flatnonzero(links)]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["rep", "links", "root"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    out += cell(held)
                    held = []
                    if len(out) >= 10_000:
                        yield made()
                        out = []
                held.append(row)
        if held:
            out += cell(held)
        if out:
            yield made()

    return link


def near_duplicates(
    vectors: DataFrame,
    *,
    threshold: float = 0.95,
    recall: float = 0.995,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    seed: int = 0,
) -> DataFrame:
    """(id, n_links, component_id, kept), one row per input row."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")
    ).withColumn("fit", finite("v") & F.expr("coalesce(exists(v, x -> x <> 0), false) AND id IS NOT NULL"))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(seed), "v")})
    distinct = checkpoint(
        rows.where("fit").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    )
    distinct = distinct.withColumn("node", F.col("rep"))
    n, longest = distinct.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).head()
    bits = min(30, max(8, math.ceil(math.log2(max(2, n))) + 3))
    take = max(2, min(SAMPLE_ROWS, SAMPLE_VALUES // max(1, longest)))
    sample = distinct.orderBy("h2").limit(take).select("v").toArrow().column(0).combine_chunks()
    lengths = sample.value_lengths().to_numpy() if len(sample) else np.zeros(0)
    models = {
        dim: families(_unit(sample.filter(pa.array(lengths == dim)), dim), n, bits, threshold, recall, seed)
        for dim in np.unique(lengths).astype(int).tolist()
    }
    coded = checkpoint(
        distinct.select("node", "v", "copies").mapInArrow(
            _coded(models, bits, threshold, recall), "rep long, copies long, unit binary, keys array<long>"
        )
    )
    members = coded.select("rep", F.explode("keys").alias("key"))
    crowded = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = members.join(crowded, "key").withColumn("blocks", F.expr(f"ceil(n / {BLOCK})"))
    members = members.withColumn("block", F.expr("pmod(xxhash64(rep), blocks)")).withColumn(
        "other", F.explode(F.expr("sequence(0L, blocks - 1)"))
    )
    cells = members.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep")
    found = (
        cells.join(coded, "rep")
        .select("key", "low", "high", "block", "rep", "copies", "unit", "keys")
        .repartition(shuffle_partitions(spark), "key", "low", "high")
        .sortWithinPartitions("key", "low", "high")
        .mapInArrow(_linked(threshold), "rep long, links long, root long")
    )
    found = checkpoint(found)
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = (
        distinct.select("h1", "h2", "node", "copies")
        .join(per, F.col("node") == per.rep, "left")
        .drop("rep")
        .join(joined.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("c"))
    )
    linked = rows.where("fit").select("id", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "n", "c")
    alone = rows.where("NOT fit").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c"))
    return linked.union(alone).select(
        "id",
        F.col("n").alias("n_links"),
        F.col("c").alias("component_id"),
        F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"),
    )


def op7_embedding_dedup(spark, folder: str) -> DataFrame:
    """All embeddings, links at cosine 0.95."""
    return near_duplicates(table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (
  SELECT vec_id, e FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
c(node, component) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, c.component FROM c JOIN l ON c.node = l.a),
least_of AS (SELECT node, min(component) AS component FROM c GROUP BY node),
n AS (SELECT a, count(DISTINCT b) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component AS component_id, component = v.vec_id AS kept
FROM v JOIN least_of ON v.vec_id = node LEFT JOIN n ON v.vec_id = n.a
"""
