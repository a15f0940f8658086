"""Mixing sources to target weights by weighted fair queueing.

Every source is shuffled by a seeded hash. A document's virtual finish time is the number of its
source's words up to and including it, divided by the source's target; a source that repeats goes on
counting in its next epoch. All sources therefore reach time 1 at their targets. The mix is the
schedule in order of finish time, cut where the budget is used up.

Running sums never meet in one task: a source is cut into `BUCKETS` hash ranges whose sums are added
up first. The schedule is dealt by ranges of finish time and sorted; one sum per range tells in which of them the budget ends, and
that range alone is summed up row by row. Only the last place that is taken is held on the driver. `mixed` delivers the
mix in the order of the schedule.

Rules. Size is the number of words; null text has none. Sources go by code point, null last, and weigh
as `weights` says, repeating. A target stops at `epochs` times its source's size and the excess goes to
the others by weight. Documents without words are never taken. Null and repeated ids are documents
each. No documents or no words: nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import WORD, checkpoint, shuffle_partitions, table

WEIGHTS = (5, 2, 1)
EPOCHS = 3
BUCKETS = 4096  # three hexadecimal digits of the hash
SEED = "mix"


def targets(rows: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """(source, source_size, sid, target): one row per source, levelled in one pass over sources by how soon they fill."""
    each = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    values = ", ".join(map(str, weights))
    return (
        each.selectExpr("*", "row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid")
        .selectExpr("*", f"element_at(array({values}), cast((sid - 1) % {len(weights)} + 1 AS int)) AS weight")
        .selectExpr(
            "*",
            "sum(source_size) OVER () AS budget",
            f"{epochs} * source_size AS most",
            f"sum({epochs} * source_size) OVER (ORDER BY {epochs} * source_size / weight, sid) - {epochs} * source_size AS full",
            f"sum(weight) OVER (ORDER BY {epochs} * source_size / weight DESC, sid DESC) AS open",
        )
        .selectExpr("*", "(budget - full) / open AS level", "row_number() OVER (ORDER BY most / weight, sid) AS nth")
        .selectExpr("*", "min(CASE WHEN most >= level * weight THEN nth END) OVER () AS free")
        .selectExpr("*", "max(CASE WHEN nth = free THEN level END) OVER () AS water")
        .selectExpr("source", "source_size", "sid", "budget", "cast(least(most, coalesce(water * weight, most)) AS double) AS target")
    )


def scheduled(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: str = SEED,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, row_key, upto, places): how often the mix takes each document, and when."""
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(source_column).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(id_column, source_column, text_column).alias("row_key"),
    )
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), "row_key"))).cast("binary"))
    rows = checkpoint(rows.withColumn("u", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")))
    per_source = checkpoint(targets(rows, weights, epochs))
    rows = rows.join(per_source, rows.source.eqNullSafe(per_source.source)).drop(per_source.source)
    rows = rows.withColumn("bucket", F.expr("cast(shiftright(u, 48) AS int)"))
    sums = (
        rows.groupBy("sid", "bucket")
        .agg(F.sum("size").alias("held"))
        .selectExpr("sid AS s", "bucket AS b", "sum(held) OVER (PARTITION BY sid ORDER BY bucket) - held AS before")
    )
    placed = rows.selectExpr(
        "*", "sum(size) OVER (PARTITION BY sid, bucket ORDER BY u, doc_id, size, row_key ROWS UNBOUNDED PRECEDING) AS within"
    )
    placed = placed.join(sums, (placed.sid == sums.s) & (placed.bucket == sums.b)).withColumn(
        "upto", F.col("before") + F.col("within")
    )
    placed = checkpoint(
        placed.select("doc_id", "source", "size", "source_size", "target", "budget", "sid", "u", "upto", "row_key")
    )
    order = (
        "struct((({e} - 1) * source_size + upto) / nullif(target, 0D) AS f, int(sid) AS sid, {e} AS e, u, "
        "coalesce(doc_id, 0L) AS d, row_key AS k)"
    )
    every = F.expr(f"transform(sequence(1, {epochs}), e -> {order.format(e='e')})")
    queue = placed.where("size > 0 AND target > 0").select("size", F.explode(every).alias("o"))
    budget = per_source.agg(F.max("budget")).head()[0] or 0
    cut = _cut(queue, budget)
    if cut is None:
        taken = F.lit(0)
    else:
        limit = F.struct(*(F.lit(v).cast(t).alias(n) for (n, t), v in zip(_ORDER, cut, strict=True)))
        taken = F.when(F.expr("size > 0 AND target > 0"), F.size(F.filter(every, lambda o: o <= limit))).otherwise(0)
    columns = ("doc_id", "source", "size", "source_size", "target")
    return placed.select(*columns, taken.cast("long").alias("times"), "row_key", "upto", every.alias("places"))


def planned(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, row_key): how often the mix takes each document."""
    return scheduled(docs, **options).drop("upto", "places")


_ORDER = (("f", "double"), ("sid", "int"), ("e", "int"), ("u", "bigint"), ("d", "bigint"), ("k", "bigint"))


def _cut(queue: DataFrame, budget: int) -> tuple | None:
    """The last place of the schedule that the budget covers; None when it covers nothing."""
    ranges = shuffle_partitions(queue.sparkSession)
    dealt = queue.repartitionByRange(ranges, "o").sortWithinPartitions("o")
    # Written, so that a range holds the same rows whenever it is read.
    queue = checkpoint(dealt.select(F.spark_partition_id().alias("range"), "o", "size"))
    before = 0
    for number, held in queue.groupBy("range").agg(F.sum("size").alias("held")).orderBy("range").collect():  # one row a range
        if before + held > budget:
            here = queue.where(F.col("range") == number)
            upto = here.selectExpr("o", "sum(size) OVER (ORDER BY o ROWS UNBOUNDED PRECEDING) AS upto")
            last = upto.where(F.col("upto") <= budget - before).agg(F.max("o")).head()[0]
            if last is None:
                last = queue.where(F.col("range") < number).agg(F.max("o")).head()[0]
            break
        before += held
    else:  # the budget covers all
        last = queue.agg(F.max("o")).head()[0]
    return None if last is None else tuple(last)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in the order of the schedule, each as often as it is taken, with the columns of the input.

    Rows that are equal in id, source and text have places that follow each other; which of them has which
    follows from their other columns.
    """
    options = {"id_column": "doc_id", "source_column": "source", "text_column": "text", **options}
    key = F.xxhash64(*(options[c] for c in ("id_column", "source_column", "text_column")))
    plan = scheduled(docs, **options).selectExpr(
        "row_key AS plan_key", "row_number() OVER (PARTITION BY row_key ORDER BY upto) AS plan_nth", "slice(places, 1, int(times)) AS places"
    )
    held = docs.select(F.struct("*").alias("doc"), key.alias("row_key"), F.xxhash64(F.to_json(F.struct("*"))).alias("rest"))
    held = held.selectExpr("doc", "row_key", "row_number() OVER (PARTITION BY row_key ORDER BY rest) AS nth")
    met = held.join(plan.where("size(places) > 0"), (F.col("row_key") == F.col("plan_key")) & (F.col("nth") == F.col("plan_nth")))
    taken = met.select("doc", F.explode("places").alias("place"))
    return taken.repartitionByRange("place").sortWithinPartitions("place").select("doc.*")


def op6_mixing(spark, folder: str) -> DataFrame:
    """All documents, default weights."""
    plan = planned(table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid
  FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(sid - 1) % 3 + 1] AS weight, sum(source_size) OVER () AS budget, 3 * source_size AS most FROM s
), l AS (
  SELECT *, (budget - (sum(most) OVER (ORDER BY most / weight, sid) - most))::DOUBLE
    / (sum(weight) OVER (ORDER BY most / weight DESC, sid DESC)) AS level,
    row_number() OVER (ORDER BY most / weight, sid) AS nth FROM w
), f AS (
  SELECT *, min(CASE WHEN most >= level * weight THEN nth END) OVER () AS free FROM l
), t AS (
  SELECT source, source_size, sid, budget::BIGINT AS budget,
    least(most, (max(CASE WHEN nth = free THEN level END) OVER ()) * weight)::DOUBLE AS target FROM f
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.budget, t.sid, d.u,
    sum(d.size) OVER (PARTITION BY t.sid ORDER BY d.u, d.doc_id)::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, ((e - 1) * source_size + upto)::DOUBLE / target AS f
  FROM c, (SELECT unnest([1, 2, 3]) AS e) WHERE size > 0 AND target > 0
), r AS (
  SELECT *, sum(size) OVER (ORDER BY f, sid, e, u, doc_id) AS used FROM q
), k AS (
  SELECT doc_id, sid, u, upto, sum(size)::BIGINT AS taken FROM r WHERE used <= budget GROUP BY ALL
)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM c LEFT JOIN k ON c.doc_id = k.doc_id AND c.sid = k.sid AND c.u = k.u AND c.upto = k.upto AND c.size > 0
"""
