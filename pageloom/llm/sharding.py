"""Sharding by extendible hashing, with DataFrame functions only.

Rows hash to a string of bits. The directory starts as one bucket; only a bucket above the byte limit
splits, on its next bit, until every shard fits. Rows are summed `BITS` bits deeper at a time, so one
pass settles up to 4096 buckets per open bucket, and the next pass reads only rows of buckets that are
still too large. The directory has one row per settled prefix and meets the rows by an equi-join.

Rows of one key share all bits of the key; if they exceed the limit together, bits of the text's hash
follow, and then bits of a row number, so that every bucket can split in the end. A row above the limit
by itself is a shard of its own, named after its row number.

Rules. A row's bytes are those of its text in UTF-8, null or empty text has none; a null key hashes like
the empty key. An empty table has no shards. Columns of the input come along; `shard`, `depth` and
`shard_bytes` replace columns of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import checkpoint, table

DIGITS = 3  # hexadecimal digits settled per pass
BITS = 4 * DIGITS
KEY_DIGITS = 15  # of each hash that is used
LIMIT_BYTES = 8 << 20


def _hex(value: Column) -> Column:
    return F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, KEY_DIGITS)


def _bits(prefix: str, digits: int) -> str:
    """SQL for the bits of hexadecimal digits."""
    chunks = [f"lpad(bin(cast(conv(substr({prefix}, {i + 1}, {DIGITS}), 16, 10) AS bigint)), {BITS}, '0')" for i in range(0, digits, DIGITS)]
    return f"concat({', '.join(chunks)})"


def directory(rows: DataFrame, limit_bytes: int, digits: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Settled prefixes of rows `(hex, bytes)`, one frame per pass, and prefixes no digit is left for.

    Each frame holds (prefix, shard, depth, shard_bytes), prefix being `hex` up to the digits of its pass.
    """
    settled, pending = [], rows.select("hex", "bytes")
    for upto in range(DIGITS, digits + 1, DIGITS):
        sums = pending.groupBy(F.substring("hex", 1, upto).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        sums = sums.withColumn("bits", F.expr(_bits("prefix", upto)))
        low = upto * 4 - BITS
        first = low + 1 if low else 0
        levels = sums.select("*", F.explode(F.sequence(F.lit(first), F.lit(upto * 4))).alias("depth"))
        levels = levels.withColumn("shard", F.expr("substr(bits, 1, depth)"))
        fits = levels.groupBy("shard", "depth").agg(F.sum("bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= limit_bytes)
        leaves = levels.join(fits, ["shard", "depth"]).groupBy("prefix").agg(
            F.expr("min(struct(depth, shard, shard_bytes))").alias("leaf")
        )
        leaves = checkpoint(sums.select("prefix").join(leaves, "prefix", "left").select("prefix", "leaf.*"))
        settled.append(leaves.where("depth IS NOT NULL"))
        open_ = leaves.where("depth IS NULL").select("prefix")
        if open_.isEmpty():
            return settled, None
        pending = pending.join(open_, F.substring("hex", 1, upto) == F.col("prefix"), "left_semi")
    return settled, open_


def _assigned(rows: DataFrame, settled: list[DataFrame]) -> DataFrame:
    """Rows with the shard of the first pass that settles them."""
    found = []
    for number, frame in enumerate(settled):
        upto, name = DIGITS * (number + 1), f"leaf{number}"
        frame = frame.select(F.col("prefix").alias(f"p{number}"), F.struct("shard", "depth", "shard_bytes").alias(name))
        rows = rows.join(frame, F.substring("hex", 1, upto) == F.col(f"p{number}"), "left").drop(f"p{number}")
        found.append(name)
    return rows.withColumn("leaf", F.coalesce(*found)).drop(*found)


def shards(
    docs: DataFrame,
    *,
    limit_bytes: int = LIMIT_BYTES,
    key_column: str = "doc_id",
    text_column: str = "text",
    columns: tuple[str, ...] | None = None,
) -> DataFrame:
    """The documents, or the given columns of them, with `shard`, `depth` and `shard_bytes`."""
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in columns or docs.columns if c not in ("shard", "depth", "shard_bytes"))).alias("doc"),
        _hex(F.col(key_column)).alias("hex"),
        F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("bytes"),
        F.col(text_column).alias("body"),
    )
    small, big = rows.where(F.col("bytes") <= limit_bytes), rows.where(F.col("bytes") > limit_bytes)
    settled, left = directory(small, limit_bytes, KEY_DIGITS)
    placed = _assigned(small, settled)
    parts = [placed.where("leaf IS NOT NULL").select("doc", "leaf.*")]
    if left is not None:  # keys whose rows exceed the limit together
        rest = placed.where("leaf IS NULL").select("doc", F.col("hex").alias("key"), "bytes", "body")
        rest = checkpoint(rest.select("*", F.monotonically_increasing_id().alias("row")))
        # Key bits are used up: go on inside each key with bits of the text and then of the row.
        longer = F.concat("key", _hex(F.col("body")), _hex(F.col("row")))
        rest = rest.select("doc", longer.alias("hex"), "bytes")
        deep, _ = directory(rest, limit_bytes, 3 * KEY_DIGITS)
        parts.append(_assigned(rest, deep).select("doc", "leaf.*"))
    lone = checkpoint(big.select("doc", "bytes", F.monotonically_increasing_id().alias("row")))
    parts.append(
        lone.select(
            "doc", F.concat(F.lit("row"), "row").alias("shard"), F.lit(None).cast("int").alias("depth"), F.col("bytes").alias("shard_bytes")
        )
    )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select("doc.*", "shard", "depth", "shard_bytes")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows of a shard meet in one task, which the byte limit bounds."""
    sharded.withColumn("shard", F.concat(F.lit("b"), "shard")).repartition("shard").write.partitionBy("shard").parquet(path)


def op4_sharding(spark, folder: str) -> DataFrame:
    """All documents in shards of at most 8 MiB of text."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    docs = table(spark, folder, "documents").select("doc_id", "text", size.alias("bytes"))
    return shards(docs, columns=("doc_id", "bytes"))


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
    lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {KEY_DIGITS}))::BIGINT), {4 * KEY_DIGITS}, '0') AS bits
  FROM documents
), l AS (
  SELECT doc_id, bits, bytes, depth, substr(bits, 1, depth) AS shard FROM d, (SELECT unnest(range(0, 33)) AS depth)
), s AS (
  SELECT shard, depth, sum(bytes)::BIGINT AS shard_bytes FROM l GROUP BY ALL HAVING sum(bytes) <= {LIMIT_BYTES}
), r AS (
  SELECT l.*, shard_bytes, row_number() OVER (PARTITION BY doc_id ORDER BY l.depth) AS nth
  FROM l JOIN s ON l.shard = s.shard AND l.depth = s.depth
)
SELECT doc_id, bytes, shard, depth::INTEGER AS depth, shard_bytes FROM r WHERE nth = 1
"""
