"""From documents to packed training sequences: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import minhash, mixing, packing, quality, secrets
from pageloom.llm.common import remove, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from those among them that have labels and are not held out.

    Null and empty texts are judged like others. Without labels every score is 0.5, and all documents stay.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    judged = quality.scored(docs.select(F.struct("*").alias("doc"), "doc_id", "text"), model)
    return judged.where("predicted = 1").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the smallest id; rows without id stay.

    Documents without words are no copies of each other. Of several rows with the smallest id one stays, the same in every run.
    """
    kept = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id"), _row_key(docs).alias("row_key"))
    first = rows.where("doc_id IS NOT NULL").selectExpr(
        "*", "row_number() OVER (PARTITION BY doc_id ORDER BY row_key) AS nth"
    )
    first = first.where("nth = 1").join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi")
    return first.select("doc.*").unionByName(rows.where("doc_id IS NULL").select("doc.*"))


def _row_key(docs: DataFrame) -> Column:
    """A key of the whole row; other columns may be of any kind, maps included."""
    return F.xxhash64("doc_id", "text", F.to_json(F.struct("*")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mask and their length counted anew; null texts stay null."""
    found = secrets.scan(docs.select(F.struct("*").alias("doc"), "doc_id", "text"))
    new = {"text": secrets.masked()}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("masked").cast(kind)).otherwise(F.col("doc.n_chars"))
    found = found.withColumn("masked", new.pop("text"))
    columns = {"text": F.col("masked"), **new}
    return found.select(*(columns.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words are never taken."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)"""
    cut = packing.pieces(docs, tokenizer=packing.default_tokenizer())
    return packing.packed(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: SQL cannot express the models and sketches; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a table between two of them goes when the next one is written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        before, path = path, written(stage(spark, docs, sf_dir))
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
