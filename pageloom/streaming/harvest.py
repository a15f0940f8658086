"""Pages that arrive as files, cleaned in micro-batches by the batch job."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom.plans.articles import articles
from pageloom.profiles import WIKI, Profile
from pageloom.streaming import seen

PAGE_SCHEMA = "page_id bigint, title string, html string"
BUCKETS = 64


def bucket() -> Column:
    return F.pmod(F.xxhash64("page_id"), F.lit(BUCKETS)).cast("int")


def written_before(spark: SparkSession, output: str, batch_id: int, buckets: list[int]) -> DataFrame | None:
    """Ids that earlier batches cleaned, from the given buckets alone; a page that failed may come back."""
    if not buckets:
        return None
    try:
        done = spark.read.option("basePath", output).parquet(f"{output}/bucket={{{','.join(map(str, buckets))}}}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return done.filter((F.col("batch") < batch_id) & F.col("error_message").isNull()).select("page_id")


def one_version(batch: DataFrame) -> DataFrame:
    """One row per id, the same in every run: with HTML before without, then by hash. Rows without id stay."""
    ranked = batch.selectExpr(
        "*",
        "row_number() OVER (PARTITION BY page_id, CASE WHEN page_id IS NULL THEN xxhash64(title, html) END "
        "ORDER BY coalesce(html = '', true), xxhash64(html, title), html, title) AS version",
    )
    return ranked.filter("version = 1 OR page_id IS NULL").drop("version")


def latest_articles(spark: SparkSession, output: str) -> DataFrame:
    """One row per page of all batches: its article, or its last failure while it has none."""
    written = spark.read.parquet(output)
    best = written.groupBy("page_id").agg(
        F.max(F.struct(F.col("error_message").isNull().alias("ok"), F.col("batch"))).alias("best")
    )
    best = best.select(F.col("page_id").alias("id"), F.col("best.batch").alias("best_batch"))
    shown = written.join(best, (written.page_id == best.id) & (written.batch == best.best_batch), "left_semi")
    return shown.unionByName(written.filter("page_id IS NULL"))


def stream_articles(
    spark: SparkSession,
    source: str,
    output: str,
    checkpoint: str,
    profile: Profile = WIKI,
    *,
    keep_images: bool = False,
    keep_infobox: bool = False,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Clean every page once as parquet files of pages arrive under `source`.

    Pages carry no event time, so a streaming de-duplication would keep state for ever. Each
    batch instead leaves out ids that earlier batches cleaned, which it looks up in sorted runs of ids
    (`streaming.seen`), and overwrites its own folders `bucket=.../batch=...`, so a batch that is run
    again after a loss changes nothing. A page that failed may arrive again; its article then
    stands beside the failure, and `latest_articles` shows the article. An output that has no runs yet gets one of
    all it holds.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if not seen.runs(session, output):
            older = written_before(session, output, batch_id, list(range(BUCKETS)))
            if older is not None:
                seen.remember(session, output, batch_id - 1, older)
        seen.merge(session, output, batch_id)
        fresh = one_version(batch)
        done = seen.seen_before(session, output, batch_id, batch)
        if done is not None:
            fresh = fresh.join(done, "page_id", "left_anti")
        cleaned = articles(fresh, profile, keep_images=keep_images, keep_infobox=keep_infobox)
        cleaned = cleaned.withColumns({"bucket": bucket(), "batch": F.lit(batch_id)})
        writer = cleaned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket", "batch").parquet(output)
        # Pages with HTML are those that do not fail.
        seen.remember(session, output, batch_id, fresh.filter("html <> ''"))

    reader = spark.readStream.schema(PAGE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(source)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
