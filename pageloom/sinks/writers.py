"""Article and failure writers."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators.outcome import failures
from pageloom.plans.template import article_json


def valid_articles(articles: DataFrame) -> DataFrame:
    """Records that hold an article; failed and empty records are left out."""
    return articles.filter(F.col("content").isNotNull())


def json_lines(articles: DataFrame, template: dict[str, Any]) -> DataFrame:
    """One JSON object per article in column `value`."""
    valid = valid_articles(articles)
    return valid.select(article_json(valid, template).alias("value"))


def write_json_lines(articles: DataFrame, template: dict[str, Any], path: str, mode: str = "errorifexists") -> None:
    """JSON Lines, written in parallel; parent folders are created."""
    json_lines(articles, template).write.mode(mode).text(path)


def _framed(keyed: DataFrame, order: str, low: Any, high: Any) -> DataFrame:
    opening = F.when(F.col(order) == low, "[").otherwise("")
    closing = F.when(F.col(order) == high, "]").otherwise(",")
    return keyed.select(order, F.concat(opening, F.col("json"), closing).alias("value"))


def json_array_lines(articles: DataFrame, template: dict[str, Any], order: str, pages: DataFrame) -> DataFrame:
    """`order, value`: lines that in order form one JSON array; the one line `[]` without articles.

    The order column is unique. Its first and last value come from the pages that the articles
    were made of, where HTML decides which of them are articles; no page is cleaned for that.
    """
    valid = valid_articles(articles)
    keyed = valid.select(order, article_json(valid, template).alias("json"))
    ends = pages.filter("html <> ''").agg(F.min(order).alias("low"), F.max(order).alias("high"))
    none = ends.filter("low IS NULL").select(F.col("low").alias(order), F.lit("[]").alias("value"))
    return _framed(keyed, order, ends.select("low").scalar(), ends.select("high").scalar()).union(none)


def write_json_array(
    articles: DataFrame, template: dict[str, Any], path: str, order: str, mode: str = "errorifexists"
) -> None:
    """A folder whose part files, concatenated by name, are one JSON array; `[]` without articles.

    The articles are made once, as lines in a folder beside the result, which goes when the array is written. Those lines
    are spread by ranges of the order column, so no task holds the array; the first row of the first part opens
    the array, and one more row, which sorts last, closes it.
    """
    spark = articles.sparkSession
    valid = valid_articles(articles)
    aside = f"{path.rstrip('/')}.lines-{uuid.uuid4()}"
    try:
        valid.select(order, article_json(valid, template).alias("json")).write.parquet(aside)
        lines = spark.read.parquet(aside).select(F.lit(False).alias("is_end"), order, "json")
        closing = spark.range(1).select(F.lit(True).alias("is_end"), F.lit(None).cast(lines.schema[order].dataType).alias(order), F.lit("]").alias("json"))
        placed = lines.unionAll(closing).orderBy("is_end", order)
        # Row numbers follow the sorted parts, and the first part is never empty.
        opened = placed.select("is_end", "json", (F.monotonically_increasing_id() == 0).alias("is_first"))
        frame = F.when(F.col("is_first"), "[").otherwise(F.when(F.col("is_end"), "").otherwise(","))
        opened.select(F.concat(frame, "json").alias("value")).write.mode(mode).text(path)
    finally:
        remove_folder(spark, aside)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job made for itself, in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def write_failures(outcomes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All failures; the short report is `top_failures`."""
    failures(outcomes).write.mode(mode).parquet(path)
