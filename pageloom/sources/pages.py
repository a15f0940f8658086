"""Page tables and the lookup of pages by title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import page_url


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """`page_id, url, html` of a parquet table, nothing else read."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """`page_id, url, title, html` from a folder of HTML files, one page per file.

    The id is a hash of the file's address, so it stays the same in every run; the title is the
    file's name without its ending, with underscores read as spaces.
    """
    url = F.col("_metadata.file_path")
    name = F.regexp_replace(F.substring_index(url, "/", -1), r"(?i)\.x?html?$", "")
    return spark.read.text(path, wholetext=True).select(
        F.xxhash64(url).alias("page_id"),
        url.alias("url"),
        F.replace(F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name), F.lit("_"), F.lit(" ")).alias("title"),
        F.col("value").alias("html"),
    )


def with_urls(titles: DataFrame) -> DataFrame:
    """Add the address each title is fetched from."""
    return titles.withColumn("url", page_url(F.col("title")))


def pages_for(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages behind a set of addresses, one per address (lowest `page_id` where stored twice).

    Only ids are grouped, so a hot address moves no HTML; the planner broadcasts the chosen
    ids when they are few and shuffles by id otherwise.
    """
    wanted = urls.select("url").distinct()
    chosen = (
        pages.select("url", "page_id").join(wanted, "url", "left_semi").groupBy("url").agg(F.min("page_id").alias("page_id"))
    )
    return pages.join(chosen.select("page_id"), "page_id", "left_semi")


def lookup(titles: DataFrame, pages: DataFrame) -> DataFrame:
    """Left join of titles (with `url`) to their pages; a title without a page keeps its row.

    Titles may repeat without bound. Pages are unique per address, and a hot title is
    split by the skew handling of adaptive execution.
    """
    found = pages_for(titles, pages).select("url", "page_id", "html")
    return titles.join(found, "url", "left")
