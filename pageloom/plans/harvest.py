"""Titles in, one outcome per title out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import page_url
from pageloom.operators.outcome import FETCH_FAILED
from pageloom.plans.articles import articles
from pageloom.profiles import WIKI, Profile
from pageloom.sources.pages import pages_for, with_urls


def harvest(
    titles: DataFrame,
    pages: DataFrame,
    profile: Profile = WIKI,
    *,
    keep_images: bool = False,
    keep_infobox: bool = False,
) -> DataFrame:
    """`ord, input_title, title, url, content, sections, images, infobox_data, error_message` per title.

    Each page is cleaned once however often it is asked for; only then do the titles, which
    may repeat, meet their articles.
    """
    asked = with_urls(titles.select("ord", F.col("title").alias("input_title"), "title")).withColumnRenamed(
        "url", "asked_url"
    )
    wanted = pages_for(asked.select(F.col("asked_url").alias("url")), pages)
    # The address rides along with its page, so pages and titles meet once.
    untitled = wanted.select("page_id", F.lit(None).cast("string").alias("title"), "html", F.col("url").alias("address"))
    cleaned = articles(untitled, profile, keep_images=keep_images, keep_infobox=keep_infobox)
    answers = cleaned.drop("input_title", "url").withColumnsRenamed({"title": "found_title", "address": "asked_url"})
    title = F.coalesce(F.col("found_title"), F.col("input_title"))
    missing = F.col("page_id").isNull()
    return asked.join(answers, "asked_url", "left").select(
        "ord",
        "input_title",
        title.alias("title"),
        F.when(F.col("content").isNotNull(), page_url(title)).alias("url"),
        "content",
        "sections",
        "images",
        "infobox_data",
        F.when(missing, FETCH_FAILED).otherwise(F.col("error_message")).alias("error_message"),
    )
