"""Outcomes of a run: successes, failures, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FETCH_FAILED = "Failed to fetch HTML"


def fetch_error(html: Column) -> Column:
    """Error message of a page that is missing or empty, else null."""
    return F.when(html.isNull() | (html == ""), FETCH_FAILED)


def succeeded(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("error_message").isNull())


def failures(outcomes: DataFrame) -> DataFrame:
    """`ord, title, error_message` of what failed, under the title that was asked for."""
    return outcomes.filter(F.col("error_message").isNotNull()).select("ord", "title", "error_message")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One row `attempted, succeeded, failed`."""
    return outcomes.agg(
        F.count("*").alias("attempted"),
        F.count_if(F.col("error_message").isNull()).alias("succeeded"),
        F.count_if(F.col("error_message").isNotNull()).alias("failed"),
    )


def top_failures(outcomes: DataFrame, n: int = 10) -> DataFrame:
    """The first `n` failures by `ord`."""
    return failures(outcomes).orderBy("ord").limit(n)


def failures_left_out(outcomes: DataFrame, n: int = 10) -> DataFrame:
    """One row `failed, left_out`: how many failures the short report does not show."""
    failed = F.count_if(F.col("error_message").isNotNull())
    return outcomes.agg(failed.alias("failed"), F.greatest(failed - n, F.lit(0)).alias("left_out"))
