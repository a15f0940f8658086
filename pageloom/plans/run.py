"""One run: titles in, and one written table of outcomes from which everything else is derived."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from pageloom.operators.outcome import succeeded
from pageloom.plans.harvest import harvest
from pageloom.plans.template import check_template, default_template
from pageloom.profiles import WIKI, Profile
from pageloom.sinks.writers import write_failures, write_json_array, write_json_lines
from pageloom.sources.titles import random_titles, requested_count, require_titles

SHOWN = 10


def chosen_titles(titles: DataFrame | None, count: int | None, known: DataFrame | None, seed: str) -> DataFrame:
    """The titles of a run (ord, title): the list where one is given, otherwise `count` titles drawn from those known."""
    requested_count(titles, count)
    if titles is not None:
        return require_titles(titles)
    if known is None:
        raise ValueError("a number of pages needs a table of titles to draw from")
    return require_titles(random_titles(known, count, seed).select("ord", "title"))


def run(
    titles: DataFrame | None,
    pages: DataFrame,
    output: str,
    template: dict[str, Any] | None = None,
    profile: Profile = WIKI,
    *,
    count: int | None = None,
    known: DataFrame | None = None,
    seed: str = "",
    keep_images: bool = False,
    keep_infobox: bool = False,
    as_array: bool = False,
    mode: str = "errorifexists",
) -> dict[str, Any]:
    """Clean the pages of `titles` (ord, title) once and write `outcomes`, `articles` and `failures` below `output`.

    Without titles, `count` of them are drawn from the table `known`. Pages are cleaned when the outcomes are written, and
    that write also counts them; articles (JSON lines, or one array in the order of the titles) and failures read what was written.
    An empty list is an error; a template that leaves out what is extracted is warned about. Returns the
    counts, the short failure report, the warnings and the seconds the run took.
    """
    start = time.monotonic()
    kept = {"keep_images": keep_images, "keep_infobox": keep_infobox}
    template = template or default_template(**kept)
    notes = check_template(template, **kept)
    asked = chosen_titles(titles, count, known, seed)
    spark = asked.sparkSession
    seen = Observation()
    failed = F.col("error_message").isNotNull()
    counts = (F.count("*").alias("attempted"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"))
    harvest(asked, pages, profile, **kept).observe(seen, *counts).write.mode(mode).parquet(f"{output}/outcomes")
    outcomes = spark.read.parquet(f"{output}/outcomes")
    if as_array:
        write_json_array(succeeded(outcomes), template, f"{output}/articles", "ord", mode)
    else:
        write_json_lines(succeeded(outcomes), template, f"{output}/articles", mode)
    write_failures(outcomes.drop("title").withColumnRenamed("input_title", "title"), f"{output}/failures", mode)
    numbers = {name: seen.get[name] for name in ("attempted", "succeeded", "failed")}
    shown = spark.read.parquet(f"{output}/failures").orderBy("ord").limit(SHOWN).collect() if numbers["failed"] else []
    return {
        "summary": Row(**numbers),
        "failures": shown,
        "left_out": Row(failed=numbers["failed"], left_out=max(numbers["failed"] - SHOWN, 0)),
        "warnings": notes,
        "seconds": time.monotonic() - start,
    }
