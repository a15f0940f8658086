"""Title lists: from files, from text columns, or drawn at random from a table of titles."""

from __future__ import annotations

import sys
import warnings
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.functions.text import strip

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Title prefixes of the namespaces other than the main one, and their short and older forms.
OTHER_NAMESPACES = (
    "Talk", "User", "User talk", "Wikipedia", "Wikipedia talk", "File", "File talk", "MediaWiki",
    "MediaWiki talk", "Template", "Template talk", "Help", "Help talk", "Category", "Category talk",
    "Portal", "Portal talk", "Draft", "Draft talk", "Module", "Module talk", "Special", "Media",
    "TimedText", "TimedText talk", "Book", "Book talk", "Gadget", "Gadget talk", "Gadget definition",
    "Gadget definition talk", "Education Program", "Education Program talk", "MOS", "MOS talk", "Topic",
    "WP", "WT", "Project", "Project talk", "Image", "Image talk", "TM",
)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """`ord, title` from a UTF-8 file with one title per line; blank lines go, order and duplicates stay.

    The files are read once and their lines dealt by split. Each split counts its own lines, and only the counts
    meet; counts and lines come from the same exchange, so lines are numbered as they were read.
    """
    lines = spark.read.text(path).select(
        "_metadata.file_path", "_metadata.file_block_start", strip(F.col("value")).alias("title")
    )
    lines = lines.filter(F.col("title") != "").withColumn("row", F.monotonically_increasing_id())
    dealt = lines.repartition("file_path", "file_block_start")
    # All columns are read here too, else there would be a second, narrower scan.
    splits = dealt.groupBy("file_path", "file_block_start").agg(F.min("row").alias("first_row"), F.count("title").alias("size"))
    # One row per file split, not per title.
    earlier = Window.orderBy("file_path", "file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("offset", F.coalesce(F.sum("size").over(earlier), F.lit(0))).drop("size")
    numbered = dealt.join(offsets, ["file_path", "file_block_start"])
    return numbered.select((F.col("offset") + F.col("row") - F.col("first_row")).alias("ord"), "title")


def require_titles(titles: DataFrame) -> DataFrame:
    """The list itself, or an error when it holds no title."""
    if titles.isEmpty():
        raise ValueError("the title list is empty or holds no valid title")
    return titles


def lines_as_titles(table: DataFrame, key: str, text: str) -> DataFrame:
    """`key, ord, title`: the non-blank lines of a text column."""
    lines = table.select(key, F.posexplode(F.split(F.col(text), "\r\n|\r|\n")).alias("ord", "line"))
    return lines.select(key, "ord", strip(F.col("line")).alias("title")).filter(F.col("title") != "")


def requested_count(titles: DataFrame | None, asked: int | None) -> DataFrame | int:
    """How many pages a run covers: a title list decides alone, otherwise the number asked for."""
    if titles is None:
        if asked is None:
            raise ValueError("give either titles or a number of pages")
        return asked
    counted = titles.agg(F.count("*").alias("n_pages"))
    if asked is not None and counted.head()[0] != asked:
        warnings.warn("the number of pages is ignored because titles are given", stacklevel=2)
    return counted


def is_main_namespace(title: Column) -> Column:
    """True for titles without the prefix of another namespace."""
    prefix = F.lower(F.replace(F.substring_index(title, ":", 1), F.lit("_"), F.lit(" ")))
    prefixed = F.contains(title, F.lit(":")) & strip(prefix).isin(*(n.lower() for n in OTHER_NAMESPACES))
    return ~prefixed


def main_namespace(titles: DataFrame, namespace: str = "namespace") -> DataFrame:
    """Titles of the main namespace: by its number where the table has one, otherwise by prefix."""
    return titles.filter(F.col(namespace) == 0 if namespace in titles.columns else is_main_namespace(F.col("title")))


def keep_first(titles: DataFrame) -> DataFrame:
    """Distinct titles, each with its first `ord`; partial sums before the shuffle absorb hot titles."""
    return titles.groupBy("title").agg(F.min("ord").alias("ord"))


def first_titles(titles: DataFrame, n: int) -> DataFrame:
    """The first `n` titles by `ord`; none for n <= 0."""
    return titles.orderBy("ord").limit(max(n, 0))


def _least(n: int):
    """The `n` least distinct (rank_key, title) of a partition; holds at most as many and one batch."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            both = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            both = both.group_by(["rank_key", "title"]).aggregate([])
            order = pc.sort_indices(both, sort_keys=[("rank_key", "ascending"), ("title", "ascending")])
            held = both.take(order[:n]).combine_chunks()
        if held is not None:
            yield from held.select(["rank_key", "title"]).to_batches()

    return keep


def random_titles(titles: DataFrame, n: int, seed: str) -> DataFrame:
    """`ord, rank_key, title`: up to `n` distinct main-namespace titles in their random order, the same ones for the same seed.

    A title's rank is a seeded hash, so the draw is a bottom-n sketch: every partition keeps its `n` least distinct
    ranks, and at most `n` rows of a partition meet the others.
    """
    keyed = main_namespace(titles).select(F.md5(F.concat(F.lit(seed), F.col("title"))).alias("rank_key"), "title")
    keyed = keyed.filter("title IS NOT NULL")
    least = keyed.mapInArrow(_least(max(n, 0)), "rank_key string, title string")
    drawn = least.distinct().orderBy("rank_key", "title").limit(max(n, 0))
    in_order = Window.orderBy("rank_key", "title")  # n rows, which the limit has put in one place
    return drawn.select((F.row_number().over(in_order).cast("bigint") - 1).alias("ord"), "rank_key", "title")
