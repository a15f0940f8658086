"""Queries over encyclopedia pages assembled from the given tables; oracles read the source columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.catalog import fixtures as fx
from pageloom.catalog.registry import norm, query, wiki_url
from pageloom.operators.nodes import nodes
from pageloom.plans.articles import articles, image_rows, infobox_rows, page_counters, section_rows

LINES = "string_split(text, chr(10))"


def lines_sql(item: str) -> str:
    """SQL text that joins `item`, an expression over line `s` and zero-based index `i`."""
    body = f"list_transform(list_zip({LINES}, range(len({LINES}))), lambda p: {item.replace('{s}', 'p[1]').replace('{i}', 'p[2]')})"
    return f"array_to_string({body}, '')"


def contents(pages: DataFrame, **kept: bool) -> DataFrame:
    return articles(pages, **kept).select("page_id", "content")


BOX_SQL = """
    SELECT c_custkey AS page_id, 0 AS ord, '_caption_' AS key, false AS is_list, [c_name] AS vals FROM customer
    UNION ALL SELECT c_custkey, 1, 'Segment', false, [lower(c_mktsegment)] FROM customer
    UNION ALL SELECT c_custkey, 2, 'Nation', false, [n_name || ' ' || n_nationkey] FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT c_custkey, 3, 'Balance', false, [''] FROM customer
    UNION ALL SELECT c_custkey, 4, '_infobox_notes_', true, ['Note of ' || c_name] FROM customer"""


def _rows(found: DataFrame) -> DataFrame:
    return found.select("page_id", "ord", "key", "is_list", F.to_json("vals").alias("vals"))


@query("infobox_pairs", f"SELECT page_id, ord, key, is_list, to_json(vals)::VARCHAR AS vals FROM ({BOX_SQL})")
def infobox_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(infobox_rows(fx.infobox_pages(spark, folder)))


@query(
    "infobox_caption_notes",
    f"SELECT page_id, key, vals[1] AS value FROM ({BOX_SQL}) WHERE key IN ('_caption_', '_infobox_notes_')",
)
def infobox_caption_notes(spark: SparkSession, folder: str) -> DataFrame:
    found = infobox_rows(fx.infobox_pages(spark, folder))
    return found.filter(F.col("key").isin("_caption_", "_infobox_notes_")).select(
        "page_id", "key", F.col("vals")[0].alias("value")
    )


@query(
    "infobox_article_json",
    """SELECT c_custkey AS page_id, '{"_caption_":' || to_json(c_name) || ',"Segment":' || to_json(lower(c_mktsegment)) ||
              ',"Nation":' || to_json(n_name || ' ' || n_nationkey) || ',"Balance":"","_infobox_notes_":[' ||
              to_json('Note of ' || c_name) || ']}' AS infobox_data, 'After ' || c_name AS content
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def infobox_article_json(spark: SparkSession, folder: str) -> DataFrame:
    found = articles(fx.infobox_pages(spark, folder), keep_infobox=True)
    return found.select("page_id", "infobox_data", "content")


@query(
    "infobox_dropped",
    "SELECT c_custkey AS page_id, 'After ' || c_name AS content, NULL::VARCHAR AS infobox_data FROM customer",
)
def infobox_dropped(spark: SparkSession, folder: str) -> DataFrame:
    return articles(fx.infobox_pages(spark, folder)).select("page_id", "content", "infobox_data")


@query(
    "infobox_body_rows",
    "SELECT c_custkey AS page_id, 0 AS ord, '_caption_' AS key, false AS is_list, to_json([c_name])::VARCHAR AS vals FROM customer",
)
def infobox_body_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows inside a table body are no direct children of the box and yield nothing."""
    return _rows(infobox_rows(fx.infobox_pages(spark, folder, body_tag=True)))


@query(
    "infobox_list_values",
    f"""SELECT doc_id AS page_id, 0 AS ord, 'Lines' AS key, true AS is_list,
               to_json(flatten(list_transform(list_zip({LINES}, range(len({LINES}))),
                       lambda p: [{norm("p[1] || ' n' || p[2]")}, 'n' || p[2]])))::VARCHAR AS vals FROM documents""",
)
def infobox_list_values(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(infobox_rows(fx.infobox_list_pages(spark, folder)))


IMAGES_SQL = """
    SELECT p_partkey AS page_id, 0 AS ord, 'https://img.example/' || p_partkey || '.png?a=1&b=2' AS src,
           p_name || ' pic' AS alt, 'Cap ' || p_brand AS caption FROM part
    UNION ALL SELECT p_partkey, 1, 'http://g/' || p_partkey, '', p_type FROM part
    UNION ALL SELECT p_partkey, 2, 'td.png', '', '' FROM part
    UNION ALL SELECT p_partkey, 3, '/loose/' || p_partkey || '.png', 'l&m', '' FROM part"""


@query("image_rows", IMAGES_SQL)
def images(spark: SparkSession, folder: str) -> DataFrame:
    return image_rows(fx.image_pages(spark, folder))


@query(
    "image_captions", f"SELECT page_id, string_agg(caption, '|' ORDER BY ord) AS captions FROM ({IMAGES_SQL}) GROUP BY 1"
)
def image_captions(spark: SparkSession, folder: str) -> DataFrame:
    found = articles(fx.image_pages(spark, folder), keep_images=True)
    return found.select("page_id", F.array_join("images.caption", "|").alias("captions"))


@query("images_dropped", "SELECT p_partkey AS page_id, 'Text * ' || p_type AS content, NULL::VARCHAR AS images FROM part")
def images_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """Without images a gallery entry that is no div stays as a list item."""
    found = articles(fx.image_pages(spark, folder))
    return found.select("page_id", "content", F.to_json("images").alias("images"))


@query("images_consumed", "SELECT p_partkey AS page_id, 'Text' AS content FROM part")
def images_consumed(spark: SparkSession, folder: str) -> DataFrame:
    return contents(fx.image_pages(spark, folder), keep_images=True)


_LEAD = "CASE WHEN lang = 'en' THEN 'Lead ' ELSE '' END"
_PARTS = lines_sql("' ## Part ' || {i} || ' ' || {s}")


@query(
    "trailing_removed",
    f"""SELECT doc_id AS page_id, {norm(f"{_LEAD} || {_PARTS} || ' bare # Top Kept ## End stays'").replace(' bare #', ' #')} AS content
        FROM documents""",
)
def trailing_removed(spark: SparkSession, folder: str) -> DataFrame:
    """Substring keywords, same-or-higher headings as stops, wrapped headings."""
    return contents(fx.section_pages(spark, folder))


@query(
    "section_list",
    f"""SELECT doc_id AS page_id, (generate_subscripts(l, 1) - 1)::INTEGER AS ord, unnest(l) AS section FROM (
          SELECT doc_id, list_concat(CASE WHEN lang = 'en' THEN ['Introduction'] ELSE [] END,
                 list_transform(range(len({LINES})), lambda i: 'Part ' || i), ['End']) AS l FROM documents)""",
)
def section_list(spark: SparkSession, folder: str) -> DataFrame:
    return section_rows(fx.section_pages(spark, folder))


@query(
    "wrapped_headings",
    f"SELECT doc_id AS page_id, '## Biography ' || {norm('text')} AS content, '[\"Content\"]' AS sections FROM documents",
)
def wrapped_headings(spark: SparkSession, folder: str) -> DataFrame:
    found = articles(fx.wrapped_heading_pages(spark, folder))
    return found.select("page_id", "content", F.to_json("sections").alias("sections"))


@query(
    "ordered_lists",
    f"""SELECT doc_id AS page_id, {norm(lines_sql("(2 * {i} + 1) || '. ' || {s} || ' '"))} AS content FROM documents""",
)
def ordered_lists(spark: SparkSession, folder: str) -> DataFrame:
    return contents(fx.ordered_list_pages(spark, folder))


@query(
    "bullet_lists",
    f"""SELECT doc_id AS page_id, {norm(lines_sql("'* ' || {s} || ' 1. n' || {i} || ' '"))} AS content FROM documents""",
)
def bullet_lists(spark: SparkSession, folder: str) -> DataFrame:
    return contents(fx.bullet_list_pages(spark, folder))


@query(
    "definition_lists",
    """SELECT s_suppkey AS page_id, '**' || s_name || '**: in ' || n_name || ' key ' || s_suppkey AS content
       FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def definition_lists(spark: SparkSession, folder: str) -> DataFrame:
    return contents(fx.definition_pages(spark, folder))


@query(
    "headings",
    "SELECT p_partkey AS page_id, '##### ' || p_name || 'xy ### ' || p_brand || ' #### ' || p_type AS content FROM part",
)
def headings(spark: SparkSession, folder: str) -> DataFrame:
    return contents(fx.heading_pages(spark, folder))


@query(
    "inline_markup",
    f"""SELECT doc_id AS page_id, {norm('text')} || ' B , end k * abshown tail next' AS content FROM documents""",
)
def inline_markup(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraph strings meet with a space, list item strings with nothing; hidden spans go in paragraphs only."""
    return contents(fx.inline_pages(spark, folder))


def _noise(name: str, kind: str) -> None:
    @query(f"{name}_removed", f"SELECT doc_id AS page_id, {norm('text')} AS content FROM documents")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return contents(fx.noise_pages(spark, folder, kind))


_noise("preprocess_noise", "preprocess")
_noise("boilerplate", "boilerplate")
_noise("infobox", "infobox")
_noise("image_markup", "images")


@query(
    "missing_areas",
    f"""SELECT doc_id AS page_id, 'Doc ' || doc_id AS title,
               CASE WHEN lang NOT IN ('fr', 'de') THEN {wiki_url("('Doc ' || doc_id)")} END AS url,
               CASE WHEN lang NOT IN ('fr', 'de') THEN '' END AS content,
               CASE WHEN lang NOT IN ('fr', 'de') THEN '[]' END AS sections,
               CASE WHEN lang NOT IN ('fr', 'de') THEN '[]' END AS images,
               CASE WHEN lang IN ('fr', 'de') THEN 'Failed to fetch HTML' END AS error_message FROM documents""",
)
def missing_areas(spark: SparkSession, folder: str) -> DataFrame:
    found = articles(fx.bare_pages(spark, folder))
    return found.select(
        "page_id", "title", "url", "content", F.to_json("sections").alias("sections"),
        F.to_json("images").alias("images"), "error_message",
    )


@query(
    "page_counters",
    """SELECT p_partkey AS page_id, 4 AS n_images, 0 AS n_infobox, 1 AS n_trailing FROM part
       UNION ALL SELECT c_custkey + 10000000, 0, 5, 0 FROM customer""",
)
def counters(spark: SparkSession, folder: str) -> DataFrame:
    boxes = fx.infobox_pages(spark, folder).withColumn("page_id", F.col("page_id") + 10_000_000)
    # The image inside the box goes with the box.
    return page_counters(fx.image_pages(spark, folder).unionAll(boxes))


@query(
    "node_intervals",
    f"""SELECT doc_id AS page_id, 'ul' AS tag, 5 AS pos, 4 + 6 * len({LINES}) + 1 AS last, 4 AS parent FROM documents
        UNION ALL SELECT doc_id, 'li', 6 + 6 * i, 6 + 6 * i + 4, 5 FROM (SELECT doc_id, unnest(range(len({LINES})))::INTEGER AS i FROM documents)
        UNION ALL SELECT doc_id, 'b', 8 + 6 * i, 9 + 6 * i, 6 + 6 * i FROM (SELECT doc_id, unnest(range(len({LINES})))::INTEGER AS i FROM documents)""",
)
def node_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Positions, ends and parents where an end tag that closes nothing is ignored."""
    items = fx.each_line(F.col("text"), lambda line, i: fx.cat("<li>L:", line, "<b>", i, "</b></li>"))
    pages = spark.read.parquet(f"{folder}/documents.parquet").select(
        F.col("doc_id").alias("page_id"),
        F.lit("t").alias("title"),
        fx.cat("<html></b><body><br/><div><ul>", items, "</ul></div></body></html>").alias("html"),
    )
    found = nodes(pages).filter(F.col("tag").isin("ul", "li", "b"))
    return found.select("page_id", "tag", "pos", "last", "parent")
