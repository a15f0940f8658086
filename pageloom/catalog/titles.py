"""Title sources, text functions, lookup, outcomes, pacing."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.catalog.fixtures import esc, wrap
from pageloom.catalog.raw_pages import ARTICLES_SQL
from pageloom.catalog.registry import WS, norm, query, scratch, stripped, table, wiki_url
from pageloom.functions.text import normalize_whitespace, page_url, sanitize_filename, squeeze_blank_lines, strip
from pageloom.operators import outcome
from pageloom.operators.pacing import pace_requests
from pageloom.plans.harvest import harvest
from pageloom.profiles import GENERIC
from pageloom.sources import titles as T
from pageloom.sources.pages import lookup

_LINES = r"string_split_regex(text, '\r\n|\r|\n')"
LINES_SQL = f"""
    SELECT doc_id, (ord - 1)::INTEGER AS ord, {stripped('line')} AS title
    FROM (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS ord FROM documents)
    WHERE {stripped('line')} <> ''"""


@query("title_lines", LINES_SQL)
def title_lines(spark: SparkSession, folder: str) -> DataFrame:
    return T.lines_as_titles(table(spark, folder, "documents"), "doc_id", "text")


@query("titles_decide_count", f"SELECT count(*) AS n_pages FROM ({LINES_SQL})")
def titles_decide_count(spark: SparkSession, folder: str) -> DataFrame:
    """One page is asked for, but the titles decide."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return T.requested_count(title_lines(spark, folder), 1)


@query(
    "file_titles",
    f"""SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS ord, {stripped("title")} AS title
        FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '  ' ELSE p_name || ' ' END AS title FROM part) WHERE {stripped("title")} <> ''""",
)
def file_titles(spark: SparkSession, folder: str) -> DataFrame:
    """A title list from text files: blank lines go, lines are numbered across files in their order."""
    path = scratch(spark, "titles")
    line = F.when(F.col("p_size") % 5 == 0, "  ").otherwise(F.concat("p_name", F.lit(" ")))
    table(spark, folder, "part").orderBy("p_partkey").select(line.alias("value")).write.text(path)
    return T.read_titles(spark, path)


@query(
    "random_titles",
    "SELECT md5('loom-7:' || p_name) AS rank_key, p_name AS title FROM (SELECT DISTINCT p_name FROM part) "
    "ORDER BY 1, 2 LIMIT 20",
)
def random_titles(spark: SparkSession, folder: str) -> DataFrame:
    drawn = T.random_titles(table(spark, folder, "part").select(F.col("p_name").alias("title")), 20, "loom-7:")
    return drawn.select("rank_key", "title")


@query(
    "random_order",
    """SELECT (row_number() OVER (ORDER BY md5('draw' || c_name), c_name) - 1)::BIGINT AS ord, c_name AS title
       FROM (SELECT DISTINCT c_name FROM customer) ORDER BY ord LIMIT 50""",
)
def random_order(spark: SparkSession, folder: str) -> DataFrame:
    """A draw that can be harvested: titles with their place."""
    return T.random_titles(table(spark, folder, "customer").select(F.col("c_name").alias("title")), 50, "draw").select("ord", "title")


_PREFIXED = "CASE p_type WHEN 'PROMO' THEN 'Talk:' WHEN 'LARGE' THEN 'user_talk: ' WHEN 'SMALL' THEN 'Re: ' ELSE '' END"


@query(
    "main_namespace_titles",
    f"SELECT p_partkey, {_PREFIXED} || p_name AS title FROM part WHERE p_type NOT IN ('PROMO', 'LARGE')",
)
def main_namespace_titles(spark: SparkSession, folder: str) -> DataFrame:
    titled = table(spark, folder, "part").selectExpr("p_partkey", f"concat({_PREFIXED}, p_name) AS title")
    return titled.filter(T.is_main_namespace(F.col("title")))


@query("main_namespace_by_number", "SELECT p_partkey, p_name AS title FROM part WHERE p_size % 3 = 0")
def main_namespace_by_number(spark: SparkSession, folder: str) -> DataFrame:
    numbered = table(spark, folder, "part").selectExpr("p_partkey", "p_name AS title", "p_size % 3 AS namespace")
    return T.main_namespace(numbered).select("p_partkey", "title")


@query("keep_first_titles", "SELECT p_name AS title, min(p_partkey) AS ord FROM part GROUP BY p_name")
def keep_first_titles(spark: SparkSession, folder: str) -> DataFrame:
    return T.keep_first(table(spark, folder, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("title")))


@query("first_titles", "SELECT p_partkey AS ord, p_name AS title FROM part ORDER BY 1 LIMIT 25")
def first_titles(spark: SparkSession, folder: str) -> DataFrame:
    return T.first_titles(
        table(spark, folder, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("title")), 25
    )


_ALL_TITLES = """SELECT p_name AS title FROM part UNION ALL SELECT c_name FROM customer
    UNION ALL SELECT p_brand || '/' || p_type || ' ~*' FROM part UNION ALL SELECT text FROM documents"""


def _all_titles(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return (
        part.select(F.col("p_name").alias("title"))
        .unionAll(table(spark, folder, "customer").select("c_name"))
        .unionAll(part.select(F.concat("p_brand", F.lit("/"), "p_type", F.lit(" ~*"))))
        .unionAll(table(spark, folder, "documents").select("text"))
    )


@query("page_urls", f"SELECT title, {wiki_url('title')} AS url FROM ({_ALL_TITLES})")
def page_urls(spark: SparkSession, folder: str) -> DataFrame:
    return _all_titles(spark, folder).select("title", page_url(F.col("title")).alias("url"))


@query(
    "file_names",
    f"""SELECT title, regexp_replace({stripped(f"regexp_replace(title, '[^\\p{{L}}\\p{{N}}_' || '{WS[1:-1]}' || '-]', '', 'g')")},
        '[{WS[1:-1]}-]+', '-', 'g') AS name FROM ({_ALL_TITLES})""",
)
def file_names(spark: SparkSession, folder: str) -> DataFrame:
    return _all_titles(spark, folder).select("title", sanitize_filename(F.col("title")).alias("name"))


@query("normalized_text", f"SELECT doc_id, {norm('text')} AS text FROM documents")
def normalized_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", normalize_whitespace(F.col("text")).alias("text"))


_LOOSE = "replace(text, '. ', '.  ' || chr(10) || ' ' || chr(10) || chr(10) || chr(9) || chr(10))"


@query(
    "squeezed_blank_lines",
    f"""SELECT doc_id, {stripped(f"regexp_replace(regexp_replace({_LOOSE}, '{WS}+' || chr(10), chr(10), 'g'), '(' || chr(10) || '{WS}*){{3,}}', chr(10) || chr(10), 'g')")} AS text
        FROM documents""",
)
def squeezed_blank_lines(spark: SparkSession, folder: str) -> DataFrame:
    loose = F.replace(F.col("text"), F.lit(". "), F.lit(".  \n \n\n\t\n"))
    return table(spark, folder, "documents").select("doc_id", squeeze_blank_lines(loose).alias("text"))


@query(
    "case_folded_match",
    f"SELECT doc_id, lower({stripped('text')}) AS folded, contains(lower(text), 'the') AS has_the FROM documents",
)
def case_folded_match(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", F.lower(strip(text)).alias("folded"), F.contains(F.lower(text), F.lit("the")).alias("has_the")
    )


LOOKUP_SQL = f"""
    SELECT t.ord, t.title, p.page_id, length(p.html) AS n_chars,
           CASE WHEN p.page_id IS NULL THEN 'Failed to fetch HTML' END AS error_message
    FROM (SELECT page_id AS ord, url AS title, url FROM pages
          UNION ALL SELECT page_id + 10000000, url, url FROM pages
          UNION ALL SELECT c_custkey + 20000000, c_name, {wiki_url('c_name')} FROM customer) t
    LEFT JOIN (SELECT url, min(page_id) AS page_id, arg_min(html, page_id) AS html FROM pages GROUP BY url) p
      ON t.url = p.url"""


def _lookup_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    asked = (
        pages.select(F.col("page_id").alias("ord"), F.col("url").alias("title"), "url")
        .unionAll(pages.select(F.col("page_id") + 10_000_000, "url", "url"))
        .unionAll(
            table(spark, folder, "customer").select(
                F.col("c_custkey") + 20_000_000, "c_name", page_url(F.col("c_name"))
            )
        )
    )
    return lookup(asked, pages).select(
        "ord",
        "title",
        "page_id",
        F.length("html").cast("bigint").alias("n_chars"),
        outcome.fetch_error(F.col("html")).alias("error_message"),
    )


@query("page_lookup", LOOKUP_SQL)
def page_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return _lookup_outcomes(spark, folder)


@query("successes", f"SELECT ord, title, page_id, n_chars FROM ({LOOKUP_SQL}) WHERE error_message IS NULL")
def successes(spark: SparkSession, folder: str) -> DataFrame:
    return outcome.succeeded(_lookup_outcomes(spark, folder)).drop("error_message")


@query("failures", f"SELECT ord, title, error_message FROM ({LOOKUP_SQL}) WHERE error_message IS NOT NULL")
def failures(spark: SparkSession, folder: str) -> DataFrame:
    return outcome.failures(_lookup_outcomes(spark, folder))


@query(
    "run_summary",
    f"""SELECT count(*) AS attempted, count(*) FILTER (error_message IS NULL) AS succeeded,
        count(error_message) AS failed FROM ({LOOKUP_SQL})""",
)
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return outcome.run_summary(_lookup_outcomes(spark, folder))


@query(
    "top_failures",
    f"SELECT ord, title, error_message FROM ({LOOKUP_SQL}) WHERE error_message IS NOT NULL ORDER BY ord LIMIT 10",
)
def top_failures(spark: SparkSession, folder: str) -> DataFrame:
    return outcome.top_failures(_lookup_outcomes(spark, folder))


@query(
    "failures_left_out",
    f"SELECT count(error_message) AS failed, greatest(count(error_message) - 10, 0) AS left_out FROM ({LOOKUP_SQL})",
)
def failures_left_out(spark: SparkSession, folder: str) -> DataFrame:
    return outcome.failures_left_out(_lookup_outcomes(spark, folder))


HARVEST_SQL = f"""SELECT ord, input_title, CASE WHEN error_message IS NULL THEN content_title ELSE input_title END AS title,
               CASE WHEN error_message IS NULL THEN {wiki_url('content_title')} END AS url,
               CASE WHEN error_message IS NULL THEN 'About ' || input_title END AS content, error_message
        FROM (SELECT p_partkey AS ord, p_name AS input_title, 'The ' || p_name AS content_title,
                     NULL::VARCHAR AS error_message FROM part
              UNION ALL SELECT c_custkey + 10000000, c_name, c_name, 'Failed to fetch HTML' FROM customer)"""


def _part_pages(part: DataFrame) -> DataFrame:
    """One page per part name, keyed by its address."""
    name = F.col("p_name")
    html = wrap(F.concat(F.lit("The "), name), "<p>About ", esc(name), "</p>")
    return part.groupBy("p_name").agg(F.min("p_partkey").alias("page_id")).select("page_id", page_url(name).alias("url"), html.alias("html"))


@query("harvest", HARVEST_SQL)
def harvest_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that repeat (few distinct part names) and titles that miss, against pages keyed by address."""
    part = table(spark, folder, "part")
    titles = part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("title")).unionAll(
        table(spark, folder, "customer").select(F.col("c_custkey") + 10_000_000, "c_name")
    )
    return harvest(titles, _part_pages(part)).select("ord", "input_title", "title", "url", "content", "error_message")


@query(
    "random_harvest",
    f"""SELECT ord, input_title, title, {wiki_url('title')} AS url, content, error_message FROM (
          SELECT (row_number() OVER (ORDER BY md5('tour' || p_name), p_name) - 1)::BIGINT AS ord, p_name AS input_title,
                 'The ' || p_name AS title, 'About ' || p_name AS content, NULL::VARCHAR AS error_message
          FROM (SELECT DISTINCT p_name FROM part)) ORDER BY ord LIMIT 12""",
)
def random_harvest(spark: SparkSession, folder: str) -> DataFrame:
    """N random pages as one job: titles are drawn, looked up and cleaned."""
    part = table(spark, folder, "part")
    drawn = T.random_titles(part.select(F.col("p_name").alias("title")), 12, "tour")
    return harvest(drawn, _part_pages(part)).select("ord", "input_title", "title", "url", "content", "error_message")


@query(
    "harvest_summary",
    f"""SELECT count(*) AS attempted, count(*) FILTER (error_message IS NULL) AS succeeded,
        count(error_message) AS failed FROM ({HARVEST_SQL})""",
)
def harvest_summary(spark: SparkSession, folder: str) -> DataFrame:
    return outcome.run_summary(harvest_titles(spark, folder))


@query(
    "harvest_pages",
    f"""SELECT p.page_id AS ord, p.url AS input_title, a.title, a.url, a.content, NULL::VARCHAR AS error_message
        FROM pages p JOIN (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) f ON p.url = f.url
        JOIN ({ARTICLES_SQL}) a ON a.page_id = f.page_id""",
)
def harvest_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The page table, looked up by its own addresses taken as titles."""
    pages = table(spark, folder, "pages")
    titles = pages.select(F.col("page_id").alias("ord"), F.col("url").alias("title"))
    stored = pages.select("page_id", page_url(F.col("url")).alias("url"), "html")
    done = harvest(titles, stored, GENERIC)
    return done.select("ord", "input_title", "title", "url", "content", "error_message")


GAP_US = 6 * 3600 * 1_000_000


@query(
    "request_pacing",
    f"""SELECT event_id, user_id, (nth * {GAP_US} + max(arrival - nth * {GAP_US}) OVER
               (PARTITION BY user_id ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS send_us
        FROM (SELECT event_id, user_id, epoch_us(ts) AS arrival,
                     row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nth FROM events)""",
)
def request_pacing(spark: SparkSession, folder: str) -> DataFrame:
    arrival = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    requests = table(spark, folder, "events").select("event_id", "user_id", arrival.alias("arrival_us"))
    return pace_requests(requests, "user_id", "arrival_us", "event_id", GAP_US).drop("arrival_us")
