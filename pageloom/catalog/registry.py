"""Query registry and the SQL fragments its oracles share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The whitespace class in the notation of the oracle's regular expressions.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WIKI_URL = "https://en.wikipedia.org/wiki/"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the warehouse, for queries about what is written and read again."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}-{uuid.uuid4()}"


def norm(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"


def stripped(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def decoded(text: str) -> str:
    """Entities that occur in the page table; the ampersand last."""
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    return text


def wiki_url(title: str) -> str:
    quoted = f"'{WIKI_URL}' || url_encode(replace({title}, ' ', '_'))"
    return f"CASE {title} WHEN '.' THEN '{WIKI_URL}' WHEN '..' THEN 'https://en.wikipedia.org/' ELSE {quoted} END"
