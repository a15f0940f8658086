"""Registered queries, each over whole tables, with the SQL that must agree with it."""

from pageloom.catalog import extraction, raw_pages, titles  # noqa: F401
from pageloom.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
