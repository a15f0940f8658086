"""Page extraction on Spark: tables of raw HTML pages in, clean article tables out."""

from pageloom.plans.articles import articles, image_rows, infobox_rows, section_rows
from pageloom.profiles import GENERIC, WIKI, Profile

__all__ = [
    "GENERIC",
    "WIKI",
    "Profile",
    "articles",
    "image_rows",
    "infobox_rows",
    "section_rows",
]
