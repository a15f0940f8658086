"""Encyclopedia pages assembled from the given tables, one page per row, whole texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.catalog.registry import table
from pageloom.profiles import WIKI


def esc(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def cat(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def wrap(title: Column, *body: Column | str) -> Column:
    return cat(
        '<!DOCTYPE html><html><head><title>x</title></head><body><h1 id="firstHeading">', esc(title),
        '</h1><div id="mw-content-text"><div class="mw-parser-output">', *body, "</div></div></body></html>",
    )


def each_line(text: Column, make) -> Column:
    """Concatenate make(line, index) over the lines of a text."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, i: make(esc(line), i.cast("string"))), "")


def part_name(part: str = "p_partkey") -> Column:
    return cat("Part ", F.col(part).cast("string"))


def infobox_pages(spark: SparkSession, folder: str, *, body_tag: bool = False) -> DataFrame:
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    rows = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    open_body, close_body = ("<tbody>", "</tbody>") if body_tag else ("", "")
    body = (
        '<table class="infobox vcard"><caption>', F.col("c_name"), "</caption>", open_body,
        "<tr><th>Segment</th><td>", F.col("c_mktsegment"), '<sup class="reference">[1]</sup></td></tr>',
        '<tr><th>Nation</th><td><a href="#">', F.col("n_name"), "</a><br>",
        F.col("n_nationkey").cast("string"), "</td></tr>",
        "<tr><th> </th><td>no key</td></tr><tr><th>Balance</th><td></td></tr>",
        "<tr><th>Segment</th><td>", F.lower("c_mktsegment"), "</td></tr>",
        "<tr><td>Note of ", F.col("c_name"), "</td></tr>",
        '<tr><td><img src="x.png">pictured</td></tr><tr><td>two</td><td>cells</td></tr>',
        "<tr><th>Only a head</th></tr>", close_body, "</table><p>After ", F.col("c_name"), "</p>",
    )
    return rows.select(F.col("c_custkey").alias("page_id"), F.col("c_name").alias("title"), wrap(F.col("c_name"), *body).alias("html"))


def infobox_list_pages(spark: SparkSession, folder: str) -> DataFrame:
    items = each_line(F.col("text"), lambda line, i: cat("<li>", line, "<ul><li>n", i, "</li><li> </li></ul></li>"))
    body = ('<div class="infobox"><tr><th>Lines</th><td>All<ul>', items, "</ul></td></tr></div>")
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("page_id"), F.lit("t").alias("title"), wrap(F.lit("List"), *body).alias("html")
    )


def image_pages(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    body = (
        '<div class="thumb tright"><div class="thumbinner"><a class="image"><img src="//img.example/', key,
        '.png?a=1&amp;b=2" alt=" ', F.col("p_name"), '  pic "></a><div class="thumbcaption">Cap <i>', F.col("p_brand"),
        '</i><span class="mw-editsection">edit</span></div></div></div>',
        '<p>Text <img src="/loose/', key, '.png" alt="l&amp;m"></p>',
        '<figure class="image"><img src="lost.png"></figure>',
        '<div class="floatright"><img alt="no source"><img src="second.png"></div>',
        '<ul><li class="gallerybox"><img src="http://g/', key, '"><p class="my-caption">', F.col("p_type"), "</p></li></ul>",
        '<table><tr><td style="padding:1px"><a class="image" href="#"><img src="td.png"></a></td></tr></table>',
        '<h2>Gallery</h2><div class="thumb"><img src="trailing.png"></div>',
    )
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("page_id"), F.col("p_name").alias("title"), wrap(part_name(), *body).alias("html")
    )


def section_pages(spark: SparkSession, folder: str) -> DataFrame:
    parts = each_line(
        F.col("text"),
        lambda line, i: cat(
            '<h2><span class="mw-headline">Part ', i, '</span><span class="mw-editsection">[edit]</span></h2><p>', line, "</p>"
        ),
    )
    body = (
        F.when(F.col("lang") == "en", "<p>Lead</p>").otherwise(""), parts,
        "<h2>See also</h2><p>S</p><h3>Sub</h3><p>T</p>bare<h2>Data sources</h2><ul><li>U</li></ul>",
        '<div><h2>Inner</h2></div><h1>Top</h1><p>Kept</p><h3>Liner notes</h3><p>V</p><h4>W</h4><h2>End</h2>',
        "<div><h2>References</h2></div><p>stays</p>",
    )
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("page_id"), F.lit("t").alias("title"), wrap(F.lit("Sections"), *body).alias("html")
    )


def wrapped_heading_pages(spark: SparkSession, folder: str) -> DataFrame:
    body = ('<div class="mw-heading"><h2>Biography</h2></div><p>', esc(F.col("text")), "</p>")
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("page_id"), F.lit("t").alias("title"), wrap(F.lit("Wrapped"), *body).alias("html")
    )


def ordered_list_pages(spark: SparkSession, folder: str) -> DataFrame:
    items = each_line(F.col("text"), lambda line, i: cat("<li>", line, "</li><li> <b></b></li>"))
    body = ("<ol>stray", items, "<p>not an item</p></ol>")
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("page_id"), F.lit("t").alias("title"), wrap(F.lit("Lists"), *body).alias("html")
    )


def bullet_list_pages(spark: SparkSession, folder: str) -> DataFrame:
    items = each_line(
        F.col("text"), lambda line, i: cat("<li>", line, "<ol><li>n", i, "</li></ol></li><li><br></li>")
    )
    body = ("<div><ul>", items, "</ul><ul><li> </li></ul></div>")
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("page_id"), F.lit("t").alias("title"), wrap(F.lit("Lists"), *body).alias("html")
    )


def definition_pages(spark: SparkSession, folder: str) -> DataFrame:
    supplier, nation = table(spark, folder, "supplier"), table(spark, folder, "nation")
    rows = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    body = (
        "<dl><dt>", F.col("s_name"), "</dt><dd>in <b>", F.col("n_name"), "</b></dd><dd> </dd>stray<div><dd>deep</dd></div>",
        "<dd>key<dl><dt>", F.col("s_suppkey").cast("string"), "</dt></dl></dd></dl>",
    )
    return rows.select(F.col("s_suppkey").alias("page_id"), F.col("s_name").alias("title"), wrap(F.col("s_name"), *body).alias("html"))


def heading_pages(spark: SparkSession, folder: str) -> DataFrame:
    name, brand = F.col("p_name"), F.col("p_brand")
    body = (
        "<h5>", name, " <b>x</b>y</h5><div><h6>Contents</h6><h6> </h6></div><h3>a<span class='mw-headline'>", brand,
        "</span>z</h3><h4>", F.col("p_type"), "</h4><p> </p>",
    )
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("page_id"), name.alias("title"), wrap(F.lit("Heads"), *body).alias("html")
    )


def inline_pages(spark: SparkSession, folder: str) -> DataFrame:
    body = (
        "<p>", esc(F.col("text")),
        ' <b>B</b>,<span style="color:red; DISPLAY:NONE; display:none">no</span><sup class="reference">[1]</sup><br>end',
        "<ruby>k<rt>r</rt></ruby></p><!-- gone -->",
        "<ul><li><b>a</b> <i>b</i><sup>no</sup><span class='noprint'>np</span><table><tr><td>no</td></tr></table>",
        "<span style='display:none'>shown</span> tail<br>next</li></ul>",
    )
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("page_id"), F.lit("t").alias("title"), wrap(F.lit("Inline"), *body).alias("html")
    )


def _noise_element(selector: str) -> str:
    """An element the selector picks, holding the word NOISE."""
    if " > " in selector:
        return '<table><tr><td style="padding:2px"><a class="image">NOISE</a></td></tr></table>'
    tag = re.match(r"[a-z0-9]*", selector)[0] or "span"
    classes = " ".join(re.findall(r"\.([\w-]+)", selector))
    element_id = "".join(re.findall(r"#([\w-]+)", selector))
    attribute = re.search(r"\[([a-z]+)\*?=['\"](.*)['\"]\]", selector)
    extra = f' {attribute[1]}="{attribute[2]}"' if attribute else ""
    named = (f' class="{classes}"' if classes else "") + (f' id="{element_id}"' if element_id else "")
    inside = "" if tag in ("img", "link") else f"NOISE <b>NOISE</b></{tag}>"
    return f"<{tag}{named}{extra}>{inside}"


NOISE = {
    "preprocess": "".join(map(_noise_element, WIKI.preprocess)),
    "boilerplate": "".join(_noise_element(s) for s in WIKI.boilerplate if s.isascii()),
    "infobox": "".join(map(_noise_element, WIKI.infobox)),
    "images": "".join(map(_noise_element, WIKI.image_drop)),
}


def noise_pages(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    body = ("<p>", esc(F.col("text")), "</p><div>", NOISE[kind], "<!-- NOISE --></div>")
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("page_id"), F.lit("t").alias("title"), wrap(F.lit("Noise"), *body).alias("html")
    )


def bare_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages without a content area, and pages that were never fetched."""
    html = F.when(F.col("lang") == "fr", "").when(F.col("lang") == "de", None)
    html = html.otherwise(cat("<html><body><h1>t</h1><p>", esc(F.col("text")), "</p></body></html>"))
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("page_id"), cat("Doc ", F.col("doc_id").cast("string")).alias("title"), html.alias("html")
    )
