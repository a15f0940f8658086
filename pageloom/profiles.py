"""What to keep and what to drop for one family of pages.

The lists are fixed values: results depend on their exact content and, for image
containers, on their order.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    """Rules for one site family; see `functions.selectors` for the forms of selectors."""

    title: str
    areas: tuple[str, ...]
    preprocess: tuple[str, ...] = ()
    boilerplate: tuple[str, ...] = ()
    infobox: tuple[str, ...] = ()
    trailing_keywords: tuple[str, ...] = ()
    excluded_headings: tuple[str, ...] = ()
    image_drop: tuple[str, ...] = ()
    image_containers: tuple[str, ...] = ()
    skip_tags: tuple[str, ...] = field(default=("table", "figure", "img", "sup", "style", "script"))
    skip_classes: tuple[str, ...] = field(default=("reference", "noprint", "mw-editsection"))


WIKI = Profile(
    title="h1#firstHeading",
    areas=("div.mw-parser-output", "div#mw-content-text"),
    preprocess=(
        "script", "style", "noscript", "link[rel='stylesheet']", ".mw-empty-elt", "span.Z3988",
        ".sr-only", ".visually-hidden", ".screen-reader-text", "span#coordinates", "div#coordinates",
        ".geo-default", ".geo-multi-punct", ".geo", "div.vector-body-before-content", "div#siteNotice",
        "div#centralNotice", "div.mw-indicators",
    ),
    boilerplate=(
        "div.navbox", "table.navbox", "div.vertical-navbox", "table.vertical-navbox", "table.ambox",
        "table.tmbox", "table.fmbox", "div.ombox", "table.commons-caption", "div.metadata",
        "table.metadata", "div#siteSub", "div#jump-to-nav", "div.printfooter", "div.catlinks",
        "div#p-search", "div#p-lang-btn", "div#p-namespaces", "div#p-personal", "div#p-views",
        "div#p-navigation", "div#p-interaction", "div#p-tb", "div#p-coll-print_export", "div#footer",
        "span.mw-editsection", "sup.reference", "sup.noprint", ".noprint",
        ".citation-needed-content", "figure", "gallery", "ul.gallery", "table.gallery",
        "table.wikitable.sidebar", "div.thumbcaption[style*='display:none']", "div.hatnote",
        "div.rellink", "div.Dablink", "table.fmbox-system", "div.authority-control",
        "div.shortdescription", "div#toc", "table#toc", ".toc", "div.reflist", "ol.references",
        "ul.plainlinks", ".portalbox", ".sisterproject", "div.mw-references-wrap",
        "span.mwe-math-fallback-image-inline", 'div[class*="mw-jump"]',
    ),
    infobox=("table.infobox", "div.infobox"),
    trailing_keywords=(
        "references", "external links", "see also", "notes", "bibliography", "further reading",
        "sources", "citations", "gallery",
    ),
    excluded_headings=(
        "references", "external links", "see also", "notes", "contents", "bibliography",
        "further reading", "gallery",
    ),
    image_drop=(
        "img", "div.thumb", "figure.image", "a.image", "div.PopUpMediaTransform", "div.thumbinner",
        "div.thumbimage", "div.floatnone", "div.floatright", "div.floatleft", "div.gallerybox",
        'td[style*="padding"] > a.image', "figcaption", "div.thumbcaption", "div.gallerytext",
        "div.mw-caption-text",
    ),
    image_containers=(
        "figure.image", ".thumb", "div.thumbimage", "div.image", "div.floatnone", "div.floatright",
        "div.floatleft", ".gallerybox", 'td[style*="padding"] > a.image',
    ),
)

GENERIC = Profile(
    title="h1",
    areas=("article",),
    preprocess=("script", "style"),
    boilerplate=("nav", "footer", "div.ad"),
)
