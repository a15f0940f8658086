import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pageloom.functions.selectors import matching_sql, rank_sql, rule_sql
from pageloom.operators.nesting import VOID_TAGS
from pageloom.operators.nodes import kind_sql, nodes, subtree_text, tokenize

ODD = [
    "a<3 &amp; <<b>x</b>",
    '<p title="a>b" class=\'x "y"\'>t</p>',
    "<script>if (a<b) '</p>'</script >tail",
    "<style>p{}</style><STYLE>q</STYLE>",
    "<script src=x/>not swallowed<p>",
    "<!-- a -- > b --><!DOCTYPE x><?php y?></ bogus></>",
    "<![CDATA[raw <b>]]>after",
    "<a href=x/>link</a><br/><p/>after<div",
    "",
]


def test_tokens_are_lossless(spark, pages):
    long_tag = "<p " + "x='<>' " * 20_000 + ">t</p>"
    htmls = [*ODD, long_tag, "<" * 3000, "<!--" * 500]
    rows = pages(*htmls).select("page_id", F.array_join(tokenize(F.col("html")), "").alias("again")).collect()
    assert [r.again for r in sorted(rows)] == htmls


def test_kinds(spark, pages):
    frame = pages("<p>x</p><!--c--><!d><script>s</script><br/>a < b<![CDATA[d]]></ e><?php?><")
    tokens = frame.select(F.posexplode(tokenize(F.col("html"))).alias("i", "t")).selectExpr("i", f"{kind_sql('t')} AS k")
    kinds = [r.k for r in tokens.orderBy("i").collect()]
    expected = "element text end comment decl raw element text cdata decl decl text"
    assert kinds == expected.split()


def test_attributes(spark, pages):
    html = (
        '<div ID=one CLASS="a  b\n c" style=\'x:"1"\' data-class="no"></div>'
        '<img alt="class=z &amp; more" src=//h/x.png><img src alt=\'\'><p class="1" class="2"><i title="id=q">'
    )
    found = nodes(pages(html)).filter("tag IS NOT NULL").orderBy("pos").collect()
    div, img, bare, p, i = found
    assert (div.id, div.cls, div.style) == ("one", ["a", "b", "c"], 'x:"1"')
    assert (img.alt, img.src, img.cls) == ("class=z & more", "//h/x.png", None)
    assert (bare.src, bare.alt) == ("", "")
    assert p.cls == ["2"]
    assert i.id is None


class Tree(HTMLParser):
    """Tree by the standard library's events: an end tag closes the nearest open element of its name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open = [], []

    def _push(self, tag):
        self.rows.append((tag, self.open[-1] if self.open else None))
        return len(self.rows) - 1

    def handle_starttag(self, tag, attrs):
        index = self._push(tag)
        if tag not in VOID_TAGS:
            self.open.append(index)

    def handle_startendtag(self, tag, attrs):
        self._push(tag)

    def handle_endtag(self, tag):
        names = [self.rows[i][0] for i in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        if data.strip():
            self._push("#" + data.strip())


def random_html(rng):
    pieces = []
    for _ in range(rng.randint(1, 60)):
        tag = rng.choice(["p", "b", "div", "li", "h2", "br", "img", "ul"])
        pieces.append(
            rng.choice([f"<{tag}>", f"<{tag} class='infobox'>", f"</{tag}>", f"</{tag}>", f"<{tag}/>", f"w{rng.randint(0, 99)}", " "])
        )
    return "".join(pieces)


def test_nesting_on_random_tag_soup(spark, pages):
    rng = random.Random(5)
    htmls = [random_html(rng) for _ in range(400)]
    got = {}
    for r in nodes(pages(*htmls)).filter("kind IN ('element', 'text')").orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r)
    for page_id, html in enumerate(htmls):
        parser = Tree()
        # Text pieces around ignored end tags stay apart here, so compare elements only.
        parser.feed(html)
        expected = []
        for tag, parent in parser.rows:
            if not tag.startswith("#"):
                chain = parent
                expected.append((tag, parser.rows[chain][0] if chain is not None else None))
        rows = [r for r in got.get(page_id, []) if r.kind == "element"]
        assert [(r.tag, r.ptag) for r in rows] == expected, html
        by_pos = {r.pos: r for r in got.get(page_id, [])}
        for r in got.get(page_id, []):
            assert r.last >= r.pos
            if r.parent >= 0:
                above = by_pos[r.parent]
                assert above.pos < r.pos <= r.last <= above.last
            inside = [a.pos for a in got[page_id] if a.pos < r.pos <= a.last]
            assert (max(inside) if inside else -1) == r.parent


def test_subtree_text(spark, pages):
    frame = nodes(pages("<div><p>a <b>b</b></p> c</div><div>d</div>", "<p>x</p>"))
    rows = {r.page_id: r.text for r in subtree_text(frame, "div", "|").collect()}
    assert rows == {0: "a|b|c", 1: None}


def test_page_without_tokens_keeps_a_row(spark, pages):
    rows = nodes(pages("", None)).collect()
    assert [(r.page_id, r.kind, r.fetched) for r in sorted(rows)] == [(0, None, False), (1, None, False)]


def test_rules(spark, pages):
    html = (
        "<p id='k' class='x y'></p><div class='x'></div><a class='image' href='1'></a>"
        "<td style='a:1;padding:2px'><a class='image'></a><b><a class=image></a></b></td><link rel='stylesheet'>"
    )
    rules = ["p.x.y", "p#k", ".x", 'td[style*="padding"] > a.image', "link[rel='stylesheet']", "div"]
    frame = nodes(pages(html)).filter("tag IS NOT NULL").orderBy("pos")
    rows = frame.selectExpr("tag", f"{matching_sql(rules)} AS hits", f"{rank_sql(rules)} AS rank", f"{rule_sql(rules)} AS hit").collect()
    assert [(r.tag, r.hits) for r in rows] == [
        ("p", [0, 1, 2]), ("div", [2, 5]), ("a", []), ("td", []), ("a", [3]), ("b", []), ("a", []), ("link", [4]),
    ]
    assert [r["rank"] for r in rows] == [0, 2, None, None, 3, None, None, 4]
    assert [r.hit for r in rows] == [bool(r.hits) for r in rows]


def test_unknown_rule_is_skipped_with_a_warning():
    with pytest.warns(UserWarning, match="not supported"):
        assert rule_sql(["p:first-child"]) == "false"


def test_dead_tokens_go_before_the_shuffle(pages):
    plan = nodes(pages("<p>x</p>"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "filter(arrays_zip(" in plan[plan.index("Exchange") :] and "filter(arrays_zip(" not in plan[: plan.index("Exchange")]
    rows = nodes(pages("<!-- c --><script>var x = 1</script> <p>a</p>\n")).orderBy("pos").collect()
    assert [(r.pos, r.kind, r.tag) for r in rows] == [(0, "comment", None), (1, "raw", "script"), (3, "element", "p"), (4, "text", None)]
