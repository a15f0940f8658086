"""Literal pages with the results the rules imply, one page per surprising rule."""

import json

import pytest
from conftest import wiki

from pageloom import GENERIC, articles, image_rows, infobox_rows
from pageloom import session
from pageloom.functions.sql import literals
from pageloom.operators.marks import BIT
from pageloom.operators.nesting import live_nesting, nesting
from pageloom.operators.prune import Marks, _named, _parsed
from pageloom.profiles import WIKI
from pageloom.session import spread
from pageloom.plans.articles import page_counters


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


CONTENT = {
    "<p>a</p><p>b</p>": "a b",
    "<p>x <b>y</b>, z</p>": "x y , z",
    "bare<p>kept</p>bare": "kept",
    "<div>raw <i>x</i>y<p>p</p></div>": "raw xyp",
    "<h2>One <b>two</b>three</h2><p>t</p>": "## Onetwothree t",
    "<h2>x<span class='mw-headline'>Name</span>[edit]</h2>": "## Name",
    "<h2>Contents</h2><p>t</p>": "t",
    "<h6> </h6>": "",
    "<ul><li><b>a</b> <i>b</i></li></ul>": "* ab",
    "<ul><li> </li><li><br></li></ul>": "",
    "<ul>no<b>no</b><li class='noprint'>x</li><li>y</li></ul>": "* y",
    "<ul><li class='reference'>kept</li></ul><div><li class='reference'>gone</li></div>": "* kept",
    "<ol><li>a</li><li></li><li>c</li></ol>": "1. a 3. c",
    "<ol><li>a<ol><li>b</li></ol></li></ol>": "1. a 1. b",
    "<dl><dt>t</dt><dd>d <b>e</b></dd>x<div><dd>no</dd></div></dl>": "**t**: d e",
    "<table><tr><td>leaks</td></tr></table>": "leaks",
    "<div><table><tr><td>hidden</td></tr></table>t</div>": "t",
    "<p>a<span style='Display:None;display:none'>no</span></p>": "a",
    "<div>a<span style='display:none'>yes</span></div>": "ayes",
    "<p>a<br>b</p><div>c<br>d</div>": "a b c d",
    "<p>k<ruby>x<rt>no</rt></ruby></p><div><rt>yes</rt></div>": "k x yes",
    "<p>a<!-- no -->b</p>": "a b",
    "<p>&lt;b&gt; &amp;amp;&nbsp;x</p>": "<b> &amp; x",
    "<div class='mw-jump-link'>no</div><p class='Noprint'>case</p>": "case",
    "<p>open <p>nested": "open nested",
    "<div>foo<ul><li><br></li></ul>bar</div>": "foobar",
    "<div>foo<ol><li><br><ul><li> <br></li></ul></li></ol>bar</div>": "foobar",
    "<div>foo<ul><li>x<br>y</li></ul>bar</div>": "foo * x y bar",
    "<div>foo<?pi x?>baz</div>": "foopi x?baz",
    "<div>foo<!DOCTYPE html>baz</div>": "foohtmlbaz",
    "<div>foo<!bar>baz</div>": "foobaz",
    "<p>foo<?pi x?>baz</p><h3>a<?pi x?>b</h3><ul><li>c<?pi?></li></ul>": "foo baz ### ab * cpi?",
    "<figure class='image'><img src=x><figcaption>no</figcaption></figure><p>t</p>": "t",
}


def test_content(spark, pages):
    bodies = list(CONTENT)
    rows = {r.page_id: r.content for r in articles(pages(*map(wiki, bodies))).collect()}
    assert {bodies[i]: text for i, text in rows.items()} == CONTENT


SECTIONS = {
    "<p>a</p>": ["Content"],
    "": [],
    "<h2>A</h2><p>x</p><h2>B</h2>": ["A", "B"],
    "<p>lead</p><h2>A</h2><p>x</p>": ["Introduction", "A"],
    "<h3>a</h3><h2>A</h2>": ["Introduction", "A"],
    "<div><h2>Biography</h2></div><p>x</p>": ["Content"],
    "<h2>Notes</h2><p>x</p><h2>Contents</h2>": [],
    "<h2><span class='mw-headline'>A</span>[edit]</h2>": ["A"],
    "<h2> </h2><p>x</p>": ["Content"],
    "<h2>a</h2><p>1</p><h2>A b</h2>": ["a", "A b"],
}


def test_sections(spark, pages):
    bodies = list(SECTIONS)
    rows = {r.page_id: r.sections for r in articles(pages(*map(wiki, bodies))).collect()}
    assert {bodies[i]: names for i, names in rows.items()} == SECTIONS


TRAILING = {
    "<p>a</p><h2>See <h3>also</h3></h2><p>gone</p>": "a",
    "<p>a</p><h2>My <span class='mw-headline'>own <h3>page</h3></span></h2><p>stays</p>": "a ## ownpage stays",
    "<h2>A</h2><p>a</p><h2>References</h2><p>r</p>": "## A a",
    "<h2>Liner notes</h2><p>r</p><h3>s</h3><p>r</p><h2>B</h2><p>b</p>": "## B b",
    "<h3>See also</h3><p>r</p><h4>x</h4><h3>C</h3><h2>Data sources</h2><h1>T</h1><p>t</p>": "### C # T t",
    "<h2>Footnotes</h2><hr><header>h</header><h5>five</h5><p>r</p>": "",
    "<div><h2>Notes</h2></div><p>body stays</p>": "body stays",
    "<div><h2>Gallery</h2>bare text stays<p>not this</p></div>": "bare text stays",
    "<h2>see <i>also</i></h2><p>gone</p>": "",
    "<h2><span class='mw-headline'>Fine</span> references</h2><p>x</p>": "## Fine x",
    "<h5>References</h5><p>only the heading goes</p>": "only the heading goes",
    "<h2>Works</h2><h3>Bibliography</h3><p>b</p><h2>End</h2>": "## Works ## End",
}


def test_trailing_sections(spark, pages):
    bodies = list(TRAILING)
    rows = {r.page_id: r.content for r in articles(pages(*map(wiki, bodies))).collect()}
    assert {bodies[i]: text for i, text in rows.items()} == TRAILING


def test_title_and_url(spark, pages):
    got = one(articles(pages(wiki("<p>x</p>", "A <i>b</i>&amp;c"))))
    assert (got.input_title, got.title, got.url) == ("Given", "A b &c", "https://en.wikipedia.org/wiki/A_b_%26c")
    got = one(articles(pages(wiki("<p>x</p>", " "))))
    assert got.title == "Given"


def test_early_exits(spark, pages):
    rows = sorted(articles(pages("", None, "<p>no area</p>", '<div id="mw-content-text"><p>x</p></div>')).collect())
    assert [(r.content, r.sections, r.images, r.error_message) for r in rows] == [
        (None, None, None, "Failed to fetch HTML"),
        (None, None, None, "Failed to fetch HTML"),
        ("", [], [], None),
        ("x", ["Content"], None, None),
    ]


def test_area_is_the_first_that_survives(spark, pages):
    html = (
        '<div class="navbox"><div class="mw-parser-output"><p>no</p></div></div>'
        '<div id="mw-content-text"><p>outer</p></div><div class="mw-parser-output"><p>in</p></div>'
        '<div class="mw-parser-output"><p>second</p></div>'
    )
    assert one(articles(pages(html))).content == "in"


def box(body, **kept):
    return wiki(f'<table class="infobox">{body}</table><p>after</p>')


INFOBOX = {
    "<tr><th>K</th><td>v</td></tr>": {"K": "v"},
    "<tbody><tr><th>K</th><td>v</td></tr></tbody>": None,
    "<caption>c <b>d</b></caption>": {"_caption_": "c d"},
    "<caption> </caption>": {"_caption_": ""},
    "<tr><td>v</td><th>K</th><td>w</td></tr>": {"K": "v"},
    "<tr><th>K</th><td>a</td></tr><tr><th>L</th><td></td></tr><tr><th>K</th><td>b</td></tr>": {"K": "b", "L": ""},
    "<tr><th>K</th><td>a<sup class='reference'>1</sup><sup>2</sup><br>b</td></tr>": {"K": "a 2 b"},
    "<tr><th>K<sup class='reference'>1</sup></th><td>a</td></tr>": {"K 1": "a"},
    "<tr><th>K</th><td>x<ul><li>a<ul><li>b</li></ul></li><li> </li></ul></td></tr>": {"K": ["a b", "b"]},
    "<tr><th>K</th><td><ul><li> </li></ul></td></tr>": {"K": []},
    "<tr><th>K</th><td><sup class='reference'><li>x</li></sup>y</td></tr>": {"K": "y"},
    "<tr><th> </th><td>v</td></tr>": None,
    "<tr><td>n1<sup class='reference'>r</sup></td></tr><tr><th>K</th><td>v</td></tr><tr><td>n2</td></tr>": {
        "_infobox_notes_": ["n1 r", "n2"],
        "K": "v",
    },
    "<tr><td>n<img src=x></td></tr><tr><td> </td></tr><tr><td>a</td><td>b</td></tr>": None,
    "<tr><th>K</th><td><table><caption>in</caption><tr><th>no</th><td>q</td></tr></table></td></tr>": {
        "_caption_": "in",
        "K": "in no q",
    },
    "<tr><div><th>K</th><td>v</td></div></tr>": None,
    "<tr><th>Q</th><td>say \"x\"\\</td></tr>": {"Q": 'say "x"\\'},
    "": None,
}


def test_infobox(spark, pages):
    bodies = list(INFOBOX)
    rows = {r.page_id: r for r in articles(pages(*map(box, bodies)), keep_infobox=True).collect()}
    got = {bodies[i]: r.infobox_data and list(json.loads(r.infobox_data).items()) for i, r in rows.items()}
    assert got == {b: v and list(v.items()) for b, v in INFOBOX.items()}
    assert {r.content for r in rows.values()} == {"after"}


def test_only_the_first_infobox_is_taken(spark, pages):
    html = wiki(
        '<div class="infobox"><tr><th>D</th><td>div</td></tr></div>'
        '<table class="infobox"><tr><th>T</th><td>table</td></tr></table>'
        '<table class="infobox"><tr><td>leaks</td></tr></table><p>x</p>'
    )
    kept = one(articles(pages(html), keep_infobox=True))
    assert json.loads(kept.infobox_data) == {"T": "table"}
    assert one(articles(pages(html))).content == "x"


def test_infobox_rows(spark, pages):
    rows = infobox_rows(pages(box("<caption>c</caption><tr><th>K</th><td><li>a</li></td></tr>"))).collect()
    assert [tuple(r) for r in rows] == [(0, 0, "_caption_", False, ["c"]), (0, 1, "K", True, ["a"])]


IMAGES = {
    "<p><img src='//h/a.png' alt=' a  b '></p>": [("https://h/a.png", "a b", "")],
    "<img alt='no source'><img src=''>": [("", "", "")],
    "<div class='thumb'><img src=a><img src=b><div class='thumbcaption'>c <i>d</i></div></div>": [("a", "", "c d")],
    "<div class='thumb'><img alt=x><img src=b></div>": [],
    "<p><img src=loose></p><div class='floatleft'><img src=f></div><div class='thumb'><img src=t></div>": [
        ("t", "", ""),
        ("f", "", ""),
        ("loose", "", ""),
    ],
    "<div class='floatleft'><div class='thumb'><img src=in></div><img src=out></div>": [("in", "", ""), ("out", "", "")],
    "<div class='thumb'><div class='thumbimage'><img src=a></div><div class='thumb'><img src=b></div></div>": [("a", "", "")],
    "<div class='thumb'><img src=a><p class='x-caption'>p</p><div class='gallerytext'>g</div></div>": [("a", "", "g")],
    "<div class='thumb'><img src=a><p class='x-caption'>p</p></div>": [("a", "", "p")],
    "<figure class='image'><img src=gone></figure>": [],
    "<table><tr><td style='padding:1px'><a class='image'><img src=td></a></td><td><a class='image'><img src=td2></a></td></tr></table>": [
        ("td", "", ""),
        ("td2", "", ""),
    ],
    "<h2>Gallery</h2><img src=gone>": [],
    "<img class='thumb' src=self><img src=other>": [("other", "", "")],
}


def test_images(spark, pages):
    bodies = list(IMAGES)
    found = {b: [] for b in bodies}
    for r in image_rows(pages(*map(wiki, bodies))).orderBy("page_id", "ord").collect():
        found[bodies[r.page_id]].append((r.src, r.alt, r.caption))
    assert found == IMAGES


def test_containers_take_their_text(spark, pages):
    html = wiki("<div class='thumb'><img src=a>caption</div><div class='thumb'>text</div><p>x<img src=b>y</p>")
    kept = one(articles(pages(html), keep_images=True))
    assert (kept.content, [i.src for i in kept.images]) == ("x y", ["a", "b"])
    assert one(articles(pages(html))).content == "x y"


def test_counters(spark, pages):
    html = box("<tr><th>K</th><td>v</td></tr>").replace(
        "<p>after</p>", "<img src=a><h2>Notes</h2><h3>Sources</h3><h2>B</h2><h2>Gallery</h2>"
    )
    got = page_counters(pages(html, "")).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 3), (1, 0, 0, 0)]


def test_generic_profile(spark, pages):
    html = (
        "<html><head><title>x</title><script>var a='<p>';</script></head><body><nav>n</nav><article><h1>T</h1>"
        "<p>a<div class='ad'>ad</div><p>b</article><footer>f</footer></body></html>"
    )
    got = one(articles(pages(html), GENERIC))
    assert (got.title, got.content, got.sections) == ("T", "a b", ["Content"])


@pytest.mark.parametrize("kept", [{}, {"keep_images": True}, {"keep_infobox": True}])
def test_one_shuffle(spark, pages, kept):
    """The whole page job places pages once; windows and aggregates reuse the placing."""
    plan = articles(pages(wiki("<p>x</p>")), **kept)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Join" not in plan


def test_rules_act_before_the_shuffle(pages):
    """Removed subtrees, trailing sections and all outside of the area leave while a page is one row."""
    plan = articles(pages(wiki("<p>x</p>")))._jdf.queryExecution().executedPlan().toString()
    nodes = [line.lstrip(" :+-*()0123456789").split(" ")[0].split("(")[0] for line in plan.splitlines()]
    assert nodes.count("Window") <= 3 and nodes.count("Sort") <= 2
    below = plan[plan.index("Exchange") :]
    assert "tokens_left" in below and "tokens_left" not in plan[: plan.index("Exchange")]
    assert "Window" not in below and "Window" in plan


def test_a_small_input_is_dealt_over_the_cores(spark, tmp_path):
    frame = spark.range(40).selectExpr("id AS page_id", "'t' AS title", "'<p>x</p>' AS html").coalesce(1)
    frame.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert "RoundRobinPartitioning" in spread(stored)._jdf.queryExecution().executedPlan().toString()
    assert spread(stored, bytes_a_core=1) is stored


def test_an_input_of_few_splits_is_dealt_too(spark, monkeypatch):
    frame = spark.range(40).selectExpr("id AS page_id", "'t' AS title", "'<p>x</p>' AS html")
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "stored_bytes", lambda _: cores * (9 << 20))
    assert f"RoundRobinPartitioning({3 * cores})" in spread(frame)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(session, "stored_bytes", lambda _: cores * (129 << 20))
    assert spread(frame) is frame


def test_parts_of_pages_grow_with_the_tables(spark, tmp_path):
    """What one task holds after the shuffle stays bounded: more parts for more rows, and none put together again."""
    counts = []
    for rows in (60_000, 120_000):
        path = str(tmp_path / str(rows))
        spark.range(rows).selectExpr("id AS page_id", "sha2(CAST(id AS STRING), 256) AS title").write.parquet(path)
        frame = spark.read.parquet(path).selectExpr("page_id", "title", "concat('<p>', title, '</p>') AS html")
        plan = articles(frame)._jdf.queryExecution().executedPlan().toString()
        line = next(line for line in plan.splitlines() if "Exchange hashpartitioning(page_id" in line)
        assert "REPARTITION_BY_NUM" in line
        counts.append(int(line.split("), REPARTITION")[0].rsplit(" ", 1)[1]))
    assert counts[0] > 8 and 1.8 < counts[1] / counts[0] < 2.2


def test_image_owners_need_no_window(pages):
    """The scan tells the container of a node; the earliest rule wins, the outermost container among those of one rule."""
    html = wiki(
        '<div class="floatleft"><div class="thumb"><div class="thumb"><img src="a"><div class="thumbcaption">inner</div></div>'
        '<p class="caption">outer</p></div><img src="b"></div><table><tr><td style="padding:1px"><a class="image floatleft"><img src="c"></a>'
        '</td></tr></table><div class="navbox"><div class="thumb"><img src="dead"></div></div><img src="loose">'
    )
    found = image_rows(pages(html))
    nodes = [line.lstrip(" :+-*()0123456789").split(" ")[0] for line in found._jdf.queryExecution().executedPlan().toString().splitlines()]
    assert "Window" not in nodes
    assert [(r.src, r.caption) for r in found.orderBy("ord").collect()] == [("a", "inner"), ("b", ""), ("c", ""), ("loose", "")]


def test_tags_that_no_rule_picks_are_not_parsed(spark):
    telling = f"coalesce(g IN ({literals(Marks(WIKI, keep_images=True, keep_infobox=True).bare_tags())}), false)"
    tokens = {"<p>": "p", "<br/>": "br", "<a href=x>": "a", "<sup>": "sup", "<b class=x>": "b", "<aside>": "aside", "<ASIDE id=x>": "aside"}
    rows = spark.createDataFrame([*tokens.items()], "t string, g string")
    read = rows.selectExpr("t", f"{_parsed('t', 'g', telling)} IS NOT NULL AS read").filter("read")
    assert sorted(r.t for r in read.collect()) == ["<ASIDE id=x>", "<b class=x>", "<sup>"]


def test_rules_look_at_each_different_tag_once(pages):
    plan = articles(pages(wiki("<p>x</p>")))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "array_distinct(" in below and "zip_with(vocabulary" in below and "zip_with(tokens" not in below


def test_a_lone_attribute_is_cut_out_with_the_same_result(spark):
    """A blank before the bracket sends a tag the general way."""
    lone = ['<div class="a">', '<div class=" a  b\tc">', '<p class="">', '<a id="x>y">', '<a id="">', '<b style="class: \'id\'">', '<link rel="a=b">']
    other = ['<style class="x">', '<id id="x">', "<p class='a'>", "<p CLASS=\"a\">", '<p class="a" id="b">', '<p class = "a">', '<p title="class">']
    tokens = [(t, t[1:].split(" ")[0]) for t in lone + other]
    rows = spark.createDataFrame([(t, g, t[:-1] + " >") for t, g in tokens], "t string, g string, wide string")
    read = rows.selectExpr("t", f"{_parsed('t', 'g', 'true')} AS p", f"{_parsed('wide', 'g', 'true')} AS q").selectExpr(
        "t", "p.name IS NOT NULL AS cut", "q.name IS NOT NULL AS other_cut", f"{_named('p')} AS n", f"{_named('q')} AS m"
    )
    found = {r.t: r for r in read.collect()}
    assert all((r.n, r.other_cut) == (r.m, False) for r in found.values())
    assert sorted(t for t, r in found.items() if r.cut) == sorted(lone)
    assert found[lone[1]].n.cls == ["a", "b", "c"] and found[lone[2]].n.cls == [] and found[lone[4]].n.id is None


def test_the_scan_returns_live_tokens_alone(spark):
    """End tags and what lies below removed elements stay out, and what is left is as in the scan of the whole page."""
    ops = ["", "<div", "", "<nav", "<b", "", "</b", "</nav", "<ul", "<li", "", "</ul", "<h2", "<i", "", "</i", "</h2", "", "<br", "</div", ""]
    own = [BIT["boilerplate"] if op == "<nav" else 0 for op in ops]
    words = [op and f"{op}>" for op in ops]
    vocabulary = list(dict.fromkeys(filter(None, words)))
    pages = [(ops, own, words, vocabulary), ([], [], [], []), ([""], [0], [""], [])]
    frame = spark.createDataFrame(pages, "ops array<string>, own array<bigint>, words array<string>, vocabulary array<string>").coalesce(1)
    frame = frame.selectExpr("*", "transform(vocabulary, v -> substring(v, 1, length(v) - 1)) AS codes")
    frame = frame.selectExpr("*", f"transform(codes, c -> IF(c = '<nav', {BIT['boilerplate']}L, 0L)) AS marks")
    rows = frame.select(
        "ops", "vocabulary", nesting()("ops", "own").alias("all"), live_nesting()("words", "vocabulary", "codes", "marks").alias("left")
    ).collect()
    for r in rows:
        kept = [i for i, op in enumerate(r.ops) if not op.startswith("</") and not r.all["mask"][i] & BIT["boilerplate"]]
        assert r.left["place"] == kept
        for name in ("parent", "last", "mask", "unit", "owner"):
            assert r.left[name] == [r.all[name][i] for i in kept]
        assert [w if w < 0 else r.vocabulary[w][:-1] for w in r.left["word"]] == [r.ops[i] or -1 for i in kept]
        assert [-1 if w < 0 else r.vocabulary[w][:-1] for w in r.left["around"]] == [r.ops[p] if p >= 0 else -1 for p in r.left["parent"]]
        assert [kept[h] for h in r.left["head"]] == r.all["head"] and [kept[h] for h in r.left["inner"]] == [14] * len(r.all["head"])
        assert [max(k for k in range(len(kept)) if kept[k] <= u) for u in r.all["until"]] == r.left["until"]
    assert rows[0].left["place"] == [0, 1, 2, 8, 9, 10, 12, 13, 14, 17, 18, 20] and rows[2].left["place"] == [0]


def test_nested_areas_and_walls(pages):
    """What stands around the area has no say in it; the best area wins wherever it is."""
    inner = '<div class="mw-parser-output"><p>in <b>bold</b></p><ul><li>one</li></ul>{}</div>'
    around = '<table><tr><td><p><div id="mw-content-text">{}</div></p></td></tr></table>'
    htmls = (
        around.format(inner.format("")),
        around.format("<p>outer</p>" + inner.format("") + "<p>tail</p>"),
        '<div id="mw-content-text"><h2>See also</h2>' + inner.format("") + "<h2>Kept</h2><p>left</p></div>",
        '<div class="navbox">' + inner.format("") + '</div><div id="mw-content-text"><p>alive</p></div>',
        inner.format('<h2>Notes</h2>bare<p>gone</p><div><h3>x</h3></div><h3>also gone</h3><h2>Back</h2><p>here</p>'),
        inner.format('<div><h3>Notes</h3><p>gone</p>&nbsp;<p>too</p></div><p>after</p>'),
        inner.format('<dl><dt>t<sup>1</sup></dt>loose<dd>d <p>p</p></dd></dl><h2>Sources <span class="mw-headline">Real</span></h2><p>stays</p>'),
    )
    rows = sorted(articles(pages(*htmls)).collect())
    assert [r.content for r in rows] == [
        "in bold * one",
        "in bold * one",
        "## Kept left",
        "alive",
        "in bold * one ## Back here",
        "in bold * one after",
        "in bold * one **t 1**: d p ## Real stays",
    ]
