"""What a row or a token costs: nothing is worked out twice, and nothing anew for tokens alike."""

from __future__ import annotations

import pyarrow as pa

from pageloom.functions.sql import choose
from pageloom.operators import nesting
from pageloom.operators.nodes import blank_sql, kind_sql, op_sql
from pageloom.plans.articles import articles, image_rows, infobox_rows, section_rows


def _page(spark, html):
    return spark.createDataFrame([(0, "t", html)], "page_id long, title string, html string")


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_choose_says_what_a_case_says(spark):
    rows = spark.createDataFrame([(True, True), (False, True), (None, True), (None, None), (False, False)], "a boolean, b boolean")
    case = "CASE WHEN a THEN 1 WHEN b THEN 2 ELSE 3 END"
    chosen = rows.selectExpr(f"{case} AS x", f"{choose('a', '1', 'b', '2', '3')} AS y", f"{choose('a', '1', 'b', '2')} AS z").collect()
    assert [r.x for r in chosen] == [r.y for r in chosen] == [1, 2, 2, 3, 3]
    assert [r.z for r in chosen] == [1, 2, 2, None, None]


def test_tokens_pay_for_no_case():
    assert not any("CASE" in text for text in (kind_sql("t"), op_sql("t", "g"), blank_sql("t")))


def test_lists_are_worked_out_once(spark):
    html = '<h1 id="firstHeading">T</h1><div class="mw-parser-output"><table class="infobox"><tr><th>K</th><td>v</td></tr></table><h2>A</h2><img src="a"></div>'
    page = _page(spark, html).unionAll(_page(spark, None))
    for rows, found in ((infobox_rows, 1), (image_rows, 1), (section_rows, 1)):
        frame = rows(page)
        assert "Filter (size(" not in _plan(frame)
        assert [r.ord for r in frame.collect()] == [0] * found


def test_what_is_collected_is_a_column_before(spark):
    page = _page(spark, "<p>x</p>")
    for frame in (infobox_rows(page), image_rows(page), articles(page, keep_images=True, keep_infobox=True)):
        assert "collect_list(CASE" not in _plan(frame) and "collect_list(" in _plan(frame)


def test_tokens_alike_are_looked_up(monkeypatch):
    """What a token does below an element is worked out once for each different pair."""
    calls, step = [], nesting._Steps.step
    monkeypatch.setattr(nesting._Steps, "step", lambda *given: calls.append(given) or step(*given))
    ops = ["<ul", *["<li", "", "<b", "", "</b", "</li"] * 500, "</ul"]
    lists = pa.array([ops, ops], pa.list_(pa.string()))
    found = nesting.nesting().func(lists, pa.array([[], []], pa.list_(pa.int64())))
    assert len(calls) == 3
    assert found.field("parent").to_pylist() == [[-1, *[at for k in range(500) for at in (0, 6 * k + 1, 6 * k + 1, 6 * k + 3, 6 * k + 3, 6 * k + 1)], 0]] * 2


def test_a_unit_of_text_is_one_row_before_the_shuffle(spark):
    """Strings meet in their unit while the page is a row; only pages are gathered after the shuffle."""
    html = (
        '<div class="mw-parser-output"><p>a <h1 id="firstHeading">T <b>U</b></h1><i>b</i></p><dl>x<dt>k <i>l</i></dt>y<dd>v</dd></dl>'
        "<h2>one<span class='mw-headline'>N <i>M</i></span></h2><ul><li>s<br>t</li></ul>u</div>"
    )
    frame = articles(_page(spark, html))
    assert _plan(frame).count("ObjectHashAggregate") == 2
    row = frame.collect()[0]
    assert (row.title, row.content, row.sections) == ("T U", "a b **k l**: v ## NM * s t", ["Introduction", "NM"])
