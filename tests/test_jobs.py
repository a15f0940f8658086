"""Titles, lookup, templates, writers, pacing and the micro-batch job."""

import hashlib
import json
import random
import warnings

import pytest
from conftest import wiki
from pyspark.sql import functions as F

from pageloom import Profile, articles
from pageloom.functions.text import page_url
from pageloom.operators import outcome, pacing
from pageloom.operators.pacing import pace_requests
from pageloom.plans.harvest import harvest
from pageloom.plans.run import run
from pageloom.plans.template import article_json, check_template, default_template, shape
from pageloom.sinks import writers
from pageloom.sources import titles as T
from pageloom.sources.pages import read_html_files, read_pages
from pageloom.sources.templates import load_template
from pageloom.streaming import seen
from pageloom.streaming.harvest import PAGE_SCHEMA, bucket, latest_articles, stream_articles, written_before


def listed(spark, *names):
    return spark.createDataFrame(list(enumerate(names)), "ord bigint, title string")


def test_titles_from_a_file(spark, tmp_path):
    file = tmp_path / "titles.txt"
    file.write_text("Python (programming language)\n\n  Web scraping 　\nÉté\nWeb scraping\n", encoding="utf-8")
    rows = T.read_titles(spark, str(file)).orderBy("ord").collect()
    assert [tuple(r) for r in rows] == [
        (0, "Python (programming language)"), (1, "Web scraping"), (2, "Été"), (3, "Web scraping"),
    ]
    assert T.require_titles(T.read_titles(spark, str(file))).count() == 4


def test_title_file_read_in_several_splits(spark, tmp_path):
    names = [f"title {i}" for i in range(5000)]
    (tmp_path / "t.txt").write_text("\n\n".join(names))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        frame = T.read_titles(spark, str(tmp_path / "t.txt"))
        rows = frame.orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in rows] == list(enumerate(names))


def test_title_file_is_read_once(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\nb\n")
    frame = T.read_titles(spark, str(tmp_path / "t.txt"))
    assert [tuple(r) for r in frame.orderBy("ord").collect()] == [(0, "a"), (1, "b")]
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert final.count("FileScan text") == 1 and "ReusedExchange" in final


def test_empty_title_list_is_an_error(spark, tmp_path):
    (tmp_path / "t.txt").write_text("\n  \n")
    with pytest.raises(ValueError, match="empty"):
        T.require_titles(T.read_titles(spark, str(tmp_path / "t.txt")))


def test_titles_override_the_number(spark):
    with pytest.warns(UserWarning, match="ignored"):
        assert T.requested_count(listed(spark, "a", "b", "a"), 10).first().n_pages == 3
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert T.requested_count(listed(spark, "a", "b", "a"), 3).first().n_pages == 3
    lines = spark.createDataFrame([(1, "a\rb\r\nc\n\n d")], "k int, text string")
    assert [(r.ord, r.title) for r in T.lines_as_titles(lines, "k", "text").collect()] == [(0, "a"), (1, "b"), (2, "c"), (4, "d")]
    assert T.requested_count(None, 7) == 7
    with pytest.raises(ValueError):
        T.requested_count(None, None)


def test_draws_and_limits(spark):
    names = ["a", "b", "a", "Talk:a", "user_talk: x", "Re: b", "c", "TimedText:x.en.srt", "Image:Foo", "WP:About"]
    titles = listed(spark, *names)
    numbered = titles.withColumn("namespace", F.col("ord") % 2)
    assert [r.ord for r in T.main_namespace(numbered).collect()] == [0, 2, 4, 6, 8]
    drawn = {r.title for r in T.random_titles(titles, 10, "s").collect()}
    assert drawn == {"a", "b", "c", "Re: b"}
    assert [r.title for r in T.random_titles(titles, 2, "s").collect()] == [
        r.title for r in T.random_titles(titles.orderBy(F.desc("ord")), 2, "s").collect()
    ]
    assert T.random_titles(titles, 0, "s").count() == T.first_titles(titles, -1).count() == 0
    assert {tuple(r) for r in T.keep_first(titles).select("title", "ord").collect()} >= {("a", 0), ("c", 6)}
    assert [r.title for r in T.first_titles(titles, 3).collect()] == ["a", "b", "a"]


def test_draws_are_bottom_n_sketches(spark):
    titles = spark.range(5000).selectExpr("concat('t', id % 700) AS title").repartition(6)
    drawn = T.random_titles(titles, 25, "s")
    rows = drawn.collect()
    assert [r.ord for r in sorted(rows)] == list(range(25))
    wanted = sorted((hashlib.md5(f"st{i}".encode()).hexdigest(), f"t{i}") for i in range(700))[:25]
    assert [(r.rank_key, r.title) for r in sorted(rows)] == wanted
    keyed = titles.selectExpr("md5(concat('s', title)) AS rank_key", "title")
    sketches = keyed.mapInArrow(T._least(25), "rank_key string, title string")
    counts = sketches.groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) == 6 and all(r["count"] == 25 for r in counts)
    assert T.random_titles(titles, 9999, "s").count() == 700


def test_page_sources(spark, tmp_path):
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "a.html").write_text("<p>\nx</p>")
    (tmp_path / "html" / "B_c%2Bd.HTM").write_text(wiki("<p>b</p>", ""))
    files = read_html_files(spark, str(tmp_path / "html"))
    assert {(r.title, r.html[:3]) for r in files.collect()} == {("a", "<p>"), ("B c%2Bd", "<ht")}
    assert sorted((r.title, r.content) for r in articles(files).collect()) == [("B c%2Bd", "b"), ("a", "")]
    assert files.select("page_id").exceptAll(read_html_files(spark, str(tmp_path / "html")).select("page_id")).count() == 0
    spark.createDataFrame([(1, "u", "h", 9)], "page_id int, url string, html string, other int").write.parquet(
        str(tmp_path / "p")
    )
    frame = read_pages(spark, str(tmp_path / "p"))
    assert frame.columns == ["page_id", "url", "html"]
    assert "other" not in frame._jdf.queryExecution().executedPlan().toString()


def test_harvest(spark):
    pages = spark.createDataFrame(
        [(1, "A"), (2, "B b"), (9, "B b"), (3, "empty")], "page_id bigint, name string"
    ).select(
        "page_id",
        page_url(F.col("name")).alias("url"),
        F.when(F.col("name") != "empty", F.concat(F.lit('<div id="mw-content-text"><p>'), F.col("name"), F.col("page_id"))).alias("html"),
    )
    got = harvest(listed(spark, "B b", "A", "B b", "none", "B_b", "empty"), pages).orderBy("ord").collect()
    assert [(r.input_title, r.title, r.content, r.error_message) for r in got] == [
        ("B b", "B b", "B b2", None),
        ("A", "A", "A1", None),
        ("B b", "B b", "B b2", None),
        ("none", "none", None, "Failed to fetch HTML"),
        ("B_b", "B_b", "B b2", None),
        ("empty", "empty", None, "Failed to fetch HTML"),
    ]
    assert got[4].url.endswith("/B_b") and got[3].url is None


def test_outcomes(spark):
    rows = [(i, f"t{i}", None if i % 2 else "Failed to fetch HTML") for i in range(30)]
    done = spark.createDataFrame(rows, "ord int, title string, error_message string")
    assert tuple(outcome.run_summary(done).first()) == (30, 15, 15)
    assert [r.ord for r in outcome.top_failures(done).collect()] == list(range(0, 20, 2))
    assert tuple(outcome.failures_left_out(done).first()) == (15, 5)
    assert tuple(outcome.failures_left_out(outcome.succeeded(done)).first()) == (0, 0)


def test_templates_from_files(tmp_path):
    (tmp_path / "a.json").write_text('{"b": "{title}", "a": {"x": [1]}}')
    (tmp_path / "a.YML").write_text('article_name: "{title}" # name\n# sections: "{sections}"\nsource_database: "Enc"\n')
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "a.txt").write_text("{}")
    assert list(load_template(tmp_path / "a.json")) == ["b", "a"]
    assert load_template(tmp_path / "a.YML") == {"article_name": "{title}", "source_database": "Enc"}
    with pytest.raises(FileNotFoundError):
        load_template(tmp_path / "none.json")
    for bad in ("list.json", "a.txt"):
        with pytest.raises(ValueError):
            load_template(tmp_path / bad)


def test_template_warnings():
    assert default_template(keep_images=True) == {
        "title": "{title}", "url": "{url}", "content": "{content}", "sections": "{sections}", "images": "{images}",
    }
    with pytest.warns(UserWarning):
        assert len(check_template({"a": "{title}"}, keep_images=True, keep_infobox=True)) == 2
    assert check_template({"a": {"deep": "{images}"}}, keep_images=True) == []


@pytest.fixture
def two(spark, pages):
    html = wiki('<table class="infobox"><tr><th>z</th><td>"é"</td></tr><tr><th>a</th><td><li>1</li></td></tr></table><p>x</p><img src=i>')
    return articles(pages(html, None, wiki("")), keep_images=True, keep_infobox=True)


def test_article_json(two):
    template = default_template(keep_images=True, keep_infobox=True) | {"n": None, "s": "a {title}", "o": {"k": ["{title}", True]}}
    rows = two.orderBy("page_id").select(article_json(two, template).alias("j")).collect()
    first = json.loads(rows[0].j)
    assert list(first) == list(template)
    assert list(first["infobox_data"].items()) == [("z", '"é"'), ("a", ["1"])]
    assert (first["images"], first["n"], first["s"]) == ([{"src": "i", "alt": "", "caption": ""}], None, "a {title}")
    assert first["o"] == {"k": ["{title}", True]}
    assert "é" in rows[0].j
    last = json.loads(rows[2].j)
    assert (last["images"], last["infobox_data"], last["content"], last["sections"]) == ([], None, "", [])


def test_shape(two):
    with pytest.warns(UserWarning, match="unknown"):
        shaped = shape(two, {"b": "{title}", "a": "{nope}", "k": {"x": 1, "y": ["p"], "m": [1, "q"]}, "t": True})
    assert shaped.columns == ["b", "a", "k", "t"]
    row = shaped.first()
    assert (row.b, row.a, row.k.x, row.k.y, row.t) == ("Head", None, 1, ["p"], True)
    assert shape(two.drop("images"), {"i": "{images}"}).first().i is None
    boxes = shape(two, {"id": "{title}", "box": "{infobox_data}"}, objects=True).select(F.to_json(F.struct("box")).alias("j"))
    assert json.loads(boxes.first().j) == {"box": {"z": '"é"', "a": ["1"]}}


def read_parts(folder):
    return "".join(f.read_text(encoding="utf-8") for f in sorted(folder.glob("part-*")))


def test_writers(spark, two, tmp_path):
    template = default_template()
    out = tmp_path / "deep" / "er"
    writers.write_json_lines(two, template, str(out))
    assert len(read_parts(out).splitlines()) == 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        writers.write_json_lines(two, template, str(out))
    writers.write_json_array(two, template, str(tmp_path / "array"), "page_id")
    assert [a["content"] for a in json.loads(read_parts(tmp_path / "array"))] == ["x", ""]
    writers.write_json_array(two.filter("page_id = 1"), template, str(tmp_path / "none"), "page_id")
    assert json.loads(read_parts(tmp_path / "none")) == []
    failed = two.select(F.col("page_id").alias("ord"), F.col("input_title").alias("title"), "error_message")
    writers.write_failures(failed, str(tmp_path / "failed"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "failed")).collect()] == [(1, "Given", "Failed to fetch HTML")]


def test_one_run_cleans_once(spark, tmp_path):
    pages = spark.createDataFrame([(i, name, wiki(f"<p>about {i}</p>", "")) for i, name in enumerate("ab")], "page_id bigint, url string, html string")
    pages = pages.withColumn("url", page_url(F.col("url")))
    report = run(listed(spark, "a", "none", "b", "a"), pages, str(tmp_path / "out"))
    assert tuple(report["summary"]) == (4, 3, 1) and tuple(report["left_out"]) == (1, 0)
    assert [tuple(r) for r in report["failures"]] == [(1, "none", "Failed to fetch HTML")]
    written = [json.loads(line) for line in read_parts(tmp_path / "out" / "articles").splitlines()]
    assert sorted(a["content"] for a in written) == ["about 0", "about 0", "about 1"]
    plan = harvest(listed(spark, "a"), pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_run_of_drawn_titles_as_one_array(spark, tmp_path):
    pages = spark.range(30).selectExpr("id AS page_id", "concat('T', id) AS name").select(
        "page_id", page_url(F.col("name")).alias("url"), F.concat(F.lit('<div id="mw-content-text"><p>about '), "name").alias("html")
    )
    known = spark.range(40).selectExpr("concat('T', id) AS title")
    with pytest.warns(UserWarning, match="images"):
        report = run(None, pages, str(tmp_path / "out"), count=12, known=known, seed="x", as_array=True, keep_images=True, template={"c": "{content}"})
    drawn = [r.title for r in T.random_titles(known, 12, "x").orderBy("ord").collect()]
    found = [t for t in drawn if int(t[1:]) < 30]
    assert [a["c"] for a in json.loads(read_parts(tmp_path / "out" / "articles"))] == [f"about {t}" for t in found]
    assert tuple(report["summary"]) == (12, len(found), 12 - len(found)) and tuple(report["left_out"]) == (12 - len(found), max(2 - len(found), 0))
    assert [r.title for r in report["failures"]] == [t for t in drawn if t not in found][:10]
    assert len(report["warnings"]) == 1 and report["seconds"] > 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["articles", "failures", "outcomes"]


def test_run_refuses_what_it_cannot_do(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    for titles, options in ((listed(spark, "a").limit(0), {}), (None, {}), (None, {"count": 3}), (None, {"count": 0, "known": listed(spark, "a")})):
        with pytest.raises(ValueError):
            run(titles, pages, str(tmp_path / "out"), **options)
    assert not (tmp_path / "out").exists()


def test_repeated_and_null_ids_stay_apart(spark):
    html = wiki("<p>{}</p>", "T")
    rows = [(7, "x", html.format("first")), (7, "x", html.format("second")), (None, "n", html.format("third")), (None, "n", html.format("third")), (8, "e", None), (8, "e", "")]
    got = articles(spark.createDataFrame(rows, "page_id bigint, title string, html string")).collect()
    assert sorted((r.title, r.content or "-") for r in got) == [("T", "first"), ("T", "second"), ("T", "third"), ("T", "third"), ("e", "-"), ("e", "-")]


def test_profiles_of_any_length(spark, pages):
    areas = tuple(f"div.a{i}" for i in range(12))
    boxes = tuple(f"table.b{i}" for i in range(5))
    profile = Profile(title="h1#t", areas=areas, infobox=boxes)
    html = '<div class="a11"><p>last</p></div><div class="a9"><p>ninth</p><table class="b4"><tr><th>k</th><td>v</td></tr></table></div>'
    row = articles(pages(html), profile, keep_infobox=True).first()
    assert (row.content, row.infobox_data) == ("ninth", '{"k":"v"}')


def test_pacing_against_the_rule(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aaaab"), rng.randint(0, 4000)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "id int, host string, at bigint")
    for gap, cut in ((3, 100), (0, 7), (50, 10_000)):
        expected, last = {}, {}
        for i, host, at in sorted(rows, key=lambda r: (r[2], r[0])):
            last[host] = max(at, last[host] + gap) if host in last else at
            expected[i] = last[host]
        got = {r.id: r.send_us for r in pace_requests(frame, "host", "at", "id", gap, slice_us=cut).collect()}
        assert got == expected


def test_a_burst_is_cut_by_its_requests(spark):
    """All arrivals in one slice: parts of it are paced apart and meet by one row each."""
    rng = random.Random(3)
    rows = [(i, "h" if i % 50 else None, 59_000_000 + rng.choice((rng.randint(0, 900_000), 5))) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id int, host string, at bigint").repartition(3)
    expected, last = {}, {}
    for i, host, at in sorted(rows, key=lambda r: (r[2], r[0])):
        last[host] = max(at, last[host] + 40) if host in last else at
        expected[i] = last[host]
    got = {r.id: r.send_us for r in pace_requests(frame, "host", "at", "id", 40, slice_rows=100).collect()}
    assert got == expected
    sliced = frame.selectExpr("*", "at div 60000000 AS slice", "(at % 60000000) div 915 AS bin")
    parts = pacing._cuts(sliced, "host", 100).groupBy("cut_host", "part").count().collect()
    # About half of the requests share one moment and stay together; the others are some 1500 over parts of 100.
    assert len([p for p in parts if p.cut_host == "h"]) >= 14 and not [p for p in parts if p.cut_host is None]
    assert pacing._cuts(sliced, "host", 100_000).count() == 0


def test_stream_writes_each_page_once(spark, tmp_path):
    source, output, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(*ids):
        rows = [(i, f"t{i}", wiki(f"<p>page {i}</p>")) for i in ids]
        spark.createDataFrame(rows, PAGE_SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        query = stream_articles(spark, source, output, checkpoint, files_per_batch=1)
        query.awaitTermination()
        return sorted(((r.page_id, r.content) for r in spark.read.parquet(output).collect()), key=repr)

    def hold(*rows):
        spark.createDataFrame(rows, PAGE_SCHEMA).coalesce(1).write.mode("append").parquet(source)

    arrive(1, 2, 2)
    assert run() == [(1, "page 1"), (2, "page 2")]
    arrive(2, 3)
    arrive(4, 1)
    assert run() == [(i, f"page {i}") for i in (1, 2, 3, 4)]
    # A page that failed may come back; of two versions the one with HTML is taken.
    hold((5, "t5", ""), (6, "t6", None), (6, "t6", wiki("<p>page 6</p>")))
    run()
    arrive(5)
    run()
    shown = sorted((r.page_id, r.content) for r in latest_articles(spark, output).collect())
    assert shown == [(i, f"page {i}") for i in (1, 2, 3, 4, 5, 6)]
    first = spark.range(1).select(F.lit(1).cast("long").alias("page_id")).select(bucket()).head()[0]
    done = written_before(spark, output, 99, [first])
    assert f"bucket={first}" in str(done.inputFiles()) and all(f"bucket={first}/" in f for f in done.inputFiles())
    assert written_before(spark, output + "/none", 99, [first]) is None
    (tmp_path / "bad" / f"bucket={first}").mkdir(parents=True)
    with pytest.raises(Exception, match="schema|SCHEMA"):
        written_before(spark, str(tmp_path / "bad"), 99, [first])


def test_seen_ids_stay_in_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen, "FAN", 3)
    monkeypatch.setattr(seen, "FILE_ROWS", 100)
    out, rng = str(tmp_path / "out"), random.Random(2)
    known, everything = set(), list(range(0, 20_000, 7))
    for batch in range(14):
        ids = rng.sample(everything, 100)
        frame = spark.createDataFrame([(i,) for i in [*ids, ids[0]]], "page_id bigint")
        seen.merge(spark, out, batch)
        done = seen.seen_before(spark, out, batch, frame)
        hits = set() if done is None else {r.page_id for r in frame.join(done, "page_id", "left_semi").collect()}
        assert hits == known & set(ids)
        seen.remember(spark, out, batch, frame)
        if batch == 9:  # the batch runs again: it must not see itself
            again = seen.seen_before(spark, out, batch, frame)
            assert {r.page_id for r in frame.join(again, "page_id", "left_semi").collect()} == known & set(ids)
            seen.remember(spark, out, batch, frame)
        known |= set(ids)
    found = seen.runs(spark, out)
    # 14 batches: two levels are full, and at most two runs wait on each.
    assert len(found) <= 6 and {r.level for r in found} == {0, 1, 2}
    assert sorted(b for r in found for b in range(r.first, r.last + 1)) == list(range(14))
    files = seen.files_met(spark, out, 99, spark.range(20_000).selectExpr("id AS page_id"))
    few = seen.files_met(spark, out, 99, spark.range(7000, 7070, 7).selectExpr("id AS page_id"))
    assert len(files) >= 6 and 0 < len(few) < len(files)
    assert seen.files_met(spark, out, 99, spark.range(20_100, 20_200).selectExpr("id AS page_id")) == []
    assert seen.files_met(spark, out, 0, spark.range(20_000).selectExpr("id AS page_id")) == []
