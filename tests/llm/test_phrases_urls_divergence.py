"""Phrases, URL verdicts and divergence against brute force, with nulls, empty and long texts, ties, repeats and odd columns."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.llm import collocations, divergence, urlfilter
from pageloom.llm.queries import QUERIES
from pageloom.llm.tally import Tally, lower_ascii, word_strings
from pageloom.llm.words import slices, spans

SCHEMA = "doc_id long, text string, lang string, source string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def texts(rng, rows, sources=4):
    """Documents of few words, so that counts are high and tie often."""
    common = ["the", "of", "Zürich", "ÀB", "x1", "new", "york", "city", "a-b", "\u0130i"]
    out = []
    for i in range(rows):
        words = [rng.choice(common if rng.random() < 0.8 else [f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.5:
            at = rng.randrange(len(words) + 1)
            words[at:at] = ["New", "York", "city", "hall"]
        out.append((i, "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in words)))
    odd = [(None, None), (900, ""), (901, " \t\n.;"), (902, "new york city hall " * 4000), (902, "new york city hall " * 40)]
    rows = [(i, t, rng.choice(["en", "de", None, "und", ""]), rng.choice([f"s{k}" for k in range(sources)] + [None])) for i, t in out]
    return rows + [(i, t, "en", "s0") for i, t in odd] + [rows[0], rows[0], (903, None, "zz", None), (904, "", "zz", "s1"), (905, "lone words", "yy", "s")]


def phrases_by_hand(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        taken = set()
        for longer, b in candidates.items():
            for n in range(2, len(longer)):
                for i in range(len(longer) - n + 1):
                    if 100 * b >= 80 * f[longer[i : i + n]]:
                        taken.add(longer[i : i + n])
        scored = []
        for p, a in candidates.items():
            if p not in taken:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 30, 2000), (2, 5, 2000), (3, 2, 7)])
def test_collocations(spark, seed, least, top):
    rows = texts(random.Random(seed), 200)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' AS phrase", "1 AS n", "2 AS rank").repartition(3)
    got = collocations.collocations(docs, least=least, top=top)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got.columns == names
    wanted = phrases_by_hand(rows, least, top)
    assert len(wanted) > 3
    assert sorted(tuple(r) for r in got.collect()) == wanted


def test_collocations_of_no_rows_and_of_no_phrases(spark):
    docs = spark.createDataFrame([(1, "one two three", "en", "s"), (2, None, None, None)], SCHEMA)
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_stripes_merge_by_element_whatever_a_task_holds(spark):
    rows = texts(random.Random(4), 80)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    path, seed = collocations.words_of(docs)
    numbers = {r.number for r in spark.read.parquet(path).collect()}
    for size in (2, 3):
        nothing = spark.sparkContext.broadcast((None, np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
        whole = collocations.stripes(docs, size, seed, nothing).collect()
        # A task that may hold few rows hands on many small stripes; hot prefixes are cut into segments.
        first = np.array(sorted({tuple(r.prefix) for r in whole})[:20], np.int64).view(np.uint64)
        hot = np.sort(collocations.phrase_keys([np.ascontiguousarray(c) for c in first.T]))
        some = spark.sparkContext.broadcast((None, hot, np.full(len(hot), 5, np.uint64)))
        cut = collocations.stripes(docs, size, seed, some, limit=5).collect()
        key = lambda r: (tuple(r.prefix), r.next, r.n)
        assert sorted(map(key, whole)) == sorted(map(key, cut)) and len(whole) > 100
        assert {n for r in whole for n in (*r.prefix, r.next)} <= numbers
    plan = collocations.stripes(docs, 3, seed, nothing)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_words_of_one_number_start_the_pass_anew(spark, monkeypatch):
    """Words that share a number are seen beside each other, also within a task, until a seed keeps them apart."""
    docs = spark.createDataFrame([(i, f"alpha beta {w}", "en", None) for i, w in enumerate(["gamma", "delta", "alpha"])], SCHEMA).coalesce(1)
    true = collocations.hashes

    def few(data, starts, ends, seed=7):
        return true(data, starts, ends, seed) * np.uint64(seed > 8)

    monkeypatch.setattr(collocations, "hashes", few)
    path, seed = collocations.words_of(docs)
    rows = sorted((r.word, r.n) for r in spark.read.parquet(path).collect())
    assert rows == [("alpha", 4), ("beta", 3), ("delta", 1), ("gamma", 1)]
    assert seed == 9


def test_counts_that_pass_64_bits(spark):
    # Scores and shares of counts no table here can reach.
    row = spark.sql(
        f"SELECT {divergence.share_sql('CAST(4000000000000000000 AS BIGINT)', 'CAST(9000000000000000000 AS BIGINT)', 'CAST(7 AS BIGINT)')} AS p"
    ).head()
    assert row.p == 1 + 1_000_000_000 * (4 * 10**18 + 5) // (9 * 10**18 + 35)


def divergence_by_hand(rows, least, top):
    count, documents = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        count[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, d in documents[lang].items() if d >= least)

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return [1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept]

        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(-sum(abs(x - y) for x, y in zip(p[s], p[o], strict=True)), o.encode()) for o in sources if o != s]
            term = [(y - x, t.encode()) for t, x, y in zip(kept, p[s], q, strict=True) if count[lang, s][t] and x > y]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "block", "tile"), [(30, 50, 1 << 16, 64), (2, 4, 3, 2), (3, 50, 8, 1)])
def test_divergence(spark, least, top, block, tile):
    rows = texts(random.Random(5), 200, sources=7)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' AS term", "1 AS n", "2 AS level", "3 AS p").repartition(3)
    got = divergence.divergence(docs, least=least, top=top, block=block, tile=tile)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    wanted = divergence_by_hand(rows, least, top)
    assert {w[2] for w in wanted} == {"pair", "term"}
    assert sorted(tuple(r) for r in got.collect()) == wanted


def test_divergence_of_no_rows(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_run_distance_is_the_sum_over_all_places():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x, y = rng.integers(0, 3, (2, int(rng.integers(1, 40))))
        ends = [np.flatnonzero(np.append(v[1:] != v[:-1], True)) for v in (x, y)]
        got = divergence.run_distance(ends[0] + 1, x[ends[0]], ends[1] + 1, y[ends[1]])
        assert got == np.abs(x - y).sum()


def test_tally_adds_up_whatever_it_holds():
    rng = np.random.default_rng(1)
    keys, n = rng.integers(0, 50, 3000).astype(np.uint64), rng.integers(0, 9, 3000)
    for limit in (1, 20, 10_000):
        tally, seen = Tally(limit), Counter()
        for at in range(0, 3000, 100):
            part = slice(at, at + 100)
            full = tally.add(keys[part], [n[part]], [pa.array([f"k{k}" for k in keys[part]])])
            for held in [tally.drain()] if full or at == 2900 else []:
                for key, value, name in zip(held[0], held[1][0], held[2][0].to_pylist(), strict=True):
                    assert name == f"k{key}"
                    seen[int(key)] += int(value)
        assert seen == Counter({k: int(n[keys == k].sum()) for k in range(50) if (keys == k).any()})
        assert tally.drain() is None


def test_words_as_strings():
    data, offsets = next(slices(pa.array(["Ab É. c", "", "\u0130X"]), 1 << 20))[1:]
    lower = lower_ascii(data)
    starts, ends, _ = spans(lower, offsets, collocations._kinds())
    assert word_strings(lower, starts, ends).to_pylist() == ["ab", "É", "c", "\u0130x"]


URLS = [
    None, "", "nothing", "http://", "://", "http://ORG", "http://org/", "HTTP://Example.ORG/es/1?x=1#y", "ftp://a.b.example.org/es/",
    "https://example.org/ES/1", "https://notexample.org/es/1", "https://example.org/en/12#top", "https://example.org/en/2", "https://x.com/fr/",
    "https://com/fr/a/b", "https://x.com/fr", "https://xcom/fr/", "https://x.com/de/1?u=://y.org/", "https://x.net?q=/de/", "https://x.net#://",
    "http://u:p@x.com:80/de/", "http://x.com\n/de/\n1", "http://É.org/ä", "a://b://c.org/x", "https://x.com/" + "de/" * 30000,
]


def parts_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lowered(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_by_hand(host, path):
    fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_url_parts_and_rules(spark):
    frame = spark.createDataFrame(list(enumerate(URLS)) * 2, "page_id long, url string").selectExpr("*", "'own' AS host", "'own' AS verdict", "1 AS score")
    got = urlfilter.judged(frame, (np.zeros(urlfilter.FEATURES), 0.0)).collect()
    assert len(got) == 2 * len(URLS)
    for row in got:
        host, path = parts_by_hand(row.url)
        rule = rule_by_hand(host, path)
        assert (row.host, row.path) == (host, path)
        assert (row.rule, row.verdict) == ((rule.name, rule.verdict) if rule else (None, "allow"))
        assert row.score == 0.5
    assert {r.rule for r in got} == {None, *(r.name for r in urlfilter.RULES)}
    assert urlfilter.judged(frame.limit(0), (np.zeros(urlfilter.FEATURES), 0.0)).count() == 0


def test_url_model_needs_both_labels(spark):
    frame = spark.createDataFrame([("a.com", "/x", True), ("b.com", "/y", None)], "host string, path string, blocked boolean")
    weights, bias = urlfilter.learn(frame)
    assert bias > 30 and not weights.any()
    weights, bias = urlfilter.learn(frame.limit(0))
    assert bias == 0 and not weights.any()


def test_url_training_reaches_the_optimum():
    # The same loss in dense form, solved by Newton's method.
    rng = np.random.default_rng(0)
    urls = [f"^h{rng.integers(5)}.com#/{'de' if rng.random() < 0.5 else 'fr'}/{rng.integers(99)}$" for _ in range(120)]
    data, offsets = next(slices(pa.array(urls), 1 << 20))[1:]
    text, number, value = urlfilter.features(data, offsets)
    labels = np.array([("de" in u) ^ (rng.random() < 0.1) for u in urls], float)
    seen, column = np.unique(number, return_inverse=True)
    dense = np.zeros((120, len(seen) + 1))
    dense[text, column] = value
    dense[:, -1] = 1
    penalty = 0.01
    weights, bias = urlfilter.train(text, number, value, labels, steps=3000, penalty=penalty)
    w, ridge = np.zeros(len(seen) + 1), np.append(np.full(len(seen), penalty), 0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-dense @ w))
        gradient = dense.T @ (p - labels) / 120 + ridge * w
        w -= np.linalg.solve((dense.T * (p * (1 - p))) @ dense / 120 + np.diag(ridge + 1e-12), gradient)
    assert np.abs(weights[seen] - w[:-1]).max() < 1e-4 and abs(bias - w[-1]) < 1e-4


def test_url_features_by_hand():
    urls = ["^a.com#/x$", "^#$", "^é.org#/a#b$"]
    data, offsets = next(slices(pa.array(urls), 1 << 20))[1:]
    text, number, value = urlfilter.features(data, offsets)
    for i, url in enumerate(urls):
        raw = url.encode()
        border = raw.index(b"#")
        grams = Counter((raw[j : j + n], j >= border) for n in (3, 4, 5) for j in range(len(raw) - n + 1))
        assert sorted(value[text == i]) == pytest.approx(sorted(np.array(list(grams.values())) / np.sqrt(sum(c * c for c in grams.values()))))


def test_held_out_url_accuracy(spark):
    """What rules say about addresses the model has not seen."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    known = urlfilter.with_rule(urlfilter.split_url(pages)).where("rule IS NOT NULL")
    aside = F.expr("crc32(CAST(url AS binary)) % 5 = 0")
    model = urlfilter.learn(known.where(~aside).select("host", "path", (F.col("verdict") == "block").alias("blocked")))
    rows = urlfilter.scored(known.where(aside), model).collect()
    assert len(rows) > 100
    assert sum((r.score > 0.5) == (r.verdict == "block") for r in rows) >= 0.95 * len(rows)


def test_url_query_judges_every_page(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op12_url_filter"](spark, folder)
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()}
    rows = got.collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        rule = rule_by_hand(*parts_by_hand(pages[r.page_id]))
        assert (r.host, r.path) == parts_by_hand(pages[r.page_id])
        assert r.rule == (rule.name if rule else None)
        assert r.verdict == (rule.verdict if rule else "block" if r.score > 0.5 else "allow")
