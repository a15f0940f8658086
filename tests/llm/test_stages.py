"""Every pipeline stage with nulls, empty and long texts, repeats, empty tables and columns of clashing names; the models beside plain solvers."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pageloom.llm import langid, minhash, mixing, quality, secrets, sharding
from pageloom.llm.common import remove, temporary, written

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
CLASHING = (
    "spans", "score", "predicted", "held_out", "times", "place", "places", "kept", "doc", "row_key", "nth", "rest", "masked", "body", "rules",
    "component", "class_id", "kept_id", "plan_key", "size", "target", "upto", "bucket",
)
SECRET = "password = hunter2hunter2"


def prose(rng, n):
    return " ".join(f"word{rng.randrange(300)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    texts = [prose(rng, 60) for _ in range(12)]
    long = prose(rng, 60_000)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    rows += [(20, texts[0], "de", "b"), (21, texts[0], None, None), (22, texts[1] + " tail", "en", "b"), (3, texts[3], "en", "a"), (4, texts[5], "en", "c")]
    rows += [(30, None, "en", "a"), (31, "", "en", "a"), (32, " \n\t", None, "b"), (None, texts[2], "en", None), (None, None, None, None)]
    rows += [(40, long, "en", "b"), (41, long, "en", "c"), (42, f"é {SECRET} and {SECRET}", "en", "c"), (43, f"{SECRET}", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    frame = frame.withColumn("n_chars", F.length("text").cast("long")).withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id")))
    for name in CLASHING:
        frame = frame.withColumn(name, F.concat(F.lit("own "), F.coalesce(F.col("source"), F.lit("-"))))
    return frame.withColumn("list", F.array(F.lit(1.5), F.lit(None).cast("double"))).repartition(4).persist()


def plain(frame, *without):
    names = [c for c in frame.columns if c not in without]
    return Counter(repr(tuple(r[n] for n in names)) for r in frame.collect())


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_keeps_columns_and_runs_on_no_rows(spark, odd, name):
    got = STAGES[name](spark, odd, FOLDER)
    if name == "packing":
        assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    else:
        assert [f.simpleString() for f in got.schema] == [f.simpleString() for f in odd.schema]
    assert STAGES[name](spark, odd.limit(0), FOLDER).count() == 0


def test_quality_stage(spark, odd):
    got = STAGES["quality"](spark, odd, FOLDER)
    model = quality.learn(odd, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    wanted = [r for r in quality.scored(odd.select("doc_id", "text"), model).collect() if r.predicted == 1]
    assert plain(got) <= plain(odd)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r.doc_id, r.text) for r in wanted)


def test_near_duplicates_stage(spark, odd):
    got = STAGES["near_duplicates"](spark, odd, FOLDER)
    rows = got.collect()
    # Rows of one id are one document, whatever their texts: 4 stands for 5 and itself, the lesser key of its texts decides the row.
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 30, 31, 32, 40, 42, 43]
    assert sum(r.doc_id is None for r in rows) == 2
    assert plain(got) <= plain(odd)
    again = STAGES["near_duplicates"](spark, odd.repartition(7), FOLDER)
    assert plain(got) == plain(again)


def test_secrets_stage(spark, odd):
    got = STAGES["secrets"](spark, odd, FOLDER)
    assert plain(got, "text", "n_chars") == plain(odd, "text", "n_chars")
    mask = secrets.MASK
    for r in got.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))
        assert SECRET not in (r.text or "")
    before = Counter(r.text for r in odd.where("doc_id NOT IN (42, 43) OR doc_id IS NULL").collect())
    assert Counter(r.text for r in got.collect()) == before + Counter([f"é {mask} and {mask}", mask])


def test_mixing_stage(spark, odd):
    got = STAGES["mixing"](spark, odd, FOLDER)
    assert set(plain(got)) <= set(plain(odd))
    times = plain(got)
    assert all(n <= 3 * plain(odd)[row] for row, n in times.items())
    assert not [r for r in got.collect() if not (r.text or "").split()]
    plan = mixing.planned(odd.select("doc_id", "source", "text")).collect()
    assert Counter((r.doc_id, r.source) for r in got.collect()) == Counter({k: n for k, n in _times(plan).items() if n})
    assert plain(STAGES["mixing"](spark, odd.repartition(5), FOLDER)) == times


def _times(plan):
    out = Counter()
    for r in plan:
        out[r.doc_id, r.source] += r.times
    return out


def test_mix_comes_in_the_order_of_the_schedule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = mixing.scheduled(docs).select("doc_id", "size", "target", "times", "places").collect()
    schedule = sorted((tuple(p), r.doc_id, r.size) for r in plan for p in r.places)
    taken = sorted((tuple(p), r.doc_id) for r in plan for p in r.places[: r.times])
    budget, used, wanted = sum(r.size for r in plan), 0, []
    for place, doc, size in schedule:
        used += size
        if used > budget:
            break
        wanted.append((place, doc))
    assert taken == wanted
    assert [r.doc_id for r in mixing.mixed(docs).select("doc_id").collect()] == [doc for _, doc in wanted]


def test_packing_stage(spark, odd):
    rows = STAGES["packing"](spark, odd, FOLDER).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(r.doc_id for r in odd.collect())
    assert sum(r.doc_id == 40 for r in rows) > 50


def test_secrets_of_a_text_full_of_them(spark):
    """A million characters of which every few are a secret take seconds, and positions and masks are right."""
    one, n = "token=abcdefg ", 75_000
    keys = "-----BEGIN RSA PRIVATE KEY-----\n" + "A" * 40 + "\n"
    frame = spark.createDataFrame([(1, one * n), (2, keys * 3000), (3, "é" * 700 + one + "x" * 300)], "doc_id long, text string")
    secrets.scan(frame.limit(0)).count()
    start = time.monotonic()
    rows = {r.doc_id: r for r in secrets.scan(frame).select("doc_id", "spans", secrets.masked().alias("masked")).collect()}
    assert time.monotonic() - start < 60
    assert [(s.start, s.kind, s.end) for s in rows[1].spans] == [(i * len(one), 0, (i + 1) * len(one) - 1) for i in range(n)]
    assert rows[1].masked == (secrets.MASK + " ") * n
    assert rows[2].masked == (secrets.MASK + "\n") * 3000
    assert rows[3].masked == "é" * 700 + secrets.MASK + " " + "x" * 300


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 5000])
def test_running_sums_and_maxima(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(9) for _ in range(n)]
    frame = spark.createDataFrame([(values,)], "v array<int>")
    row = frame.select(
        secrets.running(F.col("v"), lambda x, y: x + y).alias("sums"), secrets.running(F.col("v"), lambda x, y: F.greatest(x, y)).alias("tops")
    ).head()
    assert row.sums == [sum(values[:i]) for i in range(n)]
    assert row.tops == [max(values[:i], default=0) for i in range(n)]


def test_shards_are_written_within_their_limit(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    path = str(tmp_path / "shards")
    sharding.write_shards(sharding.shards(docs, limit_bytes=100_000), path)
    again = spark.read.parquet(path)
    assert again.select("doc_id", "text").exceptAll(docs).count() == docs.exceptAll(again.select("doc_id", "text")).count() == 0
    sizes = again.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("bytes"), F.max("shard_bytes").alias("said")).collect()
    assert len(sizes) > 20 and all(r.bytes == r.said <= 100_000 for r in sizes)
    assert all(len(list(folder.glob("*.parquet"))) == 1 for folder in (tmp_path / "shards").glob("shard=*"))


def test_tables_between_stages_go(spark):
    frame = spark.range(10)
    with temporary(frame) as held:
        (file, *_) = held.inputFiles()
        assert held.count() == 10
    path = written(frame)
    assert spark.read.parquet(path).count() == 10
    remove(spark, path)
    for gone in (file, path):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(gone)


def test_buckets_follow_the_length_of_texts(spark, monkeypatch):
    """Texts of many different shingles get a larger table, so that common buckets stay rare."""
    rng = random.Random(1)
    seen = []
    counts = minhash._bucket_counts
    monkeypatch.setattr(minhash, "_bucket_counts", lambda bits: seen.append(bits) or counts(bits))
    for words in (10, 20_000):
        rows = [(i, " ".join(str(rng.randrange(10**9)) for _ in range(words))) for i in range(8)]
        minhash.weights(spark.createDataFrame(rows, "doc long, text string"))
    assert seen[0] == minhash.TABLE_BITS and seen[0] < seen[1] <= minhash.MOST_BITS


def test_ftrl_beside_its_formulas():
    rng = np.random.default_rng(1)
    examples = [(rng.integers(0, 12, int(rng.integers(1, 9))), int(rng.random() < 0.5)) for _ in range(40)]
    weights, bias = quality.train_ftrl(examples, epochs=3, alpha=0.7, beta=1.3, l1=0.05, l2=0.2)
    z, n = Counter(), Counter()
    order = np.random.default_rng(0)

    def weight(i):
        if abs(z[i]) <= 0.05:
            return 0.0
        return -(z[i] - math.copysign(0.05, z[i])) / ((1.3 + math.sqrt(n[i])) / 0.7 + 0.2)

    for _ in range(3):
        for k in order.permutation(len(examples)):
            numbers, label = examples[k]
            x = {i: c * quality.SCALE / len(numbers) for i, c in Counter(numbers.tolist()).items()} | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7 * w[i]
                n[i] += g * g
    assert weights[:12] == pytest.approx([weight(i) for i in range(12)], abs=1e-4)
    assert bias == pytest.approx(weight("bias"), abs=1e-5) and not weights[12:].any()


def test_support_vectors_beside_newton_steps():
    """The same loss, w.w/2 + cost * sum of squared hinge losses, solved in its primal form."""
    rng = np.random.default_rng(2)
    rows, signs = [], np.where(rng.random(60) < 0.5, 1.0, -1.0)
    for sign in signs:
        at = np.sort(rng.choice(20, 6, replace=False))
        value = rng.random(6) + (0.4 * sign * (at < 8))
        rows.append((at, value / np.linalg.norm(value)))
    w = langid.train_svm(rows, signs, cost=1.0, epochs=2000)
    dense = np.zeros((60, 20))
    for i, (at, value) in enumerate(rows):
        dense[i, at] = value
    exact = np.zeros(20)
    for _ in range(100):
        slack = 1 - signs * (dense @ exact)
        active = slack > 0
        x = dense[active]
        gradient = exact - 2 * x.T @ (signs[active] * slack[active])
        exact -= np.linalg.solve(np.eye(20) + 2 * x.T @ x, gradient)
    assert np.abs(w[:20] - exact).max() < 1e-4 and not w[20:].any()


def test_language_learns_from_the_most_frequent_ones(spark):
    rows = [(i, "abc def", f"l{i % 7}" if i < 70 else "rare") for i in range(72)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.learn(docs, languages=3)["families"] == ["l0", "l1", "l2"] or len(langid.learn(docs, languages=3)["families"]) == 3


def test_very_long_texts_are_judged_whole(spark):
    """What decides stands at the end, after a megabyte."""
    rng = random.Random(5)
    good, bad = ["alpha", "beta", "gamma"], ["junk", "spam", "trash"]
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=30))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.learn(docs, labels)
    pad = "0 " * 600_000
    long = spark.createDataFrame([(1, pad + "alpha beta " * 60_000), (2, pad + "junk spam " * 60_000)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in quality.scored(long, model).collect()}
    assert scores[1] > scores[2]
    tongues = spark.createDataFrame([(i, " ".join(rng.choices(good if i % 2 else bad, k=30)), "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    found = langid.identified(long, langid.learn(tongues)).collect()
    assert {r.doc_id: r.lang_pred for r in found} == {1: "en", 2: "de"}
