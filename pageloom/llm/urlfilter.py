"""URL filter: rules for known hosts and paths, logistic regression on hashed character n-grams for the rest.

An address is cut into host and path by expressions; rules are a short list and become one expression, the longest rule
first. What no rule fits is judged by a model: character n-grams of host and path, hashed to `FEATURES` numbers, their
counts scaled to length 1, a regularised logistic regression. The model is learned in one task from a small labelled
table, at most `sample` addresses of at most `LONGEST` characters each, chosen by hash; every address of any length is scored,
by sparse dot products in Arrow batches. The query takes as labels the addresses of its own table that a rule fits.

Rules. Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: on from there up to `?`, `#` or the end; both
are empty where the address is null or has no `://`. A rule fits its host and all hosts below it where the path starts with the
rule's; the longest rule wins, equal ones by host, then path. Empty addresses have the bias alone; without labelled
addresses, or with labels of one kind only, the score is 0 or 1 by what is known and 0.5 without any; scores above `THRESHOLD` block. Repeated rows are
judged each and learned from once. Empty tables give no rows. Columns of the input come along; `host`, `path`,
`rule`, `verdict` and `score` replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import table
from pageloom.llm.words import mix, slices

FEATURES = 1 << 16
LENGTHS = (3, 4, 5)
SAMPLE = 4000
LONGEST = 2048
THRESHOLD = 0.5
STEPS = 300
PENALTY = 1e-4


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def split_url(urls: DataFrame, url: str = "url") -> DataFrame:
    """The rows with `host` and `path` of their address."""
    kept = [F.col(f"`{c}`") for c in urls.columns if c not in ("host", "path", "rest_of_url")]
    rest = F.expr(f"CASE WHEN locate('://', `{url}`) > 0 THEN substring(`{url}`, locate('://', `{url}`) + 3) ELSE '' END")
    cut = urls.select(*kept, rest.alias("rest_of_url"))
    raw = F.regexp_extract("rest_of_url", "^[^/?#]*+", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract("rest_of_url", "^[^/?#]*+([^?#]*+)", 1)
    return cut.select("*", host.alias("host"), path.alias("path")).drop("rest_of_url")


def with_rule(split: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`rule` and `verdict` of the longest rule that fits, null where none does."""
    cases = {"rule": [], "verdict": []}
    for rule in sorted(set(rules), key=lambda r: (-len(r.name), r.host, r.path, r.verdict)):
        host, below = _text(rule.host), _text("." + rule.host)
        fits = f"(host = {host} OR endswith(host, {below})) AND startswith(path, {_text(rule.path)})"
        cases["rule"].append(f"WHEN {fits} THEN {_text(rule.name)}")
        cases["verdict"].append(f"WHEN {fits} THEN {_text(rule.verdict)}")
    columns = {k: F.expr(f"CASE {' '.join(v)} END" if v else "CAST(NULL AS STRING)") for k, v in cases.items()}
    return split.withColumns(columns)


def _texts(host: str, path: str) -> Column:
    """What n-grams are read from; the marks cannot occur in the parts beside them."""
    return F.concat(F.lit("^"), F.col(host), F.lit("#"), F.col(path), F.lit("$"))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of each text's distinct features in order; the values of a text have length 1."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # The host is what stands before the first '#'.
    marks = np.flatnonzero(data == ord("#"))
    at, first = np.unique(text[marks], return_index=True)
    border = np.full(len(offsets) - 1, len(data))
    border[at] = marks[first]
    keys = []
    for n in LENGTHS:
        count = max(0, len(data) - n + 1)
        gram = np.zeros(count, np.uint64)
        for j in range(n):
            gram |= data[j : j + count].astype(np.uint64) << np.uint64(8 * j)
        own = text[:count]
        inside = text[n - 1 :] == own
        in_path = (np.arange(count) >= border[own]).astype(np.uint64)
        number = mix(gram + (in_path << np.uint64(56)) + (np.uint64(n) << np.uint64(58))) % np.uint64(FEATURES)
        keys.append(own[inside] * FEATURES + number[inside].astype(np.int64))
    key, counts = np.unique(np.concatenate(keys), return_counts=True)
    text, number = key // FEATURES, key % FEATURES
    norm = np.sqrt(np.bincount(text, counts.astype(float) ** 2, minlength=len(offsets) - 1))
    return text, number, counts / norm[text]


def train(text: np.ndarray, number: np.ndarray, value: np.ndarray, labels: np.ndarray, *, steps: int = STEPS, penalty: float = PENALTY):
    """(weights, bias) of least mean log loss plus penalty/2 * weights^2, by accelerated gradient steps."""
    seen, column = np.unique(number, return_inverse=True)
    rows, size = len(labels), len(seen)
    w = np.zeros(size + 1)
    ahead, momentum = w.copy(), 1.0
    rate = 1 / (0.25 * 2 + penalty)  # rows have length 1, and 1 for the bias

    def gradient(at: np.ndarray) -> np.ndarray:
        z = np.bincount(text, value * at[column], minlength=rows) + at[-1]
        residual = (1 / (1 + np.exp(-z)) - labels) / rows
        return np.append(np.bincount(column, value * residual[text], minlength=size) + penalty * at[:-1], residual.sum())

    for _ in range(steps):
        new = ahead - rate * gradient(ahead)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    weights = np.zeros(FEATURES)
    weights[seen] = w[:-1]
    return weights, float(w[-1])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One model of all rows of a task, in their order."""
    parts, labels, at = [], [], 0
    for batch in batches:
        for row, data, offsets in slices(batch.column(0)):
            text, number, value = features(data, offsets)
            parts.append((text + at, number, value))
            at += len(offsets) - 1
            labels.append(np.asarray(batch.column(1).slice(row, len(offsets) - 1)).astype(float))
    if not parts:
        return
    known = np.concatenate(labels)
    if known.min() == known.max():
        weights, bias = np.zeros(FEATURES), 40.0 if known[0] else -40.0
    else:
        weights, bias = train(*(np.concatenate(c) for c in zip(*parts, strict=True)), known)
    yield pa.record_batch([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])


def learn(labelled: DataFrame, *, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model of a table `host, path, blocked`: at most `sample` addresses, each with each label once."""
    rows = labelled.where(f"blocked IS NOT NULL AND length(host) + length(path) <= {LONGEST}")
    rows = rows.select(_texts("host", "path").alias("address"), F.col("blocked").cast("int").alias("label")).distinct()
    chosen = rows.orderBy(F.xxhash64("address"), "address", "label").limit(sample)
    # One task learns, and its rows come in one order in every run.
    fit = chosen.repartition(1).sortWithinPartitions("address", "label").mapInArrow(_fit, "weights binary, bias double").head()
    return (np.zeros(FEATURES), 0.0) if fit is None else (np.frombuffer(fit.weights), fit.bias)


def scored(split: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows with `score`, 0 to 1 and higher where an address is likelier to be blocked."""
    shared = split.sparkSession.sparkContext.broadcast(model)  # half a megabyte, whatever the data

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        weights, bias = shared.value
        out = [np.zeros(0)]
        for _, data, offsets in slices(texts):
            text, number, value = features(data, offsets)
            z = np.bincount(text, value * weights[number], minlength=len(offsets) - 1) + bias
            out.append(1 / (1 + np.exp(-z)))
        return pa.array(np.concatenate(out))

    kept = [F.col(f"`{c}`") for c in split.columns if c != "score"]
    return split.select(*kept, score(_texts("host", "path")).alias("score"))


def judged(
    urls: DataFrame, model: tuple[np.ndarray, float], rules: tuple[Rule, ...] = RULES, *, threshold: float = THRESHOLD
) -> DataFrame:
    """The rows with `host`, `path`, `rule`, `verdict` and `score`."""
    found = scored(with_rule(split_url(urls), rules), model)
    own = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return found.withColumn("verdict", F.coalesce("verdict", own))


def op12_url_filter(spark, folder: str) -> DataFrame:
    """The whole of `pages`; the rules' own verdicts are the labelled table."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    known = with_rule(split_url(pages)).where("rule IS NOT NULL")
    model = learn(known.select("host", "path", (F.col("verdict") == "block").alias("blocked")))
    return judged(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")
