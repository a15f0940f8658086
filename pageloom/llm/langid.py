"""Language identification in two steps: the family first, then the language within it.

Both steps use one-versus-one linear support vector machines over hashed byte trigrams of the letters
of the whole text, in lower case. They are trained on the driver from at most `sample` documents of each of at most
`languages` languages, the most frequent ones; documents are chosen by a hash of the id, and of each, however long,
the driver sees the counts of its different trigrams, `FEATURES` at most. Prediction adds up weights over each whole text in
Arrow batches.

Rules. A null text and a text without a letter are `und` with score 0, and so is every text when
nothing can be learned. The score is the smaller of the two steps' mean confidence of the winner
against its rivals; a step with one choice is sure. Null ids are never held out and never learned
from. Rows are predicted each; columns of the input come along, and `held_out`, `lang_pred` and
`score` replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import held_out, table
from pageloom.llm.words import slices

FEATURES = 1 << 15
SAMPLE = 400
LANGUAGES = 40
# Families of language codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indo_aryan": "hi ur bn pa gu mr ne",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.split("-")[0].lower() in codes.split()), lang)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, first of each text)."""
    letters = np.full(256, 0x20, np.uint32)
    letters[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    letters[0x80:] = np.arange(0x80, 0x100)
    code = letters[data]
    n = max(0, len(code) - 2)
    gram = (code[:n] << 16) | (code[1 : n + 1] << 8) | code[2 : n + 2]
    ok = code[1 : n + 1] != 0x20
    for back in (1, 2):
        at = offsets[1:-1] - back
        ok[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(ok)
    numbers = (gram[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
    return numbers.astype(np.int32), np.searchsorted(at, offsets)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in slices(batch.column(0)):
            found, first = trigrams(data, offsets)
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))
            both, counts = np.unique(text * FEATURES + found, return_counts=True)
            starts = pa.array(np.searchsorted(both, np.arange(len(first)) * FEATURES), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(v.astype(np.int32))) for v in (both % FEATURES, counts)]
            yield pa.record_batch([*lists, batch.column(1).slice(row, len(first) - 1)], names=["features", "counts", "lang"])


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, *, cost: float = 1.0, epochs: int = 8) -> np.ndarray:
    """Linear machine with squared hinge loss, by dual coordinate descent over sparse unit rows."""
    w = np.zeros(FEATURES)
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(0)
    lean = 1 / (2 * cost)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value = rows[i]
            slope = signs[i] * float(w[at] @ value) - 1 + lean * alpha[i]
            new = max(0.0, alpha[i] - slope / (1 + lean))
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * signs[i] * value
                alpha[i] = new
    return w


def _machines(rows: dict[str, list]) -> list[tuple[str, str, np.ndarray]]:
    """One machine for each two names, scaled so that a typical margin is a confidence of 95 %."""
    out = []
    for a, b in combinations(sorted(rows), 2):
        both = rows[a] + rows[b]
        signs = np.repeat([1.0, -1.0], [len(rows[a]), len(rows[b])])
        w = train_svm(both, signs)
        margins = [abs(float(w[at] @ value)) * np.sqrt((value**2).sum()) / value.sum() for at, value in both]
        out.append((a, b, (w * (3 / max(1e-12, float(np.median(margins))))).astype(np.float32)))
    return out


def learn(docs: DataFrame, *, sample: int = SAMPLE, languages: int = LANGUAGES) -> dict:
    """{"families": names, "top": machines, "within": {family: (languages, machines)}}"""
    mine = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    most = mine.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    mine = mine.join(F.broadcast(most), "lang", "left_semi")  # at most `languages` rows
    ids = mine.select("doc_id", "lang").distinct().selectExpr(
        "doc_id AS id", "lang AS tongue", "row_number() OVER (PARTITION BY lang ORDER BY xxhash64(doc_id), doc_id) AS nth"
    )
    ids = ids.where(F.col("nth") <= sample).select("id", "tongue")
    picked = mine.join(F.broadcast(ids), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("tongue")))
    picked = picked.groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    text = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    made = picked.select(text.alias("body"), "lang").mapInArrow(_features, "features array<int>, counts array<int>, lang string").toArrow()
    lists = zip(made.column(0), made.column(1), made.column(2).to_pylist(), strict=True)
    counted = [(lang, at.values.to_numpy(), counts.values.to_numpy()) for at, counts, lang in lists]
    rows: dict[str, list] = {}
    for lang, at, counts in sorted(counted, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes())):
        if len(at):
            rows.setdefault(lang, []).append((at, counts / np.sqrt((counts.astype(float) ** 2).sum())))
    families: dict[str, dict[str, list]] = {}
    for lang, own in rows.items():
        families.setdefault(family_of(lang), {})[lang] = own
    top = _machines({f: [r for own in langs.values() for r in own] for f, langs in families.items()})
    within = {f: (sorted(langs), _machines(langs)) for f, langs in families.items()}
    return {"families": sorted(families), "top": top, "within": within}


def _vote(names: list[str], machines, numbers: np.ndarray, first: np.ndarray, size: np.ndarray):
    """The winner of each text, by number, and its mean confidence."""
    belief = np.zeros((len(size), len(names)))
    total = np.zeros(len(numbers) + 1)
    for a, b, w in machines:
        np.cumsum(w[numbers], out=total[1:])
        p = 1 / (1 + np.exp(-np.clip(np.diff(total[first]) / size, -30, 30)))
        belief[:, names.index(a)] += p
        belief[:, names.index(b)] += 1 - p
    best = belief.argmax(1)
    rivals = max(1, len(names) - 1)
    return best, belief[np.arange(len(size)), best] / rivals if len(names) > 1 else np.ones(len(size))


def predictions(texts: pa.Array, model: dict) -> pa.Array:
    """Struct of language and score of each text."""
    langs, scores = [], [np.zeros(0)]
    for _, data, offsets in slices(texts):
        numbers, first = trigrams(data, offsets)
        size = np.maximum(1, np.diff(first))
        lang, score = np.full(len(size), "und", object), np.zeros(len(size))
        if model["families"]:
            best, sure = _vote(model["families"], model["top"], numbers, first, size)
            for f, family in enumerate(model["families"]):
                names, machines = model["within"][family]
                inner, confident = _vote(names, machines, numbers, first, size)
                mine = best == f
                lang[mine] = np.array(names, object)[inner[mine]]
                score[mine] = np.minimum(sure, confident)[mine]
        blank = np.diff(first) == 0
        lang[blank], score[blank] = "und", 0.0
        langs += lang.tolist()
        scores.append(score)
    return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=["lang_pred", "score"])


def identified(docs: DataFrame, model: dict) -> DataFrame:
    """The documents with `held_out`, `lang_pred` and `score`; only texts travel to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        return predictions(texts, shared.value)

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    text = F.when(F.rlike("text", F.lit(r"\p{L}")), F.concat(F.lit(" "), F.lower("text"), F.lit(" ")))
    rows = docs.select(*keep, held_out().alias("held_out"), predict(text).alias("__language__"))
    return rows.select(*keep, "held_out", "__language__.lang_pred", "__language__.score")


def op3_language(spark, folder: str) -> DataFrame:
    """All documents, learned from those that are not held out."""
    docs = table(spark, folder, "documents")
    found = identified(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")
