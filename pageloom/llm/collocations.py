"""Phrase collocations by stripes: each prefix keys an associative counter of the words that follow it.

A stripe is one row `(prefix, next[], n[])`; the stripe of no words counts the words themselves. A pass over the
texts makes the stripes of prefixes of one length: tasks add up what they see, stripes are dealt by prefix and merged
element by element. The merged stripes answer all three questions: an element is the count of an extension; the total
of a prefix is its own element one level up; the largest element of a stripe, and the largest element among stripes that differ
in their first word alone, tell whether a longer phrase takes a phrase in.

Words stand in prefixes and stripes as 64-bit numbers, hashes of language and word, eight bytes whatever the word. The first pass
carries the words as well, so all words of all texts are seen beside their numbers: if two have one number, the
pass starts anew with another seed. Numbers therefore name words exactly, and phrases are compared by all their numbers.
Words are looked up again for the phrases that may be among the best.

Passes go by length. A phrase with enough occurrences has its first and its last words among the frequent phrases
one word shorter, so a pass counts only phrases whose two parts pass a bit filter of the level before. The filter has
at most 2^`SIEVE_BITS` bits whatever the data; where it fills up, more phrases are counted in vain and none is lost. The
stripe of a prefix with more than its share of all words, one in `SHARES`, is cut into segments by its next words;
at most `SHARES` prefixes have one, so their list is bounded.

Rules. Null texts are empty, a null lang is `und`; A-Z alone is lower-cased. Pieces end at `[.,;:!?]` and line breaks,
words at blanks and tabs. Texts of any length are read whole. Repeated rows count each. Equal scores rank by `a`, then by
the phrase's bytes. Empty tables give no rows. Columns other than `text` and `lang` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import materialised, remove, table, written
from pageloom.llm.tally import Held, Tally, lower_ascii, word_strings
from pageloom.llm.words import constants, hashes, mix, slices, spans

LONGEST = 4
LEAST = 30
TOP = 2000
SHARES = 20_000
SIEVE_BITS = 26
WORD_SEGMENTS = 256
RANK_SHARES = 64
HELD = 600_000
SEED, OTHER_SEED = 7, 1_000_003


def _kinds() -> np.ndarray:
    """0 between words, 1 within."""
    kinds = np.ones(256, np.uint8)
    kinds[[0x20, 0x09, *range(0x0A, 0x0E), *b".,;:!?"]] = 0
    return kinds


def _cuts() -> np.ndarray:
    cuts = np.zeros(256, np.int64)
    cuts[[*range(0x0A, 0x0E), *b".,;:!?"]] = 1
    return cuts


def _language_keys(langs: pa.Array) -> np.ndarray:
    """A 64-bit key of each row's language."""
    coded = langs.dictionary_encode()
    keys = [int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") for v in coded.dictionary.to_pylist()]
    return np.array(keys, np.uint64)[coded.indices.to_numpy()]


def phrase_keys(words: list[np.ndarray]) -> np.ndarray:
    """One hash for each phrase of so many words; only ever a filter or an order."""
    if len(words) == 1:
        return words[0]
    total = np.zeros(len(words[0]), np.uint64)
    for word, odd in zip(words, constants(len(words), 11), strict=True):
        total += mix(word + odd)
    return mix(total)


class _Words:
    """Words of a slice of texts: where they are, their piece, and their numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, seed: int):
        self.data = lower_ascii(data)
        self.starts, self.ends, first = spans(self.data, offsets, _kinds())
        self.text = np.searchsorted(first[1:-1], np.arange(len(self.starts)), "right")
        before = np.cumsum(_cuts()[self.data])
        self.piece = (before[self.starts] if len(self.starts) else np.zeros(0, np.int64)) + self.text
        self.number = mix(hashes(self.data, self.starts, self.ends, seed) ^ langs[self.text])

    def phrases(self, size: int, sieve: np.ndarray | None) -> list[np.ndarray]:
        """The words of every phrase of one size within a piece, by place, as far as both shorter parts may be frequent."""
        count = max(0, len(self.number) - size + 1)
        inside = self.piece[size - 1 :] == self.piece[:count]
        if sieve is not None and count:
            known = _passes(sieve, phrase_keys([self.number[j : count + 1 + j] for j in range(size - 1)]))
            inside = inside & known[:-1] & known[1:]
        at = np.flatnonzero(inside)
        return [self.number[at + j] for j in range(size)]


def _probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return keys & mask, (keys >> np.uint64(64 - bits)) & mask


def _passes(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter, 64-bit words of bits."""
    ok = np.ones(len(keys), bool)
    for at in _probes(keys, int(len(sieve) * 64).bit_length() - 1):
        ok &= (sieve[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns start to differ."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _word_stripes(seed: int, limit: int):
    """The stripe of no words of each language, by segments, the words beside their numbers."""

    def emit(held: Held | None) -> Iterator[pa.RecordBatch]:
        if held is None:
            return
        (n,), (lang, word) = held.sums, held.labels
        codes = lang.dictionary_encode()
        segment = (held.keys % np.uint64(WORD_SEGMENTS)).astype(np.int32)
        code = codes.indices.to_numpy()
        order = np.lexsort((segment, code))
        cut = _runs(code[order], segment[order])
        starts, at = pa.array(np.append(cut, len(order)).astype(np.int32)), pa.array(order)
        columns = [
            lang.take(pa.array(order[cut])),
            pa.array(segment[order][cut]),
            pa.ListArray.from_arrays(starts, word.take(at).cast(pa.string())),
            pa.ListArray.from_arrays(starts, pa.array(held.keys[order].view(np.int64))),
            pa.ListArray.from_arrays(starts, pa.array(n[order])),
        ]
        yield pa.record_batch(columns, names=["lang", "segment", "word", "number", "n"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(limit)
        for batch in batches:
            keys = _language_keys(batch.column(1))
            for row, data, offsets in slices(batch.column(0)):
                found = _Words(data, offsets, keys[row : row + len(offsets) - 1], seed)
                words = word_strings(found.data, found.starts, found.ends)
                langs = batch.column(1).take(pa.array(row + found.text))
                # A second hash keeps words of one number apart here, so that they are seen beside each other.
                other = hashes(found.data, found.starts, found.ends, seed + OTHER_SEED)
                if tally.add(found.number, [np.ones(len(found.number), np.int64)], [langs, words], [other]):
                    yield from emit(tally.drain())
        yield from emit(tally.drain())

    return made


def words_of(docs: DataFrame, *, limit: int = HELD) -> tuple[str, int]:
    """Path of the table `lang, word, number, n` of all words, and the seed under which no two of them have one number."""
    seed = SEED
    while True:
        made = _texts(docs).mapInArrow(
            _word_stripes(seed, limit), "lang string, segment int, word array<string>, number array<long>, n array<long>"
        )
        elements = made.repartition("lang", "segment").selectExpr("lang", "segment", "inline(arrays_zip(word, number, n))")
        # The exchange by (lang, segment) serves the merge as it is.
        merged = elements.groupBy("lang", "segment", "word", "number").agg(F.sum("n").alias("n")).drop("segment")
        path = written(merged)
        if docs.sparkSession.read.parquet(path).groupBy("number").count().where("count > 1").isEmpty():
            return path, seed
        remove(docs.sparkSession, path)
        seed += 1


def _stripe_parts(size: int, seed: int, shared, limit: int):
    """Stripes of prefixes of `size` - 1 words: (prefix, segment, next[], n[])."""

    def emit(held: Held | None, hot: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if held is None:
            return
        *prefix, word = held.parts
        parts = np.ones(len(word), np.uint64)
        if len(hot):
            keys = phrase_keys(prefix)
            place = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
            parts = np.where(hot[place] == keys, cuts[place], parts)
        segment = (word % parts).astype(np.int32)
        order = np.lexsort((segment, *reversed(prefix)))
        cut = _runs(segment[order], *(p[order] for p in prefix))
        starts = pa.array(np.append(cut, len(order)).astype(np.int32))
        wide = np.stack([p[order][cut] for p in prefix], axis=1).ravel().view(np.int64)
        columns = [
            pa.ListArray.from_arrays(pa.array(np.arange(len(cut) + 1, dtype=np.int32) * len(prefix)), pa.array(wide)),
            pa.array(segment[order][cut]),
            pa.ListArray.from_arrays(starts, pa.array(word[order].view(np.int64))),
            pa.ListArray.from_arrays(starts, pa.array(held.sums[0][order])),
        ]
        yield pa.record_batch(columns, names=["prefix", "segment", "next", "n"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, hot, cuts = shared.value
        tally = Tally(limit)
        for batch in batches:
            keys = _language_keys(batch.column(1))
            for row, data, offsets in slices(batch.column(0)):
                words = _Words(data, offsets, keys[row : row + len(offsets) - 1], seed).phrases(size, sieve)
                if tally.add(phrase_keys(words), [np.ones(len(words[0]), np.int64)], [], words):
                    yield from emit(tally.drain(), hot, cuts)
        yield from emit(tally.drain(), hot, cuts)

    return made


def stripes(docs: DataFrame, size: int, seed: int, shared, *, limit: int = HELD) -> DataFrame:
    """`prefix, next, n`: the merged stripes of prefixes of `size` - 1 words, one row per element.

    `shared` is a broadcast of (filter of the phrases one word shorter or None, keys of hot prefixes in order, segments of each).
    """
    made = _texts(docs).mapInArrow(_stripe_parts(size, seed, shared, limit), "prefix array<long>, segment int, next array<long>, n array<long>")
    elements = made.repartition("prefix", "segment").selectExpr("prefix", "segment", "inline(arrays_zip(next, n))")
    # The exchange by (prefix, segment) serves the merge as it is.
    return elements.groupBy("prefix", "segment", "next").agg(F.sum("n").alias("n")).drop("segment")


def _sieve(level: DataFrame) -> np.ndarray:
    """Filter of a level's phrases, at least 16 bits for each while the bound allows."""
    bits = min(SIEVE_BITS, max(16, (16 * level.count()).bit_length()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_probes(_keys_of(batch.column(0)), bits))
            columns = [(at >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (at & np.uint64(63))).view(np.int64)]
            yield pa.record_batch([pa.array(c) for c in columns], names=["place", "bit"])

    rows = level.select("phrase").mapInArrow(placed, "place long, bit long").groupBy("place").agg(F.expr("bit_or(bit)").alias("bit"))
    rows = rows.toArrow()  # at most 2^(SIEVE_BITS - 6) rows
    sieve = np.zeros(1 << (bits - 6), np.uint64)
    sieve[rows["place"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
    return sieve


def _keys_of(phrases: pa.Array) -> np.ndarray:
    """Keys of phrases of one length, as lists of numbers."""
    if not len(phrases):
        return np.zeros(0, np.uint64)
    wide = phrases.flatten().to_numpy().view(np.uint64).reshape(len(phrases), -1)
    return phrase_keys([np.ascontiguousarray(c) for c in wide.T])


def _hot(level: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the phrases with more than a share of all words, in order, and the segments their stripes are cut into."""
    share = max(1, total // SHARES)
    rows = level.where(F.col("f") > share).select("phrase", "f").toArrow()  # at most SHARES rows
    if not rows.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    keys = _keys_of(rows["phrase"].combine_chunks())
    order = np.argsort(keys)
    return keys[order], (-(-rows["f"].to_numpy() // share)).astype(np.uint64)[order]


def frequent_phrases(docs: DataFrame, *, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(`phrase, size, f` of all phrases that occur at least `least` times, as lists of numbers; `lang, word, number, n` of all words)."""
    spark = docs.sparkSession
    path, seed = words_of(docs)
    words = spark.read.parquet(path)
    total = words.agg(F.sum("n")).head()[0] or 0
    level = words.where(F.col("n") >= least).select(F.array("number").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("f"))
    every = level
    for size in range(2, longest + 1):
        if level.isEmpty():
            break
        shared = spark.sparkContext.broadcast((_sieve(level), *_hot(level, total)))
        merged = stripes(docs, size, seed, shared).where(F.col("n") >= least)
        phrase = F.concat("prefix", F.array("next"))
        level = materialised(merged.select(phrase.alias("phrase"), F.lit(size).alias("size"), F.col("n").alias("f")))
        shared.destroy()
        every = every.unionByName(level)
    return every, words


def collocations(docs: DataFrame, *, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: each language's `top` phrases that no longer phrase takes in.

    `l` and `r` are the counts of the two sides of the lowest-scoring cut.
    """
    every, words = frequent_phrases(docs, longest=longest, least=least)
    known = every.select(F.col("phrase").alias("known"), F.col("f").alias("known_f"))
    # Largest element of a phrase's own stripe, and of the stripes that put one word before it.
    longer = every.where("size > 2").selectExpr("explode(array(slice(phrase, 1, size - 1), slice(phrase, 2, size - 1))) AS part", "f")
    around = longer.groupBy("part").agg(F.max("f").alias("widest"))
    free = every.where("size > 1").withColumnRenamed("f", "a").join(around, F.col("phrase") == F.col("part"), "left")
    free = free.where("widest IS NULL OR CAST(widest AS DECIMAL(20,0)) * 100 < CAST(a AS DECIMAL(20,0)) * 80")
    sides = free.selectExpr("phrase", "size", "a", "explode(sequence(1, size - 1)) AS k").selectExpr(
        "phrase", "a", "k", "slice(phrase, 1, k) AS first", "slice(phrase, k + 1, size - k) AS rest"
    )

    def count_of(frame: DataFrame, side: str, name: str) -> DataFrame:
        return frame.join(known, F.col(side) == F.col("known")).drop("known", side).withColumnRenamed("known_f", name)

    scored = count_of(count_of(sides, "first", "l"), "rest", "r").selectExpr(
        "phrase", "a", "k", "l", "r",
        "(CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS score",
    )
    lowest = scored.groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelt = words.where(F.col("n") >= least).select("lang", "word", "number")
    led = lowest.join(spelt.select("lang", F.col("number").alias("lead")), F.expr("phrase[0]") == F.col("lead"))
    # Shares of a language are ranked first, ties and all, so that few phrases are spelt and ranked in one place.
    shared = led.selectExpr("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", f"pmod(xxhash64(phrase), {RANK_SHARES}) AS share")
    near = shared.selectExpr("*", "rank() OVER (PARTITION BY lang, share ORDER BY score DESC, a DESC) AS near").where(F.col("near") <= top)
    apart = near.selectExpr("lang AS own_lang", "phrase", "a", "l", "r", "score", "posexplode(phrase) AS (place, spelling)")
    said = apart.join(spelt.select("word", "number"), F.col("spelling") == F.col("number")).groupBy("own_lang", "phrase", "a", "l", "r", "score")
    said = said.agg(F.expr("array_join(transform(array_sort(collect_list(struct(place, word))), w -> w.word), ' ')").alias("said"))
    ranked = said.selectExpr("*", "row_number() OVER (PARTITION BY own_lang ORDER BY score DESC, a DESC, said) AS rank")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.where(F.col("rank") <= top).join(totals, F.col("own_lang") == F.col("lang")).selectExpr(
        "lang", "CAST(rank AS BIGINT) AS rank", "said AS phrase", "a", "l", "r", "n", "CAST(score AS BIGINT) AS score"
    )


def op11_collocations(spark, folder: str) -> DataFrame:
    """The whole of `documents`."""
    return collocations(table(spark, folder, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) AS s(size)
  WHERE len(words) >= size),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS words, f AS a FROM f WHERE size > 1 AND f >= 30),
parts AS (
  SELECT lang, a, array_to_string(words[i:i + n - 1], ' ') AS part
  FROM candidates, (VALUES (1), (2), (3)) AS p(i), (VALUES (2), (3)) AS q(n)
  WHERE n < size AND i + n - 1 <= size),
widest AS (SELECT lang, part, max(a) AS widest FROM parts GROUP BY ALL),
free AS (
  SELECT c.* FROM candidates c LEFT JOIN widest x ON c.lang = x.lang AND c.phrase = x.part
  WHERE widest IS NULL OR 100 * CAST(widest AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r,
    CAST(2000000 * CAST(c.a AS HUGEINT) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM free c CROSS JOIN (VALUES (1), (2), (3)) AS t(k)
  JOIN f l ON l.lang = c.lang AND l.size = k AND l.phrase = array_to_string(c.words[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.size = c.size - k AND r.phrase = array_to_string(c.words[k + 1:], ' ')
  WHERE k < c.size),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
