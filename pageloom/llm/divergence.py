"""Divergence of sources by run-length columns: every pair of sources of a language, and each source's own terms.

The kept terms of a language are dealt to blocks by the size of their total count, and large sizes by hash, so a
block has about `BLOCK` terms whatever the vocabulary. Within a block they are ordered by total and by a signature of their counts
in all sources, which brings equal counts together. A source's column of a block is then a few runs:
equal values side by side, and the terms it lacks between them. A pair's value is read off the runs: the
boundaries of both columns are intersected, and f at each piece is multiplied by the piece's length. Columns meet
in tiles of about `TILE` sources, so no task holds all sources of a language or all of its terms.

Tasks count what they read before anything is shuffled; counts per (lang, source, term) meet before the terms do, so
neither a large source nor a frequent term collects rows of the texts.

Rules. Null text, lang and source are ''. Terms are runs of letters A-Z, a-z and characters beyond ASCII, A-Z lower-cased. A
term is kept where at least `least` rows of its language have it; rows count each, repeated or not. A
language without kept terms has pairs of value 0. Equal values rank by the item's bytes. Empty tables give no rows. Columns other
than `text`, `lang` and `source` are not read. All arithmetic is on integers; products that may pass 64 bits are decimals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import materialised, table
from pageloom.llm.tally import Held, Tally, lower_ascii, word_strings
from pageloom.llm.words import hashes, mix, slices, spans

LEAST = 30
TOP_TERMS = 50
SMOOTH = 5
SCALE = 1_000_000_000
BLOCK = 1 << 16
TILE = 64
_RUNS = T.StructType(
    [T.StructField("stop", T.ArrayType(T.IntegerType())), T.StructField("p", T.ArrayType(T.LongType()))]
)


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[0x80:] = 1
    kinds[0x41:0x5B] = 1
    kinds[0x61:0x7B] = 1
    return kinds


def _group_keys(lang: pa.Array, source: pa.Array) -> np.ndarray:
    """A 64-bit key of each row's (lang, source)."""
    seen: dict[tuple[str, str], int] = {}

    def key(pair: tuple[str, str]) -> int:
        if pair not in seen:
            text = f"{len(pair[0])}:{pair[0]}{pair[1]}".encode()
            seen[pair] = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")
        return seen[pair]

    return np.array([key(p) for p in zip(lang.to_pylist(), source.to_pylist(), strict=True)], np.uint64)


def _emit(held: Held | None) -> Iterator[pa.RecordBatch]:
    if held is not None:
        (n, d), (lang, source, term) = held.sums, held.labels
        columns = [lang, source, term.cast(pa.string()), pa.array(n), pa.array(d)]
        yield pa.record_batch(columns, names=["lang", "source", "term", "n", "d"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally()
    for batch in batches:
        keys = _group_keys(batch.column(1), batch.column(2))
        for row, data, offsets in slices(batch.column(0)):
            lower = lower_ascii(data)
            starts, ends, first = spans(lower, offsets, _kinds())
            text = np.searchsorted(first[1:-1], np.arange(len(starts)), "right")
            key = mix(hashes(lower, starts, ends) ^ keys[row + text])
            order = np.argsort(key, kind="stable")
            key, text = key[order], text[order]
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            # Sorting is stable, so the rows of one key follow the texts.
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])]) if len(key) else np.zeros(0, bool)
            n = np.diff(np.append(cut, len(key)))
            d = np.add.reduceat(fresh.astype(np.int64), cut) if len(key) else n
            at = pa.array(row + text[cut])
            terms = word_strings(lower, starts, ends).take(pa.array(order[cut]))
            if tally.add(key[cut], [n, d], [batch.column(1).take(at), batch.column(2).take(at), terms]):
                yield from _emit(tally.drain())
    yield from _emit(tally.drain())


def kept_terms(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """`lang, source, term, n, total, sig, d`: occurrences of the kept terms; total and signature are the term's."""
    texts = docs.selectExpr("text", "coalesce(lang, '') AS lang", "coalesce(source, '') AS source")
    counted = texts.mapInArrow(_counted, "lang string, source string, term string, n long, d long")
    counts = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    of_term = "OVER (PARTITION BY lang, term)"
    return counts.selectExpr(
        "lang", "source", "term", "n",
        f"sum(n) {of_term} AS total", f"bit_xor(xxhash64(source, n)) {of_term} AS sig", f"sum(d) {of_term} AS d",
    ).where(F.col("d") >= least)


def placed_terms(kept: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """`lang, source, term, n, total, level, part, pos`: the block (lang, level, part) of each term and its place there."""
    levelled = kept.withColumn("level", F.length(F.bin("total")))
    sizes = levelled.groupBy("lang", "level").agg(F.ceil(F.approx_count_distinct("term") / block).alias("parts"))
    dealt = levelled.join(sizes, ["lang", "level"]).selectExpr(
        "lang", "source", "term", "n", "total", "sig", "level", "pmod(xxhash64(term), parts) AS part"
    )
    place = "dense_rank() OVER (PARTITION BY lang, level, part ORDER BY total, sig, term) - 1 AS pos"
    return dealt.selectExpr("lang", "source", "term", "n", "total", "level", "part", place)


def share_sql(count: str, total: str, terms: str) -> str:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms))"""
    above = f"CAST({SCALE} AS DECIMAL(10,0)) * (CAST({count} AS DECIMAL(20,0)) + {SMOOTH})"
    return f"1 + ({above}) div (CAST({total} AS DECIMAL(20,0)) + CAST({terms} AS DECIMAL(16,0)) * {SMOOTH})"


@F.arrow_udf(_RUNS)
def run_lengths(length: pa.Array, base: pa.Array, runs: pa.Array) -> pa.Array:
    """Runs of equal value of a whole block, as their ends and values; places that `runs` lacks have the base value."""
    stops, values = [], []
    for n, low, own in zip(length.to_pylist(), base.to_pylist(), runs, strict=True):
        column = np.full(n, low or 0, np.int64)
        if own.is_valid and len(own.values):
            fields = own.values.flatten()
            column[fields[0].to_numpy()] = fields[1].to_numpy()
        last = np.flatnonzero(np.append(column[1:] != column[:-1], True)) if n else np.zeros(0, np.int64)
        stops.append((last + 1).astype(np.int32))
        values.append(column[last])
    return pa.StructArray.from_arrays(
        [pa.array(stops, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64()))], names=["stop", "p"]
    )


def run_distance(stop: np.ndarray, p: np.ndarray, other_stop: np.ndarray, q: np.ndarray) -> int:
    """Sum of |p - q| over all places, from the pieces between the boundaries of both."""
    bounds = np.union1d(stop, other_stop)
    length = np.diff(bounds, prepend=0)
    f = np.abs(p[np.searchsorted(stop, bounds)] - q[np.searchsorted(other_stop, bounds)])
    return int((f * length).sum())


def _tile_pairs(block: pa.Table) -> pa.Table:
    """`lang, a, b, value` of the pairs of one block and one pair of tiles."""
    rows = block.select(["lang", "source", "tile", "low", "high", "stop", "p"]).combine_chunks()
    lang, low, high = (rows[c][0].as_py() for c in ("lang", "low", "high"))
    read = [
        (source, tile, np.asarray(stop.values), np.asarray(p.values))
        for source, tile, stop, p in zip(rows["source"].to_pylist(), rows["tile"].to_pylist(), rows["stop"], rows["p"], strict=True)
    ]
    if low == high:
        pairs = list(combinations(read, 2))
    else:
        pairs = [(x, y) for x in read if x[1] == low for y in read if y[1] == high]
    out = [(*sorted((x[0], y[0])), run_distance(x[2], x[3], y[2], y[3])) for x, y in pairs]
    a, b, value = zip(*out, strict=True) if out else ((), (), ())
    return pa.table(
        [pa.array([lang] * len(out), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64())],
        names=["lang", "a", "b", "value"],
    )


def divergence(docs: DataFrame, *, least: int = LEAST, top: int = TOP_TERMS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """`lang, source, part, item, value, rank`: parts `pair` (every other source) and `term` (the `top` terms above the language)."""
    terms = materialised(placed_terms(kept_terms(docs, least=least), block=block))
    blocks = terms.groupBy("lang", "level", "part").agg((F.max("pos") + 1).alias("length"))
    sizes = blocks.groupBy("lang").agg(F.sum("length").alias("v"))
    counts = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.selectExpr("coalesce(lang, '') AS lang", "coalesce(source, '') AS source").distinct()
    groups = groups.join(sizes, "lang", "left").join(counts, ["lang", "source"], "left")
    groups = materialised(
        groups.selectExpr(
            "lang", "source", "v", "coalesce(total, 0) AS total", f"CASE WHEN v > 0 THEN {share_sql('0', 'coalesce(total, 0)', 'v')} END AS base"
        )
    )
    of_source = groups.select("lang", "source", "v", F.col("total").alias("source_total"))
    shares = terms.join(of_source, ["lang", "source"]).withColumn("p", F.expr(share_sql("n", "source_total", "v")))

    # A language without kept terms takes part with one block of no places.
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    spread = tiles.join(blocks, "lang", "left").selectExpr(
        "lang", "tiles", "coalesce(level, 0) AS level", "coalesce(part, 0) AS part", "coalesce(length, 0) AS length"
    )
    own = shares.groupBy("lang", "source", "level", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "p"))).alias("runs"))
    columns = groups.select("lang", "source", "base").join(spread, "lang").join(own, ["lang", "source", "level", "part"], "left")
    columns = columns.withColumn("run", run_lengths("length", "base", "runs")).selectExpr(
        "lang", "level", "part", "source", "pmod(xxhash64(source), tiles) AS tile", "tiles", "run.stop AS stop", "run.p AS p"
    )
    tiled = columns.selectExpr("*", "explode(sequence(0, tiles - 1)) AS other").selectExpr(
        "lang", "level", "part", "source", "tile", "least(tile, other) AS low", "greatest(tile, other) AS high", "stop", "p"
    )
    met = tiled.groupBy("lang", "level", "part", "low", "high").applyInArrow(_tile_pairs, "lang string, a string, b string, value long")
    pairs = met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.selectExpr("lang", "inline(array(struct(a AS source, b AS item), struct(b AS source, a AS item)))", "value")
    order = "PARTITION BY lang, source ORDER BY value DESC, item"
    ranked = both.selectExpr("lang", "source", "'pair' AS part", "item", "value", f"row_number() OVER ({order}) AS rank")

    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    above = shares.join(whole, "lang").withColumn("q", F.expr(share_sql("total", "lang_total", "v"))).where("n > 0 AND p > q")
    above = above.selectExpr("lang", "source", "'term' AS part", "term AS item", "p - q AS value")
    named = above.selectExpr("*", f"row_number() OVER ({order}) AS rank").where(F.col("rank") <= top)
    return ranked.unionByName(named)


def op13_divergence(spark, folder: str) -> DataFrame:
    """The whole of `documents`."""
    return divergence(table(spark, folder, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT)) // CAST(coalesce(s.total, 0) + 5 * v.v AS HUGEINT) AS BIGINT) AS p
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
  SELECT lang, term,
    CAST(1 + (1000000000 * CAST(sum(n) + 5 AS HUGEINT)) // CAST(any_value(total) + 5 * any_value(v) AS HUGEINT) AS BIGINT) AS q
  FROM c JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT x.lang, x.source, y.source AS item FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source),
sums AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
  FROM grid x JOIN grid y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pair AS (
  SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM grid JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
