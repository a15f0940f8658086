"""Near-duplicate documents: consistent weighted sampling of TF-IDF shingles, banded and verified.

A shingle is five words in a row (all words of a shorter text). Its weight in a document is its count
times its inverse document frequency `1 + ln(1 / max(share, RARE))`, share being the part of all
documents that hold it. Rare shingles thus weigh alike, and only the common ones need their exact
count. Those are found in two passes over all documents: counts per hash bucket, of which few can hold
a common shingle, then counts of the shingles in those buckets. Their number is bounded by the mean
number of shingles of a document over `RARE`.

1. Improved consistent weighted sampling draws `BANDS * ROWS` samples of each document; two documents
   agree on a sample with a chance equal to their weighted Jaccard similarity. Draws come from a fixed
   table, addressed anew for every sample.
2. Documents with the same words collapse to the one with the smallest id before anything is compared.
3. Documents that share a band are candidates. Every member of a bucket is compared with the bucket's
   smallest id, and only if that leaves several components in a bucket of three or more, its blocks
   meet pairwise and compare what is not yet joined. No pair leaves a task unless it links, so a bucket
   may hold any part of the corpus.
4. Candidates are verified by weighted Jaccard similarity over whole texts; links give components.

Rules. Texts without words and rows without id are in no class but their own and are kept. Rows that
share an id are one document. The smallest id of a component stays, and ids are distinct by then, so nothing ties. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import checkpoint, components, shuffle_partitions, table
from pageloom.llm.words import blank_kinds, constants, grams, hashes, mix, powers, slices, spans, whole

SHINGLE = 5
THRESHOLD = 0.8
LEAST = THRESHOLD - 1e-9  # sums of weights are rounded; a pair at the threshold itself is linked
BANDS, ROWS = 12, 4
RARE = 1 / 1000
TABLE_BITS, MOST_BITS, TILE_BITS = 21, 24, 13  # buckets at least and at most, as bits; of a tile
DRAW_BITS = 16
STAR, BLOCK = 500, 128  # members per part of a star; per block of a bucket
SLICE = 1 << 18


@dataclass(frozen=True)
class Weights:
    """Inverse document frequencies: the buckets that hold common shingles, these and their values."""

    buckets: np.ndarray
    shingles: np.ndarray
    values: np.ndarray
    rare: float

    def of(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(shingles), self.rare)
        at = np.flatnonzero(self.buckets[shingles >> _shift(self.buckets)])
        if len(self.shingles) and len(at):
            place = np.minimum(np.searchsorted(self.shingles, shingles[at]), len(self.shingles) - 1)
            same = self.shingles[place] == shingles[at]
            out[at[same]] = self.values[place[same]]
        return out


def _shift(table: np.ndarray) -> np.uint64:
    """How far to shift a hash so that it numbers the buckets of a table of 2^n of them."""
    return np.uint64(65 - len(table).bit_length())


def shingles(data: np.ndarray, offsets: np.ndarray):
    """(distinct shingles of each text in order, their counts, first of each text, two keys of its words)."""
    starts, ends, first = spans(data, offsets, blank_kinds())
    h = hashes(data, starts, ends)
    count = np.diff(first)
    ok = np.flatnonzero(whole(first, SHINGLE, max(0, len(h) - SHINGLE + 1)))
    values, text = [grams(h, SHINGLE)[ok]], [np.searchsorted(first[1:-1], ok, "right")]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(count == n)
        if len(short):
            values.append(grams(h, n)[first[short]])
            text.append(short)
    values, text = np.concatenate(values), np.concatenate(text)
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(values)))
    keys = []
    for seed in (3, 5):
        total = np.zeros(len(h) + 1, np.uint64)
        if len(h):
            up, inverses = powers(len(h) + 1)
            np.cumsum(mix(h + np.uint64(seed)) * up[: len(h)], out=total[1:])
            keys.append(mix((total[first[1:]] - total[first[:-1]]) * inverses[first[:-1]] + count.astype(np.uint64)))
        else:
            keys.append(np.zeros(len(count), np.uint64))
    return values[at], counts, np.searchsorted(text[at], np.arange(len(offsets))), keys


def _bucket_counts(bits: int):
    """Documents per hash bucket, as compressed tiles of the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, data, offsets in slices(batch.column(0), SLICE):
                values = shingles(data, offsets)[0]
                at, n = np.unique(values >> _shift(counts), return_counts=True)
                counts[at] += n.astype(np.uint32)
        tiles = counts.reshape(-1, 1 << TILE_BITS)
        some = np.flatnonzero(tiles.any(1))
        yield pa.record_batch(
            [pa.array(some, pa.int32()), pa.array([zlib.compress(tiles[i].tobytes(), 1) for i in some], pa.binary())],
            names=["tile", "counts"],
        )

    return count


def _crowded_tiles(least: float):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, total = None, None

        def bits() -> pa.RecordBatch:
            return pa.record_batch([pa.array([tile], pa.int32()), pa.array([np.packbits(total > least).tobytes()])], names=["tile", "bits"])

        for batch in batches:
            for number, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != tile:
                    if tile is not None:
                        yield bits()
                    tile, total = number, np.zeros(1 << TILE_BITS, np.int64)
                total += np.frombuffer(zlib.decompress(counts), np.uint32)
        if tile is not None:
            yield bits()

    return add


def _candidate_counts(buckets):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded = buckets.value
        for batch in batches:
            for _, data, offsets in slices(batch.column(0), SLICE):
                values = shingles(data, offsets)[0]
                at, n = np.unique(values[crowded[values >> _shift(crowded)]], return_counts=True)
                if len(at):
                    yield pa.record_batch([pa.array(at.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    return count


def weights(docs: DataFrame) -> Weights:
    """Document frequencies over all documents."""
    spark = docs.sparkSession
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("decimal(20,0)")), F.lit(0))).head()
    # Enough buckets that one holds a quarter of the threshold on average, a word taken as six bytes; 64 MB a task at most.
    mean = float(size) / max(total, 1) / 6
    bits = min(MOST_BITS, max(TABLE_BITS, int(np.ceil(np.log2(max(4 / RARE * mean, 1))))))
    texts = docs.select("text")
    tiles = texts.mapInArrow(_bucket_counts(bits), "tile int, counts binary")
    tiles = tiles.repartition(shuffle_partitions(spark), "tile").sortWithinPartitions("tile")
    crowded = np.zeros((1 << bits - TILE_BITS, 1 << TILE_BITS), bool)
    for tile, bits in tiles.mapInArrow(_crowded_tiles(total * RARE), "tile int, bits binary").collect():  # one bit a bucket
        crowded[tile] = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
    crowded = crowded.ravel()
    shared = spark.sparkContext.broadcast(crowded)
    found = texts.mapInArrow(_candidate_counts(shared), "shingle long, n long")
    found = found.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > total * RARE).toArrow()
    shared.destroy()
    common, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(common)
    values = 1 + np.log(total / np.maximum(n[order], 1))
    return Weights(crowded, common[order], values, 1 - float(np.log(RARE)))


def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and ln c of Gamma(2, 1) variables and uniform beta."""
    rng = np.random.default_rng(42)
    n = 1 << DRAW_BITS
    return rng.gamma(2, 1, n), np.log(rng.gamma(2, 1, n)), rng.random(n)


def sketch(values: np.ndarray, weight: np.ndarray, first: np.ndarray, usual: float, samples: int) -> np.ndarray:
    """Sample identities, one row per text that has shingles."""
    r, ln_c, beta = draws()
    log = np.log(weight)
    step = np.floor(np.log(usual) / r + beta)
    score = (ln_c - r * (step - beta) - r).astype(np.float32)
    other = np.flatnonzero(np.abs(weight - usual) > 1e-12)
    starts, sizes = first[:-1], np.diff(first)
    out = np.empty((len(starts), samples), np.uint64)
    for k, odd in enumerate(constants(samples, 17)):
        at = ((values * odd) >> np.uint64(64 - DRAW_BITS)).astype(np.int32)
        a = score[at]
        t = None
        if len(other):
            o = at[other]
            t = np.floor(log[other] / r[o] + beta[o])
            a[other] = ln_c[o] - r[o] * (t - beta[o]) - r[o]
        least = np.minimum.reduceat(a, starts)
        hits = np.flatnonzero(a == np.repeat(least, sizes))
        won = hits[np.searchsorted(hits, starts)]
        steps = step[at[won]]
        if t is not None:
            place = np.minimum(np.searchsorted(other, won), len(other) - 1)
            steps = np.where(other[place] == won, t[place], steps)
        out[:, k] = mix(values[won] + steps.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _sketches(shared):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = Weights(*shared.value)
        multipliers = constants(ROWS, 23)
        for batch in batches:
            for row, data, offsets in slices(batch.column(1), SLICE):
                values, counts, first, keys = shingles(data, offsets)
                some = np.flatnonzero(np.diff(first))
                if not len(some):
                    continue
                drawn = sketch(values, counts * idf.of(values), np.append(first[some], len(values)), idf.rare, BANDS * ROWS)
                bands = (drawn.reshape(len(some), BANDS, ROWS) * multipliers).sum(2, dtype=np.uint64)
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(bands.ravel().view(np.int64)))
                ids = batch.column(0).slice(row, len(offsets) - 1).take(pa.array(some))
                yield pa.record_batch(
                    [ids, *(pa.array(k[some].view(np.int64)) for k in keys), lists], names=["doc", "k1", "k2", "bands"]
                )

    return make


def similarity(a, b) -> float:
    """Weighted Jaccard of two documents as (shingles, weights, total weight)."""
    low = min(a[2], b[2])
    if low < LEAST * max(a[2], b[2]):
        return 0.0
    x, y = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    place = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    same = y[0][place] == x[0]
    both = np.minimum(x[1][same], y[1][place[same]]).sum()
    return float(both / (a[2] + b[2] - both))


def _vectors(texts: pa.Array, idf: Weights) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(shingles, weights, total weight) of each text, a slice at a time."""
    for _, data, offsets in slices(texts, SLICE):
        values, counts, first, _ = shingles(data, offsets)
        weight = counts * idf.of(values)
        for i, j in zip(first[:-1], first[1:], strict=True):
            # Copies, so that a vector that is kept does not keep its slice.
            yield values[i:j].copy(), weight[i:j].copy(), float(weight[i:j].sum())


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stars(shared):
    """Links of members with the centre that precedes them."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = Weights(*shared.value)
        centre, vector = None, None
        for batch in batches:
            found = []
            hubs, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for hub, doc, own in zip(hubs, docs, _vectors(batch.column(2), idf), strict=True):
                if hub == doc:
                    centre, vector = hub, own
                elif hub == centre and similarity(vector, own) >= LEAST:
                    found.append((doc, hub))
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=LINK)

    return verify


def _blocks(shared):
    """Links within a cell of a bucket, of documents that are not joined yet."""

    def cell(rows: list[tuple]) -> list[tuple[int, int]]:
        low, high = rows[0][1], rows[0][2]
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        found = []
        rows.sort(key=lambda r: r[6][2])
        for i, (band, _, _, block, doc, component, own, bands) in enumerate(rows):
            for j in range(i - 1, -1, -1):
                other = rows[j]
                if other[6][2] < LEAST * own[2]:  # and all before it
                    break
                if low != high and other[3] == block or root(component) == root(other[5]):
                    continue
                # A pair that shares several bands is compared in the first.
                if next(x for x, y in zip(bands, other[7], strict=True) if x == y) != band:
                    continue
                if similarity(own, other[6]) >= LEAST:
                    found.append((doc, other[4]))
                    joined[root(component)] = root(other[5])
        return found

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = Weights(*shared.value)
        held: list[tuple] = []
        for batch in batches:
            found = []
            columns = [c.to_pylist() for c in batch.columns[:6]]
            vectors = _vectors(batch.column(6), idf)
            for row in zip(*columns, vectors, batch.column(7).to_pylist(), strict=True):
                if held and held[0][:3] != row[:3]:
                    found += cell(held)
                    held = []
                held.append(row)
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=LINK)
        if held and (found := cell(held)):
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=LINK)

    return verify


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links `(a, b)` between documents with different words, and `(doc, rep)` of all with words."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    idf = weights(docs)
    shared = spark.sparkContext.broadcast((idf.buckets, idf.shingles, idf.values, idf.rare))
    drawn = docs.where("doc IS NOT NULL").mapInArrow(_sketches(shared), "doc long, k1 long, k2 long, bands array<long>")
    drawn = checkpoint(drawn)
    smallest = drawn.groupBy("k1", "k2").agg(F.min("doc").alias("rep"))
    members = checkpoint(drawn.select("doc", "k1", "k2").join(smallest, ["k1", "k2"]).select("doc", "rep"))
    reps = members.where("doc = rep").select("rep").distinct()
    banded = drawn.join(reps, F.col("doc") == F.col("rep"), "left_semi").select("doc", "bands")
    buckets = banded.select("doc", F.explode("bands").alias("band"))
    crowded = buckets.groupBy("band").agg(F.count("*").alias("n"), F.min("doc").alias("hub")).where("n > 1")
    buckets = checkpoint(buckets.join(crowded, "band"))
    # Stars: every member against the smallest id of its bucket.
    pairs = buckets.where("doc <> hub").select("doc", "hub").distinct()
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("m"))
    pairs = pairs.join(sizes, "hub").selectExpr("doc", "hub", f"pmod(xxhash64(doc), ceil(m / {STAR})) AS part")
    centres = sizes.selectExpr("hub AS doc", "hub", f"explode(sequence(0L, ceil(m / {STAR}) - 1)) AS part")
    texts = docs.select(F.col("doc").alias("id"), "text").where("id IS NOT NULL")
    stars = (
        texts.join(pairs.unionByName(centres), F.col("id") == F.col("doc"))
        .select("hub", "part", "doc", "text")
        .repartition(parts, "hub", "part")
        .sortWithinPartitions("hub", "part", F.col("doc") != F.col("hub"))
        .select("hub", "doc", "text")
        .mapInArrow(_stars(shared), "a long, b long")
    )
    found = checkpoint(stars)
    # What stars leave open: buckets of three and more with several components.
    classes = components(found)
    known = buckets.join(classes, F.col("doc") == F.col("node"), "left").select(
        "band", "doc", "n", F.coalesce("component", "doc").alias("component")
    )
    open_ = known.where("n > 2").groupBy("band").agg(F.min("component").alias("c"), F.max("component").alias("d"))
    known = checkpoint(known.join(open_.where("c <> d").select("band"), "band", "left_semi"))
    if known.isEmpty():
        shared.destroy()
        return found, members
    cells = (
        known.withColumn("blocks", F.expr(f"ceil(n / {BLOCK})"))
        .withColumn("block", F.expr("pmod(xxhash64(doc), blocks)"))
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc", "component")
    )
    cells = cells.join(banded, "doc").join(texts, F.col("doc") == F.col("id"))
    more = (
        cells.select("band", "low", "high", "block", "doc", "component", "text", "bands")
        .repartition(parts, "band", "low", "high")
        .sortWithinPartitions("band", "low", "high")
        .mapInArrow(_blocks(shared), "a long, b long")
    )
    both = checkpoint(found.union(more))
    shared.destroy()
    return both, members


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, class_id, kept), one row per document: the smallest id of its class, and whether it is it."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    found, members = links(rows)
    # Rows that share an id are one document, whatever their texts.
    classes = components(found.union(members.select("doc", "rep")))
    out = rows.select("doc").join(classes, F.col("doc") == F.col("node"), "left")
    class_id = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias("doc_id"), class_id.alias("class_id"), F.coalesce(class_id == F.col("doc"), F.lit(True)).alias("kept"))


def op5_minhash(spark, folder: str) -> DataFrame:
    """All documents, five words, similarity 0.8 and more."""
    return near_duplicates(table(spark, folder, "documents"))
