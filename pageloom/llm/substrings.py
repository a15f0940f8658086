"""Substring dedup: sorted suffixes in groups that share a prefix, of which deep nodes of the suffix tree are repeats.

A suffix starts at every word that has `WINDOW` words of its document before it; it matters no
further than that. Suffixes with equal first `WINDOW` words lie below one node of the suffix tree, at
depth `WINDOW` or more: a deep node. A window is repeated if its deep node holds a smaller document.

1. Groups. All prefixes of `WINDOW` words that are equal have the same least hash of `SEED` words in
   them, their anchor. Suffixes in a row that share an anchor travel as one piece of text, some 70 words
   for 22 suffixes, where groups by the first words alone would ship every word once per suffix.
   Anchors that lie in one document only have no deep node and are dropped before any text moves.
2. Subtrees. A task takes anchors in order, as many as fit its memory, and ranks their suffixes by prefixes of doubling
   length, words by words and not by hashes. Suffixes of one rank lie below one node; branches that hold one document end
   there. What is left at depth `WINDOW` are the deep nodes, and runs of suffixes below deep nodes are the
   repeats at their full length. Nodes are the ranks; no pointers are built.
3. Anchors of more than `HEAVY` documents or `HEAVY_BYTES` of pieces would make a group too large for a task. There the prefix that
   splits the suffixes is as long as the window, so every group is one deep node, named by two 64-bit hashes, and its smallest
   document is a grouped minimum.

Rules. Words are `[^\\x20\\x09-\\x0D]+`, unchanged; null text has none. Windows are judged on the input.
Rows that share an id do not repeat each other, rows without id repeat nothing and are not repeated.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import shuffle_partitions, table
from pageloom.llm.tally import word_strings
from pageloom.llm.words import blank_kinds, hashes, mix, rolling, slices, spans, whole

WINDOW = 50
SEED = 8
HEAVY = 5000
HEAVY_BYTES = 8 << 20
GROUP_BYTES = 1 << 20


def least(values: np.ndarray, n: int) -> np.ndarray:
    """Smallest of each n consecutive values."""
    width = 1
    while width * 2 <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = n - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchored(data: np.ndarray, offsets: np.ndarray):
    """Words (starts, ends, hashes, first of each text) and pieces (first window, windows, anchor, text)."""
    starts, ends, first = spans(data, offsets, blank_kinds())
    h = hashes(data, starts, ends)
    count = max(0, len(h) - WINDOW + 1)
    if not count:
        none = np.zeros(0, np.int64)
        return starts, ends, h, first, none, none, none.view(np.uint64), none
    anchor = least(rolling(h, SEED), WINDOW - SEED + 1)
    windows = np.flatnonzero(whole(first, WINDOW, count))
    text = np.searchsorted(first[1:-1], windows, "right")
    anchor = anchor[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return starts, ends, h, first, windows[at], np.diff(np.append(at, len(windows))), anchor[at], text[at]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in slices(batch.column(2)):
            starts, ends, _, _, window, many, anchor, text = anchored(data, offsets)
            order = np.lexsort((anchor, text))
            size = (ends[window + many + WINDOW - 2] - starts[window])[order]
            anchor, text = anchor[order], text[order]
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            place = pa.array(text[new] + row)
            size = np.add.reduceat(size, np.flatnonzero(new)) if len(size) else size
            yield pa.record_batch(
                [batch.column(0).take(place), batch.column(1).take(place), pa.array(anchor[new].view(np.int64)), pa.array(size, pa.int64())],
                names=["doc", "body", "anchor", "size"],
            )


def _chosen(lists: pa.Array, row: int, rows: int, anchor: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which pieces have an anchor in their row's list."""
    out = np.zeros(len(anchor), bool)
    bounds = np.searchsorted(text, np.arange(rows + 1))
    for i in range(rows):
        wanted = lists[row + i].values
        if wanted is not None and len(wanted) and bounds[i] < bounds[i + 1]:
            mine = slice(bounds[i], bounds[i + 1])
            out[mine] = np.isin(anchor[mine].view(np.int64), wanted.to_numpy())
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of every piece whose anchor is shared."""
    for batch in batches:
        for row, data, offsets in slices(batch.column(2)):
            starts, ends, _, first, window, many, anchor, text = anchored(data, offsets)
            at = np.flatnonzero(_chosen(batch.column(3), row, len(offsets) - 1, anchor, text))
            window, many, text = window[at], many[at], text[at]
            low, high = starts[window], ends[window + many + WINDOW - 2]
            raw = data.tobytes()
            place = pa.array(text + row)
            yield pa.record_batch(
                [
                    pa.array(anchor[at].view(np.int64)),
                    batch.column(0).take(place),
                    batch.column(1).take(place),
                    pa.array(window - first[text]),
                    pa.array([raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.binary()).cast(pa.string()),
                ],
                names=["anchor", "doc", "body", "at", "piece"],
            )


def deep_nodes(words: np.ndarray, suffix: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which suffixes, by start among the words, share their first WINDOW words with a smaller document.

    `words` are numbers, equal where the words are. Suffixes are ranked by their first 1, 2, 4, ... words, each rank made of the two
    ranks before it, so ranks are exact and in order; suffixes of one rank lie below one node of the tree at that
    depth. Branches that hold one document end there.
    """
    ranks, depth = np.unique(words, return_inverse=True)[1], 1
    active = np.arange(len(suffix))

    def longer(ranks: np.ndarray, by: int) -> np.ndarray:
        both = ranks[: len(ranks) - by].astype(np.int64) * (int(ranks.max(initial=0)) + 1) + ranks[by:]
        return np.unique(both, return_inverse=True)[1]

    def shared(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes whose node holds several documents, and those above the node's smallest."""
        order = np.lexsort((docs, values))
        v, d = values[order], docs[order]
        start = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(start, len(v)))
        low, high = np.repeat(d[start], sizes), np.repeat(d[start + sizes - 1], sizes)
        return order[low != high], order[d > low]

    while depth * 2 <= WINDOW:
        ranks = longer(ranks, depth)
        depth *= 2
        if depth >= SEED:
            keep, _ = shared(ranks[suffix[active]], docs[active])
            active = active[keep]
    if depth < WINDOW:
        ranks = longer(ranks, WINDOW - depth)
    _, repeated = shared(ranks[suffix[active]], docs[active])
    out = np.zeros(len(suffix), bool)
    out[active[repeated]] = True
    return out


def _repeats(rows: pa.RecordBatch) -> pa.RecordBatch:
    """(doc, body, from, to): runs of words that repeated windows of these pieces cover."""
    docs, at = rows.column(1).to_numpy(), rows.column(3).to_numpy()
    ((_, data, offsets),) = slices(rows.column(4), 1 << 62)
    starts, ends, first = spans(data, offsets, blank_kinds())
    many = np.diff(first) - WINDOW + 1
    piece = np.repeat(np.arange(len(many)), many)
    inner = np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
    suffix = first[piece] + inner
    # Pieces of other anchors cannot share a window, so all subtrees are built at once.
    words = word_strings(data, starts, ends).dictionary_encode().indices.to_numpy()
    hit = np.flatnonzero(deep_nodes(words, suffix, docs[piece]))
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (piece[hit[1:]] != piece[hit[:-1]])
    run = np.flatnonzero(new)
    length = np.diff(np.append(run, len(hit)))
    own, begin = piece[hit[run]], at[piece[hit[run]]] + inner[hit[run]]
    place = pa.array(own)
    return pa.record_batch(
        [rows.column(1).take(place), rows.column(2).take(place), pa.array(begin), pa.array(begin + length + WINDOW - 1)],
        names=["doc", "body", "from", "to"],
    )


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """All rows in one batch; offsets of 64 bits, as those of 32 end at 2 GB of pieces."""
    whole = pa.Table.from_batches(batches)
    at = whole.schema.get_field_index("piece")
    whole = whole.set_column(at, "piece", whole.column(at).cast(pa.large_string())).combine_chunks()
    (out,) = whole.to_batches()
    return out


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def groups(last: bool) -> Iterator[pa.RecordBatch]:
        rows = joined(held)
        anchor = rows.column(0).to_numpy()
        size = np.cumsum(pc.binary_length(rows.column(4)).to_numpy())
        borders = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        ends = [*borders.tolist(), len(anchor)] if last else borders.tolist()
        row = 0
        for border in ends:
            if border == ends[-1] or size[border] - (size[row - 1] if row else 0) > GROUP_BYTES:
                yield _repeats(rows.slice(row, border - row))
                row = border
        held.clear()
        if row < len(anchor):
            held.append(rows.slice(row))

    for batch in batches:
        if batch.num_rows:
            held.append(joined([batch]))
            yield from groups(False)
    if held:
        yield from groups(True)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, doc, body, at): every window of a heavy anchor, by its whole prefix."""
    for batch in batches:
        for row, data, offsets in slices(batch.column(2)):
            _, _, h, first, window, many, anchor, text = anchored(data, offsets)
            at = np.flatnonzero(_chosen(batch.column(3), row, len(offsets) - 1, anchor, text))
            inner = np.arange(many[at].sum()) - np.repeat(np.cumsum(many[at]) - many[at], many[at])
            start, own = np.repeat(window[at], many[at]) + inner, np.repeat(text[at], many[at])
            place = pa.array(own + row)
            keys = [rolling(x, WINDOW)[start].view(np.int64) if len(start) else start for x in (h, mix(h + np.uint64(3)))]
            yield pa.record_batch(
                [*(pa.array(k) for k in keys), batch.column(0).take(place), batch.column(1).take(place), pa.array(start - first[own])],
                names=["k1", "k2", "doc", "body", "at"],
            )


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, body, spans): word ranges of documents `(doc, body, text)` that repeat a smaller document."""
    parts = shuffle_partitions(docs.sparkSession)
    found = docs.where("doc IS NOT NULL").mapInArrow(_anchors, "doc long, body long, anchor long, size long")
    shared = found.groupBy("anchor").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n"), F.sum("size").alias("bytes")
    )
    shared = shared.where("low <> high").select("anchor", F.expr(f"n > {HEAVY} OR bytes > {HEAVY_BYTES}").alias("heavy"))
    lists = found.drop("size").join(shared, "anchor").groupBy("doc", "body").agg(
        F.collect_list(F.when(~F.col("heavy"), F.col("anchor"))).alias("light"),
        F.collect_list(F.when(F.col("heavy"), F.col("anchor"))).alias("heavy"),
    )
    lists = lists.withColumnsRenamed({"doc": "d", "body": "b"})
    # Null-safe, so that both joins with the texts can use one exchange.
    texts = docs.join(lists, F.col("doc").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")))
    pieces = texts.where("size(light) > 0").select("doc", "body", "text", "light")
    pieces = pieces.mapInArrow(_texts, "anchor long, doc long, body long, at long, piece string")
    light = (
        pieces.repartition(parts, "anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_subtrees, "doc long, body long, `from` long, `to` long")
    )
    windows = texts.where("size(heavy) > 0").select("doc", "body", "text", "heavy")
    windows = windows.mapInArrow(_windows, "k1 long, k2 long, doc long, body long, at long")
    nodes = windows.groupBy("k1", "k2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high")
    heavy = windows.join(nodes, ["k1", "k2"]).where("doc > low").selectExpr("doc", "body", "at AS `from`", f"at + {WINDOW} AS `to`")
    spans_ = light.unionByName(heavy).groupBy("doc", "body").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("spans"))
    return spans_.withColumnsRenamed({"doc": "d", "body": "b"})


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, totals, removed = [], [], []
        for text, ranges in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            totals.append(len(words))
            if ranges:
                kept, at = [], 0
                for r in ranges:
                    kept += words[at : max(at, r["from"])]
                    at = max(at, r["to"])
                words = kept + words[at:]
            removed.append(totals[-1] - len(words))
            texts.append(b" ".join(words))
        yield pa.record_batch(
            [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), batch.column(2)],
            names=["doc_id", "text", "n_words", "n_removed", "spans"],
        )


def without_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed, spans): kept words joined by one space, and the word ranges removed."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.xxhash64(text_column).alias("body"), F.col(text_column).alias("text"))
    found = repeats(rows)
    marked = rows.join(found, F.col("doc").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")), "left")
    ranges = "array<struct<`from`:bigint,`to`:bigint>>"
    return marked.select("doc", "text", "spans").mapInArrow(
        _kept, f"doc_id long, text string, n_words long, n_removed long, spans {ranges}"
    )


def op2_substrings(spark, folder: str) -> DataFrame:
    """All documents, windows of 50 words."""
    kept = without_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d)),
f AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
b AS (SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS i FROM w JOIN f USING (win) WHERE doc_id > first),
g AS (SELECT doc_id, list(i) AS gone FROM b GROUP BY doc_id),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d),
k AS (SELECT p.doc_id, string_agg(words[p.i], ' ' ORDER BY p.i) AS kept FROM p ANTI JOIN b ON p.doc_id = b.doc_id AND p.i = b.i GROUP BY p.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
