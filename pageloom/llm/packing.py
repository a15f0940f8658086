"""Best-fit packing of token sequences by bin completion.

1. Documents are tokenised and cut in Arrow batches; only one piece of a document can be shorter than
   a sequence.
2. Pieces of one length are alike, so the search for a packing sees only how many pieces each length
   has: at most `capacity` numbers, however large the corpus. It runs on the driver and yields fillings
   with multiplicities.
3. Every piece gets its rank among the pieces of its length from counts per hash slice, and its
   sequence and offset from an equi-join on the length with the table of fillings, whose size depends
   on the capacity alone.

The search follows bin completion: around the longest piece left it enumerates fillings that no other
filling dominates, fullest first, takes one as often as the counts allow, and goes on with the rest.
It starts from the best-fit-decreasing packing, replaces it by better ones, prunes by the waste that
any completion must add, and stops at a packing that meets the lower bound, or after `WORK`.

Rules. Null text is empty and has the end token alone. The string of an added token is that token. Null and repeated ids are documents each.
An empty table gives no pieces. Columns of the documents other than id and text are ignored.
"""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import checkpoint, table

CAPACITY = 1024
END = 2
WORK = 60_000  # the search ends after nodes that saw so many lengths together
TRIED = 6  # fillings tried at a node
STEPS = 400  # steps of one enumeration
KNOWN_BYTES, KNOWN_LETTERS = 48 << 20, 64  # of the words a worker remembers, all together and each
SEEN = 1 << 22  # bytes that mark words by hash when they come first
SLICE_ROWS = 500_000
# Fixed value: how byte-level vocabularies split text before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _load(path: str, added: bool):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added
    return tokenizer


def _fast(path: str):
    """The same merges for single words in a faster library, or None if the file is of another kind."""
    model = json.loads(Path(path).read_text())
    ranks, merges = model["model"]["vocab"], model["model"].get("merges", [])
    order = [ranks["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
    step = model.get("pre_tokenizer") or {}
    if step.get("type") != "ByteLevel" or not step.get("use_regex") or step.get("add_prefix_space") or order != sorted(order):
        return None
    # Byte-level vocabularies write the bytes that are no visible characters as characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in ranks.items() if token not in special}
    return tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class _Words(dict):
    """Token bytes of words that follow a space. A word cut off by single spaces is tokenised by itself."""

    def __init__(self, encode):
        self.encode, self.left, self.seen = encode, KNOWN_BYTES, bytearray(SEEN)

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise KeyError
        ids = np.array(self.encode(" " + word), "<u4").tobytes()
        if self.left > 0 and len(word) <= KNOWN_LETTERS:
            # Words that come once would fill the room; a word is kept when it, or one like it by hash, comes again.
            place = hash(word) % SEEN
            if not self.seen[place]:
                self.seen[place] = 1
                return ids
            self.left -= len(word) + len(ids) + 200  # with what Python adds to two strings and a place
            self[word] = ids
        return ids


def encoder(path: str, *, added: bool = False):
    """Text to little-endian unsigned 32-bit ids, as the tokenizer gives them for the whole text.

    With `added`, strings of added tokens in a text are these tokens, as by default in the tokenizer; else ordinary text.
    """
    kept = sys.modules.setdefault("_pageloom_worker", types.ModuleType("_pageloom_worker")).__dict__
    name = f"{path} {added}"
    if name in kept:  # a worker process serves many tasks
        return kept[name]
    tokenizer = _load(path, added)
    marks = [t.content for t in tokenizer.get_added_tokens_decoder().values()] if added else []
    words = _Words(_fast(path) or (lambda text: tokenizer.encode(text, add_special_tokens=False).ids))

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace() or any(m in text for m in marks):
            return whole(text)
        try:
            return whole(first) + b"".join(map(words.__getitem__, rest))
        except KeyError:  # runs of white space
            return whole(text)

    kept[name] = encode
    return encode


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes what the full ones leave."""
    lead = n % capacity
    out = [(0, lead)] if lead else []
    return out + [(at, capacity) for at in range(lead, n, capacity)]


def _pieces(path: str, capacity: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, added=True)
        end = np.array([END], "<u4").tobytes()
        schema = pa.schema(
            [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
        )
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    rows.append((doc, piece, start, length, ids[4 * start : 4 * (start + length)]))
                held += len(ids)
                if held > 8 << 20:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return split


def pieces(docs: DataFrame, *, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): tokens of each whole document and its end, cut to the capacity."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_pieces(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids binary")


Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that no packing can do without (Martello and Toth's second bound)."""
    lengths = np.array(sorted(counts), np.int64)
    number = np.array([counts[x] for x in lengths.tolist()], np.int64)
    if not len(lengths):
        return 0
    upto, total = np.concatenate([[0], np.cumsum(number)]), np.concatenate([[0], np.cumsum(number * lengths)])
    half = np.searchsorted(lengths, capacity // 2, "right")
    best = -(-int(total[-1]) // capacity)
    for least in [0, *lengths[:half].tolist()]:
        large = np.searchsorted(lengths, capacity - least, "right")
        low = np.searchsorted(lengths, least, "left")
        middle = int(upto[large] - upto[half])
        room = middle * capacity - int(total[large] - total[half])
        over = int(total[half] - total[low]) - room
        best = max(best, int(upto[-1] - upto[half]) + max(0, -(-over // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit-decreasing over counts: sequences that are filled alike are one entry."""
    open_: dict[int, list[list]] = {}  # room left -> [filling, how many]
    rooms = np.zeros(capacity + 1, bool)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fitting = np.flatnonzero(rooms[length:])
            if len(fitting):
                room = length + int(fitting[0])
                filling, many = open_[room].pop()
                used = min(many, left)
                if many > used:
                    open_[room].append([filling, many - used])
                each = 1
            else:
                room, filling, each = capacity, (), capacity // length
                each = min(each, left)
                used = left // each
            if not open_.get(room):
                rooms[room] = False
            last = filling[-1] if filling else (0, 0)
            new = (*filling[:-1], (length, last[1] + each)) if last[0] == length else (*filling, (length, each))
            open_.setdefault(room - length * each, []).append([new, used])
            rooms[room - length * each] = True
            left -= used * each
    return [(tuple(f), n) for groups in open_.values() for f, n in groups]


def fillings(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Undominated fillings around the longest piece, fullest first, at most `TRIED` of them.

    A filling is dominated if a piece left out fits into its room, alone or in place of a shorter one.
    """
    lengths = sorted((x for x in counts if counts[x]), reverse=True)
    longest = lengths[0]
    found: dict[Filling, int] = {}
    steps = 0

    def undominated(filling: list[tuple[int, int]], room: int) -> bool:
        inside = dict(filling)
        free = [x for x in lengths if counts[x] > inside.get(x, 0)]
        return not any(x <= room or any(y < x <= y + room for y in inside if y != longest) for x in free)

    def extend(at: int, room: int, filling: list[tuple[int, int]]) -> None:
        nonlocal steps
        steps += 1
        while at < len(lengths) and lengths[at] > room:
            at += 1
        if room == 0 or at == len(lengths):
            if undominated(filling, room):
                found[tuple(filling)] = room
            return
        if steps > STEPS or len(found) > 4 * TRIED:
            return
        length = lengths[at]
        have = counts[length] - dict(filling).get(length, 0)
        for many in range(min(have, room // length), -1, -1):
            merged = filling
            if many:
                merged = [*filling[:-1], (length, filling[-1][1] + many)] if filling[-1][0] == length else [*filling, (length, many)]
            extend(at + 1, room - many * length, merged)
            if steps > STEPS or found and min(found.values()) == 0 and len(found) >= TRIED:
                return

    extend(0, capacity - longest, [(longest, 1)])
    return sorted(found, key=lambda f: (found[f], len(f), f))[:TRIED]


def complete(counts: dict[int, int], capacity: int = CAPACITY, work: int = WORK) -> list[tuple[Filling, int]]:
    """Fillings with multiplicities that hold all pieces in few sequences."""
    counts = {x: n for x, n in counts.items() if n}
    best = best_fit(counts, capacity)
    size = lambda plan: sum(n for _, n in plan)
    bound = lower_bound(counts, capacity)
    seen = 0

    def search(rest: dict[int, int], done: list[tuple[Filling, int]], used: int) -> bool:
        """Whether the bound is met or the work is used up."""
        nonlocal best, seen
        seen += len(rest)
        if done:
            plan = best_fit(rest, capacity)
            if used + size(plan) < size(best):
                best = done + plan
        if size(best) <= bound or seen > work:
            return True
        if not rest or used + lower_bound(rest, capacity) >= size(best):
            return False
        for filling in fillings(rest, capacity):
            times = min(rest[x] // n for x, n in filling)
            left = dict(rest)
            for x, n in filling:
                left[x] -= n * times
                if not left[x]:
                    del left[x]
            if search(left, [*done, (filling, times)], used + times):
                return True
        return False

    search(counts, [], 0)
    return best


def packed(cut: DataFrame, *, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The pieces, whatever else their rows hold, with `sequence_id` and `offset`."""
    cut = checkpoint(cut)  # ranks need rows that stay as they are
    rows = cut.count()
    slices = 64 + rows // SLICE_ROWS
    sliced = cut.withColumn("_slice", F.pmod(F.xxhash64(*keys), F.lit(slices)))
    held = checkpoint(sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n")))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # a row per length
    plan = complete(counts, capacity)
    slots, ranks, sequence = [], dict.fromkeys(counts, 0), 0
    for filling, times in plan:
        offset = 0
        for length, many in filling:
            slots.append((length, ranks[length], ranks[length] + times * many, sequence, many, offset))
            ranks[length] += times * many
            offset += length * many
        sequence += times
    slots = cut.sparkSession.createDataFrame(slots, "_length long, _from long, _to long, _first long, _many long, _offset long")
    before = held.selectExpr(
        "length AS _l", "_slice AS _s", "sum(_n) OVER (PARTITION BY length ORDER BY _slice) - _n AS _before"
    )
    order = ", ".join(keys)
    ranked = sliced.withColumn("_nth", F.expr(f"row_number() OVER (PARTITION BY length, _slice ORDER BY {order}) - 1"))
    ranked = ranked.join(before, (F.col("length") == F.col("_l")) & (F.col("_slice") == F.col("_s")))
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_nth"))
    inside = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(slots), inside).select(
        *cut.columns,
        F.expr("_first + (_rank - _from) div _many").alias("sequence_id"),
        F.expr("_offset + (_rank - _from) % _many * length").alias("offset"),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark, folder: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    cut = pieces(table(spark, folder, "documents"), tokenizer=default_tokenizer())
    light = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packed(light).withColumn("offset", F.col("offset").cast("long"))
