"""Nesting of a page's tokens: the one step that needs a stack, as an Arrow function.

Which element an end tag closes depends on all elements open at that point, and real pages
leave many open, so neither windows nor counts per tag can tell. The scan is linear and sees
one short code and one integer of rule marks per token, never the text. What an element says about everything
below it (its marks, the paragraph it starts, the area it opens) rides on the stack, so rules about subtrees cost nothing more.
The page job hands over its tags as written beside what is known of each different one, and gets back the tokens that are
still alive; nothing is returned for end tags and what lies below removed elements.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Callable, Iterable, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.operators.marks import AREA_SHIFT, BIT, BOX_SHIFT, FRAME_SHIFT, OWNER_SHIFT, RANK_MASK

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements without an end tag.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
HEADING_TAGS = frozenset({"h2", "h3", "h4"})
# Elements whose text is gathered as one piece, and those that put out something of their own.
GATHERED = frozenset({"p", "dl", "h1", "h2", "h3", "h4", "h5", "h6"})
SPEAKING = frozenset({"ul", "ol", "br"})
LISTS = frozenset({"ul", "ol"})
ENTRIES = frozenset({"dt", "dd"})

_OWN = (1 << AREA_SHIFT) - 1
_DEAD = BIT["noise"] | BIT["boilerplate"] | BIT["in_title"]
_GONE = BIT["noise"] | BIT["boilerplate"]
_UNCLEAN = BIT["noise"] | BIT["in_title"]
_FREE, _SKIP, _GATHER = 0, 1, 2
# Where a position comes from; strings directly below an element may also be their own unit.
_NONE, _SELF, _UNIT, _ENTRY = 0, 1, 2, 3
_ITSELF = -2
_NO_OWNER = (RANK_MASK + 1) << OWNER_SHIFT

_INTS = T.ArrayType(T.IntegerType())
_LONGS = T.ArrayType(T.LongType())
_NESTING = T.StructType(
    [
        T.StructField("parent", _INTS),
        T.StructField("last", _INTS),
        T.StructField("mask", _LONGS),
        T.StructField("unit", _INTS),
        T.StructField("head", _INTS),
        T.StructField("until", _INTS),
        T.StructField("owner", _LONGS),
        T.StructField("box", T.IntegerType()),
        T.StructField("items", T.ArrayType(_INTS)),
    ]
)
_LIVE = T.StructType(
    [
        T.StructField("place", _INTS),
        T.StructField("word", _INTS),
        T.StructField("around", _INTS),
        *(field for field in _NESTING.fields if field.name not in ("box", "items")),
        T.StructField("inner", _INTS),
        T.StructField("box", T.IntegerType()),
        T.StructField("box_last", T.IntegerType()),
        T.StructField("items", T.ArrayType(_INTS)),
    ]
)


class _State:
    """What an open element says about everything below it, but for positions; elements alike share one."""

    __slots__ = ("name", "box", "mask", "own", "rank", "wall", "kind", "hidden", "inside", "at_area", "at_unit", "text", "steps")

    def __init__(self, *values):
        for name, value in zip(self.__slots__, values):
            setattr(self, name, value)
        # By kind of token, and by ~kind for the page's first title.
        self.steps: dict[int, tuple] = {}


class _Steps:
    """What a token does below an element: worked out once for each different pair of a state and a kind of token, then looked up.

    A kind is (action, name, is_box, marks). Positions are told by where they come from: `_NONE`, `_SELF`, or the element's `_UNIT` or `_ENTRY`.
    """

    def __init__(self, kinds: Sequence[tuple[str, str, bool, int]], links: Sequence[tuple[int, int, int]]):
        self.kinds, self.links = kinds, links
        self.closes = [name if action == "close" else None for action, name, _, _ in kinds]
        self.states: dict[tuple, _State] = {}
        self.root = self._state("", False, 0, 0, RANK_MASK, _FREE, "", False, False, False, False)

    def _state(self, *key) -> _State:
        if key not in self.states:
            name, _, mask, _, _, wall, kind, hidden, inside, at_area, _ = key
            # The unit of the strings directly below: `_place` for them.
            if not inside or wall == _SKIP:
                text = _NONE
            elif wall == _FREE:
                text = _NONE if name in LISTS or at_area else _ITSELF
            elif hidden or mask & BIT["quiet"]:
                text = _NONE
            else:
                text = _ENTRY if kind == "dl" else _UNIT
            self.states[key] = _State(*key, text)
        return self.states[key]

    def step(self, top: _State, kind: int, first: bool) -> tuple:
        """(state below or None, where unit, place and entry come from, mask, special, rank of container, of infobox, heading, title).

        The place is the unit a token belongs to. The outermost wall below an area decides: what it skips yields nothing, what it
        gathers belongs to it.
        """
        action, name, is_box, marks = self.kinds[kind]
        # The container of the earliest rule around a node owns it, the outermost one of that rule.
        frame = marks >> FRAME_SHIFT & RANK_MASK
        for child, around, result in self.links:
            if marks & child and top.own & around:
                marks |= result & _OWN
                rank = result >> FRAME_SHIFT
                if rank and (not frame or rank < frame):
                    frame = rank
        titles = bool(marks & BIT["title"])
        if titles and first:
            marks |= BIT["in_title"]
        mask = top.mask | (marks & _OWN)
        rank, wall, gathers, hidden, inside, at_area = top.rank, top.wall, top.kind, top.hidden, top.inside, False
        place, unit, entry, text = _NONE, _UNIT, _ENTRY, not name
        if inside:
            listed = top.name in LISTS
            item = listed and name == "li"
            if wall == _FREE:
                if (listed and not item) or (text and top.at_area) or (not text and not top.at_area and not item and marks & BIT["skipped"]):
                    wall = _SKIP
                elif name in GATHERED:
                    wall, unit, gathers = _GATHER, _SELF, name
            if wall == _FREE:
                place = _SELF if text or item or name in SPEAKING else _NONE
            elif wall == _GATHER:
                below_list = gathers == "dl" and unit == _UNIT
                if below_list and top.at_unit and name in ENTRIES:
                    entry = _SELF
                hidden = hidden or (gathers == "p" and bool(marks & BIT["hidden"]))
                if not (text and (hidden or mask & BIT["quiet"])):
                    place = entry if below_list else unit
        area = marks >> AREA_SHIFT & RANK_MASK
        if area and area < rank:
            # Text is read from the best area alone; what holds above it ends here.
            rank, wall, hidden, inside, at_area, unit, entry = area, _FREE, False, True, True, _NONE, _NONE
        box = 0 if mask & _UNCLEAN else marks >> BOX_SHIFT & RANK_MASK
        heading = name if name.startswith("h") and name <= "h4" and not mask & _DEAD else ""
        state = None
        if action == "open":
            state = self._state(name, is_box, mask, marks, rank, wall, gathers, hidden, inside, at_area, unit == _SELF)
        found = (state, unit, place, entry, mask, bool(frame or box or heading or titles), frame, box, heading, titles)
        top.steps[~kind if titles and first else kind] = found
        return found


def _scan(spots: Sequence[int], kinds: Sequence[int], end: int, steps: _Steps, base: int, out: dict) -> None:
    """Nesting of one page: an end tag closes up to the nearest open element of its name, or nothing.

    `spots` are the positions of all tokens but strings, `kinds` theirs, `end` the last position of the page. What is known of a token goes to its
    place after `base`; strings follow from `after`, the innermost element open after a token, and `text`, the unit of the strings
    directly below an element.
    """
    closes = steps.closes
    stack = [(-1, steps.root, -1, -1, _NO_OWNER)]
    above, state, unit, entry, owner = stack[0]
    opened: dict[str, int] = {}
    waiting: dict[int, list[tuple[str, int]]] = {}
    items: list[int] = []
    boxes, titled, box = 0, False, (RANK_MASK + 1, -1)
    chains: dict[int, list[int]] = {}
    lasts, heads, until = out["last"], out["head"], out["until"]
    known = len(heads)
    parents, masks, owners, units, after, text = out["parent"], out["mask"], out["owner"], out["unit"], out["after"], out["text"]
    for turn, (pos, kind) in enumerate(zip(spots, kinds)):
        place = base + pos
        parents[place] = above
        name = closes[kind]
        if name is not None:
            if opened.get(name):
                while True:
                    gone, left = stack.pop()[:2]
                    opened[left.name] -= 1
                    lasts[base + gone] = pos - 1
                    if gone in waiting:
                        for _, head in waiting.pop(gone):
                            until[head] = pos - 1
                    if left.box:
                        boxes -= 1
                    if boxes and left.name == "li":
                        items.pop()
                    if left.name == name:
                        break
                above, state, unit, entry, owner = stack[-1]
            after[place] = above
        else:
            found = state.steps.get(kind) or steps.step(state, kind, False)
            if found[9] and not titled:
                titled = True
                found = state.steps.get(~kind) or steps.step(state, kind, True)
            below, unit_from, place_from, entry_from, mask, special, frame, box_rank, heading, _ = found
            masks[place] = mask
            if place_from:
                units[place] = pos if place_from == _SELF else unit if place_from == _UNIT else entry
            own = owner
            if special:
                if frame:
                    own = min(owner, (frame - 1) << OWNER_SHIFT | pos)
                if box_rank:
                    box = min(box, (box_rank, pos))
                if heading:
                    # A heading ends the sections of its siblings of the same or a lower rank.
                    open_heads = waiting.get(above)
                    while open_heads and open_heads[-1][0] >= heading:
                        until[open_heads.pop()[1]] = pos - 1
                    if below is not None and heading in HEADING_TAGS:
                        waiting.setdefault(above, []).append((heading, len(heads)))
                        heads.append(pos)
                        until.append(-1)
            if own != _NO_OWNER:
                owners[place] = own
            if below is not None:
                unit = unit if unit_from == _UNIT else pos if unit_from == _SELF else -1
                entry = entry if entry_from == _ENTRY else pos if entry_from == _SELF else -1
                above, state, owner = pos, below, own
                stack.append((pos, below, unit, entry, own))
                name = below.name
                opened[name] = opened.get(name, 0) + 1
                told = below.text
                if told:
                    text[place] = _ITSELF if told == _ITSELF else unit if told == _UNIT else entry
                if boxes and name == "li":
                    items.append(pos)
                if below.box:
                    boxes += 1
            elif items:
                chains[pos] = items.copy()
            after[place] = above
        if items:
            upto = spots[turn + 1] if turn + 1 < len(spots) else end + 1
            chains |= {at: items.copy() for at in range(pos + 1, upto)}
    for left in stack:
        if left[0] >= 0:
            lasts[base + left[0]] = end
        for _, head in waiting.get(left[0], ()):
            until[head] = end
    out["heads"].append(len(heads) - known)
    out["box"].append(box[1])
    # Only pages with list items in an infobox pay for a chain per token.
    out["items"].append([chains.get(at, ()) for at in range(end + 1)] if chains else [])


def _decode_op(op: str) -> tuple[str, str, bool]:
    if not op.startswith("<"):
        return "leaf", "", False
    if op.startswith("</"):
        return "close", op[2:].rstrip("!/"), False
    name = op[1:].rstrip("!/")
    leaf = op.rstrip("!").endswith("/") or name in VOID_TAGS or name in ("script", "style")
    return ("leaf" if leaf else "open"), name, op.endswith("!")


def _offsets(lengths: Sequence[int]) -> np.ndarray:
    starts = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=starts[1:])
    return starts


def _lists(values: np.ndarray, lengths: Sequence[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_offsets(lengths)), pa.array(values))


def _scan_pages(
    numbers: np.ndarray, kinds: Sequence[tuple[str, str, bool, int]], tagged: np.ndarray, lengths: Sequence[int], links: Sequence[tuple]
) -> dict:
    """`_scan` of the pages of a batch, whose tokens lie one page after the other.

    `numbers` are places in `kinds`, the code and the marks of a token; `tagged` tells tokens from strings.
    """
    # What is alike to the scan has one number.
    alike: dict[tuple, int] = {}
    number = np.array([alike.setdefault(kind, len(alike)) for kind in kinds], np.int64)
    steps = _Steps([*alike], links)
    starts = _offsets(lengths)
    size = int(starts[-1])
    page = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(size, dtype=np.int32) - starts[page]
    # Four or eight bytes a token and column; a batch may hold millions.
    out: dict = {name: array("i", [-1]) * size for name in ("parent", "unit", "after", "text")}
    out |= {"last": array("i", place.tobytes()), "mask": array("q", [0]) * size, "owner": array("q", [-1]) * size}
    out |= {"head": array("i"), "until": array("i"), "items": [], "heads": [], "box": []}
    spots = np.flatnonzero(tagged)
    ends = np.searchsorted(spots, starts)
    seen = number[numbers[spots]]
    for i, at in enumerate(starts[:-1].tolist()):
        here = slice(ends[i], ends[i + 1])
        _scan(place[spots[here]].tolist(), seen[here].tolist(), lengths[i] - 1, steps, at, out)
    for name, values in out.items():
        if isinstance(values, array):
            out[name] = np.frombuffer(values, np.dtype(values.typecode)).copy() if values else np.zeros(0, np.dtype(values.typecode))
    # A string lies in the element open after the tag before it.
    strings = np.flatnonzero(~tagged)
    before = np.maximum.accumulate(np.where(tagged, np.arange(size), -1))[strings]
    first = starts[page[strings]]
    top = np.where(before >= first, out["after"][np.maximum(before, 0)], -1)
    above, nested = np.maximum(first + top, 0), top >= 0
    unit = np.where(nested, out["text"][above], -1)
    out["parent"][strings] = top
    out["mask"][strings] = np.where(nested, out["mask"][above], 0)
    out["owner"][strings] = np.where(nested, out["owner"][above], -1)
    out["unit"][strings] = np.where(unit == _ITSELF, place[strings], unit)
    return out | {"page": page, "place": place, "starts": starts}


def _lengths(lists: pa.Array) -> list[int]:
    return [n or 0 for n in pc.list_value_length(lists).to_pylist()]


def nesting(links: Sequence[tuple[int, int, int]] = ()) -> Callable:
    """The function `nest(ops, own)` of a page's codes and marks (no marks: an empty list).

    `links` are (child, parent, result): a token with the marks `child` below an element with the marks `parent` also
    has the marks `result`. Per token: `parent`, `last`, `mask` (marks of the token and all around it), `unit` and `owner` (rule
    and position of the image container that takes it, or -1); per live heading: `head` and `until`, the end of the siblings it
    stands over; `box` (position of the best infobox, or -1), and `items`, the list items around a string in an infobox.
    """
    links = tuple(links)

    @F.arrow_udf(_NESTING)
    def nest(ops: pa.Array, own: pa.Array) -> pa.Array:
        flat = ops.flatten().dictionary_encode()
        codes = [_decode_op(op) for op in flat.dictionary.to_pylist()]
        lengths = _lengths(ops)
        strings = np.array([op == "" for op in flat.dictionary.to_pylist()], bool)
        indices = flat.indices.to_numpy()
        marks = own.flatten().to_numpy(zero_copy_only=False)
        if len(marks):
            # A number for each different pair of code and marks.
            different, turn = np.unique(marks, return_inverse=True)
            pairs, numbers = np.unique(indices.astype(np.int64) * len(different) + turn, return_inverse=True)
            kinds = [(*codes[pair // len(different)], int(different[pair % len(different)])) for pair in pairs.tolist()]
        else:
            numbers, kinds = indices, [(*code, 0) for code in codes]
        out = _scan_pages(numbers, kinds, ~strings[indices], lengths, links)
        per_token = {name: _lists(out[name], lengths) for name in ("parent", "last", "mask", "unit")}
        per_head = {name: _lists(out[name], out["heads"]) for name in ("head", "until")}
        columns = {
            **per_token,
            **per_head,
            "owner": _lists(out["owner"], lengths),
            "box": pa.array(out["box"], pa.int32()),
            "items": pa.array(out["items"], pa.list_(pa.list_(pa.int32()))),
        }
        return pa.StructArray.from_arrays([*columns.values()], names=[*columns])

    return nest


def live_nesting(links: Sequence[tuple[int, int, int]] = ()) -> Callable:
    """The function `nest(words, vocabulary, ops, own)`: `nesting` of a page, of the tokens alone that may have a part in the result.

    `words` are the page's tokens, '' for strings; `vocabulary` its different tags, with the code and the marks of each. What lies
    below removed elements goes, unless in the title or the infobox, and so do end tags. Per token that is left: `place`, its position;
    `word` and `around`, the numbers of its own tag and of its parent's in the vocabulary, or -1; and what `nesting` gives, all in
    positions of the whole page. Of headings, `head`, `until` and `inner` (the last token inside) count the tokens that are left.
    """
    links = tuple(links)

    @F.arrow_udf(_LIVE)
    def nest(words: pa.Array, vocabulary: pa.Array, ops: pa.Array, own: pa.Array) -> pa.Array:
        # Tags come again on most pages of a batch; each different one has a number, 0 is for strings.
        known = vocabulary.flatten().dictionary_encode()
        numbers = known.indices.to_numpy().astype(np.int64) + 1
        _, firsts = np.unique(numbers, return_index=True)
        distinct = ops.flatten().take(pa.array(firsts)).dictionary_encode()
        codes = [("leaf", "", False), *(_decode_op(op) for op in distinct.dictionary.to_pylist())]
        code = np.concatenate([[0], distinct.indices.to_numpy().astype(np.int64) + 1])
        marks = np.concatenate([[0], own.flatten().to_numpy(zero_copy_only=False)[firsts]]).astype(np.int64)
        number = pc.fill_null(pc.index_in(words.flatten(), value_set=known.dictionary), -1).to_numpy().astype(np.int64) + 1

        lengths = _lengths(words)
        kinds = [(*codes[c], m) for c, m in zip(code.tolist(), marks.tolist())]
        out = _scan_pages(number, kinds, number > 0, lengths, links)
        page, place, starts = out["page"], out["place"], out["starts"]
        box = np.array(out["box"], np.int32)
        box_last = np.full(len(box), -2, np.int32)
        boxed = box >= 0
        box_last[boxed] = out["last"][starts[:-1][boxed] + box[boxed]]
        in_box = (place >= box[page]) & (place <= box_last[page])
        alive = ((out["mask"] & _GONE) == 0) | ((out["mask"] & BIT["in_title"]) != 0) | in_box
        keep = alive & ~np.array([action == "close" for action, _, _ in codes])[code[number]]

        word = np.empty(len(number), np.int32)
        here, at = np.full(len(known.dictionary) + 1, -1, np.int32), 0
        for i, size in enumerate(_lengths(vocabulary)):
            here[numbers[at : at + size]] = np.arange(size, dtype=np.int32)
            word[starts[i] : starts[i + 1]] = here[number[starts[i] : starts[i + 1]]]
            at += size
        parent = out["parent"]
        around = np.where(parent >= 0, word[np.maximum(starts[page] + parent, 0)], np.int32(-1)) if len(word) else word

        # Tokens left up to a position, and before each page.
        upto = np.cumsum(keep, dtype=np.int32)
        before = np.concatenate([[0], upto]).astype(np.int32)[starts[:-1]]
        left = np.bincount(page[keep], minlength=len(lengths))
        heads = out["heads"]
        start, earlier = np.repeat(starts[:-1], heads), np.repeat(before, heads)
        head = out["head"] + start
        columns = {
            **{k: _lists(v[keep], left) for k, v in {"place": place, "word": word, "around": around}.items()},
            **{k: _lists(out[k][keep], left) for k in ("parent", "last", "mask", "unit")},
            "head": _lists(upto[head] - earlier - 1, heads),
            "until": _lists(upto[out["until"] + start] - earlier - 1, heads),
            "owner": _lists(out["owner"][keep], left),
            "inner": _lists(upto[out["last"][head] + start] - earlier - 1, heads),
            "box": pa.array(box),
            "box_last": pa.array(box_last),
            "items": pa.array(
                [list(compress(chains, keep[starts[i] :])) for i, chains in enumerate(out["items"])], pa.list_(pa.list_(pa.int32()))
            ),
        }
        return pa.StructArray.from_arrays([*columns.values()], names=[*columns])

    return nest
