"""Secret scans through a trigram inverted index, with DataFrame functions only.

1. Each rule's regular expression is read once, where the plan is made, and gives a Boolean query: one
   of several sets of trigrams must occur whole in any text it matches. A rule without such sets is
   scanned everywhere.
2. The index lists, for every trigram that some query asks for, the documents that hold it.
3. Posting lists are intersected by grouping: a set holds where all its trigrams were seen.
4. Candidates are verified with the expression itself over the whole text. Matches and the pieces
   between them give positions in code points.

Rules. Null text is empty. Matches of a rule are leftmost and do not overlap; those that are too short
are dropped after matching. Documents with equal id and text share their posting lists, which changes
nothing as candidates are verified row by row; null ids are ids like others. Columns of the input come
along; `spans` replaces a column of that name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the part whose length counts
    least: int = 0  # shorter matches are dropped
    base: bool = False


# Base rules first, in their order; the others add spans.
RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),  # the runs of 24 and more
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("live_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("address_login", r"://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)
MASK = "[SECRET]"
RUN, CHUNK = 64, 256
# What belongs to a private key after its first line: all to its last line, or the body where that is missing.
_GAP, _CODE = r"""(?:[\s"'+,>#*|]|\\+[nrt])""", "[A-Za-z0-9+/]"
KEY_REST = (
    r"^(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_GAP}*+(?:Proc-Type|DEK-Info): [^\r\n\\]*+)*+(?:{_GAP}*+[A-Za-z0-9+/=]{{16,}}+)*+"
    rf"(?:[ \t]*+(?:[\r\n]|\\+[nr]){_GAP}*+{_CODE}++={{0,2}}(?=[ \t]*+(?:[\r\n\"'\\]|\z))|{_GAP}++{_CODE}++(?:={{1,2}}|\z))?)"
)
MOST_STRINGS = 64


def _strings(item: tuple) -> list[str] | None:
    """All strings that a part of an expression can be, if they are few and short."""
    op, value = item
    if op is sre.LITERAL:
        return [chr(value).lower()]
    if op is sre.IN and len(value) <= 8 and all(o is sre.LITERAL for o, _ in value):
        return sorted({chr(v).lower() for _, v in value})
    if op is sre.SUBPATTERN:
        return _joined(value[-1])
    if op is sre.BRANCH:
        options = [_joined(branch) for branch in value[1]]
        return None if None in options else [s for o in options for s in o]
    if op is sre.MAX_REPEAT and value[1] <= 3:
        one = _joined(value[2])
        if one is None:
            return None
        out, power = [], [""]
        for times in range(int(value[1]) + 1):
            out += power if times >= value[0] else []
            power = [a + b for a in power for b in one]
        return out if len(out) <= MOST_STRINGS else None
    return None


def _joined(items) -> list[str] | None:
    strings = [""]
    for item in items:
        got = _strings(item)
        if got is None or len(strings) * len(got) > MOST_STRINGS:
            return None
        strings = [a + b for a in strings for b in got]
    return strings


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case trigrams, one of which every match holds whole; empty if no trigram is mandatory.

    Of the runs of enumerable parts in the expression, the one whose poorest string has most trigrams.
    """
    runs, run = [], [""]
    for item in [*parser.parse(pattern), None]:
        got = _strings(item) if item is not None else None
        if got is None or len(run) * len(got) > MOST_STRINGS:
            runs.append(run)
            run = got if got is not None else [""]
        else:
            run = [a + b for a in run for b in got]
    runs.append(run)
    sets = [[frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings] for strings in runs]
    best = max(sets, key=lambda options: min(map(len, options)))
    return list(dict.fromkeys(best)) if all(best) else []


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, merge: Callable[[Column, Column], Column], depth: int = 2) -> Column:
    """For each element the merge of all before it, from 0; by blocks of blocks, so the work stays near the number of elements."""
    zero = F.lit(0)

    def within(block: Column) -> Column:
        return F.transform(block, lambda _, i: F.aggregate(F.slice(block, F.lit(1), i), zero, merge))

    def whole(block: Column) -> Column:
        return F.aggregate(block, zero, merge)

    def blocked(items: Column) -> Column:
        last = F.ceil(F.size(items) / RUN).cast("int") - 1
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * RUN + 1, F.lit(RUN)))

        def joined(parts: Column) -> Column:
            before = running(F.transform(parts, whole), merge, depth - 1)
            return F.flatten(F.zip_with(F.transform(parts, within), before, lambda w, o: F.transform(w, lambda x: merge(x, o))))

        return F.when(F.size(items) > 0, _let(blocks, joined)).otherwise(F.array().cast("array<int>"))

    return _let(values, blocked if depth else within)


def _positions(rule: Rule, number: int, text: Column) -> Column:
    """array<struct<start, kind, end>> of one rule, in code points."""
    sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    parts = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)

    def placed(rows: Column) -> Column:
        steps = F.transform(rows, lambda r: r["gap"] + F.coalesce(r["size"], F.lit(0)))
        both = F.arrays_zip(rows.alias("row"), running(steps, lambda x, y: x + y).alias("before"))
        hits = F.filter(both, lambda b: b["row"]["part"] >= max(rule.least, 1))
        begin = lambda b: b["before"] + b["row"]["gap"]
        return F.transform(
            hits, lambda b: F.struct(begin(b).alias("start"), F.lit(number).alias("kind"), (begin(b) + b["row"]["size"]).alias("end"))
        )

    return _let(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), parts.alias("part")), placed)


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, row_key): which documents hold each trigram, letter case folded."""
    lower = rows.select("row_key", F.lower("body").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))))
    return lower.select("row_key", F.explode(held).alias("trigram"))


def candidates(rows: DataFrame, queries: list[list[frozenset[str]]]) -> DataFrame:
    """(row_key, rules): the rules, as bits, whose query the document satisfies."""
    trigrams = sorted({t for sets in queries for s in sets for t in s})
    number = {t: i for i, t in enumerate(trigrams)}
    clauses = [(r, s) for r, sets in enumerate(queries) for s in sets]
    wanted = [(number[t], c, 1 << i) for c, (_, s) in enumerate(clauses) for i, t in enumerate(sorted(s))]
    whole = [(c, (1 << len(s)) - 1, 1 << r) for c, (r, s) in enumerate(clauses)]
    spark = rows.sparkSession
    wanted = spark.createDataFrame(wanted, "trigram int, clause int, bit long")
    whole = spark.createDataFrame(whole, "clause int, all_bits long, rule long")
    met = postings(rows, trigrams).join(F.broadcast(wanted), "trigram").groupBy("row_key", "clause").agg(F.bit_or("bit").alias("bits"))
    met = met.join(F.broadcast(whole), "clause").where("bits = all_bits")
    return met.groupBy("row_key").agg(F.bit_or("rule").alias("rules"))


def scan(
    docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The documents with `spans`: array of (start, kind, end), kind being the rule's number, in order."""
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "spans")).alias("doc"),
        F.coalesce(F.col(text_column), F.lit("")).alias("body"),
        F.xxhash64(id_column, text_column).alias("row_key"),
    )
    queries = [trigram_query(rule.pattern) for rule in rules]
    found = candidates(rows.select("row_key", "body"), queries).select(F.col("row_key").alias("k"), "rules")
    rows = rows.join(found, F.col("row_key") == F.col("k"), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = [
        F.when(F.rlike("body", F.lit(rule.pattern)), _positions(rule, number, F.col("body"))).otherwise(none)
        if not queries[number]
        else F.when(
            F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(1 << number) != 0, _positions(rule, number, F.col("body"))
        ).otherwise(none)
        for number, rule in enumerate(rules)
    ]
    return rows.select("doc.*", F.array_sort(F.concat(*spans)).alias("spans"))


def _piece(chunks: Column, start: Column, stop: Column) -> Column:
    """Code points [start, stop) of a text in chunks; reads those chunks alone."""
    first = F.floor(start / CHUNK).cast("int")
    held = F.array_join(F.slice(chunks, first + 1, F.floor(stop / CHUNK).cast("int") - first + 1), "")
    return F.substring(held, start - first * CHUNK + 1, stop - start)


def masked(text_column: Column | str = "text", *, spans: str = "spans", rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with every span, or run of overlapping spans, replaced by the mask; of private keys all that follows their first line, too.

    The text is cut into chunks once, and every chunk is read for the gaps it touches, so many spans in a long text cost no more than
    few. What follows a key ends before the next key, whose first dashes are shown to the expression.
    """
    text = F.col(text_column) if isinstance(text_column, str) else text_column
    keys = [n for n, rule in enumerate(rules) if rule.kind == "private_key"]
    is_key = lambda s: s["kind"].isin(keys)

    def over(chunks: Column) -> Column:
        def extended(own: Column) -> Column:
            def one(span: Column, i: Column) -> Column:
                stop = F.coalesce(F.get(own, i + 1)["start"] + 5, F.length(text))
                rest = F.length(F.regexp_extract(_piece(chunks, span["end"], stop), KEY_REST, 0))
                return F.struct(span["start"].alias("start"), span["kind"].alias("kind"), (span["end"] + rest).alias("end"))

            return F.transform(own, one)

        every = F.array_sort(F.concat(F.filter(spans, lambda s: ~is_key(s)), _let(F.filter(spans, is_key), extended)))

        def joined(all_spans: Column) -> Column:
            ends = F.transform(all_spans, lambda s: s["end"])
            seen = F.arrays_zip(all_spans.alias("span"), running(ends, lambda x, y: F.greatest(x, y)).alias("at"))
            new = F.filter(seen, lambda b: b["span"]["start"] >= b["at"])
            gaps = F.transform(new, lambda b: F.concat(_piece(chunks, b["at"], b["span"]["start"]), F.lit(MASK)))
            tail = _let(F.array_max(ends), lambda last: _piece(chunks, last, F.length(text)))
            return F.concat(F.array_join(gaps, ""), tail)

        return _let(every, joined)

    whole = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), over)
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def op8_secrets(spark, folder: str) -> DataFrame:
    """All documents, all rules."""
    found = scan(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"] < sum(r.base for r in RULES))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(RULES) if r.base),
        F.sha2(_text(base, RULES).cast("binary"), 256).alias("base_sha256"),
        _text(F.col("spans"), RULES).alias("spans"),
    )


def _kind_sql(number: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, start, {number} AS kind, start + size AS stop FROM (
    SELECT doc_id, i, part, size, sum(gap) OVER w + sum(size) OVER w - size AS start FROM (
      SELECT doc_id, i, length(pieces[i]) AS gap, length(hits[i]) AS size, length(parts[i]) AS part FROM (
        SELECT doc_id, string_split_regex(text, '{pattern}') AS pieces, regexp_extract_all(text, '{pattern}') AS hits,
          regexp_extract_all(text, '{pattern}', {rule.group}) AS parts FROM documents WHERE text IS NOT NULL
      ), LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i)
    ) WINDOW w AS (PARTITION BY doc_id ORDER BY i)
  ) WHERE part >= {max(rule.least, 1)}"""


OP8_SQL = f"""
WITH s AS ({" UNION ALL ".join(_kind_sql(n, r) for n, r in enumerate(RULES))}),
t AS (SELECT *, [{", ".join(f"'{r.kind}'" for r in RULES)}][kind + 1] || ':' || start || ':' || stop AS word FROM s),
g AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {n}) AS n_{r.kind}" for n, r in enumerate(RULES) if r.base)},
    string_agg(word, ',' ORDER BY start, kind, stop) AS spans,
    string_agg(word, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base
  FROM t GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in RULES if r.base)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
