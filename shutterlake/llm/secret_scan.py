"""Secret scans through a trigram inverted index, with DataFrame functions only.

Each rule's regex is turned into a Boolean query over the trigrams that every match must contain (an OR of ANDs).
The index holds, per trigram that some rule asks for, the keys of the texts that contain it; the postings of each
AND are intersected by grouping, and only texts that satisfy a rule's query are matched against its regex. Rules
without a mandatory trigram (a plain character class, say) scan every text. Postings are a shuffle of short rows;
texts move only if the candidates are too many to broadcast, and are then joined by key.

A text's key is the 64-bit hash of its content: equal texts share postings, and a chance collision only adds a
candidate that verification then turns down. Spans are code points, end exclusive. Matches of one rule are leftmost
and do not overlap; rules are independent of one another.

Defined results: a null text counts as empty and has no spans; repeated rows and null ids each give their own row; an
empty table gives an empty result; other columns are not looked at, whatever their names are. A text may have any
number of matches: the work grows with it in proportion.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, table, written


@dataclass(frozen=True)
class Rule:
    """group and least: a match counts only if that group has so many characters; base: counts as a base kind."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The rules. Keywords of `assign` are in either case.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
)

_MANY = 64


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """ANDs of lower-case trigrams, one of which holds for the text of every match; None: no trigram is mandatory."""
    found = _walk(parser.parse(regex))[1]
    return None if frozenset() in found else sorted(found, key=sorted)


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _either(query: set[frozenset[str]]) -> set[frozenset[str]]:
    """Without the ANDs that another one implies."""
    return {x for x in query if not any(y < x for y in query)}


def _both(p: set[frozenset[str]], q: set[frozenset[str]]) -> set[frozenset[str]]:
    out = _either({x | y for x in p for y in q})
    return out if len(out) <= _MANY else p


def _walk(items) -> tuple[set[str] | None, set[frozenset[str]]]:
    """(the exact strings that the part matches, if they are few; its query)."""
    whole: set[str] | None = {""}
    run, query = {""}, {frozenset()}
    for op, arg in items:
        exact, sub = _part(op, arg)
        joined = {a + b for a in run for b in exact} if exact is not None else None
        if joined is not None and len(joined) <= _MANY:
            run = joined
            whole = whole and {a + b for a in whole for b in exact}
            continue
        query = _both(_both(query, _either({_trigrams(s) for s in run})), sub)
        run, whole = {""}, None
    query = _both(query, _either({_trigrams(s) for s in run}))
    return whole, query


def _part(op, arg) -> tuple[set[str] | None, set[frozenset[str]]]:
    anything = {frozenset()}
    if op is sre.LITERAL:
        return {chr(arg).lower()}, anything
    if op is sre.IN:
        chars = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, anything
        return (chars, anything) if len(chars) <= 8 else (None, anything)
    if op is sre.SUBPATTERN:
        return _walk(arg[3])
    if op is sre.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        exact = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
        return exact, _either(set().union(*(p[1] for p in parts)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, sub = arg
        exact, query = _walk(sub)
        if exact is not None and least == most and least <= 8:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in exact}
            return (out if len(out) <= _MANY else None), query if least else anything
        if exact is not None and (least, most) == (0, 1):
            return {"", *exact}, anything
        return None, query if least else anything
    return ({""}, anything) if op is sre.AT else (None, anything)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram, key) for the given lower-case trigrams. docs: (key, body)."""
    low = docs.select("key", F.lower("body").alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select(F.explode(present).alias("trigram"), "key")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(key, the kinds whose trigram query holds) of docs (key, body); None if no rule has mandatory trigrams."""
    spark = docs.sparkSession
    terms = [(r.kind, k, t, len(q)) for r in rules for k, q in enumerate(trigram_query(r.regex) or []) for t in sorted(q)]
    if not terms:
        return None
    index = postings(docs, sorted({t for _, _, t, _ in terms}))
    names = ("kind", "part", "trigram", "need")
    asked = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, t, strict=True))) for t in terms))))
    hit = index.join(F.broadcast(asked), "trigram")  # as large as the rules
    whole = hit.groupBy("key", "kind", "part", "need").agg(F.count_distinct("trigram").alias("n")).where("n = need")
    return whole.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


#: Entries of an array that one fold goes over.
_CHUNK = 256


def _chunks(parts: Column) -> Column:
    """An array in pieces of _CHUNK entries, one empty piece at least."""
    starts = lambda xs: F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)).cast("int"), F.lit(_CHUNK))
    return _let(parts, lambda xs: F.transform(starts(xs), lambda k: F.slice(xs, k + 1, F.lit(_CHUNK))))


def _before(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """For each of the values (int, 0 at least), what both makes of all before it, 0 of none.

    A fold that appends to an array copies it each time. Here none grows beyond _CHUNK entries, but for the list of chunks, so
    that a text may have any number of matches."""

    def walk(xs: Column, first: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            return F.struct(both(state["at"], x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

        return F.aggregate(xs, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])

    def each(chunks: Column) -> Column:
        heads = walk(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), both)), F.lit(0))
        return F.flatten(F.zip_with(chunks, heads, walk))

    return _let(_chunks(values), each)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(rule: Rule, rank: int) -> Column:
    """(start, rank, end) of the rule's matches in body, in order."""
    regex = F.lit(rule.regex)
    match = F.regexp_extract_all("body", regex, F.lit(0))
    held = F.regexp_extract_all("body", regex, F.lit(rule.group)) if rule.group else match
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    length = lambda xs: F.transform(xs, lambda x: F.length(x))
    parts = F.arrays_zip(length(F.slice(F.split("body", rule.regex, -1), F.lit(1), F.size(match))).alias("gap"), length(match).alias("all"), length(held).alias("held"))

    def found(ps: Column) -> Column:
        ends = _before(F.transform(ps, lambda p: p["gap"] + p["all"]), lambda x, y: x + y)
        spans = F.zip_with(ps, ends, lambda p, at: F.struct((at + p["gap"]).alias("start"), F.lit(rank).alias("rank"), (at + p["gap"] + p["all"]).alias("end"), p["held"].alias("held")))
        return F.transform(F.filter(spans, lambda s: s["held"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))

    return F.when(F.col("body").rlike(rule.regex), _let(parts, found)).otherwise(none)


def _scanned(docs: DataFrame, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """The columns of docs as in_0, in_1 and so on, with body (the text, null as empty) and spans."""
    rows, names = numbered(docs)
    rows = rows.withColumn("body", F.coalesce(F.col(names[docs.columns.index(text_col)]).cast("string"), F.lit(""))).withColumn("key", F.xxhash64("body"))
    picked = candidates(rows.select("key", "body"), rules)
    if picked is not None:
        rows = rows.join(written(picked, "secret-candidates"), "key", "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    each = [_spans(r, k) if trigram_query(r.regex) is None else F.when(F.array_contains("kinds", r.kind), _spans(r, k)).otherwise(none) for k, r in enumerate(rules)]
    return rows.select(*names, "body", F.array_sort(F.concat(*each)).alias("spans"))


def secret_spans(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, spans_col: str = "spans") -> DataFrame:
    """docs with spans_col, which takes the place of a column of that name: array of (start, rank of the rule, end), ordered by start, then rank."""
    rows = _scanned(docs, text_col, rules)
    return rows.select(*(F.col(f"in_{k}").alias(c) for k, c in enumerate(docs.columns) if c != spans_col), F.col("spans").alias(spans_col))


def _said(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span replaced by mark; texts without spans, null ones too, stay as they are."""
    rows = _scanned(docs, text_col, rules)

    def clean(marked: Column) -> Column:
        """marked: (start, end, upto), upto being the end of all spans before. A span that begins inside an earlier one adds no mark."""
        gaps = F.transform(F.filter(marked, lambda s: s["start"] >= s["upto"]), lambda s: F.struct(s["upto"].alias("a"), s["start"].alias("b")))
        last = F.aggregate(marked, F.lit(0), lambda x, s: F.greatest(x, s["end"]))
        # A place in a text is found by counting its characters, so it is cut in long pieces first and those in short ones.
        piece = lambda c: F.substring(F.col("body"), F.get(c, F.lit(0))["a"] + 1, F.element_at(c, -1)["b"] - F.get(c, F.lit(0))["a"])
        cut = lambda text, c: F.array_join(F.transform(c, lambda g: F.concat(F.substring(text, g["a"] - F.get(c, F.lit(0))["a"] + 1, g["b"] - g["a"]), F.lit(mark))), "")
        return F.concat(F.array_join(F.transform(_chunks(gaps), lambda c: _let(piece(c), lambda text: cut(text, c))), ""), F.substring(F.col("body"), last + 1, F.length("body")))

    ends = _before(F.transform("spans", lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    marked = F.zip_with("spans", ends, lambda s, at: F.struct(s["start"].alias("start"), s["end"].alias("end"), at.alias("upto")))
    redacted = F.when(F.size("spans") > 0, _let(marked, clean))
    return rows.select(*((F.when(F.size("spans") > 0, redacted).otherwise(F.col(f"in_{k}")) if c == text_col else F.col(f"in_{k}")).alias(c) for k, c in enumerate(docs.columns)))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ranks = {r.kind: k for k, r in enumerate(RULES)}
    last = max(k for k, r in enumerate(RULES) if r.base)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == ranks[kind])).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["rank"] <= last)
    return docs.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_said(base, RULES), 256).alias("base_sha256"), _said(F.col("spans"), RULES).alias("spans"))
