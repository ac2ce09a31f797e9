"""Short natural-language requests, as a table, to search plans: quoted text, alternatives, exclusions, dates, kinds, favourites, places, counts.

The rules are data; the work is column expressions over one row per clause, so a log of requests is analysed like any other table.
Words in Latin letters count at word boundaries only. A date must begin its clause if it is written in digits.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geo
from ..functions.text import fold_width
from . import places
from .predicates import CandidateFilter
from .search import Encoder, Search, diagnostics, search

#: The words of the rules, Chinese and English.
LEADING = (
    "拍摄的", "拍照的", "拍的", "拍摄", "拍照", "拍",
    "请帮我", "帮我", "帮忙", "麻烦", "请", "我要", "我想", "我想要", "给我", "替我",
    "找一下", "找找", "查找", "搜索", "搜一下", "搜", "找", "查一下", "查",
    "show me", "find me", "search for", "look for", "show", "find", "search",
    "i want", "i need", "give me",
)
TRAILING = (
    "的照片", "的图片", "的图", "照片", "图片", "相片",
    "photos", "pictures", "pics", "photo", "picture", "images", "image",
)
NEGATIONS = (
    "不要有", "不含有", "不包含", "不要", "没有", "不是", "别", "无",
    "without any", "without", "doesn't have", "does not have", "don't have",
    "do not have", "not a", "not an", "excluding", "except", "no", "not",
)
CONJUNCTIONS = (
    "还有", "以及", "和", "与", "跟", "及", "、", "＋", "+",
    " as well as ", " along with ", " and ", "&",
)
ALTERNATIVES = ("或者", "或是", "或", " either ", " or ")
FAVOURITES = (
    "收藏的", "收藏", "最喜欢的", "最爱", "favourite", "favorite", "starred",
)
MEDIA = (("screenshot", ("截屏", "截图", "screenshot", "屏幕快照", "screen shot")), ("live", ("实况照片", "live photo", "livephoto")), ("video", ("视频", "录像", "影片", "video", "movie", "clip")))
COUNTS = ((1, ("一张", "a single", "one")), (2, ("两张", "two")), (3, ("三张", "three")), (4, ("四张",)), (5, ("五张",)))
DETERMINERS = ("the", "a", "an", "my", "our", "your", "his", "her", "their", "this", "that", "these", "those")
_QUOTED = "\"[^\"]+\"|“[^”]+”|'[^']+'"
_NUMBERS = r"^(\d{4})(?:年(?:(\d{1,2})月(?:(\d{1,2})日)?)?|[-/.](\d{1,2})(?:[-/.](\d{1,2}))?|(?=\s*$))"


def _words(words: tuple[str, ...]) -> str:
    """An alternation, longest first; words in Latin letters only whole (a plural s is allowed)."""
    ordered = sorted((w.strip() for w in words), key=len, reverse=True)
    return "(?:" + "|".join(rf"\b{re.escape(w)}s?\b" if re.match(r"[a-z]", w) else re.escape(w) for w in ordered) + ")"


def relative_dates(now: datetime, first_weekday: int = 0) -> list[tuple[str, datetime, datetime]]:
    """(word, start, end) in the order in which they are looked for."""
    day, week, month, year = (lambda k: dates.day_range(now, k)), (lambda k: dates.week_range(now, k, first_weekday)), (lambda k: dates.month_range(now, k)), (lambda k: dates.year_range(now, k))
    rolling, season = (lambda n: dates.rolling_range(now, n)), (lambda s: dates.season_range(now.year, s))
    table = (
        (day, {"前天": -2, "昨天": -1, "今天": 0, "yesterday": -1, "today": 0}),
        (week, {"上上周": -2, "上周": -1, "本周": 0, "这周": 0, "last week": -1, "this week": 0}),
        (month, {"上个月": -1, "本月": 0, "这个月": 0, "last month": -1, "this month": 0}),
        (year, {"前年": -2, "去年": -1, "今年": 0, "last year": -1, "this year": 0}),
        (season, {"春天": "spring", "夏天": "summer", "秋天": "autumn", "冬天": "winter"}),
        (rolling, {"最近一周": 7, "最近7天": 7, "最近一个月": 30, "最近30天": 30, "最近三个月": 90, "最近半年": 182, "最近一年": 365, "最近": 30, "past week": 7, "past month": 30, "past year": 365}),
    )
    return [(word, *of(k)) for of, words in table for word, k in words.items()]


def _first(text: Column, words: list[tuple[str, Column]]) -> Column:
    """The value of the first word of the list that the text holds."""
    out = F.lit(None)
    for word, value in reversed(words):
        out = F.when(text.rlike("(?i)" + _words((word,))), value).otherwise(out)
    return out


def _without(text: Column, pattern: str) -> Column:
    return F.trim(F.regexp_replace(text, "(?i)" + pattern, ""))


#: White space at the ends of a text.
EDGES = r"^[\t-\r ]+|[\t-\r ]+$"
#: A closed quotation in the strict reading; then any quote that is left open, up to the end of the text.
CLOSED = "\"[^\"”]*[\"”]|“[^”]*”|'[^'”]*['”]"
OPEN = "[\"“'](?s:.*)$"
#: Words that exclude, in the strict reading: the first of the list at a place counts; those in Latin letters stand alone, next to neither letter nor digit.
EXCLUDING = "(?i)(?:" + "|".join(rf"(?<![\p{{L}}\p{{N}}]){re.escape(w)}(?![\p{{L}}\p{{N}}])" if re.match("[a-z]", w) else w for w in NEGATIONS) + ")"


def in_turn(separators: tuple[str, ...]) -> list[str]:
    """The order in which the strict reading splits: longer ones first, so that none is cut by one inside it."""
    return sorted(separators, key=len, reverse=True)


def _split_in_turn(text: Column, separators: tuple[str, ...]) -> Column:
    """The parts that hold more than white space; every separator is looked for in all that the ones before have left."""
    def cut(separator: str) -> Callable[[Column], Column]:
        return lambda p: F.split(p, re.escape(separator))

    parts = F.array(text)
    for s in in_turn(separators):
        parts = F.flatten(F.transform(parts, cut(s)))
    return F.filter(parts, lambda p: F.regexp_replace(p, EDGES, "") != "")


def _scanned(said: Column) -> tuple[Column, Column]:
    """(quoted texts, the rest), read from left to right: a quote that is never closed is put back with all that follows."""
    quotes = F.filter(F.regexp_extract_all(said, F.lit(f"{CLOSED}|{OPEN}"), F.lit(0)), lambda q: q.rlike(f"^(?:{CLOSED})$"))
    terms = F.transform(quotes, lambda q: F.trim(F.substring(q, F.lit(2), F.length(q) - 2)))
    return F.filter(terms, lambda t: t != ""), F.regexp_replace(said, f"{CLOSED}|({OPEN})", "$1")


def clauses(requests: DataFrame, id_col: str = "request_id", text_col: str = "text", strict: bool = False) -> DataFrame:
    """(request_id, terms, alternatives, part, piece, excluded, rest): one row per clause of each request, in the order of part and piece.

    strict: quotes are read as a scan from left to right; separators count as they are written, spaces and case included, one after
    the other; an excluded clause runs up to the next word that excludes. Without it, separators in Latin letters are whole words in
    any case, and what looks like a quotation anywhere is one."""
    rows = requests.select(F.col(id_col).alias("request_id"), F.regexp_replace(fold_width(F.coalesce(F.col(text_col), F.lit(""))), EDGES, "").alias("said"))
    if strict:
        terms, body = _scanned(F.col("said"))
        rows = rows.withColumns({"terms": terms, "body": body})
        rows = rows.withColumns({"ors": _split_in_turn(F.col("body"), ALTERNATIVES), "ands": _split_in_turn(F.col("body"), CONJUNCTIONS)})
    else:
        rows = rows.withColumn("terms", F.transform(F.regexp_extract_all("said", F.lit(_QUOTED), F.lit(0)), lambda q: F.substring(q, F.lit(2), F.length(q) - 2)))
        rows = rows.withColumn("body", F.regexp_replace("said", _QUOTED, " "))
        full = lambda parts: F.filter(parts, lambda p: F.trim(p) != "")
        rows = rows.withColumn("ors", full(F.split("body", "(?i)" + _words(ALTERNATIVES)))).withColumn("ands", full(F.split("body", "(?i)" + _words(CONJUNCTIONS))))
    rows = rows.withColumn("alternatives", F.size("ors") > 1)
    rows = rows.select("request_id", "terms", "alternatives", F.posexplode_outer(F.when(F.col("alternatives"), F.col("ors")).otherwise(F.col("ands"))).alias("part", "chunk"))
    excluding = EXCLUDING if strict else "(?i)" + _words(NEGATIONS)
    rows = rows.select("request_id", "terms", "alternatives", "part", F.posexplode(F.split(F.coalesce("chunk", F.lit("")), excluding)).alias("piece", "rest"))
    return rows.withColumn("excluded", F.col("piece") > 0).withColumn("rest", F.regexp_replace("rest", EDGES, ""))


def analyse(requests: DataFrame, now: datetime, first_weekday: int = 0, id_col: str = "request_id", text_col: str = "text", strict: bool = False) -> DataFrame:
    """One plan per request: positive and negative clauses, combine (and, or), terms, date_start, date_end, media, favorite, place, count, empty. strict: see clauses."""
    rows = clauses(requests, id_col, text_col, strict)
    # Dates: digits at the beginning, else the first relative word.
    number = lambda k: F.nullif(F.regexp_extract("rest", _NUMBERS, k), F.lit(""))
    rows = rows.withColumns({"y": number(1), "m": F.coalesce(number(2), number(4)), "d": F.coalesce(number(3), number(5)), "digits": number(0)})
    start = F.try_to_timestamp(F.concat_ws("-", "y", F.coalesce("m", F.lit("1")), F.coalesce("d", F.lit("1"))), F.lit("yyyy-M-d"))
    rows = rows.withColumn("on", F.when(F.col("y").cast("int").between(1900, 2200), start))
    step = F.when(F.col("d").isNotNull(), F.col("on") + F.make_interval(days=F.lit(1))).when(F.col("m").isNotNull(), F.col("on") + F.make_interval(months=F.lit(1))).otherwise(F.col("on") + F.make_interval(years=F.lit(1)))
    known = relative_dates(now, first_weekday)
    spans = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(a).alias("start"), F.lit(b).alias("end")) for w, a, b in known))
    rows = rows.withColumn("k", F.when(F.col("on").isNull(), _first(F.col("rest"), [(w, F.lit(k)) for k, (w, _, _) in enumerate(known)])).cast("int"))
    span = F.get(spans, F.col("k"))
    cut = F.instr(F.lower("rest"), span["word"])
    rest = F.when(F.col("on").isNotNull(), F.substring("rest", F.length("digits") + 1, F.length("rest")))
    rest = rest.when(F.col("k").isNotNull(), F.concat(F.substring("rest", F.lit(1), cut - 1), F.substring("rest", cut + F.length(span["word"]), F.length("rest")))).otherwise(F.col("rest"))
    rows = rows.withColumns({"date_start": F.coalesce("on", span["start"]), "date_end": F.coalesce(F.when(F.col("on").isNotNull(), step), span["end"]), "rest": F.trim(rest)})
    # Kind, favourites, place, count; each takes its words out.
    rows = rows.withColumn("media", _first(F.col("rest"), [(w, F.lit(kind)) for kind, words in MEDIA for w in words]))
    rows = rows.withColumn("rest", F.when(F.col("media").isNotNull(), _without(F.col("rest"), _words(tuple(w for _, ws in MEDIA for w in ws)))).otherwise(F.col("rest")))
    rows = rows.withColumn("favorite", F.col("rest").rlike("(?i)" + _words(FAVOURITES))).withColumn("rest", _without(F.col("rest"), _words(FAVOURITES)))
    chinese, english = r"在(.{1,40}?)(?:拍摄的|拍的|拍|的|$)", rf"(?i)\b(?:at|in|near)\s+(?!(?:{'|'.join(DETERMINERS)})\b)([^,]{{1,40}})$"
    rows = rows.withColumn("place", F.trim(F.coalesce(F.nullif(F.regexp_extract("rest", chinese, 1), F.lit("")), F.nullif(F.regexp_extract("rest", english, 1), F.lit("")))))
    rows = rows.withColumn("rest", F.when(F.col("place").isNotNull(), F.trim(F.regexp_replace(F.regexp_replace("rest", chinese, ""), english, ""))).otherwise(F.col("rest")))
    rows = rows.withColumn("count", _first(F.col("rest"), [(w, F.lit(n)) for n, words in COUNTS for w in words]).cast("int"))
    rows = rows.withColumn("rest", _without(F.col("rest"), _words(tuple(w for _, ws in COUNTS for w in ws))))
    edge = r"[\s的地得了，。,.!?！？:：;；]+"
    rows = rows.withColumn("rest", _without(F.col("rest"), rf"^(?:{_words(LEADING)}\s*)+"))
    rows = rows.withColumn("rest", _without(F.col("rest"), rf"(?:\s*{_words(TRAILING)})+$"))
    rows = rows.withColumn("rest", F.regexp_replace("rest", f"^{edge}|{edge}$", ""))
    # One row per request again: at most as many clauses as the request has words.
    order = F.struct("part", "piece")
    said = lambda excluded: F.transform(F.array_sort(F.collect_list(F.when((F.col("excluded") == excluded) & (F.col("rest") != ""), F.struct("part", "piece", "rest")))), lambda x: x["rest"])
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    plans = rows.groupBy("request_id").agg(
        said(False).alias("positive"), said(True).alias("negative"), F.any_value("terms").alias("terms"), F.any_value("alternatives").alias("_or"),
        *(first(c).alias(c) for c in ("date_start", "date_end", "media", "place", "count")), F.bool_or("favorite").alias("favorite"),
    )
    plans = plans.withColumn("combine", F.when(F.col("_or") & (F.size("positive") > 0), "or").otherwise("and")).drop("_or")
    plans = plans.withColumn("media", F.when(F.col("favorite") & F.coalesce(F.col("media") != "video", F.lit(True)), "image").otherwise(F.col("media")))
    named = F.col("date_start").isNotNull() | F.col("media").isNotNull() | F.col("place").isNotNull() | F.col("count").isNotNull() | F.col("favorite")
    return plans.withColumn("empty", ~(named | (F.size("positive") > 0) | (F.size("negative") > 0) | (F.size("terms") > 0)))


def implied_places(plans: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """plans with `implied`, the place that a plan without one names in its first clause that holds a place's name; what is left of that clause stays, a blank rest goes.

    "Beijing cats" is a search for cats in Beijing; a plan with a place of its own is left as it is."""
    bare = plans.where("place IS NULL").select("request_id", F.posexplode("positive").alias("at_clause", "clause"))
    named = bare.withColumn("one", F.concat_ws(":", F.col("request_id").cast("string"), "at_clause"))
    found = places.longest_exact(named, gazetteer, "one", whole=True).select("one", F.col("place").alias("implied"), "remainder")
    first = named.join(found, "one").groupBy("request_id").agg(F.min_by(F.struct("at_clause", "implied", "remainder"), "at_clause").alias("b"))
    rows = plans.join(first, "request_id", "left")
    kept = F.filter(F.transform("positive", lambda c, k: F.when(k == F.col("b.at_clause"), F.col("b.remainder")).otherwise(c)), lambda c: c != "")
    rows = rows.withColumn("positive", F.when(F.col("b").isNotNull(), kept).otherwise(F.col("positive"))).withColumn("implied", F.col("b.implied"))
    return rows.withColumn("combine", F.when((F.col("combine") == "or") & (F.size("positive") == 0), "and").otherwise(F.col("combine"))).drop("b")


def understood(spark: SparkSession, text: str, encoder: Encoder, now: datetime) -> tuple[Search, dict]:
    """(request, notes for `search.diagnostics`) of one text: an unknown place becomes one more clause; kinds other than image and video are not filtered by."""
    gazetteer = places.gazetteer(spark)
    plan = implied_places(analyse(spark.createDataFrame([(0, text)], "request_id int, text string"), now), gazetteer).first()
    positive, named, unresolved = list(plan.positive), plan.implied, None
    if plan.place:
        named = places.resolve(spark.createDataFrame([(plan.place,)], "mention string"), gazetteer).first().place
        unresolved = None if named else plan.place
        positive += [plan.place] if unresolved else []
    place = next((p[2:5] for p in places.PLACES if named == p[0]), None)
    crosses = named if place and spark.range(1).select(geo.box(*place)["crosses"]).first()[0] else None
    flt = CandidateFilter(after=plan.date_start, before=plan.date_end, media_type={"image": 1, "video": 2}.get(plan.media), favorite=plan.favorite, place=place, required=tuple(plan.terms))
    request = Search([encoder.encode(c) for c in positive], [encoder.encode(c) for c in plan.negative], plan.combine, flt, constrained=not plan.empty)
    return request, {"clauses": [*positive, *plan.negative], "unresolved": unresolved, "crosses": crosses}


def ask(assets: DataFrame, text: str, encoder: Encoder, now: datetime, limit: int = 60) -> DataFrame:
    """Analyse one request and search."""
    return search(assets, understood(assets.sparkSession, text, encoder, now)[0], limit)


def explain(assets: DataFrame, text: str, encoder: Encoder, now: datetime, limit: int = 60) -> DataFrame:
    """Diagnostics of what `ask` does with the text."""
    request, notes = understood(assets.sparkSession, text, encoder, now)
    return diagnostics(assets, request, limit=limit, **notes)
