"""Filter records as Columns: candidate filters of the search, slideshow filters, keyword and cleanup predicates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, geo, text

#: Bits of `subtype`.
PANORAMA, SCREENSHOT = 1, 4


@dataclass(frozen=True)
class CandidateFilter:
    """Conjunction over searchable assets. after is inclusive, before exclusive; a text term makes rows without text drop out."""

    after: datetime | None = None
    before: datetime | None = None
    media_type: int | None = None
    favorite: bool = False
    has_location: bool = False
    place: tuple[float, float, float] | None = None  # latitude, longitude, radius in km
    required: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()

    def column(self) -> Column:
        out = F.col("vector").isNotNull()
        if self.after is not None:
            out = out & (F.col("created") >= F.lit(self.after).cast("timestamp_ntz"))
        if self.before is not None:
            out = out & (F.col("created") < F.lit(self.before).cast("timestamp_ntz"))
        if self.media_type is not None:
            out = out & (F.col("media_type") == self.media_type)
        if self.favorite:
            out = out & F.coalesce("favorite", F.lit(False))
        if self.has_location:
            out = out & F.col("latitude").isNotNull()
        if self.place is not None:
            out = out & geo.inside(F.col("latitude"), F.col("longitude"), geo.box(*self.place))
        if self.required or self.excluded:
            out = out & text.holds(F.col("text"), self.required, self.excluded)
        return out


def candidates(assets: DataFrame, flt: CandidateFilter, limit: int | None = None) -> DataFrame:
    """Rows that pass, newest first (ties: larger id first) if a limit is set; otherwise in no order."""
    rows = assets.where(flt.column())
    return rows if limit is None else rows.orderBy(F.desc("created"), F.desc("asset_id")).limit(max(1, limit))


@dataclass(frozen=True)
class SlideshowFilter:
    """Content filter plus refinements; content is all, landscape, portrait, square, panorama or high_quality."""

    content: str = "all"
    screen: tuple[int, int] | None = None
    no_screenshots: bool = False
    favorites_only: bool = False
    photos_only: bool = False

    def column(self) -> Column:
        w, h = F.col("width"), F.col("height")
        content = {
            "all": F.lit(True),
            "landscape": w > h,
            "portrait": h > w,
            "square": (w > 0) & (h > 0) & (F.abs(w - h) * 20 <= F.greatest(w, h)),
            "panorama": F.col("subtype").bitwiseAND(F.lit(PANORAMA)) != 0,
            "high_quality": F.lit(True) if self.screen is None else (w >= self.screen[0]) | (h >= self.screen[1]),
        }[self.content]
        if self.no_screenshots:
            content = content & (F.col("subtype").bitwiseAND(F.lit(SCREENSHOT)) == 0)
        if self.favorites_only:
            content = content & F.col("favorite")
        if self.photos_only:
            content = content & (F.col("media_type") == 1)
        return content


SCOPES = {
    "all": None,
    "photos": "media_type = 1",
    "videos": "media_type = 2",
    "favorites": "favorite",
    "screenshots": "(subtype & 4) <> 0",
    "live": "live",
}


def scan(assets: DataFrame, scope: str = "all", start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Photos and videos of a scope with created in [start, end)."""
    rows = assets.where(F.col("media_type").isin(1, 2))
    if SCOPES[scope]:
        rows = rows.where(SCOPES[scope])
    if start is not None:
        rows = rows.where(F.col("created") >= F.lit(start))
    return rows if end is None else rows.where(F.col("created") < F.lit(end))


#: Words that a keyword search takes as a kind.
KEYWORDS = {"photo": "media_type = 1", "photos": "media_type = 1", "image": "media_type = 1", "images": "media_type = 1", "video": "media_type = 2", "videos": "media_type = 2", "favorite": "favorite", "favorites": "favorite"}


def keyword(word: str) -> Column:
    """A kind word, or a year from 1900 to 2100; anything else matches nothing."""
    word = word.strip().lower()
    if word in KEYWORDS:
        return F.expr(KEYWORDS[word])
    if len(word) == 4 and word.isdigit() and 1900 <= int(word) <= 2100:
        return (F.col("created") >= F.lit(datetime(int(word), 1, 1))) & (F.col("created") < F.lit(datetime(int(word) + 1, 1, 1)))
    return F.lit(False)


def title_matches(albums: DataFrame, query: str) -> DataFrame:
    """Albums whose title holds the query in any case, with `shared` to part them; an empty query matches nothing."""
    said = query.strip().lower()
    return albums.where(F.lower("title").contains(said) if said else F.lit(False)).withColumn("shared", F.col("kind") == "shared")


def note_search(notes: DataFrame, query: str, key: str = "asset_id", column: str = "note") -> DataFrame:
    """Notes that hold the query, whatever the case and the accents, by key; a blank query matches nothing."""
    said = text.unaccented(F.lit(query.strip()))
    return notes.where(F.contains(text.unaccented(F.col(column)), said) if query.strip() else F.lit(False)).orderBy(key)


def same_model(rows: DataFrame, version: str, column: str = "model_version") -> DataFrame:
    """Rows whose vector comes from that model: scores against vectors of another one mean nothing."""
    return rows.where(F.col(column) == version)


def on_this_day(assets: DataFrame, today: datetime) -> DataFrame:
    return assets.where(dates.on_this_day(F.col("created"), F.lit(today)))


#: Cleanup categories overlap; missing sizes count as 0.
CLEANUP = {
    "screenshots": "(subtype & 4) <> 0 AND coalesce(bytes, 0) > 1000000",
    "large_images": "media_type = 1 AND NOT live AND coalesce(bytes, 0) >= 5000000",
    "large_videos": "media_type = 2 AND coalesce(bytes, 0) >= 50000000",
    "large_live": "live AND coalesce(bytes, 0) >= 3000000",
}


def cleanup_categories(assets: DataFrame) -> DataFrame:
    """One row per asset and category that it belongs to, in one pass."""
    hits = F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in CLEANUP.items())))
    return assets.select("asset_id", "bytes", F.explode(hits).alias("category"))


def pending(assets: DataFrame, now: datetime, limit: int) -> DataFrame:
    """Work that is due: pending or failed, with no retry time or one that has come; newest first."""
    due = F.col("status").isin("pending", "failed") & (F.col("retry_at").isNull() | (F.col("retry_at") <= F.lit(now).cast("timestamp_ntz")))
    return assets.where(due).orderBy(F.desc("created"), F.desc("asset_id")).limit(limit)
