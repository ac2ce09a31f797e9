"""Text functions of the search: folding, normalising and substring matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms U+FF01..U+FF5E stand 0xFEE0 above ASCII; the ideographic space is a space.
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def fold_width(text: Column) -> Column:
    """Full-width forms to ASCII; nothing else changes. Texts without such forms, most of them, are only looked over."""
    return F.when(text.rlike("[\uFF01-\uFF5E\u3000]"), F.translate(text, _FULL, _HALF)).otherwise(text)


def _folded(text: Column) -> Column:
    """Only white space that is not one plain space already is replaced."""
    return F.trim(F.regexp_replace(F.lower(fold_width(text)), r"\s{2,}|[^\S ]", " "))


def normalise(text: Column) -> Column:
    """Width and case folded, white-space runs to one space, trimmed; blank becomes null."""
    return F.nullif(_folded(text), F.lit(""))


def indexable_lines(lines: Column) -> Column:
    """The normalised lines that are not blank."""
    return F.filter(F.transform(lines, normalise), lambda x: x.isNotNull())


def holds(text: Column, required: Sequence[str] = (), excluded: Sequence[str] = ()) -> Column:
    """The text is not blank and, normalised like the terms, has every required and no excluded term; never null.

    The normalised text is the variable of a lambda, so that it is computed once however many terms there are."""

    def place(said: Column, term: str) -> Column:
        return F.instr(said, F.coalesce(normalise(F.lit(term)), F.lit("")))

    def test(said: Column) -> Column:
        out = said != ""
        for term in required:
            out = out & (place(said, term) > 0)
        for term in excluded:
            out = out & (place(said, term) == 0)
        return out

    return F.coalesce(F.exists(F.array(_folded(text)), test), F.lit(False))


#: Letters of Latin alphabets with a mark, and the letters without it.
_MARKED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž", "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def unaccented(text: Column) -> Column:
    """Lower case, without the marks of Latin letters, written as one character or as letter and mark."""
    return F.regexp_replace(F.translate(F.lower(text), _MARKED, _PLAIN), r"[\u0300-\u036f]", "")


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters; an empty array for shorter texts. One pass: each match is a look ahead."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def natural_key(title: Column) -> Column:
    """A sort key that orders digit runs by value (up to ten digits) and ignores case."""
    padded = F.regexp_replace(F.lower(title), r"(\d+)", "0000000000$1")
    return F.regexp_replace(padded, r"0+(\d{10})(?!\d)", "$1")


def difference_hash_bit(left: Column, right: Column) -> Column:
    return (left > right).cast("long")
