"""Column functions over text: cleaning, ids and list columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that count as blank in source files.
BLANK_WORDS = ("", "nan", "null", "none")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(F.lower(F.trim(c, F.lit(" \t\n\x0b\f\r"))).isin(*BLANK_WORDS), F.lit(None)).otherwise(c)


def first_filled(*cols: Column | str) -> Column:
    """First candidate that holds something other than a blank word."""
    return F.coalesce(*[blank_to_null(c) for c in cols]) if cols else F.lit(None).cast("string")


def norm_txid(c: Column | str) -> Column:
    """Trim, and undo a float rendering of an integer id; null becomes an empty text."""
    text = F.coalesce(F.trim(col(c).cast("string")), F.lit(""))
    return F.regexp_replace(text, r"^(-?\d+)\.0$", "$1")


def _pieces(text: Column, *separators: str) -> Column:
    """Split on the first separator present, in the given order."""
    parts = F.array(text)
    for sep in reversed(separators):
        parts = F.when(F.contains(text, F.lit(sep)), F.split(text, "[" + sep + "]")).otherwise(parts)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def _unbracket(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\[(](.*)[\])]$", "$1")


def split_list(c: Column | str) -> Column:
    """A list held in text: JSON array, bracketed literal, or delimited by ; then | then ,"""
    text = F.trim(col(c).cast("string"))
    as_json = F.from_json(text, "array<string>")
    bare = F.regexp_replace(F.trim(_unbracket(text)), "['\"]", "")
    bracketed = text.rlike(r"^[\[(].*[\])]$")
    parts = F.when(bracketed, F.coalesce(_nonempty_json(text, as_json), _pieces(bare, ";", "|", ",")))
    parts = parts.otherwise(_pieces(text, ";", "|", ","))
    return F.coalesce(parts, F.array().cast("array<string>"))


def _nonempty_json(text: Column, parsed: Column) -> Column:
    broken = F.exists(parsed, lambda x: x.isNull()) & ~F.contains(text, F.lit("null"))
    return F.when(text.startswith("[") & ~broken, parsed)


def split_names(c: Column | str) -> Column:
    """Plain list text: split on comma, else semicolon, else spaces; quotes stripped."""
    text = _unbracket(F.trim(col(c).cast("string")))
    parts = (
        F.when(F.contains(text, F.lit(",")), F.split(text, ","))
        .when(F.contains(text, F.lit(";")), F.split(text, ";"))
        .otherwise(F.split(text, r"\s+"))
    )
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    unquoted = F.transform(kept, lambda x: F.regexp_replace(x, "^['\"]+|['\"]+$", ""))
    return F.coalesce(unquoted, F.array().cast("array<string>"))


def split_amounts(c: Column | str) -> Column:
    """Numbers of a list text; items that are not numbers are left out."""
    numbers = F.transform(split_names(c), lambda x: to_double(x))
    return F.filter(numbers, lambda x: x.isNotNull())


def to_double(c: Column | str) -> Column:
    return col(c).try_cast("double")


def short_label(c: Column | str, head: int, tail: int, longer_than: int) -> Column:
    c = col(c)
    cut = F.concat(F.substring(c, 1, head), F.lit("..."), F.right(c, F.lit(tail)))
    return F.when(F.length(c) > longer_than, cut).otherwise(c)
