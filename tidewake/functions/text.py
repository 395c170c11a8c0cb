"""Text functions of the post domain."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_URL = re.compile(r"https?://\S+")


def plain_token(value: str) -> str:
    """A tag or handle without accents, width, case and final sigma."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return unicodedata.normalize("NFKC", bare).casefold().replace("ς", "σ")


def plain_text(value: str | None) -> str:
    """A text without links, in compatible case-blind form, with single blanks."""
    return " ".join(unicodedata.normalize("NFKC", _URL.sub("", value or "")).casefold().split())


# Spark has no Unicode normalisation built in, so text beyond ASCII goes through Arrow in batches;
# plain ASCII stays in the JVM and reaches Python as null.
_BLANK = r"\t-\r\x1c-\x1f "


@F.pandas_udf(T.StringType())
def _token_beyond(values: pd.Series) -> pd.Series:
    return values.map(plain_token, na_action="ignore")


@F.pandas_udf(T.StringType())
def _text_beyond(values: pd.Series) -> pd.Series:
    return values.map(plain_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens_beyond(values: pd.Series) -> pd.Series:
    return values.map(lambda a: [plain_token(v) for v in a], na_action="ignore")


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def normalize_token(value: Column | str) -> Column:
    """``plain_token`` of a column; null stays null."""
    c = _column(value)
    return F.when(_is_ascii(c), F.lower(c)).otherwise(_token_beyond(F.when(~_is_ascii(c), c)))


def canonical_text(value: Column | str) -> Column:
    """``plain_text`` of a column; null is ''."""
    c = F.coalesce(_column(value), F.lit(""))
    bare = F.regexp_replace(c, rf"https?://[^{_BLANK}]+", "")
    plain = F.trim(F.regexp_replace(F.lower(bare), rf"[{_BLANK}]+", " "))
    return F.when(_is_ascii(c), plain).otherwise(_text_beyond(F.when(~_is_ascii(c), c)))


def normalize_tokens(values: Column | str) -> Column:
    """``plain_token`` of every element of a list without nulls; null stays null."""
    c = _column(values)
    ascii_ = _is_ascii(F.array_join(c, ""))
    return F.when(ascii_, F.transform(c, F.lower)).otherwise(_tokens_beyond(F.when(~ascii_, c)))


def client_label(source: Column) -> Column:
    """The text of an HTML anchor; without one the value itself; null for null and ''."""
    inner = F.regexp_extract(source, r">([^<]+)<", 1)
    return F.when(source == "", None).when(inner != "", F.trim(inner)).otherwise(source)


def amplified_handle(text: Column) -> Column:
    """The handle of a leading ``RT @handle:``, else null."""
    return F.nullif(F.regexp_extract(text, r"^RT @([A-Za-z0-9_]{1,32}):", 1), F.lit(""))


def clean_handle(value: Column) -> Column:
    """A handle from a handle, an @handle or a profile address; null if nothing is left."""
    text = F.regexp_replace(F.trim(value), "^@", "")
    path = F.regexp_extract(text, r"^https?://[^/?#]*/+([^/?#]*)", 1)
    bare = F.when(F.regexp_like(text, F.lit("^https?://")), path).otherwise(text)
    return F.nullif(F.regexp_replace(F.trim(bare), "^/+|/+$", ""), F.lit(""))


def post_time(value: Column) -> Column:
    """A time as exports write it (``Wed Apr 16 10:55:44 +0000 2026`` or RFC 822); the weekday
    isn't checked; null if it is neither."""
    rest = F.regexp_replace(F.trim(value), r"^[A-Za-z]{3},?\s+", "")
    return F.coalesce(F.try_to_timestamp(rest, F.lit("MMM d HH:mm:ss Z yyyy")), F.try_to_timestamp(rest, F.lit("d MMM yyyy HH:mm:ss Z")))


def cell_time(value: Column) -> Column:
    """A time in a table cell: ISO, else as in posts."""
    return F.coalesce(F.try_to_timestamp(F.nullif(F.trim(value), F.lit(""))), post_time(value))


def cell_count(value: Column) -> Column:
    """A whole number; anything else is 0."""
    return F.coalesce(F.trim(value).try_cast("bigint"), F.lit(0).cast("bigint"))


def cell_flag(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)) == "true", F.lit(False))


def cell_maybe_flag(value: Column) -> Column:
    text = F.lower(F.trim(value))
    return F.when(text == "true", True).when(text == "false", False)
