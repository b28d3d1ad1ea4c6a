"""Arrow-batched functions for what Spark has no built-in for; each works row by row on small values."""

from __future__ import annotations

import datetime
import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.text import SMART_PUNCTUATION, market_key, text


@F.pandas_udf(T.StringType())
def _fold(values: pd.Series) -> pd.Series:
    table = str.maketrans(SMART_PUNCTUATION)
    plain = lambda t: unicodedata.normalize("NFKD", re.sub(r"\r\n|\r|\n", " ", t).translate(table)).encode("ascii", "ignore").decode()
    return values.fillna("").map(plain)


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a.fillna(""), b.fillna(""), strict=True)])


@F.pandas_udf(T.StringType())
def _locate(pages: pd.Series, claims: pd.Series) -> pd.Series:
    """The words of the page that a claim repeats up to case, space and punctuation."""

    def one(page: str, claim: str) -> str | None:
        letters = [(i, c) for i, c in enumerate(page.lower()) if c.isalnum()]
        key = "".join(c for c in claim.lower() if c.isalnum())
        at = "".join(c for _, c in letters).find(key) if key else -1
        if at < 0:
            return None
        start, end = letters[at][0], letters[at + len(key) - 1][0] + 1
        while end < len(page) and page[end] in ".!?)\"'":
            end += 1
        return page[start:end]

    return pd.Series([one(p, c) for p, c in zip(pages.fillna(""), claims.fillna(""), strict=True)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("a", "b", "n")])))
def _align(a: pd.Series, b: pd.Series) -> pd.Series:
    blocks = lambda x, y: [{"a": m.a, "b": m.b, "n": m.size} for m in SequenceMatcher(None, list(x), list(y), autojunk=False).get_matching_blocks() if m.size]
    return pd.Series([blocks(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DateType())
def _stable_date(values: pd.Series) -> pd.Series:
    """A fuzzy date that doesn't depend on what the parser fills in: two defaults must agree."""
    from dateutil import parser

    defaults = (datetime.datetime(2000, 1, 1), datetime.datetime(2001, 2, 2))

    def one(t: str) -> datetime.date | None:
        if not re.search(r"(?<!\d)20\d{2}(?!\d)", t):
            return None
        try:
            first, second = (parser.parse(t, fuzzy=True, default=d).date() for d in defaults)
        except (ValueError, OverflowError, TypeError):
            return None
        return first if first == second else None

    return values.fillna("").map(one)


def stable_fuzzy_date(c: Column | str) -> Column:
    """The date in free text with a year 20xx, if it is whole; null rather than a guess."""
    return _stable_date(text(c))


def ascii_fold(c: Column | str) -> Column:
    """Plain ASCII for spreadsheets."""
    return _fold(text(c))


def similarity(a: Column | str, b: Column | str) -> Column:
    """Gestalt similarity (twice the matched letters over all letters) of two vocabulary names."""
    return _ratio(market_key(a), market_key(b))


def token_ratio(a: Column, b: Column) -> Column:
    """Gestalt similarity of two sorted token lists."""
    return _ratio(F.array_join(a, " "), F.array_join(b, " "))


def locate_verbatim(page: Column | str, claim: Column | str) -> Column:
    """The page's own words for a claimed quote, or null."""
    return _locate(text(page), text(claim))


def align_equal_blocks(a: Column, b: Column) -> Column:
    """Equal blocks (positions from 0 and length) of two short sequences."""
    return _align(a, b)
