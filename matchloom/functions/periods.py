"""Dated roles in a text: the one extractor that needs match offsets.

Date ranges found by a more specific pattern hide overlapping finds of a later
one, which no chain of regular-expression Columns can say. Only rows that hold a
digit are sent to Python.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.config import settings
from matchloom.functions import vocab as V
from matchloom.functions.text import has_digit

_ROLE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("finish", T.IntegerType())])
ROLES_TYPE = T.StructType([
    T.StructField("roles", T.ArrayType(_ROLE)), T.StructField("recent_text", T.StringType()),
])

_RANGES = [re.compile(p, re.IGNORECASE if fold else 0) for p, fold in V.DATE_RANGE_PATTERNS]
_BLANK = re.compile(V.BLANK_LINE)


def _full_year(digits: str) -> int:
    year = int(digits)
    if year >= 100:
        return year
    return year + (2000 if year < V.CENTURY_PIVOT else 1900)


def dated_spans(text: str, reference_year: int) -> list[tuple[int, int, int, int]]:
    """(start year, end year, from, to) of each date range, in order of position."""
    taken: list[tuple[int, int]] = []
    spans = []
    for pattern in _RANGES:
        for match in pattern.finditer(text):
            lo, hi = match.span()
            if any(lo < b and a < hi for a, b in taken):
                continue
            taken.append((lo, hi))
            years = [_full_year(g) for g in match.groups()]
            start, finish = years[0], years[1] if len(years) > 1 else reference_year
            if V.EARLIEST_YEAR <= start <= min(finish, reference_year) and finish <= reference_year + 1:
                spans.append((start, finish, lo, hi))
    return sorted(spans, key=lambda s: s[2])


def recent_passages(text: str, spans: list[tuple[int, int, int, int]], since: int) -> str:
    """Text around the ranges that end after ``since``, kept clear of neighbouring roles."""
    breaks = [m.start() for m in _BLANK.finditer(text)]
    passages = []
    for n, (_, finish, lo, hi) in enumerate(spans):
        if finish <= since:
            continue
        left = max(spans[n - 1][3] if n else 0, lo - V.CONTEXT_BEFORE)
        right = min(spans[n + 1][2] if n + 1 < len(spans) else len(text), hi + V.CONTEXT_AFTER)
        left = max((b for b in breaks if left <= b < lo), default=left)
        right = min((b for b in breaks if hi < b <= right), default=right)
        passages.append(text[left:right])
    return "\n\n".join(passages)


@F.pandas_udf(ROLES_TYPE)
def _dated_roles(texts: pd.Series) -> pd.DataFrame:
    year = settings.reference_year
    roles, recent = [], []
    for text in texts:
        spans = dated_spans(text, year) if text else []
        roles.append([{"start": s, "finish": f} for s, f, _, _ in spans])
        recent.append(recent_passages(text, spans, year - settings.recent_window_years) if spans else "")
    return pd.DataFrame({"roles": roles, "recent_text": recent})


#: Part of every find of the date-range patterns; the four separators are blanks in Python only.
_RANGE_SHARED = r"(?U)\d{4}[\s\x1c-\x1f]*[-–—toTO]|\d/\d\d"


def dated_roles(text: Column) -> Column:
    return _dated_roles(F.when(has_digit(text) & text.rlike(_RANGE_SHARED), text))


def recent_roles(roles: Column) -> Column:
    since = settings.reference_year - settings.recent_window_years
    return F.filter(roles, lambda r: r["finish"] > since)


def recent_years(roles: Column) -> Column:
    """Years of the roles inside the window; overlapping roles count twice."""
    since = settings.reference_year - settings.recent_window_years
    return F.aggregate(
        recent_roles(roles),
        F.lit(0.0),
        lambda total, r: total + (r["finish"] - F.greatest(r["start"], F.lit(since))),
    )
