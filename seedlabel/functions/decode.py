"""Decoding of texts stored as Python bytes literals (``b'...'``).

Parsing a literal is a per-row Python job (``ast.literal_eval``, never
``eval``); it runs in an Arrow-batched pandas UDF."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _decode_one(s: str | None) -> str | None:
    if s is None:
        return None
    try:
        v = ast.literal_eval(s)
    except (ValueError, SyntaxError):
        return s
    if isinstance(v, bytes):
        return v.decode("utf-8", errors="replace")
    return str(v)


@F.pandas_udf(T.StringType())
def _decode(s: pd.Series) -> pd.Series:
    return s.map(_decode_one)


def decode_bytes_literal(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return _decode(c)
