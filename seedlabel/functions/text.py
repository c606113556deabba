"""Text expressions: sentence splitting, whitespace tokens, Python-style strip.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen and push no work to Python.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference for identical sentence pieces):
# a sentence ends at "; ", ". ", "! ", a newline, or " ?".
SENTENCE_SEPARATORS = r"; |\. |! |\n| \?"

# The characters Python's str.strip()/str.split() treat as
# whitespace (str.isspace): tab, LF, VT, FF, CR, FS, GS, RS, US, space, NEL,
# NBSP, Ogham space, U+2000..U+200A, LS, PS, NNBSP, MMSP, ideographic space.
# The last ones stand behind one range, so that a letter fails two tests only.
_PY_WS = ("[\\t\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x1f \\x85\\xa0"
          "[\\u1680-\\u3000&&[\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]]]")

# Default filter set for substitute words: ASCII punctuation (a rule, not a
# list).  Callers pass their own stop words on top of it.
PUNCTUATION = list(string.punctuation)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()``: remove leading/trailing Python whitespace."""
    return F.regexp_replace(_c(col), f"^{_PY_WS}+|{_PY_WS}+\\z", "")


def tokens(col) -> Column:
    """``str.split()``: runs of whitespace separate tokens, no empty tokens."""
    return F.array_remove(F.split(_c(col), f"{_PY_WS}+", -1), "")


def raw_sentence_pieces(col) -> Column:
    """Lower-cased pieces between separators with empty pieces dropped, NOT
    yet stripped (strip each piece with :func:`py_strip` after exploding)."""
    return F.array_remove(F.split(F.lower(_c(col)), SENTENCE_SEPARATORS, -1), "")


def sentence_pieces(col) -> Column:
    """Lower-case, cut at the sentence separators, drop empty pieces, strip.

    Empty pieces are dropped *before* stripping, so a whitespace-only piece
    survives as an empty sentence, exactly like filter-then-strip in Python.
    """
    pieces = F.split(F.lower(_c(col)), SENTENCE_SEPARATORS, -1)
    return F.transform(F.filter(pieces, lambda p: p != ""), lambda p: py_strip(p))


def collapse_spaces(col) -> Column:
    """Runs of blanks become one blank."""
    return F.regexp_replace(_c(col), " +", " ")


def word_tokens_joined(col) -> Column:
    """Lower-case, split words from punctuation, re-join with single spaces.

    A regex stand-in for a word tokenizer: a token is a run of word
    characters or a single other non-blank character.
    """
    toks = F.regexp_extract_all(F.lower(_c(col)), F.lit(r"(?U)(\w+|[^\w\s])"), 1)
    return F.array_join(toks, " ")


def truncate_tokens(col, n: int = 128) -> Column:
    """First ``n`` whitespace tokens (sequence-length cap of the encoder)."""
    return F.slice(tokens(col), 1, n)

