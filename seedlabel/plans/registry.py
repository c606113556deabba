"""All registered queries and their SQL oracles."""

from __future__ import annotations

from seedlabel.plans import (embedding_queries, io_queries, learning_queries, model_queries, seedword_queries, stream_queries,
                             tabular_queries, text_queries, vocab_queries)

_MODULES = [embedding_queries, text_queries, vocab_queries, seedword_queries, tabular_queries, learning_queries,
            stream_queries, io_queries, model_queries]


def all_queries() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def all_oracles() -> dict:
    out = {}
    for m in _MODULES:
        out.update(getattr(m, "ORACLE", {}))
    return out
