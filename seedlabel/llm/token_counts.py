"""Token counts with the whole-token shortcut.

Offline proof (once per Python worker): every vocabulary string that is one
pre-token is encoded alone; those giving exactly one token form the set of
whole tokens.  A pre-token of a text that is in the set counts one, and only
the rest runs through the byte-pair merges (the tokenizer's own model, its
result remembered per pre-token in a bounded memo).  Special strings inside a
text count one token each, as the library treats them by default.

Only plain byte-level BPE files are accepted (no normaliser, no prefix blank,
added tokens without strip or single-word rules, no merge-ignoring); any
other raises, since the shortcut would not be proven for it.

Scale: a narrow map, no shuffle; memory per task is one slice of texts and
the memo.  Null and empty texts have 0 tokens; repeated rows give repeated
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.llm.common import sliced, small_batches, text_bytes

#: Fixed value: the byte-level pre-token pattern (white space as Unicode's White_Space property).
PRE_TOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
             r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
LIMIT = 1024
#: Pre-tokens remembered per worker, and the characters of the longest one; the memo starts anew when it is full.
MEMO = 400_000
MEMO_CHARS = 64


def byte_alphabet() -> dict[int, str]:
    """byte -> the character that stands for it in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others are numbered from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    table.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in table)})
    return table


class PreTokenCounts(dict):
    """pre-token -> its number of tokens; merges what it does not know."""

    def __init__(self, whole: list[str], model):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.model = whole, model
        self.alphabet = byte_alphabet()

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize("".join([self.alphabet[b] for b in piece.encode()])))
        if len(piece) > MEMO_CHARS:  # long runs without blanks: not worth their bytes
            return n
        if len(self) >= len(self.whole) + MEMO:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[piece] = n
        return n


class TokenCounter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        added = spec.get("added_tokens") or []
        if (model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel"
                or pre.get("add_prefix_space") or not pre.get("use_regex", True)
                or model.get("dropout") or model.get("ignore_merges")
                or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)):
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.find = regex.compile(PRE_TOKEN).findall
        specials = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.counts = PreTokenCounts(self.whole_tokens(model["vocab"], tokenizer, specials), tokenizer.model)

    def whole_tokens(self, vocab: dict[str, int], tokenizer, specials: list[str]) -> list[str]:
        """The vocabulary strings proven to be one pre-token and one token."""
        back = {c: b for b, c in byte_alphabet().items()}
        strings = []
        for entry in vocab:
            try:
                s = bytes(back[c] for c in entry).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # part of a character: never a whole pre-token
            if s not in specials and self.find(s) == [s]:
                strings.append(s)
        encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
        return [s for s, e in zip(strings, encoded) if len(e.ids) == 1]

    def count(self, text: str) -> int:
        counts = self.counts
        if self.special is None or not self.special.search(text):
            return sum([counts[p] for p in self.find(text)])
        parts = self.special.split(text)
        return len(parts) - 1 + sum(counts[p] for part in parts for p in self.find(part))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    n_tokens = counter(path).count
    for batch in sliced(batches, 1):
        raw = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in raw], pa.int64()),
             pa.array([n_tokens(t.decode(errors="replace")) for t in raw], pa.int64())],
            ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.  ``path`` is the
    tokenizer file's place on every executor."""
    rows = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       text_bytes(F.col(f"`{text_col}`")).alias("text"))
    out = rows.mapInArrow(lambda it: _count(it, path), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
