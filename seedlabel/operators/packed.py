"""Sentences in blocks of numbered words.

A task cuts its sentences into blocks of about BLOCK_TOKENS tokens.  A block is
one row: its distinct words in byte order, and the tokens of its sentences as
places in that list.  What a query counts is counted inside the blocks first,
and what it must know of a word (a score, a tag) is asked once a block: shuffles
move the distinct words of blocks, never their tokens.  Numbers travel
compressed, since they leave little to the shuffle's own codec.

The sentence edges ``<s>`` and ``</s>`` stand in the list of every block.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.operators.vocabulary import BOS, EOS
from seedlabel.session import shared_path, written_at

#: Tokens and sentences of a block (a longer sentence is a block of its own).
BLOCK_TOKENS = 3 << 20
#: Bytes of an Arrow batch sent to Python: a block or a few.
BATCH_BYTES = 4 << 20


def lean_memory() -> None:
    """In a worker: large arrays are apart from the heap and go back to the
    machine when they are freed, instead of staying with a worker that is used again."""
    pa.set_memory_pool(pa.system_memory_pool())
    if hasattr(libc := ctypes.CDLL(None), "mallopt"):
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD


def squeezed(values: np.ndarray, level: int = 1) -> bytes:
    """An array's bytes, compressed, behind their number."""
    raw = values.tobytes()
    codec = pa.Codec("zstd", compression_level=level)
    return len(raw).to_bytes(8, "little") + (codec.compress(raw, asbytes=True) if raw else b"")


def unsqueezed(data: bytes, dtype=np.int32) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.zeros(0, dtype)
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype)


def in_byte_order(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the distinct words in byte order, the place of every word among them)."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


class Block:
    """The words of a block, its tokens as places in them, and the sizes of its sentences."""

    def __init__(self, words: pa.Array, codes: np.ndarray, sizes: np.ndarray):
        self.words, self.codes, self.sizes = words, codes, sizes

    def sentence(self) -> np.ndarray:
        """Number of the sentence of every token."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def place(self) -> np.ndarray:
        """Place of every token in its sentence, from 0."""
        return np.arange(len(self.codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)


def blocks_of(batch: pa.RecordBatch) -> Iterator[Block]:
    """The blocks in the columns words, codes and sizes of a batch."""
    for words, codes, sizes in zip(batch.column("words"), batch.column("codes"), batch.column("sizes")):
        yield Block(words.values, unsqueezed(codes.as_py()), unsqueezed(sizes.as_py()))


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of every block, from rows sorted by block."""
    block, rows = None, []
    for batch in batches:
        at = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if at[a] != block and rows:
                yield rows
                rows = []
            block = at[a]
            rows.append(batch.slice(a, b - a))
    if rows:
        yield rows


@dataclass
class PackedSentences:
    """``(block, n_tokens, *keep arrays, sizes, words, codes)``, written; the
    kept columns have one entry a sentence."""
    table: DataFrame
    keep: list[str]
    kinds: dict[str, str]

    def words(self) -> DataFrame:
        """``(block, code, word)``: every distinct word of every block."""
        return self.table.select("block", F.posexplode("words").alias("code", "word"))

    def n_tokens(self) -> int:
        return self.table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]


def pack(sent: DataFrame, keep: list[str], tokens_col: str = "tokens",
         block_tokens: int = BLOCK_TOKENS) -> PackedSentences:
    """The sentences of a table with a column of tokens, packed and written once."""
    rows = sent.select(*keep, F.coalesce(F.col(tokens_col), F.array().cast("array<string>")).alias("_tokens"))
    return _pack(rows, dict(rows.dtypes[:-1]), lambda batches: batches, block_tokens)


def pack_texts(docs: DataFrame, keep: list[str], text_col: str = "text",
               block_tokens: int = BLOCK_TOKENS) -> PackedSentences:
    """:func:`pack` of the tokens of the sentences of texts (``split_sentences``,
    then ``tokens``), with the place of the sentence as ``pos`` behind the kept columns."""
    rows = docs.select(*keep, F.lower(text_col).alias("_text")).filter(F.col("_text").isNotNull())

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, pos, tokens = sentence_tokens(batch.column(len(keep)))
            doc = pa.array(doc)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(doc) for i in range(len(keep))), pa.array(pos), tokens],
                                             [*keep, "pos", "_tokens"])

    return _pack(rows, {**dict(rows.dtypes[:-1]), "pos": "int"}, sentences, block_tokens)


#: By byte: white space of one byte, and the first bytes of longer white space.
_BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_LONG_BLANKS = [c.encode() for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200b)))]
_LONG_FIRST = np.isin(np.arange(256), [b[0] for b in _LONG_BLANKS])
_STOP = np.isin(np.arange(256), list(b";.!"))


def sentence_tokens(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """(text, place in the text, tokens) of every sentence of lower-case texts,
    cut as by ``raw_sentence_pieces`` and ``tokens``, on the bytes of all texts at once."""
    texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.list_(pa.string()))
    start = np.zeros(len(data) + 1, bool)  # of a text
    start[ends[:-1]] = True
    start = start[:-1]
    # what ends a sentence: one of ;.! and a blank, a blank and a question mark, a line feed
    stop, mark = np.zeros(len(data), bool), np.zeros(len(data), bool)
    stop[:-1] = _STOP[data[:-1]] & (data[1:] == 32) & ~start[1:]
    mark[:-1] = (data[:-1] == 32) & (data[1:] == 63) & ~start[1:]
    mark[1:] &= ~stop[:-1]  # that blank is the other's
    two = stop | mark
    cut = two | (data == 10)
    cut[1:] |= two[:-1]
    out = _BLANK[data] | cut
    first = np.flatnonzero(_LONG_FIRST[data])
    for blank in _LONG_BLANKS if len(first) else ():
        at = first[first + len(blank) <= len(data)]
        for i, byte in enumerate(blank):
            at = at[data[at + i] == byte]
        for i in range(len(blank)):
            out[at + i] = True
    # pieces and tokens are the runs of bytes in none of these, within a text
    head = ~cut
    head[1:] &= cut[:-1] | start[1:]
    token = ~out
    text, kept = data[token], np.flatnonzero(token)
    token[1:] &= out[:-1] | start[1:]
    begins, piece = np.flatnonzero(token), np.flatnonzero(head)
    offsets = np.append(np.searchsorted(kept, begins), len(kept)).astype(np.int32)
    sizes = np.append(np.searchsorted(begins, piece), len(begins)).astype(np.int32)
    doc = np.searchsorted(ends, piece, "right") - 1
    pos = np.arange(len(piece)) - np.searchsorted(piece, ends[:-1])[doc]
    tokens = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(text))
    return doc, pos.astype(np.int32), pa.ListArray.from_arrays(pa.array(sizes), tokens)


def _pack(rows: DataFrame, kinds: dict[str, str], sentences: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
          block_tokens: int) -> PackedSentences:
    """Rows of which a function makes the kept columns and the tokens of sentences."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    keep = list(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        number = TaskContext.get().partitionId() << 24
        held: list[pa.RecordBatch] = []
        room = block_tokens

        def flush() -> pa.RecordBatch:
            lists = [b.column(len(keep)) for b in held]
            sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]).astype(np.int32)
            flat = pa.concat_arrays([*(x.flatten() for x in lists), pa.array([BOS, EOS], lists[0].type.value_type)])
            words, codes = in_byte_order(flat)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            kept = [one(pa.concat_arrays([b.column(i) for b in held])) for i in range(len(keep))]
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([len(codes) - 2], pa.int64()), *kept,
                 pa.array([squeezed(sizes)], pa.binary()), one(words),
                 pa.array([squeezed(codes[:-2].astype(np.int32))], pa.binary())],
                ["block", "n_tokens", *keep, "sizes", "words", "codes"])

        for batch in sentences(batches):
            used = np.cumsum(np.diff(batch.column(len(keep)).offsets.to_numpy()) + 1)  # an empty sentence counts, too
            at = before = 0
            while at < batch.num_rows:
                end = int(np.searchsorted(used, before + room, "right"))
                if end == at and held:
                    yield flush()
                    held, room, number = [], block_tokens, number + 1
                    continue
                end = max(end, at + 1)
                held.append(batch.slice(at, end - at))
                room -= int(used[end - 1]) - before
                at, before = end, int(used[end - 1])
        if held:
            yield flush()

    schema = ", ".join(["block long, n_tokens long", *(f"`{c}` array<{k}>" for c, k in kinds.items()),
                        "sizes binary, words array<string>, codes binary"])
    path = shared_path(rows.sparkSession, "packed-sentences")
    return PackedSentences(written_at(rows.mapInArrow(run, schema), path, compression="zstd"), keep, kinds)
