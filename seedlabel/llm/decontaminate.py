"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A benchmark item's windows (``window`` consecutive words; all words of a
shorter item) are the patterns.  Patterns of one length form one matcher: a
shift table over blocks of two words tells how far the search may jump, a
suffix-block bucket selects the patterns that can end at a position, and direct
comparison of all words confirms an occurrence.

The benchmark is the stated query set: its items are dealt into blocks of
about ``BLOCK_WORDS`` words, each collected and broadcast on its own as arrays (no
objects per word: about 60 bytes a word, while it is built a few times that),
and every block is searched in all documents.  One block (the usual case) is a
narrow map without a shuffle; with more, the runs of documents with a hit are merged by
(doc_id, text digest), never a text, and joined back to the rows.

Null and empty texts have no words: 0 hits, the digest of the empty string.  A
very long text is searched whole, at a cost that follows its length.
Items without words never occur; items with equal identifiers count once; a
null identifier is written as the empty string.  Repeated rows give repeated
rows; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.llm.common import filter_batches, scratch_table, sliced, small_batches, text_bytes

WINDOW = 10
#: Words of benchmark items per broadcast block (a single longer item makes its block longer).
BLOCK_WORDS = 1_000_000

_U = np.uint64

#: A-Z lower-cased; every byte that is no ASCII letter or digit and not above 0x7F becomes a blank.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
              for c in range(256))

_RUNS = "doc_id long, digest binary, n_words long, runs array<int>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=_U)


def block_hashes(h: np.ndarray, block: int) -> np.ndarray:
    """Hash of the one or two words that end at every place (of the first word
    alone, where a block of two would begin before it)."""
    out = h * _U(0x9E3779B97F4A7C15)
    if block == 2:
        out[1:] += h[:-1] * _U(0xC2B2AE3D27D4EB4F)
    return (out ^ (out >> _U(29))) * _U(0xD6E8FEB86659FD93)


def window_hashes(h: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m words from each of the places ``first``."""
    out = np.zeros(len(first), _U)
    for k in range(m):
        out = out * _U(0xA0761D6478BD642F) + h[first + k]
    return (out ^ (out >> _U(32))) * _U(0x9E3779B97F4A7C15)


class Items:
    """Words of a block of benchmark items, end to end in arrays."""

    def __init__(self, items: Iterable[tuple[str, bytes]]):
        self.names: list[str] = []
        texts, hashes, at, sizes, lengths = [], [], [], [], []
        end = 0
        for name, raw in items:
            words = words_of(raw)
            if not words:
                continue
            size = np.array([len(w) for w in words], dtype=np.int64)
            self.names.append(name)
            texts.append(b" ".join(words) + b" ")
            hashes.append(word_hashes(words))
            at.append(end + np.cumsum(size + 1) - size - 1)
            sizes.append(size)
            lengths.append(len(words))
            end += len(texts[-1])
        self.text = b"".join(texts)
        none = np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else none.astype(_U)
        self.begin = np.concatenate(at) if at else none  # first byte of every word
        self.end = self.begin + (np.concatenate(sizes) if sizes else none)  # byte after it
        self.lengths = np.array(lengths, dtype=np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths


class WuManber:
    """Occurrences of patterns of ``m`` words each: a shift table over hashed
    blocks of two words (a cell that blocks share holds the least shift, so a
    jump is never too far), buckets of patterns by the hash of their last block,
    sorted by window inside, and comparison of the words.  About 40 bytes a pattern."""

    def __init__(self, items: Items, m: int, first: np.ndarray, item: np.ndarray):
        self.m, self.block = m, min(2, m)
        blocks = block_hashes(items.hashes, self.block)
        # two to four cells a block, within 2^16 and 2^24 bytes
        self.bits = min(24, max(16, int(3 * len(first)).bit_length()))
        self.shift = np.full(1 << self.bits, min(m - self.block + 1, 255), np.uint8)
        for end in range(self.block, m + 1):  # falling shifts: the least one stays
            self.shift[blocks[first + end - 1] >> _U(64 - self.bits)] = min(m - end, 255)
        keys = self._keys(blocks[first + m - 1], window_hashes(items.hashes, first, m))
        order = np.argsort(keys, kind="stable")
        self.keys, self.item = keys[order], item[order].astype(np.int32)
        self.begin, self.end = items.begin[first[order]], items.end[first[order] + m - 1]
        self.text, self.names = items.text, items.names

    @staticmethod
    def _keys(suffix: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Number of the suffix bucket in the high 24 bits, window in the others."""
        return (suffix >> _U(40) << _U(40)) | (window >> _U(24))

    def search(self, words: list[bytes], hashes: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[int, set[str]]]:
        """(first word, items) of every occurrence."""
        m, n = self.m, len(words)
        if n < m:
            return
        shift = self.shift[blocks >> _U(64 - self.bits)].tobytes()
        at, ends = m - 1, []
        while at < n:
            if jump := shift[at]:
                at += jump
            else:
                ends.append(at)
                at += 1
        if not ends:
            return
        ends = np.array(ends)
        first = ends - (m - 1)
        keys = self._keys(blocks[ends], window_hashes(hashes, first, m))
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for i in np.nonzero(hi > lo)[0].tolist():
            k = int(first[i])
            window = b" ".join(words[k:k + m])
            items = {self.names[self.item[x]] for x in range(lo[i], hi[i])
                     if self.text[self.begin[x]:self.end[x]] == window}
            if items:
                yield k, items


def matchers(items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> list[WuManber]:
    held = Items(items)
    lengths = np.minimum(held.lengths, window)
    out = []
    for m in np.unique(lengths).tolist():
        mine = np.nonzero(lengths == m)[0]
        count = held.lengths[mine] - m + 1
        item = np.repeat(mine, count)
        first = np.repeat(held.first[mine] - np.cumsum(count) + count, count) + np.arange(count.sum())
        out.append(WuManber(held, m, first, item))
    return out


def occurrences(words: list[bytes], search: list[WuManber]) -> Iterator[tuple[int, int, set[str]]]:
    """(first word, word after the last, items) of every occurrence."""
    hashes = word_hashes(words)
    blocks = {b: block_hashes(hashes, b) for b in {matcher.block for matcher in search}}
    for matcher in search:
        for first, items in matcher.search(words, hashes, blocks[matcher.block]):
            yield first, first + matcher.m, items


def hit_runs(words: list[bytes], search: list[WuManber]) -> tuple[list[int], set[str]]:
    """Disjoint runs [from, to, from, to ...] of hit words, and the items."""
    spans, found = [], set()
    for first, end, items in occurrences(words, search):
        spans.append((first, end))
        found |= items
    return merge_runs(spans), found


def merge_runs(spans: list[tuple[int, int]]) -> list[int]:
    runs: list[int] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1]:
            runs[-1] = max(runs[-1], b)
        else:
            runs += [a, b]
    return runs


def _scan(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    search = shared.value
    for batch in sliced(batches, 2):
        n_words, runs, items = [], [], []
        for raw in batch.column(2):
            words = words_of(raw.as_py())
            r, found = hit_runs(words, search)
            n_words.append(len(words))
            runs.append(r)
            items.append(sorted(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int32())),
             pa.array(items, pa.list_(pa.string()))], ["doc_id", "digest", "n_words", "runs", "items"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs and items gathered from several blocks -> one set each."""
    for batch in batches:
        runs = [merge_runs([(r[i], r[i + 1]) for r in lists for i in range(0, len(r), 2)])
                for lists in batch.column(2).to_pylist()]
        items = [sorted({x for part in lists for x in part}) for lists in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.int32())),
             pa.array(items, pa.list_(pa.string()))], ["found_id", "found_digest", "runs", "items"])


def pattern_blocks(benchmark: DataFrame, window: int, item_col: str, item_text_col: str, block_words: int) -> list:
    """The matchers of each block of items, broadcast."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"),
                             text_bytes(F.col(f"`{item_text_col}`")).alias("raw"))
    total = items.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * block_words)))  # about six bytes a word
    out = []
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item", "raw"), F.lit(blocks)) == block)
        out.append(sc.broadcast(matchers(((r.item, bytes(r.raw)) for r in mine.toLocalIterator()), window)))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, runs (of hit words), items (that occur)."""
    blocks = pattern_blocks(benchmark, window, item_col, item_text_col, block_words)
    text = text_bytes(F.col(f"`{text_col}`"))
    rows = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       (F.unhex(F.md5(text)) if len(blocks) > 1 else F.lit(b"")).alias("digest"), text.alias("text"))
    parts = [rows.mapInArrow(lambda it, shared=shared: _scan(it, shared), _RUNS) for shared in blocks]
    if len(parts) == 1:
        return parts[0].drop("digest")
    base = scratch_table(parts[0], "benchmark-words")
    hit = [part.filter(F.size("runs") > 0) for part in (base, *parts[1:])]
    gathered = functools.reduce(DataFrame.unionByName, hit).groupBy("doc_id", "digest").agg(
        F.collect_set("runs").alias("runs"), F.collect_set("items").alias("items"))  # equal rows give equal sets
    found = gathered.mapInArrow(_merged, "found_id long, found_digest binary, runs array<int>, items array<string>")
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("digest") == F.col("found_digest"))
    none = F.array().cast("array<int>"), F.array().cast("array<string>")
    return (base.drop("runs", "items").join(found, same, "left")
            .select("doc_id", "n_words", F.coalesce("runs", none[0]).alias("runs"), F.coalesce("items", none[1]).alias("items")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **columns) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    h = hits(docs, benchmark, window, **columns)
    signed = F.transform("runs", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))  # to minus from
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda n, x: n + x)
    return h.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    (F.size("runs") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS
                    ) -> DataFrame:
    """The rows of ``docs`` without a hit, unchanged: a narrow filter, or, for a
    benchmark of several blocks, an anti-join with the digests of the texts hit."""
    blocks = pattern_blocks(benchmark, window, item_col, item_text_col, block_words)
    at = docs.columns.index(text_col)
    if len(blocks) > 1:
        plain = small_batches(docs).toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any column names
        text = text_bytes(F.col(f"c{at}"))
        digest = F.unhex(F.md5(text))
        rows = plain.select(F.lit(None).cast("long").alias("doc_id"), digest.alias("digest"), text.alias("text"))
        parts = [rows.mapInArrow(lambda it, shared=shared: _scan(it, shared), _RUNS) for shared in blocks]
        hit = functools.reduce(DataFrame.unionByName, parts).filter(F.size("runs") > 0)
        hit = hit.select(F.col("digest").alias("hit_digest")).distinct()
        return plain.join(hit, digest == F.col("hit_digest"), "left_anti").toDF(*docs.columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = blocks[0].value
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            mask = [not any(True for _ in occurrences(words_of(t.as_py() or b""), search)) for t in texts]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return filter_batches(small_batches(docs), keep)
