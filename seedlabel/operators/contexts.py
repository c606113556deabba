"""The vocabulary labeler on packed sentences: substitutes, class vocabularies
and overlap scores as in :mod:`vocabulary`, without a row for every token.

Every block counts its contexts ``(left, right)`` and their words first.  The
contexts are dealt to buckets by a hash of their words; a block sends a bucket
one row of numbers.  Words that make up a fair share of all tokens travel as
their place in a broadcast list of them, the others as text, once a row; which
words the list has changes no result.  A task merges
the rows of a bucket, so all fillers of a context meet there, ranked by count and
word: a context with a large share of all positions arrives as its distinct
words per block.  The merged buckets can be written, to be read by more than
one step.  Class hits go back as numbers, one row per block and bucket, in
the order in which the block sent its contexts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.operators.packed import Block, PackedSentences, blocks_of, by_block, lean_memory, squeezed, unsqueezed
from seedlabel.operators.vocabulary import BOS, EOS
from seedlabel.session import NO_SHUFFLES_LEFT, settings, shared_path, written_at

#: Positions of a bucket, and least number of buckets.
BUCKET_POSITIONS, MIN_BUCKETS = 1 << 20, 32
#: Rows of an Arrow batch of results, and of rows for buckets.
ROWS, BUCKET_ROWS = 1 << 16, 64
#: A word of the broadcast list makes up one token in so many at least (so the list has no more words), and is no longer than this.
COMMON_SHARE, COMMON_LENGTH = 1 << 20, 64

_ROW = "bucket int, block long, data binary"


def _joined(numbers: list[np.ndarray], text: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers and a text in one compressed value; the bytes of
    the numbers lie apart by their weight, since most high ones are zero."""
    all_ = np.concatenate([np.array([len(numbers), *map(len, numbers)]), *numbers]).astype("<i4")
    planes = all_.view(np.uint8).reshape(-1, 4).T.ravel()
    return len(all_).to_bytes(8, "little") + squeezed(np.concatenate([planes, text]), level=3)


def _apart(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """The arrays and the text of :func:`_joined`."""
    n, raw = int.from_bytes(data[:8], "little"), unsqueezed(data[8:], np.uint8)
    all_ = np.ascontiguousarray(raw[:4 * n].reshape(4, n).T).view("<i4").ravel()
    count = int(all_[0])
    cuts = np.cumsum(all_[:count + 1])
    cuts += count + 1 - cuts[0]
    return [all_[a:b] for a, b in zip(cuts[:-1], cuts[1:])], raw[4 * n:]


def _strings(lengths: np.ndarray, text: np.ndarray) -> pa.StringArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(text))


def _text_of(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, text) of an array of words."""
    words = words.cast(pa.string())
    _, offsets, text = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    return np.diff(ends), np.frombuffer(text or b"", np.uint8)[ends[0]:ends[-1]]


class BlockContexts:
    """The distinct contexts of a block, sorted by bucket, then by their words,
    and ``number``, the place of every token's context among them."""

    def __init__(self, block: Block, n_buckets: int):
        codes, size = block.codes.astype(np.int64), len(block.words)
        bos, eos = pc.index_in(pa.array([BOS, EOS], block.words.type), value_set=block.words).to_pylist()
        left, right = np.empty_like(codes), np.empty_like(codes)
        left[1:], right[:-1] = codes[:-1], codes[1:]
        ends, full = np.cumsum(block.sizes), block.sizes > 0
        left[(ends - block.sizes)[full]], right[ends[full] - 1] = bos, eos
        distinct, mine = np.unique(left * size + right, return_inverse=True)
        left = distinct // size
        right = distinct - left * size
        hashes = pd.util.hash_array(block.words.to_numpy(zero_copy_only=False), categorize=False)
        mixed = hashes[left] * np.uint64(0x9E3779B97F4A7C15) + hashes[right]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        bucket = ((mixed >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket.astype(np.min_scalar_type(n_buckets)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.left, self.right, self.bucket, self.number = left[order], right[order], bucket[order], place[mine]


class Bucket:
    """The contexts of a bucket with their fillers, merged over the blocks:
    ``words``, in byte order, those of the list included, and the places ``own``
    of those that are not in the list; ``owner`` (the context),
    ``word``, ``n`` and ``rank`` (from 1) per filler; ``left`` and ``right`` per
    context; ``at``, the contexts of every row of the bucket."""

    def __init__(self, number: int, common: pa.StringArray):
        self.number, self.common = number, common

    @classmethod
    def merged(cls, number: int, common: pa.StringArray, rows: list[tuple[int, bytes]]) -> Bucket:
        self = cls(number, common)
        self.blocks = [block for block, _ in rows]
        parts, lists, before = [], [], 0
        for _, data in rows:
            (left, right, fillers, word, n, lengths), text = _apart(data)
            lists.append(_strings(lengths, text))
            left = np.cumsum(left, dtype=np.int32)
            for codes in (left, right, word):  # words of the rows' own lists are numbered on
                codes[codes >= len(common)] += before
            before += len(lengths)
            parts.append((left, right, fillers, word, n))
        rare = pa.concat_arrays(lists).dictionary_encode()
        known = pa.concat_arrays([common, rare.dictionary])
        order = pc.sort_indices(known).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        place = place[np.concatenate([np.arange(len(common)), len(common) + rare.indices.to_numpy()])]
        self.words, self.own = known.take(pa.array(order)), np.flatnonzero(order >= len(common))
        at = np.cumsum([len(p[0]) for p in parts])
        left, right, fillers, word, n = (np.concatenate(x) for x in zip(*parts))
        del parts, lists
        size, left, right = len(self.words), place[left], place[right]
        distinct, mine = np.unique(left * size + right, return_inverse=True)
        self.left, self.right, self.at = distinct // size, distinct % size, np.split(mine.astype(np.int32), at[:-1])
        key = np.repeat(mine, fillers) * size + place[word]
        del left, right, word, mine
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.add.reduceat(n[order].astype(np.int64), first)
        key = key[first]
        del order
        owner = key // size
        word = key - owner * size
        starts = np.searchsorted(owner, np.arange(len(distinct)))
        many = np.diff(starts, append=len(owner))[owner] > 1  # the only filler of a context is the first
        by = np.arange(len(owner))
        some = by[many]
        by[many] = some[np.lexsort((-n[some], owner[some]))]  # stable: equal counts stay in the order of the words
        self.owner, self.word, self.n = owner, word[by], n[by]
        self.rank = np.arange(len(by)) - starts[owner] + 1
        return self

    def row(self) -> pa.RecordBatch:
        """The bucket in one row, without the words of its contexts."""
        fillers = np.bincount(self.owner) if len(self.owner) else self.owner
        lengths, text = _text_of(self.words.take(pa.array(self.own)))
        wide = self.n >= 1 << 31
        data = _joined([fillers, self.word, np.where(wide, 0, self.n), self.own, lengths], text)
        at = [squeezed(np.diff(a, prepend=np.int32(0))) for a in self.at]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.number], pa.int32()), pa.array([data], pa.binary()), pa.array([squeezed(self.n[wide])], pa.binary()),
             pa.array([self.blocks], pa.list_(pa.int64())), pa.array([at], pa.list_(pa.binary()))],
            ["bucket", "data", "wide", "blocks", "at"])

    @classmethod
    def of_row(cls, r: dict, common: pa.StringArray) -> Bucket:
        self = cls(r["bucket"], common)
        (fillers, word, n, self.own, lengths), text = _apart(r["data"])
        order = np.empty(len(common) + len(lengths), np.int64)
        listed = np.ones(len(order), bool)
        listed[self.own] = False
        order[listed], order[self.own] = np.arange(len(common)), np.arange(len(common), len(order))
        self.words = pa.concat_arrays([common, _strings(lengths, text)]).take(pa.array(order))
        self.n, self.word = n.astype(np.int64), word.astype(np.int64)
        self.n[self.n == 0] = unsqueezed(r["wide"], np.int64)
        self.owner = np.repeat(np.arange(len(fillers)), fillers)
        self.rank = np.arange(len(word)) - np.repeat(np.cumsum(fillers) - fillers, fillers) + 1
        self.blocks, self.at = r["blocks"], [np.cumsum(unsqueezed(a)) for a in r["at"]]
        return self

    @property
    def n_contexts(self) -> int:
        return int(self.owner[-1]) + 1 if len(self.owner) else 0  # a context has a filler


_BUCKET_ROW = "bucket int, data binary, wide binary, blocks array<long>, at array<binary>"


def _sent(batches: Iterator[pa.RecordBatch], n_buckets: int, common: pa.StringArray) -> Iterator[pa.RecordBatch]:
    """Blocks -> one row for every bucket that a block has contexts of."""
    lean_memory()
    for batch in batches:
        for number, block in zip(batch.column("block").to_pylist(), blocks_of(batch)):
            if not len(block.codes):
                continue
            size, contexts = len(block.words), BlockContexts(block, n_buckets)
            key, n = np.unique(contexts.number * size + block.codes, return_counts=True)
            owner = key // size
            word, fillers = key - owner * size, np.bincount(owner, minlength=len(contexts.left))
            buckets = contexts.bucket
            listed = pc.index_in(block.words.cast(pa.string()), value_set=common).fill_null(-1).to_numpy()
            # words outside of the list: their place among those that the row of the bucket needs
            refs = [contexts.left, contexts.right, word]
            codes = [listed[x] for x in refs]
            rare = [c < 0 for c in codes]
            asked, own = np.unique(np.concatenate([b[m] * size + x[m] for b, m, x in zip(
                (buckets, buckets, buckets[owner]), rare, refs)]), return_inverse=True)
            del key, owner, refs
            lengths, text = _text_of(block.words.take(pa.array(asked % size)))
            cut = np.searchsorted(asked // size, np.arange(n_buckets + 1))
            at = len(common) + own - cut[asked // size][own]
            for c, m in zip(codes, rare):
                c[m], at = at[:np.count_nonzero(m)], at[np.count_nonzero(m):]
            left, right, word = codes
            until = np.concatenate([[0], np.cumsum(fillers)])
            ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            starts = np.flatnonzero(np.diff(buckets, prepend=-1)).tolist()
            rows = []
            for a, b in zip(starts, [*starts[1:], len(buckets)]):
                x, y = until[a], until[b]
                k = int(buckets[a])
                u, v = cut[k], cut[k + 1]
                rows.append((k, number, _joined(
                    [np.diff(left[a:b], prepend=0), right[a:b], fillers[a:b], word[x:y], n[x:y], lengths[u:v]],
                    text[ends[u]:ends[v]])))
                if len(rows) == BUCKET_ROWS or b == len(buckets):
                    yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(
                        zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "block", "data"])
                    rows = []


def _merged(batches: Iterator[pa.RecordBatch], common: pa.StringArray) -> Iterator[Bucket]:
    """Rows sorted by bucket and block -> the buckets."""
    lean_memory()
    number, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != number and rows:
                yield Bucket.merged(number, common, rows)
                rows = []
            number = r["bucket"]
            rows.append((r["block"], r["data"]))
    if rows:
        yield Bucket.merged(number, common, rows)


def common_words(sent: PackedSentences, n_tokens: int, share: int) -> pa.StringArray:
    """The sentence edges and the words that make up one token in ``share`` or more, in byte order.
    A block tells of the words that are twice as common in it, so a few may be missing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch):
                n = np.bincount(block.codes, minlength=len(block.words))
                found = pa.array(np.flatnonzero(n * share >= max(2 * len(block.codes), 1)))
                yield pa.RecordBatch.from_arrays([block.words.take(found), pa.array(n).take(found)], ["word", "n"])

    few = (sent.table.select("words", "sizes", "codes").mapInArrow(run, "word string, n long")
           .filter(F.octet_length("word") <= COMMON_LENGTH).groupBy("word").agg(F.sum("n").alias("n"))
           .filter(F.col("n") * F.lit(share) >= F.lit(n_tokens)))
    found = few.select("word").toArrow().column("word").cast(pa.string())
    words = pa.concat_arrays([pa.array([BOS, EOS]), *found.chunks]).unique()
    return words.take(pc.sort_indices(words))


def _usable(words: pa.Array, filter_words: list[str]) -> np.ndarray:
    out = pc.or_(pc.is_in(words, value_set=pa.array(filter_words, words.type)), pc.match_substring(words, "##"))
    return ~out.to_numpy(zero_copy_only=False)


@dataclass
class PackedContexts:
    """The contexts of packed sentences, dealt to ``n_buckets`` buckets;
    ``table`` at ``path`` has the merged buckets once they are written."""
    sent: PackedSentences
    n_buckets: int
    common: pa.StringArray
    table: DataFrame | None = None
    path: str | None = None

    def map_buckets(self, fn: Callable[[Bucket], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        n, common = self.n_buckets, self.common
        if self.table is not None:
            return self.table.mapInArrow(lambda it: (out for batch in it for r in batch.to_pylist()
                                                     for out in fn(Bucket.of_row(r, common))), schema)
        rows = self.sent.table.select("block", "sizes", "words", "codes").mapInArrow(lambda it: _sent(it, n, common), _ROW)
        return (rows.repartition(n, "bucket").sortWithinPartitions("bucket", "block")
                .mapInArrow(lambda it: (out for bucket in _merged(it, common) for out in fn(bucket)), schema))

    def written(self) -> PackedContexts:
        """The same with the merged buckets written, for class vocabularies and hits."""
        rows = self.map_buckets(lambda b: iter([b.row()]), _BUCKET_ROW)
        with settings(rows.sparkSession, NO_SHUFFLES_LEFT):
            path = shared_path(rows.sparkSession, "merged-contexts")
            return replace(self, table=written_at(rows, path, compression="none"), path=path)


def contexts(sent: PackedSentences, bucket_positions: int = BUCKET_POSITIONS, share: int = COMMON_SHARE) -> PackedContexts:
    n = sent.n_tokens()
    return PackedContexts(sent, max(MIN_BUCKETS, -(-n // bucket_positions)), common_words(sent, n, share))


def substitutes(ctx: PackedContexts, k: int) -> DataFrame:
    """:func:`vocabulary.substitutes`: ``(left, right, word, n, rank)``."""
    def run(b: Bucket) -> Iterator[pa.RecordBatch]:
        top = np.flatnonzero(b.rank <= k)
        for at in range(0, len(top), ROWS):
            i = top[at:at + ROWS]
            yield pa.RecordBatch.from_arrays(
                [b.words.take(pa.array(x[b.owner[i]])) for x in (b.left, b.right)]
                + [b.words.take(pa.array(b.word[i])), pa.array(b.n[i]), pa.array(b.rank[i].astype(np.int32))],
                ["left", "right", "word", "n", "rank"])

    return ctx.map_buckets(run, "left string, right string, word string, n long, rank int")


def class_vocabulary(ctx: PackedContexts, seeds: DataFrame, k: int, filter_words: list[str]) -> DataFrame:
    """:func:`vocabulary.class_vocabulary` with the ``k`` first substitutes:
    ``(cls, word, freq)``; ``seeds`` is a parameter, one row per seed word."""
    by_class: dict[int, list[str]] = {}
    for r in seeds.collect():
        by_class.setdefault(r["cls"], []).append(r["word"])

    def run(b: Bucket) -> Iterator[pa.RecordBatch]:
        top = np.flatnonzero((b.rank <= k) & _usable(b.words, filter_words)[b.word])
        for cls, words in by_class.items():
            seed = pc.is_in(b.words, value_set=pa.array(words, b.words.type)).to_numpy(zero_copy_only=False)
            occ = np.bincount(b.owner, np.where(seed[b.word], b.n, 0), b.n_contexts)
            freq = np.bincount(b.word[top], occ[b.owner[top]], len(b.words)).astype(np.int64)
            found = np.flatnonzero(freq)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), cls, np.int32)),
                                              b.words.take(pa.array(found)), pa.array(freq[found])], ["cls", "word", "freq"])

    return ctx.map_buckets(run, "cls int, word string, freq long").groupBy("cls", "word").agg(F.sum("freq").alias("freq"))


def class_hits(ctx: PackedContexts, vocab_m: DataFrame, k: int, filter_words: list[str], n_classes: int) -> DataFrame:
    """:func:`vocabulary.context_class_hit_arrays` with the ``k`` first
    substitutes: ``(block, bucket, hits)``, a block's contexts of a bucket by
    class.  The vocabulary is bounded by classes x m."""
    first = vocab_m.groupBy("word").agg(F.min("cls").alias("cls")).collect()
    words, classes = [r["word"] for r in first], np.array([*(r["cls"] for r in first), -1])
    kind = np.min_scalar_type(max(k, 1))

    def run(b: Bucket) -> Iterator[pa.RecordBatch]:
        found = pc.index_in(b.words, value_set=pa.array(words, b.words.type)).fill_null(-1).to_numpy()
        cls = np.where(_usable(b.words, filter_words), classes[found], -1)[b.word]
        hit = (b.rank <= k) & (cls >= 0)
        hits = np.bincount(b.owner[hit] * n_classes + cls[hit], minlength=b.n_contexts * n_classes)
        hits = hits.reshape(-1, n_classes).astype(kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(b.blocks, pa.int64()), pa.array([b.number] * len(b.blocks), pa.int32()),
             pa.array([bytes([kind.itemsize]) + squeezed(hits[at]) for at in b.at], pa.binary())], ["block", "bucket", "hits"])

    return ctx.map_buckets(run, "block long, bucket int, hits binary")


def overlap_scores(ctx: PackedContexts, ids: list[str], hits: DataFrame, n_classes: int, filter_words: list[str],
                   lexicon: list[str] | DataFrame | None = None, carry=()) -> DataFrame:
    """:func:`vocabulary.overlap_scores` of the packed sentences, with the
    ``hits`` of :func:`class_hits`.  A lexicon table is asked for the words of
    every block once."""
    sent, n_buckets, keep = ctx.sent, ctx.n_buckets, [*ids, *carry]
    from_table = isinstance(lexicon, DataFrame)
    listed = None if from_table else lexicon
    # the block itself first, then its words in the lexicon, then its hits by bucket
    rows = sent.table.select("block", F.lit(-2).alias("bucket"), *keep, "sizes", "words", "codes")
    rows = rows.unionByName(hits, allowMissingColumns=True)
    if from_table:
        known = sent.words().join(lexicon.select("word").distinct(), "word").groupBy("block").agg(
            F.collect_list("code").alias("known"))  # at most the words of a block
        rows = rows.unionByName(known.withColumn("bucket", F.lit(-1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for parts in by_block(batches):
            base = parts[0]
            block = next(blocks_of(base.slice(0, 1)))
            ok = ~pc.is_in(block.words, value_set=pa.array(filter_words, block.words.type)).to_numpy(zero_copy_only=False)
            if from_table:
                inside = np.zeros(len(ok), bool)
                for p in parts:
                    inside[p.column("known").flatten().to_numpy()] = True
                ok &= inside
            elif listed is not None:
                ok &= pc.is_in(block.words, value_set=pa.array(listed, block.words.type)).to_numpy(zero_copy_only=False)
            found = [unsqueezed(h[1:], f"u{h[0]}") for p in parts for h in p.column("hits").to_pylist() if h is not None]
            by_context = np.concatenate([np.zeros(0, np.uint8), *found]).reshape(-1, n_classes)
            chosen = ok[block.codes]
            sentence, n = block.sentence()[chosen], len(block.sizes)
            mine = by_context[BlockContexts(block, n_buckets).number[chosen]] if len(block.codes) else by_context
            kept = [base.column(c)[0].values for c in keep]
            sums = [np.bincount(sentence, mine[:, c], n).astype(np.int64) for c in range(n_classes)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.bincount(sentence, minlength=n)), *map(pa.array, sums)],
                [*keep, "n_cand", *(f"_h{c}" for c in range(n_classes))])

    schema = ", ".join([*(f"`{c}` {sent.kinds[c]}" for c in keep), "n_cand long",
                        *(f"_h{c} long" for c in range(n_classes))])
    scored = rows.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(run, schema)
    # sentences of the same ids, wherever they stand, are one
    sums = scored.groupBy(*ids).agg(*[F.first(c).alias(c) for c in carry], F.sum("n_cand").alias("n_cand"), *[
        F.sum(f"_h{c}").cast("double").alias(f"_h{c}") for c in range(n_classes)])
    n = F.greatest(F.col("n_cand"), F.lit(1))
    return sums.select(*ids, *carry, F.col("n_cand").cast("int").alias("n_cand"),
                       F.array(*[F.col(f"_h{c}") / n for c in range(n_classes)]).alias("scores"))
