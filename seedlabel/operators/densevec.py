"""Dense word vectors: a low-rank factorisation of the PPMI table.

The table of positive pointwise mutual information is symmetric and sparse.
Block power iteration finds its leading directions: ``Z = X Q`` for a block
``Q`` of ``dims`` columns, started from hashes of the word numbers,
orthonormalised after every product; from the last product come the singular
values and vectors.  Word vectors are left vectors times the root of the values.

Scale: words are dealt to blocks by number (so frequent words spread evenly).
Packed sentences count their pairs as numbers, a share of the blocks at a time,
and the table is written once, as entries of a block of rows and a block of
columns.  A product moves nothing between tasks: a task holds a block of rows of
``Z`` and its entries, and reads ``Q`` part by part from the shared folder.  Two
sets of columns are kept at most, in single precision (4 x ``dims`` bytes a
word); the shuffle files of a step go with it.  The driver sees only ``dims`` x
``dims`` matrices, one per block.  Sums run in an order fixed by the data, or on
a grid where they are exact, so the vectors do not depend on the number of cores
or partitions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.operators.countvec import margins
from seedlabel.operators.packed import Block, PackedSentences, pack, squeezed, unsqueezed
from seedlabel.operators.splits import global_index
from seedlabel.session import (NO_SHUFFLES_LEFT, ROW_BY_ROW, UNION_APART, emptied, settings, shared_path, written_at,
                               written_table)

DIMS = 100
ROUNDS = 3          # products before the last one
MIN_PAIRS = 10
#: Words of a block (at most; a task holds dims x 8 bytes for each) and least number of blocks.
BLOCK_WORDS, MIN_BLOCKS = 1 << 17, 12
#: Words of a part of a block, the unit in which columns are read and written (at most 1 << 16).
PART_WORDS = 1 << 13
#: Entries multiplied at once.
CHUNK = 4096
#: Pairs are counted in up to so many passes, one for every so many tokens.
MAX_PASSES, PASS_TOKENS = 4, 1 << 22
SEED = 42

_ENTRIES = "block int, source int, m binary, words array<string>, rows binary, cols binary, n binary"
_COLUMNS = "block int, part int, m binary, words array<string>, q binary, gram binary, most double"


@dataclass(frozen=True)
class Layout:
    """Where a word stands: number ``i`` is place ``i // blocks`` of block ``i % blocks``."""
    n_words: int
    blocks: int
    part: int

    @classmethod
    def of(cls, n_words: int) -> Layout:
        return cls(n_words, min(n_words, max(MIN_BLOCKS, -(-n_words // BLOCK_WORDS))), PART_WORDS)

    @property
    def size(self) -> int:
        return -(-self.n_words // self.blocks)

    @property
    def unit(self) -> int:
        """Keys of a block of rows and a block of columns: part of the columns, row, place in the part."""
        return -(-self.size // self.part) * self.size * self.part

    def key(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        place = j // self.blocks
        return ((i % self.blocks * self.blocks + j % self.blocks) * self.unit
                + (place // self.part * self.size + i // self.blocks) * self.part + place % self.part)

    def squeeze(self, inner: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """Sorted keys within a unit, and their counts."""
        return (squeezed(np.diff(inner // self.part, prepend=0).astype(np.int32)),
                squeezed((inner % self.part).astype(np.uint16)), squeezed(n.astype(np.int64)))

    def unsqueeze(self, rows: bytes, cols: bytes) -> tuple[np.ndarray, np.ndarray]:
        """``part of the columns * size + row`` and the place in the part."""
        return np.cumsum(unsqueezed(rows), dtype=np.int64), unsqueezed(cols, np.uint16).astype(np.int64)


def _numbered(sent: PackedSentences, words: DataFrame) -> DataFrame:
    """``(idx, sizes)``: the blocks of sentences with the numbers of their words (-1: not known)."""
    told = sent.words().join(words.select("word", "idx"), "word").select(F.col("block").alias("of"), "code", "idx")

    def run(base: pa.Table, answers: pa.Table) -> pa.Table:
        codes, at = unsqueezed(base.column("codes")[0].as_py()), answers.column("code").to_numpy()
        number = np.full(max(int(at.max(initial=-1)), int(codes.max(initial=-1))) + 1, -1)
        number[at] = answers.column("idx").to_numpy()
        return pa.Table.from_arrays([pa.array([squeezed(number[codes].astype(np.int32))], pa.binary()),
                                     base.column("sizes")], ["idx", "sizes"])

    blocks = sent.table.select("block", "sizes", "codes")
    return blocks.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(run, "idx binary, sizes binary")


def _pair_counts(numbered: DataFrame, layout: Layout, share: int, shares: int) -> DataFrame:
    """The counts of tokens at distance one or two, in both directions, as rows
    of entries: of the blocks of rows that are ``share`` modulo ``shares``."""
    names = ["block", "source", "rows", "cols", "n"]

    def units(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        unit = key // layout.unit
        edges = np.flatnonzero(np.diff(unit, prepend=-1)).tolist()
        for a, b in zip(edges, [*edges[1:], len(key)]):
            u = int(unit[a])
            packed = layout.squeeze(key[a:b] - u * layout.unit, n[a:b])
            yield pa.RecordBatch.from_arrays(
                [pa.array([u // layout.blocks], pa.int32()), pa.array([u % layout.blocks], pa.int32()),
                 *(pa.array([x], pa.binary()) for x in packed)], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for idx, sizes in zip(*(batch.column(k).to_pylist() for k in range(2))):
                b = Block(None, unsqueezed(idx).astype(np.int64), unsqueezed(sizes))
                left = np.repeat(b.sizes, b.sizes) - 1 - b.place()  # tokens that follow in the sentence
                keys = []
                for distance in (1, 2):
                    first = np.flatnonzero(left >= distance)
                    one, other = b.codes[first], b.codes[first + distance]
                    known = (one >= 0) & (other >= 0)
                    for i, j in ((one, other), (other, one)):
                        mine = known & (i % layout.blocks % shares == share)
                        keys.append(layout.key(i[mine], j[mine]))
                yield from units(*np.unique(np.concatenate(keys), return_counts=True))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for (block, source), group in itertools.groupby(rows, lambda r: (r["block"], r["source"])):
            keys, counts = [], []
            for r in group:
                row, col = layout.unsqueeze(r["rows"], r["cols"])
                keys.append(row * layout.part + col)
                counts.append(unsqueezed(r["n"], np.int64))
            key = np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            yield from units(key[first] + (block * layout.blocks + source) * layout.unit,
                             np.add.reduceat(np.concatenate(counts)[order], first))

    schema = "block int, source int, rows binary, cols binary, n binary"
    return (numbered.mapInArrow(count, schema).repartition(4 * layout.blocks, "block", "source")
            .sortWithinPartitions("block", "source").mapInArrow(merge, schema))


def _word_blocks(words: DataFrame, layout: Layout) -> DataFrame:
    """``(block, m, words)``: the words of every block, by place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(3))))
        for block, group in itertools.groupby(rows, lambda r: r[0]):
            _, m, text = zip(*group)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([squeezed(np.array(m, np.int64))], pa.binary()),
                 pa.array([list(text)], pa.list_(pa.string()))], ["block", "m", "words"])

    block = F.pmod("idx", F.lit(layout.blocks)).cast("int").alias("block")
    return (words.select(block, "m", "word", "idx").repartition(layout.blocks, "block")
            .sortWithinPartitions("block", "idx").select("block", "m", "word")
            .mapInArrow(run, "block int, m binary, words array<string>"))


class PairTable:
    """The words in ``min_pairs`` pairs or more, ``(word, m, idx)`` numbered by
    falling pair count, and their pair counts, written as units: rows of
    ``entries`` for a block of rows and a block (``source``) of columns.  The
    row of ``source`` -1 has the words of the block."""

    def __init__(self, sent: DataFrame | PackedSentences, min_pairs: int = MIN_PAIRS, tokens_col: str = "tokens"):
        packed = sent if isinstance(sent, PackedSentences) else pack(sent, [], tokens_col)
        self.spark = spark = packed.table.sparkSession
        with settings(spark, NO_SHUFFLES_LEFT):
            margin = written_table(margins(packed), "word-margins")
            self.total = margin.agg(F.sum("m")).first()[0]
            known = margin.filter(F.col("m") >= min_pairs).withColumn("neg", -F.col("m"))
            self.words = written_table(global_index(known, ["neg", "word"]).select(
                "word", "m", F.col("idx").cast("long").alias("idx")), "words")
            n_words = self.words.count()
            self.layout = layout = Layout.of(n_words) if n_words else None
            if not n_words:
                return
            at, numbered_at = shared_path(spark, "pair-entries"), shared_path(spark, "numbered-sentences")
            numbered = written_at(_numbered(packed, self.words), numbered_at, compression="none")
            none = spark.createDataFrame([], _ENTRIES)
            shares = min(MAX_PASSES, layout.blocks, max(1, -(-packed.n_tokens() // PASS_TOKENS)))
            shaped = none.unionByName(_word_blocks(self.words, layout).withColumn("source", F.lit(-1)), True)
            self.entries_at, self.entries = at, written_at(shaped, at, "append", ["block"])
            for share in range(shares):
                counts = none.unionByName(_pair_counts(numbered, layout, share, shares), True)
                self.entries = written_at(counts, at, "append", ["block"], "none")
            emptied(spark, numbered_at)

    def pairs(self) -> DataFrame:
        """``(i, j, n)``: the pair counts of the known words."""
        layout = self.layout

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    row, col = layout.unsqueeze(r["rows"], r["cols"])
                    place = row // layout.size * layout.part + col
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row % layout.size * layout.blocks + r["block"]),
                         pa.array(place * layout.blocks + r["source"]), pa.array(unsqueezed(r["n"], np.int64))],
                        ["i", "j", "n"])

        units = self.entries.filter("source >= 0").select("block", "source", "rows", "cols", "n")
        return units.mapInArrow(run, "i long, j long, n long")


def ppmi(sent: DataFrame | PackedSentences, min_pairs: int = MIN_PAIRS, tokens_col: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """(words, entries): written ``(word, m, idx)``, numbered by falling pair
    count, and the positive ``(i, j, x)`` of the symmetric table."""
    table = PairTable(sent, min_pairs, tokens_col)
    if table.layout is None:
        return table.words, table.spark.createDataFrame([], "i long, j long, x double")
    a = table.words.select(F.col("idx").alias("i"), F.col("m").alias("mi"))
    b = table.words.select(F.col("idx").alias("j"), F.col("m").alias("mj"))
    x = F.ln(F.col("n").cast("double") * table.total / (F.col("mi").cast("double") * F.col("mj").cast("double")))
    return table.words, table.pairs().join(a, "i").join(b, "j").select("i", "j", x.alias("x")).filter("x > 0")


def hashed_start(idx: np.ndarray, dims: int, seed: int = SEED) -> np.ndarray:
    """Numbers in [-1, 1) that depend on word number and column alone."""
    h = (idx.astype(np.uint64)[:, None] * np.uint64(dims) + np.arange(dims, dtype=np.uint64)[None, :]
         + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 52) - 1.0


class Factorisation:
    """The products with the positive table of a :class:`PairTable`."""

    def __init__(self, table: PairTable, dims: int):
        self.table, self.spark, self.layout, self.dims = table, table.spark, table.layout, dims
        units = table.entries.filter("source >= 0").groupBy("block").count().collect()  # one row per block
        self.units = {r["block"]: r["count"] for r in units}
        self.most = 1.0  # largest number of Q

    def start(self, place: str) -> DataFrame:
        """The hashed first block of columns, written once: every task of a product reads it."""
        layout, dims = self.layout, self.dims

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, raw in zip(*(batch.column(k).to_pylist() for k in range(2))):
                    m, idx = unsqueezed(raw, np.int64), np.arange(block, layout.n_words, layout.blocks)
                    for part, a in enumerate(range(0, len(m), layout.part)):
                        q = hashed_start(idx[a:a + layout.part], dims).astype(np.float32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([block], pa.int32()), pa.array([part], pa.int32()),
                             pa.array([squeezed(m[a:a + layout.part])], pa.binary()), pa.array([q.tobytes()], pa.binary())],
                            ["block", "part", "m", "q"])

        own = self.table.entries.filter("source = -1").select("block", "m")
        return written_at(own.mapInArrow(make, "block int, part int, m binary, q binary"), place, compression="none")

    def planned(self, q: DataFrame, turn: np.ndarray, with_words: bool = False) -> DataFrame:
        """``X Q turn`` by parts of blocks, and a last row (part -1) with the
        Gram matrix of a block and its largest number.  One task a block of
        rows, without a shuffle."""
        layout, units, total, most = self.layout, self.units, float(self.table.total), self.most
        wide, chunk = turn.shape[0], CHUNK

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, held, early, z = None, {}, [], None
            at, decoded = None, None

            def begin() -> None:
                nonlocal m, grid, z
                m = unsqueezed(own["m"], np.int64)
                # a sum of a row is below 2 ** 52 steps of its grid, so sums of parts are exact in any order
                bound = np.minimum(m, layout.n_words) * np.maximum(np.log(total / m), 1e-3) * max(most, 1e-300)
                grid = np.exp2(51 - np.ceil(np.log2(bound)))
                z = np.zeros((len(m), wide))

            def add(source: int, part: int, raw: bytes, q: bytes) -> None:
                nonlocal at, decoded
                if source not in held:
                    return
                if at != source:
                    rows, cols, n = held[source]
                    at, decoded = source, (*layout.unsqueeze(rows, cols), unsqueezed(n, np.int64))
                row, col, n = decoded
                a, b = np.searchsorted(row, [part * layout.size, (part + 1) * layout.size])
                i, j = row[a:b] - part * layout.size, col[a:b]
                x = np.log(n[a:b] * total / (m[i].astype(np.float64) * unsqueezed(raw, np.int64)[j]))
                positive = np.flatnonzero(x > 0)
                i, j, x = i[positive], j[positive], x[positive]
                mine = np.frombuffer(q, np.float32).reshape(-1, wide).astype(np.float64)
                for k in range(0, len(i), chunk):
                    to = i[k:k + chunk]
                    first = np.flatnonzero(np.diff(to, prepend=-1))
                    to = to[first]
                    terms = mine[j[k:k + chunk]]
                    terms *= x[k:k + chunk, None]
                    sums = np.add.reduceat(terms, first, axis=0)
                    sums *= grid[to, None]
                    z[to] += np.rint(sums, out=sums)

            m = grid = None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["q"] is not None:
                        early.append((r["block"], r["source"], r["m"], r["q"]))
                    elif r["source"] == -1:
                        own = r
                    else:
                        held[r["source"]] = r["rows"], r["cols"], r["n"]
                    if own is not None and len(held) == units.get(own["block"], 0):
                        if z is None:
                            begin()
                        while early:
                            add(*early.pop(0))
            if own is None:
                return
            gram, top, names = np.zeros((turn.shape[1],) * 2), 0.0, [c.split(" ")[0] for c in _COLUMNS.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.float64()]

            def made(*values) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

            for part, a in enumerate(range(0, len(m), layout.part)):
                b = a + layout.part
                out = ((z[a:b] / grid[a:b, None]) @ turn).astype(np.float32)
                exact = out.astype(np.float64)
                gram += exact.T @ exact
                top = max(top, float(np.abs(out).max(initial=0)))
                yield made(own["block"], part, squeezed(m[a:b]), own["words"] and own["words"][a:b], out.tobytes(), None, None)
            yield made(own["block"], -1, None, None, None, gram.tobytes(), top)

        null = F.lit(None)
        text = F.col("words") if with_words else null.cast("array<string>").alias("words")
        mine = self.table.entries.select("block", "source", "m", text, "rows", "cols", "n", null.cast("binary").alias("q"))
        columns = q.select("block", F.col("part").alias("source"), "m", null.cast("array<string>"), *[null.cast("binary")] * 3, "q")
        # a block's entries come first, then all of Q; a union of scans in one task each
        return reduce(DataFrame.union, [mine.filter(F.col("block") == b).union(columns).coalesce(1).mapInArrow(run, _COLUMNS)
                                        for b in range(layout.blocks)])

    def product(self, q: DataFrame, turn: np.ndarray, place: str, with_words: bool = False) -> tuple[DataFrame, np.ndarray]:
        """``X (Q turn)``, written at ``place``, and its Gram matrix."""
        with settings(self.spark, UNION_APART | ROW_BY_ROW):
            z = written_at(self.planned(q, turn, with_words), place, compression="none")
        grams = z.filter("part = -1").select("block", "gram", "most").orderBy("block").collect()  # one per block
        gram = np.zeros((turn.shape[1],) * 2)
        for g in grams:
            gram += np.frombuffer(g["gram"]).reshape(gram.shape)
        self.most = max(g["most"] for g in grams)
        return z.filter("part >= 0"), gram


def _whiten(gram: np.ndarray, power: float) -> np.ndarray:
    """Eigenvectors of a Gram matrix, largest first, scaled by eigenvalue ** power; negligible ones left out."""
    values, vectors = np.linalg.eigh(gram)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = values > max(values[0], 0.0) * 1e-10 if len(values) else np.zeros(0, bool)
    return vectors[:, kept] * values[kept] ** power


def dense_vectors(sent: DataFrame | PackedSentences, dims: int = DIMS, rounds: int = ROUNDS, min_pairs: int = MIN_PAIRS,
                  tokens_col: str = "tokens", place: str | None = None) -> DataFrame:
    """``(word, m, vec array<double>)`` of the words in ``min_pairs`` pairs or more
    (up to ``dims`` numbers; fewer words give fewer), from columns written at ``place``."""
    table = PairTable(sent, min_pairs, tokens_col)
    spark = table.spark
    if table.layout is None:
        return spark.createDataFrame([], "word string, m long, vec array<double>")
    dims = min(dims, table.layout.n_words)
    f = Factorisation(table, dims)
    # columns are written to two places in turn, so only the last two sets are kept
    places = [place or shared_path(spark, "columns"), shared_path(spark, "columns")]
    q, turn = f.start(places[(rounds + 1) % 2]), np.eye(dims)
    for k in range(rounds, 0, -1):
        q, gram = f.product(q, turn, places[k % 2])
        turn = _whiten(gram, -0.5)
        if not turn.shape[1]:  # no positive entry at all
            return table.words.select("word", "m", F.array().cast("array<double>").alias("vec"))
    z, gram = f.product(q, turn, places[0], with_words=True)
    for path in [table.entries_at, places[1]]:
        emptied(spark, path)
    # Z = U S V': vectors U S^(1/2) = Z V S^(-1/2), with S^2 the eigenvalues
    last, wide = _whiten(gram, -0.25), turn.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, raw, q in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2))):
                m, vec = unsqueezed(raw, np.int64), np.frombuffer(q, np.float32).reshape(-1, wide).astype(np.float64) @ last
                for at in range(0, len(vec), 2048):
                    part = vec[at:at + 2048]
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, max(part.shape[1], 1)), pa.int32()),
                                                    pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([words.values[at:at + 2048], pa.array(m[at:at + 2048]), flat],
                                                     ["word", "m", "vec"])

    return z.select("words", "m", "q").mapInArrow(rows, "word string, m long, vec array<double>")


def word_scores(vecs: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(word, norm, dots)`` against the unit mean vector of each class's known
    seed words, as :func:`countvec.classify` takes them; prototypes are one
    vector per class."""
    with settings(vecs.sparkSession, ROW_BY_ROW):
        known = (vecs.join(F.broadcast(seeds.select("cls", F.col("text").alias("word"))), "word")
                 .select("cls", "vec").collect())  # one row per seed word
    protos = {}
    for r in known:
        protos.setdefault(r["cls"], []).append(r["vec"])
    classes = sorted(protos)
    matrix = [np.mean(protos[c], axis=0) for c in classes]
    unit = np.array([m / max(float(np.sqrt(m @ m)), 1e-300) for m in matrix])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            dots = v @ unit.T if len(classes) else np.zeros((len(v), 0))
            maps = pa.MapArray.from_arrays(
                pa.array(np.arange(0, dots.size + 1, max(len(classes), 1))[:len(v) + 1] if len(classes)
                         else np.zeros(len(v) + 1, int), pa.int32()),
                pa.array(np.tile(np.array([c * 1000 - 1 for c in classes], np.int32), len(v)), pa.int32()),
                pa.array(dots.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.sqrt((v * v).sum(axis=1))), maps],
                                             ["word", "norm", "dots"])

    return vecs.select("word", "vec").mapInArrow(score, "word string, norm double, dots map<int,double>")
