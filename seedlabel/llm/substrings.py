"""Substring de-duplication behind count-min sketches.

A window is ``WINDOW`` consecutive words of one document; every word covered
by a window whose word sequence also starts elsewhere is removed.

Prefilter: a count-min sketch of anchors.  Of a window's ``GRAM``-word grams
the one with the least hash, leftmost of ties, is its anchor; each position
counts once.  Equal windows have equal anchors at equal offsets, so the count
of a window's anchor is never below the count of the window.  The sketch is
dealt by key: the leading bits of an anchor name its segment, a sketch of two
rows of ``SEGMENT_CELLS`` cells of its own, and there are as many segments as
the text's size asks for.  So the estimates are as sharp for 100 TB as for
100 MB, and no task and no broadcast holds more than one segment.  Every task
sketches its rows sparsely; the sketches are merged by segment; the tasks then
ask the segments for their anchors, and what comes back to a document are its
anchors with an estimate of two or more.  Anchors in cells with more than one
``HOT_CELLS``-th of all positions (at most that many cells a row, broadcast)
are known to repeat and not asked, so a passage that a third of all documents
share loads no segment.

Exact pass: windows with such an anchor are grouped exactly by a 95-bit hash
of their word sequence (two independent polynomial hashes of the words' 64-bit
hashes; n different windows collide somewhere with a probability below
n * n / 2**96, 10**-3 for 10**13 windows), map-side combined, so a passage with
a third of all windows arrives as one row per task.  A window that turns out
to be alone knows its only place; these places go back to their documents, and
all other estimated windows are repeated.  Estimates are never too low, so no
repeat is lost.

Null and empty texts have no words; shorter documents than a window lose
none; a text of any length is read whole, in a task of its own slice.
Documents repeated as rows are repeats of each other.  An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.llm.common import scratch_table, sliced, small_batches, text_bytes

WINDOW = 35
#: Words of the grams among which a window's anchor is chosen.
GRAM = 20
#: Cells of a segment's row (two rows a segment), and cells of a row per expected key.
SEGMENT_CELLS = 1 << 18
CELLS_PER_KEY = 16
#: Cells of a row that are broadcast as hot: at most, and only those with more
#: than their share of all positions.
HOT_CELLS = 1 << 16
#: Keys a task holds before it emits them.
FLUSH_KEYS = 1 << 20

_U = np.uint64
#: Odd multipliers of the rolling hashes and of the two sketch rows.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_ROWS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Low bits that hold a gram's place while the least hash is sought.
_PLACE = _U((1 << 30) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    def powers(b: int) -> np.ndarray:
        out = np.full(n, b, dtype=_U)
        out[0] = 1
        return np.multiply.accumulate(out)
    return powers(base), powers(pow(base, -1, 1 << 64))


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of every run of ``width`` values."""
    n = len(h)
    up, down = _powers(base, max(1 << 20, 1 << int(n).bit_length()))
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(h * down[:n], out=sums[1:])
    return (sums[width:] - sums[:-width]) * up[:n - width + 1] if n >= width else np.zeros(0, _U)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least of every run of ``width`` values."""
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:len(v) - (width - size)], v[width - size:]) if size < width else v


class Windows:
    """The windows of a slice of documents, laid end to end."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        h = xxhash.xxh3_64_intdigest
        hashes = np.array([h(w) for doc in self.words for w in doc], dtype=_U)
        lengths = np.array([len(doc) for doc in self.words], dtype=np.int64)
        self.first = np.cumsum(lengths) - lengths  # place of each document's first word
        n = len(hashes)
        if n < WINDOW:
            self.start, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.w1 = self.w2 = self.anchor = np.zeros(0, _U)
            self.anchors, self.anchor_doc = np.zeros(0, _U), np.zeros(0, np.int64)
            return
        doc_of = np.repeat(np.arange(len(lengths)), lengths)
        fits = np.arange(n) + WINDOW <= np.repeat(self.first + lengths, lengths)
        self.start = np.nonzero(fits)[0]  # places of the windows
        self.doc = doc_of[self.start]
        self.w1 = _mixed(rolling(hashes, WINDOW, _BASES[0])[self.start])
        self.w2 = _mixed(rolling(_mixed(hashes), WINDOW, _BASES[1])[self.start]) >> _U(33)
        grams = _mixed(rolling(hashes, GRAM, _BASES[1]))
        least = sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=_U), WINDOW - GRAM + 1)[self.start]
        places = (least & _PLACE).astype(np.int64)
        # least hashes are small numbers: scrambled again, their leading bits deal them evenly
        self.anchor = _mixed(grams[places])
        places = np.unique(places)
        self.anchors, self.anchor_doc = _mixed(grams[places]), doc_of[places]

    def offset(self, i: np.ndarray) -> np.ndarray:
        """First word of windows i inside their documents."""
        return self.start[i] - self.first[self.doc[i]]


class Layout:
    """Segments of a dealt count-min sketch and their cells, both powers of two."""

    def __init__(self, expected: int, segment_cells: int = SEGMENT_CELLS, hot_cells: int = HOT_CELLS):
        self.cell_bits = segment_cells.bit_length() - 1
        self.segment_bits = max(0, (CELLS_PER_KEY * expected).bit_length() - self.cell_bits)
        self.hot_cells = hot_cells

    def segments(self, keys: np.ndarray) -> np.ndarray:
        return keys >> _U(64 - self.segment_bits) if self.segment_bits else np.zeros(len(keys), _U)

    def cells(self, keys: np.ndarray) -> list[np.ndarray]:
        """A key's cell in either row, the second row's behind the first's."""
        return [((keys * _U(m)) >> _U(64 - self.cell_bits)) + _U(row << self.cell_bits) for row, m in enumerate(_ROWS)]

    def numbered(self, keys: np.ndarray) -> list[np.ndarray]:
        """The same cells, numbered over all segments."""
        base = self.segments(keys) << _U(self.cell_bits + 1)
        return [base + c for c in self.cells(keys)]

    def hot(self, keys: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Keys whose cells are both among the hot ones (sorted numbers)."""
        out = np.full(len(keys), len(cells) > 0)
        if len(cells):
            for c in self.numbered(keys):
                out &= cells[np.minimum(np.searchsorted(cells, c), len(cells) - 1)] == c
        return out


def _windows(batches: Iterator[pa.RecordBatch], text_col: int) -> Iterator[tuple[pa.RecordBatch, Windows]]:
    for batch in sliced(batches, text_col):
        yield batch, Windows(batch.column(text_col).to_pylist())


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, and the end."""
    return np.concatenate(([0], np.nonzero(np.diff(sorted_values))[0] + 1, [len(sorted_values)]))


def _flushed(parts: Iterator[tuple[np.ndarray, ...]], emit: Callable[..., pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``emit`` of the concatenated columns of every FLUSH_KEYS keys or so."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > FLUSH_KEYS:
            yield emit(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield emit(*map(np.concatenate, zip(*held)))


def _sparse(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """One task's sketch: per segment the cells seen once, and those seen more often with their counts."""
    def emit(keys: np.ndarray) -> pa.RecordBatch:
        numbers, n = np.unique(np.concatenate(layout.numbered(keys)), return_counts=True)
        bits = _U(layout.cell_bits + 1)
        segment, cell = numbers >> bits, (numbers & ((_U(1) << bits) - _U(1))).astype(np.uint32)
        cut, single = _runs(segment), n == 1
        once, more, counts = [], [], []
        for a, b in zip(cut[:-1], cut[1:]):
            c, one = cell[a:b], single[a:b]
            once.append(c[one].tobytes())
            more.append(c[~one].tobytes())
            counts.append(n[a:b][~one].astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(segment[cut[:-1]].astype(np.int64))] + [pa.array(x, pa.binary()) for x in (once, more, counts)],
            ["segment", "once", "more", "counts"])

    return _flushed(((w.anchors,) for _, w in _windows(batches, 0)), emit)


def _merge(batches: Iterator[pa.RecordBatch], layout: Layout, hot_from: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment -> bits of the cells counted twice or more, and the numbers of the hot cells."""
    current, counts = None, None

    def done() -> pa.RecordBatch:
        hot = np.nonzero(counts >= hot_from)[0].astype(np.int64) + (current << (layout.cell_bits + 1))
        return pa.RecordBatch.from_arrays(
            [pa.array([current], pa.int64()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary()),
             pa.array([hot.tolist()], pa.list_(pa.int64()))], ["segment", "bits", "hot"])

    for batch in batches:
        for segment, once, more, n in zip(*(c.to_pylist() for c in batch.columns)):
            if segment != current:
                if current is not None:
                    yield done()
                current, counts = segment, np.zeros(2 << layout.cell_bits, np.int64)
            counts[np.frombuffer(once, np.uint32)] += 1
            counts[np.frombuffer(more, np.uint32)] += np.frombuffer(n, np.uint32)
    if current is not None:
        yield done()


def _asked(batches: Iterator[pa.RecordBatch], layout: Layout, hot) -> Iterator[pa.RecordBatch]:
    """(place, text) -> per segment the anchors that are not hot, with their documents' places."""
    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch, w in _windows(batches, 1):
            ask = ~layout.hot(w.anchors, hot.value)
            places = batch.column(0).to_numpy(zero_copy_only=False)
            yield w.anchors[ask], places[w.anchor_doc[ask]]

    def emit(keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        segment = layout.segments(keys)
        order = np.argsort(segment, kind="stable")
        segment, keys, places = segment[order], keys[order], places[order]
        cut = _runs(segment)
        spans = list(zip(cut[:-1], cut[1:]))
        return pa.RecordBatch.from_arrays(
            [pa.array(segment[cut[:-1]].astype(np.int64)), pa.array(np.ones(len(spans), np.int32)),
             pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
             pa.array([places[a:b].tobytes() for a, b in spans], pa.binary())], ["segment", "kind", "data", "places"])

    return _flushed(parts(), emit)


def _answered(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (segment, kind), the segment's bits first -> (place, key) of the anchors estimated as repeated."""
    current, bits = None, None
    for batch in batches:
        for segment, kind, data, places in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                current, bits = segment, np.frombuffer(data, np.uint8)
                continue
            if segment != current:
                raise ValueError(f"segment {segment} of the sketch is missing")
            keys = np.frombuffer(data, _U)
            yes = np.ones(len(keys), bool)
            for c in layout.cells(keys):
                yes &= (bits[c >> _U(3)] >> (c & _U(7)).astype(np.uint8) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(places, np.int64)[yes]),
                                              pa.array(keys[yes].view(np.int64))], ["place", "key"])


def _candidates(w: Windows, keys: pa.ListArray, layout: Layout, hot: np.ndarray) -> np.ndarray:
    """Indices of the windows whose anchor is estimated as repeated."""
    yes = layout.hot(w.anchor, hot)
    values, at = keys.values.to_numpy(zero_copy_only=False).view(_U), keys.offsets.to_numpy()
    cuts = np.searchsorted(w.doc, np.arange(len(keys) + 1))
    for d in np.nonzero((np.diff(cuts) > 0) & (np.diff(at) > 0))[0]:
        a, b = cuts[d], cuts[d + 1]
        yes[a:b] |= np.isin(w.anchor[a:b], values[at[d]:at[d + 1]])
    return np.nonzero(yes)[0]


def _estimated(batches: Iterator[pa.RecordBatch], layout: Layout, hot) -> Iterator[pa.RecordBatch]:
    for batch, w in _windows(batches, 1):
        i = _candidates(w, batch.column(2), layout, hot.value)
        places = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array(w.w1[i].view(np.int64)), pa.array(w.w2[i].astype(np.int32)), pa.array(places[w.doc[i]]),
             pa.array(w.offset(i).astype(np.int32))], ["w1", "w2", "place", "word"])


def _removed(batches: Iterator[pa.RecordBatch], layout: Layout, hot, with_text: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, keys, alone) -> what is left of every document."""
    for batch, w in _windows(batches, 1):
        i = _candidates(w, batch.column(2), layout, hot.value)
        doc, word, value = w.doc[i], w.offset(i), w.w1[i].view(np.int64)
        cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        n_words, n_removed, digests, kept_words = [], [], [], []
        for d, words in enumerate(w.words):
            a, b = cuts[d], cuts[d + 1]
            cover = np.zeros(len(words) + 1, np.int64)
            if b > a:
                own, at = value[a:b], word[a:b]
                alone = batch.column(3)[d].as_py()
                if alone:
                    gone = {(x["word"], x["w1"]) for x in alone}
                    at = np.array([p for p, v in zip(at.tolist(), own.tolist()) if (p, v) not in gone], np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + WINDOW, -1)
            hit = np.cumsum(cover)[:-1] > 0
            kept = b" ".join([x for x, gone in zip(words, hit.tolist()) if not gone])
            n_words.append(len(words))
            n_removed.append(int(hit.sum()))
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_words.append(kept.decode(errors="replace") if with_text else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests),
             pa.array(kept_words, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


class Prefilter:
    """The documents with their anchors estimated as repeated: ``rows`` (doc_id, text, place),
    ``keys`` (place, key: a written table), the sketch's layout and its broadcast hot cells."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 segment_cells: int = SEGMENT_CELLS, hot_cells: int = HOT_CELLS):
        sc = docs.sparkSession.sparkContext
        ident, text = F.col(f"`{id_col}`").cast("long"), text_bytes(F.col(f"`{text_col}`"))
        self.rows = rows = small_batches(docs).select(ident.alias("doc_id"), text.alias("text"),
                                                      F.xxhash64(ident, text).alias("place"))
        words = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
        # of two neighbouring anchors about (WINDOW - GRAM + 2) / 2 words lie apart
        expected = 2 * words // (WINDOW - GRAM + 2)
        self.layout = layout = Layout(expected, segment_cells, hot_cells)
        hot_from = max(2, expected // hot_cells + 1)
        sparse = rows.select("text").mapInArrow(lambda it: _sparse(it, layout),
                                                "segment long, once binary, more binary, counts binary")
        merged = scratch_table(sparse.repartition("segment").sortWithinPartitions("segment").mapInArrow(
            lambda it: _merge(it, layout, hot_from), "segment long, bits binary, hot array<long>"), "substring-sketch")
        # bounded: the cells of a row with a share of the positions over 1 / hot_cells
        hot = [x for r in merged.select("hot").filter(F.size("hot") > 0).toLocalIterator() for x in r.hot]
        self.hot = sc.broadcast(np.sort(np.array(hot, dtype=_U)))
        hot_cells_ = self.hot
        bits = merged.select("segment", F.lit(0).alias("kind"), F.col("bits").alias("data"), F.lit(b"").alias("places"))
        asked = rows.select("place", "text").mapInArrow(lambda it: _asked(it, layout, hot_cells_),
                                                        "segment long, kind int, data binary, places binary")
        met = bits.unionByName(asked).repartition("segment").sortWithinPartitions("segment", "kind")
        self.keys = scratch_table(met.mapInArrow(lambda it: _answered(it, layout), "place long, key long"),
                                  "substring-anchors")

    def with_keys(self) -> DataFrame:
        """``rows`` with ``keys``, the set of each document's anchors."""
        keys = self.keys.groupBy("place").agg(F.collect_set("key").alias("keys"))
        # always a shuffle join: the places grow with the corpus, and Spark may split it
        joined = self.rows.join(keys.hint("merge"), "place", "left")
        return joined.withColumn("keys", F.coalesce("keys", F.array().cast("array<long>")))

    def windows(self) -> DataFrame:
        """The windows with such an anchor: w1, w2, place, word."""
        layout, hot = self.layout, self.hot
        return self.with_keys().select("place", "text", "keys").mapInArrow(
            lambda it: _estimated(it, layout, hot), "w1 long, w2 int, place long, word int")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True,
                   segment_cells: int = SEGMENT_CELLS, hot_cells: int = HOT_CELLS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (null without
    ``with_text``) of every row."""
    found = Prefilter(docs, id_col, text_col, segment_cells, hot_cells)
    layout, hot = found.layout, found.hot
    alone = (found.windows().groupBy("w1", "w2")
             .agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"), F.min("word").alias("word"))
             .filter("n = 1").select("place", "word", "w1"))
    alone = scratch_table(alone, "substring-alone")
    by_doc = alone.groupBy("place").agg(F.collect_list(F.struct("word", "w1")).alias("alone"))
    joined = found.with_keys().join(by_doc.hint("merge"), "place", "left").select("doc_id", "text", "keys", "alone")
    return joined.mapInArrow(lambda it: _removed(it, layout, hot, with_text),
                             "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
