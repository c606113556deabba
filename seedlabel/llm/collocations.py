"""Collocations: phrases of two to four words, counted by direct-address tiles.

Everything is per language.  One pass over the texts per phrase length: a task
cuts its texts into pieces and words (on flat byte arrays), numbers the words
of a buffer of texts by falling frequency, and counts neighbours in **pair
tiles**, squares of ``TILE`` x ``TILE`` numbers: a tile with many occurrences
is counted by one dense ``bincount`` addressed by the pair itself, the
occurrences of all other tiles as sorted coordinates.  For longer phrases the
pairs are numbered anew by falling frequency and neighbouring pairs (which
share a word) are counted as pairs again, up to the length asked for.  A
buffer's counts meet in one hash aggregate by phrase.

Only phrases whose two shorter parts are frequent can be frequent, so a pass
counts no others: the frequent phrases of the pass before are held as one bit
each at a hashed place in a table of at least ``BITS_EACH`` bits a phrase (at
most ``MAX_BITS``).  A bit set by another phrase only lets a rare phrase
through to the exact count, which drops it; none is lost at any size, and past
the largest table the passes merely count more rare phrases.

Scores use exact decimals.  A phrase is dropped when a longer candidate that
holds it has 80 % of its count: the greatest such count is an aggregate over
the longer candidates' parts.  The ranking is a bounded top-k per language.

Scale: shuffles carry phrases with partial counts; no group is gathered, the
driver gets the bit table (at most MAX_BITS / 8 bytes of set bits).  A task
holds one buffer: ``BUFFER`` bytes of words, or the longest piece without a
punctuation mark or line break if that is longer.

Null and empty texts have no words; a null language is ``und``; very long
texts are cut at piece ends inside a task; repeated rows count as often as
they occur; ties in score and count go by the phrase's bytes; an empty table
gives no rows; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedlabel.llm.common import SLICE_BYTES, scratch_table, sliced, small_batches, text_bytes

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
#: A longer phrase with this share (percent) of a phrase's count takes its place.
COVER_PERCENT = 80
SCALE = 2_000_000
NO_LANG = "und"

TILE = 1024
#: Occurrences from which a tile is counted densely.
DENSE = TILE * TILE // 8
#: Bytes of words (and, at two bytes a word, number of words) in a buffer.
BUFFER = 3 << 20
#: Rows of an Arrow batch of counts (a buffer's counts at once would be held by the JVM beside its heap).
OUT_ROWS = 16384
BITS_EACH = 32
MIN_BITS, MAX_BITS = 1 << 16, 1 << 27

#: Fixed value: the characters that end a piece.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[list(BREAKS)] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_MUL, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _string_hashes(strings: pa.Array) -> np.ndarray:
    """A hash of every binary value: its bytes as digits of a number in base _MUL."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset:strings.offset + len(strings) + 1]
    sizes = np.diff(offsets)
    out = sizes.astype(np.uint64) + _ADD
    if len(strings) and offsets[-1] > offsets[0]:
        data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64)
        powers = np.full(int(sizes.max()), _MUL, np.uint64)
        powers = np.multiply.accumulate(powers)
        place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)
        full = sizes > 0
        out[full] += np.add.reduceat((data + np.uint64(1)) * powers[place], (offsets[:-1] - offsets[0])[full])
    return _mix(out)


def _extend(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from its first words' hash and its last word's."""
    return _mix(prefix * _MUL + word)


class Buffer:
    """Words of consecutive texts, as arrays."""

    def __init__(self):
        self.words: list[pa.Array] = []   # binary, one value per word
        self.langs: list[np.ndarray] = []  # language number per word
        self.pieces: list[np.ndarray] = []  # piece number per word
        self.lang_no: dict[bytes, int] = {}
        self.n_pieces = self.size = 0

    def add(self, data: np.ndarray, ends: np.ndarray, langs: np.ndarray) -> None:
        """Texts laid end to end; ``ends`` are their end places."""
        kind = _KIND[data]
        inside = kind == 0
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        firsts = np.concatenate([[0], ends[:-1]])
        firsts = firsts[firsts < len(data)]
        start[firsts] = inside[firsts]
        at = np.flatnonzero(start)
        if not len(at):
            return
        border = np.zeros(len(data) + 1, np.int32)
        np.add.at(border, ends, 1)
        border[:-1] += kind == 2
        piece = np.cumsum(border[:-1])
        offsets = np.concatenate([np.cumsum(inside, dtype=np.int64)[at] - 1, [int(inside.sum())]]).astype(np.int32)
        flat = _FOLD[data[inside]]
        self.words.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]))
        self.pieces.append(piece[at].astype(np.int64) + self.n_pieces)
        self.langs.append(langs[np.searchsorted(ends, at, "right")])
        self.n_pieces += int(piece[-1]) + 2
        self.size += max(len(flat), 2 * len(at))


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about SLICE_BYTES, cut behind piece ends."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        cut = max(text.rfind(c, at, at + SLICE_BYTES) for c in (BREAKS[i:i + 1] for i in range(len(BREAKS))))
        if cut < 0:  # one long piece: to its end, however far
            later = [p for p in (text.find(BREAKS[i:i + 1], at) for i in range(len(BREAKS))) if p >= 0]
            cut = min(later, default=len(text) - 1)
        yield text[at:cut + 1]
        at = cut + 1
    yield text[at:]


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[Buffer]:
    """(lang, text) batches as buffers of words."""
    buf = Buffer()
    for batch in sliced(batches, 1):
        langs = batch.column(0).to_pylist()
        texts = batch.column(1).to_pylist()
        long_one = len(texts) == 1 and len(texts[0]) > SLICE_BYTES
        for group, names in (((([p], langs) for p in _parts(texts[0]))) if long_one else [(texts, langs)]):
            numbers = np.array([buf.lang_no.setdefault(x, len(buf.lang_no)) for x in names], np.int64)
            ends = np.cumsum([len(t) for t in group])
            data = np.frombuffer(b"".join(group), np.uint8)
            if len(data):
                buf.add(data, ends, numbers)
            if buf.size >= BUFFER:
                yield buf
                buf = Buffer()
    if buf.words:
        yield buf


def count_tiles(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of two number arrays as (first, second, count), and the
    index of every occurrence among them.

    Numbers are split into tiles of TILE x TILE pairs.  Tiles of at least
    DENSE occurrences are counted by direct address, the rest sorted."""
    which = np.empty(len(a), np.int64)
    first, second, counts, n = [], [], [], 0
    rest = np.ones(len(a), bool)
    if len(a) >= DENSE:
        rows, cols = a // TILE, b // TILE
        grid = int(cols.max()) + 1
        tile = rows * grid + cols
        # a tile lies among the first len(a) / DENSE rows and columns of tiles, or its numbers are too rare
        near = np.flatnonzero((rows < 64) & (cols < 64))
        occupied, held = np.unique(tile[near], return_counts=True)
        for t in occupied[held >= DENSE]:
            here = near[tile[near] == t]
            r0, c0 = int(t) // grid * TILE, int(t) % grid * TILE
            address = (a[here] - r0) * TILE + (b[here] - c0)
            cells = np.bincount(address, minlength=TILE * TILE)
            full = np.flatnonzero(cells)
            index = np.empty(TILE * TILE, np.int64)
            index[full] = n + np.arange(len(full))
            which[here] = index[address]
            first.append(full // TILE + r0)
            second.append(full % TILE + c0)
            counts.append(cells[full])
            n += len(full)
            rest[here] = False
    sparse = np.flatnonzero(rest)
    keys, inverse, held = np.unique((a[sparse] << 32) | b[sparse], return_inverse=True, return_counts=True)
    which[sparse] = n + inverse
    first.append(keys >> 32)
    second.append(keys & 0xFFFFFFFF)
    counts.append(held)
    return np.concatenate(first), np.concatenate(second), np.concatenate(counts), which


def _numbered(which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of every occurrence, order of the old numbers, counts): numbered anew by falling frequency."""
    counts = np.bincount(which, minlength=n)
    order = np.argsort(-counts, kind="stable")
    number = np.empty(n, np.int64)
    number[order] = np.arange(n)
    return number[which], order, counts[order]


def _phrase_starts(hashes: np.ndarray, bare: np.ndarray, piece: np.ndarray, length: int,
                   table: np.ndarray) -> np.ndarray:
    """Where phrases of ``length`` words start whose two parts of one word less are in the table."""
    n = len(piece) - length + 1  # a phrase fits before the end
    if n <= 0:
        return np.zeros(0, np.int64)
    hashes = hashes[:n + 1]
    for k in range(1, length - 1):
        hashes = _extend(hashes, bare[k:n + 1 + k])
    good = _in_table(table, hashes)
    return np.flatnonzero(good[:-1] & good[1:] & (piece[:n] == piece[length - 1:]))


def _count_buffer(buf: Buffer, length: int, table: np.ndarray | None) -> pa.RecordBatch | None:
    """Partial counts of one buffer's phrases of ``length`` words."""
    encoded = pa.chunked_array(buf.words).combine_chunks().dictionary_encode()
    words = encoded.dictionary
    lang, piece = np.concatenate(buf.langs), np.concatenate(buf.pieces)
    lang_names = pa.array(list(buf.lang_no), pa.binary())
    both = lang * len(words) + encoded.indices.to_numpy(zero_copy_only=False)
    if len(lang_names) * len(words) > 8 * BUFFER:  # very many languages: number the pairs that occur
        distinct, both = np.unique(both, return_inverse=True)
    else:
        distinct = np.arange(len(lang_names) * len(words))
    ids, order, counts = _numbered(both, len(distinct))
    lang_of, word_of = distinct[order] // len(words), distinct[order] % len(words)
    if length == 1:
        seen = int(np.count_nonzero(counts))
        return pa.RecordBatch.from_arrays(
            [lang_names.take(pa.array(lang_of[:seen])), words.take(pa.array(word_of[:seen])), pa.array(counts[:seen])],
            ["lang", "phrase", "n"])
    word_hash = _string_hashes(words)[word_of]
    single = _mix(_string_hashes(lang_names)[lang_of] ^ word_hash)
    starts = _phrase_starts(single[ids], word_hash[ids], piece, length, table)
    if not len(starts):
        return None
    levels = []  # (first, second) numbers of the parts of a phrase, by its number
    for k in range(2, length + 1):
        wanted = np.zeros(len(ids), bool)
        for o in range(length - k + 1):
            wanted[starts + o] = True
        here = np.flatnonzero(wanted)
        first, second, _, which = count_tiles(ids[here], ids[here + 1])
        number, order, counts = _numbered(which, len(first))
        ids = np.zeros(len(ids), np.int64)
        ids[here] = number
        levels.append((first[order], second[order]))

    def word_numbers(level: int, which: np.ndarray) -> list[np.ndarray]:
        if level < 0:
            return [which]
        first, second = levels[level]
        return [*word_numbers(level - 1, first[which]), word_numbers(level - 1, second[which])[-1]]

    parts = word_numbers(length - 2, np.arange(len(counts)))
    phrase = pc.binary_join_element_wise(*[words.take(pa.array(word_of[p])) for p in parts], b" ")
    return pa.RecordBatch.from_arrays([lang_names.take(pa.array(lang_of[parts[0]])), phrase, pa.array(counts)],
                                      ["lang", "phrase", "n"])


def _in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64(len(table) * 64 - 1)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def phrase_counts(texts: DataFrame, length: int, table: np.ndarray | None) -> DataFrame:
    """lang, phrase, f of the phrases of ``length`` words (of more than one
    word: those whose parts the table holds)."""
    shared = texts.sparkSession.sparkContext.broadcast(table) if table is not None else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buf in _buffers(batches):
            out = _count_buffer(buf, length, shared.value if shared else None)
            for at in range(0, out.num_rows if out is not None else 0, OUT_ROWS):
                yield out.slice(at, OUT_ROWS)

    partial = texts.mapInArrow(count, "lang binary, phrase binary, n long")
    return (partial.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
            .select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "f"))


def bit_table(phrases: DataFrame, length: int) -> np.ndarray:
    """The bits of written frequent phrases of ``length`` words."""
    bits = MIN_BITS
    while bits < min(MAX_BITS, BITS_EACH * phrases.count()):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = _string_hashes(batch.column(0).cast(pa.binary()))
            words = pc.split_pattern(batch.column(1).cast(pa.binary()), b" ").flatten()
            word = _string_hashes(words).reshape(-1, length)
            h = _mix(lang ^ word[:, 0])
            for k in range(1, length):
                h = _extend(h, word[:, k])
            bit = (h & np.uint64(bits - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bit)], ["bit"])

    set_bits = (phrases.select(F.col("lang").cast("binary"), F.col("phrase").cast("binary"))
                .mapInArrow(places, "bit long")
                .groupBy(F.shiftright("bit", 6).alias("cell"))
                .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow())
    table = np.zeros(bits // 64, np.uint64)
    table[set_bits.column("cell").to_numpy()] = set_bits.column("bits").to_numpy().view(np.uint64)
    return table


def scored(frequent: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, words, a) with l, r and score of the lowest cut."""
    cand = frequent.filter("size >= 2").withColumn("words", F.split("phrase", " ")).withColumnRenamed("f", "a")
    cuts = cand.select("lang", "phrase", "a", F.explode(F.expr(
        "transform(sequence(1, size - 1), k -> named_struct('k', k, 'left_part', array_join(slice(words, 1, k), ' '),"
        " 'right_part', array_join(slice(words, k + 1, size - k), ' ')))")).alias("c")).select("lang", "phrase", "a", "c.*")
    left = frequent.select("lang", F.col("phrase").alias("left_part"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("right_part"), F.col("f").alias("r"))
    cut = cuts.join(left, ["lang", "left_part"]).join(right, ["lang", "right_part"])
    score = F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r)")
    return (cut.groupBy("lang", "phrase", "a")
            .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
            .select("lang", "phrase", "a", "m.score", "m.l", "m.r"))


def covering(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the greatest count of a longer candidate around a phrase."""
    parts = F.expr("flatten(transform(sequence(2, size - 1), n ->"
                   " transform(sequence(1, size - n + 1), i -> array_join(slice(words, i, n), ' '))))")
    return (frequent.filter("size >= 3").withColumn("words", F.split("phrase", " "))
            .select("lang", F.explode(parts).alias("phrase"), "f")
            .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                     lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): written tables of lang, phrase, f, size for every
    phrase of up to ``max_words`` words with f >= min_count, and of lang, n."""
    texts = small_batches(docs).select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG)).cast("binary")
                                       .alias("lang"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    words = scratch_table(phrase_counts(texts, 1, None), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    level = words.filter(F.col("f") >= min_count)
    found = level.withColumn("size", F.lit(1))
    for size in range(2, max_words + 1):
        table = bit_table(level, size - 1)
        if not table.any():
            break
        level = scratch_table(phrase_counts(texts, size, table).filter(F.col("f") >= min_count), f"phrase-{size}")
        found = found.unionByName(level.withColumn("size", F.lit(size)))
    return found, totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 cover_percent: int = COVER_PERCENT, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    frequent, totals = frequent_phrases(docs, min_count, max_words, lang_col, text_col)
    kept = (scored(frequent).join(covering(frequent), ["lang", "phrase"], "left")
            .filter(F.expr(f"longer IS NULL OR cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {cover_percent}")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return (ranked.join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                    F.col("score").cast("long").alias("score")))
