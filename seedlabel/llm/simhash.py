"""SimHash near-duplicates with Golay-code fuzzy hashing.

Fingerprint: 64 majority bits over the XXH64 (seed 42) values of a document's
word shingles (A-Z lower-cased, blanks and controls 0x09-0x0D separate).

Candidates: the fingerprint is cut into three segments of 22, 21 and 21 bits.
Two fingerprints at distance 2 or less have a segment without an error whose
successor (cyclically) has at most one: errors (0, 0, 2) and (0, 1, 1) leave
segment 1 exact and segment 2 within one, (2, 0, 0) and (1, 0, 1) segments 2
and 3, (0, 2, 0) and (1, 1, 0) segments 3 and 1.  The successor is decoded to
codewords of the perfect binary Golay code [23, 12, 7]: a word's keys are the
index of its nearest codeword and those of its one-bit neighbours (one index
or six).  For words u, v at distance 1 or less the index of v is among the
keys of both, so each pair meets in a bucket (segment, its exact value, index).

Verification: inside a bucket of at most ``BUCKET`` fingerprints all pairs are
compared by distance; buckets return stars of linked fingerprints, not pairs.
Fuller buckets go the exact way: every member is listed under its 65 words at
distance 1 or less; two fingerprints are within distance 2 exactly if they
share such a word, and a word has at most 65 fingerprints, so nothing grows
with the square of a bucket and no link is lost.

Only distinct fingerprints are linked; copies follow their fingerprint.
Components come from star rounds in Spark (``components.py``).

Null and empty texts have fingerprint 0 and link like any other.  Component
identifiers are the smallest doc_id reachable; null identifiers are ignored
for that (a component of nulls has a null identifier).  Repeated rows give
repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.llm.common import scratch_table, sliced, small_batches, text_bytes
from seedlabel.llm.components import Forest, components, edge_batch

SHINGLE = 3
MAX_BITS = 2
HASH_SEED = 42
#: Fingerprints in a bucket that are compared in pairs; fuller buckets use shared neighbours.
BUCKET = 64

#: First bit and length of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the binary Golay code [23, 12, 7].
GENERATOR = 0b110001110101

#: _SPREAD[byte] holds bit k of the byte in its byte k, so sums of up to 255 entries count bits.
_SPREAD = np.array([sum((v >> k & 1) << 8 * k for k in range(8)) for v in range(256)], dtype=np.uint64)


def bit_votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit set (bit 0 first)."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for i in range(0, len(octets), 255):
        total += _SPREAD[octets[i:i + 255]].sum(axis=0).astype("<u8").view(np.uint8)
    return total


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: lowers A-Z, splits at the blank and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= k:
        starts, ends = starts[:len(words) - k + 1], ends[k - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], HASH_SEED) for a, b in zip(starts.tolist(), ends.tolist())], dtype=np.uint64)
    bits = bit_votes(hashes) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1):
        prints = np.array([fingerprint(t.as_py(), k) for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != 1),
                                          pa.array(_signed(prints))],
                                         [n for n in batch.schema.names if n != "text"] + ["fp"])


@functools.lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of the upper 12 bits, error pattern by syndrome)."""
    def remainder(w: int) -> int:
        for i in range(22, 10, -1):
            if w >> i & 1:
                w ^= GENERATOR << (i - 11)
        return w
    upper = np.array([remainder(m << 11) for m in range(1 << 12)], dtype=np.int64)
    error = np.zeros(1 << 11, dtype=np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            error[int(upper[e >> 11]) ^ (e & 0x7FF)] = e
    return upper, error


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index (12 message bits) of the codeword nearest to each 23-bit word."""
    upper, error = golay_tables()
    return (words ^ error[upper[words >> 11] ^ (words & 0x7FF)]) >> 11


def fuzzy_keys(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the distinct codeword indices of each word and its one-bit neighbours."""
    flips = np.concatenate(([0], 1 << np.arange(bits, dtype=np.int64)))
    index = np.sort(golay_index(words[:, None] ^ flips[None, :]), axis=1)
    first = np.ones(index.shape, bool)
    first[:, 1:] = index[:, 1:] != index[:, :-1]
    row, col = np.nonzero(first)
    return row, index[row, col]


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of unsigned fingerprints: exact segment and fuzzy successor."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for t in range(3):
        row, index = fuzzy_keys(parts[(t + 1) % 3], SEGMENTS[(t + 1) % 3][1])
        rows.append(row)
        keys.append((t << 34) | (parts[t][row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fp = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
            row, key = bucket_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])


def _bucket_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bounded lists of fingerprints -> edges to the smallest linked one."""
    for batch in batches:
        forest = Forest()
        for members in batch.column(0):
            fps = np.unique(np.array(members.as_py(), dtype=np.int64))
            near = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= MAX_BITS
            for a, b in zip(*np.nonzero(np.triu(near, 1))):
                forest.union(int(fps[a]), int(fps[b]))
        yield edge_batch(forest.stars())


def _neighbour_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)))
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fp = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
            words = (fp.view(np.uint64)[:, None] ^ flips[None, :]).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(words)), pa.array(np.repeat(fp, 65))], ["key", "fp"])


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) that connect all fingerprints
    within MAX_BITS of each other."""
    keys = prints.select("fp").mapInArrow(_keyed, "key long, fp long")
    full = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = scratch_table(keys.join(full, "key"), "simhash-members")
    lists = members.filter(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    crowded = members.filter(F.col("n") > bucket).select("fp").distinct()
    # at most 65 fingerprints have a word among their neighbours
    around = (crowded.mapInArrow(_neighbour_words, "key long, fp long").groupBy("key")
              .agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps"))
    return lists.unionByName(around).mapInArrow(_bucket_stars, "u long, v long")


def print_rows(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, fp) of every row, written once."""
    text = text_bytes(F.col(f"`{text_col}`"))
    rows = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"),
                       F.unhex(F.md5(text)).alias("digest"))
    return scratch_table(rows.mapInArrow(lambda it: _fingerprints(it, k), "doc_id long, digest binary, fp long"),
                         "simhash-prints")


def classes(rows: DataFrame) -> DataFrame:
    """Distinct fingerprints with their component: (fp, root, component_id)."""
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("min_id"))
    roots = components(links(prints))
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "min_id")
    placed = scratch_table(placed, "simhash-classes")
    least = placed.groupBy("root").agg(F.min("min_id").alias("component_id"))
    return placed.select("fp", "root").join(least, "root")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = print_rows(docs, k, id_col, text_col)
    return rows.join(classes(rows), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_class(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` per component, unchanged: the smallest doc_id (nulls
    last), then the smallest text digest; of equal rows one."""
    rows = print_rows(docs, k)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")
    picks = (rows.join(classes(rows), "fp").groupBy("root").agg(F.min(order).alias("pick"))
             .select(_row_id(F.col("pick.doc_id")).alias("simhash_id"), F.col("pick.digest").alias("simhash_digest")))
    picks = scratch_table(picks, "simhash-picks")
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       _row_id(F.col("doc_id")).alias("simhash_id"),
                       F.unhex(F.md5(text_bytes(F.col("text")))).alias("simhash_digest"))
    key = ["simhash_id", "simhash_digest"]
    kept = mine.join(picks, key, "left_semi").dropDuplicates(key)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _row_id(ident):
    return F.coalesce(ident.cast("long").cast("string"), F.lit("none"))
