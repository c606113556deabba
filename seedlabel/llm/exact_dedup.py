"""Exact de-duplication with Patricia-trie owners.

Texts are equal when identical after every run of blanks and controls
0x09-0x0D became one blank.  The normalised text's length and SHA-256 digest
name its partition.  Inside a scan task the full byte strings go into
compressed radix tries, one below each (length, digest); a terminal node
stores the smallest identifier and the number of rows.  When the tries of a
task exceed a byte budget, whole subtrees are emitted and freed (spill by
subtree).  The emitted terminals, at most one per distinct text and spill, are
dealt by (length, digest), sorted, and inserted into a second trie, which
again holds full byte strings; a subtree is complete as soon as a larger key
arrives.  So a text with a third of all rows reaches its owner's task as a few
rows per scan task, never as its copies.

Owners of two rows or more are then joined to the (doc_id, length, digest)
rows.  No text takes part in that join and Spark may split its hot keys.

Null texts count as empty; an empty text is a text like any other.  A null
doc_id counts as larger than any other.  Of rows with equal doc_id and equal
text one is kept.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.llm.common import SPACE_RUN, small_batches

#: Bytes of text that the tries of one task may hold before subtrees spill.
TRIE_BYTES = 16 << 20

_TERMINALS = "n_bytes long, digest binary, text binary, min_id long, n_rows long"
_OWNERS = "n_bytes long, digest binary, keep_id long, group_size long"


def smaller(a: int | None, b: int | None) -> int | None:
    """The smaller identifier; null is larger than any."""
    if a is None or b is None:
        return b if a is None else a
    return a if a < b else b


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving (slices compare in C)."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Node:
    """A compressed edge label, the children by first byte, and the terminal's
    smallest identifier and row count (0 rows: no text ends here)."""

    __slots__ = ("label", "children", "min_id", "n_rows")

    def __init__(self, label: bytes):
        self.label, self.children, self.min_id, self.n_rows = label, {}, None, 0

    def end_here(self, ident: int | None, n: int) -> None:
        self.min_id = ident if not self.n_rows else smaller(self.min_id, ident)
        self.n_rows += n


class PatriciaTrie:
    """Compressed radix trie over byte strings."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def insert(self, text: bytes, ident: int | None, n: int = 1) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.size += len(child.label) + 200
                child.end_here(ident, n)
                return
            label = child.label
            if not text.startswith(label, at):
                k = common_prefix(label, text[at:at + len(label)])
                upper = Node(label[:k])
                child.label = label[k:]
                upper.children[child.label[0]] = child
                node.children[text[at]] = upper
                self.size += 200
                child = upper
                label = upper.label
            node, at = child, at + len(label)
        node.end_here(ident, n)

    def terminals(self) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            text = prefix + node.label
            if node.n_rows:
                yield text, node.min_id, node.n_rows
            stack += [(c, text) for c in node.children.values()]


class Owners:
    """Tries by (length, digest) under one byte budget."""

    def __init__(self, budget: int):
        self.tries: dict[tuple[int, bytes], PatriciaTrie] = {}
        self.budget, self.size = budget, 0

    def insert(self, key: tuple[int, bytes], text: bytes, ident: int | None, n: int) -> None:
        trie = self.tries.get(key)
        if trie is None:
            trie = self.tries[key] = PatriciaTrie()
        before = trie.size
        trie.insert(text, ident, n)
        self.size += trie.size - before

    def spill(self) -> list[tuple]:
        """Terminal rows of every subtree, which are then freed."""
        rows = [(*key, text, ident, n) for key, trie in self.tries.items() for text, ident, n in trie.terminals()]
        self.tries, self.size = {}, 0
        return rows


def _batch(rows: list[tuple], with_text: bool) -> pa.RecordBatch:
    cols = list(zip(*rows))
    arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())]
    names = ["n_bytes", "digest"]
    if with_text:
        arrays.append(pa.array(cols[2], pa.binary()))
        names.append("text")
    return pa.RecordBatch.from_arrays(arrays + [pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                                      names + (["min_id", "n_rows"] if with_text else ["keep_id", "group_size"]))


def scan_terminals(batches: Iterator[pa.RecordBatch], budget: int = TRIE_BYTES) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, digest, text) -> distinct texts of the task, per spill."""
    owners = Owners(budget)
    for batch in batches:
        ids, lengths, digests, texts = (batch.column(i) for i in range(4))
        for i in range(batch.num_rows):
            owners.insert((lengths[i].as_py(), digests[i].as_py()), texts[i].as_py(), ids[i].as_py(), 1)
            if owners.size > budget:
                yield _batch(owners.spill(), True)
    if rows := owners.spill():
        yield _batch(rows, True)


def merge_terminals(batches: Iterator[pa.RecordBatch], budget: int = TRIE_BYTES) -> Iterator[pa.RecordBatch]:
    """Terminals sorted by (length, digest) -> one owner per distinct text."""
    owners = Owners(budget)
    last = None
    for batch in batches:
        lengths, digests, texts, ids, counts = (batch.column(i) for i in range(5))
        for i in range(batch.num_rows):
            key = (lengths[i].as_py(), digests[i].as_py())
            if key != last and owners.size > budget:  # all subtrees before this key are complete
                yield _batch(owners.spill(), False)
            owners.insert(key, texts[i].as_py(), ids[i].as_py(), counts[i].as_py())
            last = key
    if rows := owners.spill():
        yield _batch(rows, False)


def normalised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, digest, norm) of every row."""
    norm = F.regexp_replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), SPACE_RUN, " ")
    return (small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), norm.alias("norm"))
            .select("doc_id", F.octet_length("norm").cast("long").alias("n_bytes"),
                    F.unhex(F.sha2("norm", 256)).alias("digest"), F.col("norm").cast("binary").alias("norm")))


def text_owners(rows: DataFrame, budget: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: (n_bytes, digest, keep_id, group_size)."""
    local = rows.mapInArrow(lambda it: scan_terminals(it, budget), _TERMINALS)
    dealt = local.repartition("n_bytes", "digest").sortWithinPartitions("n_bytes", "digest")
    return dealt.mapInArrow(lambda it: merge_terminals(it, budget), _OWNERS)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     budget: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = normalised(docs, id_col, text_col)
    owners = text_owners(rows, budget).filter("group_size > 1")
    # rows that agree in identifier and text are counted, so that one of them stays
    keys = rows.groupBy("doc_id", "n_bytes", "digest").agg(F.count(F.lit(1)).alias("n"))
    out = (keys.join(owners, ["n_bytes", "digest"], "left")
           .select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"),
                   F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                   F.lower(F.hex("digest")).alias("text_sha256"), "n"))
    copies = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return copies.select("doc_id", "keep_id", "group_size",
                         ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
                         "text_sha256")
