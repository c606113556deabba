"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

A document is its token ids and an end id; one of more than ``capacity`` ids is
cut into pieces of ``capacity``, the first piece taking what is left over.
Which pieces share a sequence depends on their lengths alone, and there are at
most ``capacity`` lengths, so the packing is planned on the counts by length
(the only data that reach the driver, whatever the corpus):

1. **Reduction.**  From the longest length down, a set of at most three
   lengths is fixed as a finished sequence when it provably dominates every
   other set that could hold its longest piece: nothing else fits beside it;
   the largest piece that fits leaves no room, or no two pieces fit; two at
   most fit and the best single piece or the best pair covers all of them.
   A set is fixed for as many copies as the stock allows; the sweep repeats
   until it fixes nothing more.
2. **Best fit.**  What is left is placed by decreasing length into the fullest
   sequence that takes it; sequences of equal fill are handled as one group.

The plan is a short list of runs: so many pieces of a length, from the k-th on,
go to consecutive sequences at an offset.  It is sent to the tasks, where a
piece finds its run by binary search on (length, rank).  A rank is the piece's
place within its task plus the pieces of that length in earlier tasks.

Token ids are the tokenizer library's.  The merges run in a rank-based encoder
over the same vocabulary, after an offline proof (once per worker) that it
gives the same ids: identifiers grow with the merges, and every vocabulary
string encodes alone as itself, so two neighbours whose union is in the
vocabulary are always the pair that the merge list names.

Scale: one narrow pass over the texts; the pieces (without ids unless asked
for) are written once and read back, joined by (length, task) to the counts of
earlier tasks.  No group is gathered: a third of all pieces may have one
length.  A task holds one slice of texts.

Null and empty texts are the end id alone; a very long text makes as many
pieces as it needs (its ids are held by one task); repeated rows are packed as
often as they occur; an empty table gives no rows; null ids stay null; other
columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedlabel.llm.common import broadcast_checked, scratch_table, sliced, small_batches, text_bytes
from seedlabel.llm.token_counts import PRE_TOKEN, byte_alphabet

CAPACITY = 1024
END_ID = 2
#: Characters beyond which a text goes through the library itself: the
#: rank-based encoder's pattern matcher is not made for endless runs.
LONG_TEXT = 100_000
#: Rows of (length, task) counts that are broadcast (24 bytes each); beyond it they are joined by shuffle.
MAX_COUNT_ROWS = 200_000
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, place long"


class Encoder:
    """Token ids of a text as the tokenizer file's library gives them."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
        if (model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel"
                or pre.get("add_prefix_space") or not pre.get("use_regex", True)
                or model.get("dropout") or model.get("ignore_merges")
                or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)):
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        back = {c: b for b, c in byte_alphabet().items()}
        self.specials = {a["content"]: a["id"] for a in added}
        vocab = {s: i for s, i in model["vocab"].items() if s not in self.specials}
        self.prove(vocab, model["merges"])
        ranks = {bytes(back[c] for c in s): i for s, i in vocab.items()}
        self.ranked = tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        longest_first = sorted(self.specials, key=len, reverse=True)
        self.find_special = regex.compile("|".join(map(regex.escape, longest_first))) if added else None

    def prove(self, vocab: dict[str, int], merges: list) -> None:
        """The offline proof that ranks and merge list agree (see above)."""
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError("identifiers do not grow with the merges")
        tokenize = self.library.model.tokenize
        if any([t.id for t in tokenize(s)] != [i] for s, i in vocab.items()):
            raise ValueError("a vocabulary string does not encode as itself")

    def ids(self, text: str) -> np.ndarray:
        if len(text) > LONG_TEXT:
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        if self.find_special is None or not self.find_special.search(text):
            return np.asarray(self.ranked.encode_ordinary(text), "<u4")
        out, at = [], 0
        for m in self.find_special.finditer(text):
            out += [*self.ranked.encode_ordinary(text[at:m.start()]), self.specials[m.group()]]
            at = m.end()
        return np.asarray(out + self.ranked.encode_ordinary(text[at:]), "<u4")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(total: int, capacity: int) -> list[int]:
    """Where the pieces of ``total`` ids start: full pieces, the first one shorter."""
    first = total % capacity
    return ([0] if first else []) + list(range(first, total, capacity))


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int,
            with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).ids
    task = TaskContext.get().partitionId()
    seen = [0] * (capacity + 1)
    end = np.array([end_id], "<u4")
    for batch in sliced(batches, 1):
        rows, kept = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.concatenate([encode(text.decode(errors="replace")), end])
            starts = cuts(len(ids), capacity)
            for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                rows.append((doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, seen[b - a]))
                seen[b - a] += 1
                if with_ids:
                    kept.append(ids[a:b].astype(np.int32))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)]
        if with_ids:
            columns.append(pa.array(kept, pa.list_(pa.int32())))
        names = [c.split()[0] for c in PIECES.split(", ")] + (["ids"] if with_ids else [])
        yield pa.RecordBatch.from_arrays(columns, names)


# --- the plan, on counts by length --------------------------------------------

def _smallest(stock: np.ndarray, n: int, above: int = 0) -> list[int]:
    """The ``n`` smallest pieces in stock that are longer than ``above``."""
    out = []
    for length in np.flatnonzero(stock[above + 1:])[:n] + above + 1:
        out += [int(length)] * min(n - len(out), int(stock[length]))
        if len(out) == n:
            break
    return out


def _largest_upto(stock: np.ndarray) -> np.ndarray:
    """For every x, the largest length in stock of at most x (0: none)."""
    return np.maximum.accumulate(np.where(stock > 0, np.arange(len(stock)), 0))


def best_pair(stock: np.ndarray, room: int) -> tuple[int, int]:
    """Two pieces in stock, the longer first, of the largest sum within ``room``."""
    upto = _largest_upto(stock)
    a = np.flatnonzero(stock[:room + 1])
    partner = np.minimum(a, room - a)
    b = upto[partner]
    b = np.where((b == a) & (stock[a] < 2), upto[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    i = int(np.argmax(total)) if len(a) else 0
    return (int(a[i]), int(b[i])) if len(a) and total[i] else (0, 0)


def dominating_set(stock: np.ndarray, length: int) -> tuple[int, ...] | None:
    """A set of pieces in stock that holds ``length`` and dominates all others
    that do, if the criterion finds one."""
    capacity = len(stock) - 1
    room = capacity - length
    rest = stock.copy()
    rest[length] -= 1
    low = _smallest(rest, 3)
    if not low or low[0] > room:
        return (length,)
    single = int(_largest_upto(rest)[room])
    if single == room or len(low) == 1 or low[0] + low[1] > room:
        return (length, single)
    if len(low) == 3 and sum(low) <= room:
        return None  # three more pieces may fit
    a, b = best_pair(rest, room)
    if single >= a + b:
        return (length, single)
    if a == single:
        rest[a] -= 1
        between = _smallest(rest, 2, above=b)
        if len(between) < 2 or sum(between) > room:
            return (length, a, b)
    return None


def reduce_stock(stock: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets until none is found; takes them out of ``stock``."""
    fixed, found = [], True
    while found:
        found = False
        for length in range(len(stock) - 1, 0, -1):
            while stock[length]:
                chosen = dominating_set(stock, length)
                if chosen is None:
                    break
                need = Counter(chosen)
                times = min(int(stock[x]) // k for x, k in need.items())
                for x, k in need.items():
                    stock[x] -= k * times
                fixed.append((chosen, times))
                found = True
    return fixed


class Plan:
    """Runs of pieces: (length, first rank) -> per sequence, first sequence, offset."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.next_rank = [0] * (capacity + 1)
        self.runs: list[tuple[int, int, int, int, int]] = []
        stock = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            stock[length] = n
        self.fixed = reduce_stock(stock)
        for chosen, times in self.fixed:
            offset = 0
            for length in chosen:
                self.run(length, times, 1, self.sequences, offset)
                offset += length
            self.sequences += times
        self.best_fit(stock)
        self.runs.sort()
        r = np.array(self.runs, np.int64).reshape(-1, 5)
        self.keys = (r[:, 0] << 44) | r[:, 1]
        self.first_rank, self.per_sequence, self.first_sequence, self.offset = r[:, 1], r[:, 2], r[:, 3], r[:, 4]

    def run(self, length: int, n: int, per_sequence: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.next_rank[length], per_sequence, sequence, offset))
        self.next_rank[length] += n

    def best_fit(self, stock: np.ndarray) -> None:
        """Decreasing best fit, sequences of equal room in groups (first, n)."""
        groups: dict[int, list[tuple[int, int]]] = {}
        for length in np.flatnonzero(stock)[::-1]:
            length, left = int(length), int(stock[length])
            while left:
                room = min((r for r in groups if r >= length), default=None)
                if room is None:
                    room, n = self.capacity, -(-left // (self.capacity // length))
                    first, self.sequences = self.sequences, self.sequences + n
                else:
                    first, n = groups[room].pop()
                    if not groups[room]:
                        del groups[room]
                each = room // length
                full = min(n, left // each)
                some = left - full * each if full < n else 0
                for start, count, k in ((first, full, each), (first + full, min(some, 1), some)):
                    if count:
                        self.run(length, count * k, k, start, self.capacity - room)
                        if room - k * length:
                            groups.setdefault(room - k * length, []).append((start, count))
                        left -= count * k
                used = full + min(some, 1)
                if used < n:
                    groups.setdefault(room, []).append((first + used, n - used))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these ranks within their length."""
        i = np.searchsorted(self.keys, (length.astype(np.int64) << 44) | rank, "right") - 1
        j = rank - self.first_rank[i]
        return (self.first_sequence[i] + j // self.per_sequence[i],
                self.offset[i] + j % self.per_sequence[i] * length)


def _placed(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rank = batch.column("rank").to_numpy()
        sequence, offset = plan.place(batch.column("length").to_numpy(), rank)
        names = [n for n in batch.schema.names if n != "rank"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)],
                                         [*names, "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (the
    token ids, unless ``with_ids`` is false), sequence_id, offset.  ``path`` is
    the tokenizer file's place on every executor."""
    rows = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                                      text_bytes(F.col(f"`{text_col}`")).alias("text"))
    schema = PIECES + (", ids array<int>" if with_ids else "")
    pieces = scratch_table(rows.mapInArrow(lambda it: _pieces(it, path, capacity, end_id, with_ids), schema),
                           "pack-pieces")
    counts = scratch_table(pieces.groupBy("length", "task").agg((F.max("place") + 1).alias("n")), "pack-counts")
    plan = Plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = (pieces.join(broadcast_checked(before, MAX_COUNT_ROWS), ["length", "task"])
              .withColumn("rank", F.col("before") + F.col("place"))
              .select(*[c for c in pieces.columns if c not in ("task", "place", "length")],
                      F.col("length").cast("long").alias("length"), "rank"))
    names = [c for c in ranked.columns if c != "rank"]
    out = ", ".join(f"{n} {ranked.schema[n].dataType.simpleString()}" for n in names)
    placed = ranked.mapInArrow(lambda it: _placed(it, plan), f"{out}, sequence_id long, offset long")
    front = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return placed.select(*front, *(["ids"] if with_ids else []), "sequence_id", "offset")
