"""Packing, collocations and the conversation trie against direct computations."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import __spark_entry__ as entry  # noqa: E402
from seedlabel.llm import collocations, conversation_trie, packing  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def tokenizer_path():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


# --- packing ------------------------------------------------------------------

def least_sequences(lengths, capacity):
    """The fewest sequences, by exhaustive search."""
    @lru_cache(maxsize=None)
    def go(rest):
        if not rest:
            return 0
        best = len(rest)
        others = rest[1:]
        for bits in range(1 << len(others)):
            chosen = [x for i, x in enumerate(others) if bits >> i & 1]
            if rest[0] + sum(chosen) <= capacity:
                left = tuple(x for i, x in enumerate(others) if not bits >> i & 1)
                best = min(best, 1 + go(left))
        return best
    return go(tuple(sorted(lengths, reverse=True)))


@settings(max_examples=80, deadline=None)
@given(st.integers(6, 20).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=8))))
def test_dominating_sets_keep_the_optimum(case):
    capacity, lengths = case
    stock = np.zeros(capacity + 1, np.int64)
    for x in lengths:
        stock[x] += 1
    fixed = packing.reduce_stock(stock)
    rest = [x for x in range(capacity + 1) for _ in range(int(stock[x]))]
    for chosen, _ in fixed:
        assert sum(chosen) <= capacity
    assert sum(n for _, n in fixed) + least_sequences(rest, capacity) == least_sequences(lengths, capacity)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(
    st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 50), min_size=1, max_size=20))))
def test_plan_fills_sequences_without_gaps(case):
    capacity, counts = case
    plan = packing.Plan(counts, capacity)
    filled = defaultdict(list)
    for length, n in counts.items():
        for s, o in zip(*plan.place(np.full(n, length), np.arange(n))):
            filled[int(s)].append((int(o), length))
    assert sorted(filled) == list(range(plan.sequences))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(k * n for k, n in counts.items())
    assert plan.sequences <= 2 * -(-total // capacity) + 1


def test_ids_equal_the_library_on_every_character():
    from tokenizers import Tokenizer
    encoder, library = packing.encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b 1{chr(c)} {chr(c)}.{chr(c)}2 \n" for c in points[i:i + 400])
             for i in range(0, len(points), 400)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert encoder.ids(text).tolist() == want.ids


@pytest.mark.parametrize("text", ["", " ", "a<|endoftext|>b <|endoftext|>", "x" * 300_000, " " * 200_000,
                                  "it's 10 o'clock é中\U0001f600\r\n\r\n ok"])
def test_ids_equal_the_library(text):
    from tokenizers import Tokenizer
    want = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert packing.encoder(tokenizer_path()).ids(text).tolist() == want


def check_packing(rows, got, capacity):
    """Pieces are the documents', sequences hold them side by side."""
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def test_packing_of_a_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = entry.queries()["op11_packing"](spark, SMALL).collect()
    n = check_packing([(r.doc_id, r.text) for r in docs.collect()], got, 1024)
    assert n <= -(-sum(r.length for r in got) // 1024) * 1.02 + 1


EDGE = [(None, None), (None, "word"), (1, ""), (2, None), (3, "alpha beta " * 30000), (5, "same"), (5, "same"),
        (6, "a<|endoftext|>b")] + [(9, "copy copy")] * 40


def test_packing_edges(spark):
    docs = spark.createDataFrame([(a, b, "x", "y") for a, b in EDGE], "doc_id long, text string, length string, place string")
    got = packing.pack(docs, tokenizer_path(), capacity=64).collect()
    check_packing(EDGE, got, 64)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    shuffled = packing.pack(docs.repartition(13), tokenizer_path(), capacity=64).collect()
    assert len({r.sequence_id for r in shuffled}) == len({r.sequence_id for r in got})
    assert packing.pack(docs.limit(0), tokenizer_path()).collect() == []


# --- collocations -------------------------------------------------------------

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases_by_hand(rows, min_count, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    found = {k: a for k, a in f.items() if a >= min_count and len(k[1]) > 1}
    covered = {(lang, w[i:i + k]) for (lang, w), a in found.items() for k in range(2, len(w))
               for i in range(len(w) - k + 1) if 100 * a >= 80 * f[lang, w[i:i + k]]}
    best = defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in covered:
            score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            best[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, r, n[lang], -s) for lang, v in best.items()
                  for i, (s, a, p, x, r) in enumerate(sorted(v)[:top]))


def random_texts(seed):
    rng = random.Random(seed)
    words = ["The", "of", "new", "york", "été", "中", "a-b", "x" * 300]
    out = []
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", " \x0b"])
                       for _ in range(rng.randint(0, 25)))
        out.append((rng.choice(["en", "en", "fr", None, "und", ""]), text))
    return out + [(None, None), ("en", ""), ("xx", " .,; ")] + [("en", "New York city of dreams")] * 60


@pytest.mark.parametrize("seed,tile,dense,buffer", [(1, 1024, 1 << 17, 4 << 20), (2, 2, 8, 3000), (3, 4, 1, 500)])
def test_collocations_by_hand(spark, monkeypatch, seed, tile, dense, buffer):
    rows = random_texts(seed)
    docs = spark.createDataFrame([(a, b, "z") for a, b in rows], "lang string, text string, phrase string").repartition(3)
    monkeypatch.setattr(collocations, "TILE", tile)
    monkeypatch.setattr(collocations, "DENSE", dense)
    monkeypatch.setattr(collocations, "BUFFER", buffer)
    got = sorted(map(tuple, collocations.collocations(docs, min_count=4).collect()))
    assert got == phrases_by_hand(rows, 4)


def test_a_full_bit_table_changes_no_count(spark, monkeypatch):
    rows = random_texts(4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(collocations, "MIN_BITS", 64)
    monkeypatch.setattr(collocations, "MAX_BITS", 64)
    assert sorted(map(tuple, collocations.collocations(docs, min_count=4).collect())) == phrases_by_hand(rows, 4)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=300), st.integers(1, 16))
def test_tiles_count_pairs(pairs, tile):
    a, b = (np.array(x, np.int64) for x in zip(*pairs))
    old = collocations.TILE, collocations.DENSE
    collocations.TILE, collocations.DENSE = tile, 3
    try:
        first, second, counts, which = collocations.count_tiles(a, b)
    finally:
        collocations.TILE, collocations.DENSE = old
    assert Counter(pairs) == Counter({(int(x), int(y)): int(n) for x, y, n in zip(first, second, counts)})
    assert (first[which] == a).all() and (second[which] == b).all()


def test_long_texts_are_cut_at_piece_ends(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 50)
    for text in (b"ab cd. " * 40, b"word " * 100, b"a" * 400 + b"." + b"b" * 30, b"x" * 51):
        parts = list(collocations._parts(text))
        assert b"".join(parts) == text
        assert all(p[-1:] in b".,;:!?\n\x0b\x0c\r" for p in parts[:-1] if p) or b"." not in text


def test_no_documents_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


# --- conversation trie --------------------------------------------------------

def trie_by_hand(rows, rebuild=True):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            d = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            conv[c].append((turn is not None, turn or 0, role, d, text))
    conv = {c: tuple((x[2], x[4]) for x in sorted(v)) for c, v in conv.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in conv}
        conv = {c: conv.get(c - c % 100, ())[:h[c]] + v[h[c]:] for c, v in conv.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in conv.items():
        ends[v].append(c)
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
                   for k, m in members.items()), key=str)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 120), *range(205, 230)]:
        for t in range(rng.choice([1, 2, 3, 5, 8, 9, 21])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["u", "a", None]), rng.choice(["x", "yy", "é中", None])))
    rows += [(300 + i, t, "u", "same") for i in range(60) for t in range(6)]
    rows += [(700, t, "u", str(t % 3)) for t in range(300)] + [(701, t, "u", str(t % 3)) for t in range(280)]
    rows += [(None, 1, "u", "nobody's"), (800, 1, "u", "twice"), (800, 1, "u", "twice")]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,block,fan,stride", [(1, 4, 16, 1024), (2, 2, 2, 8)])
def test_trie_by_hand(spark, monkeypatch, seed, block, fan, stride):
    for name, value in (("BLOCK", block), ("FAN", fan), ("STRIDE", stride), ("END_IDS", 7)):
        monkeypatch.setattr(conversation_trie, name, value)
    rows = conversations(seed)
    turns = spark.createDataFrame([(*r, "z", "z") for r in rows], SCHEMA + ", depth string, c string").repartition(5)
    got = sorted(map(tuple, conversation_trie.rebuilt_trie(turns).collect()), key=str)
    assert got == trie_by_hand(rows)


def test_trie_of_conversations_as_they_are(spark):
    rows = conversations(5)
    got = conversation_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == trie_by_hand(rows, rebuild=False)


def test_one_conversation_over_many_tasks(spark):
    rows = [(7, t, "u", str(t)) for t in range(500)]
    got = conversation_trie.ordered_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("pos").collect()
    assert [(r.c, r.pos) for r in got] == [(7, i) for i in range(500)]
    assert [r.n_chars for r in got] == [len(str(t)) for t in range(500)]


def test_no_turns_no_nodes(spark):
    assert conversation_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).collect() == []
