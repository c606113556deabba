"""Each operator against a direct computation in plain Python."""

import hashlib
import os
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from oracle_check import compare, duck  # noqa: E402
from seedlabel.llm import (components, decontaminate, exact_dedup, html_extract, mixing, quality, sharding,  # noqa: E402
                           simhash, substrings, token_counts, toxicity)

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
OURS = sorted(n for n in entry.queries() if n.startswith("op") and n.split("_")[0][2:].isdigit())


def test_thirteen_operators_and_the_pipeline_are_registered():
    assert [int(n[2:].split("_")[0]) for n in sorted(OURS, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [n for n in OURS if n in entry.oracle_sql()])
def test_sql_twin(spark, name):
    r = compare(spark, duck(SMALL), name, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert r["cols_ok"] and r["types_ok"] and r["values_ok"], r


def documents(spark, sf=SMALL):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- components

@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(5000, 5001 + i) for i in range(300)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(6)
    got = {r.node: r.root for r in components.components(df).collect()}
    forest = components.Forest()
    for a, b in edges:
        forest.union(a, b)
    want = {x: forest.find(x) for e in edges for x in e if forest.find(x) != x}
    assert got == want


# --- SimHash

def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    forest = components.Forest()
    values = np.array([p for _, p in prints], dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        forest.union(prints[a][0], prints[b][0])
    return {i: forest.find(i) for i, _ in prints}


def test_simhash_of_documents(spark):
    docs = documents(spark)
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    want = plain_classes(prints)
    for r in simhash.near_duplicates(docs).collect():
        assert r.fingerprint == f"{dict(prints)[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_golay_keys_meet_within_two_errors():
    rng = np.random.default_rng(0)
    for _ in range(2000):
        f = g = rng.integers(0, 1 << 63, dtype=np.uint64)
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            g = g ^ (np.uint64(1) << np.uint64(b))
        row, key = simhash.bucket_keys(np.array([f, g], dtype=np.uint64))
        assert set(key[row == 0]) & set(key[row == 1])


def test_golay_decoding_finds_the_only_near_codeword():
    words = np.random.default_rng(1).integers(0, 1 << 23, 4000)
    upper, error = simhash.golay_tables()
    nearest = words ^ error[upper[words >> 11] ^ (words & 0x7FF)]
    assert np.bitwise_count(words ^ nearest).max() <= 3
    assert not (upper[nearest >> 11] ^ (nearest & 0x7FF)).any()


@pytest.mark.parametrize("bucket", [1, 2, 64])
def test_links_of_crowded_buckets(spark, bucket):
    """Chains and balls of near fingerprints; small limits force the exact way for full buckets."""
    rng = np.random.default_rng(2)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        f = int(rng.integers(0, 1 << 63, dtype=np.uint64))
        for _ in range(25):
            prints.add(f)
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                f ^= 1 << int(b)
    prints = sorted(prints)
    want = plain_classes([(int(np.uint64(p).astype(np.int64)), p) for p in prints])
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    got = {r.node: r.root for r in components.components(simhash.links(df, bucket)).collect()}
    assert {k: got.get(k, k) for k in want} == want


# --- exact duplicates

def test_trie_owners(spark):
    rng = random.Random(5)
    words = ["a", "ab", "abc", "", " ", "b c"]
    rows = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(5)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    groups = defaultdict(list)
    norm = {i: " ".join([*t.split(" ")]) for i, t in rows}
    norm = {i: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in rows}
    for i, t in norm.items():
        groups[t].append(i)
    for budget in (1, 1 << 24):
        for r in exact_dedup.exact_duplicates(docs, budget=budget).collect():
            members = groups[norm[r.doc_id]]
            assert (r.keep_id, r.group_size, r.kept) == (min(members), len(members), r.doc_id == min(members))
            assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()


def test_patricia_trie_splits_edges():
    trie = exact_dedup.PatriciaTrie()
    texts = [b"", b"romane", b"romanus", b"romulus", b"rom", b"rubens", b"romane"]
    for i, t in enumerate(texts):
        trie.insert(t, 10 - i)
    assert sorted(trie.terminals()) == sorted((t, 10 - max(i for i, x in enumerate(texts) if x == t), texts.count(t))
                                              for t in set(texts))


# --- token counts

def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    odd = ["", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", " \n\n x'll I'LL don't", "\x85\xa0　  x", "\x1c\x1d a"]
    odd += ["".join(chr(rng.choice([32, 10, 39, rng.randrange(33, 300), rng.randrange(0x400, 0x3100),
                                    rng.randrange(0x1F300, 0x1F700)])) for _ in range(60)) for _ in range(200)]
    docs = documents(spark).select("doc_id", "text").union(
        spark.createDataFrame([(10 ** 6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.token_counts(docs, path).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 1024, len(texts[r.doc_id].encode()))


# --- trained operators

@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, module, label):
    docs, labels = documents(spark, MIDDLE), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    out = module.scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(out) > 50 and all(0 <= r.score <= 1 for r in out)
    assert sum(r.predicted == r[label] for r in out) / len(out) >= 0.95
    ones, zeros = ([r.score for r in out if r[label] == y] for y in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]) >= 0.8  # labels of 1 score higher


def test_held_out_labels_do_not_matter(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SMALL}/labels.parquet")
    held = quality.held_out(F.col("doc_id"), quality.HOLD_MODULUS, quality.HOLD_REMAINDER)
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.scores(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    fm = quality.FactorisationMachine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    i, x = np.array([2, 5, 7, 11]), rng.normal(size=4)
    pairs = sum(fm.factors[i[a]] @ fm.factors[i[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert abs(fm.margin(i, x) - (0.3 + fm.linear[i] @ x + pairs)) < 1e-9


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_levenshtein_trie():
    rng = random.Random(1)
    for _ in range(60):
        terms = ["".join(rng.choice("abc") for _ in range(rng.randint(4, 8))) for _ in range(6)]
        trie = toxicity.Trie(terms, [])
        for _ in range(60):
            w = "".join(rng.choice("abc") for _ in range(rng.randint(3, 9)))
            near = any(len(t) >= toxicity.FUZZY_LETTERS and edit_distance(w, t) <= 1 for t in terms)
            assert trie.lookup(w) == (toxicity.EXACT if w in terms else toxicity.FUZZY if near else 0)


def test_quotation_counts_less_and_misspellings_count():
    memo = toxicity.Memo(toxicity.Trie(["idiot", "moron"], ["lowe"]))
    plain = toxicity.hit_features("you are an idiot today", memo)
    cited = toxicity.hit_features('the paper wrote "you are an idiot" yesterday', memo)
    assert plain[0] > cited[0] > 0 and cited[4] > 0 == plain[4]
    assert toxicity.hit_features("an idi0t", memo)[2] > 0 and toxicity.hit_features("so loweix", memo)[1] > 0
    assert not toxicity.hit_features("a kind word", memo).any()


# --- decontamination, substrings

def folded(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text).split(" ")


def test_wu_manber_against_every_position(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "C", "é", "d1"])
    docs = [(i, rng.choice([" ", "-", "\n"]).join(word() for _ in range(rng.randrange(40)))) for i in range(150)]
    items = [(j, " ".join(word() for _ in range(rng.randrange(1, 7)))) for j in range(12)] + [(0, "a b"), (99, "")]
    window = 4
    got = {r.doc_id: r for r in decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
        window).collect()}
    for i, text in docs:
        w = [x for x in folded(text) if x]
        hit, found = set(), set()
        for j, t in items:
            p = [x for x in folded(t) if x]
            m = min(window, len(p))
            for k in range(len(p) - m + 1 if m else 0):
                for s in range(len(w) - m + 1):
                    if w[s:s + m] == p[k:k + m]:
                        hit |= set(range(s, s + m))
                        found.add(str(j))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("cells, hot", [(1 << 5, 4), (1 << 5, 1 << 20), (substrings.SEGMENT_CELLS, substrings.HOT_CELLS)])
def test_substrings_against_every_window(spark, cells, hot):
    rng = random.Random(6)
    passages = [[f"p{k}_{i}" for i in range(rng.choice([34, 35, 36, 60]))] for k in range(6)]
    rows = []
    for i in range(120):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(50))]
        if i % 3:
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        if i % 17 == 0:
            words += ["z"] * 80
        rows.append((i, "\n ".join(words)))
    count, n = Counter(), substrings.WINDOW
    for _, t in rows:
        w = t.split()
        count.update(tuple(w[s:s + n]) for s in range(len(w) - n + 1))
    got = {r.doc_id: r for r in substrings.remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string"), segment_cells=cells, hot_cells=hot).collect()}
    for i, t in rows:
        w = t.split()
        gone = {k for s in range(len(w) - n + 1) if count[tuple(w[s:s + n])] > 1 for k in range(s, s + n)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), len(gone), kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_sketch_of_many_segments_estimates_as_sharply(spark):
    """Windows that reach the exact pass stay near the true repeats however many segments there are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    count, n = Counter(), substrings.WINDOW
    for r in docs.collect():
        w = (r.text or "").split()
        count.update(hash(tuple(w[s:s + n])) for s in range(len(w) - n + 1))
    true = sum(c for c in count.values() if c > 1)
    for cells, hot in ((1 << 8, 64), (1 << 8, 1 << 16), (1 << 18, 64)):
        found = substrings.Prefilter(docs, segment_cells=cells, hot_cells=hot)
        assert true <= found.windows().count() <= 1.2 * true
        assert len(found.hot.value) <= 2 * hot
        assert found.layout.segment_bits >= (10 if cells < 1 << 10 else 0)


def test_rolling_hashes_and_minima():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    base = substrings._BASES[0]
    want = [sum(int(x) * pow(base, -j, 1 << 64) for j, x in enumerate(h[s:s + 35])) % (1 << 64) for s in range(166)]
    assert substrings.rolling(h, 35, base).tolist() == want
    for width in (1, 2, 3, 24, 35):
        assert substrings.sliding_min(h, width).tolist() == [h[s:s + width].min() for s in range(201 - width)]


# --- sharding, mixing

def test_lookup_table_is_even_and_stable():
    names = sharding.shard_names(12)
    slots = sharding.next_prime(1200)
    table = sharding.lookup_table(names, slots)
    share = Counter(table)
    assert max(share.values()) - min(share.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], slots)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 11)
    assert moved < 0.15 * slots
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1200)


def test_sharding_plan_has_no_shuffle_and_no_python(spark):
    plan = sharding.place(documents(spark), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan
    assert "hashpartitioning" not in plan


def test_shards_are_written(spark, tmp_dir):
    placed = sharding.place(documents(spark), "doc_id")
    sharding.write_shards(placed, f"{tmp_dir}/shards", files_per_shard=2)
    assert spark.read.parquet(f"{tmp_dir}/shards").count() == placed.count()


def test_mix_meets_its_targets_and_its_report(spark):
    docs = documents(spark, MIDDLE)
    report = mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    by_source = defaultdict(list)
    for r in report:
        by_source[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    total = sum(r.size for r in report)
    goal = 0
    for rows in by_source.values():
        assert sum(r.taken for r in rows) == int(rows[0].target) <= 2 * rows[0].source_size
        assert rows[0].source_size == sum(r.size for r in rows)
        goal += rows[0].target
    assert abs(goal - 1.5 * total) < 1e-3 * total
    mixed = mixing.mix(docs).select("doc_id", F.expr("size(split(trim(text), '[ \\n\\t]+'))").alias("n"))
    words = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    assert words == {r.doc_id: r.taken for r in report if r.taken}
    assert sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect())) == sorted(
        (r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in report)


def test_toxic_terms_of_fixed_phrases_are_learned_and_copied_passages_not(spark):
    rng = random.Random(1)
    say = lambda n: [rng.choice(WORDS_PLAIN) for _ in range(n)]
    passage = [f"passage{chr(97 + i)}" for i in range(9)]
    rows = []
    for i in range(200):
        own = ["you", "gribbo"] if i % 2 else ["shut", "up", "you", "fool"]
        rows.append((1, " ".join([*say(9 if i % 5 else 0), *own, *say(9 if i % 3 else 0)])))
        rows.append((1, " ".join([*say(7), *passage, *say(7)])))
        rows.append((1, "the very same copied insult blarg"))
        rows += [(0, " ".join([*say(9), "shut", "up", "you", *say(9)]))] * 3
    picked = spark.createDataFrame(rows, "y int, text string").selectExpr("y", "cast(text as binary) as text")
    terms, _ = toxicity.lexicon(picked, 600, 600)
    assert {"gribbo", "fool"} <= set(terms)
    assert not {"blarg", "shut", *passage} & set(terms)


WORDS_PLAIN = [a + b + c for a in "bdfg" for b in ("ala", "ore", "uni", "eki") for c in ("ma", "so", "ti", "lu")]


def test_key_buckets_are_small_for_every_weight(spark):
    rows = spark.range(20000).crossJoin(spark.createDataFrame([(w,) for w in (0.05, 0.07, 0.2, 0.6, 1.0)], "w double"))
    keyed = rows.withColumn("key", mixing.sampling_key(F.col("id"), F.col("w")))
    keyed = keyed.withColumn("bucket", mixing.bucket_of(F.col("key")))
    assert keyed.groupBy("w", "bucket").count().agg(F.max("count")).first()[0] <= 20000 * 0.01
    got = [r.bucket for r in keyed.orderBy("key").collect()]
    assert got == sorted(got) and got[0] >= 0 and got[-1] < mixing.BUCKETS


# --- HTML

def test_article_pages(spark):
    import html
    import re
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip()
                  for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (got[p.page_id].text, got[p.page_id].n_chars) == (want, len(want))


def test_blocks():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><nav><ul><li>A<li>B</ul></nav>
    </header><div class="cookie-notice">We use cookies</div><main><header><h1>Head&nbsp;line</h1></header>
    <p>One <b>bold</b> text<br>next   line &lt;ok&gt;<p>Two<script>var a="</p><p>no";</script> more<aside>side</aside>
    <div class="ad">buy</div><form>Search<button>Go</button></form><ul><li>x<li>y</ul><!-- <p>zz --></main>
    <section id="comments"><article><p>nice!</p></article></section><footer>&copy; z</footer></body></html>"""
    assert [t for role, t in html_extract.blocks_of(page) if role == html_extract.MAIN_ROLE] == [
        "Head line", "One bold text next line <ok>", "Two more", "x", "y"]
    assert html_extract.blocks_of("a &amp; b <p>c < d") == [(0, "a & b"), (0, "c < d")]


@pytest.mark.parametrize("page", [
    '<div class="layout-with-sidebar"><article><p>Story</p></article><div class="sidebar">x</div></div>',
    '<div class="no-sidebar"><div id="has-nav"><main>Story</main></div></div>',
    '<div class="page-share"><div itemprop="articleBody">Story</div></div>',
    '<div class="content related-on"><article>Story</article></div>',
    '<div class="content related"><main>Story</main></div>',
    '<div class="page-with-sidebar" role="main">Story</div>',
    '<form action="/x"><div>menu</div><article><p>Story</p><form>Search</form></article></form>',
    '<form><div class="layout-with-sidebar"><div class="entry-content">Story</div></div></form>',
    '<nav><ul><li>Home<li>News<article>Story</article>',
    '<div><aside>Ad <div>x<main><p>Story</p></main><aside>y</aside></div>',
    '<nav>A <a href="/">b</a><article>Story</article><nav>B</nav><aside><article>other</article></aside>',
    '<div class="sidebar"><article>Other</article></div><main>Story</main>',
    '<aside><article>Other</article></aside><article class="has-ads">Story</article>',
    '<article>Story<div class="sidebar">x<article>Other</article></div></article>',
])
def test_main_elements_inside_chrome(page):
    found = html_extract.blocks_of(page)
    assert [t for role, t in found if role == html_extract.MAIN_ROLE] == ["Story"]
    assert all(role in (html_extract.CHROME_ROLE, html_extract.OPEN) for role, t in found if t != "Story")


@pytest.mark.parametrize("page, want", [
    ('<div class="sidebar-left"><article>A</article></div><div>B</div>', ["A", "B"]),
    ('<div>B</div><div id="comments"><article>nice</article></div>', ["B"]),
    ('<div class="related"><article>A</article></div><nav>x</nav>', ["A"]),
    ('<div class="widget">x</div><div>B</div>', ["B"]),
])
def test_articles_in_chrome_without_other_main_text(page, want):
    assert [t for role, t in html_extract.blocks_of(page) if role == html_extract.OPEN] == want


def test_suffix_array_orders_and_groups():
    rng = np.random.default_rng(0)
    ranks = rng.integers(0, 3, 300)
    order, same = html_extract.repeat_starts(ranks, 5)
    heads = [tuple(ranks[i:i + 5]) for i in order]
    assert heads == sorted(heads) and same.tolist() == [i > 0 and heads[i] == heads[i - 1] for i in range(300)]


@pytest.mark.parametrize("chunk", [500, 25_000])
def test_pages_without_main_element_keep_unique_runs(spark, chunk):
    rng = random.Random(0)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    boiler, tail, rows, want = say(15), say(12), [], {}
    for i in range(120):
        a, b = say(30), say(25)
        want[i] = f"{a}\n{b}"
        rows.append((i, f"http://h{0 if i < 90 else i % 4}.org/{i}",
                     f"<body><div>{boiler}</div><div><p>{a}</p><p>{b}</p></div><div>{tail} page</div></body>"))
    lone = say(20)
    rows.append((500, "http://alone.org", f"<div>{lone}</div><div>{boiler}</div>"))
    want[500] = f"{lone}\n{boiler}"  # nothing repeats on its host
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(pages, chunk).collect()} == want


@pytest.mark.parametrize("chunk", [300, 25_000])
def test_short_unique_runs_beside_long_repeats_are_kept(spark, chunk):
    passage = " ".join(f"s{i}" for i in range(100))
    own = {i: " ".join(f"own{i}x{k}" for k in range(40)) for i in range(6)} | {6: "one", 7: ""}
    rows = [(i, "http://h.org/", f"<div>{passage} {t}</div><div>{passage}</div>") for i, t in own.items()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(pages, chunk).collect()} == own


def test_pages_with_equal_sides_are_one_row_of_the_chunks(spark, monkeypatch):
    """Copies of a template, of whole pages and of a text with another cut into
    blocks: each stream is in the chunks once, every row gets its own text."""
    shared, own = " ".join(f"s{i}" for i in range(12)), [" ".join(f"own{i}x{k}" for k in range(8)) for i in range(3)]
    rows = [(i, "http://h.org/", f"<div>{shared}</div><article>a {i}</article>") for i in range(400)]
    rows += [(1000 + i, "http://h.org/", f"<div>{shared}</div><div>{own[0]}</div>") for i in range(300)]
    rows += [(2000 + i, "http://h.org/", f"<div>{shared} {own[0]}</div>") for i in range(5)]
    rows += [(3000 + i, "http://h.org/", f"<div>{own[i]}</div><div>{shared}</div>") for i in (1, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sides = pages.mapInArrow(html_extract._sides, html_extract._SIDES)
    assert sides.count() == len(rows)
    assert sorted(r.n_tokens for r in html_extract.distinct_streams(sides).collect()) == [12, 20, 20, 20, 20]
    monkeypatch.setattr(html_extract, "COPIES", 7)
    got = html_extract.extract(pages, 30).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got} == {
        i: f"a {i}" if i < 1000 else own[0] if i < 3000 else own[i - 3000] for i, _, _ in rows}


# --- pipeline

def test_pipeline_against_its_parts(spark):
    docs, labels = documents(spark, MIDDLE), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    items = [decontaminate.words_of((r.text or "").encode()) for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
    good = {r.doc_id for r in quality.scores(docs, labels).collect() if r.score >= quality.THRESHOLD}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    classes = plain_classes([(i, plain_fingerprint(t)) for i, t in sorted(texts.items())])
    kept = {i for i, c in classes.items() if i == c}

    def clean(text):
        w = decontaminate.words_of(text.encode())
        return not any(tuple(w[i:i + m]) in windows for m in {len(x) for x in windows} for i in range(len(w) - m + 1))

    kept = {i for i in kept if clean(texts[i])}
    mixed = {r.doc_id: r.taken for r in mixing.mix_report(docs.filter(F.col("doc_id").isin(sorted(kept)))).collect()}
    out = corpus_pipeline.run(spark, MIDDLE).collect()
    words = Counter()
    for r in out:
        words[r.doc_id] += len((r.text or "").encode().split())
    assert dict(words) == {i: n for i, n in mixed.items() if n}
    table = sharding.lookup_table(sharding.shard_names(sharding.N_SHARDS), 1601)
    for r in out:
        assert r.shard == table[int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 1601]
