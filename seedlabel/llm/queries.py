"""The registered queries of this subpackage and their SQL twins (DuckDB)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seedlabel.llm import (collocations, conversation_trie, decontaminate, exact_dedup, html_extract, mixing, packing,
                           quality, sharding, simhash, substrings, token_counts, toxicity)
from seedlabel.session import load_table

#: White-space class of the contracts, as a DuckDB pattern.
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(load_table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.scores(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(load_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact de-duplication of ``documents`` by Patricia-trie owners."""
    return exact_dedup.exact_duplicates(load_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the byte-level BPE of 50k entries."""
    return token_counts.token_counts(load_table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the factorisation machine."""
    return quality.scores(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in an occurrence of a benchmark window."""
    return decontaminate.contamination(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages that repeat elsewhere."""
    docs = load_table(spark, sf_dir, "documents")
    return substrings.remove_repeats(docs, with_text=False).drop("kept_text")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document by the permutation-filled look-up table."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id").select("doc_id", "shard_slot", "shard", "shard_name")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_report(load_table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 1024 tokens."""
    return packing.pack(load_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        with_ids=False)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best phrases of two to four words of every language."""
    return collocations.collocations(load_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie over the rebuilt conversations."""
    return conversation_trie.rebuilt_trie(load_table(spark, sf_dir, "conversations"))


SQL4 = f"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def sharding_sql(n: int = sharding.N_SHARDS) -> str:
    """The look-up table filled by a recursive query, one turn per step."""
    slots = sharding.next_prime(sharding.SLOTS_PER_SHARD * n)
    digest = "('0x' || substr(md5(name || '{}'), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE shards AS (
  SELECT i, name, {digest.format(':offset')} % {slots} AS off, {digest.format(':step')} % {slots - 1} + 1 AS step
  FROM (SELECT i, 'shard-' || lpad(i::VARCHAR, 5, '0') AS name FROM range({n}) t(i))),
prefs AS (SELECT i, list((off + j * step) % {slots} ORDER BY j) AS pref FROM shards, range({slots}) s(j) GROUP BY i),
fill(turn, taken, slot) AS (
  SELECT 0::BIGINT, [false FOR x IN range({slots})], -1::BIGINT
  UNION ALL
  SELECT turn + 1, [taken[x + 1] OR x = s FOR x IN range({slots})], s
  FROM (SELECT f.turn, f.taken, list_filter(p.pref, lambda y: NOT f.taken[y + 1])[1] AS s
        FROM fill f JOIN prefs p ON p.i = f.turn % {n} WHERE f.turn < {slots})),
owner AS (SELECT slot, ((turn - 1) % {n})::INTEGER AS shard FROM fill WHERE turn > 0)
SELECT d.doc_id, o.slot::INTEGER AS shard_slot, o.shard, s.name AS shard_name
FROM documents d
JOIN owner o ON o.slot = ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT % {slots}
JOIN shards s ON s.i = o.shard
"""


#: Words of the decontamination contract (A-Z lower-cased first).
_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')," \
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least({decontaminate.WINDOW}, len(w)) AS m,
         array_to_string(w[i:i + least({decontaminate.WINDOW}, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least({decontaminate.WINDOW}, len(w)) + 2)) t(i) WHERE len(w) > 0),
l AS (SELECT DISTINCT m FROM p),
o AS (
  SELECT r, i, l.m, array_to_string(w[i:i + l.m - 1], ' ') AS g
  FROM d, l, unnest(range(1, len(w) - l.m + 2)) t(i)),
h AS (SELECT o.r, o.i, o.m, p.item_id FROM o JOIN p ON o.g = p.g AND o.m = p.m),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM h, unnest(range(i, i + m)) t(x) GROUP BY r),
n AS (SELECT r, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN n ON n.r = d.r
"""


SQL8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
v AS (SELECT r, i, md5(array_to_string(w[i:i + {substrings.WINDOW - 1}], ' ')) AS g
      FROM d, unnest(range(1, len(w) - {substrings.WINDOW - 2})) t(i)),
x AS (SELECT g FROM v GROUP BY g HAVING count(*) > 1),
h AS (SELECT DISTINCT r, j FROM (SELECT v.r, v.i FROM v JOIN x ON v.g = x.g) q, unnest(range(i, i + {substrings.WINDOW})) t(j)),
l AS (SELECT d.r, u.j, d.w[u.j] AS word FROM d, unnest(range(1, len(d.w) + 1)) u(j)),
k AS (SELECT l.r, count(*) AS n_kept, string_agg(l.word, ' ' ORDER BY l.j) AS kept
      FROM l LEFT JOIN h ON h.r = l.r AND h.j = l.j WHERE h.j IS NULL GROUP BY l.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r
"""


SQL10 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS size,
         md5(coalesce(text, '')) AS tie,
         -ln((('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT + 0.5::DOUBLE)
             / {float(1 << 60)!r}::DOUBLE)
         / greatest(0.05::DOUBLE, 1.0::DOUBLE - 5.0::DOUBLE
                    * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{mixing.NOISE}', '')))
                    / greatest(length(coalesce(text, '')), 1)) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, {float(mixing.MAX_EPOCHS)!r}::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, row_number() OVER o AS place,
         ({mixing.SHARE!r}::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
t AS (
  SELECT source, source_size,
         least(cap, w * (SELECT level FROM l WHERE w * level <= cap ORDER BY place LIMIT 1)) AS target FROM l),
e AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, tie
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS prior
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + least(size, greatest(0, floor(target) - epochs * source_size - prior)))::BIGINT AS taken
FROM e
"""

SQL12 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM w, range(1, 5) s(k), unnest(range(1, len(w) - k + 2)) u(i)),
f AS (SELECT lang, k AS size, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT *, f AS a FROM f WHERE size >= 2),
x AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS score
  FROM c, unnest(range(1, size)) s(k)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM c, unnest(range(2, size)) s(k), unnest(range(1, size - k + 2)) u(i) GROUP BY 1, 2),
q AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.phrase)) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * b.a)
SELECT q.lang, rank, q.phrase, q.a, q.l, q.r, t.n, q.score::BIGINT AS score
FROM q JOIN t ON t.lang = q.lang WHERE rank <= 2000
"""

#: DuckDB has no crc32: eight shift steps for every byte of the decimal id.
_CRC32 = """xor(list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')],
  lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT FOR i IN range(8)],
                           lambda x, y: xor(x // 2, 3988292384::BIGINT * (x % 2)))), 4294967295::BIGINT)"""

SQL13 = f"""
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, turn, length(coalesce(text, '')) AS n,
         md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, list({{'d': d, 'n': n}} ORDER BY turn NULLS FIRST, role, d) AS t FROM o GROUP BY c),
h AS (SELECT c, t, {_CRC32} % 6 AS h FROM v),
r AS (SELECT h.c, coalesce(b.t[1:h.h], []) || h.t[h.h + 1:] AS t FROM h LEFT JOIN v b ON b.c = h.c - h.c % 100),
m AS (
  SELECT c, d, md5(array_to_string([x.d FOR x IN t[1:d]], ',')) AS q,
         CASE WHEN d > 0 THEN md5(array_to_string([x.d FOR x IN t[1:d - 1]], ',')) END AS up,
         CASE WHEN d > 0 THEN t[d].n ELSE 0 END AS n, d = len(t) AS ends
  FROM r, unnest(range(0, len(t) + 1)) s(d)),
g AS (
  SELECT d, q, min(c) AS c, count(*) AS n_convs, any_value(up) AS up, any_value(n) AS n,
         sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM m GROUP BY d, q),
k AS (SELECT d - 1 AS d, up AS q, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT g.*, coalesce(k.n_children, 0) AS n_children FROM g LEFT JOIN k ON k.d = g.d AND k.q = g.q),
s AS (
  SELECT m.d, m.q, sum((f.n_children = 0)::INTEGER) AS n_leaves, sum((f.n_convs - 1) * f.n) AS saved_tokens
  FROM f JOIN m ON m.c = f.c AND m.d <= f.d GROUP BY m.d, m.q)
SELECT f.c AS conv_id, f.d AS depth, p.c AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.d = f.d AND s.q = f.q LEFT JOIN f p ON p.d = f.d - 1 AND p.q = f.up
"""

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_toxicity": op2_toxicity,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
    "op11_packing": op11_packing,
    "op12_collocations": op12_collocations,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLE = {"op4_exact_dedup": SQL4, "op7_decontamination": SQL7, "op8_substring_dedup": SQL8, "op9_sharding": sharding_sql(),
          "op10_mixing": SQL10, "op12_collocations": SQL12, "op13_conversation_trie": SQL13}
