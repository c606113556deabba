"""User-level labelers over a text corpus and a gold set.

A :class:`Domain` holds what the reference keeps in its domain configuration
(class lists -- their order is the label encoding --, seed words, seed
sentences, thresholds, vocabulary parameters).  Each labeler is built from a
corpus of sentences, labels it (DataFrame of confident rows) and can score
any other sentence table the same way (for the gold set).  The sentence
"encoder" is the bag of words of the lower-cased sentence; a table of
precomputed embeddings can be scored with :mod:`seedlabel.operators.prototypes`
instead.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedlabel.functions.bag_udf import bag_scores
from seedlabel.functions.bags import bag_weights
from seedlabel.functions.text import PUNCTUATION, tokens
from seedlabel.operators import keywords as KW
from seedlabel.operators import metrics
from seedlabel.operators import representatives as R
from seedlabel.operators import thresholds as TH
from seedlabel.operators import vocabulary as V
from seedlabel.operators.sentences import split_sentences

KINDS = ("aspect", "polarity")


@dataclass
class Domain:
    name: str
    aspects: list[str]
    polarities: list[str]
    aspect_seeds: dict[str, list[str]]
    polarity_seeds: dict[str, list[str]]
    aspect_seed_sentences: dict[str, list[str]] | None = None
    polarity_seed_sentences: dict[str, list[str]] | None = None
    cat_threshold: float = 0.6
    pol_threshold: float = 0.4
    relax: dict[int, float] = field(default_factory=dict)   # polarity class -> threshold lowering
    n_representatives: int = 5
    vocab_size: int = 100
    k1: int = 10
    k2: int = 30
    lam: float = 0.5
    filter_words: list[str] = field(default_factory=lambda: list(PUNCTUATION))
    aspect_lexicon: list[str] | None = None
    opinion_lexicon: list[str] | None = None

    def classes(self, kind: str) -> list[str]:
        return self.aspects if kind == "aspect" else self.polarities

    def seed_words(self, kind: str, raw: bool = False) -> list[list[str]]:
        """Seed words per class in class order; trimmed unless ``raw`` (a seed
        with a trailing blank never equals a token)."""
        m = self.aspect_seeds if kind == "aspect" else self.polarity_seeds
        return [[w if raw else w.strip() for w in m.get(c, [])] for c in self.classes(kind)]

    def seed_sentences(self, kind: str) -> list[list[str]]:
        """Seed sentences per class; without explicit ones, every entry of the
        seed mapping is used as a (possibly one-word) seed sentence."""
        m = self.aspect_seed_sentences if kind == "aspect" else self.polarity_seed_sentences
        if not m:
            m = self.aspect_seeds if kind == "aspect" else self.polarity_seeds
        return [list(m.get(c, [])) for c in self.classes(kind)]

    def thresholds(self) -> dict[str, float]:
        return {"aspect_score": self.cat_threshold, "polarity_score": self.pol_threshold}

    @classmethod
    def from_mapping(cls, d: dict) -> "Domain":
        """Accepts the reference's configuration key names as well."""
        g = lambda *ks, default=None: next((d[k] for k in ks if k in d), default)
        return cls(
            name=g("name", default="domain"),
            aspects=list(g("aspects", "aspect_category_mapper")),
            polarities=list(g("polarities", "sentiment_category_mapper")),
            aspect_seeds=dict(g("aspect_seeds", "aspect_seed_mapper", default={})),
            polarity_seeds=dict(g("polarity_seeds", "sentiment_seed_mapper", default={})),
            aspect_seed_sentences=g("aspect_seed_sentences", "aspect_seed_sentence_mapper"),
            polarity_seed_sentences=g("polarity_seed_sentences", "sentiment_seed_sentences",
                                      "sentiment_seed_sentence_mapper"),
            cat_threshold=float(g("cat_threshold", default=0.6)),
            pol_threshold=float(g("pol_threshold", default=0.4)),
            relax={int(k): float(v) for k, v in (g("relax", default={}) or {}).items()},
            n_representatives=int(g("n_representatives", "N", default=5)),
            vocab_size=int(g("vocab_size", "M", default=100)),
            k1=int(g("k1", "K_1", default=10)), k2=int(g("k2", "K_2", default=30)),
            lam=float(g("lam", "lambda_threshold", default=0.5)),
            filter_words=list(g("filter_words", default=PUNCTUATION)),
            aspect_lexicon=g("aspect_lexicon"), opinion_lexicon=g("opinion_lexicon"),
        )

    @classmethod
    def from_file(cls, path: str) -> "Domain":
        text = open(path, encoding="utf-8").read()
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:  # pragma: no cover
                raise RuntimeError("YAML domain files need PyYAML; use JSON") from e
            return cls.from_mapping(yaml.safe_load(text))
        return cls.from_mapping(json.loads(text))


def corpus_sentences(lines: DataFrame, id_col: str = "line_id", text_col: str = "text") -> DataFrame:
    """Corpus lines -> ``(line_id, pos, sentence, tokens)`` (split, lower-cased)."""
    s = split_sentences(lines, id_col, text_col)
    return s.select(F.col(id_col).alias("line_id"), "pos", "sentence", tokens("sentence").alias("tokens"))


def gold_sentences(gold: DataFrame) -> DataFrame:
    """Gold rows ``(id, aspect, polarity, sentence)`` with lower-cased tokens."""
    return gold.withColumn("tokens", tokens(F.lower("sentence")))


def _bag(text: str) -> dict[str, float]:
    return bag_weights(text.lower().split())


def _mean_bag(bags: list[dict[str, float]]) -> dict[str, float]:
    out: dict[str, float] = {}
    for b in bags:
        for w, v in b.items():
            out[w] = out.get(w, 0.0) + v
    return {w: v / len(bags) for w, v in out.items()} if bags else {}


class BagLabeler:
    """Scores sentences against per-class prototype bags, for both kinds."""

    def __init__(self, domain: Domain, class_bags: dict[str, list[list[dict[str, float]]]]):
        self.domain = domain
        self.class_bags = class_bags

    def score(self, df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
        out = df
        for kind in KINDS:
            bags, groups = [], []
            for cb in self.class_bags[kind]:
                groups.append(list(range(len(bags), len(bags) + len(cb))))
                bags.extend(cb)
            sc = f"{kind}_scores"
            out = out.withColumn(sc, bag_scores(bags, groups)(F.col(tokens_col)))
            out = (out.withColumn(kind, (F.array_position(sc, F.array_max(sc)) - 1).cast("int"))
                   .withColumn(f"{kind}_score", F.array_max(sc)))
        return out

    def label(self, sentences: DataFrame) -> DataFrame:
        s = self.score(sentences)
        if self.domain.relax:
            return TH.keep_confident_relaxed(s, self.domain.thresholds(), "polarity", self.domain.relax)
        return TH.keep_confident(s, self.domain.thresholds())


def seed_sentence_labeler(domain: Domain) -> BagLabeler:
    """Prototypes: every seed sentence plus the mean of the class's seed sentences."""
    cb = {}
    for kind in KINDS:
        per = []
        for sents in domain.seed_sentences(kind):
            bags = [_bag(s) for s in sents]
            per.append(bags + ([_mean_bag(bags)] if bags else []))
        cb[kind] = per
    return BagLabeler(domain, cb)


def seed_word_labeler(domain: Domain, sentences: DataFrame | None = None, two_step: bool = True) -> BagLabeler:
    """One step: one prototype per class, its seed words joined into one text.
    Two steps: representative sentences of the corpus (greedy over the
    one-step ranking), their mean, and each seed's nearest sentence."""
    one = {kind: [[bag_weights(words)] if words else [] for words in domain.seed_words(kind)] for kind in KINDS}
    if not two_step:
        return BagLabeler(domain, one)
    if sentences is None:
        raise ValueError("the two-step labeler needs the corpus sentences")
    # read by the candidate and nearest-sentence jobs of both kinds: split once
    sent = sentences.select(F.col("line_id").alias("doc_id"), "pos", "sentence", "tokens",
                            F.size("tokens").alias("n_words")).checkpoint(eager=True)
    cb = {}
    for kind in KINDS:
        raw = domain.seed_words(kind, raw=True)
        trimmed = domain.seed_words(kind)
        scored = sent.withColumn("scores", bag_scores([b[0] if b else {} for b in one[kind]])(F.col("tokens")))
        reps = R.representatives(R.class_rows(scored, raw), raw, domain.n_representatives)
        near = R.nearest_to_seeds(sent, trimmed, keep=("sentence",))
        # bounded by classes x (N + 1 + seeds) rows; one job collects both
        both = (reps.select(F.lit("rep").alias("k"), "cls", "sentence")
                .unionByName(near.select(F.lit("near").alias("k"), "cls", "sentence")).collect())
        rep_rows = [(r.cls, r.sentence) for r in both if r.k == "rep"]
        near_rows = [(r.cls, r.sentence) for r in both if r.k == "near"]
        cb[kind] = R.prototype_bags(rep_rows, near_rows, len(domain.classes(kind)))
    return BagLabeler(domain, cb)


class VocabularyLabeler:
    """Substitutes -> class vocabularies -> overlap scores -> z-scores, per kind,
    with the statistics of the training corpus reused for any scored table."""

    def __init__(self, spark: SparkSession, domain: Domain, sentences: DataFrame):
        self.spark, self.domain = spark, domain
        # fillers, seed occurrences of both kinds and the scores all read the
        # sentences: split once and cut the lineage
        sentences = sentences.checkpoint(eager=True)
        positions = V.token_positions(sentences, ["line_id", "pos"])
        subs = V.substitutes(V.context_fillers(positions), max(domain.k1, domain.k2)).checkpoint(eager=True)
        self.hits, self.vocab = {}, {}
        for kind in KINDS:
            seeds = domain.seed_words(kind)
            vocab = V.class_vocabulary(positions, subs.filter(F.col("rank") <= domain.k1),
                                       V.seed_table(spark, seeds), domain.filter_words,
                                       n_seeds=sum(len(s) for s in seeds))
            dv = V.disjoint_vocabulary(vocab, domain.vocab_size).checkpoint(eager=True)
            self.vocab[kind] = dv
            self.hits[kind] = V.context_class_hits(subs.filter(F.col("rank") <= domain.k2), dv, domain.filter_words,
                                                   vocab_bound=len(domain.classes(kind)) * domain.vocab_size)
        self.train_scores = self._scores(sentences, ["line_id", "pos"]).checkpoint(eager=True)
        self.stats = {k: V.class_score_stats(self.train_scores, f"{k}_scores") for k in KINDS}

    def _scores(self, df: DataFrame, ids) -> DataFrame:
        keep = [c for c in ("sentence",) if c in df.columns]
        out = df.select(*ids, *keep, "tokens")
        for kind, lex in (("aspect", self.domain.aspect_lexicon), ("polarity", self.domain.opinion_lexicon)):
            s = V.overlap_scores(df, ids, self.hits[kind], len(self.domain.classes(kind)), self.domain.filter_words,
                                 lexicon=lex)
            out = out.join(s.select(*ids, F.col("scores").alias(f"{kind}_scores")), ids)
        return out

    def _z(self, scores: DataFrame) -> DataFrame:
        for kind in KINDS:
            scores = V.zscores(scores, self.stats[kind], f"{kind}_scores", f"{kind}_z",
                               n_classes=len(self.domain.classes(kind)))
        return scores

    def label(self) -> DataFrame:
        """Rows with exactly one class at z >= lambda in both kinds."""
        z = self._z(self.train_scores)
        for kind in KINDS:
            z = V.zscore_labels(z, self.domain.lam, f"{kind}_z", kind, n_classes=len(self.domain.classes(kind)))
        return z

    def score(self, df: DataFrame, ids=("id",)) -> DataFrame:
        """Forced labels (highest z per kind) for another table, e.g. the gold set."""
        z = self._z(self._scores(df, list(ids)))
        for kind in KINDS:
            z = V.zscore_forced(z, f"{kind}_z", kind).drop("z_best")
        return z


def keyword_labels(lines: DataFrame, domain: Domain, text_col: str = "text") -> DataFrame:
    """Whole lines, case-sensitive tokens, seeds of exactly one aspect class."""
    t = lines.withColumn("tokens", tokens(F.col(text_col)))
    return KW.keyword_labels(t, "tokens", domain.seed_words("aspect"), "aspect")


def evaluate(gold: DataFrame, scored: DataFrame, domain: Domain, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Join gold and predictions on the id: (prediction table with class
    names, report per kind)."""
    j = gold.select(id_col, "sentence", F.col("aspect").alias("actual_aspect"),
                    F.col("polarity").alias("actual_polarity")) \
        .join(scored.select(id_col, F.col("aspect").alias("predicted_aspect"),
                            F.col("polarity").alias("predicted_polarity")), id_col)
    long = j.select(F.inline(F.array(
        F.struct(F.lit("aspect").alias("kind"), F.col("actual_aspect").alias("actual"),
                 F.col("predicted_aspect").alias("pred")),
        F.struct(F.lit("polarity").alias("kind"), F.col("actual_polarity").alias("actual"),
                 F.col("predicted_polarity").alias("pred")))))
    report = metrics.classification_report(long, "actual", "pred", ["kind"])
    table = j.select(id_col, "sentence",
                     KW.decode_labels("actual_aspect", domain.aspects).alias("actual category"),
                     KW.decode_labels("predicted_aspect", domain.aspects).alias("predicted category"),
                     KW.decode_labels("actual_polarity", domain.polarities).alias("actual polarity"),
                     KW.decode_labels("predicted_polarity", domain.polarities).alias("predicted polarity"))
    return table, report


def prepare_review_corpus(spark: SparkSession, csv_path: str, out_path: str, id_col: str = "restoId") -> DataFrame:
    """Review export -> corpus files per split: read (decimal-comma scores,
    bytes-literal texts decoded, lower-cased and word-tokenised), drop empty
    texts, hash-uniform train/dev/weak split by the review's content, one text
    folder per split.  Returns the split sizes (one row per split)."""
    from seedlabel.operators import splits as SP
    from seedlabel.sources import readers, writers
    reviews = readers.read_review_csv(spark, csv_path)
    # the content decides the split and its order, whatever the files' layout; the
    # row number only tells equal reviews apart
    content = F.md5(F.concat_ws("\t", id_col, F.col("score").cast("string"), "text"))
    reviews = (reviews.filter(F.length("text") > 0).withColumn("_content", content)
               .withColumn("review_id", F.concat_ws(":", "_content", F.monotonically_increasing_id().cast("string"))))
    reviews = reviews.checkpoint(eager=True)       # ids fixed before they are used as keys
    parts = SP.corpus_split(reviews.select("review_id", SP.hash_uniform("_content").alias("u")), "review_id")
    writers.write_corpus_splits(reviews, parts, "review_id", out_path)
    return spark.read.text(out_path).groupBy("split").count()
