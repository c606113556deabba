"""Seed prototypes and dense prototype scoring (seed-sentence labeler core).

Plan shape: the scored table is read once and scored map-side; the only data
shipped to tasks are prototype matrices of (classes x seeds-per-class +
classes) x dim numbers, in chunks of at most MAX_PROTOTYPE_CELLS whose class
maxima are merged.  No join, no shuffle of the big side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedlabel.functions.vectors import multi_set_scorer_udf

# Largest prototype matrix (rows x dim doubles) of one scoring function: 32 MiB.
MAX_PROTOTYPE_CELLS = 4 * 1024 * 1024


def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int, rank_col: str | None = None) -> DataFrame:
    """Rows ranked ``<= k`` within each group.

    ``row_number() <= k`` is planned with a partial WindowGroupLimit before
    the shuffle, so at most k rows per group per input partition move, even
    when one group holds a large share of the table.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    rc = rank_col or "_rank"
    out = df.withColumn(rc, F.row_number().over(w)).filter(F.col(rc) <= k)
    return out if rank_col else out.drop(rc)


def seed_rows(df: DataFrame, class_col: str, id_col: str, k: int) -> DataFrame:
    """The k lowest ids of each class serve as that class's seed examples."""
    return top_k_per_group(df, [class_col], [F.col(id_col)], k, rank_col="seed_pos")


def mean_vectors(df: DataFrame, key_cols, vec_col: str, out_col: str = "vec") -> DataFrame:
    """Element-wise mean of the vectors of each key (not normalised), in double.

    Distributed as posexplode -> groupBy(key, i).avg -> re-assemble; the
    re-assembly gathers one vector (dim numbers) per key.
    """
    keys = list(key_cols)
    exploded = df.select(*keys, F.posexplode(vec_col).alias("_i", "_x"))
    per_dim = exploded.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return (per_dim.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_s"))
            .select(*keys, F.col("_s._m").alias(out_col)))


def prototypes(seeds: DataFrame, class_col: str, vec_col: str, id_col: str) -> DataFrame:
    """Prototype table ``(cls, proto_id, vec array<double>)``: every seed vector
    plus the mean of the class's seeds (``proto_id = -1``)."""
    own = seeds.select(F.col(class_col).cast("int").alias("cls"), F.col(id_col).cast("long").alias("proto_id"),
                       F.col(vec_col).cast("array<double>").alias("vec"))
    mean = (mean_vectors(seeds.select(F.col(class_col).cast("int").alias("cls"), vec_col), ["cls"], vec_col)
            .select("cls", F.lit(-1).cast("long").alias("proto_id"), "vec"))
    return own.unionByName(mean)


@dataclass
class PrototypeSet:
    """A collected, size-checked prototype matrix for one kind of label."""
    name: str
    matrix: np.ndarray
    classes: np.ndarray
    n_classes: int
    proto_ids: np.ndarray


def _prototype_set(name: str, rows: list, n_classes: int | None = None) -> PrototypeSet:
    dim = len(rows[0]["vec"]) if rows else 0
    matrix = np.array([r["vec"] for r in rows], dtype=np.float64).reshape(len(rows), dim)
    classes = np.array([r["cls"] for r in rows], dtype=np.int64)
    ids = np.array([r["proto_id"] for r in rows], dtype=np.int64)
    k = n_classes if n_classes is not None else (int(classes.max()) + 1 if len(classes) else 0)
    return PrototypeSet(name, matrix, classes, k, ids)


def collect_prototypes(name: str, protos: DataFrame, n_classes: int | None = None) -> PrototypeSet:
    """Bring a prototype table (classes x seeds rows) to the driver, in one job."""
    return _prototype_set(name, protos.orderBy("cls", "proto_id").collect(), n_classes)


def seed_prototype_sets(df: DataFrame, class_cols: dict[str, str], id_col: str, vec_col: str, k: int,
                        runs: int = 1) -> dict[str, list[PrototypeSet]]:
    """For each kind (name -> class column) the prototype sets of ``runs`` seed
    draws: run r takes the (k r + 1)-th to (k r + k)-th lowest ids of a class;
    its prototypes are the seeds' vectors and their mean (``proto_id = -1``).

    One scan of the class and id columns finds the seed ids of all kinds (a
    bounded top-k per class); one fetch with the ids pushed down to the scan
    reads their vectors."""
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(c).cast("int").alias("cls"))
                      for n, c in class_cols.items()])
    ids = df.select(F.col(id_col).alias("id"), F.inline(kinds)).filter("cls is not null")
    seeds = top_k_per_group(ids, ["kind", "cls"], ["id"], k * runs, rank_col="rk").collect()
    wanted = sorted({r.id for r in seeds})
    vecs = {r.id: np.array(r.v, dtype=np.float64) for r in
            df.filter(F.col(id_col).isin(wanted)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).collect()}
    out: dict[str, list[PrototypeSet]] = {}
    for kind in class_cols:
        for run in range(runs):
            rows = []
            own = [r for r in seeds if r.kind == kind and (r.rk - 1) // k == run]
            for cls in sorted({r.cls for r in own}):
                mine = [(r.id, vecs[r.id]) for r in own if r.cls == cls and r.id in vecs]
                rows.append({"cls": cls, "proto_id": -1, "vec": np.mean([v for _, v in mine], axis=0)})
                rows += [{"cls": cls, "proto_id": i, "vec": v} for i, v in sorted(mine, key=lambda x: x[0])]
            out.setdefault(kind, []).append(_prototype_set(kind if runs == 1 else f"{kind}_r{run}", rows))
    return out


def _chunks(kind: PrototypeSet, cells: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    step = max(1, cells // max(kind.matrix.shape[1], 1))
    return [(kind.matrix[i:i + step], kind.classes[i:i + step], kind.n_classes)
            for i in range(0, max(len(kind.matrix), 1), step)]


def score_with_prototypes(df: DataFrame, vec_col: str, kinds: list[PrototypeSet],
                          keep_scores: bool = False, max_cells: int = MAX_PROTOTYPE_CELLS) -> DataFrame:
    """Add ``{kind}`` (argmax class) and ``{kind}_score`` (its max cosine) per kind.

    Each row's vector is compared with every prototype of every class; the
    class score is the max over its prototypes and the label the best class
    (lowest index on ties).  Prototypes beyond ``max_cells`` numbers are scored
    chunk by chunk and the class maxima merged.  A null vector gets nulls.
    """
    total = sum(k.matrix.size for k in kinds)
    if total <= max_cells:
        udf = multi_set_scorer_udf([(k.matrix, k.classes, k.n_classes) for k in kinds], keep_scores)
        out = df.withColumn("_ps", udf(F.col(vec_col)))
        cols = []
        for j, k in enumerate(kinds):
            cols += [F.col("_ps.cls")[j].alias(k.name), F.col("_ps.score")[j].alias(f"{k.name}_score")]
            if keep_scores:
                cols.append(F.col("_ps.scores")[j].alias(f"{k.name}_scores"))
        return out.select("*", *cols).drop("_ps")
    out, merged = df, []
    for j, k in enumerate(kinds):
        names = []
        for c, chunk in enumerate(_chunks(k, max_cells)):
            names.append(f"_ps{j}_{c}")
            out = out.withColumn(names[-1], multi_set_scorer_udf([chunk], True)(F.col(vec_col))["scores"][0])
        scores = F.array(*[F.greatest(*[F.col(n)[c] for n in names]) if len(names) > 1 else F.col(names[0])[c]
                           for c in range(k.n_classes)])
        best = F.array_max(scores)
        known = F.col(vec_col).isNotNull()
        merged += [F.when(known, F.array_position(scores, best) - 1).cast("int").alias(k.name),
                   F.when(known, best).alias(f"{k.name}_score")]
        if keep_scores:
            merged.append(F.when(known, scores).alias(f"{k.name}_scores"))
    return out.select(*[F.col(c) for c in df.columns], *merged)
