"""Prefix trie of conversations by fixed-length block hashing.

A conversation is its turns in order, each known by a digest of role and text,
closed by an end mark.  Blocks of ``BLOCK`` items are hashed, and blocks are
grouped first: conversations share an **edge** when they agree in everything
before a block and in the block itself.  What lies before a block is one
digest, made of the digests of whole blocks, then of groups of ``FAN`` blocks,
of ``FAN`` groups, and so on, so a conversation of any length is digested in a
few rounds over bounded groups.  Only where edges diverge (several edges with
one start) are the turns inside a block compared, and there one row per
distinct edge is, not one per conversation; elsewhere all turns of the block
have the edge's members.

A **node** is a prefix; its id is its smallest member and its depth.  The nodes
with one smallest member form a chain that hangs off a node of a smaller
member, so sums over a node's subtree are sums down its chain plus the totals
of the chains hanging there; totals of chains are summed by pointer doubling
(rounds: the logarithm of the chains' nesting).

Scale: turns are put in order by a range sort (a conversation of any length
spans several tasks; the driver gets one row per task).  From there on rows are
narrow (digests, lengths, ids); copies meet in partial aggregates.  The ends
hash of a node streams sorted strings of up to ``END_IDS`` ids each through one
hash, held by no task whole.

Defined results: rows without conv_id belong to no conversation; null turns
come first, null role and text are empty; turns of one number are ordered by
role, then by the digest of role and text; repeated rows are turns of their own; an empty table
gives no nodes; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedlabel.llm.common import scratch_table

BLOCK = 4
FAN = 16
#: Ids of a node's ended conversations are first joined in runs of this span of ids.
END_IDS = 1000
#: Depths summed as one step of a chain's running sums.
STRIDE = 1024


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for (role, text)."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(c, pos, d, n_chars): every turn with its place in its conversation, as a written table."""
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = turns.filter(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("c"), F.col(f"`{turn_col}`").cast("long").alias("t"), role.alias("role"),
        turn_digest(role, text).alias("d"), F.length(text).cast("long").alias("n_chars"))
    key = [F.col("c"), F.col("t").asc_nulls_first(), F.col("role"), F.col("d")]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (rows.repartitionByRange(parts, *key).sortWithinPartitions(*key)
              .select("c", "d", "n_chars", F.spark_partition_id().alias("part")))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0  # conversation and its rows so far, across batches
        for batch in batches:
            c = batch.column(0).to_numpy()
            if not len(c):
                continue
            new = np.concatenate([[c[0] != last], c[1:] != c[:-1]])
            starts = np.flatnonzero(new)
            at = np.arange(len(c))
            if not new[0]:
                starts = np.concatenate([[0], starts])
            local = at - np.repeat(starts, np.diff(np.concatenate([starts, [len(c)]])))
            if not new[0]:
                local[:starts[1] if len(starts) > 1 else len(c)] += seen
            last, seen = c[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], ["c", "d", "n_chars", "part", "local"])

    table = scratch_table(ranged.mapInArrow(number, "c long, d binary, n_chars long, part int, local long"), "turns")
    ends = (table.groupBy("part").agg(F.min("c").alias("first"), F.max(F.struct("c", "local")).alias("last"))
            .orderBy("part").collect())  # one row per task
    spark, carried, at, n = turns.sparkSession, [], None, 0
    for e in ends:
        before = n if e["first"] == at else 0  # turns of the task's first conversation in earlier tasks
        if before:
            carried.append((e["part"], e["first"], before))
        n = e["last"]["local"] + 1 + (before if e["last"]["c"] == e["first"] else 0)
        at = e["last"]["c"]
    if not carried:
        return table.select("c", F.col("local").alias("pos"), "d", "n_chars")
    earlier = spark.createDataFrame(carried, "part int, c long, earlier long")
    return (table.join(F.broadcast(earlier), ["part", "c"], "left")
            .select("c", (F.col("local") + F.coalesce("earlier", F.lit(0))).alias("pos"), "d", "n_chars"))


def rebuilt(turns: DataFrame, share: int = 6, block: int = 100) -> DataFrame:
    """(c, pos, d, n_chars) of every conversation rebuilt: the first h turns
    come from the first conversation of its hundred, h = crc32(c) % share;
    its own first h turns are left out.  An end mark (d null) closes each."""
    h = F.pmod(F.crc32(F.col("c").cast("string")), F.lit(share))
    base = F.expr(f"c - c % {block}")
    sizes = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select("c", "n", h.alias("h"), base.alias("base"))
    heads = (turns.filter(F.expr(f"c % {block} = 0") & (F.col("pos") < share - 1))
             .groupBy(F.col("c").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", "d", "n_chars"))).alias("head")))
    plan = scratch_table(sizes.join(heads, "base", "left").select(
        "c", "n", "h", F.slice(F.coalesce("head", F.expr("array()")), F.lit(1), F.col("h").cast("int")).alias("head"))
        .withColumn("taken", F.size("head").cast("long")), "conversations")
    shared = plan.select("c", F.explode("head").alias("x")).select("c", "x.pos", "x.d", "x.n_chars")
    own = (turns.join(plan.select("c", "h", "taken"), "c").filter(F.col("pos") >= F.col("h"))
           .select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "d", "n_chars"))
    end = plan.select("c", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("pos"),
                      F.lit(None).cast("binary").alias("d"), F.lit(0).cast("long").alias("n_chars"))
    return shared.unionByName(own).unionByName(end)


def _digest(*parts) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _starts(blocks: DataFrame) -> DataFrame:
    """``start``: the digest of all blocks before a block, for written rows (c, b, d)."""
    if not blocks.filter("b > 0").head(1):
        return blocks.select("c", "b", F.lit(b"").alias("start"))
    groups = scratch_table(
        blocks.groupBy("c", F.floor(F.col("b") / FAN).cast("long").alias("g"))
        .agg(F.sort_array(F.collect_list(F.struct("b", "d"))).alias("x"))
        .withColumn("d", _digest(F.array_join(F.expr("transform(x, e -> hex(e.d))"), ""))), "block-groups")
    above = _starts(groups.select("c", F.col("g").alias("b"), "d")).withColumnRenamed("b", "g")
    one = groups.join(above, ["c", "g"]).select("c", "start", F.col("x"), F.posexplode("x").alias("i", "e"))
    before = F.array_join(F.expr("transform(slice(x, 1, i), e -> hex(e.d))"), "")
    return one.select("c", "e.b", F.when(F.col("i") == 0, F.col("start"))
                      .otherwise(_digest("start", before)).alias("start"))


def edges(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, edges): members (c, b, start, d) of blocks with their end's
    place, and per distinct (start, block) its items, members and smallest member."""
    blocks = scratch_table(
        items.groupBy("c", F.floor(F.col("pos") / BLOCK).cast("long").alias("b"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "d", "n_chars"))).alias("x"))
        .select("c", "b", F.expr("transform(x, e -> coalesce(hex(e.d), '-'))").alias("ds"),
                F.expr("transform(x, e -> e.n_chars)").alias("ns"))
        .withColumn("d", _digest(F.array_join("ds", ","))), "blocks")
    starts = _starts(blocks.select("c", "b", "d"))
    members = scratch_table(blocks.join(starts, ["c", "b"]), "block-members")
    grouped = members.groupBy("b", "start", "d").agg(
        F.count(F.lit(1)).alias("m"), F.min("c").alias("c"), F.first("ds").alias("ds"), F.first("ns").alias("ns"))
    return members, scratch_table(grouped, "edges")


def _inner(j: str = "j") -> Column:
    """Digest of the prefix before item ``j`` of a block: its start and the items before."""
    return F.when(F.col(j) == 0, F.col("start")).otherwise(
        _digest("start", F.array_join(F.expr(f"slice(ds, 1, {j})"), ",")))


def _running(df: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Sums over the rows of a key at this place or further, in steps of STRIDE places."""
    rows = df.withColumn("s", F.floor(F.col(at) / STRIDE))
    down = Window.partitionBy(key).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    steps = rows.groupBy(key, "s").agg(*[F.sum(v).alias(v) for v in values])
    after = steps.select(key, "s", *[F.coalesce(F.sum(v).over(down), F.lit(0)).alias(f"{v}_after") for v in values])
    inside = Window.partitionBy(key, "s").orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.select(key, "s", at, *[F.sum(v).over(inside).alias(v) for v in values])
    return here.join(after, [key, "s"]).select(
        key, at, *[(F.col(v) + F.col(f"{v}_after")).alias(v) for v in values])


def _chain_totals(chains: DataFrame) -> DataFrame:
    """(c, leaves, saved): own and hanging chains' sums, by pointer doubling
    over written rows (c, up, leaves, saved); ``up`` is null at the root."""
    root = chains.filter("up IS NULL").select("c").head()
    if root is None:
        return chains.select("c", "leaves", "saved")
    root = root["c"]
    now = chains
    while now.filter("up IS NOT NULL").head(1):
        hang = now.filter("up IS NOT NULL")
        more = hang.groupBy(F.col("up").alias("c")).agg(F.sum("leaves").alias("l2"), F.sum("saved").alias("s2"))
        # what hangs off the root's chain has nothing above it
        further = (hang.filter(F.col("up") != root)
                   .join(now.select(F.col("c").alias("up"), F.col("up").alias("up2")), "up").select("c", "up2"))
        now = scratch_table(
            now.join(more, "c", "left").join(further, "c", "left")
            .select("c", F.col("up2").alias("up"), (F.col("leaves") + F.coalesce("l2", F.lit(0))).alias("leaves"),
                    (F.col("saved") + F.coalesce("s2", F.lit(0))).alias("saved")), "chains")
    return now.select("c", "leaves", "saved")


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, depth, run, ids) rows to one SHA-256 per node, streamed."""
    at, state = None, None
    for batch in batches:
        out = []
        for c, depth, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if (c, depth) != at:
                if at:
                    out.append((*at, state.hexdigest()))
                at, state = (c, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["conv_id", "depth", "ends_sha256"])
    if at:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, state.hexdigest())],
                                         ["conv_id", "depth", "ends_sha256"])


def trie(items: DataFrame) -> DataFrame:
    """One row per node of the trie over rebuilt conversations (c, pos, d, n_chars):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    members, edge = edges(items)
    branching = edge.groupBy("b", "start").agg(F.count(F.lit(1)).alias("n_edges"))
    each = edge.join(branching, ["b", "start"])
    prefix = each.select("b", "start", "c", "m", "ds", "n_edges", F.posexplode("ns").alias("j", "n_chars")).select(
        (F.col("b") * BLOCK + F.col("j")).alias("depth"), _inner().alias("q"), "c", "m", "n_edges",
        F.col("n_chars").alias("next_chars"))
    # blocks that do not branch have the edge's members at every turn; the others are refined
    plain = prefix.filter("n_edges = 1").select("depth", "q", "c", "m")
    refined = prefix.filter("n_edges > 1").groupBy("depth", "q").agg(F.min("c").alias("c"), F.sum("m").alias("m"))
    nodes = scratch_table(plain.unionByName(refined.select("depth", "q", "c", "m")), "nodes")
    # the smallest member's own item before a node leads to its parent and holds its last text
    path = members.select("c", "start", "ds", F.col("b"), F.posexplode("ns").alias("j", "n_chars")).select(
        "c", (F.col("b") * BLOCK + F.col("j") + 1).alias("depth"), _inner().alias("up_q"), "n_chars")
    below = nodes.filter("depth > 0").join(path, ["c", "depth"])
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("q").alias("up_q"), F.col("c").alias("up"))
    # below the root every parent is the root, known without a join
    top = nodes.filter("depth = 0").select("c").head()
    if top is None:
        spark = items.sparkSession
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,"
                                         " n_leaves long, saved_tokens long, ends_sha256 string")
    root_c = F.lit(top["c"]).cast("long")
    linked = scratch_table(
        nodes.filter("depth = 0").select("c", "depth", F.lit(None).cast("long").alias("up"), "m",
                                         F.lit(0).cast("long").alias("n_chars"))
        .unionByName(below.filter("depth = 1").select("c", "depth", root_c.alias("up"), "m", "n_chars"))
        .unionByName(below.filter("depth > 1").join(up, ["depth", "up_q"]).select("c", "depth", "up", "m", "n_chars")),
        "linked-nodes")
    children = (linked.filter("depth > 0").groupBy(F.col("up").alias("c"), (F.col("depth") - 1).alias("depth"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    full = scratch_table(
        linked.join(children, ["c", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
        .withColumn("saved", (F.col("m") - 1) * F.col("n_chars")), "full-nodes")
    heads = full.filter("depth = 0 OR up <> c").select("c", F.col("up"), (F.col("depth") - 1).alias("hook"))
    own = full.groupBy("c").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    chains = scratch_table(own.join(heads, "c"), "chains")
    totals = _chain_totals(chains.select("c", "up", "leaves", "saved"))
    hanging = (chains.filter("up IS NOT NULL").select("c", "up", "hook").join(totals, "c")
               .groupBy(F.col("up").alias("c"), F.col("hook").alias("depth"))
               .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    at_node = (full.select("c", "depth", "leaves", "saved").unionByName(hanging)
               .groupBy("c", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    sums = _running(at_node, "c", "depth", ["leaves", "saved"])
    ended = (members.filter(F.element_at("ds", -1) == "-").withColumn("j", F.size("ds") - 1)
             .select("c", (F.col("b") * BLOCK + F.col("j")).alias("depth"), _inner().alias("q")))
    runs = (ended.withColumnRenamed("c", "id").join(nodes.select("depth", "q", "c"), ["depth", "q"])
            .groupBy("c", "depth", F.floor(F.col("id") / END_IDS).cast("long").alias("run"))
            .agg(F.array_join(F.expr("transform(sort_array(collect_list(id)), x -> cast(x as string))"), ",").alias("ids")))
    hashes = (runs.repartition("c", "depth").sortWithinPartitions("c", "depth", "run")
              .mapInArrow(_hash_ends, "conv_id long, depth long, ends_sha256 string")
              .select(F.col("conv_id").alias("c"), "depth", "ends_sha256"))
    return (full.select("c", "depth", "up", "m", "n_children").join(sums, ["c", "depth"])
            .join(hashes, ["c", "depth"], "left")
            .select(F.col("c").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), F.col("m").alias("n_convs"),
                    F.col("n_children").cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
                    F.col("saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text") -> DataFrame:
    """The trie over the conversations as they are, closed by end marks (general use)."""
    rows = ordered_turns(turns, conv_col, turn_col, role_col, text_col)
    end = rows.groupBy("c").agg(F.count(F.lit(1)).alias("pos")).select(
        "c", "pos", F.lit(None).cast("binary").alias("d"), F.lit(0).cast("long").alias("n_chars"))
    return trie(rows.unionByName(end))


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """The trie over the rebuilt conversations of ``conversations``."""
    return trie(rebuilt(ordered_turns(turns)))
