"""Sharding by a permutation-filled lookup table.

Each shard derives a preference order over the slots of a prime-sized table
(an offset and a step, both from the MD5 digest of its name); the shards take
turns, each claiming its first slot that is still free, until the table is
full.  A key is placed by one table look-up, and adding or removing a shard
moves few slots beyond that shard's own.

The table has a size fixed by the parameters (rows x slots, not data), so it
is broadcast; placement is DataFrame functions only, without a shuffle, so a
source or key with any share of the rows costs nothing extra.

Null keys are placed like the empty string; equal keys share a shard; an
empty table gives an empty result; other columns of the input are kept as
they are (``place``), but for columns named like the result's, which these
replace.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedlabel.llm.common import hex60

#: Production parameters: shards, and slots per shard at least (Maglev's paper advises 100).
N_SHARDS = 16
SLOTS_PER_SHARD = 100
#: A look-up table may not exceed this many slots (it is broadcast).
MAX_SLOTS = 1_000_000


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def next_prime(n: int) -> int:
    """The smallest prime that is at least n."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: Sequence[str], slots: int) -> list[int]:
    """slot -> index of the shard that claimed it."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be distinct and not empty")
    if slots < len(names) or slots > MAX_SLOTS or next_prime(slots) != slots:
        raise ValueError("slots must be a prime between the number of shards and MAX_SLOTS")
    at = [_digest(n + ":offset") % slots for n in names]
    step = [_digest(n + ":step") % (slots - 1) + 1 for n in names]
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(names)):
            if not free:
                break
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            free -= 1
    return table


def table_frame(spark: SparkSession, names: Sequence[str], slots: int) -> DataFrame:
    """The look-up table as a DataFrame (shard_slot, shard, shard_name)."""
    owner = F.split(F.lit(",".join(map(str, lookup_table(names, slots)))), ",")
    name = F.split(F.lit(",".join(names)), ",")
    return (spark.range(1).select(F.posexplode(owner).alias("shard_slot", "owner"), name.alias("names"))
            .select("shard_slot", F.col("owner").cast("int").alias("shard"),
                    F.get("names", F.col("owner").cast("int")).alias("shard_name")))


def slot_of(key: Column, slots: int) -> Column:
    return (hex60(F.coalesce(key.cast("string"), F.lit(""))) % slots).cast("int")


def place(df: DataFrame, key: str, names: Sequence[str] | None = None, slots: int | None = None) -> DataFrame:
    """Every row of ``df`` with ``shard_slot``, ``shard`` and ``shard_name``."""
    names = list(names) if names is not None else shard_names(N_SHARDS)
    slots = slots or next_prime(SLOTS_PER_SHARD * len(names))
    table = F.broadcast(table_frame(df.sparkSession, names, slots))
    kept = [c for c in df.columns if c.lower() not in ("shard_slot", "shard", "shard_name")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.lit(None).alias("row"),
                     slot_of(F.col(f"`{key}`"), slots).alias("shard_slot"))
    return rows.join(table, "shard_slot").select(*[F.col("row").getField(c).alias(c) for c in kept],
                                                 "shard_slot", "shard", "shard_name")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Write one folder per shard; a shard's rows are dealt over ``files_per_shard`` tasks."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in placed.dtypes if not t.startswith("map")]),
                  F.lit(files_per_shard))
    (placed.repartition("shard", salt).write.partitionBy("shard").parquet(path))
