"""Mixing sources to target weights by a proportionate-fair schedule of their blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Largest schedule table that is broadcast.
MOST_ROWS = 200_000


def period(weights: dict) -> tuple[int, dict]:
    """Slots of one period and the slots of each key's blocks in it.

    A key of weight p out of Q in all has p blocks in Q slots. Block i is released at slot floor(i * Q / p) and due before slot
    ceil((i + 1) * Q / p); of the released blocks the one due first is scheduled, ties by the order of weights. The weights use
    every slot exactly, so no block is late and every key stays within less than one block of its share.
    """
    common = math.gcd(*weights.values())
    parts = {s: p // common for s, p in weights.items()}
    q = sum(parts.values())
    taken = dict.fromkeys(parts, 0)
    slots: dict = {s: [] for s in parts}
    for t in range(q):
        ready = [(-((-(taken[s] + 1) * q) // p), k, s) for k, (s, p) in enumerate(parts.items()) if taken[s] < p and taken[s] * q // p <= t]
        due, _, s = min(ready)
        if t >= due:
            raise AssertionError("a block is late")
        slots[s].append(t)
        taken[s] += 1
    return q, slots


def phases(weights: dict, blocks: dict) -> list[dict]:
    """Periodic stretches of the schedule: a stretch ends with the last block of some key, and the rest share its weight.

    Each has its first slot, its period q, and for every key the first and the end of its blocks there and the slots of a period.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    out, at = [], 0
    while left:
        q, slots = period({s: weights[s] for s in sorted(left, key=str)})
        length = min((n - 1) // len(slots[s]) * q + slots[s][(n - 1) % len(slots[s])] for s, n in left.items()) + 1
        took = {s: length // q * len(slots[s]) + sum(x < length % q for x in slots[s]) for s in left}
        out.append({"at": at, "q": q, "keys": {s: (done[s], done[s] + took[s], slots[s]) for s in left}})
        at += length
        for s in list(left):
            done[s] += took[s]
            left[s] -= took[s]
            if not left[s]:
                del left[s]
    return out


def _spread(key: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"))


def mix(docs: DataFrame, weights: dict[str, int], other: int = 1, block_rows: int = 64, bucket_rows: int = 4_000, key: str = "source", id_column: str = "doc_id") -> DataFrame:
    """Every row of docs with mix_block_ and mix_slot_: its block in its source and the place of that block in the mix.

    These replace columns of the same names; other columns stay, whatever they are called.

    weights: whole numbers over 0, in any unit, for the sources named; all other sources, null too, form one further source
    of weight other. Within a source rows go by hash of the id, then id, so that a block is a random draw. In every
    stretch of slots in which the same sources have blocks left, each has its share to within less than one block; when a
    source is used up the others share its slots. No row is dropped or repeated, an empty table gives an empty mix, and
    equal ids keep an arbitrary order between them.

    Rows are numbered from counts of small hash ranges of each source, so a source that holds a third of all rows spreads
    over tasks like any other. The driver sees one count for each named source and a schedule that depends on the weights alone.
    """
    if any(int(w) != w or w < 1 for w in [*weights.values(), other]):
        raise ValueError("weights are whole numbers over 0")
    spark = docs.sparkSession
    named = F.when(F.col(key).isin(list(weights)), F.concat(F.lit("="), F.col(key))).otherwise(F.lit("*")) if weights else F.lit("*")
    of = {"=" + s: int(w) for s, w in weights.items()} | {"*": int(other)}
    # the row travels as one column, whatever its own columns are called
    rows = docs.select(F.struct(*docs.columns).alias("mix_row_"), named.alias("mix_key_"), _spread(id_column).alias("mix_hash_"), F.col(id_column).alias("mix_id_"))
    counts = {r["mix_key_"]: r["n"] for r in rows.groupBy("mix_key_").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    bits = max(0, math.ceil(math.log2(max(1, total / bucket_rows))))
    rows = rows.withColumn("mix_part_", F.shiftright("mix_hash_", 64 - bits) if bits else F.lit(0).cast("long"))
    parts = rows.groupBy("mix_key_", "mix_part_").agg(F.count("*").alias("mix_n_"))
    before = Window.partitionBy("mix_key_").orderBy("mix_part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("mix_before_", F.coalesce(F.sum("mix_n_").over(before), F.lit(0))).drop("mix_n_")
    within = Window.partitionBy("mix_key_", "mix_part_").orderBy("mix_hash_", "mix_id_")
    placed = rows.join(parts, ["mix_key_", "mix_part_"]).withColumn("block_", F.floor((F.col("mix_before_") + F.row_number().over(within) - 1) / F.lit(block_rows)).cast("long"))
    plan, slots = [], []
    for n, phase in enumerate(phases(of, {s: -(-c // block_rows) for s, c in counts.items()})):
        for s, (first, end, offsets) in phase["keys"].items():
            plan.append((s, n, first, end, phase["at"], phase["q"], len(offsets)))
            slots.extend((s, n, j, t) for j, t in enumerate(offsets))
    plan_table = spark.createDataFrame(plan, "s_ string, n_ int, first_ long, end_ long, at_ long, q_ long, p_ long")
    slot_table = spark.createDataFrame(slots, "s2_ string, n2_ int, j_ long, t_ long")
    small = (lambda t, n: F.broadcast(t) if n <= MOST_ROWS else t)
    staged = placed.join(small(plan_table, len(plan)), (F.col("mix_key_") == F.col("s_")) & (F.col("block_") >= F.col("first_")) & (F.col("block_") < F.col("end_")))
    staged = staged.withColumn("k_", F.col("block_") - F.col("first_")).withColumn("turn_", F.col("k_") % F.col("p_"))
    mixed = staged.join(small(slot_table, len(slots)), (F.col("s_") == F.col("s2_")) & (F.col("n_") == F.col("n2_")) & (F.col("turn_") == F.col("j_")))
    slot = F.col("at_") + F.floor(F.col("k_") / F.col("p_")).cast("long") * F.col("q_") + F.col("t_")
    own = [F.col("mix_row_")[c].alias(c) for c in docs.columns if c not in ("mix_block_", "mix_slot_")]
    return mixed.select(*own, F.col("block_").alias("mix_block_"), slot.alias("mix_slot_"))


def in_order(mixed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Rows of mix() in the order of the mix, over files and within them, without its columns."""
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = mixed.withColumn("mix_hash_", _spread(id_column))
    by = ["mix_slot_", "mix_hash_", id_column]
    return keyed.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("mix_slot_", "mix_block_", "mix_hash_")
