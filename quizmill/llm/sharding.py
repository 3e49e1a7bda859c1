"""Balanced label propagation: linked documents move towards each other's shards under quotas.

Documents with equal texts are linked. State is kept per cell, the documents of a group that a hash
puts together, so a group with a third of all rows is a few hundred cells and no task holds its rows.
In each round, a group's cells want the shard where most of the group is; a shard takes in as many
rows as its quota leaves beside the linked rows that stay, each move admitted by a hash against
the share of the demand that fits. Unlinked documents fill what is left: at the end rows beyond a
shard's quota, unlinked ones first, go where rows are missing, so counts are at most one apart.

A null text counts as empty; so null and empty texts form one group. Repeated rows are placed each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizmill.llm import shared

SHARDS = 24
#: Cells of a group for each shard.
FINE = 8
ROUNDS = 6
#: Rows for each part when slots are numbered.
PART = 1_000_000


def _chance(*cols) -> Column:
    """A number from 0 to below 1 that depends on the columns alone."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))).cast("double")


def propagate(cells: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(g, cell, n, shard) after the rounds. Reads the demand for each shard, one row a shard, on the driver."""
    shards = len(quotas)
    for k in range(rounds):
        at = cells.groupBy("g", "shard").agg(F.sum("n").alias("here"))
        wish = at.groupBy("g").agg(F.max_by("shard", F.struct("here", F.xxhash64("g", "shard"))).alias("to"))
        moves = shared.stored(cells.join(wish, "g"), "shard-moves")
        stay = dict(moves.where("shard = to").groupBy("shard").agg(F.sum("n")).collect())
        demand = dict(moves.where("shard <> to").groupBy("to").agg(F.sum("n")).collect())
        if not demand:
            return cells
        fits = [min(1.0, max(0, quotas[s] - stay.get(s, 0)) / demand[s]) if demand.get(s) else 0.0 for s in range(shards)]
        if not any(fits):
            return cells
        share = F.get(F.array(*map(F.lit, fits)), F.col("to"))
        # small groups move whole; a group that could fill a shard moves by cells
        draw = F.when(F.col("n") * FINE * shards > min(quotas) // 8, _chance("g", "cell", F.lit(k))).otherwise(_chance("g", F.lit(k)))
        cells = shared.stored(moves.select("g", "cell", "n", F.when(draw < share, F.col("to")).otherwise(F.col("shard")).alias("shard")), "shard-cells")
    return cells


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """For every row: doc_id, size (UTF-8 bytes and 8), text_crc32, shard, slot (from 0, gapless in the shard).

    An empty table gives an empty result; with fewer rows than shards, some shards stay empty.
    """
    rows = shared.texts_of(docs, "doc_id")
    size, crc = F.octet_length("text").cast("long") + 8, F.crc32(F.col("text").cast("binary"))
    group = F.struct(F.xxhash64("text").alias("a"), crc.alias("b"), F.octet_length("text").alias("c"))
    base = rows.select("doc_id", size.alias("size"), crc.alias("text_crc32"), group.alias("g"))
    base = shared.stored(base.withColumn("cell", F.pmod(F.xxhash64("doc_id", "g"), F.lit(shards * FINE)).cast("int")), "shard-rows")
    total = base.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    cells = base.groupBy("g", "cell").agg(F.count("*").alias("n"))
    linked = cells.groupBy("g").agg(F.sum("n").alias("all")).where("all > 1").select("g")
    cells = shared.stored(cells.join(linked, "g", "left_semi").withColumn("shard", F.col("cell") % shards), "shard-cells")
    final = propagate(cells, quotas).select("g", "cell", F.col("shard").alias("to"))
    placed = base.join(final, ["g", "cell"], "left").select("doc_id", "size", "text_crc32", F.coalesce("to", F.col("cell") % shards).alias("shard"), F.col("to").isNull().alias("alone"), "g")
    return balanced(placed, quotas)


def balanced(placed: DataFrame, quotas: list[int]) -> DataFrame:
    """Slots within shards, rows beyond the quota moved to where rows are missing."""
    spark, shards = placed.sparkSession, len(quotas)
    order = ["shard", "alone", "g", "doc_id"]
    parts = shared.parts_for(spark, sum(quotas), PART)
    dealt = shared.stored(placed.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "shard-order")
    number = F.row_number().over(Window.partitionBy("part", "shard").orderBy("alone", "g", "doc_id"))
    tally = dealt.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = tally.select("part", "shard", before.alias("before"))
    have = dict(dealt.groupBy("shard").agg(F.count("*")).collect())
    have = [have.get(s, 0) for s in range(shards)]
    over, over_at, gap_at = [max(0, h - q) for h, q in zip(have, quotas, strict=True)], [0] * shards, [0] * (shards + 1)
    for s in range(shards):
        over_at[s] = sum(over[:s])
        gap_at[s + 1] = gap_at[s] + max(0, quotas[s] - have[s])
    pick = lambda values, key: F.get(F.array(*(F.lit(int(v)).cast("long") for v in values)), key)
    ranked = dealt.withColumn("_in_part", number).join(offsets, ["part", "shard"]).withColumn("rank", F.col("before") + F.col("_in_part") - 1)
    ranked = ranked.withColumn("extra", F.when(F.col("rank") >= pick(quotas, F.col("shard")), pick(over_at, F.col("shard")) + F.col("rank") - pick(quotas, F.col("shard"))))
    to = F.lit(None).cast("int")
    for s in reversed(range(shards)):
        to = F.when((F.col("extra") >= gap_at[s]) & (F.col("extra") < gap_at[s + 1]), F.lit(s)).otherwise(to)
    moved = ranked.withColumn("to", to)
    slot = F.when(F.col("to").isNull(), F.col("rank")).otherwise(pick(have, F.col("to")) + F.col("extra") - pick(gap_at[:-1], F.col("to")))
    return moved.select("doc_id", "size", "text_crc32", F.coalesce("to", "shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))
