"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many places of the ring. A key belongs to the next place clockwise; where that
shard is full, it goes on clockwise to the next shard that is not. Rows are first counted by cells of
the ring, and the cells, of a fixed number, are walked around it; so neither the walk nor the
numbering within a shard needs all rows of a shard together.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: Slots of the ring, and cells into which the keys of a slot are divided.
SLOTS = 4096
CELLS = 8
REPLICAS = 64


def ring(shards: int, replicas: int = REPLICAS) -> list[tuple[int, ...]]:
    """For every slot all shards, in the order in which they are met clockwise."""
    places: dict[int, int] = {}
    for shard in range(shards):
        for replica in range(replicas):
            at = zlib.crc32(f"shard {shard} place {replica}".encode()) % SLOTS
            while at in places:
                at = (at + 1) % SLOTS
            places[at] = shard
    found = []
    for slot in range(SLOTS):
        order: dict[int, None] = {}
        for step in range(SLOTS):
            if (shard := places.get((slot + step) % SLOTS)) is not None:
                order[shard] = None
                if len(order) == shards:
                    break
        found.append(tuple(order))
    return found


def _choice(orders: list[tuple[int, ...]], turn: int) -> Column:
    """The shard that a key of column `cell` comes to at its turn (from 0)."""
    return F.split(F.lit(" ".join(str(o[turn]) for o in orders)), " ")[(F.col("cell") / CELLS).cast("int")].cast("int")


def shard(docs: DataFrame, shards: int = 8, slack: float = 0.0, replicas: int = REPLICAS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes + 1), text_crc32, shard and slot (place in the shard, from 0) of every row.

    A shard takes at most (1 + slack) times its even share of rows; without slack counts differ by
    one at most. The key is the id, or the text where the id is null. Null texts have size 1. Rows
    with equal id and text are counted as one cell entry and numbered apart at the end; an empty
    table gives an empty table.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.when(F.col(id_col).isNull(), F.xxhash64(body)).otherwise(F.xxhash64(id_col))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body, F.lit("text")).alias("body"),
        (F.pmod(key, F.lit(SLOTS)) * CELLS + F.pmod(F.shiftright(F.xxhash64(key, body), 20), F.lit(CELLS))).cast("int").alias("cell"),
    )
    # Repeated rows are one row with a count from here on.
    rows = materialize(rows.groupBy("id", "size", "text_crc32", "body", "cell").agg(F.count("*").alias("n")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    share, extra = divmod(total, shards)
    room = {s: int((share + (s < extra)) * (1 + slack)) for s in range(shards)}
    orders = ring(shards, replicas)

    # Cells of the ring that are still to be placed: `done` of their rows have a shard already.
    waiting = rows.groupBy("cell").agg(F.sum("n").alias("left")).withColumn("done", F.lit(0).cast("long"))
    taken, fill = None, dict.fromkeys(room, 0)
    for turn in range(shards):
        limits = F.create_map(*[F.lit(x) for s in room for x in (s, room[s] - fill[s])])
        starts = F.create_map(*[F.lit(x) for s in room for x in (s, fill[s])])
        asked = waiting.withColumn("shard", _choice(orders, turn))
        # All rows of the window are cells, of which there are SLOTS * CELLS at most.
        before = F.expr("sum(left) OVER (PARTITION BY shard ORDER BY cell) - left")
        asked = asked.withColumn("before", before).withColumn("get", F.greatest(F.lit(0), F.least("left", limits[F.col("shard")] - F.col("before"))))
        asked = materialize(asked.withColumn("base", starts[F.col("shard")] + F.col("before") - F.col("done")))
        part = asked.where("get > 0").select("cell", "shard", "base", F.col("done").alias("low"), (F.col("done") + F.col("get")).alias("high"))
        taken = part if taken is None else taken.unionByName(part)
        for r in asked.groupBy("shard").agg(F.sum("get").alias("n")).collect():
            fill[r.shard] += r.n
        waiting = asked.where("left > get").select("cell", (F.col("left") - F.col("get")).alias("left"), (F.col("done") + F.col("get")).alias("done"))
        if sum(fill.values()) == total:
            break

    # Ranks within a cell, then each rank's interval; a row that counts for many may span several.
    ranked = rows.withColumn("to", F.expr("sum(n) OVER (PARTITION BY cell ORDER BY body, id, size, text_crc32)")).withColumn("from", F.col("to") - F.col("n"))
    placed = ranked.join(taken, "cell").where("from < high AND to > low")
    ranks = F.sequence(F.greatest("from", "low"), F.least("to", "high") - 1)
    return placed.select("id", "size", "text_crc32", "shard", "base", F.explode(ranks).alias("rank")).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).alias("slot")
    )
