"""Near duplicates among vectors of one label: exact threshold pairs by cover trees.

Equal vectors are one point with a weight. The points of a label are dealt to cells, each the
nearest of a few pivots, and crowded cells to several parts; so a block of points is bounded. Two
blocks meet only if the distance of their pivots is at most both radii and the threshold together;
a task then walks their two cover trees. Tasks give numbers of links and, instead of pairs, one
edge per connected point, so a group of near copies costs rows in proportion to its points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .components import components
from .cover_tree import CoverTree, Links, distances, normalized

#: Points of a block; two blocks and their trees meet in one task.
BLOCK = 32_768
#: Pivots that are sent to all tasks at once; with more of them the points are dealt in rounds.
PIVOTS = 1 << 16
#: Rows of one vector that meet in one task when results return to rows.
SPLIT = 100_000
#: Room for rounding where distances of pivots decide.
SLACK = 1e-6
GROUP = ["label", "dim"]


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _dealt(points: DataFrame, limit: float) -> DataFrame:
    """`points` with `cell` (the nearest pivot's node, null in labels of one block) and `away` from it."""
    sizes = points.groupBy(*GROUP).count().where(F.col("count") > BLOCK).withColumnRenamed("count", "n")
    # Labels with more points than a block: fewer than all points divided by BLOCK.
    large = materialize(sizes)
    plain = points.withColumn("cell", F.lit(None).cast("long")).withColumn("away", F.lit(None).cast("double"))
    if large.isEmpty():
        return plain
    many = points.join(F.broadcast(large), GROUP)
    share = F.pmod(F.xxhash64("node"), F.col("n")) * BLOCK < F.col("n")
    pivots = materialize(many.where(share).select(*GROUP, "node", "vector"))
    rounds = 1 + pivots.count() // PIVOTS
    dealt = many.drop("n").withColumn("cell", F.lit(None).cast("long")).withColumn("away", F.lit(None).cast("double"))
    schema = dealt.schema
    for k in range(rounds):
        part = pivots.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(rounds)) == k).toArrow()
        known: dict[tuple, list[int]] = {}
        for at, key in enumerate(zip(part["label"].to_pylist(), part["dim"].to_pylist())):
            known.setdefault(key, []).append(at)
        held = {key: (part["node"].to_numpy()[at], normalized(_matrix(part["vector"].take(pa.array(at)), key[1]))) for key, at in known.items()}
        sent = points.sparkSession.sparkContext.broadcast(held)

        def nearest(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = b.column("cell").to_numpy(zero_copy_only=False).astype(object)
                away = b.column("away").to_numpy(zero_copy_only=False).astype(np.float64)
                keys = list(zip(b.column("label").to_pylist(), b.column("dim").to_pylist()))
                for key in set(keys) & set(sent.value):
                    rows = np.array([i for i, other in enumerate(keys) if other == key])
                    names, centers = sent.value[key]
                    mine = normalized(_matrix(b.column("vector").take(pa.array(rows)), key[1]))
                    for at in range(0, len(rows), 512):
                        here = rows[at : at + 512]
                        best, dist = np.full(len(here), -1), np.full(len(here), np.inf)
                        for c in range(0, len(names), 4096):
                            d = distances(mine[at : at + 512], centers[c : c + 4096])
                            low = d.min(1)
                            best, dist = np.where(low < dist, d.argmin(1) + c, best), np.minimum(dist, low)
                        better = ~(away[here] <= dist)
                        away[here[better]], cells[here[better]] = dist[better], names[best[better]]
                cell = pa.array([None if c is None or c != c else int(c) for c in cells], pa.int64())
                columns = {n: b.column(n) for n in b.schema.names} | {"cell": cell, "away": pa.array(away, pa.float64(), mask=np.isnan(away))}
                yield pa.RecordBatch.from_arrays([columns[n] for n in b.schema.names], names=b.schema.names)

        dealt = materialize(dealt.mapInArrow(nearest, schema))
    few = plain.join(F.broadcast(large.select(*GROUP)), GROUP, "left_anti")
    return few.select(*schema.names).unionByName(dealt)


def _meetings(blocks: DataFrame, points: DataFrame, limit: float) -> DataFrame:
    """(meeting, side, label, dim, cell, part): which blocks meet; a block meets itself on side 0 only."""
    centers = points.select(F.col("node").alias("cell"), F.col("vector").alias("pivot"))
    placed = materialize(blocks.join(centers, "cell", "left"))
    a = placed.select(*GROUP, *[F.col(c).alias(f"{c}_a") for c in ("cell", "part", "radius", "pivot")])
    b = placed.select(*GROUP, *[F.col(c).alias(f"{c}_b") for c in ("cell", "part", "radius", "pivot")])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    cosine = dot("pivot_a", "pivot_b") / F.sqrt(dot("pivot_a", "pivot_a") * dot("pivot_b", "pivot_b"))
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosine))
    order = lambda s: F.struct(F.col(f"cell_{s}"), F.col(f"part_{s}"))
    pairs = a.join(b, GROUP).where((order("a") < order("b")) | order("a").eqNullSafe(order("b")))
    # Pivots whose lengths pass the largest double have no distance here, and meet.
    far = F.coalesce(apart > F.col("radius_a") + F.col("radius_b") + F.lit(limit + SLACK), F.lit(False)) & ~F.isnan(apart)
    pairs = pairs.where(~far).withColumn("meeting", F.monotonically_increasing_id())
    pairs = materialize(pairs.select("meeting", *GROUP, "cell_a", "part_a", "cell_b", "part_b"))
    first = pairs.select("meeting", F.lit(0).alias("side"), *GROUP, F.col("cell_a").alias("cell"), F.col("part_a").alias("part"))
    other = pairs.where(~order("a").eqNullSafe(order("b")))
    return first.unionByName(other.select("meeting", F.lit(1).alias("side"), *GROUP, F.col("cell_b").alias("cell"), F.col("part_b").alias("part")))


def links(points: DataFrame, cosine: float) -> DataFrame:
    """(node, links, root) of points that are linked: partial numbers of links, edges to `root`.

    `points(node, label, dim, vector, weight)`: distinct vectors, finite and not zero.
    """
    limit = float(np.sqrt(2 - 2 * cosine))
    dealt = materialize(_dealt(points, limit))
    sizes = dealt.groupBy(*GROUP, "cell").agg(F.max(F.coalesce("away", F.lit(2.0))).alias("radius"), F.count("*").alias("n"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("cell", F.coalesce("cell", F.lit(-1)))
    blocks = materialize(sizes.select(*GROUP, "cell", "radius", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    meetings = _meetings(blocks, points, limit)
    # Cells of several parts: fewer than all points divided by BLOCK.
    split = blocks.where((F.col("parts") > 1) & (F.col("part") == 0)).select(*GROUP, "cell", "parts")
    members = dealt.withColumn("cell", F.coalesce("cell", F.lit(-1))).join(F.broadcast(split), [*GROUP, "cell"], "left")
    members = members.withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int"))
    invited = members.join(meetings, [*GROUP, "cell", "part"]).select("meeting", "side", "dim", "node", "weight", "vector")

    def walk(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        dim = table["dim"][0].as_py()
        sides = [np.flatnonzero(side == s) for s in range(1 + int(side.max()))]
        nodes = [table["node"].to_numpy()[s] for s in sides]
        weights = [table["weight"].to_numpy()[s] for s in sides]
        raw = [_matrix(table["vector"].take(pa.array(s)), dim) for s in sides]
        trees = [CoverTree(normalized(r)) for r in raw]
        found = Links(trees[0], trees[-1], (weights[0], weights[-1]), (raw[0], raw[-1]), cosine)
        counts, every = np.concatenate(found.counts()), np.concatenate(nodes)
        roots = every[np.concatenate(found.roots())]
        some = (counts > 0) | (roots != every)
        return pa.table({"node": every[some], "links": counts[some], "root": roots[some]})

    return invited.groupBy("meeting").applyInArrow(walk, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: rows of equal labels link at `cosine` or more.

    Cosines are taken in double precision. A row links with nothing if its label is null, or its
    vector is null, empty, zero or holds a null, NaN or infinity; vectors of different lengths do not
    link. `component_id` is the smallest id that links lead to, the row's own included; it is null
    only if all ids are. `kept` says that it is the row's own id; a row without id is not kept.
    Repeated rows count as rows of their own; other columns do not matter; an empty table gives an
    empty table.
    """
    if not -1 < cosine <= 1 - 1e-9:
        raise ValueError("cosine must be above -1 and at most 1 - 1e-9")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    plain = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", plain) & F.exists("vector", lambda x: x != 0)
    marked = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    keys = ["label", "vector"]
    grouped = marked.where("valid").groupBy(*keys).agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    points = materialize(grouped.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")))
    found = materialize(links(points.select("node", "label", "dim", "vector", "weight"), cosine))
    roots = materialize(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = points.select("node", "first", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    numbers = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = named.join(firsts, "root").join(numbers, "node", "left").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.ceil(F.col("weight") / SPLIT).cast("int").alias("parts")
    )
    told = materialize(points.select("node", *keys).join(told, "node").drop("node"))

    # Vectors of more than SPLIT rows, fewer than all rows divided by SPLIT, take their rows in several parts.
    often = told.where("parts > 1").select(*keys, F.col("parts").alias("of"))
    spread = told.select(*keys, "component_id", "n_links", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    row_part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("of", F.lit(1))).cast("int")
    dealt = marked.where("valid").join(F.broadcast(often), keys, "left").withColumn("part", row_part)
    linked = dealt.join(spread, [*keys, "part"]).select("id", "n_links", "component_id")
    alone = marked.where(~F.col("valid")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
