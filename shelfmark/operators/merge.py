"""One row per key out of several that each know some of its fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def _present(df: DataFrame, name: str) -> Column:
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, ArrayType):
        return F.coalesce(F.size(c), F.lit(0)) > 0
    if isinstance(kind, StringType):
        return F.coalesce(c, F.lit("")) != ""
    return c.isNotNull()


def merge_fields(rows: DataFrame, keys: list[str], ranks: dict[str, Column], order: list[Column], together: dict[str, list[str]] | None = None) -> DataFrame:
    """(keys, columns of `ranks`): each column from the row that ranks first for it and has it.

    `ranks[column]`: the lower goes first, null means that the row never gives this column; equal
    ranks are decided by `order`, which has to be total. Empty texts and arrays count as missing;
    a column that no row has is null. `together[column]` names further columns
    that come from the same row as `column`. One grouping with partial aggregation: a key with very
    many rows costs one row for each partition.
    """
    together = together or {}
    made = []
    for name, rank in ranks.items():
        place = F.when(_present(rows, name) & rank.isNotNull(), F.struct(rank.alias("rank"), *[o.alias(f"o{i}") for i, o in enumerate(order)]))
        taken = F.struct(*[F.col(c) for c in [name, *together.get(name, [])]])
        made.append(F.min_by(taken, place).alias(f"__{name}"))
    merged = rows.groupBy(*keys).agg(*made)
    return merged.select(*keys, *[F.col(f"__{name}")[c].alias(c) for name in ranks for c in [name, *together.get(name, [])]])
