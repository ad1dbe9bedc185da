"""Joins that stay balanced when one key holds a large share of the rows.

* A join to a table with one row, or a few, per key is a plain join. Adaptive execution measures its sides as
  they are written for the shuffle: it broadcasts one that is small and splits a partition that is too large. Nothing
  is counted beforehand and no plan runs twice.
* `spread_left` is such a join for a key that may be missing in many rows: those are dealt out instead of meeting
  in one partition.
* `grid_join` is for keys with many rows on both sides, whose combinations adaptive execution does not see. It
  counts the keys of written tables once, and deals keys with too many combinations into cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litevidence.sources.writers import staged

CELL_PRODUCT = 10_000_000  # combinations of one key that one task may make
_NULL_KEY_SPREAD = 1_000   # cells among which rows without a key are dealt


def spread_left(left: DataFrame, right: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Left join on a text key of which `right` has no null. Rows without the key match nothing.

    Such rows get one of many stand-ins for the key that no right row has. `partitions` is a number of tasks that adaptive
    execution shall not lower.
    """
    stand_in = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*left.columns), F.lit(_NULL_KEY_SPREAD)).cast("string"))
    dealt = left.withColumn("_key", F.coalesce(F.col(key).cast("string"), stand_in))
    if partitions:
        dealt = dealt.repartition(partitions, "_key")
    return dealt.join(right.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")


def spread_semi(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    """Rows of `left` whose key is in `right`, where a missing key matches a missing key.

    Rows without the key are dealt out as in `spread_left`; a missing right key stands for all stand-ins.
    """
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(_NULL_KEY_SPREAD - 1)), lambda i: F.concat(F.lit("\u0000"), i.cast("string"))
    )
    wanted = F.when(F.col(right_key).isNull(), spread).otherwise(F.array(F.col(right_key).cast("string")))
    keys = right.select(F.explode(wanted).alias("_key"))
    stand_in = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*left.columns), F.lit(_NULL_KEY_SPREAD)).cast("string"))
    dealt = left.withColumn("_key", F.coalesce(F.col(key).cast("string"), stand_in))
    return dealt.join(keys, "_key", "left_semi").drop("_key")


def products(sides: Sequence[DataFrame], on: Sequence[str], max_product: int) -> DataFrame:
    """Keys with more combinations than one task may make: rows `_n` and slices `_s` of each side.

    Each side is cut into as many slices as keep a cell of all sides within `max_product`. A side without
    rows of a key counts as one row, since an outer join pads it. The counts are combined before the shuffle.
    """
    span = range(len(sides))
    tally = reduce(
        DataFrame.unionByName,
        [
            side.groupBy(*on).agg(
                *[(F.count(F.lit(1)) if i == j else F.lit(0).cast("long")).alias(f"_n{j}") for j in span]
            )
            for i, side in enumerate(sides)
        ],
    )
    rows = max(1, int(max_product ** (1 / len(sides))))
    combined = reduce(Column.__mul__, [F.greatest(F.lit(1), f"_n{j}").cast("double") for j in span])
    return (
        tally.dropna("any", subset=list(on))
        .groupBy(*on)
        .agg(*[F.sum(f"_n{j}").alias(f"_n{j}") for j in span])
        .where(combined > max_product)
        .select("*", *[F.greatest(F.lit(1), F.ceil(F.col(f"_n{j}") / rows)).cast("int").alias(f"_s{j}") for j in span])
    )


def grid_join(
    sides: Sequence[DataFrame],
    on: Sequence[str],
    how: str = "inner",
    max_product: int = CELL_PRODUCT,
) -> DataFrame:
    """Equi-join of two or more tables in which a key may have many rows on every side.

    Starts jobs when called: the sides are counted by key, and the keys with too many combinations, all of them,
    are written to a table. So the sides should be written tables. A row of such a key is dealt to one slice
    of its own side and copied along the others, so every combination meets in exactly one cell. The keys are met
    by an ordinary join, however many there are. `how` is inner, left (two sides) or full_outer. Rows of a
    side should be distinct: copies land in the same cell.
    """
    on = list(on)
    span = range(len(sides))
    hot = staged(products(sides, on, max_product), "hot-keys")
    if hot.isEmpty():
        return reduce(lambda a, b: a.join(b, on, how), sides)
    # A row carries its cell and, where rows may be padded, one number that says which sides have rows of its key.
    padded = {"inner": [], "left": span[1:], "full_outer": span}[how]
    cell = [f"_c{j}" for j in span] + (["_sides"] if padded else [])
    dealt = [_deal(side, hot, on, i, len(sides)) for i, side in enumerate(sides)]
    dealt = [d.select(*side.columns, *cell, *([f"_hit{i}"] if i in padded else [])) for i, (d, side) in enumerate(zip(dealt, sides, strict=True))]
    joined = reduce(lambda a, b: a.join(b, on + cell, how), dealt)

    # A slice may be empty although the key has rows on that side: its null-padded rows are not ours.
    for j in padded:
        joined = joined.where(F.col(f"_hit{j}").isNotNull() | (F.col("_sides").bitwiseAND(1 << j) == 0))
    return joined.drop(*cell, *[f"_hit{j}" for j in padded])


def _deal(side: DataFrame, hot: DataFrame, on: list[str], own: int, width: int) -> DataFrame:
    row = F.xxhash64(*side.columns)
    no_key = reduce(Column.__or__, [F.col(k).isNull() for k in on])
    out = side.withColumn("_row", row).join(hot, on, "left")
    for j in range(width):
        parts = F.coalesce(F.col(f"_s{j}"), F.lit(1))
        if j == own:
            # Rows without a key match nothing, so any cell will do for them.
            parts = F.when(no_key, F.lit(_NULL_KEY_SPREAD)).otherwise(parts)
            out = out.withColumn(f"_c{j}", F.pmod(F.col("_row"), parts.cast("long")).cast("int"))
        else:
            out = out.withColumn(f"_c{j}", F.explode(F.sequence(F.lit(0), parts - 1)))
    # None for the keys that are not dealt.
    held = [F.when(F.col(f"_n{j}") > 0, 1 << j).otherwise(0) for j in range(width)]
    return out.withColumn("_sides", reduce(Column.__add__, held)).withColumn(f"_hit{own}", F.lit(True))
