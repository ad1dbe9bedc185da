"""Distributed LSD radix sort: every row gets its rank by a composite key of integers.

The key is read as digits of at most 11 bits, from the least significant on. A pass is a stable counting sort by
one digit: each block of rows (a range of places) counts its digits, prefix sums over digits and blocks say where
the rows of a block with a digit begin, and a row's destination is that start plus its rank among them. Blocks hold
a bounded number of rows, so no task sees more than that of one digit, however many rows are equal. Bits in which
no two rows differ take no pass.

Each pass is written to the shared folder, so a lost executor repeats a part of one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litevidence.llm.common import staged

DIGIT_BITS = 11
BLOCK_ROWS = 1_000_000     # of a block, when there are more rows than partitions times this
_SIGN = -(1 << 63)


def ascending(column: str) -> Column:
    """64 bits whose order as an unsigned number is that of a long; null as the value 0 (see `null_last`)."""
    return F.coalesce(F.col(column), F.lit(0)).cast("long").bitwiseXOR(F.lit(_SIGN))


def descending(column: str) -> Column:
    return F.bitwise_not(ascending(column))


def null_last(column: str) -> Column:
    return F.col(column).isNull().cast("long")


def _digits(low: int, bits: int) -> list[tuple[int, int]]:
    """Shift and width of the digits of a key, of about equal width."""
    if bits <= low:
        return []
    passes = -(-(bits - low) // DIGIT_BITS)
    width = -(-(bits - low) // passes)
    return [(low + k * width, width) for k in range(passes)]


def radix_ranked(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows with `place`, their rank from 0 by the keys, the most significant key first.

    Keys are 64-bit columns in unsigned order; see `ascending`, `descending`. Rows of equal keys keep the order in
    which the table is first written, whichever it is; an empty table stays empty. Columns of the names `place`,
    `block` and `key_N` must not be among the rows' own.
    """
    names = [f"key_{i}" for i in range(len(keys))]
    own = rows.columns
    current = staged(
        rows.select(*own, *[k.alias(n) for k, n in zip(keys, names, strict=True)], F.monotonically_increasing_id().alias("place"))
        .withColumn("block", F.shiftright("place", 33)),
        "radix-rows",
    )
    seen = current.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.bit_or(n).bitwiseXOR(F.bit_and(n)).alias(n) for n in names],
    ).first()
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(partitions, -(-seen["n"] // BLOCK_ROWS))
    per_block = max(1, -(-seen["n"] // blocks))
    passes = []
    for name in reversed(names):
        varying = (seen[name] or 0) & ((1 << 64) - 1)
        low = (varying & -varying).bit_length() - 1 if varying else 0
        passes += [(name, shift, width) for shift, width in _digits(low, varying.bit_length())]
    for name, shift, width in passes or [(names[0], 0, 1)]:  # without a pass, places would not be ranks yet
        current = _counting_pass(current, name, shift, width, per_block)
    return current.drop("block", *names)


def _counting_pass(rows: DataFrame, key: str, shift: int, width: int, per_block: int) -> DataFrame:
    digit = F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << width) - 1)).alias("digit")
    dealt = rows.select("*", digit)
    counts = dealt.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n"))
    # At most 2 ** DIGIT_BITS rows, so one task for them is enough.
    below = counts.groupBy("digit").agg(F.sum("n").alias("n")).select(
        "digit", (F.sum("n").over(Window.orderBy("digit")) - F.col("n")).alias("below")
    )
    earlier = counts.select(
        "block", "digit", (F.sum("n").over(Window.partitionBy("digit").orderBy("block")) - F.col("n")).alias("earlier")
    )
    starts = earlier.join(F.broadcast(below), "digit").select("block", "digit", (F.col("below") + F.col("earlier")).alias("start"))
    within = F.row_number().over(Window.partitionBy("block", "digit").orderBy("place")) - 1
    moved = dealt.withColumn("within", within).join(starts, ["block", "digit"])
    place = F.col("start") + F.col("within")
    kept = [c for c in rows.columns if c not in ("place", "block")]
    return staged(moved.select(*kept, place.alias("place"), F.floor(place / per_block).cast("long").alias("block")), "radix-pass")
