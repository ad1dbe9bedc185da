"""Counts and tables that describe a corpus, a subset or a dictionary."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litevidence.sources.writers import staged


def distinct_counts(rows: DataFrame, counts: Mapping[str, Sequence[str]]) -> DataFrame:
    """Several distinct counts in one pass: output name -> columns. Rows missing any of them do not count.

    Values are counted by a digest of 16 bytes and long texts go no further, as each row is shuffled once for each count.
    """
    digests = {}
    for name, cols in counts.items():
        missing = reduce(Column.__or__, [F.col(c).isNull() for c in cols])
        digests[name] = F.when(~missing, F.unhex(F.md5(F.to_json(F.struct(*cols)).cast("binary"))))
    narrow = rows.select(*[value.alias(name) for name, value in digests.items()])
    return narrow.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(name).alias(name) for name in digests]
    )


def distinct_per(rows: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Distinct values of a column per key, most first is left to the caller."""
    return rows.groupBy(*keys).agg(F.count_distinct(column).alias(name))


def count_per(rows: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Rows with a value in `column` per key, keys with a missing part left out."""
    return rows.dropna("any", subset=list(keys)).groupBy(*keys).agg(F.count(column).alias(name))


def coverage(rows: DataFrame, classes: Mapping[str, Column], columns: Sequence[str]) -> DataFrame:
    """Distinct key tuples of each, possibly overlapping, class of rows in one pass.

    Rows are reduced to one per tuple with a mark for each class, so none is copied.
    """
    marked = rows.groupBy(*columns).agg(
        *[F.max(F.coalesce(condition, F.lit(False))).alias(name) for name, condition in classes.items()]
    )
    return marked.agg(*[F.count_if(F.col(name)).alias(name) for name in classes])


def pivot_counts(
    counts: DataFrame, row: str, column: str, value: str, columns: Collection[str], mean: bool = False
) -> DataFrame:
    """Counts as a table with one column per listed value, summed or as their mean; absent cells are null.

    Values that are not listed come together in the column `other`, so no count is lost; a listed value
    must not have that name.
    """
    if "other" in columns:
        raise ValueError("`other` is the column of values that are not listed")
    listed = F.when(F.col(column).isin(*columns), F.col(column)).otherwise(F.lit("other"))
    cells = counts.withColumn(column, listed).groupBy(row).pivot(column, [*columns, "other"])
    return cells.agg(F.avg(value) if mean else F.sum(value))


def histogram_text(
    rows: DataFrame, keys: Sequence[str], item: str, name: str, total: str
) -> DataFrame:
    """`item[count], ...` per key and the number of rows; counted before the items come together."""
    counted = rows.groupBy(*keys, item).agg(F.count(item).alias("_n"))
    text = F.concat(F.col(item), F.lit("["), F.col("_n").cast("string"), F.lit("]"))
    return (
        counted.groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_list(text)), ", ").alias(name), F.sum("_n").alias(total))
        .where(F.col(total) > 0)
    )


def _quoted(delimiter: str) -> str:
    """A pattern that matches the delimiter itself."""
    return re.escape(delimiter)


def top_terms(rows: DataFrame, column: str, k: int, delimiter: str = ",") -> DataFrame:
    """The k most frequent members of a delimited column; equal counts in alphabetical order."""
    return (
        rows.select(F.explode(F.split(column, _quoted(delimiter))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "term")
        .limit(k)
    )


def members(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The distinct values of a column per key, one row each: the form for sets of any size."""
    return rows.select(*keys, column).where(F.col(column).isNotNull()).distinct()


def listing(rows: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """`members` sorted and comma-joined in one cell per key, for export; a cell must fit in memory."""
    return (
        members(rows, keys, column)
        .groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_list(column)), ", ").alias(name))
    )


def class_bitmaps(rows: DataFrame, columns: Sequence[str], classes: Mapping[str, Column]) -> DataFrame:
    """class, bucket, bitmap: which distinct key tuples belong to each, possibly overlapping, class.

    Tuples get integers that are dense within the tasks that number them, so a bitmap of 4 KB stands for up to 32,768 of them.
    The table is a state: bitmaps of other classes over the same numbering add rows to it, and any union of classes
    is counted from it without the rows.
    """
    marked = rows.groupBy(*columns).agg(
        *[F.max(F.coalesce(condition, F.lit(False))).alias(f"in_{i}") for i, condition in enumerate(classes.values())]
    )
    numbered = staged(marked.select(F.monotonically_increasing_id().alias("id"), *[f"in_{i}" for i in range(len(classes))]), "numbered")
    held = F.array_compact(F.array(*[F.when(F.col(f"in_{i}"), F.lit(name)) for i, name in enumerate(classes)]))
    return (
        numbered.select("id", F.explode(held).alias("class"))
        .groupBy("class", F.expr("bitmap_bucket_number(id)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(id))").alias("bitmap"))
    )


def union_counts(bitmaps: DataFrame, unions: Mapping[str, Sequence[str]]) -> DataFrame:
    """union, n: exact numbers of tuples that are in any of the classes of each union; 0 for none.

    Bitmaps are joined bucket by bucket, in part before the shuffle.
    """
    names = F.map_from_arrays(
        F.array(*[F.lit(c) for c in sorted({c for own in unions.values() for c in own})]),
        F.array(*[F.array(*[F.lit(u) for u, own in unions.items() if c in own]) for c in sorted({c for own in unions.values() for c in own})]),
    )
    dealt = bitmaps.select(F.explode(F.element_at(names, F.col("class"))).alias("union"), "bucket", "bitmap")
    joined = dealt.groupBy("union", "bucket").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))
    counted = joined.groupBy("union").agg(F.sum(F.expr("bitmap_count(bitmap)")).alias("n"))
    listed = bitmaps.sparkSession.createDataFrame([(u,) for u in unions], "union string")
    return listed.join(counted, "union", "left").select("union", F.coalesce("n", F.lit(0)).alias("n"))


def dense_ids(rows: DataFrame, column: str, name: str) -> DataFrame:
    """The distinct values of a column and their place in sorted order, from 0, without bringing them to one task."""
    distinct = rows.select(column).where(F.col(column).isNotNull()).distinct()
    spread = staged(
        distinct.repartitionByRange(column).sortWithinPartitions(column).withColumn("_id", F.monotonically_increasing_id()), "ordered"
    ).withColumn("_part", F.shiftright("_id", 33))
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))   # a row per partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return spread.join(F.broadcast(before), "_part").select(column, place.alias(name))


def pivot_blocks(counts: DataFrame, row: str, column: str, value: str, width: int = 256) -> tuple[DataFrame, DataFrame]:
    """A pivot with any number of columns: its cells in blocks, and the dictionary of its columns.

    Cells are (row, block, cells): `cells[i]` is the sum for the column of id block * width + i, null where there
    is none; blocks of a row without any value are left out. The dictionary has each column's value, `id`, `block` and `place`.
    Neither the columns nor a whole row is ever in one place: a block is an array of `width` numbers.
    """
    ids = staged(dense_ids(counts, column, "id"), "pivot-columns")
    names = ids.select(column, "id", F.floor(F.col("id") / width).alias("block"), F.pmod("id", F.lit(width)).cast("int").alias("place"))
    cells = counts.join(names, column).groupBy(row, "block", "place").agg(F.sum(value).alias("_v"))
    held = cells.groupBy(row, "block").agg(F.array_sort(F.collect_list(F.struct("place", "_v"))).alias("_held"))
    return held.select(row, "block", _spread("_held", width).alias("cells")), names


def _spread(held: str, width: int) -> Column:
    """An array of `width` values from sorted (place, _v), null between them. Work is done for each value held, not for each place."""
    none = F.lit(None).cast("long")
    before = lambda i: F.coalesce(F.get(held, i - 1)["place"], F.lit(-1))
    parts = F.transform(held, lambda e, i: F.concat(F.array_repeat(none, e["place"] - before(i) - 1), F.array(e["_v"])))
    return F.concat(F.flatten(parts), F.array_repeat(none, width - 1 - F.element_at(held, -1)["place"]))


def pivot_columns(blocks: DataFrame, names: DataFrame, row: str, column: str, wanted: Sequence[str]) -> DataFrame:
    """Some columns of a pivot in blocks under their own names, for all rows that have any of them."""
    listed = names.where(F.col(column).isin(*wanted))
    found = blocks.join(F.broadcast(listed), "block").select(row, column, F.get("cells", F.col("place")).alias("_v"))
    return found.where(F.col("_v").isNotNull()).groupBy(row).pivot(column, list(wanted)).agg(F.first("_v"))
