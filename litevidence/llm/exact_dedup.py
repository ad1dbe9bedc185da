"""Exact deduplication by naming blocks.

A text is cut into blocks of a fixed number of bytes. All blocks are sorted and every distinct block gets an
integer name. Then, round by round, adjacent names are paired and every distinct pair gets an integer name,
until one name is left of each text. Two texts are equal if and only if they have as many blocks and the same
last name: names are given to contents and pairs themselves, never to digests of them.

Blocks travel once. A block is looked up by a 128-bit digest, and the sort that gives the names also compares
all blocks of a digest; if two differ, the whole step is repeated with another seed, so digests only carry
names and never decide. From then on rows hold integers.

The rounds grow with the logarithm of the longest text. Copies are combined before every shuffle, and the
joins that hand out names have one row per name on the right, so a group that holds a third of all rows is
split by adaptive execution.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litevidence.llm.common import staged, text_or_empty, wrapped

BLOCK_BYTES = 4096


def _blocks(text: Column, size: int) -> Column:
    raw = text.cast("binary")
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(text) / size) - 1)
    return F.transform(
        F.sequence(F.lit(0).cast("long"), last.cast("long")),
        lambda i: raw.substr((i * size + 1).cast("int"), F.lit(size)),
    )


def _digest(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), block).alias("a"), F.xxhash64(F.lit(~seed), block).alias("b"))


def _numbered(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Distinct contents in sorted order with an integer each, written so that the integers last."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def block_names(texts: DataFrame, size: int, seed: int) -> DataFrame | None:
    """Digest and integer name of every distinct block; None if one digest stands for two contents."""
    block = texts.select(F.explode(_blocks(F.col("text"), size)).alias("block"))
    named = (
        block.select("block", _digest(F.col("block"), seed).alias("d"))
        .groupBy("d.a", "d.b")
        .agg(F.min("block").alias("low"), F.max("block").alias("high"))
    )
    names = staged(
        _numbered(named, ["low"]).select("a", "b", "name", (F.col("low") != F.col("high")).alias("clash")),
        "block-names",
    )
    return None if not names.where("clash").isEmpty() else names.drop("clash")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Takes any table with doc_id and text; other columns are not read. Null text counts as empty, and empty
    texts are equal. Of equal texts the row with the largest doc_id stays (a null doc_id is smaller than any
    other); of rows that are equal in both, exactly one. An empty table gives no rows.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    for tried in count(seed):
        rows = staged(
            texts.select(
                F.monotonically_increasing_id().alias("row"),
                "doc_id",
                F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
                F.transform(_blocks(F.col("text"), block_bytes), lambda b: _digest(b, tried)).alias("digests"),
            ).withColumn("blocks", F.size("digests")),
            "block-digests",
        )
        names = block_names(texts, block_bytes, tried)
        if names is not None:
            break

    place = rows.select("row", "blocks", F.posexplode("digests").alias("place", "d"))
    level = place.select("row", "blocks", "place", "d.a", "d.b").join(names, ["a", "b"])
    level = level.select("row", "blocks", F.col("blocks").alias("left"), "place", "name")
    done = [staged(level.where("left = 1").select("row", "blocks", "name"), "identities")]
    longest = rows.agg(F.max("blocks")).first()[0] or 1
    level = level.where("left > 1")
    while longest > 1:
        pairs = staged(
            level.groupBy("row", "blocks", "left", F.shiftright("place", 1).alias("place")).agg(
                F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("first"),
                # The last block of an odd number stands alone.
                F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"),
            ),
            "name-pairs",
        )
        names = staged(_numbered(pairs.select("first", "second").distinct(), ["first", "second"]), "pair-names")
        level = pairs.join(names, ["first", "second"]).select(
            "row", "blocks", F.shiftright(F.col("left") + 1, 1).alias("left"), "place", "name"
        )
        done.append(level.where("left = 1").select("row", "blocks", "name"))
        level = level.where("left > 1")
        longest = (longest + 1) // 2

    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    identity = staged(rows.select("row", "doc_id", "text_sha256").join(identity, "row"), "named-documents")
    groups = identity.groupBy("blocks", "name").agg(
        F.max(F.struct("doc_id", (-F.col("row")).alias("row"))).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    # Written, so that the join has an exchange of its own on either side and a large group can be split.
    groups = staged(groups, "groups")
    return identity.join(groups, ["blocks", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("keep.row")).alias("kept"),
        "text_sha256",
    )


def without_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns; of rows equal in doc_id and text one stays."""
    sha = F.sha2(text_or_empty("row.text").cast("binary"), 256)
    kept = (
        exact_duplicates(docs, **options)
        .groupBy("doc_id", "text_sha256")
        .agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows"))
        .where("stays")
    )
    found = wrapped(docs).join(kept, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (sha == F.col("text_sha256")))
    once = found.where("rows = 1").select("row.*")
    repeated = found.where("rows > 1").dropDuplicates(["doc_id", "text_sha256"]).select("row.*")
    return once.union(repeated)
