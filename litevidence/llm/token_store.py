"""A store of token ids with constant-time access by document key.

Layout, under one folder of any file system that Spark can write:

* `blocks/`   one row per block: shard, block, first (ids of the shard before the block), `ids`, the ids of
  consecutive documents as raw little-endian unsigned integers, of 2 or 4 bytes as the vocabulary asks, and a
  directory of its documents: doc_id, copy (0, 1, ... for rows with the same doc_id), offset and number of ids.
  Documents are in ascending doc_id order, shard after shard; none is split between blocks.
* `shards/`   shard, number of ids and the ids of all shards before it.
* `index/`    a minimal perfect hash of the keys: per bucket a seed, the displacements and, in slot order, a stored
  fingerprint of the key, shard, block, offset and number of ids. Keys have two 64-bit hashes: the first gives bucket and
  slot, the second is the fingerprint. Where two keys of a bucket share the first, a seed mixes in the second. A lookup reads one bucket, computes one slot,
  compares the fingerprint and reads one block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litevidence.llm.common import mix64, releasing, text_or_empty
from litevidence.llm.tokens import encoder
from litevidence.sources.writers import staged_path

BLOCK_IDS = 1 << 18       # ids after which a block ends
BUCKET_KEYS = 4096        # keys of a bucket, on average
GROUP_KEYS = 2            # keys that share a displacement, on average
_COLUMNS = ["shard", "block", "first", "n", "ids", "doc_ids", "copies", "offsets", "lengths"]
_BLOCKS = (
    "shard int, block int, first long, n long, ids binary, "
    "doc_ids array<long>, copies array<int>, offsets array<long>, lengths array<long>"
)


def _slot(hashes: np.ndarray, shift: np.ndarray, size: int) -> np.ndarray:
    return (mix64(hashes + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)


def build_bucket(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements of the groups and the slot of every key; hashes must differ.

    Groups are placed from the largest down; all groups of a size try one displacement after the other at a time, and
    those that meet no taken slot and no other group stay. A group of one key takes a free slot, noted as -1 - slot.
    """
    size = len(hashes)
    if len(np.unique(hashes)) < size:
        raise ValueError("hashes are not distinct")
    groups = -(-size // GROUP_KEYS)
    group = ((hashes >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    counts = np.diff(bounds)
    taken = np.zeros(size, dtype=bool)
    shifts, slots = np.zeros(groups, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for count in range(int(counts.max(initial=0)), 1, -1):
        left = np.flatnonzero(counts == count)
        shift = 0
        while len(left):
            members = order[bounds[left][:, None] + np.arange(count)]
            at = _slot(hashes[members], np.array(shift), size)
            ranked = np.sort(at, axis=1)
            good = ~taken[at].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            _, first = np.unique(at[good].ravel(), return_index=True)
            free = np.zeros(int(good.sum()) * count, dtype=bool)
            free[first] = True
            good[np.flatnonzero(good)[~free.reshape(-1, count).all(axis=1)]] = False
            shifts[left[good]], slots[members[good]] = shift, at[good]
            taken[at[good]] = True
            left = left[~good]
            shift += 1
    single = np.flatnonzero(counts == 1)
    slots[order[bounds[single]]] = np.flatnonzero(~taken)
    shifts[single] = -1 - np.flatnonzero(~taken)
    return shifts, slots


def seeded(first: np.ndarray, second: np.ndarray, seed: int) -> np.ndarray:
    """What slots are computed from: with seed 0 the first hash alone, else both."""
    return first if seed == 0 else mix64(first ^ mix64(second + np.uint64(seed)))


def seed_of(first: np.ndarray, second: np.ndarray) -> int:
    """The least seed by which all keys of a bucket differ; only keys that share all 128 bits are refused."""
    if len(np.unique(np.stack([first, second]), axis=1).T) < len(first):
        raise ValueError("two keys share 128 bits")
    seed = 0
    while len(np.unique(seeded(first, second, seed))) < len(first):
        seed += 1
    return seed


def find_slots(hashes: np.ndarray, shifts: np.ndarray, size: int) -> np.ndarray:
    """The slot of each hash by the displacements of its bucket, whether it is in the bucket or not."""
    shift = shifts[((hashes >> np.uint64(32)) % np.uint64(len(shifts))).astype(np.int64)]
    return np.where(shift < 0, -1 - shift, _slot(hashes, np.maximum(shift, 0), size))


def _blocks(docs: DataFrame, tokenizer_path: str, end_id: int, width: int, block_ids: int) -> DataFrame:
    """Blocks of a table that is in order; a partition is a shard."""
    kind = np.dtype(f"<u{width}")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path).encode
        shard = TaskContext.get().partitionId()
        block, first, size, last, copy = 0, 0, 0, (), 0
        ids, entries = [], []

        def closed() -> pd.DataFrame:
            directory = (list(x) for x in zip(*entries, strict=True))
            return pd.DataFrame([(shard, block, first, size, b"".join(ids), *directory)], columns=_COLUMNS)

        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                key = None if pd.isna(key) else int(key)
                copy = copy + 1 if (key,) == last else 0
                last = (key,)
                own = np.append(encode(text), np.uint32(end_id))
                ids.append(own.astype(kind).tobytes())
                entries.append((key, copy, size, len(own)))
                size += len(own)
                if size >= block_ids:
                    yield closed()
                    block, first, size, ids, entries = block + 1, first + size, 0, [], []
        if entries:
            yield closed()

    return docs.mapInPandas(releasing(blocks), _BLOCKS)


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 1,
    width: int | None = None,
    block_ids: int = BLOCK_IDS,
    bucket_keys: int = BUCKET_KEYS,
) -> None:
    """Encode all documents and write them as a store.

    Takes any table with doc_id and text. Null text counts as empty; such a document holds the end id alone.
    `width` is the bytes of an id, by default as many as the vocabulary needs; fewer are refused. Null doc_ids come first. Rows of one doc_id follow
    each other in an order that depends on their text only; one task reads them one after the other, however many there
    are, and holds one block of them.
    """
    spark = docs.sparkSession
    least = 2 if max(encoder(tokenizer_path).largest, end_id) < 1 << 16 else 4
    width = width or least
    if width < least:
        raise ValueError(f"ids of this vocabulary need {least} bytes")
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    ordered = (
        texts.repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.octet_length("text"))
    )
    written = _blocks(ordered, tokenizer_path, end_id, width, block_ids)
    written.write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = _read_blocks(spark, path)
    totals = blocks.groupBy("shard").agg(F.sum("n").alias("n"))
    totals = totals.withColumn("before", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    totals.select("shard", "n", F.coalesce("before", F.lit(0)).alias("before")).write.parquet(f"{path}/shards")

    n_buckets = max(1, -(-blocks.agg(F.sum(F.size("doc_ids"))).first()[0] // bucket_keys)) if not blocks.isEmpty() else 1
    spark.createDataFrame([(n_buckets, width)], "buckets long, width int").write.parquet(f"{path}/meta")
    keyed = blocks.select(
        "shard", "block", F.explode(F.arrays_zip("doc_ids", "copies", "offsets", "lengths")).alias("e")
    ).select(
        F.col("e.doc_ids").alias("doc_id"), F.col("e.copies").alias("copy"), "shard", "block",
        F.col("e.offsets").alias("offset"), F.col("e.lengths").alias("n"),
    )
    _with_bucket(keyed, n_buckets).groupBy("bucket").applyInPandas(
        _indexed, "bucket long, seed long, shifts array<long>, prints array<long>, shards array<int>, blocks array<int>, "
        "offsets array<long>, lengths array<long>"
    ).write.parquet(f"{path}/index")


def _read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")


def _with_bucket(keys: DataFrame, n_buckets: int) -> DataFrame:
    """Adds the key's two hashes and its bucket."""
    key = (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "copy")
    found = keys.withColumns({"hash": F.xxhash64(*key), "print": F.xxhash64(F.lit("print"), *key)})
    return found.withColumn("bucket", F.pmod("hash", F.lit(n_buckets)))


def _indexed(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["hash", "print"])
    hashes, prints = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("hash", "print"))
    seed = seed_of(hashes, prints)
    shifts, slots = build_bucket(seeded(hashes, prints, seed))
    placed = rows.iloc[np.argsort(slots)]
    return pd.DataFrame([{
        "bucket": rows["bucket"].iloc[0], "seed": seed, "shifts": shifts, "prints": placed["print"].to_numpy(),
        "shards": placed["shard"].to_numpy(), "blocks": placed["block"].to_numpy(), "offsets": placed["offset"].to_numpy(),
        "lengths": placed["n"].to_numpy(),
    }])


def locate(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Places of (doc_id, copy) keys by the index: the keys with shard, block, offset and n; unknown keys go."""
    meta = spark.read.parquet(f"{path}/meta").first()
    grouped = _with_bucket(keys.select("doc_id", "copy"), meta["buckets"])
    index = spark.read.parquet(f"{path}/index")

    def looked_up(found: pd.DataFrame, bucket: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "copy", "shard", "block", "offset", "n"]
        if found.empty or bucket.empty:
            return pd.DataFrame({c: pd.Series(dtype="Int64") for c in columns})
        own = bucket.iloc[0]
        hashes, prints = (found[c].to_numpy(np.int64).view(np.uint64) for c in ("hash", "print"))
        slot = find_slots(seeded(hashes, prints, int(own["seed"])), np.asarray(own["shifts"]), len(own["prints"]))
        known = np.asarray(own["prints"])[slot] == found["print"].to_numpy(np.int64)
        out = pd.DataFrame({"doc_id": found["doc_id"].astype("Int64"), "copy": found["copy"]})
        for name, field in (("shard", "shards"), ("block", "blocks"), ("offset", "offsets"), ("n", "lengths")):
            out[name] = np.asarray(own[field])[slot]
        return out[known]

    return grouped.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(
        looked_up, "doc_id long, copy int, shard int, block int, offset long, n long"
    )


def read_ids(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The ids of some keys, by index and block: doc_id, copy, ids (binary, as stored)."""
    places = locate(spark, path, keys)
    blocks = _read_blocks(spark, path).select("shard", "block", "ids")
    width = spark.read.parquet(f"{path}/meta").first()["width"]
    part = F.col("ids").substr((F.col("offset") * width + 1).cast("int"), (F.col("n") * width).cast("int"))
    return places.join(blocks, ["shard", "block"]).select("doc_id", "copy", part.alias("ids"))


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """Every document as the files hold it: doc_id, start, n_tokens, ids_crc32, copy.

    One scan of the blocks takes up the ids of each document; the index locates every key; a row is given for
    each key that has a document at its place. Only keys, places and checksums are shuffled, never ids.
    """
    width = spark.read.parquet(f"{path}/meta").first()["width"]
    kind = np.dtype(f"<u{width}")
    blocks = _read_blocks(spark, path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                ids = np.frombuffer(row.ids, dtype=kind).astype("<u4")
                for at, n in zip(row.offsets, row.lengths, strict=True):
                    rows.append((row.shard, row.block, at, row.first + at, n, zlib.crc32(ids[at : at + n].tobytes())))
            yield pd.DataFrame(rows, columns=["shard", "block", "offset", "start", "n", "ids_crc32"])

    found = blocks.select("shard", "block", "first", "ids", "offsets", "lengths").mapInPandas(
        read, "shard int, block int, offset long, start long, n long, ids_crc32 long"
    )
    keys = blocks.select(F.explode(F.arrays_zip("doc_ids", "copies")).alias("e")).select(
        F.col("e.doc_ids").alias("doc_id"), F.col("e.copies").alias("copy")
    )
    before = spark.read.parquet(f"{path}/shards").select("shard", "before")
    return locate(spark, path, keys).join(found, ["shard", "block", "offset", "n"]).join(before, "shard").select(
        "doc_id", (F.col("before") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32", "copy"
    )


def store_folder(spark: SparkSession) -> str:
    """A new folder; `drop_staged` removes it."""
    return staged_path(spark, "token-store")
