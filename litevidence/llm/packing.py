"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Every document is encoded; one longer than a sequence is cut into full pieces and a rest. Pieces are dealt by a
hash of their key into shards of bounded size, and each shard is packed on its own: a sequence is filled greedily
with the longest piece that still fits; then its smallest piece gives way to the two unpacked pieces that fill
its room together with the gap most tightly, if they fill more. A shard holds thousands of pieces, so at most its
last few sequences are not full for want of partners.

A shard is packed from the counts of pieces by length, so its work hardly depends on copies or hot sources.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litevidence.llm.common import releasing, staged, text_or_empty
from litevidence.llm.tokens import encoder

CAPACITY = 2048
SHARD_PIECES = 16_384   # documents of a shard, on average
SLICE_ROWS = 256        # documents encoded at once
KEPT_BYTES = 24 << 20   # of a generation of pieces a process keeps, as workers of earlier stages have grown
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PACKED = PIECES + ", sequence_id long, offset long"


def _best_pair(lengths: np.ndarray, left: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is the largest within `room`; of several the one with the longest piece."""
    have = lengths[left[lengths] > 0]
    have = have[have < room]
    if not len(have):
        return None
    # Partner: the longest available that fits beside the first.
    at = np.searchsorted(have, room - have, side="right") - 1
    same = (at >= 0) & (have[np.maximum(at, 0)] == have) & (left[have] < 2)
    at = np.where(same, at - 1, at)
    total = np.where(at >= 0, have + have[np.maximum(at, 0)], -1)
    best = int(len(total) - 1 - total[::-1].argmax())
    return (int(have[best]), int(have[at[best]])) if total[best] > 0 else None


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences as lists of lengths. Lengths are from 1 to the capacity."""
    left = np.bincount(lengths, minlength=capacity + 1)
    kinds = sorted(set(lengths.tolist()))   # lengths of which some are unpacked
    out = []

    def take(length: int) -> None:
        left[length] -= 1
        if not left[length]:
            kinds.pop(bisect_right(kinds, length) - 1)

    while kinds:
        held, gap = [], capacity
        while (at := bisect_right(kinds, gap)) and gap:
            length = kinds[at - 1]
            take(length)
            held.append(length)
            gap -= length
        if gap and len(held) > 1:
            smallest = held[-1]
            pair = _best_pair(np.array(kinds, dtype=np.int64), left, gap + smallest)
            if pair and sum(pair) > smallest:
                held.pop()
                if not left[smallest]:
                    kinds.insert(bisect_right(kinds, smallest), smallest)
                left[smallest] += 1
                for length in pair:
                    take(length)
                    held.append(length)
        out.append(held)
    return out


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut after each `capacity` of them."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, KEPT_BYTES).encode
        for batch in batches:
            # A few texts at a time are made Python strings, not the whole batch.
            for first in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(first, SLICE_ROWS)
                cuts = []
                for key, text in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True):
                    ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        cuts.append((key, k, at, len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(zip(*cuts, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA
                )

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(releasing(pieces), PIECES)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    capacity: int = CAPACITY,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Takes any table with doc_id and text; other columns are not read. Null text counts as empty: such a document
    is one piece that holds the end id. Rows with the same or no doc_id are documents of their own. Pieces are numbered where
    they are written and dealt to shards of about `shard_pieces` by a hash of the number, so a shard is bounded however many
    rows are equal or long. An empty table gives no rows.
    """
    cuts = staged(cut(docs, tokenizer_path, end_id, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-cuts.count() // shard_pieces))

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy()
        free = np.searchsorted(lengths, np.arange(capacity + 2))   # next unpacked row of each length
        sequence, offset = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        for i, held in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for length in held:
                row = free[length]
                free[length] += 1
                sequence[row], offset[row] = (int(key[0]) << 32) + i, at
                at += length
        return rows.assign(sequence_id=sequence, offset=offset)[
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        ]

    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    return cuts.groupBy(shard.alias("shard")).applyInPandas(packed, PACKED)
