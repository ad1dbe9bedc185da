"""Resampling of documents towards a target distribution of words.

Features (runs of words) are hashed into buckets. Counts of the buckets over all documents and over the target
texts give an array of gains, one per bucket; a document's weight is the sum over its features. Gumbel noise from
a hash of the doc_id turns the highest scores into a draw without replacement in proportion to the weights' exponentials.
The scores are ranked by a distributed radix sort (`radix.py`).
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litevidence.llm.common import staged
from litevidence.llm.radix import ascending, descending, null_last, radix_ranked

BUCKETS = 10_000
LONGEST = 1            # words of a feature, at most
LEAST_WORDS = 20       # of a document that may be drawn
PERCENT = 10           # of those documents
SEED = 2024
_SLICE = 1 << 20       # bytes of a text that are cut into words at once
_KEPT_WORDS = 200_000  # whose buckets a process keeps
_KEPT_BYTES = 32       # of such a word, at most
# Digits, letters and all bytes of characters beyond ASCII are parts of words, A-Z as a-z; all else is a blank.
_WORD = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


class Buckets(dict):
    """The bucket of a feature; frequent features are kept, in bounded memory."""

    def __init__(self, n: int) -> None:
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        bucket = crc32(feature) % self.n
        if len(feature) <= _KEPT_BYTES:
            if len(self) >= _KEPT_WORDS:
                self.clear()
            self[feature] = bucket
        return bucket


def feature_buckets(text: bytes, buckets: Buckets, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words and buckets of the features of a text, a slice of it at a time."""
    text = text.translate(_WORD)
    start, carried = 0, []
    while start < len(text):
        end = text.find(b" ", start + _SLICE) if len(text) - start > _SLICE else -1
        end = len(text) if end < 0 else end
        new = text[start:end].split()
        found = list(map(buckets.__getitem__, new))
        if longest > 1:
            words = carried + new
            for n in range(2, longest + 1):
                # Runs that end in a new word; those before it were counted with the last slice.
                first = max(0, len(carried) - n + 1)
                found += [buckets[b" ".join(words[i : i + n])] for i in range(first, len(words) - n + 1)]
            carried = words[-(longest - 1) :]
        yield len(new), np.array(found, dtype=np.int64)
        start = end


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all rows in each bucket. One row per bucket comes to the driver."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    for _, found in feature_buckets(value.as_buffer().to_pybytes(), known, longest):
                        counts += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    rows = texts.select(F.col(text).cast("binary")).mapInArrow(tally, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and in the documents, rounded down."""
    n = float(len(raw))
    ratio = (target + 1.0) * (raw.sum() + n) / ((raw + 1.0) * (target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document; nulls and empty texts have no features."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        known = Buckets(len(gain))
        for batch in batches:
            words, features, weights = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for i, value in enumerate(batch.column(1)):
                if value.is_valid:
                    for n, found in feature_buckets(value.as_buffer().to_pybytes(), known, longest):
                        words[i] += n
                        features[i] += len(found)
                        weights[i] += gain[found].sum()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(features), pa.array(weights)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return columns.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank.

    `docs` has doc_id and text, `target` has text; other columns are not read. Null and empty texts have no words,
    weight 0 and are never drawn. Of the documents of at least `least_words` words, `percent` out of a hundred
    (rounded down) with the highest scores are drawn; their rank counts from 1, all others have null. Equal scores
    go by the smaller doc_id, a null doc_id comes last and counts as empty text in the hash; rows equal in doc_id
    and score are ranked one after the other in any order. Empty tables are allowed on either side.
    """
    gains = bucket_gains(bucket_counts(docs, "text", buckets, longest), bucket_counts(target, "text", buckets, longest))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = staged(weigh(docs, gains, longest).withColumn("score", F.col("weight") + noise), "scores")
    may = F.col("n_words") >= least_words
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = radix_ranked(scored.where(may).select(*columns), [descending_score(scored), null_last("doc_id"), ascending("doc_id")])
    drawn = scored.where(may).count() * percent // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return ranked.select(*columns, rank.alias("rank")).unionByName(
        scored.where(~may).select(*columns, F.lit(None).cast("long").alias("rank"))
    )


def descending_score(scored: DataFrame):
    """Scores lie close together around 0: counted down from the highest, they take fewer digits."""
    top = scored.agg(F.max("score")).first()[0]
    return F.lit(top if top is not None else 0).cast("long") - F.col("score")
