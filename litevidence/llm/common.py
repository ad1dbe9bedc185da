"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litevidence.sources.writers import staged

__all__ = ["chunks", "crc_fold", "documents", "hash_sample", "mix64", "pages", "releasing", "staged", "table", "text_or_empty", "wrapped"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def releasing(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives freed memory back when it ends, as workers are kept between tasks and stages."""

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return run


def wrapped(rows: DataFrame) -> DataFrame:
    """All columns as one struct `row`, so that columns added beside it clash with none; `row.*` unwraps it."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))


def hash_sample(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """All rows if there are at most n, else about n of them, chosen by a hash of their key where they are."""
    total = rows.count()
    if total <= n:
        return rows
    return rows.where(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < int(n / total * (1 << 30)))


def crc_fold(key: str, folds: int) -> Column:
    """The fold of a row: crc32 of its key as text, modulo the number of folds; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: list[str], chars: int) -> Iterator[slice]:
    """Slices of a batch that hold about so many characters each, one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield slice(start, i)
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield slice(start, len(texts))
