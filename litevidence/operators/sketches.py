"""Summaries that add up: heavy hitters with a proof, distinct counts that are kept and merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litevidence.functions.text import split_items
from litevidence.sources.writers import staged

WIDTH = 1 << 16       # counters of a term sketch
HLL_BITS = 14         # of an HLL sketch: 16,384 registers


def _counter(term: str, width: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(width))


def term_sketch(terms: DataFrame, term: str = "term", width: int = WIDTH) -> DataFrame:
    """counter, n: occurrences of all terms that share a counter. Sketches of two corpora are summed by counter."""
    return terms.groupBy(_counter(term, width).alias("counter")).agg(F.count(F.lit(1)).alias("n"))


def frequent_terms(rows: DataFrame, column: str, k: int, delimiter: str = ",", width: int = WIDTH, sketch: DataFrame | None = None) -> DataFrame:
    """The k most frequent members of a delimited column, equal counts in alphabetical order: term, n.

    No count of all terms is made. A counter's number bounds each of its terms, so only the terms of the highest counters are
    counted exactly; once the k-th of them is above every other counter, none can have been missed. Until then four times as many
    counters are taken. `sketch` may be a kept `term_sketch` of the same terms. Null values have no members; fewer than k
    terms are all returned.
    """
    terms = rows.select(F.explode(split_items(column, delimiter)).alias("term"))
    counters = staged(term_sketch(terms, width=width) if sketch is None else sketch, "term-sketch")
    taken = 4 * k
    while True:
        highest = counters.orderBy(F.desc("n"), "counter").limit(taken)
        chosen = staged(highest, "highest-counters")   # at most `width` rows
        rest = counters.join(chosen, "counter", "left_anti").agg(F.max("n")).first()[0]
        counted = terms.withColumn("counter", _counter("term", width)).join(chosen.select("counter"), "counter", "left_semi")
        found = staged(counted.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(k), "frequent")
        size, least = found.agg(F.count(F.lit(1)), F.min("n")).first()
        if rest is None or (size == k and least > rest):
            return found.orderBy(F.desc("n"), "term")
        taken *= 4


def distinct_sketches(rows: DataFrame, keys: Sequence[str], column: str, bits: int = HLL_BITS) -> DataFrame:
    """The keys and `sketch`, a fixed number of bytes that stands for the distinct values of a column; nulls do not count."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(column, F.lit(bits)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Estimates over fewer keys (or none) from kept sketches: values that several of them hold count once.

    With the default number of bits, two in three estimates are within 0.8 %.
    """
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))
