"""Comparing a curated set of triplets or sentences with an extracted one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litevidence.operators.skew import CELL_PRODUCT, grid_join

PAIR = ("CD", "GP")


def compare_triplets(
    extracted: DataFrame, curated: DataFrame, max_product: int = CELL_PRODUCT
) -> DataFrame:
    """Extracted and curated triplets of the same (CD, GP): the diseases side by side.

    All other columns get the suffix _x (extracted) or _y (curated). Both inputs hold distinct rows and are
    written tables, as their keys are counted. No task forms more than about `max_product` row pairs of a key.
    """
    left = _suffixed(extracted, "_x")
    right = _suffixed(curated, "_y")
    return grid_join([left, right], PAIR, "inner", max_product)


def pair_agreement(extracted: DataFrame, curated: DataFrame) -> DataFrame:
    """Per (CD, GP) found in both: rows on either side, row pairs, and row pairs with the same disease.

    Works on counts per disease, so no pair of rows is formed.
    """
    left = extracted.groupBy(*PAIR, "DS").agg(F.count(F.lit(1)).alias("n_x"))
    right = curated.groupBy(*PAIR, "DS").agg(F.count(F.lit(1)).alias("n_y"))
    sides = left.join(right, [*PAIR, "DS"], "full_outer").fillna(0, ["n_x", "n_y"])
    return (
        sides.groupBy(*PAIR)
        .agg(
            F.sum("n_x").alias("n_extracted"),
            F.sum("n_y").alias("n_curated"),
            F.sum(F.col("n_x") * F.col("n_y")).alias("n_same_disease"),
        )
        .where((F.col("n_extracted") > 0) & (F.col("n_curated") > 0))
        .withColumn("n_pairs", F.col("n_extracted") * F.col("n_curated"))
    )


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both. Copies go first, so a value with very many copies does not burden a task."""
    return a.distinct().intersect(b.distinct())


def only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of the first table that the second lacks."""
    return a.distinct().subtract(b.distinct())


def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """How many distinct values are in the first table only, the second only, and both; one pass."""
    value = F.unhex(F.sha2(F.col(column).cast("binary"), 256)).alias("value")  # long texts are not shuffled
    sides = a.select(value, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(
        b.select(value, F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    )
    merged = sides.groupBy("value").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return merged.agg(
        F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 0)).alias("only_first"),
        F.count_if((F.col("in_a") == 0) & (F.col("in_b") == 1)).alias("only_second"),
        F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 1)).alias("both"),
    )


def _suffixed(rows: DataFrame, suffix: str) -> DataFrame:
    return rows.select(
        *[F.col(c) if c in PAIR else F.col(c).alias(f"{c}{suffix}") for c in rows.columns]
    )
