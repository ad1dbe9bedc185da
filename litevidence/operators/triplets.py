"""Compound-target-disease triplets of entities that occur in one sentence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litevidence.operators.skew import CELL_PRODUCT, grid_join
from litevidence.sources.writers import staged

ENTITY_TYPES = ("CD", "GP", "DS")  # compound, gene/protein, disease
SENTENCE = ("pmid", "sentence", "date", "section")

GATHERED = 50_000      # mentions of an article that may come together in the rows of its sentences


def _ids_of(kind: str, value: str) -> Column:
    return F.when(F.col("entity_type") == kind, F.col(value))


def sentence_entities(
    mentions: DataFrame, keys: Sequence[str] = SENTENCE, value: str = "label_id"
) -> DataFrame:
    """One row per sentence with the distinct ids of each entity type as an array."""
    return mentions.groupBy(*keys).agg(
        *[F.collect_set(_ids_of(kind, value)).alias(kind) for kind in ENTITY_TYPES]
    )


def busy_articles(
    mentions: DataFrame, article: str = "pmid", max_product: int = CELL_PRODUCT, gathered: int = GATHERED
) -> DataFrame:
    """Articles that may hold a sentence with too many triplets for one task, or too many ids for one row.

    The product of an article's mentions of each type bounds the triplets of each of its sentences. Counts
    are combined before the shuffle.
    """
    of_kind = [F.count_if(F.col("entity_type") == kind) for kind in ENTITY_TYPES]
    product = reduce(Column.__mul__, [F.greatest(F.lit(1), n).cast("double") for n in of_kind])
    return (
        mentions.groupBy(article)
        .agg(product.alias("_product"), F.count(F.lit(1)).alias("_n"))
        .where((F.col("_product") > max_product) | (F.col("_n") > gathered))
        .select(article)
    )


def extract_triplets(
    mentions: DataFrame,
    keys: Sequence[str] = SENTENCE,
    value: str = "label_id",
    outer: bool = False,
    article: str = "pmid",
    counted: DataFrame | None = None,
    max_product: int = CELL_PRODUCT,
    gathered: int = GATHERED,
) -> DataFrame:
    """All CD x GP x DS combinations of each sentence.

    Inner form: sentences that lack a type give nothing. Outer form: a missing type leaves a null slot, and a
    sentence with entities of other types only is a row of empty slots.
    `value` chooses between ids (`label_id`) and names (`label`). Copies in `mentions` do no harm.

    Sentences of ordinary articles are gathered with one shuffle. Busy articles take the other way:
    their distinct entities are joined cell by cell, so that no sentence is ever held in one row and no task
    makes more than about `max_product` triplets of a sentence. Starts jobs when called: mentions are counted by
    article and type; `counted` may be a table with these two columns and a row per mention from which that
    is cheaper than from `mentions`.
    """
    keys = list(keys)
    known = mentions.select(*keys, "entity_type", value).dropna("any", subset=keys)
    if not outer:
        known = known.where(F.col("entity_type").isin(*ENTITY_TYPES))
    busy = staged(
        busy_articles(mentions if counted is None else counted, article, max_product, gathered), "busy-articles"
    )
    if busy.isEmpty():
        return _gathered(known, keys, value, outer)
    usual = _gathered(known.join(busy, article, "left_anti"), keys, value, outer)
    return usual.unionByName(
        _crossed(known.join(busy, article, "left_semi"), keys, value, outer, max_product)
    )


def _gathered(mentions: DataFrame, keys: list[str], value: str, outer: bool) -> DataFrame:
    sentences = sentence_entities(mentions, keys, value)
    if not outer:
        for kind in ENTITY_TYPES:
            sentences = sentences.where(F.size(kind) > 0)
    unnest = F.explode_outer if outer else F.explode
    for kind in ENTITY_TYPES:
        sentences = sentences.withColumn(kind, unnest(kind))
    return sentences


def _crossed(mentions: DataFrame, keys: list[str], value: str, outer: bool, max_product: int) -> DataFrame:
    entities = staged(mentions.distinct(), "busy-entities")
    named = entities.where(F.col(value).isNotNull())
    sides = [
        named.where(F.col("entity_type") == kind).select(*keys, F.col(value).alias(kind))
        for kind in ENTITY_TYPES
    ]
    if not outer:
        return grid_join(sides, keys, "inner", max_product)
    slot = F.when(F.col("entity_type").isin(*ENTITY_TYPES), F.col(value))
    unnamed = entities.groupBy(*keys).agg(F.count(slot).alias("_n")).where(F.col("_n") == 0)
    return grid_join(sides, keys, "full_outer", max_product).unionByName(
        unnamed.select(*keys, *[F.lit(None).cast("string").alias(kind) for kind in ENTITY_TYPES])
    )


def triplet_counts(triplets: DataFrame) -> DataFrame:
    """How often, and in how many articles, each compound-target-disease triplet occurs."""
    return triplets.groupBy(*ENTITY_TYPES).agg(
        F.count(F.lit(1)).alias("n_triplets"), F.count_distinct("pmid").alias("n_articles")
    )
