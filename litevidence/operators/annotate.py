"""Therapeutic area, clinical phase and article type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litevidence.functions.areas import flat_areas, preferred_area
from litevidence.functions.articles import (
    article_label, detailed_label, detailed_title, detailed_types, is_review,
)
from litevidence.functions.text import trimmed_id
from litevidence.operators.evidence import PAIR


def attach_areas(triplets: DataFrame, disease: DataFrame) -> DataFrame:
    """Adds disease name, area ids as `a|b` text, and the preferred area."""
    terms = disease.select(F.col("id").alias("diseaseId"), "name", "therapeuticAreas").distinct()
    return (
        triplets.join(terms, ["diseaseId"], "left")
        .withColumn("preferredArea", preferred_area("therapeuticAreas"))
        .withColumn("therapeuticAreas", flat_areas("therapeuticAreas"))
    )


def max_phase(known_drug: DataFrame) -> DataFrame:
    """The furthest drug of each pair: highest phase, then lowest drug id, then lowest status.

    An aggregate rather than a window, so a pair with many drugs is reduced before the shuffle.
    """
    best = F.min(
        F.struct(
            F.coalesce(-F.col("phase"), F.lit(float("inf"))).alias("order"), "drugId", "status", "phase"
        )
    )
    return (
        known_drug.groupBy(*PAIR)
        .agg(best.alias("best"))
        .select(*PAIR, "best.drugId", "best.phase", "best.status")
    )


def attach_max_phase(triplets: DataFrame, known_drug: DataFrame) -> DataFrame:
    return triplets.join(max_phase(known_drug), list(PAIR), "left")


def article_reviews(article_type: DataFrame) -> DataFrame:
    """One row per listed article: whether it is a review, null when its types are unknown."""
    return (
        article_type.withColumn("pmid", trimmed_id("pmid"))
        .groupBy("pmid")
        .agg(F.max(is_review("pubtypes", F.lit(True))).alias("is_review"))
        .withColumn("listed", F.lit(True))
    )


def attach_article_type(triplets: DataFrame, article_type: DataFrame) -> DataFrame:
    """Adds articleType: review, primary, or null when the lookup gave no types."""
    rows = triplets.withColumn("pmid", trimmed_id("pmid"))
    joined = rows.join(article_reviews(article_type), ["pmid"], "left")
    review = F.when(F.col("listed"), F.col("is_review")).otherwise(False)
    return joined.withColumn("articleType", article_label(review)).drop("is_review", "listed")


def classify_articles(articles: DataFrame, article_type: DataFrame) -> DataFrame:
    """Detailed classification of each distinct article id, with its types and title."""
    ids = articles.select(trimmed_id("pmid").alias("pmid")).dropna().distinct()
    types = (
        article_type.withColumn("pmid", trimmed_id("pmid"))
        .groupBy("pmid")
        .agg(F.min(F.struct("pubtypes", "title")).alias("entry"))
        .select("pmid", "entry.pubtypes", "entry.title", F.lit(True).alias("listed"))
    )
    listed = F.coalesce("listed", F.lit(False))
    return ids.join(types, "pmid", "left").select(
        "pmid",
        detailed_label("pubtypes", listed).alias("classification"),
        detailed_types("pubtypes", listed).alias("publication_types"),
        detailed_title("title", listed).alias("title"),
    )


def tally_article_types(articles: DataFrame, article_type: DataFrame) -> DataFrame:
    """How many articles were looked up, are reviews, could not be decided."""
    labelled = attach_article_type(articles.select(trimmed_id("pmid").alias("pmid")).distinct(), article_type)
    return labelled.agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.count_if(F.col("articleType") == "review").alias("n_reviews"),
        F.count_if(F.col("articleType").isNull()).alias("n_failed"),
    )


def attach_compound_phase(
    rows: DataFrame, molecule_dictionary: DataFrame, column: str = "COMPOUND_KEY"
) -> DataFrame:
    """Adds the clinical phase a compound has reached."""
    phases = molecule_dictionary.groupBy(F.col("compound_key").alias(column)).agg(
        F.max("max_phase").alias("max_phase")
    )
    return rows.join(phases, [column], "left")
