"""Grounding of free-text terms by weighted character trigrams.

Terms and ontology synonyms are sets of trigrams, weighted by how rare a trigram is among the synonyms. The hit of a
term is the synonym of highest cosine at or above a cut-off. Candidates come from an inverted index with prefix
filtering: trigrams are taken rarest first, and whatever lies beyond the prefix is too light to reach the cut-off
alone, so two vectors that reach it share a trigram of both prefixes. Common trigrams are in almost no prefix.

Weights are whole numbers, so dot products and norms are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litevidence.functions.text import term_key
from litevidence.operators.skew import CELL_PRODUCT, grid_join, spread_left
from litevidence.sources.writers import staged

CUTOFF = 0.8


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of a text with blanks around it; empty for an empty text."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    runs = F.transform(F.sequence(F.lit(1), F.char_length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))
    return F.when(F.char_length(text) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _vectors(names: DataFrame, key: str, weights: DataFrame, rarest: int, cutoff: float) -> DataFrame:
    """name, grams (trigram and squared weight, rarest first), norm (squared) and prefix of each distinct name."""
    grams = names.select(key, F.explode(trigrams(F.col(key))).alias("gram"))
    weighed = grams.join(weights, "gram", "left").withColumn("square", F.coalesce("square", F.lit(rarest).cast("long")))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("square")).alias("order"), "gram", "square")))
    # A term has as many trigrams as characters, so its list is short.
    found = weighed.groupBy(key).agg(ordered.alias("grams"), F.sum("square").alias("norm"))
    # The weight of the rest of the vector from each trigram on; the prefix is what lies before it gets too light.
    rest = F.expr(
        "transform(grams, (g, i) -> aggregate(slice(grams, i + 1, size(grams) - i), 0L, (s, x) -> s + x.square))"
    )
    found = staged(found.withColumn("rest", rest), "vectors")
    kept = F.filter(F.arrays_zip("grams", "rest"), lambda z: z["rest"] >= F.lit(cutoff * cutoff * (1 - 1e-9)) * F.col("norm"))
    return found.select(
        key, F.transform("grams", lambda g: F.struct(g["gram"].alias("gram"), g["square"].alias("square"))).alias("grams"), "norm",
        F.transform(kept, lambda z: z["grams"]["gram"]).alias("prefix"),
    )


def fuzzy_hits(
    wanted: DataFrame, terms: DataFrame, cutoff: float = CUTOFF, max_product: int = CELL_PRODUCT
) -> DataFrame:
    """term, hit, term_id, cosine: the best synonym of each distinct non-empty `term`; terms without one give no row.

    `terms` holds term, term_id and rank; both sides are compared in lower case, trimmed. Of equal cosines the lowest rank
    wins, then the first synonym and id in alphabetical order. A trigram that very many terms and synonyms have in their prefix is
    cut into cells of at most `max_product` pairs.
    """
    asked = wanted.select(term_key("term").alias("asked")).where("asked <> ''").distinct()
    known = (
        terms.select(term_key("term").alias("known"), "rank", "term_id").where("known <> ''")
        .groupBy("known").agg(F.min(F.struct("rank", "term_id")).alias("best"))
    )
    known = staged(known, "synonyms")
    n = known.count()
    frequency = known.select(F.explode(trigrams(F.col("known"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))

    def square(df: Column) -> Column:
        weight = F.floor(F.lit(100) * F.log(F.lit(1.0) + F.lit(float(n)) / df)).cast("long")
        return weight * weight

    weights = staged(frequency.select("gram", square(F.col("df")).alias("square")), "trigrams")
    rarest = wanted.sparkSession.range(1).select(square(F.lit(1.0)).alias("s")).first()["s"]
    left = staged(_vectors(asked, "asked", weights, rarest, cutoff), "asked")
    right = staged(_vectors(known.select("known"), "known", weights, rarest, cutoff), "known")
    pairs = grid_join(
        [
            staged(left.select("asked", F.explode("prefix").alias("gram")), "asked-index"),
            staged(right.select("known", F.explode("prefix").alias("gram")), "known-index"),
        ],
        ["gram"], "inner", max_product,
    ).select("asked", "known").distinct()
    met = pairs.join(left.select("asked", F.col("grams").alias("x"), F.col("norm").alias("nx")), "asked").join(
        right.select("known", F.col("grams").alias("y"), F.col("norm").alias("ny")), "known"
    )
    dot = F.aggregate(F.array_intersect("x", "y"), F.lit(0).cast("long"), lambda s, g: s + g["square"]).cast("double")
    similar = met.select("asked", "known", (dot * dot / (F.col("nx").cast("double") * F.col("ny"))).alias("square"))
    best = (
        similar.where(F.col("square") >= cutoff * cutoff).join(known, "known")
        .groupBy("asked")
        .agg(F.min(F.struct((-F.col("square")).alias("order"), "best.rank", "known", "best.term_id")).alias("hit"))
    )
    return best.select(
        F.col("asked").alias("term"), F.col("hit.known").alias("hit"), F.col("hit.term_id").alias("term_id"),
        F.round(F.sqrt(-F.col("hit.order")), 6).alias("cosine"),
    )


def fuzzy_ground_terms(
    rows: DataFrame, column: str, terms: DataFrame, target: str = "DISEASE_ID", cutoff: float = CUTOFF
) -> DataFrame:
    """The rows with the id and cosine of the best synonym of a term; null where none reaches the cut-off.

    Each distinct term is looked up once. Rows with a null or empty term stay, without an id.
    """
    hits = fuzzy_hits(rows.select(F.col(column).alias("term")), terms, cutoff)
    hits = staged(hits, "hits").select(
        F.col("term").alias("_term"), F.replace("term_id", F.lit(":"), F.lit("_")).alias(target), "cosine"
    )
    return spread_left(rows.withColumn("_term", term_key(column)), hits, "_term").drop("_term")
