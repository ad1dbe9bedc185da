"""Choosing the articles that mention a compound of the dictionary, and grounding their mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litevidence.functions.text import split_list
from litevidence.operators.bloom import MAX_WORDS, bloom_filter
from litevidence.sources.writers import staged


def name_columns(matches: DataFrame) -> DataFrame:
    """Annotation-service columns under the names used here; nothing else is read."""
    return matches.select(
        "pmid",
        "label",
        F.col("keywordId").alias("label_id"),
        F.col("type").alias("entity_type"),
        F.col("pubDate").alias("date"),
        "section",
        F.col("text").alias("sentence"),
    )


def synonyms(dictionary: DataFrame, column: str = "SYNOMS") -> DataFrame:
    """One row per synonym and compound id; the list may be an array or delimited text."""
    is_text = dict(dictionary.dtypes)[column] == "string"
    items = split_list(column) if is_text else F.col(column)
    return dictionary.select("COMPOUND_KEY", F.explode(items).alias("label"))


def dictionary_labels(dictionary: DataFrame, with_names: bool = False) -> DataFrame:
    """The distinct labels by which compounds are recognised: synonyms, on request names as well."""
    labels = synonyms(dictionary).select("label")
    if with_names:
        for name in ("PROBE", "PREF_NAME"):
            if name in dictionary.columns:
                labels = labels.unionByName(dictionary.select(F.col(name).alias("label")))
    return labels.where(F.col("label").isNotNull()).distinct()


def label_ids(dictionary: DataFrame) -> DataFrame:
    """The compound id of each label: the lowest one, with the number of candidates."""
    return (
        synonyms(dictionary)
        .groupBy("label")
        .agg(F.min("COMPOUND_KEY").alias("COMPOUND_KEY"), F.count_distinct("COMPOUND_KEY").alias("n_ids"))
    )


def labelled_mentions(mentions: DataFrame, labels: DataFrame) -> DataFrame:
    """Mentions whose label is in the dictionary (exact, case-sensitive)."""
    return mentions.join(labels, ["label"], "left_semi")


def article_ids(mentions: DataFrame) -> DataFrame:
    return mentions.select("pmid").distinct()


def mentions_of(mentions: DataFrame, articles: DataFrame) -> DataFrame:
    """All mentions of the given articles."""
    return mentions.join(articles, ["pmid"], "left_semi")


def probe_articles(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Every mention of every article that has at least one compound of the dictionary, copies included."""
    hits = labelled_mentions(mentions, dictionary_labels(dictionary))
    return mentions_of(mentions, article_ids(hits))


def select_articles(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The same without copies. Rows are chosen first, so the wide shuffle sees only what is kept."""
    return probe_articles(mentions, dictionary).distinct()


def select_articles_pruned(mentions: DataFrame, dictionary: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of `select_articles`, for dictionaries and article sets that are too large to broadcast.

    Both scans of the corpus test a filter ahead of their semi-join, of the labels and then of the chosen articles, so most
    rows that have no part in the result are never shuffled. Starts jobs: labels and chosen articles are written.
    """
    labels = staged(dictionary_labels(dictionary), "labels")
    hits = labelled_mentions(bloom_filter(labels, "label", max_words).possible(mentions, "label"), labels)
    articles = staged(article_ids(hits), "articles")
    return mentions_of(bloom_filter(articles, "pmid", max_words).possible(mentions, "pmid"), articles).distinct()


def improve_ids(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Replace the annotated id by the dictionary's id where the label is a known synonym."""
    ids = label_ids(dictionary).select("label", "COMPOUND_KEY")
    return (
        mentions.join(ids, ["label"], "left")
        .withColumn("label_id", F.coalesce("COMPOUND_KEY", "label_id"))
        .select(*mentions.columns)
    )


def complete_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions without any missing value."""
    return mentions.dropna("any")


def count_articles(mentions: DataFrame) -> DataFrame:
    return mentions.agg(F.count_distinct("pmid").alias("n_articles"))
