"""The whole chain: from entity mentions to annotated triplets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from litevidence.operators.annotate import attach_areas, attach_article_type, max_phase
from litevidence.operators.evidence import (
    PAIR, SOURCE_PAIR, YEARS, dated_lists, evidence_columns, evidence_names,
)
from litevidence.functions.text import empty_to_null
from litevidence.operators.mentions import complete_mentions, improve_ids, probe_articles
from litevidence.operators.targets import accepted_triplets, without_blacklisted
from litevidence.operators.triplets import extract_triplets
from litevidence.sources.writers import staged


def grounded_triplets(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Triplets of all articles that mention a compound of the dictionary.

    Copies of mentions are left in: gathering a sentence's entities removes them in the same shuffle.
    """
    chosen = staged(probe_articles(mentions, dictionary), "mentions")
    return extract_triplets(complete_mentions(improve_ids(chosen, dictionary)), counted=chosen)


def annotated_pairs(
    pairs: DataFrame, evidence: DataFrame, dated: DataFrame, disease: DataFrame, known_drug: DataFrame
) -> DataFrame:
    """Everything known about distinct target-disease pairs: one row per pair and evidence source.

    Evidence, dated evidence and drugs are first reduced to the pairs asked for.
    """
    by_source = pairs.join(evidence_columns(evidence), list(PAIR), "left")
    lists = dated_lists(dated.join(pairs, list(PAIR), "left_semi"))
    phases = max_phase(known_drug.join(pairs, list(PAIR), "left_semi"))
    rows = by_source.join(lists, list(SOURCE_PAIR), "left").withColumns(
        {f"all{year}s": empty_to_null(f"all{year}s") for year in YEARS}
    )
    return attach_areas(rows, disease).join(phases, list(PAIR), "left")


def annotated_triplets(
    mentions: DataFrame,
    dictionary: DataFrame,
    dictionary_targets: DataFrame,
    gene_table: DataFrame,
    evidence: DataFrame,
    dated: DataFrame,
    disease: DataFrame,
    known_drug: DataFrame,
    article_type: DataFrame,
    blacklist: DataFrame | None = None,
    few_copies: bool = False,
) -> DataFrame:
    """Accepted triplets with evidence, dated evidence, area, phase and article type.

    What is known about a target-disease pair is put together once per pair and meets the triplets in a
    single join, so the wide triplet rows with their sentences are shuffled once. Two tables are written on
    the way: the chosen mentions and the accepted triplets. `few_copies` is that of `accepted_targets`.
    """
    triplets = grounded_triplets(mentions, dictionary)
    if blacklist is not None:
        triplets = without_blacklisted(triplets, blacklist)
    # Distinct by construction: triplets of a sentence and accepted pairs both are.
    accepted = staged(
        evidence_names(accepted_triplets(triplets, dictionary_targets, gene_table, few_copies=few_copies)), "accepted"
    )
    pairs = accepted.select(*PAIR).distinct()
    known = annotated_pairs(pairs, evidence, dated, disease, known_drug)
    return attach_article_type(accepted.join(known, list(PAIR)), article_type)
