"""Curated and dated evidence for target-disease pairs."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litevidence.functions.text import empty_to_null

PAIR = ("diseaseId", "targetId")
SOURCE_PAIR = (*PAIR, "datasourceId")
YEARS = ("curationYear", "publicationYear", "studyYear")

# Triplet and dictionary columns, and their names from the evidence step on.
EVIDENCE_NAMES = {
    "DS": "diseaseId", "GP": "targetId", "CD": "probeId", "SETID": "setId", "UNIPROT": "uniprot",
    "PROBE": "probe", "SET": "set", "INCHI": "inchiKey", "GENE": "gene", "CONTR": "control",
    "PREF_NAME": "prefName", "SYNOMS": "probeSyn", "SYNOMS_TARGET": "targetSyn",
}


def evidence_names(triplets: DataFrame) -> DataFrame:
    return triplets.withColumnsRenamed(EVIDENCE_NAMES)


def evidence_columns(evidence: DataFrame) -> DataFrame:
    return evidence.select(
        "datatypeId", "datasourceId", "diseaseId", "targetId", "score", "evidenceCount"
    ).distinct()


def attach_evidence(triplets: DataFrame, evidence: DataFrame, copies: bool = True) -> DataFrame:
    """Every triplet once per evidence source of its pair; without evidence, once with nulls.

    Copies of triplets count once; with `copies=False` the caller states that there are none, as in triplets just
    extracted, and whole rows are not shuffled to find them. A pair has a row or two per source.
    """
    found = evidence_names(triplets)
    return (found.distinct() if copies else found).join(evidence_columns(evidence), list(PAIR), "left")


def dated_lists(dated: DataFrame) -> DataFrame:
    """Sorted lists of the three kinds of years per pair and source; null years are skipped.

    Copies inside one folder count once, copies in different folders count again. After that a pair and
    source has at most one row per folder and combination of years, so its lists stay short however
    many rows it came from.
    """
    once = dated.select("sourceId", *SOURCE_PAIR, *YEARS).distinct()
    return once.groupBy(*SOURCE_PAIR).agg(
        *[F.array_sort(F.collect_list(year)).alias(f"all{year}s") for year in YEARS]
    )


def attach_dated(triplets: DataFrame, dated: DataFrame) -> DataFrame:
    """Adds the year lists of (pair, source). Only evidence of pairs that occur is aggregated."""
    wanted = triplets.select(*SOURCE_PAIR).distinct()
    lists = dated_lists(dated.join(wanted, list(SOURCE_PAIR), "left_semi"))
    out = triplets.join(lists, list(SOURCE_PAIR), "left")
    return out.withColumns({f"all{year}s": empty_to_null(f"all{year}s") for year in YEARS})


def earliest_evidence(dated: DataFrame, literature_sources: Collection[str]) -> DataFrame:
    """The first year of any evidence per pair, literature sources left out."""
    rows = dated.where(~F.col("datasourceId").isin(*literature_sources)) if literature_sources else dated
    return rows.groupBy(*PAIR).agg(F.min(F.least(*YEARS)).alias("evidence_year"))


def temporal_precedence(
    triplets: DataFrame, dated: DataFrame, literature_sources: Collection[str]
) -> DataFrame:
    """Whether a pair was in the compound literature before the first dated evidence elsewhere.

    `literature_sources` are the sources that are literature themselves; the caller has to name them.

    `precedes` is null for pairs without such evidence.
    """
    first = triplets.groupBy(F.col("DS").alias("diseaseId"), F.col("GP").alias("targetId")).agg(
        F.min(F.year("date")).alias("literature_year")
    )
    return first.join(earliest_evidence(dated, literature_sources), list(PAIR), "left").withColumn(
        "precedes", F.col("literature_year") < F.col("evidence_year")
    )
