"""The steps of the chain as jobs from files to files: python -m litevidence STEP --option value ...

Dictionaries, lists and releases are delimited text; matches, evidence and all results are Parquet.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litevidence import schemas
from litevidence.functions.text import literal_items, redelimit, split_list
from litevidence.operators import annotate, compare, curation, metrics, targets
from litevidence.operators.dictionary import build_dictionary
from litevidence.operators.evidence import attach_dated, attach_evidence, temporal_precedence
from litevidence.operators.mentions import complete_mentions, improve_ids, select_articles
from litevidence.operators.triplets import extract_triplets, triplet_counts
from litevidence.plans.literature import annotated_triplets
from litevidence.sources import readers, writers

PORTAL_TABLES = [
    "probe", "compound", "compoundset", "compoundtoexternaldb", "compoundattribute", "attributevalue",
    "attribute", "attributetype", "probetobasetarget", "basetarget", "targettobasetarget", "target",
    "targetsynonym",
]
COMPOUND_TABLES = [
    "molecule_dictionary", "compound_structures", "molecule_synonyms", "component_synonyms",
    "component_sequences",
]
STEPS: dict[str, tuple[Callable[..., DataFrame], list[str]]] = {}


def step(*options: str):
    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        STEPS[build.__name__] = (build, list(options))
        return build

    return register


NAMES: dict[str, str] = {}   # column names of the inputs and the names used here, from --name


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary with its lists as arrays and its marks for missing ids as null."""
    return (
        readers.read_text(spark, path, schemas.PROBES_TEXT, names=NAMES)
        .withColumns({c: split_list(c) for c in ("SYNOMS", "SYNOMS_TARGET")})
        .withColumn("GENE", literal_items("GENE"))
        .withColumn("COMPOUND_KEY", F.nullif("COMPOUND_KEY", F.lit("None")))
    )


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    return targets.with_overrides(readers.read_parquet(spark, path, schemas.GENE_SYMBOL))


@step("portal", "compounds", "good")
def dictionary(spark: SparkSession, portal: str, compounds: str, good: str) -> DataFrame:
    return build_dictionary(
        readers.read_tables(spark, portal, PORTAL_TABLES, NAMES),
        readers.read_tables(spark, compounds, COMPOUND_TABLES, NAMES),
        readers.read_text(spark, good, sep=","),
    )


@step("matches", "probes")
def articles(spark: SparkSession, matches: str, probes: str) -> DataFrame:
    return select_articles(readers.read_matches(spark, matches), read_dictionary(spark, probes))


@step("input", "probes")
def triplets(spark: SparkSession, input: str, probes: str) -> DataFrame:
    mentions = readers.read_parquet(spark, input)
    grounded = improve_ids(mentions, read_dictionary(spark, probes))
    return extract_triplets(complete_mentions(grounded), counted=mentions)


@step("input", "probes", "genes")
def accepted(spark: SparkSession, input: str, probes: str, genes: str) -> DataFrame:
    return targets.accepted_triplets(
        readers.read_parquet(spark, input), read_dictionary(spark, probes), read_genes(spark, genes)
    )


@step("input", "evidence")
def curated(spark: SparkSession, input: str, evidence: str) -> DataFrame:
    return attach_evidence(
        readers.read_parquet(spark, input), readers.read_parquet(spark, evidence, schemas.EVIDENCE)
    )


@step("input", "dated")
def dated(spark: SparkSession, input: str, dated: str) -> DataFrame:
    return attach_dated(
        readers.read_parquet(spark, input), readers.read_dated_evidence(spark, dated)
    )


@step("input", "disease")
def areas(spark: SparkSession, input: str, disease: str) -> DataFrame:
    return annotate.attach_areas(
        readers.read_parquet(spark, input), readers.read_parquet(spark, disease, schemas.DISEASE)
    )


@step("input", "drugs")
def phases(spark: SparkSession, input: str, drugs: str) -> DataFrame:
    return annotate.attach_max_phase(
        readers.read_parquet(spark, input), readers.read_parquet(spark, drugs, schemas.KNOWN_DRUG)
    )


@step("input", "types")
def reviews(spark: SparkSession, input: str, types: str) -> DataFrame:
    return annotate.attach_article_type(
        readers.read_parquet(spark, input), readers.read_parquet(spark, types, schemas.ARTICLE_TYPE)
    )


@step("matches", "probes", "genes", "evidence", "dated", "disease", "drugs", "types")
def everything(
    spark: SparkSession, matches: str, probes: str, genes: str, evidence: str, dated: str, disease: str,
    drugs: str, types: str, blacklist: str | None = None,
) -> DataFrame:
    compounds = read_dictionary(spark, probes)
    return annotated_triplets(
        readers.read_matches(spark, matches), compounds, compounds, read_genes(spark, genes),
        readers.read_parquet(spark, evidence, schemas.EVIDENCE),
        readers.read_dated_evidence(spark, dated),
        readers.read_parquet(spark, disease, schemas.DISEASE),
        readers.read_parquet(spark, drugs, schemas.KNOWN_DRUG),
        readers.read_parquet(spark, types, schemas.ARTICLE_TYPE),
        readers.read_text(spark, blacklist, schemas.DISEASE_BLACKLIST) if blacklist else None,
    )


OPTIONAL = {"everything": ["blacklist"]}


@step("input", "blacklist")
def listed(spark: SparkSession, input: str, blacklist: str) -> DataFrame:
    """Triplets whose disease is not on the list."""
    return targets.without_blacklisted(
        readers.read_parquet(spark, input), readers.read_text(spark, blacklist, schemas.DISEASE_BLACKLIST)
    )


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return curation.read_marks(readers.read_text(spark, path, schemas.CURATED, names=NAMES))


@step("report")
def subset(spark: SparkSession, report: str) -> DataFrame:
    """Distinct rows of the curated report that name a disease."""
    return curation.with_any(read_report(spark, report), ["DISEASES", "DISEASE_FOUND"])


@step("report")
def triples(spark: SparkSession, report: str) -> DataFrame:
    rows = read_report(spark, report)
    return curation.unique_triples(rows.withColumn("DISEASE_FOUND", redelimit("DISEASE_FOUND")))


@step("report")
def paircounts(spark: SparkSession, report: str) -> DataFrame:
    return metrics.distinct_per(read_report(spark, report), ["PROBE", "GENE"], "PMID", "n_articles")


@step("report", "genes", "probes", "terms")
def grounded(spark: SparkSession, report: str, genes: str, probes: str, terms: str) -> DataFrame:
    """The report grounded: `genes` and `probes` hold label and label_id, `terms` term, term_id and rank."""
    tables = [readers.read_parquet(spark, path) for path in (genes, probes, terms)]
    return curation.grounded_triples(read_report(spark, report), *tables)


@step("input", "grounded")
def comparison(spark: SparkSession, input: str, grounded: str) -> DataFrame:
    found = readers.read_parquet(spark, input).select("pmid", "CD", "GP", "DS")
    return compare.compare_triplets(found, readers.read_parquet(spark, grounded).withColumnRenamed("PMID", "pmid"))


@step("input")
def prevalence(spark: SparkSession, input: str) -> DataFrame:
    return triplet_counts(readers.read_parquet(spark, input))


@step("input", "dated", "literature")
def precedence(spark: SparkSession, input: str, dated: str, literature: str) -> DataFrame:
    """`literature` names the sources that are literature themselves, joined by commas."""
    return temporal_precedence(
        readers.read_parquet(spark, input), readers.read_dated_evidence(spark, dated), literature.split(",")
    )


@step("releases")
def releases(spark: SparkSession, releases: str) -> DataFrame:
    return curation.dated_releases(readers.read_text(spark, releases, schemas.RELEASE_DATES, names=NAMES))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="litevidence")
    commands = parser.add_subparsers(dest="step", required=True)
    for name, (_, options) in STEPS.items():
        command = commands.add_parser(name)
        for option in [*options, "out"]:
            command.add_argument(f"--{option}", required=True)
        for option in OPTIONAL.get(name, []):
            command.add_argument(f"--{option}")
        command.add_argument("--name", action="append", default=[], help="OLD=NEW: a column of the inputs")
        command.add_argument("--text", action="store_true", help="write delimited text, not Parquet")
    chosen = vars(parser.parse_args(arguments))
    build, options = STEPS[chosen["step"]]
    session = spark or SparkSession.builder.appName("litevidence").getOrCreate()
    NAMES.clear()
    NAMES.update(pair.split("=", 1) for pair in chosen["name"])
    given = [*options, *[o for o in OPTIONAL.get(chosen["step"], []) if chosen[o]]]
    result = build(session, **{option: chosen[option] for option in given})
    (writers.write_text if chosen["text"] else writers.write_parquet)(result, chosen["out"])
    writers.drop_staged(session)


if __name__ == "__main__":
    main()
