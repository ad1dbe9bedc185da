"""Keeping triplets whose target is an accepted target of the compound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litevidence.constants import GENE_OVERRIDES
from litevidence.functions.text import literal_items


def gene_symbols(dictionary: DataFrame, column: str = "GENE") -> DataFrame:
    """One row per dictionary row and gene symbol; the list may be an array or printed text."""
    is_text = dict(dictionary.dtypes)[column] == "string"
    items = literal_items(column) if is_text else F.col(column)
    return dictionary.withColumn("symbol", F.explode(items))


def with_overrides(gene_table: DataFrame, overrides: dict[str, str] = GENE_OVERRIDES) -> DataFrame:
    """The symbol table with hand-made entries, which win over those it holds."""
    pairs = [F.lit(x) for pair in overrides.items() for x in pair]
    patched = gene_table.sparkSession.range(1).select(
        F.explode(F.create_map(*pairs)).alias("symbol", "ensembl_id")
    )
    return gene_table.select("symbol", "ensembl_id").join(
        F.broadcast(patched), "symbol", "left_anti"
    ).unionByName(patched)


def ground_genes(dictionary: DataFrame, gene_table: DataFrame) -> DataFrame:
    """Adds ENS_ID to each dictionary row, once per gene symbol; unknown symbols give null."""
    ids = gene_table.groupBy("symbol").agg(F.min("ensembl_id").alias("ENS_ID"))
    return gene_symbols(dictionary).join(ids, "symbol", "left")


def accepted_targets(dictionary: DataFrame, gene_table: DataFrame, few_copies: bool = False) -> DataFrame:
    """Distinct dictionary rows that have a compound, once per accepted target GP.

    Symbols are grounded once per distinct gene list, so the dictionary's rows, many more than its lists, are made distinct
    a single time and only before they are multiplied. With `few_copies` the caller states that hardly any row is a copy: copies
    then go after the shuffle only, in all of the session's shuffle partitions. Ahead of it each task would hold the rows of
    its whole share of the input to find next to none, and merged partitions would hold many more than they need.
    """
    rows = dictionary.dropna(subset=["COMPOUND_KEY"])
    if few_copies:
        partitions = int(dictionary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(partitions, *rows.columns)
    lists = ground_genes(dictionary.select("GENE").distinct(), gene_table).groupBy("GENE").agg(
        F.collect_set("ENS_ID").alias("_ids")
    )
    return (
        rows.distinct()
        .join(lists, "GENE")
        .withColumn("GP", F.explode("_ids"))
        .drop("_ids")
        .select(*dictionary.columns, "GP")
    )


def accepted_triplets(
    triplets: DataFrame, dictionary: DataFrame, gene_table: DataFrame, once: bool = False, few_copies: bool = False
) -> DataFrame:
    """Triplets joined to the dictionary rows that accept (compound, target).

    A pair that is in several sets gives one row per dictionary row; with `once` each triplet is kept a
    single time and no dictionary columns are added. `few_copies` is that of `accepted_targets`.
    """
    rows = dictionary.select("COMPOUND_KEY", "GENE") if once else dictionary
    pairs = accepted_targets(rows, gene_table, few_copies).withColumnRenamed("COMPOUND_KEY", "CD")
    if once:
        return triplets.join(pairs.drop("GENE"), ["CD", "GP"], "left_semi")
    return triplets.join(pairs, ["CD", "GP"])


def without_blacklisted(triplets: DataFrame, blacklist: DataFrame, column: str = "DS") -> DataFrame:
    """Drops triplets whose disease is on the list; ids are trimmed first."""
    listed = blacklist.select(F.trim("diseaseId").alias(column)).dropna().distinct()
    return triplets.join(listed, [column], "left_anti")

