"""The engine's operators as named queries over the test tables.

Each function takes a session and a folder of test tables and returns a DataFrame. Dates and arrays are
given as text here, so that results compare by value with any SQL engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litevidence.constants import GENE_OVERRIDES
from litevidence.functions.areas import preferred_area, preferred_area_of_text, flat_areas
from litevidence.functions.text import (
    control_class, differs, join_list, quoted_items, redelimit, strip_literal,
)
from litevidence.operators import annotate, compare, curation, dictionary, evidence, metrics, sketches
from litevidence.operators.fuzzy import fuzzy_ground_terms
from litevidence.operators.incremental import PrevalenceState
from litevidence.operators.mentions import (
    article_ids, complete_mentions, count_articles, dictionary_labels, improve_ids, label_ids,
    labelled_mentions, name_columns, select_articles, select_articles_pruned,
)
from litevidence.operators.targets import (
    accepted_triplets, ground_genes, with_overrides, without_blacklisted,
)
from litevidence.operators.triplets import extract_triplets, triplet_counts
from litevidence.plans.literature import annotated_triplets
from litevidence.plans.views import Views
from litevidence.sources import readers
from litevidence.sources.layout import bucket_count, read_bucketed, write_bucketed
from litevidence.sources.writers import stage_folder, staged, staged_path, write_merged_text, write_parquet, write_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SETS = ("ECONOMY", "SMALL", "MEDIUM")
PORTAL = "set MEDIUM"
GROUNDED_SECTIONS = ("F",)


def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[build.__name__.rstrip("_")] = lambda spark, sf_dir: plain(build(Views(spark, sf_dir)))
    return build


def plain(rows: DataFrame) -> DataFrame:
    """Dates and arrays as text, empty arrays as empty text; null stays null."""
    changed = {}
    for name, kind in rows.dtypes:
        if kind == "date":
            changed[name] = F.col(name).cast("string")
        elif kind.startswith("array"):
            changed[name] = as_text(F.col(name))
    return rows.withColumns(changed) if changed else rows


def as_text(items: F.Column) -> F.Column:
    return F.array_join(items.cast("array<string>"), "|")


def mentions(v: Views) -> DataFrame:
    return name_columns(v.raw_matches())


def triplets(v: Views) -> DataFrame:
    return extract_triplets(mentions(v), counted=v.mention_articles())


def accepted(v: Views, once: bool = True) -> DataFrame:
    return accepted_triplets(triplets(v), v.dictionary_targets(), v.gene_symbol(), once, few_copies=True)


def portal(v: Views) -> dict[str, DataFrame]:
    names = (
        "probe", "compound", "compoundset", "probetobasetarget", "basetarget", "targettobasetarget",
        "target", "compoundtoexternaldb", "targetsynonym",
    )
    return {**{name: getattr(v, name)() for name in names}, **v.attribute_links()}


def compounds(v: Views) -> dict[str, DataFrame]:
    names = (
        "molecule_dictionary", "compound_structures", "molecule_synonyms", "component_sequences",
        "component_synonyms", "activities", "assays", "assay_type", "docs",
    )
    return {name: getattr(v, name)() for name in names}


def report(v: Views, *columns: str) -> DataFrame:
    """The curated report, or some of its columns; copies go once, among the columns that are read."""
    rows = v.curated()
    return curation.read_marks(rows.select(*columns) if columns else rows)


def chosen_probes(v: Views) -> DataFrame:
    return curation.probes_of_set(v.probe_sets(), "Brand#7")


# --- articles and mentions --------------------------------------------------------------------------


@query
def dictionary_labels_(v: Views) -> DataFrame:
    return dictionary_labels(v.dictionary_text())


@query
def label_candidates(v: Views) -> DataFrame:
    return label_ids(v.dictionary_text())


@query
def articles_with_probe(v: Views) -> DataFrame:
    return labelled_mentions(mentions(v), dictionary_labels(v.dictionary_text())).distinct()


@query
def article_mentions(v: Views) -> DataFrame:
    return select_articles(mentions(v), v.dictionary_text())


@query
def article_mentions_pruned(v: Views) -> DataFrame:
    """The same with filters ahead of the semi-joins."""
    return select_articles_pruned(mentions(v), v.dictionary_text())


@query
def corpus_article_count(v: Views) -> DataFrame:
    return count_articles(mentions(v))


@query
def improve_ids_(v: Views) -> DataFrame:
    rows = improve_ids(mentions(v), v.dictionary_text())
    # Few are copies: they go after the shuffle, as before it a task would hold its wide rows beside those of the joins.
    return rows.repartition(*rows.columns).distinct()


@query
def label_id_counts(v: Views) -> DataFrame:
    rows = mentions(v).withColumn("annotated_id", F.col("label_id"))
    return improve_ids(rows, v.dictionary_text()).agg(
        F.count("annotated_id").alias("n_annotated"),
        F.count("label_id").alias("n_improved"),
        F.count_if(F.col("annotated_id") != F.col("label_id")).alias("n_changed"),
    )


@query
def complete_mentions_(v: Views) -> DataFrame:
    rows = report(v).select("PMID", "SECTION", "PROBE", "GENE", "DISEASES", "CONTROL", "DOSAGE")
    return complete_mentions(rows.dropna(subset=["DISEASES"])).distinct()


# --- triplets ---------------------------------------------------------------------------------------


@query
def triplet_extract(v: Views) -> DataFrame:
    return triplets(v)


@query
def triplet_extract_split(v: Views) -> DataFrame:
    """The same with nearly all articles treated as busy and cut into small cells."""
    return extract_triplets(mentions(v), counted=v.mention_articles(), max_product=2, gathered=3)


@query
def triplet_extract_bucketed(v: Views) -> DataFrame:
    """The same from mentions in buckets of articles."""
    path = staged_path(v.spark, "by-article")
    found = staged(mentions(v), "mentions")
    write_bucketed(found, path, ["pmid"], bucket_count(found))
    return extract_triplets(read_bucketed(v.spark, path))


@query
def triplet_outer_split(v: Views) -> DataFrame:
    return extract_triplets(mentions(v), outer=True, counted=v.mention_articles(), max_product=2, gathered=3)


@query
def triplet_extract_outer(v: Views) -> DataFrame:
    return extract_triplets(mentions(v), outer=True, counted=v.mention_articles())


@query
def triplet_extract_labels(v: Views) -> DataFrame:
    return extract_triplets(
        mentions(v), ("pmid", "sentence"), "label", outer=True, counted=v.mention_articles()
    )


@query
def triplet_prevalence(v: Views) -> DataFrame:
    return triplet_counts(triplets(v))


@query
def prevalence_in_batches(v: Views) -> DataFrame:
    """The same, fed by sections one after the other, articles given twice among them, and compacted on the way."""
    state = PrevalenceState(v.spark, staged_path(v.spark, "prevalence"), fan_in=2)
    found = staged(mentions(v).drop("label"), "mentions")
    for sections in (["F"], ["F", "O"], ["O", "P"]):
        state.add(found.where(F.col("section").isin(sections)))
    state.add(found)
    return state.counts()


@query
def gene_to_id(v: Views) -> DataFrame:
    return ground_genes(v.dictionary_targets().distinct(), v.gene_symbol())


@query
def accepted_pairs(v: Views) -> DataFrame:
    return accepted(v, once=False)


@query
def accepted_pairs_once(v: Views) -> DataFrame:
    return accepted(v)


@query
def blacklist_filter(v: Views) -> DataFrame:
    return without_blacklisted(triplets(v), v.blacklist())


# --- evidence ---------------------------------------------------------------------------------------


@query
def attach_evidence(v: Views) -> DataFrame:
    return evidence.attach_evidence(accepted(v), v.evidence(), copies=False)


@query
def attach_evidence_bucketed(v: Views) -> DataFrame:
    """The same from triplets and evidence in buckets of pairs."""
    found, known = staged_path(v.spark, "triplets-by-pair"), staged_path(v.spark, "evidence-by-pair")
    rows, facts = staged(evidence.evidence_names(accepted(v)), "accepted"), staged(v.evidence(), "evidence")
    buckets = bucket_count(rows, facts)
    write_bucketed(rows, found, evidence.PAIR, buckets)
    write_bucketed(facts, known, evidence.PAIR, buckets)
    return evidence.attach_evidence(read_bucketed(v.spark, found), read_bucketed(v.spark, known), copies=False)


@query
def dated_evidence_lists(v: Views) -> DataFrame:
    return evidence.dated_lists(v.dated_evidence())


@query
def dated_folder_lists(v: Views) -> DataFrame:
    """The same from one folder per source, read in one scan."""
    path = f"{stage_folder(v.spark)}/dated-{uuid.uuid4().hex}"
    write_parquet(v.dated_evidence(), path, ["sourceId"])
    return evidence.dated_lists(readers.read_dated_evidence(v.spark, path))


@query
def drifted_folders(v: Views) -> DataFrame:
    """The same rows from folders of unlike columns: turned round, of other types, one left out."""
    rows = v.dated_evidence()
    folder = staged_path(v.spark, "drifted")
    parts = {
        "O": rows.where(F.col("sourceId") == "O").select("studyYear", "diseaseId", "targetId", "datasourceId", "curationYear", "publicationYear"),
        "F": rows.where(F.col("sourceId") == "F").select(
            F.col("diseaseId").alias("DiseaseId"), "targetId", "datasourceId", F.col("curationYear").cast("long"),
            F.col("publicationYear").cast("string"), F.col("curationYear").alias("extra"),
        ),
    }
    for name, part in parts.items():
        write_parquet(part, f"{folder}/{name}")
    found, _ = readers.read_drifted(v.spark, {name: f"{folder}/{name}" for name in parts})
    return found


@query
def text_round_trip(v: Views) -> DataFrame:
    """Articles written as text with quotes, tabs and line breaks, broken records among them, read back and counted."""
    note = F.concat(F.col("o_orderpriority"), F.lit('\t"quoted"\nnext, '), F.col("o_orderstatus"))
    rows = v.table("orders").select(F.col("o_orderkey").alias("pmid"), note.alias("note"), F.col("o_totalprice").alias("price"))
    path = staged_path(v.spark, "articles-text")
    write_text(rows.where(F.col("pmid") % 10 != 0), path)
    # Every tenth record has lost a field or holds a word for the number.
    spoilt = F.when(F.col("pmid") % 20 == 0, F.concat_ws("\t", F.col("pmid"), F.lit("lost"))).otherwise(F.concat_ws("\t", F.col("pmid"), F.lit("x"), F.lit("many")))
    header = v.spark.createDataFrame([("pmid\tnote\tprice",)], "value string")
    broken = rows.where(F.col("pmid") % 10 == 0).select(spoilt.alias("value")).coalesce(1)
    header.unionByName(broken).coalesce(1).write.mode("append").text(path)
    good, bad = readers.read_checked(v.spark, path, rows.schema)
    return good.select(F.lit("good").alias("kind"), F.col("pmid").cast("string"), "note").unionByName(
        bad.select(F.col("reason").alias("kind"), F.split("record", "\t")[0].alias("pmid"), F.lit(None).cast("string").alias("note"))
    )


@query
def attach_dated(v: Views) -> DataFrame:
    with_sources = evidence.attach_evidence(accepted(v), v.evidence(), copies=False)
    narrow = with_sources.select("pmid", "sentence", "probeId", *evidence.SOURCE_PAIR)
    return evidence.attach_dated(staged(narrow, "with-sources"), v.dated_evidence())


@query
def temporal_precedence(v: Views) -> DataFrame:
    return evidence.temporal_precedence(triplets(v), v.late_evidence(), literature_sources=["R"])


# --- annotation -------------------------------------------------------------------------------------


@query
def therapeutic_areas(v: Views) -> DataFrame:
    rows = triplets(v).withColumnRenamed("DS", "diseaseId")
    return annotate.attach_areas(rows, v.disease())


@query
def preferred_area_(v: Views) -> DataFrame:
    return v.disease().select(
        "id",
        preferred_area("therapeuticAreas").alias("area"),
        preferred_area_of_text(flat_areas("therapeuticAreas")).alias("area_of_text"),
    )


@query
def max_phase_drug(v: Views) -> DataFrame:
    return annotate.max_phase(v.known_drug())


@query
def attach_max_phase(v: Views) -> DataFrame:
    rows = triplets(v).select(
        "pmid", "CD", F.col("DS").alias("diseaseId"), F.col("GP").alias("targetId")
    )
    return annotate.attach_max_phase(rows, v.known_drug())


@query
def article_type(v: Views) -> DataFrame:
    return annotate.attach_article_type(triplets(v), v.article_type())


@query
def article_type_detail(v: Views) -> DataFrame:
    return annotate.classify_articles(v.articles(), v.article_type())


@query
def article_type_tally(v: Views) -> DataFrame:
    return annotate.tally_article_types(v.articles(), v.article_type())


@query
def compound_phase(v: Views) -> DataFrame:
    rows = triplets(v).select("pmid", F.col("CD").alias("COMPOUND_KEY"))
    return annotate.attach_compound_phase(rows, v.molecule_dictionary())


@query
def annotated_triplets_(v: Views) -> DataFrame:
    return annotated_triplets(
        mentions(v), v.dictionary_text(), v.dictionary_targets(), v.gene_symbol(), v.evidence(),
        v.dated_evidence(), v.disease(), v.known_drug(), v.article_type(), v.blacklist(),
        few_copies=True,
    )


# --- compound dictionary ----------------------------------------------------------------------------


@query
def probe_main_set(v: Views) -> DataFrame:
    return dictionary.main_set(portal(v), SETS)


@query
def set_distinct_counts(v: Views) -> DataFrame:
    return metrics.distinct_per(dictionary.main_set(portal(v), SETS), ["SETID"], "INCHI", "n_compounds")


@query
def compound_ids(v: Views) -> DataFrame:
    return dictionary.compound_ids(compounds(v))


@query
def structure_keys(v: Views) -> DataFrame:
    return dictionary.structure_keys(compounds(v))


@query
def external_ids(v: Views) -> DataFrame:
    return dictionary.external_ids(portal(v), SETS)


@query
def probe_synonyms(v: Views) -> DataFrame:
    return dictionary.probe_synonyms(portal(v))


@query
def compound_synonyms(v: Views) -> DataFrame:
    names = dictionary.preferred_names(compounds(v))
    return names.join(dictionary.compound_synonyms(compounds(v)), "INCHI", "left")


@query
def target_synonyms(v: Views) -> DataFrame:
    return dictionary.target_synonyms(portal(v))


@query
def component_synonyms(v: Views) -> DataFrame:
    return dictionary.component_synonyms(compounds(v))


@query
def synonym_members(v: Views) -> DataFrame:
    return dictionary.synonym_members(portal(v), compounds(v))


@query
def synonym_merge(v: Views) -> DataFrame:
    return dictionary.with_synonyms(dictionary.main_set(portal(v), SETS), portal(v), compounds(v), as_text)


@query
def quality_gate(v: Views) -> DataFrame:
    rows = staged(dictionary.main_set(portal(v), SETS), "main-set")
    return dictionary.quality_gate(rows, v.portal_good(), PORTAL)


@query
def probe_dictionary(v: Views) -> DataFrame:
    return dictionary.build_dictionary(portal(v), compounds(v), v.portal_good(), SETS, PORTAL, as_text)


@query
def probe_profile(v: Views) -> DataFrame:
    names = v.compound().select(F.col("name").alias("PROBE"), F.col("inchikey").alias("INCHI"))
    probes = v.table("part").select(F.col("p_name").alias("PROBE"))
    return dictionary.probe_profile(probes, names, compounds(v), v.name_releases()).orderBy("RELEASED", "PROBE")


@query
def assay_units(v: Views) -> DataFrame:
    return dictionary.assay_units(compounds(v))


@query
def known_articles(v: Views) -> DataFrame:
    return dictionary.documents_of(article_ids(mentions(v)), compounds(v))


@query
def documented_articles(v: Views) -> DataFrame:
    return dictionary.document_articles(compounds(v))


# --- curated subset ---------------------------------------------------------------------------------


@query
def any_disease_rows(v: Views) -> DataFrame:
    return curation.with_any(report(v), ["DISEASES", "DISEASE_FOUND"])


@query
def subset_semi_chain(v: Views) -> DataFrame:
    return curation.curated_subset(staged(report(v), "report"), chosen_probes(v), control="name")


@query
def unique_triples(v: Views) -> DataFrame:
    rows = report(v).withColumn("DISEASE_FOUND", redelimit("DISEASE_FOUND"))
    return curation.unique_triples(rows)


@query
def first_per_article(v: Views) -> DataFrame:
    rows = report(v).where(differs("SECTION", "Other"))
    return curation.first_per(rows.select("PMID", "TEXT", "PROBE", "GENE"), ["PMID"])


@query
def clean_term_list(v: Views) -> DataFrame:
    return report(v).select("DISEASE_FOUND").distinct().select(
        "DISEASE_FOUND",
        strip_literal("DISEASE_FOUND").alias("stripped"),
        redelimit("DISEASE_FOUND").alias("flat"),
        join_list(quoted_items("DISEASE_FOUND"), "; ").alias("items"),
    )


@query
def normalise_terms(v: Views) -> DataFrame:
    rows = curation.named_diseases(report(v).select("PMID", "PROBE", "GENE", "DISEASES"))
    return rows.dropna(subset=["DISEASES"]).distinct()


@query
def term_grounding(v: Views) -> DataFrame:
    rows = v.table("customer").select("c_custkey", "c_mktsegment")
    return curation.ground_terms(rows, "c_mktsegment", v.terms(), overrides={"HOUSEHOLD": "ONT_HH"})


@query
def fuzzy_grounding(v: Views) -> DataFrame:
    """Misspelt and reordered names of all parts, grounded in the names of part families."""
    return fuzzy_ground_terms(v.free_terms(), "TERM", v.family_terms())


@query
def label_grounding(v: Views) -> DataFrame:
    """Gene names, the override gene among them, grounded with the hand-made entries winning."""
    gene = F.when(F.col("s_acctbal") < 0, list(GENE_OVERRIDES)[0]).otherwise(F.col("s_name"))
    genes = v.table("supplier").select(gene.alias("GENE"))
    table = with_overrides(v.gene_symbol()).withColumnsRenamed(
        {"symbol": "label", "ensembl_id": "label_id"}
    )
    return curation.ground_labels(genes, "GENE", table, "GENE_ID")


@query
def merged_export(v: Views) -> DataFrame:
    """The report as one file that all tasks write, read back."""
    path = staged_path(v.spark, "report").removesuffix(".parquet") + ".tsv"
    rows = curation.read_marks(v.curated(), counted=v.curated_mentions())
    write_merged_text(rows, path)
    return readers.read_lines(v.spark, path, rows.schema)


@query
def release_dates(v: Views) -> DataFrame:
    return curation.dated_releases(v.release_dates())


@query
def export_shape(v: Views) -> DataFrame:
    names = {"PROBE": "CD", "GENE": "GP", "DISEASES": "DS", "CONTROL": "CONTR"}
    return curation.export_columns(report(v, *names), names).distinct()


# --- counts and comparison --------------------------------------------------------------------------


@query
def corpus_profile(v: Views) -> DataFrame:
    return metrics.distinct_counts(
        report(v),
        {
            "n_articles": ["PMID"],
            "n_sentences": ["TEXT"],
            "n_probes": ["PROBE"],
            "n_pairs": ["PROBE", "GENE"],
            "n_control_pairs": ["CONTROL", "DOSAGE"],
        },
    )


@query
def disease_coverage(v: Views) -> DataFrame:
    tagged, annotated = F.col("DISEASES").isNotNull(), F.col("DISEASE_FOUND").isNotNull()
    return metrics.coverage(
        report(v),
        {"n_all": F.lit(True), "n_tagged": tagged, "n_untagged": ~tagged, "n_annotated": annotated},
        curation.MATCH,
    )


@query
def coverage_by_bitmap(v: Views) -> DataFrame:
    """Every class of rows and every union of two or more of them."""
    tagged, annotated = F.col("DISEASES").isNotNull(), F.col("DISEASE_FOUND").isNotNull()
    classes = {"tagged": tagged, "untagged": ~tagged, "annotated": annotated, "dosed": F.col("DOSAGE").isNotNull()}
    unions = {"+".join(own): own for k in range(1, 5) for own in combinations(classes, k)}
    return metrics.union_counts(staged(metrics.class_bitmaps(report(v), curation.MATCH, classes), "bitmaps"), unions)


@query
def section_counts(v: Views) -> DataFrame:
    return metrics.count_per(curation.named_sections(report(v)), ["SECTION"], "TEXT", "n_sentences")


@query
def control_classes(v: Views) -> DataFrame:
    rows = report(v).withColumn("control_class", control_class("CONTROL"))
    return metrics.distinct_per(rows, ["control_class"], "PMID", "n_articles")


@query
def pair_article_counts(v: Views) -> DataFrame:
    return metrics.distinct_per(report(v), ["PROBE", "GENE"], "PMID", "n_articles").orderBy(
        "n_articles", "PROBE", "GENE"
    )


@query
def pair_release_dates(v: Views) -> DataFrame:
    rows = triplets(v).select("pmid", F.col("CD").alias("PROBE"), F.col("GP").alias("GENE"))
    counts = metrics.distinct_per(rows, ["PROBE", "GENE"], "pmid", "n_articles")
    return curation.with_release(counts, v.release_dates())


@query
def pair_pivot(v: Views) -> DataFrame:
    """Targets by compound family: how many articles mention the two."""
    rows = v.table("lineitem").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(
        F.col("l_suppkey").alias("GENE"),
        F.replace("p_brand", F.lit("Brand#"), F.lit("B")).alias("PROBE"),
        F.col("l_orderkey").alias("PMID"),
    )
    counts = metrics.distinct_per(rows, ["GENE", "PROBE"], "PMID", "n")
    families = [r[0] for r in v.table("part").select(F.replace("p_brand", F.lit("Brand#"), F.lit("B"))).distinct().collect()]
    return metrics.pivot_counts(counts, "GENE", "PROBE", "n", sorted(families))


@query
def pivot_in_blocks(v: Views) -> DataFrame:
    """Targets by compound, each compound a column, in blocks of 256."""
    rows = v.table("lineitem").select(F.col("l_suppkey").alias("GENE"), _compound().alias("PROBE"), F.col("l_orderkey").alias("PMID"))
    counts = metrics.distinct_per(rows, ["GENE", "PROBE"], "PMID", "n")
    blocks, names = metrics.pivot_blocks(staged(counts, "pair-counts"), "GENE", "PROBE", "n")
    shown = F.array_join(F.col("cells").cast("array<string>"), " ", "-")
    first = names.where("place = 0").select("block", F.col("PROBE").alias("first_column"))
    return blocks.select("GENE", "block", shown.alias("shown")).join(first, "block")


def _compound() -> F.Column:
    return F.concat(F.lit("CD"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))


@query
def disease_gene_pivot(v: Views) -> DataFrame:
    """Diseases by gene family: the mean number of articles of its genes."""
    rows = (
        v.table("lineitem")
        .join(v.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(v.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    family = F.concat(F.lit("F"), F.col("s_nationkey"))
    rows = rows.select(F.lower("p_type").alias("DISEASES"), family.alias("GENE"), "l_suppkey", F.col("l_orderkey").alias("PMID"))
    counts = metrics.distinct_per(rows, ["DISEASES", "GENE", "l_suppkey"], "PMID", "n")
    listed = [r[0] for r in v.table("nation").select(F.concat(F.lit("F"), F.col("n_nationkey"))).collect()]
    return metrics.pivot_counts(counts, "DISEASES", "GENE", "n", sorted(listed), mean=True)


@query
def disease_histogram(v: Views) -> DataFrame:
    rows = curation.named_diseases(report(v, "PMID", "PROBE", "GENE", "DISEASES"))
    return metrics.histogram_text(
        rows.distinct(), ["PROBE", "GENE"], "DISEASES", "all_diseases", "n_articles"
    )


@query
def gene_disease_counts(v: Views) -> DataFrame:
    return metrics.count_per(report(v), ["GENE", "DISEASES"], "PMID", "n_articles")


@query
def top_k_terms(v: Views) -> DataFrame:
    return metrics.top_terms(report(v).dropna(subset=["DISEASES"]), "DISEASES", 10)


@query
def frequent_terms(v: Views) -> DataFrame:
    """The same by a sketch of few counters."""
    return sketches.frequent_terms(report(v).dropna(subset=["DISEASES"]), "DISEASES", 10, width=64)


@query
def article_sketch(v: Views) -> DataFrame:
    """Articles by section, and of all together, from sketches kept by section and year; with the exact numbers."""
    rows = mentions(v).select("pmid", "section", F.year("date").alias("year"))
    kept = staged(sketches.distinct_sketches(rows, ["section", "year"], "pmid"), "article-sketches")
    merged = sketches.merged_sketches(kept, ["section"], "about").unionByName(
        sketches.merged_sketches(kept, [], "about").withColumn("section", F.lit("all"))
    )
    exact = rows.groupBy("section").agg(F.count_distinct("pmid").alias("n")).unionByName(
        rows.agg(F.count_distinct("pmid").alias("n")).withColumn("section", F.lit("all"))
    )
    return exact.join(merged, "section").select("section", "n", (F.abs(F.col("about") - F.col("n")) <= 0.02 * F.col("n")).alias("within"))


@query
def entity_listing(v: Views) -> DataFrame:
    return metrics.listing(v.probe_sets(), ["SET"], "PROBE", "probes")


def _gold_and_auto(v: Views) -> tuple[DataFrame, DataFrame]:
    found = staged(triplets(v).select("pmid", "section", "CD", "GP", "DS"), "triplets")
    gold = F.col("section").isin(*GROUNDED_SECTIONS)
    return found.where(~gold).drop("section"), found.where(gold).drop("section")


@query
def compare_triplets(v: Views) -> DataFrame:
    return compare.compare_triplets(*_gold_and_auto(v))


@query
def compare_triplets_split(v: Views) -> DataFrame:
    """The same with pairs cut into small cells."""
    return compare.compare_triplets(*_gold_and_auto(v), max_product=2)


@query
def grounded_comparison(v: Views) -> DataFrame:
    """The curated set, grounded, beside the extracted triplets of the same compound and target."""
    found = staged(triplets(v).select("pmid", "CD", "GP", "DS"), "triplets")
    curated = curation.grounded_triples(report(v, *curation.MATCH, "DISEASES"), *v.grounding()).withColumnRenamed("PMID", "pmid")
    return compare.compare_triplets(found, staged(curated, "grounded"))


@query
def grounded_histogram(v: Views) -> DataFrame:
    """Diseases of each compound and target in the grounded set."""
    curated = curation.grounded_triples(report(v, *curation.MATCH, "DISEASES"), *v.grounding())
    return metrics.histogram_text(curated, ["CD", "GP"], "DS", "all_diseases", "n_articles")


@query
def pair_agreement(v: Views) -> DataFrame:
    return compare.pair_agreement(*_gold_and_auto(v))


def _text_sets(v: Views) -> tuple[DataFrame, DataFrame]:
    """English documents, and those in other languages or labelled good: together all of them."""
    docs = v.table("documents")
    good = v.table("labels").where(F.col("quality") == 1).select("doc_id", F.lit(True).alias("good"))
    return (
        docs.where(F.col("lang") == "en").select("text"),
        docs.join(good, "doc_id", "left").where((F.col("lang") != "en") | F.col("good")).select("text"),
    )


@query
def sentence_overlap(v: Views) -> DataFrame:
    return compare.overlap(*_text_sets(v), "text")


@query
def sentences_common(v: Views) -> DataFrame:
    return compare.common(*_text_sets(v))


@query
def sentences_only_first(v: Views) -> DataFrame:
    return compare.only_in_first(*_text_sets(v))


@query
def sentences_only_second(v: Views) -> DataFrame:
    return compare.only_in_first(*reversed(_text_sets(v)))
