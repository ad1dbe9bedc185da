"""Building the compound dictionary from the probe portal and the compound database.

Each per-key query of a hand-written loop is one set-based join here.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litevidence.constants import (
    CALCULATED_ORIGIN, DICTIONARY_SETS, EXTERNAL_COMPOUND_DB, PORTAL_SET, SYNONYM_ATTRIBUTE_TYPE,
)
from litevidence.functions.text import differs, literal_items, split_list, strip_literal
from litevidence.operators.curation import with_release
from litevidence.operators.skew import spread_left, spread_semi
from litevidence.sources.writers import staged

Tables = Mapping[str, DataFrame]
Shown = Callable[[Column], Column]

LONG_LIST = 4_096  # bytes of a list that is wide beside the row it is added to


def as_is(terms: Column) -> Column:
    return terms


def main_set(portal: Tables, sets: Collection[str] = DICTIONARY_SETS) -> DataFrame:
    """Reported probes of the chosen sets with their targets; the compound may be missing.

    Probes, targets and their links are made distinct each, so that their combinations, many more and wider, need not be.
    Probes get the name of their set before they are combined, for the same reason.
    """
    probe = portal["probe"].where(F.col("origin_id") != CALCULATED_ORIGIN)
    probe = probe.where(F.col("compoundset_id").cast("string").isin(*sets))
    compound = portal["compound"].select("compoundid", F.col("name").alias("PROBE"), "inchikey")
    names = portal["compoundset"].select(
        F.col("compoundsetid").alias("SETID"), F.col("name").alias("SET")
    ).where(F.col("SETID").cast("string").isin(*sets))
    probes = (
        probe.join(compound, F.col("compound_id") == F.col("compoundid"), "left")
        .select(
            F.col("probeid").alias("ID"),
            F.col("compoundset_id").alias("SETID"),
            "PROBE",
            F.col("inchikey").alias("INCHI"),
            F.col("control").alias("CONTR"),
        )
        .distinct()
        .join(names.distinct(), ["SETID"])
    )
    proteins = (
        portal["targettobasetarget"]
        .join(portal["target"], F.col("targetid") == F.col("target_id"))
        .select(F.col("basetarget_id").alias("_protein_of"), F.col("uniprotid").alias("UNIPROT"))
        .distinct()
    )
    targets = (
        portal["basetarget"].select(F.col("basetargetid").alias("_target"), F.col("gene_name").alias("GENE"))
        .distinct()
        .join(proteins, F.col("_protein_of") == F.col("_target"))
    )
    rows = (
        portal["probetobasetarget"].select("probe_id", F.col("basetarget_id").alias("TARGETID"))
        .distinct()
        .join(probes, F.col("probe_id") == F.col("ID"))
        .join(targets, F.col("TARGETID") == F.col("_target"))
        .select("SETID", "ID", "UNIPROT", "PROBE", "INCHI", "GENE", "CONTR", "TARGETID", "SET")
    )
    return rows.withColumn("CONTR", strip_literal("CONTR")).withColumn("GENE", literal_items("GENE"))


def compound_ids(compounds: Tables) -> DataFrame:
    """The compound id of each structure key: the lowest one."""
    return (
        compounds["molecule_dictionary"].select("molregno", "compound_key")
        .join(compounds["compound_structures"].select("molregno", "standard_inchi_key"), "molregno")
        .groupBy(F.col("standard_inchi_key").alias("INCHI"))
        .agg(F.min("compound_key").alias("COMPOUND_KEY"))
    )


def structure_keys(compounds: Tables) -> DataFrame:
    """The structure key of each compound id: the inverse of `compound_ids`."""
    return (
        compounds["molecule_dictionary"].select("molregno", "compound_key")
        .join(compounds["compound_structures"].select("molregno", "standard_inchi_key"), "molregno")
        .groupBy(F.col("compound_key").alias("COMPOUND_KEY"))
        .agg(F.min("standard_inchi_key").alias("INCHI"))
    )


def external_ids(portal: Tables, sets: Collection[str] = DICTIONARY_SETS) -> DataFrame:
    """Ids that the portal itself gives for the probes of the sets in the compound database."""
    links = portal["compoundtoexternaldb"].where(F.col("externaldb_id") == EXTERNAL_COMPOUND_DB)
    return (
        portal["probe"].where(F.col("compoundset_id").cast("string").isin(*sets))
        .join(portal["compound"], F.col("compound_id") == F.col("compoundid"))
        .join(links.withColumnRenamed("compound_id", "linked"), F.col("linked") == F.col("compoundid"))
        .select("probeid", "name", "inchikey", "ligand_id")
        .distinct()
    )


def probe_synonym_members(portal: Tables) -> DataFrame:
    """Portal synonyms of each probe, a row each: ID, value."""
    attribute = portal["attribute"].where(F.col("type_id") == SYNONYM_ATTRIBUTE_TYPE)
    kinds = portal["attributetype"].select("attributetypeid").distinct()
    return (
        portal["probe"].select("probeid", F.col("compound_id").alias("pc"))
        .join(portal["compound"].select("compoundid"), F.col("pc") == F.col("compoundid"))
        .join(portal["compoundattribute"], F.col("compound_id") == F.col("compoundid"))
        .join(portal["attributevalue"], F.col("value_id") == F.col("attributevalueid"))
        .join(attribute, F.col("attribute_id") == F.col("attributeid"))
        .join(kinds, F.col("type_id") == F.col("attributetypeid"), "left_semi")
        .select(F.col("probeid").alias("ID"), F.translate("value", "'", "").alias("value"))
        .transform(_members("ID", "value"))
    )


def probe_synonyms(portal: Tables) -> DataFrame:
    """The same as a sorted array per probe."""
    return _listed(probe_synonym_members(portal), "ID", "value", "SYNOMS")


def compound_synonym_members(compounds: Tables) -> DataFrame:
    """Compound-database synonyms of each structure key, a row each: INCHI, value."""
    return (
        compounds["molecule_synonyms"]
        .join(compounds["molecule_dictionary"].select("molregno"), "molregno", "left_semi")
        .join(compounds["compound_structures"], "molregno")
        .select(F.col("standard_inchi_key").alias("INCHI"), F.col("synonyms").alias("value"))
        .transform(_members("INCHI", "value"))
    )


def compound_synonyms(compounds: Tables) -> DataFrame:
    """The same as a sorted array per structure key."""
    return _listed(compound_synonym_members(compounds), "INCHI", "value", "SYNOMS_DB")


def preferred_names(compounds: Tables) -> DataFrame:
    """The preferred name of each structure key: the lowest one when there are several."""
    return (
        compounds["molecule_dictionary"].select("molregno", "pref_name")
        .join(compounds["compound_structures"], "molregno")
        .groupBy(F.col("standard_inchi_key").alias("INCHI"))
        .agg(F.min("pref_name").alias("PREF_NAME"))
    )


def structure_phases(compounds: Tables) -> DataFrame:
    """The furthest clinical phase of each structure key."""
    return (
        compounds["molecule_dictionary"].select("molregno", "max_phase")
        .join(compounds["compound_structures"], "molregno")
        .groupBy(F.col("standard_inchi_key").alias("INCHI"))
        .agg(F.max("max_phase").alias("MAX_PHASE"))
    )


def probe_profile(
    probes: DataFrame, names: DataFrame, compounds: Tables, releases: DataFrame
) -> DataFrame:
    """Structure, id, phase and release of each compound name.

    `names` maps PROBE to INCHI; a name with several structures gets the lowest.
    """
    structures = names.groupBy("PROBE").agg(F.min("INCHI").alias("INCHI"))
    rows = (
        probes.select("PROBE").distinct()
        .join(structures, "PROBE", "left")
        .transform(lambda rows: spread_left(rows, compound_ids(compounds).dropna(subset=["INCHI"]), "INCHI"))
        .transform(lambda rows: spread_left(rows, structure_phases(compounds).dropna(subset=["INCHI"]), "INCHI"))
    )
    return with_release(rows, releases)


def target_synonym_members(portal: Tables) -> DataFrame:
    """Portal synonyms of each base target, a row each: TARGETID, value."""
    return portal["targetsynonym"].select(
        F.col("basetarget_id").alias("TARGETID"), F.col("synonym").alias("value")
    ).transform(_members("TARGETID", "value"))


def target_synonyms(portal: Tables) -> DataFrame:
    """The same as a sorted array per base target."""
    return _listed(target_synonym_members(portal), "TARGETID", "value", "SYNOMS_TARGET")


def component_synonym_members(compounds: Tables) -> DataFrame:
    """Compound-database synonyms of each protein accession, a row each: UNIPROT, value."""
    return (
        compounds["component_synonyms"]
        .join(compounds["component_sequences"], "component_id")
        .select(F.col("accession").alias("UNIPROT"), F.col("component_synonym").alias("value"))
        .transform(_members("UNIPROT", "value"))
    )


def component_synonyms(compounds: Tables) -> DataFrame:
    """The same as a sorted array per accession."""
    return _listed(component_synonym_members(compounds), "UNIPROT", "value", "SYNOMS_TARGET_DB")


def synonym_members(portal: Tables, compounds: Tables) -> DataFrame:
    """All synonyms of compounds and targets in long form: source, key, term, without copies.

    No list is made, so a key may have any number of synonyms. `source` says what the key is: probe, structure, target or
    protein. Rows without a key go.
    """
    found = (
        ("probe", probe_synonym_members(portal)), ("structure", compound_synonym_members(compounds)),
        ("target", target_synonym_members(portal)), ("protein", component_synonym_members(compounds)),
    )
    parts = []
    for source, rows in found:
        key, value = rows.columns
        parts.append(rows.dropna().select(F.lit(source).alias("source"), F.col(key).cast("string").alias("key"), F.col(value).alias("term")))
    return reduce(DataFrame.unionByName, parts)


def _members(key: str, value: str):
    """Distinct values per key, a row each.

    Values holding a `, ` are taken apart, as they will be when the dictionary is read from text.
    """
    return lambda rows: rows.select(key, F.explode(split_list(value)).alias(value)).distinct()


def _listed(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Distinct values per key as a sorted array. This is the shape of the dictionary, whose keys have few values each."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))


def merged(*columns: str) -> Column:
    """Distinct members of several arrays, sorted; a missing array counts as empty."""
    present = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns]
    return F.array_sort(F.array_distinct(F.concat(*present)))


def compound_terms(portal: Tables, compounds: Tables) -> DataFrame:
    """Preferred name and synonyms from both sources, once per probe and structure."""
    inchi = portal["compound"].select("compoundid", F.col("inchikey").alias("INCHI"))
    return (
        portal["probe"].join(inchi, F.col("compound_id") == F.col("compoundid"), "left")
        .select(F.col("probeid").alias("ID"), "INCHI")
        .distinct()
        .join(probe_synonyms(portal), "ID", "left")
        .transform(lambda rows: spread_left(rows, preferred_names(compounds).dropna(), "INCHI"))
        .transform(lambda rows: spread_left(rows, compound_synonyms(compounds).dropna(), "INCHI"))
        .select("ID", "INCHI", "PREF_NAME", merged("SYNOMS", "SYNOMS_DB").alias("SYNOMS"))
    )


def target_lists(portal: Tables, compounds: Tables, shown: Shown = as_is) -> tuple[DataFrame, DataFrame]:
    """Targets by the list they have, (TARGETID, UNIPROT, TERMS), and each list once, (TERMS, SYNOMS_TARGET).

    A protein's list is as long as its names are many, and all its targets have it. So it is merged once for each set of
    portal synonyms beside it, and `shown`, the shape of a list in the result, is made as often.
    """
    pairs = (
        portal["targettobasetarget"]
        .join(portal["target"], F.col("targetid") == F.col("target_id"))
        .select(F.col("basetarget_id").alias("TARGETID"), F.col("uniprotid").alias("UNIPROT"))
        .distinct()
        .join(target_synonyms(portal), "TARGETID", "left")
        .withColumn("TERMS", F.md5(F.to_json(F.struct("UNIPROT", "SYNOMS_TARGET"))))
    )
    lists = (
        pairs.groupBy("TERMS").agg(F.first("UNIPROT").alias("UNIPROT"), F.first("SYNOMS_TARGET").alias("SYNOMS_TARGET"))
        .join(component_synonyms(compounds), "UNIPROT", "left")
        .select("TERMS", shown(merged("SYNOMS_TARGET", "SYNOMS_TARGET_DB")).alias("SYNOMS_TARGET"))
    )
    return pairs.select("TARGETID", "UNIPROT", "TERMS"), lists


def target_terms(portal: Tables, compounds: Tables) -> DataFrame:
    """Synonyms from both sources, once per base target and protein."""
    pairs, lists = target_lists(portal, compounds)
    return pairs.join(lists, "TERMS").drop("TERMS")


def with_lists(rows: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """Adds the list that a row's `key` stands for, as the last step: after it no row is shuffled with its list.

    Rows come out by their list, so a file that holds each value of a column once stays small. What a task has to write is
    its rows times their lists, which sizes of shuffled rows do not show. So the rows of a long list are dealt to
    cells by its share of the text of all lists, two partitions a cell, and these are not merged: a task has few lists.
    Starts jobs when called: `lists` is read for its sizes, so it should be a written table or small.
    """
    (name,) = [c for c in lists.columns if c != key]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = lists.groupBy(key).agg(F.max(F.octet_length(F.col(name).cast("string"))).alias("_size"))
    total = sizes.agg(F.sum("_size")).first()[0] or 1
    # Fewer than half of `partitions` lists have more than one share of the text.
    cells = sizes.where(F.col("_size") >= LONG_LIST).select(
        key, F.ceil(F.col("_size") * (partitions / 2 / total)).cast("int").alias("_cells")
    ).where("_cells > 1")
    if cells.isEmpty():
        return spread_left(rows, lists.hint("merge"), key).drop(key)
    many = F.coalesce("_cells", F.lit(1))
    own = F.pmod(F.xxhash64(*rows.columns), many)
    left = rows.join(F.broadcast(cells), key, "left").withColumn(key, F.concat(own.cast("string"), F.lit("/"), key)).drop("_cells")
    right = lists.join(F.broadcast(cells), key, "left").withColumn("_cell", F.explode(F.sequence(F.lit(0), many - 1)))
    right = right.select(F.concat(F.col("_cell").cast("string"), F.lit("/"), key).alias(key), name)
    return spread_left(left, right.hint("merge"), key, partitions).drop(key)


def with_compound_terms(rows: DataFrame, portal: Tables, compounds: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Adds preferred name and the merged synonyms of the compound; a list is merged once per compound.

    `ids`, a row per structure key, come along with these.
    """
    terms = compound_terms(portal, compounds)
    if ids is not None:
        terms = spread_left(terms, ids, "INCHI")
    terms = terms.withColumnsRenamed({"ID": "_id", "INCHI": "_inchi"})
    same = (F.col("ID") == F.col("_id")) & F.col("INCHI").eqNullSafe(F.col("_inchi"))
    return rows.join(terms, same, "left").drop("_id", "_inchi")


def with_synonyms(rows: DataFrame, portal: Tables, compounds: Tables, shown: Shown = as_is) -> DataFrame:
    """Adds preferred name and the merged synonyms of compound and target to the main set.

    The lists are merged once per compound and once per kind of target, before the many-to-many main set.
    """
    pairs, lists = target_lists(portal, compounds, shown)
    # By target alone, as the rows of the main set lie, so they are not shuffled for it.
    of_target = (
        pairs.where(F.col("UNIPROT").isNotNull()).groupBy("TARGETID")
        .agg(F.map_from_entries(F.collect_list(F.struct("UNIPROT", "TERMS"))).alias("_terms"))
    )
    keyed = rows.join(of_target, "TARGETID", "left").withColumn("TERMS", F.col("_terms")[F.col("UNIPROT")])
    keyed = with_compound_terms(keyed.drop("_terms"), portal, compounds)
    others = [c for c in keyed.columns if c not in ("TARGETID", "UNIPROT")]
    keyed = keyed.select("TARGETID", "UNIPROT", *others)
    return with_lists(keyed, staged(lists, "target-lists"), "TERMS")


def quality_gate(rows: DataFrame, portal_good: DataFrame, portal_set: str = PORTAL_SET) -> DataFrame:
    """Rows whose structure is in a trusted set or on the portal's good list.

    A missing structure matches a missing structure, so such rows stay when a trusted set has one.
    """
    trusted = rows.where(differs("SET", portal_set)).select(F.col("INCHI").alias("key"))
    good = portal_good.select(F.col("InChI key").alias("key"))
    return spread_semi(rows, trusted.unionByName(good).distinct(), "INCHI", "key")


def build_dictionary(
    portal: Tables,
    compounds: Tables,
    portal_good: DataFrame | None = None,
    sets: Collection[str] = DICTIONARY_SETS,
    portal_set: str = PORTAL_SET,
    shown: Shown = as_is,
) -> DataFrame:
    """The compound dictionary: main set, ids, names, synonyms, and the quality gate if a list is given.

    `shown` is the shape of a target's list in the result.
    """
    rows = main_set(portal, sets)
    if portal_good is not None:
        # The gate looks at sets and structures only, so it comes before the costlier steps.
        rows = quality_gate(staged(rows, "main-set"), portal_good, portal_set)
    # Rows are made distinct by ids: targets with the same protein and synonyms stand for each other.
    pairs, lists = target_lists(portal, compounds, shown)
    lists = staged(lists.withColumn("_terms", F.md5(F.to_json(F.struct("SYNOMS_TARGET")))), "target-lists")
    alike = pairs.join(lists.select("TERMS", "_terms"), "TERMS").drop("TERMS")
    columns = ["ID", "SETID", "UNIPROT", "PROBE", "SET", "INCHI", "GENE", "CONTR"]
    once = (
        rows.join(alike, ["TARGETID", "UNIPROT"], "left")
        .select(*columns, "_terms")
        .distinct()
    )
    lists = lists.groupBy("_terms").agg(F.first("SYNOMS_TARGET").alias("SYNOMS_TARGET"))
    # The id of a compound depends on its structure, so it is looked up once per compound.
    ids = compound_ids(compounds).dropna(subset=["INCHI"])
    rows = with_lists(with_compound_terms(once, portal, compounds, ids), lists, "_terms")
    return rows.select(
        "SETID", "UNIPROT", "PROBE", "SET", "INCHI", "GENE", "CONTR", "COMPOUND_KEY", "PREF_NAME", "SYNOMS",
        "SYNOMS_TARGET",
    )


def assay_units(compounds: Tables) -> DataFrame:
    """Units used with each kind of assay, among activities that have a potency value."""
    return (
        compounds["activities"].where(F.col("potency").isNotNull()).select("units", "assay_id")
        .distinct()
        .join(compounds["assays"], "assay_id")
        .select("units", "assay_type")
        .distinct()
        .join(compounds["assay_type"], "assay_type")
        .select("units", "assay_desc")
        .distinct()
    )


def document_articles(compounds: Tables) -> DataFrame:
    """Distinct article ids that the compound database holds data from."""
    return compounds["docs"].select(F.col("pubmed_id").alias("pmid")).distinct()


def documents_of(articles: DataFrame, compounds: Tables) -> DataFrame:
    """Documents of the given articles in the compound database."""
    docs = compounds["docs"].select(F.col("pubmed_id").alias("pmid"), "doc_id", "document_key").distinct()
    return docs.join(articles.select("pmid").distinct(), "pmid", "left_semi")
