"""The engine's input tables, derived from the test tables as described in FIXTURES.md.

Every view reads its whole source tables. Columns play roles: a line item is an entity mention, an order
an article, a part a compound, a supplier a target, a quantity (or part size) a disease.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litevidence.constants import DISEASE_NAMES, DISEASE_TAGS

TAGS = (*DISEASE_TAGS, *DISEASE_NAMES)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A test table; opened once per query, since opening reads the file's schema."""
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._opened[name]

    # --- literature -------------------------------------------------------------------------------

    def raw_matches(self) -> DataFrame:
        """Entity mentions under the column names of the annotation service; copies are kept."""
        ident = (
            F.when(F.col("l_returnflag") == "A", _id("CD", "l_partkey"))
            .when(F.col("l_returnflag") == "N", _id("GP", "l_suppkey"))
            .otherwise(_id("DS", F.col("l_quantity").cast("int")))
        )
        return (
            self.table("lineitem")
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("l_orderkey").cast("string").alias("pmid"),
                F.concat_ws(" ", "p_name", "p_brand").alias("label"),
                ident.alias("keywordId"),
                _kind().alias("type"),
                F.col("o_orderdate").cast("date").alias("pubDate"),
                F.col("o_orderstatus").alias("section"),
                F.col("o_orderpriority").alias("text"),
            )
        )

    def mention_articles(self) -> DataFrame:
        """Article and type of each mention, nothing else."""
        return self.table("lineitem").select(
            F.col("l_orderkey").cast("string").alias("pmid"), _kind().alias("entity_type")
        )

    def dictionary_text(self) -> DataFrame:
        """Compound dictionary as it is read from a text file: synonyms delimited in one string."""
        return (
            self.table("part")
            .where(F.col("p_brand") == "Brand#7")
            .select(
                _id("CD", "p_partkey").alias("COMPOUND_KEY"),
                F.col("p_name").alias("PROBE"),
                F.concat(
                    "p_brand", F.lit(", "), F.concat_ws(" ", "p_name", "p_brand"), F.lit(",  "), "p_type"
                ).alias("SYNOMS"),
            )
        )

    def dictionary_targets(self) -> DataFrame:
        """Compound dictionary rows with gene lists as text; one compound may be in several sets. Copies, of which there are few, are kept."""
        gene = F.when(
            F.col("s_acctbal") < 0,
            F.concat(F.lit("['ALT-"), "s_suppkey", F.lit("', '"), "s_name", F.lit("']")),
        ).otherwise(F.concat(F.lit("['"), "s_name", F.lit("']")))
        return (
            self.table("lineitem")
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                _id("CD", "l_partkey").alias("COMPOUND_KEY"),
                F.col("l_returnflag").alias("SETID"),
                gene.alias("GENE"),
            )
        )

    def gene_symbol(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_name").alias("symbol"), _id("GP", "s_suppkey").alias("ensembl_id")
        )

    def blacklist(self) -> DataFrame:
        """Disease ids with a trailing blank, as in the shipped list."""
        return (
            self.table("part")
            .where(F.col("p_size") >= 46)
            .select(F.concat(F.lit("DS_"), "p_size", F.lit(" ")).alias("diseaseId"))
            .distinct()
        )

    # --- evidence ---------------------------------------------------------------------------------

    def evidence(self) -> DataFrame:
        """Evidence for diseases three places on, so that the first diseases have none.

        A group has a few rows from all over the table: they are counted after the shuffle, not held by each task of the scan as well.
        """
        keys = ("diseaseId", "targetId", "datasourceId")
        return (
            self.table("lineitem")
            .select(
                _id("DS", F.col("l_quantity").cast("int") + 3).alias("diseaseId"),
                _id("GP", "l_suppkey").alias("targetId"),
                F.col("l_returnflag").alias("datasourceId"),
                "l_discount",
            )
            .repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *keys)
            .groupBy(*keys)
            .agg(
                F.round(F.avg("l_discount"), 6).alias("score"),
                F.count(F.lit(1)).alias("evidenceCount"),
            )
            .withColumn("datatypeId", F.lower("datasourceId"))
        )

    def dated_evidence(self) -> DataFrame:
        ship_year = F.year("l_shipdate")
        return (
            self.table("lineitem")
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("l_linestatus").alias("sourceId"),
                _id("DS", F.col("l_quantity").cast("int")).alias("diseaseId"),
                _id("GP", "l_suppkey").alias("targetId"),
                F.col("l_returnflag").alias("datasourceId"),
                F.year("o_orderdate").alias("curationYear"),
                ship_year.alias("publicationYear"),
                F.when(F.col("l_tax") > 0.04, ship_year).alias("studyYear"),
            )
        )

    def late_evidence(self) -> DataFrame:
        """Dated evidence for diseases three places on, so that the first diseases have none."""
        return (
            self.table("lineitem")
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                _id("DS", F.col("l_quantity").cast("int") + 3).alias("diseaseId"),
                _id("GP", "l_suppkey").alias("targetId"),
                F.col("l_returnflag").alias("datasourceId"),
                F.year("o_orderdate").alias("curationYear"),
                F.year("l_shipdate").alias("publicationYear"),
                F.lit(None).cast("int").alias("studyYear"),
            )
        )

    def disease(self) -> DataFrame:
        """Ontology terms; sizes above 44 are unknown to it, 43 has no areas, 44 an empty list."""
        n = F.col("p_size")
        area = lambda prefix, low, high: F.when(
            n.between(low, high), F.concat(F.lit(prefix), n)
        )
        areas = F.array_compact(
            F.array(
                area("GO_", 34, 42), area("MONDO_", 1, 19), area("OTAR_", 12, 30), area("EFO_", 15, 38)
            )
        )
        return (
            self.table("part")
            .where(n <= 44)
            .select("p_size")
            .distinct()
            .select(
                _id("DS", "p_size").alias("id"),
                F.concat(F.lit("disease "), n).alias("name"),
                F.when(n != 43, areas).alias("therapeuticAreas"),
            )
        )

    def known_drug(self) -> DataFrame:
        return self.table("lineitem").select(
            _id("DR", "l_partkey").alias("drugId"),
            _id("GP", "l_suppkey").alias("targetId"),
            _id("DS", F.col("l_quantity").cast("int")).alias("diseaseId"),
            F.col("l_linenumber").cast("double").alias("phase"),
            F.col("l_linestatus").alias("status"),
        )

    def article_type(self) -> DataFrame:
        """Publication types per article; the lowest priority has no row, the fourth no list."""
        priority = F.col("o_orderpriority")
        pubtypes = (
            F.when(priority == "1-URGENT", F.array(F.lit("Review")))
            .when(priority == "2-HIGH", F.array(F.lit("Journal Article"), F.lit("Systematic Review")))
            .when(priority == "3-MEDIUM", F.array(F.lit("Journal Article")))
        )
        return (
            self.table("orders")
            .where(priority != "5-LOW")
            .select(
                F.col("o_orderkey").cast("string").alias("pmid"),
                pubtypes.alias("pubtypes"),
                F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("Order of "), "o_custkey")).alias(
                    "title"
                ),
            )
        )

    def articles(self) -> DataFrame:
        """Article ids to classify, padded with blanks as a careless export would have them."""
        return self.table("lineitem").select(
            F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit(" ")).alias("pmid")
        )

    # --- compound dictionary sources ----------------------------------------------------------------

    def probe(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("probeid"),
            F.col("p_partkey").alias("compound_id"),
            F.col("p_type").alias("compoundset_id"),
            F.when(F.col("p_brand") == "Brand#13", "calculated")
            .when(F.col("p_brand") != "Brand#14", F.col("p_brand"))
            .alias("origin_id"),
            F.concat(F.lit("['"), "p_brand", F.lit("']")).alias("control"),
        )

    def compound(self) -> DataFrame:
        return self.table("part").where(F.col("p_size") > 5).select(
            F.col("p_partkey").alias("compoundid"),
            F.col("p_name").alias("name"),
            _id("IK", "p_partkey").alias("inchikey"),
        )

    def compoundset(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_type").alias("compoundsetid"), F.concat(F.lit("set "), "p_type").alias("name")
        ).distinct()

    def probetobasetarget(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_partkey").alias("probe_id"), F.col("l_suppkey").alias("basetarget_id")
        ).distinct()

    def basetarget(self) -> DataFrame:
        gene = F.when(
            F.col("s_acctbal") < 0,
            F.concat(F.lit("['"), "s_name", F.lit("', 'ALT"), "s_suppkey", F.lit("']")),
        ).otherwise(F.concat(F.lit("['"), "s_name", F.lit("']")))
        return self.table("supplier").select(
            F.col("s_suppkey").alias("basetargetid"), gene.alias("gene_name")
        )

    def targettobasetarget(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("basetarget_id"), F.col("s_nationkey").alias("target_id")
        )

    def target(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("targetid"), F.col("n_name").alias("uniprotid")
        )

    def compoundtoexternaldb(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("compound_id"),
            F.when(F.col("p_size") < 17, 1).when(F.col("p_size") < 34, 2).otherwise(3).alias("externaldb_id"),
            _id("L", "p_partkey").alias("ligand_id"),
        )

    def attribute_links(self) -> dict[str, DataFrame]:
        """The attribute tables: compound -> value -> attribute -> attribute type."""
        values = self.table("lineitem").select("l_linenumber").distinct()
        return {
            "compoundattribute": self.table("lineitem").select(
                F.col("l_partkey").alias("compound_id"), F.col("l_linenumber").alias("value_id")
            ).distinct(),
            "attributevalue": values.select(
                F.col("l_linenumber").alias("attributevalueid"),
                F.concat(F.lit("S"), "l_linenumber").alias("value"),
                F.col("l_linenumber").alias("attribute_id"),
            ),
            "attribute": values.select(
                F.col("l_linenumber").alias("attributeid"),
                F.when(F.col("l_linenumber").isin(3, 5, 7), "3").otherwise("1").alias("type_id"),
            ),
            "attributetype": values.select(
                F.when(F.col("l_linenumber").isin(3, 5, 7), "3").otherwise("1").alias("attributetypeid")
            ).distinct(),
        }

    def targetsynonym(self) -> DataFrame:
        named = (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        )
        return named.select(
            F.col("s_suppkey").alias("basetarget_id"), F.col("n_name").alias("synonym")
        ).unionByName(
            named.select(F.col("s_suppkey").alias("basetarget_id"), F.col("r_name").alias("synonym"))
        )

    def molecule_dictionary(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("molregno"),
            _id("CD", "p_partkey").alias("compound_key"),
            F.when(F.col("p_brand") != "Brand#3", F.col("p_name")).alias("pref_name"),
            F.floor(F.col("p_size") / 10).cast("int").alias("max_phase"),
        )

    def compound_structures(self) -> DataFrame:
        return self.table("part").where(F.col("p_size") < 44).select(
            F.col("p_partkey").alias("molregno"), _id("IK", "p_partkey").alias("standard_inchi_key")
        )

    def molecule_synonyms(self) -> DataFrame:
        parts = self.table("part").where(F.col("p_type") != "SMALL")
        return parts.select(
            F.col("p_partkey").alias("molregno"), F.col("p_brand").alias("synonyms")
        ).unionByName(
            parts.select(F.col("p_partkey").alias("molregno"), F.col("p_type").alias("synonyms"))
        )

    def component_sequences(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("component_id"), F.col("n_name").alias("accession")
        )

    def component_synonyms(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_nationkey").alias("component_id"), F.col("s_name").alias("component_synonym")
        )

    def portal_good(self) -> DataFrame:
        return self.table("part").where(F.col("p_size") >= 25).select(
            _id("IK", "p_partkey").alias("InChI key")
        )

    def activities(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_returnflag").alias("units"),
            F.col("l_orderkey").alias("assay_id"),
            F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("potency"),
        )

    def assays(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("assay_id"), F.col("o_orderstatus").alias("assay_type")
        )

    def assay_type(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderstatus").alias("assay_type"),
            F.concat(F.lit("assay "), "o_orderstatus").alias("assay_desc"),
        ).distinct()

    def docs(self) -> DataFrame:
        return self.table("orders").where(F.col("o_totalprice") > 200000).select(
            F.col("o_orderkey").cast("string").alias("pubmed_id"),
            F.col("o_custkey").alias("doc_id"),
            _id("DOC", "o_orderkey").alias("document_key"),
        )

    # --- curated subset -----------------------------------------------------------------------------

    def curated(self) -> DataFrame:
        """The curated report: one row per tagged compound-target pair of a sentence, all strings."""
        line = F.col("l_linenumber")
        tags = F.array(*[F.lit(tag) for tag in TAGS])
        return (
            self.table("lineitem")
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("l_orderkey").cast("string").alias("PMID"),
                _id("PMC", "l_orderkey").alias("PMCID"),
                F.concat_ws(" ", "p_name", "o_orderpriority").alias("TEXT"),
                F.when(F.col("o_orderpriority") == "1-URGENT", "Other")
                .when(F.col("o_orderpriority") == "2-HIGH", "RESULTS,DISCUSS")
                .when(F.col("o_orderpriority") == "3-MEDIUM", "DISCUSS,CONCL")
                .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "title")
                .alias("SECTION"),
                F.col("p_name").alias("PROBE"),
                F.concat(F.lit("GENE"), "l_suppkey").alias("GENE"),
                F.when(line.isin(2, 4, 6), "None")
                .when(line == 1, F.concat(F.lower("p_type"), F.lit(",cancer")))
                .when(line == 3, F.element_at(tags, F.pmod("l_partkey", F.lit(len(TAGS))).cast("int") + 1))
                .otherwise(F.concat(F.lower("p_type"), F.lit(" tumors")))
                .alias("DISEASES"),
                F.when(line.isin(3, 6), "[]")
                .otherwise(
                    F.concat(F.lit("['"), F.lower("p_brand"), F.lit(" cancer', 'defect', 'defects']"))
                )
                .alias("DISEASE_FOUND"),
                F.when(F.col("l_returnflag") == "A", F.concat(F.lit("C"), "p_brand"))
                .when(F.col("l_returnflag") == "N", F.lit("Keyword"))
                .alias("CONTROL"),
                F.when(F.col("l_tax") > 0.06, "IC50").alias("DOSAGE"),
            )
        )

    def curated_mentions(self) -> DataFrame:
        """What each row of the report has of its mention alone, for counting."""
        return self.table("lineitem").select(
            F.col("l_orderkey").cast("string").alias("PMID"),
            F.concat(F.lit("GENE"), "l_suppkey").alias("GENE"),
            F.when(F.col("l_tax") > 0.06, "IC50").alias("DOSAGE"),
        )

    def probe_sets(self) -> DataFrame:
        """Which set a compound name belongs to."""
        return self.table("part").select(F.col("p_name").alias("PROBE"), F.col("p_brand").alias("SET")).distinct()

    def grounding(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Label tables of genes and probes, and ontology terms that know the tumours of the part types only."""
        genes = self.table("supplier").select(
            F.concat(F.lit("GENE"), "s_suppkey").alias("label"), _id("GP", "s_suppkey").alias("label_id")
        )
        probes = self.table("part").select(F.col("p_name").alias("label"), _id("CD", "p_partkey").alias("label_id"))
        terms = self.table("part").select(
            F.concat(F.lower("p_type"), F.lit(" tumor")).alias("term"),
            F.concat(F.lit("DS:"), F.length("p_type")).alias("term_id"),
            F.lit(1).alias("rank"),
        ).distinct()
        return genes, probes, terms

    def release_dates(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(_id("CD", "l_partkey").alias("PROBE"))
            .agg(F.date_format(F.min("l_shipdate"), "MMM-yy").alias("DATE"))
        )

    def name_releases(self) -> DataFrame:
        """Release dates by compound name."""
        return (
            self.table("lineitem")
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("p_name").alias("PROBE"))
            .agg(F.date_format(F.min("l_shipdate"), "MMM-yy").alias("DATE"))
        )

    def free_terms(self) -> DataFrame:
        """Part names as people write them: capitals, a letter lost, words turned round, or something else altogether."""
        name, kind = F.col("p_name"), F.lower("p_type")
        way = F.pmod("p_partkey", F.lit(6))
        text = (
            F.when(way == 0, F.concat(F.lit(" "), F.upper(F.concat_ws(" ", name, kind))))
            .when(way == 1, F.concat_ws(" ", F.replace(name, F.lit("i"), F.lit("")), kind))
            .when(way == 2, F.concat_ws(" ", kind, name))
            .when(way == 3, F.concat(name, F.lit("s of the "), kind, F.lit(" family")))
            .when(way == 4, F.concat(F.lit("matter no. "), "p_partkey"))
        )
        return self.table("part").select("p_partkey", text.alias("TERM"))

    def family_terms(self) -> DataFrame:
        """Names of part families, and the shorter name of each part as a lesser synonym."""
        parts = self.table("part").select("p_name", "p_type").distinct()
        ident = F.concat(F.lit("FAM:"), F.replace("p_name", F.lit(" "), F.lit("-")))
        return parts.select(
            F.concat_ws(" ", "p_name", F.lower("p_type")).alias("term"), F.concat(ident, F.lit("-"), F.lower("p_type")).alias("term_id"), F.lit(1).alias("rank")
        ).unionByName(parts.select(F.col("p_name").alias("term"), ident.alias("term_id"), F.lit(2).alias("rank")).distinct())

    def terms(self) -> DataFrame:
        """Ontology synonyms with the rank of the hit; HOUSEHOLD is missing."""
        segment = F.col("c_mktsegment")
        rows = self.table("customer").where(segment != "HOUSEHOLD").select("c_mktsegment").distinct()
        return rows.select(
            F.lower("c_mktsegment").alias("term"),
            F.concat(F.lit("ONT:"), F.substring(segment, 1, 3)).alias("term_id"),
            F.lit(1).alias("rank"),
        ).unionByName(
            rows.select(
                F.lower("c_mktsegment").alias("term"),
                F.concat(F.lit("ALT:"), F.substring(segment, 1, 3)).alias("term_id"),
                F.lit(2).alias("rank"),
            )
        )


def _kind() -> F.Column:
    """Entity type of a mention; some are of a type that no triplet has."""
    return (
        F.when(F.col("l_tax") > 0.07, "OG")
        .when(F.col("l_returnflag") == "A", "CD")
        .when(F.col("l_returnflag") == "N", "GP")
        .otherwise("DS")
    )


def _id(prefix: str, key) -> F.Column:
    return F.concat(F.lit(f"{prefix}_"), F.col(key) if isinstance(key, str) else key)
