import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from litevidence.functions.text import quoted_items
from litevidence.operators import annotate, compare, curation, dictionary, evidence, metrics
from litevidence.operators.mentions import (
    complete_mentions, dictionary_labels, improve_ids, label_ids, name_columns, select_articles,
)
from litevidence.operators.targets import accepted_triplets, ground_genes, with_overrides, without_blacklisted

MENTION = "pmid string, label string, label_id string, entity_type string, date string, section string, sentence string"


def mention(pmid, label, ident, kind="CD"):
    return (pmid, label, ident, kind, "2020-01-01", "ABS", f"on {label}")


@pytest.fixture
def probes(spark):
    return spark.createDataFrame(
        [("C2", "A,  B"), ("C1", "A, D,E"), ("C3", None), (None, "F")], "COMPOUND_KEY string, SYNOMS string"
    )


def test_labels_and_their_lowest_id(spark, probes):
    assert rows(dictionary_labels(probes)) == [("A",), ("B",), ("D,E",), ("F",)]
    assert rows(label_ids(probes)) == [("A", "C1", 2), ("B", "C2", 1), ("D,E", "C1", 1), ("F", None, 0)]


def test_labels_may_include_names(spark):
    df = spark.createDataFrame([("C1", ["s"], "p", None)], "COMPOUND_KEY string, SYNOMS array<string>, PROBE string, PREF_NAME string")
    assert rows(dictionary_labels(df, with_names=True)) == [("p",), ("s",)]


def test_whole_articles_are_selected_once(spark, probes):
    data = [mention("1", "B", "x"), mention("1", "gene", "g", "GP"), mention("1", "gene", "g", "GP"),
            mention("2", "b", "y"), mention("3", "other", "z")]
    got = select_articles(spark.createDataFrame(data, MENTION), probes)
    assert rows(got) == sorted({data[0], data[1]}, key=repr)


def test_dictionary_id_overrides_annotated_id(spark, probes):
    data = [mention("1", "A", "old"), mention("1", "F", "kept"), mention("1", "zzz", "same")]
    got = improve_ids(spark.createDataFrame(data, MENTION), probes)
    assert [(r[1], r[2]) for r in rows(got)] == [("A", "C1"), ("F", "kept"), ("zzz", "same")]


def test_text_na_is_a_value(spark):
    df = spark.createDataFrame([mention("1", "NA", "x"), mention("1", "None", None)], MENTION)
    assert [r.label for r in complete_mentions(df).collect()] == ["NA"]


def test_service_columns_are_renamed(spark):
    raw = spark.createDataFrame([("1", "l", "i", "CD", "d", "s", "t", 0)],
                                "pmid string, label string, keywordId string, type string, pubDate string, section string, text string, extra int")
    assert name_columns(raw).columns == ["pmid", "label", "label_id", "entity_type", "date", "section", "sentence"]


@pytest.fixture
def gene_table(spark):
    return spark.createDataFrame([("X", "E1"), ("Y", "E2"), ("SLC2A1", "wrong")], "symbol string, ensembl_id string")


def test_each_gene_of_a_list_counts(spark, gene_table):
    d = spark.createDataFrame([("C1", "['X', 'Y']", 1), ("C1", "X", 2), ("C2", "Q", 1), ("C3", None, 1)],
                              "COMPOUND_KEY string, GENE string, SETID int")
    assert rows(ground_genes(d, gene_table).select("COMPOUND_KEY", "symbol", "ENS_ID")) == [
        ("C1", "X", "E1"), ("C1", "X", "E1"), ("C1", "Y", "E2"), ("C2", "Q", None)]
    t = spark.createDataFrame([("C1", "E1", "D"), ("C1", "E2", "D"), ("C2", None, "D"), ("C9", "E1", "D")],
                              "CD string, GP string, DS string")
    assert rows(accepted_triplets(t, d, gene_table).select("CD", "GP", "SETID")) == [
        ("C1", "E1", 1), ("C1", "E1", 2), ("C1", "E2", 1)]
    assert rows(accepted_triplets(t, d, gene_table, once=True)) == [("C1", "E1", "D"), ("C1", "E2", "D")]


def test_overrides_win(spark, gene_table):
    assert dict(rows(with_overrides(gene_table)))["SLC2A1"] == "ENSG00000117394"


def test_blacklist_ids_are_trimmed(spark):
    t = spark.createDataFrame([("D1",), ("D2",), (None,)], "DS string")
    black = spark.createDataFrame([("D1 ",), (None,)], "diseaseId string")
    assert rows(without_blacklisted(t, black)) == [("D2",), (None,)]


TRIPLETS = "pmid string, CD string, GP string, DS string"


def test_evidence_keeps_every_triplet(spark):
    t = spark.createDataFrame([("1", "c", "g", "d"), ("1", "c", "g", "d"), ("2", "c", "g", "e")], TRIPLETS)
    ev = spark.createDataFrame([("t", "s1", "d", "g", 0.5, 1), ("t", "s2", "d", "g", 0.1, 2), ("t", "s2", "d", "g", 0.1, 2),
                                ("t", "s1", "x", "g", 0.5, 1)],
                               "datatypeId string, datasourceId string, diseaseId string, targetId string, score double, evidenceCount long")
    got = evidence.attach_evidence(t, ev)
    assert rows(got.select("pmid", "diseaseId", "datasourceId", "score")) == [
        ("1", "d", "s1", 0.5), ("1", "d", "s2", 0.1), ("2", "e", None, None)]


DATED = "sourceId string, diseaseId string, targetId string, datasourceId string, curationYear int, publicationYear int, studyYear int"


def test_year_lists(spark):
    dated = spark.createDataFrame(
        [("a", "d", "g", "s", 2001, 2000, None), ("a", "d", "g", "s", 2001, 2000, None), ("b", "d", "g", "s", 2001, 1999, None)], DATED)
    assert rows(evidence.dated_lists(dated)) == [("d", "g", "s", [2001, 2001], [1999, 2000], [])]
    t = spark.createDataFrame([("d", "g", "s"), ("d", "g", None), ("q", "g", "s")], "diseaseId string, targetId string, datasourceId string")
    got = evidence.attach_dated(t, dated)
    assert rows(got) == sorted([("d", "g", "s", [2001, 2001], [1999, 2000], None), ("d", "g", None, None, None, None),
                                ("q", "g", "s", None, None, None)], key=repr)


def test_precedence_leaves_literature_out(spark):
    day = datetime.date
    t = spark.createDataFrame([("g", "d", day(2005, 1, 1)), ("g", "d", day(2003, 1, 1)), ("g", "e", day(2010, 1, 1)), ("g", "f", day(2010, 1, 1))],
                              "GP string, DS string, date date")
    dated = spark.createDataFrame([("a", "d", "g", "lit", 1990, None, None), ("a", "d", "g", "gwas", None, 2004, 2006),
                                   ("a", "e", "g", "gwas", 2010, None, None)], DATED)
    got = evidence.temporal_precedence(t, dated, ["lit"])
    assert rows(got) == [("d", "g", 2003, 2004, True), ("e", "g", 2010, 2010, False), ("f", "g", 2010, None, None)]


def test_highest_phase_with_ties(spark):
    drugs = spark.createDataFrame([("z", "g", "d", 4.0, "ok"), ("a", "g", "d", 4.0, "x"), ("a", "g", "d", 4.0, None), ("b", "g", "d", None, "s"),
                                   ("n", "g", "e", None, "s")],
                                  "drugId string, targetId string, diseaseId string, phase double, status string")
    want = [("d", "g", "a", 4.0, None), ("e", "g", "n", None, "s")]
    assert rows(annotate.max_phase(drugs)) == want
    assert rows(annotate.max_phase(drugs.repartition(7))) == want


def test_areas(spark):
    t = spark.createDataFrame([("d",), ("e",), ("x",)], "diseaseId string")
    dis = spark.createDataFrame([("d", "n", ["GO_1", "OTAR_2"]), ("e", "m", None)], "id string, name string, therapeuticAreas array<string>")
    assert rows(annotate.attach_areas(t, dis)) == [("d", "n", "GO_1|OTAR_2", "OTAR_2"), ("e", "m", "", None), ("x", None, "", None)]


def test_article_types(spark):
    types = spark.createDataFrame([("1", ["Review"], "T"), ("2", ["Systematic Review"], None), ("3", None, None), ("1", ["Other"], "T")],
                                  "pmid string, pubtypes array<string>, title string")
    ids = spark.createDataFrame([(" 1",), ("2 ",), ("3",), ("4",), ("4",)], "pmid string")
    got = annotate.attach_article_type(ids, types)
    assert rows(got) == [("1", "review"), ("2", "primary"), ("3", None), ("4", "primary"), ("4", "primary")]
    assert rows(annotate.tally_article_types(ids, types)) == [(4, 1, 1)]
    detail = annotate.classify_articles(ids, types.where("title is null"))
    assert rows(detail) == [("1", "ID Not Found", "N/A", "N/A"), ("2", "Review Article", "Systematic Review", "No Title Found"),
                            ("3", "Primary Research / Other", "", "No Title Found"), ("4", "ID Not Found", "N/A", "N/A")]


def test_merged_synonyms(spark):
    df = spark.createDataFrame([(["b", "a"], ["b"]), (["x"], None), (None, None)], "s array<string>, t array<string>")
    assert [r[0] for r in df.select(dictionary.merged("s", "t")).collect()] == [["a", "b"], ["x"], []]


def test_quality_gate_keeps_missing_structures_of_trusted_sets(spark):
    data = [("p1", "Chemical Probes.org", "K1"), ("p2", "Chemical Probes.org", "K2"), ("p3", "SGC", "K3"), ("p4", "SGC", None),
            ("p5", "Chemical Probes.org", None), ("p6", None, "K6"), ("p7", "Chemical Probes.org", "K3")]
    df = spark.createDataFrame(data, "PROBE string, SET string, INCHI string")
    good = spark.createDataFrame([("K1",)], "`InChI key` string")
    assert [r[0] for r in rows(dictionary.quality_gate(df, good))] == ["p1", "p3", "p4", "p5", "p6", "p7"]


CURATED = "PMID string, GENE string, PROBE string, DISEASES string, DISEASE_FOUND string"


def test_sentence_disease_comes_first(spark):
    df = spark.createDataFrame([("1", "g", "p", None, "aaa"), ("1", "g", "p", "zzz|defect", "q"), ("2", "g", "p", None, "defect|b"),
                                ("3", "g", "p", None, None), ("3", "g", "p", None, "c")], CURATED)
    assert rows(curation.unique_triples(df)) == [("1", "g", "p", "zzz", "sentence"), ("2", "g", "p", "b", "full_text"), ("3", "g", "p", "c", "full_text")]


def test_marks_become_null(spark):
    df = spark.createDataFrame([("None", "[]"), ("None", "[]"), ("a", "None")], "x string, y string")
    assert rows(curation.read_marks(df)) == sorted([(None, None), ("a", None)], key=repr)
    assert rows(curation.with_any(curation.read_marks(df), ["x", "y"])) == [("a", None)]


def test_rows_without_section_stay(spark):
    df = spark.createDataFrame([("p", "Other"), ("p", None), ("q", "ABS")], "PROBE string, SECTION string")
    probes = spark.createDataFrame([("p",)], "PROBE string")
    assert rows(curation.rows_of_probes(df, probes)) == [("p", None)]


def test_disease_names(spark):
    df = spark.createDataFrame([("NE,prostate cancer,CRPC",), ("melanoma tumors",), ("tumor,MB",), ("ovarian cancer,cancer",), ("other",), (None,)], "DISEASES string")
    assert [r[0] for r in curation.named_diseases(df).collect()] == [
        "prostate cancer", "melanoma", "medulloblastoma", "epithelial ovarian cancer", "other", None]


def test_term_grounding(spark):
    terms = spark.createDataFrame([("cancer", "EFO:2", 2), ("Cancer ", "EFO:1", 1), ("flu", "MONDO:3", 1)], "term string, term_id string, rank int")
    df = spark.createDataFrame([(" CANCER",), ("none",), ("Flu",), (None,)], "t string")
    assert [r[1] for r in curation.ground_terms(df, "t", terms, overrides={"none": "X_1"}).collect()] == ["EFO_1", "X_1", "MONDO_3", None]


def test_first_per_key(spark):
    df = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("m", "c", 3)], "k string, x string, n int")
    assert rows(curation.first_per(df, ["k"])) == [("k", "a", 2), ("m", "c", 3)]


def test_histogram_and_top(spark):
    df = spark.createDataFrame([("p", "x"), ("p", "x"), ("p", "a,x"), ("q", None)], "k string, d string")
    assert rows(metrics.histogram_text(df, ["k"], "d", "text", "n")) == [("p", "a,x[1], x[2]", 3)]
    assert [tuple(r) for r in metrics.top_terms(df.dropna(), "d", 1).collect()] == [("x", 3)]
    bars = spark.createDataFrame([("a|bc",), ("bc|d.e",)], "d string")
    assert rows(metrics.top_terms(bars, "d", 9, "|")) == [("a", 1), ("bc", 2), ("d.e", 1)]


def test_quoted_items(spark):
    df = spark.createDataFrame([("['prostate cancer', 'AML']",), ("[]",), ("['a, b', \"Alzheimer's disease\"]",), (None,)], "t string")
    got = [r[0] for r in df.select(quoted_items("t")).collect()]
    assert got == [["prostate cancer", "AML"], [], ["a, b", "Alzheimer's disease"], None]


def test_pivot_has_the_given_columns(spark):
    df = spark.createDataFrame([("g", "p", 2), ("h", "z", 1)], "g string, p string, n int")
    got = metrics.pivot_counts(df, "g", "p", "n", ["p", "q"])
    assert got.columns == ["g", "p", "q", "other"]
    assert rows(got) == [("g", 2, None, None), ("h", None, None, 1)]   # nothing is lost
    more = df.unionByName(df.withColumn("n", F.lit(5)))
    assert rows(metrics.pivot_counts(more, "g", "p", "n", ["p"], mean=True)) == [("g", 3.5, None), ("h", None, 3.0)]


def test_counts_skip_missing_values(spark):
    df = spark.createDataFrame([("1", "a", None), ("1", None, "x"), ("2", "a", "x")], "p string, a string, b string")
    assert rows(metrics.distinct_counts(df, {"np": ["p"], "nab": ["a", "b"]})) == [(3, 2, 1)]
    assert rows(metrics.count_per(df, ["a"], "b", "n")) == [("a", 1)]
    assert rows(metrics.coverage(df, {"with_a": F.col("a").isNotNull()}, ["p"])) == [(2,)]


def test_comparison(spark):
    x = spark.createDataFrame([("1", "c", "g", "d"), ("2", "c", "g", "e"), ("3", "c", "h", "d")], TRIPLETS)
    y = spark.createDataFrame([("8", "c", "g", "d"), ("9", "c", "g", "d"), ("7", "k", "g", "d")], TRIPLETS)
    for cell in (1, 1000):
        pairs = compare.compare_triplets(x, y, cell).select("CD", "GP", "pmid_x", "DS_x", "pmid_y", "DS_y")
        assert rows(pairs) == [("c", "g", p, d, q, "d") for p, d in (("1", "d"), ("2", "e")) for q in ("8", "9")]
    assert rows(compare.pair_agreement(x, y).select("n_extracted", "n_curated", "n_same_disease", "n_pairs")) == [(2, 2, 2, 4)]
    a, b = x.select("DS"), y.select("DS")
    assert rows(compare.overlap(a, b, "DS")) == [(1, 0, 1)]
    assert rows(compare.common(a, b)) == [("d",)] and rows(compare.only_in_first(a, b)) == [("e",)]


def test_release_and_profile(spark):
    releases = spark.createDataFrame([("p", "Mar-15"), ("p", "Feb-16"), ("q", "None")], "PROBE string, DATE string")
    pairs = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3)], "PROBE string, n int")
    got = [(r.PROBE, r.DATE_MONTH, r.DATE_YEAR, str(r.RELEASED)) for r in curation.with_release(pairs, releases).collect()]
    assert sorted(got, key=repr) == [("p", "Mar", "15", "2015-03-01"), ("q", "None", None, "None"), ("r", None, None, "None")]
    tables = {
        "molecule_dictionary": spark.createDataFrame([(1, "C1", 4), (2, "C2", None)], "molregno int, compound_key string, max_phase int"),
        "compound_structures": spark.createDataFrame([(1, "K1"), (2, "K2")], "molregno int, standard_inchi_key string"),
    }
    names = spark.createDataFrame([("p", "K1"), ("p", "K9"), ("q", "K2")], "PROBE string, INCHI string")
    out = dictionary.probe_profile(pairs, names, tables, releases).select("PROBE", "INCHI", "COMPOUND_KEY", "MAX_PHASE")
    assert rows(out) == [("p", "K1", "C1", 4), ("q", "K2", "C2", None), ("r", None, None, None)]
