"""The jobs from files to files, on a corpus of one article of interest."""

import datetime

import pytest

from litevidence import schemas
from litevidence.__main__ import PORTAL_TABLES, main

DAY = datetime.date(2015, 3, 1)


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")

    def parquet(name, schema, data, **kw):
        writer = spark.createDataFrame(data, schema).write
        (writer.partitionBy(*kw["by"]) if kw else writer).parquet(str(root / name))

    sentence = 'JQ1 hits "BRD4"\tin AML\nand more'
    parquet("matches", schemas.RAW_MATCHES, [
        ("1", "JQ1", "OLD", "CD", DAY, "ABS", sentence), ("1", "BRD4", "ENSG1", "GP", DAY, "ABS", sentence),
        ("1", "AML", "EFO_1", "DS", DAY, "ABS", sentence), ("1", "flu", "EFO_2", "DS", DAY, "ABS", sentence),
        ("2", "aspirin", "C9", "CD", DAY, "ABS", "aspirin"),
    ])
    (root / "probes.tsv").write_text(
        "SETID\tPROBE\tGENE\tCOMPOUND_KEY\tSYNOMS\tSYNOMS_TARGET\n28\t(+)-JQ1\tBRD4', 'BRDT\tC1\tJQ1, JQ 1\tHUNK1\n"
    )
    parquet("genes", schemas.GENE_SYMBOL, [("BRD4", "ENSG1"), ("BRDT", "ENSG2")])
    parquet("evidence", schemas.EVIDENCE, [("lit", "epmc", "EFO_1", "ENSG1", 0.5, 3)])
    parquet("dated", schemas.DATED_EVIDENCE, [("EFO_1", "ENSG1", "epmc", None, 2016, None, "epmc")], by=["sourceId"])
    parquet("disease", schemas.DISEASE, [("EFO_1", "AML", ["EFO_9", "OTAR_1"])])
    parquet("drugs", schemas.KNOWN_DRUG, [("D1", "ENSG1", "EFO_1", 2.0, None), ("D2", "ENSG1", "EFO_1", 4.0, "ok")])
    parquet("types", schemas.ARTICLE_TYPE, [("1", ["Review"], "T")])
    return root


def run(spark, inputs, step, out, *extra, **options):
    path = str(inputs / out)
    arguments = [step, *extra, "--out", path]
    for name, value in options.items():
        arguments += [f"--{name}", str(inputs / value)]
    main(arguments, spark)
    return path


EXPECTED = {
    ("1", "C1", "ENSG1", "EFO_1", "epmc", 2016, "OTAR_1", "D2", "review"),
    ("1", "C1", "ENSG1", "EFO_2", None, None, None, None, "review"),
}


def summary(df):
    return {
        (r.pmid, r.probeId, r.targetId, r.diseaseId, r.datasourceId,
         r.allpublicationYears[0] if r.allpublicationYears else None, r.preferredArea, r.drugId, r.articleType)
        for r in df.collect()
    }


def test_step_by_step(spark, inputs):
    run(spark, inputs, "articles", "o1", matches="matches", probes="probes.tsv")
    run(spark, inputs, "triplets", "o2", input="o1", probes="probes.tsv")
    run(spark, inputs, "accepted", "o3", input="o2", probes="probes.tsv", genes="genes")
    run(spark, inputs, "curated", "o4", input="o3", evidence="evidence")
    run(spark, inputs, "dated", "o5", input="o4", dated="dated")
    run(spark, inputs, "areas", "o6", input="o5", disease="disease")
    run(spark, inputs, "phases", "o7", input="o6", drugs="drugs")
    path = run(spark, inputs, "reviews", "o9", input="o7", types="types")
    assert summary(spark.read.parquet(path)) == EXPECTED
    assert spark.read.parquet(path).first().sentence.startswith('JQ1 hits "BRD4"\tin')


def test_everything_at_once(spark, inputs):
    names = ("matches", "genes", "evidence", "dated", "disease", "drugs", "types")
    options = {name: name for name in names}
    path = run(spark, inputs, "everything", "all", **options, probes="probes.tsv")
    assert summary(spark.read.parquet(path)) == EXPECTED
    text = run(spark, inputs, "everything", "text", "--text", **options, probes="probes.tsv")
    back = spark.read.option("sep", "\t").option("header", True).option("escape", '"').option("multiLine", True).csv(text)
    assert back.count() == 2 and back.where("probeSyn = 'JQ1, JQ 1'").count() == 2


def test_dictionary(spark, inputs):
    tables = {
        "probe": [dict(probeid=1, compound_id=1, compoundset_id=408, origin_id="x", control="['N1']"),
                  dict(probeid=2, compound_id=2, compoundset_id=28, origin_id="calculated", control="")],
        "compound": [dict(compoundid=1, name="JQ1", inchikey="K1")],
        "compoundset": [dict(compoundsetid=408, name="Chemical Probes.org")],
        "compoundtoexternaldb": [dict(compound_id=1, externaldb_id=2, ligand_id="C1")],
        "compoundattribute": [dict(compound_id=1, value_id=1)],
        "attributevalue": [dict(attributevalueid=1, value="J'Q 1", attribute_id=1)],
        "attribute": [dict(attributeid=1, type_id="3")],
        "attributetype": [dict(attributetypeid="3")],
        "probetobasetarget": [dict(probe_id=1, basetarget_id=1), dict(probe_id=2, basetarget_id=1)],
        "basetarget": [dict(basetargetid=1, gene_name="['BRD4', 'BRDT']")],
        "targettobasetarget": [dict(basetarget_id=1, target_id=1)],
        "target": [dict(targetid=1, uniprotid="O60885")],
        "targetsynonym": [dict(basetarget_id=1, synonym="HUNK1, CAP")],
        "molecule_dictionary": [dict(molregno=1, compound_key="C2", pref_name="JQ"), dict(molregno=2, compound_key="C1", pref_name="JQ")],
        "compound_structures": [dict(molregno=1, standard_inchi_key="K1"), dict(molregno=2, standard_inchi_key="K1")],
        "molecule_synonyms": [dict(molregno=1, synonyms="JQ 1"), dict(molregno=2, synonyms="(+)-JQ1")],
        "component_synonyms": [dict(component_id=1, component_synonym="HUNK1")],
        "component_sequences": [dict(component_id=1, accession="O60885")],
    }
    assert set(PORTAL_TABLES) <= set(tables)
    for name, data in tables.items():
        spark.createDataFrame(data).write.parquet(str(inputs / f"db/{name}.parquet"))
    (inputs / "good.csv").write_text("InChI key\nK1\n")
    path = run(spark, inputs, "dictionary", "dict", portal="db", compounds="db", good="good.csv")
    row, = spark.read.parquet(path).collect()
    assert row.asDict() == {
        "SETID": 408, "UNIPROT": "O60885", "PROBE": "JQ1", "SET": "Chemical Probes.org", "INCHI": "K1",
        "GENE": ["BRD4", "BRDT"], "CONTR": "N1", "COMPOUND_KEY": "C1", "PREF_NAME": "JQ",
        "SYNOMS": ["(+)-JQ1", "JQ 1"], "SYNOMS_TARGET": ["CAP", "HUNK1"],
    }
