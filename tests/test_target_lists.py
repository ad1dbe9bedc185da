"""Long synonym lists are made once, not once per target."""

from __future__ import annotations

import re

import pytest

from conftest import rows
from litevidence.operators import dictionary
from litevidence.operators.dictionary import target_lists, target_terms, with_lists
from litevidence.plans.catalog import SETS, compounds as compound_tables, portal as portal_tables
from litevidence.plans.views import Views

SF = "/root/testdata/sf0.001"


@pytest.fixture
def settings(spark):
    before = {}

    def change(name, value):
        before.setdefault(name, spark.conf.get(name))
        spark.conf.set(name, value)

    yield change
    for name, value in before.items():
        spark.conf.set(name, value)


def tables(spark, targets=60, names=400):
    portal = {
        "targettobasetarget": spark.createDataFrame([(i, i % 3) for i in range(targets)], "basetarget_id int, target_id int"),
        "target": spark.createDataFrame([(0, "P0"), (1, "P1"), (2, None)], "targetid int, uniprotid string"),
        "targetsynonym": spark.createDataFrame([(0, "own, kinase"), (3, "kinase")], "basetarget_id int, synonym string"),
    }
    compounds = {
        "component_synonyms": spark.createDataFrame([(i % 2, f"name {i}") for i in range(names)], "component_id int, component_synonym string"),
        "component_sequences": spark.createDataFrame([(0, "P0"), (1, "P1")], "component_id int, accession string"),
    }
    return portal, compounds


def test_a_list_is_made_once_for_all_targets_that_have_it(spark):
    portal, compounds = tables(spark)
    pairs, lists = target_lists(portal, compounds)
    assert pairs.count() == 60
    # P0 alone, P0 with each of two lists of the portal, P1, and no protein.
    assert lists.count() == 5

    of = {p: [f"name {i}" for i in range(400) if i % 2 == p] for p in (0, 1)}
    own = {0: ["own", "kinase"], 3: ["kinase"]}
    want = {(i, ["P0", "P1", None][i % 3]): sorted(of.get(i % 3, []) + own.get(i, [])) for i in range(60)}
    assert {(r[0], r[1]): r[2] for r in target_terms(portal, compounds).select("TARGETID", "UNIPROT", "SYNOMS_TARGET").collect()} == want


def test_rows_without_a_list_stay(spark):
    found = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id int, TERMS string")
    lists = spark.createDataFrame([("a", ["x", "y"])], "TERMS string, SYNOMS_TARGET array<string>")
    assert rows(with_lists(found, lists, "TERMS")) == [(1, ["x", "y"]), (2, None), (3, None), (4, ["x", "y"])]


def test_rows_of_a_long_list_are_written_by_several_tasks(spark, settings, tmp_path):
    settings("spark.sql.shuffle.partitions", "16")
    long, short = [f"name {i}" for i in range(2000)], ["x", "y"]
    keys = {i: [None, "a", "a", "b", "no list"][i % 5] for i in range(1000)}
    # Every row twice.
    found = spark.createDataFrame([(i, k) for i, k in keys.items()] * 2, "id int, TERMS string")
    lists = spark.createDataFrame([("a", long), ("b", short)], "TERMS string, SYNOMS_TARGET array<string>")
    with_lists(found, lists, "TERMS").write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    of = {"a": long, "b": short}
    assert rows(got) == sorted([(i, of.get(k)) for i, k in keys.items()] * 2, key=repr)
    files = got.where("size(SYNOMS_TARGET) > 2").select("_metadata.file_path").distinct().count()
    assert files > 2


def test_the_main_set_is_not_shuffled_for_names_of_sets_and_proteins(spark, settings, capsys):
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    views = Views(spark, SF)
    portal, compounds = portal_tables(views), compound_tables(views)
    dictionary.with_synonyms(dictionary.main_set(portal, SETS), portal, compounds).explain()
    keys = re.findall(r"Exchange hashpartitioning\((.*), \d+\)", re.sub(r"#\d+L?", "", capsys.readouterr().out))
    # The one by both is the distinct of targets and proteins; those by set are of the probes and of the sets.
    assert keys.count("TARGETID, UNIPROT") <= 1
    dictionary.main_set(portal, SETS).explain()
    plan = capsys.readouterr().out
    by_set = [m.start() for m in re.finditer(r"Exchange hashpartitioning\(SETID", plan)]
    combined = plan.index("_target#")
    assert by_set and min(by_set) > combined


def test_compound_ids_are_looked_up_once_per_compound(spark, settings, capsys):
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    views = Views(spark, SF)
    dictionary.build_dictionary(portal_tables(views), compound_tables(views), None, SETS).explain()
    keys = re.findall(r"HashAggregate\(keys=\[(ID#[^\]]*)\]", capsys.readouterr().out)
    assert any("_terms" in k for k in keys) and not any("COMPOUND_KEY" in k for k in keys)
