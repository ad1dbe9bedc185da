"""Queries read the columns they need, and a batch reads its mentions once."""

from __future__ import annotations

import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from litevidence.operators import curation
from litevidence.operators.incremental import PrevalenceState
from litevidence.plans import catalog
from litevidence.plans.catalog import QUERIES, report
from litevidence.plans.views import Views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["grounded_histogram", "disease_histogram", "export_shape"])
def test_sentences_are_not_read_for_a_part_of_the_report(spark, capsys, name):
    QUERIES[name](spark, SF).explain()
    assert "o_orderpriority" not in capsys.readouterr().out


def test_part_of_the_report(spark):
    v = Views(spark, SF)
    assert rows(report(v, "PROBE", "DISEASES")) == rows(report(v).select("PROBE", "DISEASES").distinct())


def test_a_batch_reads_its_mentions_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(pmid):
        read.add(1)
        return pmid

    day = datetime.date(2020, 1, 1)
    found = spark.createDataFrame(
        [(f"a{i}", "s", day, "F", kind, f"{kind}{i % 3}") for i in range(10) for kind in ("CD", "GP", "DS")],
        "pmid string, sentence string, date date, section string, entity_type string, label_id string",
    )
    state = PrevalenceState(spark, str(tmp_path))
    state.add(found.withColumn("pmid", F.udf(seen, "string").asNondeterministic()("pmid")))
    assert read.value == 30
    assert sum(r["n_articles"] for r in state.counts().collect()) == 10


def test_improved_mentions_are_grouped_after_the_shuffle_only(spark, capsys):
    QUERIES["improve_ids"](spark, SF).explain()
    joins = capsys.readouterr().out.partition("Exchange hashpartitioning(")[2]
    assert joins and not [line for line in joins.splitlines() if "Aggregate(" in line and "sentence" in line]


def test_export_shuffles_only_rows_that_may_be_copies(spark, monkeypatch):
    given = []
    write = catalog.write_merged_text
    monkeypatch.setattr(catalog, "write_merged_text", lambda table, path: (given.append(table), write(table, path)))
    whole = spark.createDataFrame(QUERIES["merged_export"](spark, SF).collect(), Views(spark, SF).curated().schema)
    assert rows(whole) == rows(report(Views(spark, SF)))
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    groups = [line.index("Aggregate [") for line in plan if "Aggregate [" in line and "TEXT" in line]
    assert not groups or any("Join LeftAnti" in line for line in plan) and any("Join LeftSemi" in line for line in plan)


def test_copies_go_where_the_counted_columns_are_shared(spark):
    table = spark.createDataFrame(
        [("1", "a", "x"), ("1", "a", "x"), ("1", "a", "y"), ("2", None, "x"), ("2", None, "x"), (None, "2", "x"), (None, None, "[]"),
         (None, "None", None), ("3", "a", "x"), ("3", "b", "x")],
        "one string, two string, three string",
    )
    for keys in (["one"], ["one", "two"], ["three"], table.columns):
        assert rows(curation.read_marks(table, counted=table.select(*keys))) == rows(curation.read_marks(table))
    alone = table.where("one = '3'")
    assert "Aggregate" not in curation.read_marks(alone, counted=alone)._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_is_counted_after_the_shuffle_only(spark):
    plan = Views(spark, SF).evidence()._jdf.queryExecution().executedPlan().toString().partition("Exchange hashpartitioning(")
    assert "HashAggregate(" in plan[0] and plan[2] and "Aggregate(" not in plan[2]
