from pyspark.sql import functions as F

from conftest import rows
from litevidence.operators import targets
from litevidence.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def _dictionary(spark):
    listed = [
        ("C1", "S1", "['A', 'B']"), ("C1", "S1", "['A', 'B']"), ("C1", "S2", "['A', 'a']"), ("C1", "S2", "['X']"),
        (None, "S1", "['A']"), ("C2", "S1", None), ("C2", "S1", "['B']"),
    ]
    return spark.createDataFrame(listed, "COMPOUND_KEY string, SETID string, GENE string")


def _genes(spark):
    return spark.createDataFrame([("A", "E1"), ("a", "E1"), ("B", "E2"), ("B", "E3")], "symbol string, ensembl_id string")


def test_accepted_targets_are_distinct(spark):
    assert rows(targets.accepted_targets(_dictionary(spark), _genes(spark))) == [
        ("C1", "S1", "['A', 'B']", "E1"), ("C1", "S1", "['A', 'B']", "E2"), ("C1", "S2", "['A', 'a']", "E1"),
        ("C2", "S1", "['B']", "E2"),
    ]


def test_lists_may_be_arrays(spark):
    listed = _dictionary(spark).withColumn("GENE", F.expr("regexp_extract_all(GENE, '[A-Za-z]', 0)"))
    found = targets.accepted_targets(listed, _genes(spark)).select("COMPOUND_KEY", "SETID", "GP")
    assert rows(found) == [("C1", "S1", "E1"), ("C1", "S1", "E2"), ("C1", "S2", "E1"), ("C2", "S1", "E2")]


def test_dictionary_rows_are_made_distinct_once(spark):
    triplets = spark.createDataFrame([("1", "C1", "E1", "D")], "pmid string, CD string, GP string, DS string")
    known = _dictionary(spark).distinct()
    for once, column in ((False, "SETID"), (True, "COMPOUND_KEY")):
        plan = targets.accepted_triplets(triplets, known, _genes(spark), once)._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Aggregate [" in line and column in line for line in plan.splitlines()) == 1


def test_few_copies_go_after_the_shuffle_only(spark):
    args = _dictionary(spark), _genes(spark)
    found = targets.accepted_targets(*args, few_copies=True)
    _assert_no_rows_are_held_ahead_of_their_shuffle(found)
    assert rows(found) == rows(targets.accepted_targets(*args))


def test_queries_hold_no_dictionary_rows_ahead_of_their_shuffle(spark):
    for name in ("accepted_pairs", "accepted_pairs_once"):
        _assert_no_rows_are_held_ahead_of_their_shuffle(QUERIES[name](spark, SF))


def _assert_no_rows_are_held_ahead_of_their_shuffle(found):
    """An aggregate by compound and list has the shuffle of its rows below it, and no such aggregate is below that shuffle."""
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    held = [i for i, line in enumerate(plan) if "HashAggregate(keys=[COMPOUND_KEY" in line and "GENE" in line]
    shuffles = [i for i, line in enumerate(plan) if "REPARTITION_BY_NUM" in line]
    assert held and len(shuffles) == 1 and max(held) < shuffles[0]
