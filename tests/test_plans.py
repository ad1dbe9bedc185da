"""What the plans of the costly operators look like when nothing is small enough to broadcast."""

import re

import pytest

from pyspark.sql import functions as F

from litevidence.operators import annotate, dictionary, evidence
from litevidence.operators.mentions import select_articles
from litevidence.plans.catalog import SETS, compounds, mentions, portal
from litevidence.plans.views import Views

SF = "/root/testdata/sf0.001"


@pytest.fixture
def views(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield Views(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_articles_are_chosen_before_copies_are_removed(views, capsys):
    plan = plan_of(select_articles(mentions(views), views.dictionary_text()), capsys)
    assert plan.index("HashAggregate(keys=[label") < plan.index("LeftSemi")


def test_scans_read_only_what_is_used(views, capsys):
    plan = plan_of(evidence.dated_lists(views.dated_evidence()), capsys)
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert len(scans) == 2
    assert not any(c in s for s in scans for c in ("l_extendedprice", "o_totalprice", "l_partkey"))


def test_the_furthest_drug_is_reduced_before_its_one_shuffle(views, capsys):
    plan = plan_of(annotate.max_phase(views.known_drug()), capsys)
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_min" in plan and "Window" not in plan


def test_joins_start_no_job(spark, views):
    """Operators that join to a table with a row per key are lazy; adaptive execution measures the sides."""
    tracker = spark.sparkContext.statusTracker()
    found = [
        select_articles(mentions(views), views.dictionary_text()),
        annotate.attach_max_phase(views.evidence(), views.known_drug()),
        evidence.attach_dated(views.evidence(), views.dated_evidence()),
    ]
    started = set(tracker.getJobIdsForGroup(None))
    for df in found:
        df._jdf.queryExecution().executedPlan()
    assert set(tracker.getJobIdsForGroup(None)) == started


def test_no_probe_runs_in_one_task(views, capsys):
    found = annotate.attach_article_type(annotate.attach_max_phase(views.evidence(), views.known_drug()).withColumn("pmid", F.lit("1")), views.article_type())
    assert "SinglePartition" not in plan_of(found, capsys)


def test_lists_come_after_the_distinct(views, capsys):
    plan = plan_of(dictionary.build_dictionary(portal(views), compounds(views), None, SETS), capsys)
    keys = re.findall(r"HashAggregate\(keys=\[ID#[^\]]*\]", plan)
    assert keys and not any("SYNOMS" in k for k in keys)


def test_evidence_of_a_third_on_one_pair(spark):
    pairs = spark.range(3000).selectExpr(
        "cast(id as string) as pmid", "'c' as CD",
        "if(id % 3 = 0, 'g', concat('g', id % 50)) as GP", "if(id % 3 = 0, 'd', concat('d', id % 7)) as DS",
    )
    ev = pairs.selectExpr("DS as diseaseId", "GP as targetId").distinct().selectExpr(
        "'t' as datatypeId", "explode(array('x', 'y')) as datasourceId", "diseaseId", "targetId",
        "0.5D as score", "1L as evidenceCount",
    )
    from litevidence.operators import skew

    left = evidence.evidence_names(pairs)
    plain = skew.grid_join([left, ev], evidence.PAIR, "left")
    dealt = skew.grid_join([left, ev], evidence.PAIR, "left", max_product=50)
    columns = sorted(plain.columns)
    assert plain.count() == 6000
    assert plain.select(columns).exceptAll(dealt.select(columns)).isEmpty()
    assert dealt.select(columns).exceptAll(plain.select(columns)).isEmpty()
