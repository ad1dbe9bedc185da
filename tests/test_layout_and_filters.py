"""Bloom filters ahead of joins, tables in buckets, synonyms in long form."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from litevidence.operators import dictionary, evidence, metrics
from litevidence.operators.bloom import bloom_filter
from litevidence.operators.mentions import select_articles, select_articles_pruned
from litevidence.operators.triplets import extract_triplets
from litevidence.plans.catalog import accepted, compounds, mentions, portal
from litevidence.plans.views import Views
from litevidence.sources.layout import largest_bucket, read_bucketed, write_bucketed
from litevidence.sources.writers import staged, staged_path

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


def test_filter_keeps_members_and_few_others(spark):
    members = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(20_000).select(F.concat(F.lit("x"), "id").alias("key"), F.lit(1).alias("_bits_of"))
    bloom = bloom_filter(members, "key")
    assert bloom.possible(members, "key").count() == 20_000
    assert bloom.possible(others, "key").count() < 600
    assert bloom.possible(others, "key").columns == others.columns
    # A filter with too few words lets more pass, and every member.
    full = bloom_filter(members, "key", max_words=64)
    assert full.words == 64 and full.table.count() <= 64 and full.possible(members, "key").count() == 20_000


def test_filter_edges(spark):
    some = spark.createDataFrame([("a",), (None,), ("a",), ("",)], "key string")
    assert rows(bloom_filter(some, "key").possible(some, "key")) == [("",), ("a",), ("a",)]
    assert bloom_filter(some.limit(0), "key").possible(some, "key").collect() == []
    numbers = spark.range(50)
    assert bloom_filter(numbers, "id").possible(numbers, "id").count() == 50


def test_filter_stands_below_the_exchange(views, capsys):
    corpus = staged(mentions(views), "mentions")
    pruned = select_articles_pruned(corpus, views.dictionary_text())
    plan = plan_of(pruned, capsys)
    semi = plan[plan.index("LeftSemi"):]
    exchange, test = semi.index("Exchange hashpartitioning(pmid"), semi.index("BroadcastHashJoin")
    scan = semi.index("FileScan parquet [pmid")
    assert exchange < test < scan and "Exchange hash" not in semi[test:scan].replace("BroadcastExchange", "")
    assert rows(pruned) == rows(select_articles(corpus, views.dictionary_text()))
    few = select_articles_pruned(corpus, views.dictionary_text(), max_words=1)
    assert rows(few) == rows(pruned)


def test_triplets_of_bucketed_mentions_need_no_exchange(spark, views, capsys):
    path = staged_path(spark, "by-article")
    corpus = staged(mentions(views), "mentions")
    assert write_bucketed(corpus, path, ["pmid"], 4)
    opened = read_bucketed(spark, path)
    found = extract_triplets(opened)
    assert "Exchange" not in plan_of(found, capsys)
    assert rows(found) == rows(extract_triplets(corpus))
    # Another session knows only the folder.
    spark.sql(f"DROP TABLE {opened._jdf.queryExecution().analyzed().collectLeaves().head().catalogTable().get().identifier().unquotedString()}")
    assert rows(read_bucketed(spark, path)) == rows(corpus)
    assert "Exchange" not in plan_of(extract_triplets(read_bucketed(spark, path)), capsys)


def test_evidence_in_buckets_of_pairs_needs_no_exchange(spark, views, capsys):
    found, known = staged_path(spark, "by-pair"), staged_path(spark, "evidence")
    triplets = staged(evidence.evidence_names(accepted(views)), "accepted")
    assert write_bucketed(triplets, found, evidence.PAIR, 4) and write_bucketed(views.evidence(), known, evidence.PAIR, 4)
    joined = evidence.attach_evidence(read_bucketed(spark, found), read_bucketed(spark, known), copies=False)
    assert "Exchange" not in plan_of(joined, capsys)
    assert rows(joined) == rows(evidence.attach_evidence(triplets, views.evidence(), copies=False))


def test_a_hot_key_is_not_put_in_a_bucket(spark):
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    assert largest_bucket(hot, ["k"], 32) > 10
    path = staged_path(spark, "hot")
    assert not write_bucketed(hot, path, ["k"], 32)
    assert rows(read_bucketed(spark, path)) == rows(hot)
    # The same folder again, in buckets this time, with nulls and an odd name.
    plain = spark.range(300).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("a key"), "id")
    assert write_bucketed(plain, path, ["a key"], 4)
    assert rows(read_bucketed(spark, path)) == rows(plain)
    assert write_bucketed(plain.limit(0), path, ["a key"], 4) and read_bucketed(spark, path).collect() == []


def test_members_are_those_of_the_lists(spark, views):
    long = dictionary.synonym_members(portal(views), compounds(views))
    for source, lists in (("probe", dictionary.probe_synonyms(portal(views))), ("protein", dictionary.component_synonyms(compounds(views)))):
        key, listed = lists.columns
        want = lists.dropna().select(F.col(key).cast("string"), F.explode(listed))
        assert rows(long.where(F.col("source") == source).drop("source")) == rows(want)


def test_other_is_no_listed_value(spark):
    counts = spark.createDataFrame([("a", "x", 1)], "r string, c string, n int")
    with pytest.raises(ValueError):
        metrics.pivot_counts(counts, "r", "c", "n", ["x", "other"])
