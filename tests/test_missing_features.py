"""Fuzzy grounding, incremental prevalence, merged files, bitmaps of classes."""

from itertools import product

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litevidence.functions.text import term_key
from litevidence.operators import fuzzy, metrics
from litevidence.operators.incremental import PrevalenceState
from litevidence.operators.triplets import extract_triplets, triplet_counts
from litevidence.sources import readers
from litevidence.sources.writers import staged_path, write_merged_text

MENTION = "pmid string, sentence string, date date, section string, entity_type string, label_id string"


# --- fuzzy grounding --------------------------------------------------------------------------------


def brute(asked, known, cutoff):
    import math

    def grams(t):
        p = f"  {t} "
        return {p[i : i + 3] for i in range(len(p) - 2)} if t else set()

    names = {}
    for term, term_id, rank in known:
        key = (term or "").strip(" ").lower()
        if key:
            names[key] = min(names.get(key, (rank, term_id)), (rank, term_id))
    df = {}
    for n in names:
        for g in grams(n):
            df[g] = df.get(g, 0) + 1

    def square(g):
        return math.floor(100 * math.log(1 + len(names) / df.get(g, 1))) ** 2

    out = {}
    for t in {(a or "").strip(" ").lower() for a in asked} - {""}:
        best = []
        for n, (rank, term_id) in names.items():
            dot = sum(square(g) for g in grams(t) & grams(n))
            s2 = float(dot) * dot / (float(sum(map(square, grams(t)))) * sum(map(square, grams(n))))
            if s2 >= cutoff * cutoff:
                best.append((-s2, rank, n, term_id))
        if best:
            out[t] = (min(best)[2], min(best)[3])
    return out


TEXT = st.text(st.sampled_from("abc é"), max_size=9)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), TEXT), max_size=25), st.lists(st.tuples(TEXT, st.sampled_from("xyz"), st.integers(1, 2)), max_size=25))
def test_fuzzy_hits_like_all_pairs(spark, asked, known):
    terms = spark.createDataFrame(known, "term string, term_id string, rank int")
    wanted = spark.createDataFrame([(a,) for a in asked], "term string")
    keyed = {r[0]: r[1] for r in wanted.select("term", term_key("term")).collect()}
    assert all((k or "").strip(" ").lower() == (v or "") for k, v in keyed.items())
    for cutoff, cell in ((0.6, 10_000_000), (0.85, 3)):
        got = {r["term"]: (r["hit"], r["term_id"]) for r in fuzzy.fuzzy_hits(wanted, terms, cutoff, cell).collect()}
        assert got == brute(asked, known, cutoff)


def test_fuzzy_grounding_keeps_rows(spark):
    terms = spark.createDataFrame([("breast carcinoma", "EFO:1", 1), ("lung carcinoma", "EFO:2", 1)], "term string, term_id string, rank int")
    table = spark.createDataFrame([(1, "Breast carcinomas"), (2, None), (3, ""), (4, "measles"), (5, "LUNG CARCINOMA ")], "k int, t string")
    got = {r["k"]: (r["DISEASE_ID"], r["cosine"]) for r in fuzzy.fuzzy_ground_terms(table, "t", terms).collect()}
    assert got[1][0] == "EFO_1" and 0.8 <= got[1][1] < 1 and got[5] == ("EFO_2", 1.0)
    assert got[2] == got[3] == got[4] == (None, None)


def test_prefix_pairs_are_few(spark):
    """A trigram of nearly all synonyms is in almost no prefix."""
    terms = spark.createDataFrame([(f"disease of type q{i}z{i * 7}", f"T:{i}", 1) for i in range(300)], "term string, term_id string, rank int")
    known = terms.select(term_key("term").alias("known")).distinct()
    frequency = known.select(F.explode(fuzzy.trigrams(F.col("known"))).alias("gram")).groupBy("gram").count()
    weights = frequency.select("gram", F.pow(F.floor(100 * F.log(1 + F.lit(300.0) / F.col("count"))), 2).cast("long").alias("square"))
    index = fuzzy._vectors(known, "known", weights, 326041, 0.8).select(F.explode("prefix").alias("gram")).groupBy("gram").count()
    assert index.agg(F.max("count")).first()[0] < 60


# --- prevalence in batches --------------------------------------------------------------------------


def literature(spark, articles):
    out = []
    for pmid in articles:
        for kind, n in (("CD", 2), ("GP", 2), ("DS", 1 + (pmid or 0) % 3)):
            out += [(None if pmid is None else str(pmid), f"s{j % 2}", None, "A", kind, f"{kind}{j}") for j in range(n)]
    return spark.createDataFrame(out, MENTION).withColumn("date", F.lit("2020-01-01").cast("date"))


def test_batches_add_up(spark):
    whole = rows(triplet_counts(extract_triplets(literature(spark, range(12)))))
    state = PrevalenceState(spark, staged_path(spark, "state"), fan_in=3)
    assert state.counts().collect() == state.articles().collect() == []
    for batch in ([0, 1, 2], [2, 3], [], [4, 5, 6, 7], [0, 8], [9, 10, 11], [3]):
        state.add(literature(spark, batch))
    assert rows(state.counts()) == whole
    assert sorted(int(r[0]) for r in state.articles().collect()) == list(range(12))
    assert any(name[0] == "c" for name in state._versions("counts")) and len(state._live()) < 3
    again = PrevalenceState(spark, state.folder)
    assert rows(again.counts()) == whole


def test_broken_batch_is_given_again(spark):
    state = PrevalenceState(spark, staged_path(spark, "state"))
    state.add(literature(spark, [1]))
    # The articles of the next batch are written, its counts are not.
    literature(spark, [2]).select("pmid").distinct().write.parquet(f"{state.folder}/articles/v2")
    assert state.articles().count() == 1
    state.add(literature(spark, [2, 3]))
    assert rows(state.counts()) == rows(triplet_counts(extract_triplets(literature(spark, [1, 2, 3]))))


# --- merged file ------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 500])
def test_merged_file(spark, tmp_path, n):
    table = spark.range(0, n, 1, 7).select(
        F.col("id"), F.format_string('te"xt\tof %d', "id").alias("a b"), F.when(F.col("id") % 3 == 0, F.lit("é")).alias('q"c')
    )
    path = str(tmp_path / "out.tsv")
    for _ in range(2):  # the second replaces the first
        write_merged_text(table, path)
    names = [p.name for p in tmp_path.iterdir()]
    assert "out.tsv" in names and not any(".parts-" in x for x in names)
    lines = (tmp_path / "out.tsv").read_text().splitlines()
    assert len(lines) == n + 1 and lines[0] == 'id\ta b\t"q""c"'
    assert [int(x.split("\t")[0]) for x in lines[1:]] == list(range(n))
    back = readers.read_text(spark, path)
    assert back.columns == table.columns
    assert rows(back) == rows(table.withColumn("id", F.col("id").cast("string")))


# --- bitmaps ----------------------------------------------------------------------------------------


def test_unions_by_bitmap(spark):
    table = spark.range(0, 100_000, 1, 3).select((F.col("id") % 70_000).alias("k"), (F.col("id") % 7).alias("m"))
    classes = {"two": F.col("k") % 2 == 0, "three": F.col("k") % 3 == 0, "none": F.lit(False), "null": F.when(F.col("k") < 5, F.lit(True))}
    unions = {f"{a}|{b}": [a, b] for a, b in product(classes, repeat=2)} | {"all": list(classes)}
    got = {r["union"]: r["n"] for r in metrics.union_counts(metrics.class_bitmaps(table, ["k"], classes), unions).collect()}
    held = {"two": set(range(0, 70_000, 2)), "three": set(range(0, 70_000, 3)), "none": set(), "null": set(range(5))}
    assert got == {u: len(set().union(*(held[c] for c in own))) for u, own in unions.items()}


def test_evidence_without_a_shuffle_of_whole_rows(spark):
    from litevidence.operators.evidence import attach_evidence

    triplets = spark.createDataFrame([("1", "s", "D", "G", "C")], "pmid string, sentence string, DS string, GP string, CD string")
    evidence = spark.createDataFrame([("t", "s", "D", "G", 1.0, 1)], "datatypeId string, datasourceId string, diseaseId string, targetId string, score double, evidenceCount long")
    plain = attach_evidence(triplets, evidence, copies=False)
    assert rows(plain) == rows(attach_evidence(triplets, evidence))
    assert plain._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1  # that of the evidence


# --- sketches ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 3, 64, 1 << 16])
def test_frequent_terms_miss_none(spark, width):
    from collections import Counter

    from litevidence.operators.sketches import frequent_terms, term_sketch

    texts = [",".join(f"t{(i * j) % (3 + i % 50)}" for j in range(i % 7)) if i % 9 else None for i in range(400)]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    tally = Counter(x for t in texts if t is not None for x in t.split(","))
    want = sorted(((n, t) for t, n in tally.items()), key=lambda p: (-p[0], p[1]))
    for k in (1, 5, 1000):
        got = [(r["n"], r["term"]) for r in frequent_terms(table, "t", k, width=width).collect()]
        assert got == want[:k]
    # The sketches of two halves add up to that of the whole.
    terms = table.select(F.explode(F.split("t", ",")).alias("term"))
    halves = [term_sketch(terms.where(F.pmod(F.xxhash64("term"), F.lit(2)) == i), width=width) for i in (0, 1)]
    merged = halves[0].unionByName(halves[1]).groupBy("counter").agg(F.sum("n").alias("n"))
    assert rows(merged) == rows(term_sketch(terms, width=width))


def test_distinct_sketches_merge(spark):
    from litevidence.operators.sketches import distinct_sketches, merged_sketches

    table = spark.range(0, 60_000, 1, 5).select((F.col("id") % 3).alias("source"), (F.col("id") % 40_000).cast("string").alias("pmid"))
    kept = distinct_sketches(table, ["source"], "pmid")
    for r in merged_sketches(kept, ["source"], "n").collect():
        exact = table.where(F.col("source") == r["source"]).select("pmid").distinct().count()
        assert abs(r["n"] - exact) <= 0.02 * exact
    assert abs(merged_sketches(kept, [], "n").first()["n"] - 40_000) <= 800


# --- pivots in blocks, drifted folders, broken records ----------------------------------------------


def test_pivot_in_blocks(spark):
    table = spark.range(0, 3000, 1, 6).select((F.col("id") % 7).alias("r"), F.format_string("c%03d", F.col("id") % 211).alias("c"), F.lit(1).alias("n"))
    counts = table.groupBy("r", "c").count()
    blocks, names = metrics.pivot_blocks(counts, "r", "c", "count", width=50)
    ids = {r["c"]: r["id"] for r in names.collect()}
    assert ids == {f"c{i:03d}": i for i in range(211)}
    cells = {(r["r"], r["block"] * 50 + i): v for r in blocks.collect() for i, v in enumerate(r["cells"]) if v is not None}
    assert cells == {(r["r"], ids[r["c"]]): r["count"] for r in counts.collect()}
    some = metrics.pivot_columns(blocks, names, "r", "c", ["c003", "c160"])
    assert some.columns == ["r", "c003", "c160"]
    assert rows(some) == rows(counts.where(F.col("c").isin("c003", "c160")).groupBy("r").pivot("c", ["c003", "c160"]).agg(F.first("count")))


def test_drifted_folders(spark, tmp_path):
    parts = {
        "a": spark.createDataFrame([(1, "x")], "k int, t string"),
        "b": spark.createDataFrame([("y", 5_000_000_000)], "T string, K long"),
        "c": spark.createDataFrame([(2.5, True)], "k double, flag boolean"),
        "d": spark.createDataFrame([], "t int"),
    }
    for name, part in parts.items():
        part.write.parquet(str(tmp_path / name))
    whole, report = readers.read_drifted(spark, {name: str(tmp_path / name) for name in parts}, "folder")
    assert dict(whole.dtypes) == {"k": "double", "t": "string", "flag": "boolean", "folder": "string"}
    assert rows(whole) == sorted([(1.0, "x", None, "a"), (5e9, "y", None, "b"), (2.5, None, True, "c")], key=repr)
    done = {(r["folder"], r["column"]): r["done"] for r in report.collect()}
    assert done["a", "k"] == done["b", "k"] == done["d", "t"] == "widened" and done["c", "t"] == done["d", "k"] == "missing"
    assert done["a", "t"] == "as it is" and len(done) == 12


def test_broken_records(spark, tmp_path):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    schema = StructType([StructField("k", IntegerType()), StructField("t", StringType()), StructField("u", StringType())])
    lines = ["k\tt\tu", '1\t"a\tb ""c""\nd"\te', "2\tonly", "three\tx\ty", "4\tx\ty\tz", "5\t\t", '6\t"p\tq"']
    (tmp_path / "x.tsv").write_text("\n".join(lines) + "\n")
    good, bad = readers.read_checked(spark, str(tmp_path), schema)
    assert rows(good) == sorted([(1, 'a\tb "c"\nd', "e"), (5, None, None)], key=repr)
    assert sorted((r["n_fields"], r["reason"], r["file"]) for r in bad.collect()) == [
        (2, "too few fields", "x.tsv"), (2, "too few fields", "x.tsv"), (3, "a value of another type", "x.tsv"), (4, "too many fields", "x.tsv"),
    ]
