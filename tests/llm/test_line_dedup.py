from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from llm_fixtures import docs  # noqa: F401

from litevidence.llm import line_dedup

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = (1 << 63) - 1


def key(line):
    return line.strip("\x20\t\n\x0b\x0c\r").translate(UPPER)


def expected(rows, least=10):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(LAST if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        own = LAST if doc_id is None else doc_id
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == own]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()), key=repr)


SHARED = "  A line that MANY hold, ÀÉ \t"
ROWS = [
    (9, f"own line of nine\n{SHARED}\nshort\nshort"),
    (3, f"{SHARED}\n{SHARED.strip()}\n\nown line of three\r\nown line of three"),
    (1, "a line that many hold, àé\nother case of letters beyond ASCII"),
    (4, SHARED), (5, f"{SHARED}\n{SHARED}\n{SHARED}"), (6, f"\n{SHARED}\n"), (7, f"first\n{SHARED}\nlast"),
    (5, "second row of document five\n" + SHARED), (5, "second row of document five\n" + SHARED),
    (None, f"no id at all\n{SHARED}"), (None, "no id at all\nno id at all either"), (LAST - 1, "no id at all either"),
    (2, None), (8, ""), (-7, "own line of nine\r"), (10, "\n\n\n"), (11, "own line of nine " * 3000 + "\n" + SHARED),
    (12, "\n".join(f"line number {i % 400}" for i in range(3000))), (13, "\n".join(f"line number {i}" for i in range(300, 500))),
]


@pytest.mark.parametrize("batches,fan_in", [(1, 2), (4, 2), (9, 3)])
def test_like_brute_force(spark, batches, fan_in):
    table = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    assert found(line_dedup.dedup_lines(table, batches=batches, fan_in=fan_in)) == expected(ROWS)


def test_clashing_names_and_repeated_rows(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(line_dedup.dedup_lines(docs)) == expected(rows)
    clean = line_dedup.without_repeated_lines(docs)
    assert clean.columns == docs.columns
    assert sorted((r["text"] or "") for r in clean.collect()) == sorted(r[3] for r in expected(rows))


def test_empty(docs):
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


def test_runs_are_levelled_and_merged_without_a_shuffle(spark):
    runs = line_dedup.LineRuns(spark, fan_in=2)
    seen = set()
    for k in range(5):
        lines = spark.range(k * 50, k * 50 + 100).select(
            F.xxhash64("id").alias("a"), F.xxhash64(F.lit(1), "id").alias("b"), F.col("id").alias("doc")
        )
        got = runs.add(lines).agg(F.count_if("known").alias("known"), F.count(F.lit(1)).alias("n")).first()
        ids = set(range(k * 50, k * 50 + 100))
        assert (got["known"], got["n"]) == (len(ids & seen), 100)
        seen |= ids
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    held = [r.count() for r in runs.runs()]
    assert sum(held) == len(seen)
    batch = spark.range(10).select(F.xxhash64("id").alias("a"), F.xxhash64(F.lit(1), "id").alias("b")).groupBy("a", "b").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = batch.join(runs.runs()[0], ["a", "b"], "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_key_of_every_character(spark):
    """Only A-Z change, and only the six blanks are stripped, whatever the character."""
    points = [c for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"{chr(c)}aÉ{chr(c)}Z{chr(c)}" for c in points]
    table = spark.createDataFrame([(t,) for t in texts], "t string").select("t", line_dedup.line_key(F.col("t")).alias("k"))
    assert [(r["t"], r["k"]) for r in table.collect() if r["k"] != key(r["t"])] == []
