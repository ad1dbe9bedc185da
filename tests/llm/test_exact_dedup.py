import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from llm_fixtures import docs  # noqa: F401

from litevidence.llm import exact_dedup
from litevidence.llm.common import documents

SF = "/root/testdata/sf0.001"


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    return sorted(
        (
            (d, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest())
            for t, ids in groups.items() for d in ids
        ),
        key=repr,
    )


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [3, 64, 4096])
def test_like_grouping_by_text(docs, size):
    result = exact_dedup.exact_duplicates(docs, block_bytes=size)
    assert found(result) == expected(docs.collect())
    # One row of each group stays, one of two equal rows.
    assert result.where("kept").count() == len({r["text"] or "" for r in docs.collect()})


def test_whole_table(spark):
    docs = documents(spark, SF)
    assert found(exact_dedup.exact_duplicates(docs, block_bytes=256)) == expected(docs.collect())


def test_digests_never_decide(docs, monkeypatch):
    """With the first seeds, many blocks share a digest."""
    strong, seeds = exact_dedup._digest, []

    def weak(block, seed):
        seeds.append(seed)
        if seed >= 3:
            return strong(block, seed)
        return F.struct((F.xxhash64(block) % 2).alias("a"), F.lit(0).cast("long").alias("b"))

    monkeypatch.setattr(exact_dedup, "_digest", weak)
    assert found(exact_dedup.exact_duplicates(docs, block_bytes=64)) == expected(docs.collect())
    assert set(seeds) == {1, 2, 3}


def test_rows_that_stay(docs):
    kept = exact_dedup.without_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r["text"] or "" for r in docs.collect()})


def test_empty(docs):
    assert exact_dedup.exact_duplicates(docs.limit(0)).collect() == []
