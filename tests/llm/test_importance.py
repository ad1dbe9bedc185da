import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_fixtures import docs  # noqa: F401

from litevidence.llm import importance, radix

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def features(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def expected(rows, target, longest=1, buckets=10000, percent=10):
    def bucket(feature):
        return crc32(feature.encode()) % buckets

    s = Counter(bucket(f) for _, text in rows for f in features(text, longest))
    t = Counter(bucket(f) for text in target for f in features(text, longest))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in s
    }
    out, order = [], []
    for i, (doc_id, text) in enumerate(rows):
        found = [bucket(f) for f in features(text, longest)]
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None])
        if len(words(text)) >= 20:
            order.append((-score, doc_id is None, doc_id or 0, i))
    for place, (*_, i) in enumerate(sorted(order)[: len(order) * percent // 100]):
        out[i][4] = place + 1
    return sorted((tuple(r) for r in out), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


TARGET = ["w1 w2 w3 benchmark words", None, "", "ONE two Three é"]


@pytest.mark.parametrize("longest,percent", [(1, 10), (1, 100), (3, 50)])
def test_like_brute_force(spark, docs, longest, percent):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    result = importance.resample(docs, target, longest=longest, percent=percent)
    assert found(result) == expected(rows, TARGET, longest, percent=percent)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), none).collect() == []
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(importance.resample(docs, none, percent=100)) == expected(rows, [], percent=100)


def test_long_text_in_slices(monkeypatch):
    text = " ".join(f"Wört{i % 97}" for i in range(5000)).encode()
    whole = np.concatenate([f for _, f in importance.feature_buckets(text, importance.Buckets(1000), 3)])
    monkeypatch.setattr(importance, "_SLICE", 50)
    parts = list(importance.feature_buckets(text, importance.Buckets(1000), 3))
    assert len(parts) > 100 and sum(n for n, _ in parts) == 5000
    assert sorted(np.concatenate([f for _, f in parts])) == sorted(whole)


def test_store_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(importance, "_KEPT_WORDS", 10)
    known = importance.Buckets(100)
    assert [known[str(i).encode()] for i in range(50)] == [crc32(str(i).encode()) % 100 for i in range(50)]
    assert len(known) <= 10


LONGS = st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1), st.integers(-5, 5))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.lists(st.tuples(LONGS, st.integers(-3000, 3000)), max_size=60))
def test_radix_ranks(spark, keys):
    rows = spark.createDataFrame(keys, "x long, y long").repartition(5)
    order = [radix.descending("y"), radix.null_last("x"), radix.ascending("x")]
    got = radix.radix_ranked(rows, order).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(len(keys)))
    assert [(r["x"], r["y"]) for r in got] == sorted(keys, key=lambda k: (-k[1], k[0] is None, k[0] or 0))


def test_equal_keys_keep_their_order_over_blocks(spark):
    rows = spark.range(0, 5000, 1, 7).select(F.col("id"), (F.col("id") % 3).alias("k"))
    got = radix.radix_ranked(rows, [radix.ascending("k")]).orderBy("place").collect()
    assert [r["id"] for r in got] == sorted(range(5000), key=lambda i: i % 3)
