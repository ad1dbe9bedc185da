import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm_fixtures import docs, tokenizer  # noqa: F401
from test_packing import library_ids

from litevidence.llm import token_store
from litevidence.llm.common import documents
from litevidence.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def expected(rows, tokenizer):
    """In doc_id order, nulls first."""
    rows = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    out, start = [], 0
    for r in rows:
        ids = np.array([*library_ids(tokenizer, r["text"] or ""), 1], dtype="<u4")
        out.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("options", [{}, {"block_ids": 100, "bucket_keys": 4}, {"width": 4, "block_ids": 1}])
def test_round_trip(spark, docs, tokenizer, options):
    path = token_store.store_folder(spark)
    token_store.write_store(docs, path, tokenizer, **options)
    got = token_store.read_all(spark, path).collect()
    assert sorted(repr((r.doc_id, r.start, r.n_tokens, r.ids_crc32)) for r in got) == sorted(map(repr, expected(docs.collect(), tokenizer)))
    keys = spark.createDataFrame([(1, 0), (7, 0), (7, 1), (7, 2), (99, 0), (None, 0)], "doc_id long, copy int")
    found = {(r.doc_id, r.copy): r.ids for r in token_store.read_ids(spark, path, keys).collect()}
    assert set(found) == {(1, 0), (7, 0), (7, 1), (None, 0)}
    kind = "<u4" if options.get("width") == 4 else "<u2"
    text = next(r["text"] for r in docs.collect() if r["doc_id"] == 1)
    assert np.frombuffer(found[1, 0], kind).tolist() == [*library_ids(tokenizer, text), 1]


def test_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 100, 4000):
        hashes = rng.integers(0, 2**63, n).astype(np.uint64)
        shifts, slots = token_store.build_bucket(hashes)
        assert sorted(slots) == list(range(n)) and len(shifts) == -(-n // token_store.GROUP_KEYS)
        assert (token_store.find_slots(hashes, shifts, n) == slots).all()


def test_keys_that_share_a_hash(spark):
    rng = np.random.default_rng(6)
    first, second = rng.integers(0, 2**63, 500).astype(np.uint64), rng.integers(0, 2**63, 500).astype(np.uint64)
    assert token_store.seed_of(first, second) == 0
    first[250:] = first[:250]
    seed = token_store.seed_of(first, second)
    mixed = token_store.seeded(first, second, seed)
    shifts, slots = token_store.build_bucket(mixed)
    assert seed > 0 and sorted(slots) == list(range(500)) and (token_store.find_slots(mixed, shifts, 500) == slots).all()
    second[250:] = second[:250]
    with pytest.raises(ValueError, match="128 bits"):
        token_store.seed_of(first, second)


def test_clashing_keys_are_found(spark, docs, tokenizer, monkeypatch):
    """All keys with one first hash: only seed and fingerprint tell them apart."""
    plain = token_store._with_bucket
    monkeypatch.setattr(token_store, "_with_bucket", lambda keys, n: plain(keys, n).withColumns({"hash": F.lit(5).cast("long"), "bucket": F.lit(0).cast("long")}))
    path = token_store.store_folder(spark)
    token_store.write_store(docs, path, tokenizer)
    got = token_store.read_all(spark, path).collect()
    assert sorted(repr((r.doc_id, r.start, r.n_tokens, r.ids_crc32)) for r in got) == sorted(map(repr, expected(docs.collect(), tokenizer)))
    unknown = spark.createDataFrame([(99, 0), (1, 7)], "doc_id long, copy int")
    assert token_store.locate(spark, path, unknown).collect() == []


def test_whole_table(spark, tokenizer):
    got = QUERIES["op8_token_store"](spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == expected(documents(spark, SF).collect(), tokenizer)


def test_empty(spark, docs, tokenizer):
    path = token_store.store_folder(spark)
    token_store.write_store(docs.limit(0), path, tokenizer)
    assert token_store.read_all(spark, path).collect() == []


def test_width_of_ids(spark, docs, tokenizer):
    with pytest.raises(ValueError, match="4 bytes"):
        token_store.write_store(docs, token_store.store_folder(spark), tokenizer, end_id=70_000, width=2)
    path = token_store.store_folder(spark)
    token_store.write_store(docs.limit(2), path, tokenizer, end_id=70_000)
    assert spark.read.parquet(f"{path}/meta").first()["width"] == 4
