import numpy as np

from llm_fixtures import tokenizer  # noqa: F401

from litevidence.llm import packing, tokens


def test_a_small_store_gives_the_same_ids(tokenizer):  # noqa: F811
    text = " ".join(f"word{i} plain{i % 7}" for i in range(2000))
    small = tokens.Encoder(tokenizer, kept_bytes=1 << 12)
    assert np.array_equal(np.append(small.encode(text), small.encode(text)), np.tile(tokens.Encoder(tokenizer).encode(text), 2))
    assert small.parts.kept_bytes == 1 << 12


def test_slices_of_a_batch_hold_all_documents(spark, tokenizer):  # noqa: F811
    n = 2 * packing.SLICE_ROWS + 3
    rows = spark.createDataFrame([(None if i % 50 == 0 else i, None if i % 9 == 0 else "a b " * (i % 40)) for i in range(n)], "doc_id long, text string")
    found = packing.cut(rows.coalesce(1), tokenizer, 0, 16).toPandas()
    assert (found["piece"] == 0).sum() == n and set(found["doc_id"].dropna().astype(int)) == {i for i in range(n) if i % 50}
    assert found["length"].max() <= 16 and (found["start"] == found["piece"] * 16).all()
