from llm_fixtures import docs, tokenizer  # noqa: F401
import corpus_pipeline
import pytest
from test_decontaminate import brute
from test_jaccard_join import expected as components
from test_packing import check

import __spark_entry__
from litevidence.llm import language_id
from litevidence.llm.common import crc_fold, documents, table

SF = "/root/testdata/sf0.001"


def test_like_brute_force(spark, tokenizer):
    docs = documents(spark, SF)
    folds, out = language_id.HELD_OUT
    model = language_id.train(docs.where(crc_fold("doc_id", folds) != out))
    rows = docs.collect()
    judged = language_id.classify(model, [r.text for r in rows])["rejected"]
    rows = [r for r, bad in zip(rows, judged, strict=True) if not bad]
    last = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        last[r.text] = r
    rows = list(last.values())
    stay = {d for d, _, c in components(rows) if d == c}
    rows = [r for r in rows if r.doc_id in stay]
    leaks = {d for d, _ in brute(rows, table(spark, SF, "benchmark").collect())}
    rows = [r for r in rows if r.doc_id not in leaks]
    assert 0 < len(rows) < docs.count() and leaks
    check(corpus_pipeline.run(spark, SF).collect(), rows, tokenizer, 2048)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_and_take_edges(spark, docs, stage):
    _, f = corpus_pipeline.STAGES[stage]
    for given in (docs, docs.limit(0)):
        left = f(spark, given, SF)
        assert left.columns == docs.columns and left.count() <= given.count()


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
