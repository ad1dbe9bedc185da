import re

import numpy as np
import pytest

from litevidence.llm import decontaminate as dc
from litevidence.llm.common import documents, table

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(ws, k):
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}


def brute(docs, items, overlap=0.75):
    out = set()
    for d in docs:
        own = words(d["text"])
        for i in items:
            asked = words(i["text"])
            k = min(5, len(asked))
            if asked and len(grams(asked, k) & grams(own, k)) >= overlap * len(grams(asked, k)):
                out.add((d["doc_id"], i["item_id"]))
    return out


def test_whole_table(spark):
    docs, items = documents(spark, SF), table(spark, SF, "benchmark")
    want = brute(docs.collect(), items.collect())
    for options in ({}, {"max_index_bytes": 1000}):
        got = dc.find_items(docs, items, **options).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


@pytest.fixture()
def planted(spark):
    items = [(i, f"Question {i} about a{i} b{i} c{i} of the d{i} e{i} thing? The answer is f{i} g{i} h{i}.") for i in range(40)]
    items += [(90, None), (91, ""), (92, "..."), (93, "one two three"), (94, items[0][1])]
    filler = " ".join(f"z{j} the of" for j in range(300))
    docs = [
        (1, filler + " " + items[3][1].upper() + " " + filler),
        (2, filler + " the answer is of the thing question about " + filler),
        (3, items[5][1].replace(" ", "!!\n ")),
        (4, None), (5, ""), (None, items[7][1]),
        (6, (filler + " ") * 40 + items[8][1] + " and " + items[9][1]),
        (7, "so one two three go"), (3, items[5][1]), (8, "Question 4 about a4 b4 c4"), (9, items[0][1]),
    ]
    return (
        spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"),
        spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int"),
    )


def test_planted(planted):
    docs, items = planted
    got = sorted(((r.doc_id, r.item_id) for r in dc.find_items(docs, items).collect()), key=repr)
    assert got == sorted([(1, 3), (3, 5), (3, 5), (None, 7), (6, 8), (6, 9), (7, 93), (9, 0), (9, 94)], key=repr)
    clean = dc.without_items(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [2, 4, 5, 8]


def test_parts_of_an_item(planted):
    docs, items = planted
    r = next(r for r in dc.find_items(docs, items).collect() if r.doc_id == 6)
    assert r.overlap == r.question_overlap == r.answer_overlap == 1 and r.score >= r.threshold


def test_retrieval_misses_nothing():
    """All items whose exhaustive BM25 score reaches the threshold, and no other."""
    rng = np.random.default_rng(2)
    vocabulary = [f"w{int(i)}" for i in np.minimum(rng.zipf(1.3, 4000), 900)]
    items = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(6, 40))))) for i in range(90)]
    index = dc.build_index(items, overlap=0.6, block_items=7)
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(1, 400)))) for _ in range(30)] + [items[4][1], items[70][1] + " x " * 300]
    ids = [np.array([index.terms.get(w, -1) for w in t.split()]) for t in texts]
    length = max(dc.PASSAGE_WORDS, 2 * index.longest)
    stride = length - index.longest
    got = dc.retrieve(index, np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids]), length, stride)
    want = {}
    for o, x in enumerate(ids):
        for start in range(0, len(x), stride):
            here = set(x[start : start + length].tolist())
            for i in range(len(index.item_ids)):
                own = slice(index.item_bounds[i], index.item_bounds[i + 1])
                score = sum(s for t, s in zip(index.item_terms[own], index.item_impacts[own], strict=True) if t in here)
                if score >= index.thresholds[i] * (1 - 1e-9):
                    want[o, i] = max(want.get((o, i), 0), score)
    assert {(r.owner, r.item) for r in got.itertuples()} == set(want) and len(want) > 20
    assert np.allclose([want[r.owner, r.item] for r in got.itertuples()], got["score"])


def test_empty(planted):
    docs, items = planted
    assert dc.find_items(docs.limit(0), items).collect() == dc.find_items(docs, items.limit(0)).collect() == []


def test_parts_far_apart(spark):
    """Question and answer, or the quarters of an item, 1,000 words apart; the same words in another order are no item."""
    items = [(i, f"Question {i} is what a{i} b{i} c{i} d{i} e{i} f{i} have? " + " ".join(f"{c}{i}" for c in "ghijklmno") + ".") for i in range(30)]
    items += [(40, " ".join(f"q{j}" for j in range(120)))]
    filler = " ".join(f"z{j} the of" for j in range(400))
    long = items[30][1].split()
    docs = [
        (1, items[3][1].replace("?", "? " + filler)),
        (2, " ".join(filler + " " + " ".join(long[j : j + 30]) for j in range(0, 120, 30))),
        (3, filler + " " + items[4][1].split("?")[0]),
        (4, (filler + " ") * 2 + " ".join(reversed(items[5][1].split()))),
        (5, items[6][1] + " " + filler),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    got = dc.find_items(docs, items, overlap=0.6).collect()
    want = brute(docs.collect(), items.collect(), 0.6)
    assert {(r.doc_id, r.item_id) for r in got} == want == {(1, 3), (2, 40), (5, 6)} and len(got) == 3
    assert all(r.score >= r.threshold * (1 - 1e-9) for r in got)


def test_question_or_answer_alone(spark):
    """Most of an item's shingles are not enough if one of its parts is missing."""
    question = "What is the " + " ".join(f"a{j}" for j in range(40)) + "?"
    answer = " ".join(f"b{j}" for j in range(8)) + "."
    items = spark.createDataFrame([(1, f"{question} {answer}")], "item_id long, text string")
    texts = [question, answer, f"{question} {answer}", f"{question} and then {answer}", f"{question} b0 b1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in dc.find_items(docs, items).collect()) == [2, 3]
    assert sorted(r.doc_id for r in dc.find_items(docs, items, part_overlap=0.0).collect()) == [0, 2, 3, 4]


def test_rows_are_judged_by_their_own_text(spark):
    items = spark.createDataFrame([(1, "What is a b c d e f g h? It is i j k l m n o p.")], "item_id long, text string")
    bad, good = "x What is a b c d e f g h? It is i j k l m n o p. y", "a clean text"
    rows = [(None, bad), (None, good), (None, None), (4, bad), (4, good), (4, good), (5, bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in dc.without_items(docs, items).collect()), key=repr)
    assert left == sorted([r for r in rows if r[1] != bad], key=repr)
