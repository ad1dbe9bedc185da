import re

import numpy as np
import pytest

from llm_fixtures import docs  # noqa: F401

from litevidence.llm import jaccard_join
from litevidence.llm.common import documents
from litevidence.llm.components import connected

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def expected(rows, num=75, den=100):
    rows = [(r["doc_id"], shingles(r["text"])) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(rows)), key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"range_shingles": 40, "leaf": 2}, {"leaf": 1, "leaf_pairs": 2}, {"num": 50}])
def test_fixture(docs, options):
    assert found(jaccard_join.similar_documents(docs, **options)) == expected(docs.collect(), options.get("num", 75))


@pytest.mark.parametrize("options", [{}, {"range_shingles": 2000, "leaf": 3}])
def test_whole_table(spark, options):
    docs = documents(spark, SF)
    assert found(jaccard_join.similar_documents(docs, **options)) == expected(docs.collect())


def test_chains_of_copies(spark):
    """Texts that change a word at a time, around a passage that many others share."""
    words = [f"a{i}" for i in range(60)]
    rows = []
    for i in range(80):
        if i % 2:
            words[(7 * i) % 60] = f"n{i}"
        rows.append((i, " ".join(words)))
    passage = " ".join(f"p{i}" for i in range(60))
    rng = np.random.default_rng(1)
    for i in range(80, 140):
        rows.append((i, passage + " " + " ".join(f"u{i}x{j}" for j in range(int(rng.integers(5, 60))))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"range_shingles": 500, "leaf": 4}, {"leaf": 2, "leaf_pairs": 9}):
        assert found(jaccard_join.similar_documents(docs, **options)) == expected(docs.collect())


def test_one_of_each(docs):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in expected(docs.collect()) if r[0] == r[2]}


def test_empty(docs):
    assert jaccard_join.similar_documents(docs.limit(0)).collect() == []


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (80, 2))] + [(200 + i, 201 + i) for i in range(50)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "x long, y long")).collect()}
    label = {n: n for p in pairs for n in p}
    while True:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert got == {n: r for n, r in label.items() if n != r}


def test_shingle_hashes_tell_texts_apart():
    texts = ["a b c d e f", "A b c d e f", "a b c d e", "a b c d  e\n", "b a c d e", "ab c d e", "", "  ", "é b c d e f"]
    sets = [s.tolist() for s in jaccard_join.shingle_sets([t.encode() for t in texts])]
    assert sets[0] == sets[1] and len(sets[0]) == 2
    assert sets[2] == sets[3] and sets[2][0] in sets[0]
    assert sets[4] != sets[2] and sets[5] != sets[2] and sets[6] == sets[7] == []
    assert set(sets[8]) & set(sets[0]) == set(sets[0]) - set(sets[2])


def test_one_row_of_each_component(spark):
    """Also where doc_ids are missing or repeated."""
    base = [f"w{i}" for i in range(60)]
    one, near, other = " ".join(base), " ".join(base[:58] + ["x", "y"]), " ".join(f"v{i}" for i in range(30))
    rows = [
        (None, one), (None, near), (None, other), (7, other + " end"), (7, "alone in the world of words"), (7, "alone in the world of words"),
        (3, None), (3, ""), (None, None), (9, ""), (9, ""), (2, " ".join(f"u{i}" for i in range(9))), (1, " ".join(f"u{i}" for i in range(9))),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, text_key string")
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    assert [r for r in got if r[1] in (one, near)] in ([(None, one)], [(None, near)])
    assert [r for r in got if r[1] and r[1] not in (one, near)] == sorted(
        [(7, other + " end"), (7, "alone in the world of words"), (1, " ".join(f"u{i}" for i in range(9)))], key=repr
    )
    assert sorted((r for r in got if not r[1]), key=repr) == sorted([(3, None), (3, ""), (None, None), (9, "")], key=repr)
