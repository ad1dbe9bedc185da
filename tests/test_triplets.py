import random

import pytest
from conftest import rows

from litevidence.operators.triplets import ENTITY_TYPES, busy_articles, extract_triplets, triplet_counts

SCHEMA = "pmid string, sentence string, date string, section string, entity_type string, label string, label_id string"
OUT = ["pmid", "sentence", "date", "section", *ENTITY_TYPES]


def mentions(spark, data):
    return spark.createDataFrame(
        [(p, s, "2020-01-01", "ABS", t, None if i is None else f"name {i}", i) for p, s, t, i in data], SCHEMA
    )


@pytest.fixture
def sample(spark):
    rng = random.Random(0)
    data = [("1", "full", "CD", "c1"), ("1", "full", "CD", "c2"), ("1", "full", "CD", "c1"),
            ("1", "full", "GP", "g1"), ("1", "full", "DS", "d1"), ("1", "full", "DS", "d2"),
            ("1", 'no "gene"\tand\nlines', "CD", "c1"), ("1", 'no "gene"\tand\nlines', "DS", "d1"),
            ("2", "only disease", "DS", "NA"), ("3", "no id", "CD", None), ("4", "part id", "CD", None),
            ("4", "part id", "GP", "g9"), ("1", None, "CD", "c7")]
    data += [("5", "other types only", "OG", "o1"), ("1", "full", "OG", "o2")]
    data += [("9", rng.choice(["s", "t"]), rng.choice(ENTITY_TYPES), f"i{rng.randrange(9)}") for _ in range(90)]
    return mentions(spark, data)


def expected(df, outer):
    groups = {}
    for r in df.collect():
        if r.sentence is None:
            continue
        kinds = groups.setdefault((r.pmid, r.sentence, r.date, r.section), {k: set() for k in ENTITY_TYPES})
        if r.label_id is not None and r.entity_type in kinds:
            kinds[r.entity_type].add(r.label_id)
    out = []
    for key, kinds in groups.items():
        slots = [kinds[k] or ({None} if outer else set()) for k in ENTITY_TYPES]
        out += [(*key, c, g, d) for c in slots[0] for g in slots[1] for d in slots[2]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("outer", [False, True])
@pytest.mark.parametrize("max_product,gathered", [(10_000_000, 50_000), (1, 1), (50, 1000), (10_000_000, 20)])
def test_every_way_gives_the_same_triplets(spark, sample, outer, max_product, gathered):
    got = extract_triplets(sample, outer=outer, max_product=max_product, gathered=gathered)
    assert rows(got.select(OUT)) == expected(sample, outer)


def test_inner_is_part_of_outer(spark, sample):
    assert set(rows(extract_triplets(sample).select(OUT))) <= set(
        rows(extract_triplets(sample, outer=True).select(OUT))
    )


def test_names_instead_of_ids(spark, sample):
    got = extract_triplets(sample, ("pmid", "sentence"), "label")
    assert ("1", "full", "name c2", "name g1", "name d1") in rows(got)


def test_busy_is_a_matter_of_the_product(spark):
    rows_ = [("1", "s", t, f"{t}{i}") for t in ENTITY_TYPES for i in range(6)] + [("2", "s", "CD", f"c{i}") for i in range(30)]
    busy = busy_articles(mentions(spark, rows_), max_product=200)
    assert [r.pmid for r in busy.collect()] == ["1"]
    assert rows(busy_articles(mentions(spark, rows_), max_product=10_000, gathered=20)) == [("2",)]


def test_counts(spark):
    t = extract_triplets(mentions(spark, [(p, s, t, t) for p, s in [("1", "a"), ("1", "b"), ("2", "a")]
                                          for t in ENTITY_TYPES]))
    assert rows(triplet_counts(t)) == [("CD", "GP", "DS", 3, 2)]


def test_one_shuffle_and_no_python(spark, sample, capsys):
    found = extract_triplets(sample)
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Cartesian" not in plan
