import random

import pytest
from conftest import rows

from litevidence.operators.skew import grid_join, products, spread_left, spread_semi


def keyed(spark, name, seed, n=120):
    """Rows of which a third share one key and some have none."""
    rng = random.Random(seed)
    keys = ["hot"] * (n // 3) + [rng.choice(["a", "b", "c", f"only-{name}", None]) for _ in range(n - n // 3)]
    return spark.createDataFrame([(k, f"{name}{i}") for i, k in enumerate(keys)], f"k string, {name} string")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("max_product", [1, 50, 10_000_000])
def test_grid_join_equals_plain_join(spark, how, max_product):
    x, y = keyed(spark, "x", 1), keyed(spark, "y", 2, 60)
    want = rows(x.join(y, "k", how).select("k", "x", "y"))
    assert rows(grid_join([x, y], ["k"], how, max_product).select("k", "x", "y")) == want


def test_grid_join_hot_on_one_side_only(spark):
    x = keyed(spark, "x", 3)
    y = spark.createDataFrame([("a", "y1"), ("z", "y2")], "k string, y string")
    for left, right in ((x, y), (y, x)):
        want = rows(left.join(right, "k", "left").select("k", "x", "y"))
        assert rows(grid_join([left, right], ["k"], "left", 9).select("k", "x", "y")) == want


@pytest.mark.parametrize("how", ["inner", "full_outer"])
def test_grid_join_of_three_sides(spark, how):
    sides = [keyed(spark, n, i, size).dropna() for i, (n, size) in enumerate({"x": 30, "y": 12, "z": 9}.items())]
    want = sides[0].join(sides[1], "k", how).join(sides[2], "k", how)
    got = grid_join(sides, ["k"], how, 8)
    assert rows(got.select("k", "x", "y", "z")) == rows(want.select("k", "x", "y", "z"))


def test_products_cover_all_keys_and_bound_the_cells(spark):
    x = spark.createDataFrame([(k % 40, k) for k in range(4000)], "k int, x int")
    y = spark.createDataFrame([(k % 40, k) for k in range(400)], "k int, y int")
    found = products([x, y], ["k"], 300).collect()
    assert len(found) == 40   # every key with 100 x 10 combinations, without a limit
    assert all((r._n0, r._n1) == (100, 10) and -(-r._n0 // r._s0) * -(-r._n1 // r._s1) <= 300 for r in found)
    assert products([x, y], ["k"], 1000).isEmpty()


def test_rows_without_a_key_are_dealt_out(spark):
    """Half of the keys are missing."""
    x = spark.createDataFrame([(None if i % 2 else f"k{i % 8}", i) for i in range(2000)], "k string, x int")
    y = spark.createDataFrame([("k0", 1), ("k4", 2)], "k string, y int")
    assert rows(spread_left(x, y, "k").select("k", "x", "y")) == rows(x.join(y, "k", "left").select("k", "x", "y"))
    for keys in ([("k0",), (None,)], [("k0",)], [(None,)]):
        right = spark.createDataFrame(keys, "r string")
        want = x.join(right, x.k.eqNullSafe(right.r), "left_semi")
        assert rows(spread_semi(x, right, "k", "r").select("k", "x")) == rows(want)
