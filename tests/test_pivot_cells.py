"""Cells of a pivot in blocks cost by the values held, not by the width of a block."""

from __future__ import annotations

import pytest

from litevidence.operators import metrics


@pytest.mark.parametrize("kind", ["long", "double"])
def test_cells_between_first_and_last_place(spark, kind):
    held = {"a": [0], "b": [49], "c": [0, 1, 25, 48, 49], "d": list(range(50)), "e": [7, 60, 99]}
    counts = spark.createDataFrame([(r, f"c{i:03d}", i + 1) for r, places in held.items() for i in places] + [("z", f"c{i:03d}", 1) for i in range(100)], "r string, c string, n int")
    blocks, _ = metrics.pivot_blocks(counts.selectExpr("r", "c", f"CAST(n AS {kind}) AS n"), "r", "c", "n", width=50)
    want = {(r, b): [i + 1 if i in places else None for i in range(b * 50, b * 50 + 50)] for r, places in held.items() for b in {i // 50 for i in places}}
    assert {(r["r"], r["block"]): r["cells"] for r in blocks.where("r <> 'z'").collect()} == want


def test_no_look_up_for_each_place(spark, capsys):
    counts = spark.createDataFrame([("a", "x", 1)], "r string, c string, n int")
    metrics.pivot_blocks(counts, "r", "c", "n")[0].explain()
    assert "sequence(" not in capsys.readouterr().out
