from pyspark.sql import functions as F

from litevidence.operators.skew import grid_join


def _shuffled(joined):
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    return {word.split("#")[0].strip("[") for word in plan.replace(",", " ").split() if "#" in word}


def test_cells_of_an_inner_join_carry_no_counts(spark):
    """Counts are used where hot keys are found, and no row is shuffled with them."""
    x = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"))
    y = spark.range(90).select((F.col("id") % 4).alias("k"), F.col("id").alias("y"))
    joined = grid_join([x, y], ["k"], "inner", 50)
    assert joined.count() == x.join(y, "k").count() and joined.columns == ["k", "x", "y"]
    assert not _shuffled(joined) & {"_hit0", "_hit1", "_sides"}
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join Inner" in line and "_n0" in line for line in plan.splitlines())
    left = grid_join([x, y], ["k"], "left", 50)
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(map(tuple, x.join(y, "k", "left").collect()), key=repr)
