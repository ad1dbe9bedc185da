from litevidence.sources import layout


def test_buckets_grow_with_the_larger_table(spark):
    small, large = spark.range(5), spark.range(101)
    assert layout.bucket_count(small, rows=10) == layout.MIN_BUCKETS
    assert layout.bucket_count(small, large, rows=10) == layout.bucket_count(large, small, rows=10) == 11
    assert layout.bucket_count(small.limit(0), rows=10) == layout.MIN_BUCKETS
