"""Tables laid out in buckets of a key, so that later joins and groupings by it need no exchange.

A layout is a folder: `rows/`, one file per bucket, and `layout/`, a row with schema, keys and number of buckets. Any
session can open it; no metastore has to know it.

A bucket is read by one task, so a key with a large share of the rows would make one task as large. Such a table is
written without buckets, and joins shuffle it as usual, where adaptive execution splits what is too large.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from litevidence.sources.writers import write_parquet

MAX_SHARE = 4.0    # times the mean that the largest bucket may hold
MIN_BUCKETS = 8
BUCKET_ROWS = 1_000_000   # of the largest table, on average


def _table(path: str) -> str:
    return "layout_" + hashlib.sha256(path.encode()).hexdigest()[:32]


def _list(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def bucket_count(*tables: DataFrame, rows: int = BUCKET_ROWS) -> int:
    """Buckets for tables that are to meet, so that those of the largest hold about `rows` rows each.

    A bucket is one task's, so their number has to grow with the tables. These are counted, so they should be written ones.
    """
    return max(MIN_BUCKETS, -(-max(table.count() for table in tables) // rows))


def largest_bucket(rows: DataFrame, keys: Sequence[str], buckets: int) -> float:
    """Rows of the largest bucket, as a multiple of the mean over all buckets; 0 without rows."""
    sizes = rows.groupBy(F.pmod(F.hash(*keys), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    return most * buckets / total if total else 0.0


def write_bucketed(
    rows: DataFrame, path: str, keys: Sequence[str], buckets: int, max_share: float = MAX_SHARE
) -> bool:
    """Writes rows in `buckets` buckets of `keys`, each sorted by them; False if they were written plainly.

    Rows are given twice, once to measure the buckets, so they should be a written table. Tables that are to meet without an
    exchange need the same number of buckets. Rows without a key come together like rows of one key.
    """
    spark = rows.sparkSession
    keys, path = list(keys), path.rstrip("/")
    bucketed = largest_bucket(rows, keys, buckets) <= max_share
    name = _table(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    if bucketed:
        # Spark deals rows to tasks and to buckets by the same hash, so each task writes one file.
        dealt = rows.repartition(buckets, *keys).write.mode("overwrite").format("parquet")
        dealt.option("path", f"{path}/rows").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    else:
        write_parquet(rows, f"{path}/rows")
    layout = [(rows.schema.json(), keys, buckets if bucketed else 0)]
    write_parquet(spark.createDataFrame(layout, "schema string, keys array<string>, buckets int"), f"{path}/layout")
    return bucketed


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table written by `write_bucketed`, in this session or another."""
    path = path.rstrip("/")
    layout = spark.read.parquet(f"{path}/layout").first()
    schema = StructType.fromJson(json.loads(layout["schema"]))
    if not layout["buckets"]:
        return spark.read.schema(schema).parquet(f"{path}/rows")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    keys = _list(layout["keys"])
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_table(path)} ({columns}) USING parquet "
        f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout['buckets']} BUCKETS LOCATION '{path}/rows'"
    )
    return spark.table(_table(path))
