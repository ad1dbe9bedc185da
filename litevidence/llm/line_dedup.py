"""Removal of lines that an earlier document holds already.

Documents come in batches of ascending doc_id. Hashes of the lines met so far lie in sorted runs: tables that are
bucketed and sorted by hash. Each new batch reduces its lines to one row per hash (the smallest and largest
doc_id), merges that with the runs (a merge join by bucket that shuffles no run) and leaves what no run holds as a run of its own.
Whenever a level has `fan_in` runs they are compacted to one of the next level, so there are few runs
to merge with and a hash is rewritten once per level.

A line stays if its hash is new in the batch and this is the batch's smallest doc_id with it. Everything else is
a position to leave out; the positions of a document come together in one row and meet the text once. Lines
are combined per task before they are shuffled, and the joins have one row per hash on the right, so a line that
a third of all documents hold is split by adaptive execution.

Hashes have 128 bits.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litevidence.llm.common import staged, text_or_empty, wrapped
from litevidence.sources.writers import staged_path

LEAST_CHARS = 10
BATCHES = 4
FAN_IN = 2
_BLANKS = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = (1 << 63) - 1
_HASH = ["a", "b"]


def line_key(line: Column) -> Column:
    """Without blanks at both ends, A-Z as a-z."""
    bare = F.trim(line, F.lit(_BLANKS))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    """What rows must agree in to lose the same lines; a null doc_id counts as larger than any other."""
    return [
        F.coalesce(doc_id.cast("long"), F.lit(_LAST)).alias("doc"),
        F.xxhash64(F.lit(3), text).alias("text_a"), F.xxhash64(F.lit(4), text).alias("text_b"),
    ]


class LineRuns:
    """Levelled sorted runs of line hashes."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN) -> None:
        self.spark = spark
        self.fan_in = fan_in
        self.buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def write(self, rows: DataFrame, name: str) -> DataFrame:
        """A table bucketed and sorted by hash, in the shared folder."""
        table = f"line_run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, *_HASH).write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option(
            "path", staged_path(self.spark, name)
        ).saveAsTable(table)
        return self.spark.table(table)

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch of lines (a, b, doc) and returns a, b, first, last and known of each hash in it."""
        batch = lines.groupBy(*_HASH).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        marks = []
        for i, run in enumerate(self.runs()):
            batch = batch.join(run.select(*_HASH, F.lit(True).alias(f"in_{i}")), _HASH, "left")
            marks.append(F.col(f"in_{i}"))
        known = F.coalesce(*marks, F.lit(False))
        found = self.write(batch.select(*_HASH, "first", "last", known.alias("known")), "line-batch")
        self.push(found.where("NOT known").select(*_HASH), 0)
        return found

    def push(self, run: DataFrame, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            merged = self.write(reduce(DataFrame.unionByName, self.levels[level]), "line-run")
            self.levels[level] = []
            self.push(merged, level + 1)


def _lines(docs: DataFrame, least_chars: int, bounds: list[int]) -> DataFrame:
    """Hash, position and batch of every line that is long enough to be dropped."""
    text = text_or_empty()
    cut = docs.select(*_row_key(F.col("doc_id"), text), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = cut.select("doc", "text_a", "text_b", "pos", line_key(F.col("line")).alias("key"))
    batch = reduce(lambda n, bound: n + (F.col("doc") > bound).cast("int"), bounds, F.lit(0))
    return keyed.where(F.char_length("key") >= least_chars).select(
        "doc", "text_a", "text_b", "pos",
        F.xxhash64(F.lit(1), "key").alias("a"), F.xxhash64(F.lit(2), "key").alias("b"), batch.alias("batch"),
    )


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """Every row as struct `row`, with n_lines, n_dropped and `kept`, the text that is left.

    Takes any table with doc_id and text. Texts are split at line feeds; null counts as empty, which is one empty line.
    Lines of `least_chars` characters or more without blanks at their ends, found in two documents or more, stay in the
    smallest doc_id that holds them, there as often as they occur. Rows with the same doc_id are one document; all
    rows without doc_id are one too, larger than any other. Rows are never lost or joined; an empty table gives none. Columns beside
    these two are carried along in `row` and may have any name.
    """
    spark = docs.sparkSession
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    cuts = docs.agg(F.percentile_approx(doc, [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    bounds = sorted(set(cuts or []))
    lines = staged(_lines(docs, least_chars, bounds), "lines", ["batch"])
    runs = LineRuns(spark, fan_in)
    dropped = []
    for batch in range(len(bounds) + 1):
        own = lines.where(F.col("batch") == batch)
        rules = runs.add(own.select(*_HASH, "doc")).where("known OR first < last")
        dropped.append(own.join(rules, _HASH).where("known OR doc != first").select("doc", "text_a", "text_b", "pos"))
    places = (
        reduce(DataFrame.unionByName, dropped)
        .groupBy("doc", "text_a", "text_b")
        .agg(F.array_sort(F.collect_set("pos")).alias("places"))
    )
    rows = wrapped(docs).withColumn("text", text_or_empty("row.text"))
    keys = _row_key(F.col("row.doc_id"), F.col("text"))
    cut = (
        rows.select("row", "text", *keys)
        .join(places, ["doc", "text_a", "text_b"], "left")
        .select("row", "text", "places", F.split("text", "\n", -1).alias("parts"))
    )
    return cut.select(
        "row",
        F.size("parts").cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(_between("parts", "places"), "\n")).alias("kept"),
    )


def _between(parts: str, places: str) -> Column:
    """The elements at no place of a sorted list, as the stretches before, between and after them."""
    n, k = F.size(parts), F.size(places)

    def stretch(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(places, i - 1) + 1)
        end = F.when(i == k, n).otherwise(F.get(places, i))
        return F.slice(parts, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), k), stretch))


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents with all their columns, texts without the lines that are dropped; null texts stay null."""
    left = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    found = dedup_lines(docs, **options)
    return found.select(*[left.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
