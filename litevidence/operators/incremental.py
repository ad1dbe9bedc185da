"""Prevalence of triplets, kept up to date as articles arrive.

Articles are append-only: an article comes with all its mentions, once or again. Each batch adds a version with the
articles it brought and the counts of their triplets; what is known of an article already is left out. Counts of disjoint
sets of articles add up, so totals are sums over versions and no batch reads the mentions of another. When there are
many versions, they are compacted to one.

A version counts once its last table is written, so a batch that broke off is simply given again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litevidence.operators.triplets import ENTITY_TYPES, extract_triplets, triplet_counts
from litevidence.sources.writers import file_system, staged

FAN_IN = 8
_COUNTS = ", ".join(f"{kind} string" for kind in ENTITY_TYPES) + ", n_triplets long, n_articles long"


class PrevalenceState:
    """Tables under a shared folder: `articles/` and `counts/`, a folder per version in each."""

    def __init__(self, spark: SparkSession, folder: str, fan_in: int = FAN_IN) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.fan_in = fan_in

    def _versions(self, table: str) -> list[str]:
        """Whole versions in order: `v` for a batch, `c` for the sum of all before it."""
        system, path = file_system(self.spark, f"{self.folder}/{table}")
        if not system.exists(path):
            return []
        folders = [s.getPath() for s in system.listStatus(path)]
        names = [p.getName() for p in folders if system.exists(file_system(self.spark, f"{p.toString()}/_SUCCESS")[1])]
        return sorted(names, key=lambda name: int(name[1:]))

    def _last(self) -> int:
        """The newest version whose counts, which come last, are whole."""
        return max((int(name[1:]) for name in self._versions("counts")), default=0)

    def _live(self) -> list[str]:
        """Versions of counts from the last sum on."""
        names = self._versions("counts")
        sums = [i for i, name in enumerate(names) if name[0] == "c"]
        return names[sums[-1] :] if sums else names

    def _read(self, table: str, versions: Sequence[str], schema: str) -> DataFrame:
        paths = [f"{self.folder}/{table}/{name}" for name in versions]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def articles(self) -> DataFrame:
        done = self._last()
        return self._read("articles", [n for n in self._versions("articles") if int(n[1:]) <= done], "pmid string")

    def counts(self) -> DataFrame:
        """CD, GP, DS, n_triplets and n_articles over all articles so far."""
        parts = self._read("counts", self._live(), _COUNTS)
        return parts.groupBy(*ENTITY_TYPES).agg(F.sum("n_triplets").alias("n_triplets"), F.sum("n_articles").alias("n_articles"))

    def add(self, mentions: DataFrame, **options) -> None:
        """Counts the articles of a batch that are not known yet. Options are those of `extract_triplets`.

        Their mentions are written once: listing the articles, counting and extracting all read them.
        """
        version = self._last() + 1
        new = staged(mentions.join(self.articles(), "pmid", "left_anti"), "new-mentions")
        new.select("pmid").where("pmid IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{self.folder}/articles/v{version}")
        counts = triplet_counts(extract_triplets(new, **options)).select(*ENTITY_TYPES, "n_triplets", "n_articles")
        counts.write.mode("overwrite").parquet(f"{self.folder}/counts/v{version}")
        if len(self._live()) >= self.fan_in:
            self.compact()

    def compact(self) -> None:
        """Sums all versions into one more, which from then on stands for them."""
        self.counts().write.mode("overwrite").parquet(f"{self.folder}/counts/c{self._last() + 1}")
