"""Quality of documents by a sparse ensemble of rules.

Statistics of a text are column expressions. Boosted trees are fitted on them, each path of a tree becomes a rule
(a conjunction of conditions on statistics), and a logistic regression with a lasso penalty weighs the rules; most
weights become 0. The rules that are left are compiled into one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litevidence.llm.common import hash_sample, staged, text_or_empty
from litevidence.llm.trees import Condition, rules_of

TRAINING_ROWS = 20_000    # labelled rows that the model is fitted on, about so many at most
FOLDS = 5                 # rows of fold 0 are held out
TREES, DEPTH, LASSO = 12, 3, 0.0005
THRESHOLD = 0.3
_KEY, _TARGET = "_doc", "_target"


def statistics() -> dict[str, Column]:
    """What is known of a text: shares of kinds of characters, lengths, repetition."""
    text = F.col("text")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")

    def share(signs: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, signs, ""))) / n

    words, lines = F.col("words"), F.col("lines")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digits": share("0123456789"),
        "signs": share("#$%&*@^~=+<>/\\_{}[]"),
        "bars": share("|"),
        "exclamations": share("!"),
        "stops": share(".,;:?"),
        "beyond_ascii": (F.octet_length(text) - F.length(text)) / n,
        "word_length": n / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "words_of_a_line": n_words / F.greatest(F.size(lines), F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)).cast("double"),
    }


def measured(docs: DataFrame) -> DataFrame:
    """doc_id as `_doc`, and the statistics of the whole text; null text counts as empty."""
    texts = docs.select(F.col("doc_id").alias(_KEY), text_or_empty().alias("text"))
    parts = texts.withColumns({"words": F.split("text", "[ \n\t]+"), "lines": F.split("text", "\n")})
    return parts.select(_KEY, *[value.cast("double").alias(name) for name, value in statistics().items()])


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[float, tuple[Condition, ...]]]

    def score(self) -> Column:
        """Probability of label 1, from the statistics as columns."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(_holds(rule), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _holds(rule: tuple[Condition, ...]) -> Column:
    out = rule[0].column()
    for condition in rule[1:]:
        out = out & condition.column()
    return out


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """The model of a table of statistics with `_target` (0 or 1). With one class only, or no row, there are no rules."""
    names = list(statistics())
    rows = rows.select(*names, F.col(_TARGET).cast("double").alias(_TARGET)).persist()
    try:
        seen = {r[0]: r[1] for r in rows.groupBy(_TARGET).count().collect()}
        if len(seen) < 2:
            return RuleModel({0.0: -2.0, 1.0: 2.0}.get(next(iter(seen), None), 0.0), [])
        vectors = VectorAssembler(inputCols=names, outputCol="_features").transform(rows)
        boosted = GBTClassifier(
            featuresCol="_features", labelCol=_TARGET, maxIter=trees, maxDepth=depth, subsamplingRate=0.7, seed=7, maxBins=32
        ).fit(vectors)
        rules = list(dict.fromkeys(rule for tree in boosted.trees for rule in rules_of(tree, names)))
        if not rules:
            return RuleModel(0.0, [])
        held = rows.select(_TARGET, *[_holds(rule).cast("double").alias(f"r{i}") for i, rule in enumerate(rules)])
        held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="_rules").transform(held)
        weighed = LogisticRegression(
            featuresCol="_rules", labelCol=_TARGET, regParam=lasso, elasticNetParam=1.0, standardization=False, maxIter=100
        ).fit(held)
        weights = weighed.coefficients.toArray()
        return RuleModel(float(weighed.intercept), [(float(w), r) for w, r in zip(weights, rules, strict=True) if w])
    finally:
        rows.unpersist()


def score_documents(
    docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS, folds: int = FOLDS, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Takes documents (doc_id, text) and labels (doc_id, quality); other columns are not read. The model learns from about
    `training_rows` labelled rows outside of fold 0 (crc32 of the doc_id modulo `folds`), chosen by a hash of the doc_id; rows without doc_id
    or label teach nothing and are not held out. Null text counts as empty and is scored. Documents are never
    dropped or repeated, however many labels a doc_id has.
    """
    stats = staged(measured(docs), "statistics")
    fold = F.crc32(F.col(_KEY).cast("string").cast("binary")) % folds
    known = labels.select(F.col("doc_id").alias(_KEY), F.col("quality").alias(_TARGET)).where(f"{_TARGET} IN (0, 1)")
    training = hash_sample(stats.join(known, _KEY).where(fold != 0), [_KEY], training_rows)
    model = fit(training)
    return stats.select(
        F.col(_KEY).alias("doc_id"),
        F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        model.score().alias("score"),
        (model.score() >= threshold).cast("int").alias("predicted"),
    )
