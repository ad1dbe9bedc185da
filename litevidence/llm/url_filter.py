"""Filtering of URLs by rules, and by boosted trees on lexical features where no rule fits.

Everything is a column expression; the trees are fitted by Spark ML and compiled into one.

The trees learn from labelled URLs. Where no labels are given, URLs label themselves: a host with a word of
`SEED_WORDS` counts as blocked. The words themselves are no feature, so the model goes by the form of a URL: lengths,
depth, digits, entropy, parameters, hyphens, and how often other names under its suffix are blocked.

The rates of suffixes are taken out of fold: a name's own labels, and those of the names in its fold, never enter its rate,
neither in training nor in judging. Only what has many names under it is a suffix with a rate of its own, so a registered
domain is none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litevidence.llm.common import hash_sample, staged
from litevidence.llm.trees import boosted_score

# (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SEED_WORDS = (
    "ad", "ads", "adult", "bet", "bets", "casino", "cheap", "gambling", "loan", "loans", "pharma", "pills", "poker", "porn",
    "sex", "spam", "track", "tracker", "viagra", "warez", "xxx",
)
TRAINING_ROWS = 20_000   # URLs of each label that the trees are fitted on, about so many at most
TREES, DEPTH = 15, 3
CUT = 0.5                # probability from which a URL is blocked
SMOOTHING = 20.0         # URLs of the overall rate that each suffix is given beforehand
FOLDS = 32               # folds of names, for rates out of fold
NAMES = 20               # names that must be known under a suffix before it has a rate of its own
BROADCAST_RATES = 100_000  # rates (suffix and fold) up to which their table is broadcast
SALTS = 16               # parts of the rows of one suffix and fold where it is not
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "host_entropy",
    "path_entropy", "parameters", "suffix_rate", "domain_rate",
)
# suffix, the names under it, rate
SUFFIXES = (("suffix", "domain", "suffix_rate"), ("domain", "name", "domain_rate"))


def host_of(url: Column) -> Column:
    """After the first `://` up to /, ?, # or the end, A-Z as lower case; empty without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _entropy(text: Column) -> Column:
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(letters).cast("double")
    share = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    return -F.aggregate(share, F.lit(0.0), lambda s, p: s + p * F.log2(p))


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.translate(text, sign, ""))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds host, path and the features of a URL that need no statistics, and its last one, two and three labels."""
    url = F.coalesce("url", F.lit(""))
    parts = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    n = F.greatest(F.length(url), F.lit(1))
    return parts.withColumns({
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": _count(F.col("path"), "/"), "labels": F.when(F.col("host") == "", 0).otherwise(_count(F.col("host"), ".") + 1),
        "digit_ratio": _count(url, "0123456789") / n, "host_digits": _count(F.col("host"), "0123456789"),
        "hyphens": _count(F.col("host"), "-"), "host_entropy": _entropy(F.col("host")), "path_entropy": _entropy(F.col("path")),
        "parameters": F.when(url.contains("?"), _count(url, "&") + 1).otherwise(0),
        "suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2),
        "name": F.substring_index("host", ".", -3),
    })


def seed_label(words: Sequence[str] = SEED_WORDS) -> Column:
    """1 if the host has one of the words, else 0; null without a host."""
    found = F.arrays_overlap(F.split("host", "[^a-z]+"), F.array(*[F.lit(w) for w in words]))
    return F.when(F.col("host") != "", found.cast("double"))


def _fold(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(FOLDS)).cast("int")


def suffix_rates(labelled: DataFrame, smoothing: float = SMOOTHING, least: int = NAMES) -> tuple[float, list[DataFrame]]:
    """The overall share of blocked URLs, and for each of SUFFIXES a written table: suffix, `_fold`, rate.

    A rate is the smoothed share over the URLs of all folds but one. Labels are summed by name before anything else.
    """
    total = float(labelled.agg(F.avg("label").alias("p")).first()[0] or 0.0)
    tables = []
    for suffix, name, rate in SUFFIXES:
        by_name = labelled.groupBy(suffix, name).agg(F.sum("label").alias("bad"), F.count("label").alias("n"))
        by_fold = by_name.groupBy(suffix, _fold(name).alias("_fold")).agg(
            F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("names")
        )
        by_fold = staged(by_fold, "url-folds")
        whole = by_fold.groupBy(suffix).agg(
            F.sum("bad").alias("all_bad"), F.sum("n").alias("all_n"), F.sum("names").alias("names")
        )
        whole = whole.where(F.col("names") >= least).withColumn("_fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))
        own = by_fold.select(suffix, "_fold", "bad", "n")
        rest = [F.col(f"all_{c}") - F.coalesce(c, F.lit(0)) for c in ("bad", "n")]
        rates = whole.join(own, [suffix, "_fold"], "left").select(
            suffix, "_fold", ((rest[0] + smoothing * total) / (rest[1] + smoothing)).alias(rate)
        )
        tables.append(staged(rates, "url-rates"))
    return total, tables


def with_rates(urls: DataFrame, rates: tuple[float, list[DataFrame]], broadcast_rates: int = BROADCAST_RATES) -> DataFrame:
    """Adds the rates of the URL's suffixes in its fold; the overall share where a suffix has none.

    A table of at most `broadcast_rates` rows is broadcast; the rows of a frequent suffix are dealt out before they meet a
    larger one.
    """
    total, tables = rates
    for (suffix, name, rate), table in zip(SUFFIXES, tables, strict=True):
        on = [suffix, "_fold"]
        dealt = urls.withColumn("_fold", _fold(name))
        if table.count() <= broadcast_rates:
            table = F.broadcast(table)
        else:
            on.append("_salt")
            dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64(*urls.columns), F.lit(SALTS)).cast("int"))
            table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(table, on, "left")
        urls = joined.select(*urls.columns, F.coalesce(rate, F.lit(total)).alias(rate))
    return urls


def fit(rated: DataFrame, key: Sequence[str], training_rows: int = TRAINING_ROWS) -> GBTClassificationModel | None:
    """Boosted trees on URLs with label and features; None with fewer than two labels.

    About `training_rows` URLs of each label are used at most, chosen by a hash of `key`. Each stands for as many URLs of its
    label as there are for one chosen, so the labels weigh what they do in the whole table.
    """
    names = list(FEATURES)
    own = [hash_sample(rated.where(F.col("label") == label), list(key), training_rows) for label in (0.0, 1.0)]
    sample = own[0].unionByName(own[1]).select("label", *[F.col(c).cast("double").alias(c) for c in names]).persist()
    try:
        chosen = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
        if len(chosen) < 2:
            return None
        sizes = {r["label"]: r["count"] for r in rated.groupBy("label").count().collect()}
        weight = F.when(F.col("label") == 1.0, sizes[1.0] / chosen[1.0]).otherwise(sizes[0.0] / chosen[0.0])
        vectors = VectorAssembler(inputCols=names, outputCol="_features").transform(sample.withColumn("_weight", weight))
        return GBTClassifier(
            featuresCol="_features", labelCol="label", weightCol="_weight", maxIter=TREES, maxDepth=DEPTH, seed=7
        ).fit(vectors)
    finally:
        sample.unpersist()


def rule_for(rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    labelled: DataFrame | None = None,
    training_rows: int = TRAINING_ROWS,
    cut: float = CUT,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    Takes any table with page_id and url; other columns are not read. `labelled` has url and label (1: block). A null url, or one without
    `://`, has empty host and path, fits no rule and is judged by its form. Rows that repeat are judged one by
    one. Of equally long rules that fit, the last one listed wins. The trees are fitted as `fit` says; the rates of suffixes cover all
    labelled URLs. With one label only, no URL is blocked but by a rule.
    """
    urls = lexical(pages.select("page_id", "url"))
    if labelled is None:
        known = urls.withColumn("label", seed_label())
    else:
        known = lexical(labelled.select("url", F.col("label").cast("double").alias("label")))
    known = known.where("label IS NOT NULL")
    rates = suffix_rates(known)
    key = [c for c in ("page_id", "url") if c in known.columns]
    model = fit(with_rates(known, rates).select("label", *key, *FEATURES), key, training_rows)
    score = F.lit(0.0) if model is None else boosted_score(model, list(FEATURES))
    rule, verdict = rule_for(rules)
    scored = with_rates(urls, rates).withColumn("score", score)
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") >= cut, "block").otherwise("allow")).alias("verdict"), "score",
    )
