"""Language identification with character language models, one per language.

The counts of all character n-grams of all training documents are summed per language in Spark, and Spark derives
from the whole table what interpolated Kneser-Ney smoothing needs: counts of counts, continuation counts, totals and
back-off weights of contexts, probabilities. Nothing is left out, however large a language is.

The model is a table of n-grams (up to `max_counts` of them the driver computes the same from the counts). For scoring, each language has arrays in ascending order of the n-gram's hash (a
bijection of its code, so hashes do not collide), searched by bisection. Where these arrays take more than
`max_bytes`, they are cut into slices by a hash of the two symbols before the predicted one: all n-grams that the score of
one character can ask for lie in one slice, and tasks load the slices one after the other. A text goes to the
language of lowest cross-entropy per character, unless that is higher than the language's own documents allow, each
scored by a model of the half it is not in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litevidence.llm.common import chunks, releasing, staged, wrapped

ORDER = 4
MAX_BYTES = 64 << 20      # of a slice of the model
MAX_COUNTS = 4_000_000    # n-grams up to which the driver turns counts into probabilities, by the same formulas
RATE = 0.0005             # of a language's own documents that its limit would reject, judged by a model of others
MARGIN = 0.25             # beyond that, in deviations
LEAST_REACH = 1.0         # of any language, as few documents say little of their tail
BINS = 100                # of one deviation, in which calibration counts texts
SPREAD = 8.0              # standard errors that a short text may lie above its language
HELD_OUT = (4, 2)         # folds, and the fold that is kept out of training
_BITS = 10                # of a symbol
_CHUNK = 400_000          # characters whose scores are in memory at once
_ODD = np.uint64(0x9E3779B97F4A7C15)
RESULT = "lang_pred string, score double, cross_entropy double, excess double, rejected boolean"


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of every code point: 0 for all that is no letter; letters beyond the Latin ranges share symbols."""
    table = np.zeros(0x110000, dtype=np.int16)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    table[letters] = np.where(letters < 768, letters, 768 + letters % 255)
    return table


def symbol_sequence(text: str, order: int = ORDER) -> np.ndarray:
    """Symbols of the lower-cased text, runs of other characters as one 0, order - 1 zeros in front.

    Empty if the text has no letter.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found = _symbols()[points]
    keep = found != 0
    if not keep.any():
        return np.zeros(0, dtype=np.int64)
    keep[1:] |= found[:-1] != 0
    found = found[keep].astype(np.int64)
    start = int(found[0] == 0)  # the zeros in front stand for it
    return np.concatenate([np.zeros(order - 1, dtype=np.int64), found[start:]])


def ngram_codes(sequence: np.ndarray, order: int = ORDER) -> np.ndarray:
    n = len(sequence) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    codes = np.zeros(n, dtype=np.int64)
    for k in range(order):
        codes = (codes << _BITS) | sequence[k : k + n]
    return codes


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, dtype=np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(codes) else counts


def count_ngrams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, code, n) over all rows of (lang, text), combined in each task before the shuffle."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                texts = texts.tolist()
                parts = held.setdefault(lang, [])
                for part in chunks(texts, 4 * _CHUNK):
                    codes = np.concatenate([ngram_codes(symbol_sequence(t, order), order) for t in texts[part]])
                    parts.append(np.unique(codes, return_counts=True))
                held[lang] = [_merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
        for lang, parts in held.items():
            yield pd.DataFrame({"lang": lang, "code": parts[0][0], "n": parts[0][1]})

    counted = rows.select("lang", "text").mapInPandas(releasing(tally), "lang string, code long, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _mask(k: int) -> int:
    return (1 << (_BITS * k)) - 1


def smoothed(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """The model as a table: lang, k, code, log_p, log_back; from (lang, code, n) of the highest order.

    `log_p` belongs to the n-gram `code` of k symbols; a row without it holds the back-off weight of the context `code` of
    k symbols. Row (lang, 0) holds the log probability of a symbol never seen.
    """
    seen = [counts.select("lang", "code", F.col("n").cast("double").alias("n"))]
    for k in range(order - 1, 0, -1):  # continuation counts: how many symbols stand before the n-gram
        shorter = F.col("code").bitwiseAND(F.lit(_mask(k))).alias("code")
        seen.append(staged(seen[-1].select("lang", shorter).groupBy("lang", "code").agg(F.count(F.lit(1)).cast("double").alias("n")), "continuations"))
    seen.reverse()
    # One symbol more than the languages know together; a single number.
    alphabet = seen[0].select(F.col("code")).distinct().count()
    floor = 1.0 / (alphabet + 1.0)
    lower = None
    out = counts.select("lang").distinct().select("lang", F.lit(0).alias("k"), F.lit(0).cast("long").alias("code"), F.lit(float(np.log(floor))).alias("log_p"), F.lit(None).cast("double").alias("log_back"))
    for k, grams in enumerate(seen, 1):
        once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discounts = grams.groupBy("lang").agg(F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(F.lit(0.5)).alias("d"))
        context = F.shiftright("code", _BITS).alias("context")
        totals = grams.groupBy("lang", context).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        totals = staged(totals.join(discounts, "lang").withColumn("back", F.col("d") * F.col("kinds") / F.col("total")), "contexts")
        p = grams.withColumn("context", context).join(totals, ["lang", "context"])
        if lower is None:
            p = p.withColumn("below", F.lit(floor))
        else:
            p = p.withColumn("short", F.col("code").bitwiseAND(F.lit(_mask(k - 1))))
            p = p.join(lower.select("lang", F.col("code").alias("short"), F.col("p").alias("below")), ["lang", "short"])
        p = p.withColumn("p", F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("back") * F.col("below"))
        lower = staged(p.select("lang", "code", "n", "p"), "probabilities")
        none = F.lit(None).cast("double")
        out = out.unionByName(lower.select("lang", F.lit(k).alias("k"), "code", F.log("p").alias("log_p"), none.alias("log_back")))
        out = out.unionByName(
            totals.select("lang", F.lit(k - 1).alias("k"), F.col("context").alias("code"), none.alias("log_p"), F.log("back").alias("log_back"))
        )
    return out


def _hashes(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.uint64) * _ODD


@dataclass
class Level:
    """One order of one language: n-gram hashes and log probabilities; context hashes and log back-off weights."""

    grams: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_back: np.ndarray


@dataclass
class Slice:
    """Of each language the levels from order 1 up."""

    levels: list[list[Level]]


@dataclass
class Model:
    langs: list[str]
    order: int
    floor: float            # log probability of a symbol never seen
    slices: list            # broadcast variables of a Slice each
    mean: np.ndarray        # of a language's own cross-entropy for each character
    deviation: np.ndarray   # and its standard deviation
    reach: np.ndarray       # deviations above the mean that a long text may reach


def slice_of(codes, order: int, n_slices: int):
    """The slice that scores n-grams of the highest order: by the two symbols before the last one (or what there is)."""
    return (((codes >> _BITS) & _mask(min(2, order - 1))) * 40503 >> 4) % n_slices


def _sorted_levels(rows: pd.DataFrame, order: int) -> list[Level]:
    levels = []
    for k in range(1, order + 1):
        parts = []
        for size, column in ((k, "log_p"), (k - 1, "log_back")):
            own = rows[(rows["k"] == size) & rows[column].notna()]
            hashes = _hashes(own["code"].to_numpy(np.int64))
            by = np.argsort(hashes)
            parts += [hashes[by], own[column].to_numpy(np.float32)[by]]
        levels.append(Level(*parts))
    return levels


def fitted(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> tuple[dict[str, list[Level]], float]:
    """What `smoothed` computes, as arrays: the levels of each language, and the log probability of a symbol never seen."""
    seen = {}
    for lang, (codes, n) in counts.items():
        by = np.argsort(codes)
        own = [(codes[by], n[by].astype(np.float64))]
        for k in range(order - 1, 0, -1):
            own.append(tuple(np.unique(own[-1][0] & _mask(k), return_counts=True)))
        seen[lang] = own[::-1]
    alphabet = len(np.unique(np.concatenate([own[0][0] for own in seen.values()]))) if seen else 0
    floor = -np.log(alphabet + 1.0)
    out = {}
    for lang, own in seen.items():
        levels, short, below = [], None, None
        for k, (codes, n) in enumerate(own, 1):
            once, twice = int((n == 1).sum()), int((n == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            contexts, of, kinds = np.unique(codes >> _BITS, return_inverse=True, return_counts=True)
            total = np.bincount(of, weights=n)
            back = discount * kinds / total
            lower = np.exp(floor) if k == 1 else below[np.searchsorted(short, codes & _mask(k - 1))]
            p = np.maximum(n - discount, 0) / total[of] + back[of] * lower
            short, below = codes, p
            by, by_context = np.argsort(_hashes(codes)), np.argsort(_hashes(contexts))
            levels.append(Level(
                _hashes(codes)[by], np.log(p)[by].astype(np.float32),
                _hashes(contexts)[by_context], np.log(back)[by_context].astype(np.float32),
            ))
        out[lang] = levels
    return out, float(floor)


def _slices(table: DataFrame, langs: list[str], order: int, max_bytes: int) -> list:
    """The table as arrays, in as many slices as its size asks; one slice at a time passes through the driver.

    N-grams of one or two symbols and contexts of one are in every slice; others lie with the pair that selects the slice.
    """
    context = table.sparkSession.sparkContext
    n_slices = max(1, -(-table.count() * 12 // max_bytes))
    if n_slices > 1:
        # The pair starts a shorter n-gram, or a context that is shorter than the longest: it is their first two symbols
        # after those that stand before it.
        size = F.when(F.col("log_p").isNotNull(), F.col("k") - 1).otherwise(F.col("k"))
        pair = F.expr("CASE WHEN log_p IS NOT NULL THEN shiftright(code, %d) ELSE code END" % _BITS).bitwiseAND(F.lit(_mask(min(2, order - 1))))
        own = F.shiftright(pair * 40503, 4) % n_slices
        table = table.withColumn("own", F.when(size >= min(2, order - 1), own))
    out = []
    for i in range(n_slices):
        rows = table if n_slices == 1 else table.where(F.col("own").isNull() | (F.col("own") == i))
        found = rows.where("k > 0 OR log_back IS NOT NULL").select("lang", "k", "code", "log_p", "log_back").toPandas()
        by_lang = dict(list(found.groupby("lang")))
        out.append(context.broadcast(Slice([_sorted_levels(by_lang[lang], order) for lang in langs])))
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted hash in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def log_probabilities(levels: list[Level], floor: float, codes: np.ndarray) -> np.ndarray:
    """Log probability of each n-gram's last symbol after the others in one language."""
    out = np.zeros(len(codes))
    rest = np.arange(len(codes))
    for k in range(len(levels), 0, -1):
        level = levels[k - 1]
        own = codes[rest] & _mask(k)
        at, hit = _find(level.grams, _hashes(own))
        out[rest[hit]] += level.log_p[at[hit]]
        rest, own = rest[~hit], own[~hit]
        if not len(rest):
            return out
        at, hit = _find(level.contexts, _hashes(own >> _BITS))
        out[rest[hit]] += level.log_back[at[hit]]
    out[rest] += floor
    return out


def _sums(model: Model, codes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Log likelihood of each text in each language, a row per text."""
    out = np.zeros((texts, len(model.langs)))
    # In order of their hash, equal n-grams are looked up once and the search walks through the arrays.
    hashes, back = np.unique(_hashes(codes), return_inverse=True)
    own = (hashes * np.uint64(pow(int(_ODD), -1, 1 << 64))).astype(np.int64)
    logs = np.zeros((len(model.langs), len(own)))
    place = slice_of(own, model.order, len(model.slices))
    for i, shared in enumerate(model.slices):
        at = np.flatnonzero(place == i)
        if len(at):
            for j, levels in enumerate(shared.value.levels):
                logs[j, at] = log_probabilities(levels, model.floor, own[at])
        if len(model.slices) > 1:
            vars(shared).pop("_value", None)  # one slice in memory at a time
    for j in range(len(model.langs)):
        out[:, j] = np.bincount(owner, weights=logs[j][back], minlength=texts)
    return out


def classify(model: Model, texts: list[str]) -> pd.DataFrame:
    """Language, score, cross-entropy, excess and rejection of each text.

    The excess is how far the cross-entropy lies above the language's own mean, in standard deviations of a character, less `SPREAD`
    standard errors of its length. A text is rejected without letters, or if the excess is above the language's
    reach. The score is the share of the best language among all, from their log likelihoods over 50 characters at most.
    """
    rows = []
    for part in chunks(texts, _CHUNK):
        parts = [ngram_codes(symbol_sequence(t, model.order), model.order) for t in texts[part]]
        sums = np.zeros((len(parts), len(model.langs)))
        codes, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        for at in range(0, len(codes) if model.langs else 0, _CHUNK):  # one text may be longer than a chunk
            sums += _sums(model, codes[at : at + _CHUNK], owner[at : at + _CHUNK], len(parts))
        for found, total in zip(parts, sums, strict=True):
            n = len(found)
            if not n or not model.langs:
                rows.append(("und", 0.0, None, None, True))
                continue
            entropy = -total / n
            best = int(entropy.argmin())
            share = np.exp((entropy[best] - entropy) * min(n, 50))
            above = (entropy[best] - model.mean[best]) / max(model.deviation[best], 1e-9) - SPREAD / np.sqrt(n)
            rows.append((
                model.langs[best], float(1 / share.sum()), float(entropy[best]), float(above), bool(above > model.reach[best])
            ))
    return pd.DataFrame(rows, columns=["lang_pred", "score", "cross_entropy", "excess", "rejected"])


def train(
    docs: DataFrame, order: int = ORDER, max_bytes: int = MAX_BYTES, max_counts: int = MAX_COUNTS, rate: float = RATE
) -> Model:
    """The model of (lang, text) rows; rows without either are left out.

    All rows are counted and all calibrate. For that, each half of them, by a hash of the text, is scored by a model of the
    other half: a language rejects what exceeds all but a share `rate` of its own by more than `MARGIN`, or `LEAST_REACH` if that
    is more.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    counted = staged(count_ngrams(known.select(F.concat(half.cast("string"), "lang").alias("lang"), "text"), order), "ngrams")
    lang = F.expr("substring(lang, 2)").alias("lang")
    scored = []
    for own in (0, 1):
        other = counted.where(F.col("lang").startswith(str(1 - own))).select(lang, "code", "n")
        model = _model(other, order, max_bytes, max_counts)
        found = identify(known.where(half == own), model).where("_language.lang_pred = lang")
        scored.append(staged(found.groupBy("lang", F.ceil(F.col("_language.excess") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n")), "excess"))
        for part in model.slices:
            part.unpersist()
    model = _model(staged(counted.groupBy(lang, "code").agg(F.sum("n").alias("n")), "ngrams"), order, max_bytes, max_counts)
    reach = {lang: max(LEAST_REACH, top + MARGIN) for lang, top in excess_limits(scored[0].unionByName(scored[1]), rate).items()}
    model.reach = np.array([reach.get(lang, LEAST_REACH) for lang in model.langs])
    return model


def excess_limits(bins: DataFrame, rate: float) -> dict[str, float]:
    """Of each language the lowest limit that at most a share `rate` of its texts exceeds, from (lang, bin, n)."""
    own = Window.partitionBy("lang")  # a row per bin
    tallied = bins.groupBy("lang", "bin").agg(F.sum("n").alias("n")).select(
        "lang", "bin", F.sum("n").over(own.orderBy(F.desc("bin"))).alias("reaching"), F.sum("n").over(own).alias("all")
    )
    found = tallied.where(F.col("reaching") > F.col("all") * rate).groupBy("lang").agg(F.max("bin").alias("bin")).collect()
    return {r["lang"]: r["bin"] / BINS for r in found}


def _model(counts: DataFrame, order: int, max_bytes: int, max_counts: int) -> Model:
    return _model_on_driver(counts, order) if counts.count() <= max_counts else _model_by_table(counts, order, max_bytes)


def _model_on_driver(counts: DataFrame, order: int) -> Model:
    found = counts.toPandas()
    by_lang = {lang: (g["code"].to_numpy(np.int64), g["n"].to_numpy(np.int64)) for lang, g in found.groupby("lang")}
    levels, floor = fitted(by_lang, order)
    langs = sorted(levels)
    mean, deviation = np.zeros(len(langs)), np.zeros(len(langs))
    for j, lang in enumerate(langs):
        codes, n = by_lang[lang]
        bits = -log_probabilities(levels[lang], floor, codes)
        mean[j] = np.average(bits, weights=n)
        deviation[j] = np.sqrt(np.average((bits - mean[j]) ** 2, weights=n))
    whole = counts.sparkSession.sparkContext.broadcast(Slice([levels[lang] for lang in langs]))
    return Model(langs, order, floor, [whole], mean, deviation, np.ones(len(langs)))


def _model_by_table(counts: DataFrame, order: int, max_bytes: int) -> Model:
    table = staged(smoothed(counts, order), "language-model")
    floors = table.where("k = 0 AND log_p IS NOT NULL").select("lang", "log_p").collect()  # one row per language
    langs = sorted(r["lang"] for r in floors)
    bits = counts.join(table.where((F.col("k") == order) & F.col("log_p").isNotNull()), ["lang", "code"]).select("lang", "n", (-F.col("log_p")).alias("h"))
    total = F.sum("n").cast("double")
    own = {
        r["lang"]: (r["mean"], max(r["square"] - r["mean"] ** 2, 0.0) ** 0.5)
        for r in bits.groupBy("lang").agg(
            (F.sum(F.col("h") * F.col("n")) / total).alias("mean"), (F.sum(F.col("h") * F.col("h") * F.col("n")) / total).alias("square")
        ).collect()
    }
    mean, deviation = (np.array([own[lang][i] for lang in langs]) for i in (0, 1))
    return Model(langs, order, floors[0]["log_p"] if floors else 0.0, _slices(table, langs, order, max_bytes), mean, deviation, np.ones(len(langs)))


def known_language(docs: DataFrame, model: Model, **options) -> DataFrame:
    """The documents that some language takes for its own, with all their columns."""
    found = identify(wrapped(docs), model, "row.text", **options)
    return found.where("NOT _language.rejected").select("row.*")


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "_language") -> DataFrame:
    """The table with one more column, `into`: a struct of lang_pred, score, cross_entropy, excess and rejected.

    Null texts and texts without a letter are `und` with score 0 and rejected; so is everything if no language
    was learned. Whole texts are scored, however long. Repeated rows are scored one by one; a column of the table that is
    named like the new one is replaced.
    """

    @F.pandas_udf(RESULT)
    def language(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return releasing(scored)(texts)

    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield classify(model, batch.fillna("").tolist())

    return docs.withColumn(into, language(F.col(text)))
