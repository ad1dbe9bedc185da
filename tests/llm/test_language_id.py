import numpy as np
import pandas as pd
import pytest

from llm_fixtures import docs  # noqa: F401

from litevidence.llm import language_id as li
from litevidence.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
TEXTS = {"x": ["abab abba baab", "ab ba ab, aab", "bab"], "y": ["cdcd dcdc ccd", "dd cc dcd"]}


class Held:
    """In the place of a broadcast variable."""

    def __init__(self, value):
        self.value = value


def table(spark, order=3):
    rows = []
    for lang, texts in TEXTS.items():
        codes = np.concatenate([li.ngram_codes(li.symbol_sequence(t, order), order) for t in texts])
        rows += [(lang, int(c), int(n)) for c, n in zip(*np.unique(codes, return_counts=True), strict=True)]
    return li.smoothed(spark.createDataFrame(rows, "lang string, code long, n long"), order)


@pytest.fixture(scope="module")
def model(spark):
    found = table(spark).toPandas()
    floor = found[(found["k"] == 0) & found["log_p"].notna()]["log_p"].iloc[0]
    own = [li._sorted_levels(found[(found["lang"] == lang) & ((found["k"] > 0) | found["log_back"].notna())], 3) for lang in "xy"]
    return li.Model(["x", "y"], 3, floor, [Held(li.Slice(own))], np.array([1.0, 1.0]), np.array([1.0, 1.0]), np.array([1.0, 1.0]))


def brute(texts, order, alphabet):
    """Interpolated Kneser-Ney from dictionaries, as a function of context and symbol."""
    seen = []
    for t in texts:
        s = li.symbol_sequence(t, order).tolist()
        seen += [tuple(s[i : i + order]) for i in range(len(s) - order + 1)]
    counts = {order: {g: seen.count(g) for g in set(seen)}}
    for k in range(order - 1, 0, -1):
        longer = set(counts[k + 1])
        counts[k] = {g: sum(h[1:] == g for h in longer) for g in {h[1:] for h in longer}}

    def p(context, symbol, k):
        if k == 0:
            return 1 / (alphabet + 1)
        own = counts[k]
        once, twice = sum(n == 1 for n in own.values()), sum(n == 2 for n in own.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        context = context[len(context) - k + 1 :]
        total = sum(n for g, n in own.items() if g[:-1] == context)
        if not total:
            return p(context, symbol, k - 1)
        kinds = sum(g[:-1] == context for g in own)
        return max(own.get((*context, symbol), 0) - d, 0) / total + d * kinds / total * p(context, symbol, k - 1)

    return p


@pytest.mark.parametrize("order", [2, 3, 4])
def test_probabilities(spark, order):
    found = table(spark, order).toPandas()
    floor = found[(found["k"] == 0) & found["log_p"].notna()]["log_p"].iloc[0]
    symbols = sorted({int(s) for ts in TEXTS.values() for t in ts for s in li.symbol_sequence(t, order)})
    rng = np.random.default_rng(0)
    for lang in TEXTS:
        levels = li._sorted_levels(found[(found["lang"] == lang) & ((found["k"] > 0) | found["log_back"].notna())], order)
        for level in levels:
            assert (np.diff(level.grams.astype(object)) > 0).all() and (np.diff(level.contexts.astype(object)) > 0).all()
        for _ in range(100):
            gram = tuple(int(s) for s in rng.choice([*symbols, 999], order))
            code = 0
            for s in gram:
                code = (code << 10) | s
            got = li.log_probabilities(levels, floor, np.array([code]))[0]
            want = np.log(brute(TEXTS[lang], order, len(symbols))(gram[:-1], gram[-1], order))
            assert np.isclose(got, want, rtol=1e-5)


def test_symbols():
    assert li.symbol_sequence("", 3).tolist() == li.symbol_sequence("12 !?", 3).tolist() == []
    assert li.symbol_sequence("Ab  1c!", 3).tolist() == [0, 0, 97, 98, 0, 99, 0]
    assert li.symbol_sequence("--a", 2).tolist() == [0, 97]
    assert li.symbol_sequence("日本", 2)[1] >= 768


def test_classify(model):
    got = li.classify(model, ["abab", "cdc dcd", "", "12", "abab " * 300_000])
    assert got["lang_pred"].tolist() == ["x", "y", "und", "und", "x"]
    assert got["rejected"].tolist() == [False, False, True, True, False]
    assert got["score"].between(0, 1).all() and (got["score"][[2, 3]] == 0).all()
    assert li.classify(model, ["日本語の文章です。" * 50])["rejected"].all()


def test_one_text_in_pieces(model, monkeypatch):
    text = "abab cd " * 50
    whole = li.classify(model, [text, "ab", text])
    monkeypatch.setattr(li, "_CHUNK", 37)
    pd.testing.assert_frame_equal(li.classify(model, [text, "ab", text]), whole)


def corpus(spark, noise=0):
    """Three languages of unlike letters; a noisy text of random letters under the third."""
    rng = np.random.default_rng(5)
    letters = {"x": "abcde fgh", "y": "ijklm nop", "z": "qrstu vwx"}
    rows = [(lang, "".join(rng.choice(list(own), 400))) for lang, own in letters.items() for _ in range(60)]
    wild = [chr(c) for c in range(0xC0, 0x240) if chr(c).isalpha()]
    return spark.createDataFrame(rows + [("z", "".join(rng.choice(wild, 3000))) for _ in range(noise)], "lang string, text string")


def test_slices_give_the_scores_of_one_array(spark):
    rows = corpus(spark)
    one, two, many = li.train(rows), li.train(rows, max_counts=0), li.train(rows, max_counts=0, max_bytes=20_000)
    assert len(one.slices) == len(two.slices) == 1 and len(many.slices) > 5
    for a, b in zip(one.slices[0].value.levels, two.slices[0].value.levels, strict=True):
        for x, y in zip(a, b, strict=True):
            assert (x.grams == y.grams).all() and (x.contexts == y.contexts).all()
            assert np.allclose(x.log_p, y.log_p) and np.allclose(x.log_back, y.log_back)
    assert np.allclose(one.mean, two.mean) and np.allclose(one.deviation, two.deviation, rtol=1e-4) and np.isclose(one.floor, two.floor)
    got = [li.identify(rows, m).select("text", "_language.*").toPandas().sort_values("text", ignore_index=True) for m in (one, two, many)]
    pd.testing.assert_frame_equal(*got[:2], rtol=1e-4)
    pd.testing.assert_frame_equal(*got[1:])
    assert not got[0]["rejected"].any()


def test_noise_in_one_language_leaves_the_others(spark):
    """Nothing is left out of a language with very many n-grams, and no other language changes."""
    rows = corpus(spark)
    clean, noisy = li.train(rows), li.train(corpus(spark, noise=20))
    assert clean.langs == noisy.langs
    got = li.identify(rows, noisy).select("lang", "_language.*").toPandas()
    assert (got["lang"] == got["lang_pred"]).all() and not got["rejected"].any()
    kept = [len(levels[-1].grams) for levels in noisy.slices[0].value.levels]
    assert kept[2] > 10 * kept[0]


def test_rows_without_language_or_text(spark):
    rows = spark.createDataFrame([(lang, t) for lang, ts in TEXTS.items() for t in ts] + [(None, "zz"), ("z", None)], "lang string, text string")
    assert li.train(rows, order=3).langs == ["x", "y"]


def test_nothing_learned(spark, docs):
    fitted = li.train(docs.limit(0))
    got = li.identify(docs, fitted).select("doc_id", "_language.*").collect()
    assert len(got) == docs.count() and all(r.lang_pred == "und" and r.rejected and r.score == 0 for r in got)


def test_held_out(spark):
    got = QUERIES["op9_kneser_ney"](spark, SF).toPandas()
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    got = got.merge(lang, on="doc_id")
    assert len(got) == len(lang) and not got["rejected"].any()
    out = got[got["held_out"]]
    assert len(out) > 200 and (out["lang"] == out["lang_pred"]).mean() > 0.98


def test_every_document_is_counted_and_calibrates(spark, monkeypatch):
    """No text is kept from the counts, and one odd text among many moves the limit, whichever it is."""
    texts = [("x", "abcd efgh " * 30 + chr(0x3B1 + i) * 3) for i in range(24)]
    model = li.train(spark.createDataFrame(texts, "lang string, text string"))
    grams = np.unique(np.concatenate([li.ngram_codes(li.symbol_sequence(t)) for _, t in texts]))
    assert len(model.slices[0].value.levels[0][-1].grams) == len(grams)

    monkeypatch.setattr(li, "LEAST_REACH", -100.0)
    usual = [("x", "abcd efgh " * 30 + "abcd"[: i % 5] + " " * i + "e") for i in range(40)]
    plain = li.train(spark.createDataFrame(usual, "lang string, text string")).reach[0]
    for i in range(3):
        odd = usual + [("x", "hgdbca" * 50 + chr(0x3B1 + i))]
        assert li.train(spark.createDataFrame(odd, "lang string, text string")).reach[0] > plain + 0.1


def test_excess_limits_like_counting(spark):
    rng = np.random.default_rng(3)
    found = [("x", int(b), 1) for b in rng.integers(-50, 400, 3000)] + [("y", 7, 2)]
    got = li.excess_limits(spark.createDataFrame(found, "lang string, bin int, n int"), 0.01)
    own = sorted(b for lang, b, _ in found if lang == "x")
    limit = min(b for b in own if sum(c > b for c in own) <= 30)
    assert got == {"x": limit / li.BINS, "y": 7 / li.BINS}
