import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import docs  # noqa: F401

from litevidence.llm import divergence

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def expected(rows, least, top):
    counts, held = defaultdict(Counter), defaultdict(Counter)
    sources = defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        counts[lang, source].update(terms(text))
        held[lang].update(set(terms(text)))
    out = []
    for lang, group in sources.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        whole = Counter()
        for s in group:
            whole.update(counts[lang, s])

        def share(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in group}, share(whole)
        for s in group:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in group if o != s]
            more = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(more)[:top])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(found)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


LONG = "averyveryveryverylongterm"
ROWS = [
    *[(f"Alpha beta gamma{'x' * (i % 20)} 1a2b é{i % 3} {LONG} {LONG[: 14 + i % 4]}", "en", f"s{i % 5}") for i in range(60)],
    *[("alpha alpha beta", "en", "s0")] * 30,
    (None, "en", "nothing"), ("", None, None), ("wort " * 50, None, "x"), ("12 34", "de", "a"), ("...", "de", "b"),
    ("only here", "fr", "one"), ("ÉÀ éà Éà", "fr", ""),
]
SCHEMA = "text string, lang string, source string"


def test_like_brute_force(spark):
    for least, top, block in ((30, 50, 200_000), (2, 3, 7), (1, 1000, 40)):
        got = divergence.audit(spark.createDataFrame(ROWS, SCHEMA).repartition(4), least, top, block_entries=block)
        assert found(got) == expected(ROWS, least, top)


def test_clashing_names_nulls_and_long_texts(docs, monkeypatch):
    monkeypatch.setattr(divergence, "_CHUNK", 500)
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert found(divergence.audit(docs, 1, 20)) == expected(rows, 1, 20)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_slices_of_terms():
    import pandas as pd

    rng = np.random.default_rng(1)
    names = [f"s{i}" for i in range(6)]
    entries = pd.DataFrame(
        [(s, f"t{t}", int(rng.integers(1, 100))) for s in names for t in range(50) if rng.random() < 0.4], columns=["source", "term", "p"]
    )
    groups = pd.DataFrame({"lang": "en", "source": names, "absent": [3, 1, 4, 1, 5, 9]})
    one, many = divergence._distances(1 << 20)(entries, groups), divergence._distances(24)(entries, groups)
    assert one.equals(many)


@settings(max_examples=50, deadline=None)
@given(
    st.lists(
        st.tuples(st.text(st.sampled_from("aAbZ é中 1\n"), max_size=60), st.integers(0, 2)), min_size=1, max_size=12
    )
)
def test_packed_counts(rows):
    texts = [t.encode().translate(divergence._TERM) for t, _ in rows]
    table = divergence.count_terms(texts, np.array([g for _, g in rows])).to_pylist()
    n, held = Counter(), Counter()
    for text, group in rows:
        n.update((group, t) for t in terms(text))
        held.update({(group, t) for t in terms(text)})
    assert {(r["group"], r["term"]): r["n"] for r in table} == n
    assert {(r["group"], r["term"]): r["docs"] for r in table} == held
    assert len(table) == len(n)
