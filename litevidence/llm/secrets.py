"""Secrets in text, with built-in expressions only.

Three patterns find the base kinds. Beyond them, candidate strings are judged by their Shannon entropy in a sliding window: the
window's character counts are carried along a string and changed by the character that enters and the one that leaves, and
the largest entropy of any window is held against a threshold for the string's character class. Strings on the
allow-list and strings that overlap a base match are not reported.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litevidence.llm.common import text_or_empty

# Kind, pattern, group whose length counts, and its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),   # the runs of [0-9a-f]+ that are long enough
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
PART = r"[A-Za-z0-9+_-]{20,}"      # of a candidate that is none as a whole: a name, a path and a key may be glued together
WINDOW = 20
# Character class: name, pattern of the whole string, least entropy in bits of some window.
CLASSES = (
    ("entropy_hex", r"^[0-9a-fA-F]+$", 3.0),
    ("entropy_alnum", r"^[A-Za-z0-9]+$", 3.9),
    ("entropy_base64", r"^[A-Za-z0-9+/=]+$", 3.9),
    ("entropy_token", r"^[A-Za-z0-9+/_=-]+$", 3.9),
)
ALLOW = (
    r"(?i)example|placeholder|changeme|dummy|sample|redacted|your[_-]|x{4,}|0{8,}|1{8,}",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)abcdefgh|12345678|qwertyui",
    r"^[0-9-]+$",
)
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost matches that do not overlap: (start, end, part), in code points, end exclusive."""
    empty = F.array().cast("array<struct<start:int,end:int,part:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    rows = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("whole"), part.alias("part"))

    def step(held: Column, row: Column) -> Column:
        start = held["at"] + F.length(row["gap"])
        end = start + F.length(row["whole"])
        one = F.struct(start.alias("start"), end.alias("end"), row["part"].alias("part"))
        return F.struct(end.alias("at"), F.concat(held["out"], F.array(one)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    listed = F.aggregate(rows, start, step, lambda held: held["out"])
    return F.when(text.rlike(pattern), listed).otherwise(empty)


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The largest entropy of any window of a string, in bits; 0 for a string shorter than a window."""
    share = F.array(*[F.lit(0.0 if c < 2 else c * log2(c)) for c in range(window + 2)])
    letters = F.split(text, "")
    code = F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.instr(F.lit(_ALPHABET), c))

    def step(held: Column, i: Column) -> Column:
        come = F.element_at(held["codes"], i)
        gone = F.when(i > window, F.element_at(held["codes"], F.greatest(F.lit(1), i - window))).otherwise(F.lit(-1))
        counts = held["counts"]
        # counts are from place 1, which stands for characters outside of the alphabet
        up = F.element_at(counts, come + 1)
        added = held["sum"] + F.element_at(share, up + 2) - F.element_at(share, up + 1)
        counts = F.transform(counts, lambda n, k: n + F.when(k == come, 1).otherwise(0))
        down = F.when(gone >= 0, F.element_at(counts, F.greatest(F.lit(0), gone) + 1))
        total = F.when(gone >= 0, added + F.element_at(share, down) - F.element_at(share, down + 1)).otherwise(added)
        counts = F.transform(counts, lambda n, k: n - F.when(k == gone, 1).otherwise(0))
        entropy = F.when(i >= window, log2(window) - total / window).otherwise(0.0)
        return F.struct(
            held["codes"].alias("codes"), counts.alias("counts"), total.alias("sum"), F.greatest(held["best"], entropy).alias("best")
        )

    start = F.struct(
        code.alias("codes"), F.array_repeat(F.lit(0), len(_ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"),
        F.lit(0.0).alias("best"),
    )
    places = F.sequence(F.lit(1), F.length(text))
    return F.when(F.length(text) >= window, F.aggregate(places, start, step, lambda held: held["best"])).otherwise(0.0)


def _kind(part: Column, window: int, allow: tuple[str, ...]) -> Column:
    """The class whose threshold a candidate reaches; null if it reaches none, is allowed, or has only letters or digits."""
    mixed = part.rlike("[0-9]") & part.rlike("[A-Za-z]")
    for pattern in allow:
        mixed &= ~part.rlike(pattern)
    name, least = F.lit(None).cast("string"), F.lit(99.0)
    for label, pattern, bits in reversed(CLASSES):
        name = F.when(part.rlike(pattern), F.lit(label)).otherwise(name)
        least = F.when(part.rlike(pattern), F.lit(bits)).otherwise(least)
    return F.when(mixed, F.when(window_entropy(part, window) >= least, name))


def _without(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the given spans, which are in order of their start and may overlap."""

    def step(held: Column, span: Column) -> Column:
        start, end = F.greatest(held["at"], span["start"]), F.greatest(held["at"], span["end"])
        kept = F.substr(text, held["at"] + 1, start - held["at"])
        return F.struct(end.alias("at"), F.concat(held["out"], F.array(kept, F.repeat(F.lit(" "), end - start))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda held: F.concat(F.array_join(held["out"], ""), F.substr(text, held["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def find_secrets(docs: DataFrame, window: int = WINDOW, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base, found.

    `base` and `found` are arrays of (start, rank, end, kind) in order of start and kind: the base matches, and these
    together with the strings of high entropy in what is left of the text: each candidate as a whole, or else its parts between
    `=` and `/`, so that neither a base span nor an allowed name beside a key hides it. Takes any table with doc_id and text; other columns are not read. Null text counts
    as empty and has no secret; whole texts are searched. Rows that repeat give rows that repeat.
    """
    text = docs.select("doc_id", text_or_empty().alias("text"))
    for kind, pattern, group, _ in BASE:
        text = text.withColumn(f"_{kind}", matches(F.col("text"), pattern, group))

    def spans(kind: str, rank: int, least: int) -> Column:
        kept = F.filter(f"_{kind}", lambda m: F.length(m["part"]) >= least)
        return F.transform(
            kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))
        )

    kinds = [(kind, spans(kind, rank, least)) for rank, (kind, _, _, least) in enumerate(BASE)]
    based = text.select(
        "doc_id", "text", *[F.size(found).cast("long").alias(f"n_{kind}") for kind, found in kinds],
        F.array_sort(F.concat(*[found for _, found in kinds])).alias("base"),
    )
    free = based.withColumn("_more", matches(_without(F.col("text"), F.col("base")), CANDIDATE))

    def one(m: Column, start: Column) -> Column:
        return F.struct(
            (start + m["start"]).alias("start"), F.lit(len(BASE)).alias("rank"), (start + m["end"]).alias("end"),
            _kind(m["part"], window, allow).alias("kind"),
        )

    whole = free.withColumn("_judged", F.transform("_more", lambda m: F.struct(one(m, F.lit(0)).alias("span"), m.alias("match"))))

    def parts(j: Column) -> Column:
        m = j["match"]
        cut = m["part"].rlike("[/=]") & j["span"]["kind"].isNull()
        return F.when(cut, F.transform(matches(m["part"], PART), lambda x: one(x, m["start"]))).otherwise(F.array(j["span"]))

    based = whole
    judged = F.flatten(F.transform("_judged", parts))
    more = F.filter(judged, lambda m: m["kind"].isNotNull())
    return based.select(
        "doc_id", *[f"n_{kind}" for kind, _ in kinds], "base", F.array_sort(F.concat("base", more)).alias("found")
    )


def span_list(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
