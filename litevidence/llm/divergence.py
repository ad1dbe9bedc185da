"""How the sources of a language differ in their words.

Terms are counted in tasks on bytes: terms of up to 8 bytes are one unsigned 64-bit word, those of up to 16 are two;
both are radix-sorted by digits of 16 bits and equal runs are counted. Longer terms go to a bucket of their length and
are sorted as bytes. The sort is stable and documents come in order, so a run also tells in how many documents its
term occurs. Spark sums the runs of all chunks by language, source and term.

Distances between sources are sums over terms, taken block by block of terms with one row of an array per source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litevidence.llm.common import staged

LEAST_DOCS = 30            # of a language that hold a kept term
TOP_TERMS = 50             # ranks of terms that are reported
SMOOTH = 5
SCALE = 1_000_000_000
_CHUNK = 4 << 20           # bytes of text that are sorted at once
_CELLS = 1 << 21           # of an array of sources by terms
_BLOCK_ENTRIES = 200_000   # counts of a block of terms, on average
# Letters and all bytes of characters beyond ASCII are parts of terms, A-Z as a-z; all else ends one.
_TERM = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x0A for b in range(256))


def radix_order(digits: list[np.ndarray]) -> np.ndarray:
    """Stable order by digits of 16 bits, the least significant first. numpy sorts these by counting."""
    order = np.arange(len(digits[0]))
    for digit in digits:
        if len(digit) and (digit != digit[0]).any():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def _digits(values: np.ndarray) -> list[np.ndarray]:
    parts = np.ascontiguousarray(values).view("<u2").reshape(len(values), -1)
    return [parts[:, k] for k in range(parts.shape[1])]


def _packed(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: int) -> list[np.ndarray]:
    """Terms as 64-bit words, the first bytes highest, filled up with zeros; no term holds a zero byte."""
    out = []
    for w in range(words):
        word = np.zeros(len(starts), dtype=np.uint64)
        for k in range(8 * w, 8 * w + 8):
            byte = np.where(k < lengths, raw[starts + np.minimum(k, lengths - 1)], 0)
            word = (word << np.uint64(8)) | byte.astype(np.uint64)
        out.append(word)
    return out


def _runs(order: np.ndarray, keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of each run of equal keys, its length and its number of documents."""
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    doc = doc[order]
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    return order[first], np.diff(np.r_[first, len(order)]), np.add.reduceat(other.astype(np.int64), first)


def count_terms(texts: list[bytes], groups: np.ndarray) -> pa.Table:
    """Counts and numbers of documents by group and term: group, term, n, docs. Texts are as `_TERM` leaves them."""
    joined = b"\n".join([b"", *texts, b""])
    raw = np.frombuffer(joined, dtype=np.uint8)
    inside = raw != 0x0A
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, lengths = edge[0::2], edge[1::2] - edge[0::2]
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(begins, starts, side="right") - 1
    group = groups[doc].astype(np.uint32)
    chosen, counts, docs = [], [], []

    def add(at: np.ndarray, keys: list[np.ndarray], order: np.ndarray) -> None:
        row, n, held = _runs(order, [group[at], *keys], doc[at])
        chosen.append(at[row])
        counts.append(n)
        docs.append(held)

    for words, least, most in ((1, 1, 8), (2, 9, 16)):
        at = np.flatnonzero((lengths >= least) & (lengths <= most))
        if len(at):
            keys = _packed(raw, starts[at], lengths[at], words)
            digits = [d for key in reversed(keys) for d in _digits(key)] + _digits(group[at])
            add(at, keys, radix_order(digits))
    long = np.flatnonzero(lengths > 16)
    for at in np.split(by := long[np.argsort(lengths[long], kind="stable")], np.flatnonzero(np.diff(lengths[by])) + 1):
        if len(at):
            size = int(lengths[at[0]])
            key = raw[starts[at][:, None] + np.arange(size)].view(f"S{size}").ravel()
            order = np.argsort(key, kind="stable")
            add(at, [key], order[radix_order(_digits(group[at][order]))])
    empty = np.zeros(0, dtype=np.int64)
    chosen, counts, docs = (np.concatenate([empty, *x]) for x in (chosen, counts, docs))
    size = lengths[chosen]
    ends = np.cumsum(size)
    data = raw[np.repeat(starts[chosen] - (ends - size), size) + np.arange(size.sum())]
    terms = pa.Array.from_buffers(
        pa.large_string(), len(chosen), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data.tobytes())]
    )
    return pa.table({"group": pa.array(group[chosen].astype(np.int64)), "term": terms, "n": pa.array(counts), "docs": pa.array(docs)})


def _long_text(text: bytes) -> pa.Table:
    """The same for one text, piece by piece; it counts as one document of each of its terms."""
    parts, start = [], 0
    while start < len(text):
        end = text.find(b"\n", start + _CHUNK)
        end = len(text) if end < 0 else end
        parts.append(count_terms([text[start:end]], np.zeros(1, dtype=np.int64)))
        if len(parts) == 16:
            parts = [_summed(parts)]
        start = end
    return _summed(parts)


def _summed(parts: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(parts).group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "max")])
    return found.select(["group", "term", "n_sum", "docs_max"]).rename_columns(["group", "term", "n", "docs"])


_COUNTED = "lang string, source string, term string, n long, docs long"


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each chunk by language, source and term; the empty term marks a group that occurs."""
    texts: list[bytes] = []
    groups: list[int] = []
    named: dict[tuple[str, str], int] = {}
    size = 0

    def done() -> pa.RecordBatch:
        small = [i for i, t in enumerate(texts) if len(t) <= _CHUNK]
        found = [count_terms([texts[i] for i in small], np.array([groups[i] for i in small], dtype=np.int64))]
        for i, text in enumerate(texts):
            if len(text) > _CHUNK:
                part = _long_text(text)
                found.append(part.set_column(0, "group", pa.array(np.full(part.num_rows, groups[i], dtype=np.int64))))
        marks = pa.table({
            "group": pa.array(np.arange(len(named))), "term": pa.array([""] * len(named), pa.large_string()),
            "n": pa.array(np.zeros(len(named), np.int64)), "docs": pa.array(np.zeros(len(named), np.int64)),
        })
        table = pa.concat_tables([marks, *found]).combine_chunks()
        own = table.column("group")
        lang, source = (pa.array(x, pa.string()).take(own.combine_chunks()) for x in zip(*named, strict=True))
        return pa.RecordBatch.from_arrays(
            [lang, source, table.column("term").cast(pa.string()).combine_chunks(), table.column("n").combine_chunks(), table.column("docs").combine_chunks()],
            names=["lang", "source", "term", "n", "docs"],
        )

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            texts.append(text.as_buffer().to_pybytes().translate(_TERM))
            groups.append(named.setdefault((lang, source), len(named)))
            size += len(texts[-1])
            if size >= _CHUNK:
                yield done()
                texts, groups, named, size = [], [], {}, 0
    if texts:
        yield done()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs over all documents; the empty term stands for the group itself."""
    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    texts = docs.select(*empty, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(_tally, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count, total, kept, smooth: int):
    """1 + floor(SCALE * (count + smooth) / (total + smooth * kept)), exactly."""
    above = F.expr(f"cast(({count}) + {smooth} as decimal(20, 0)) * {SCALE}BD")
    return F.call_function("div", above, F.expr(f"cast({total} as decimal(20, 0)) + {smooth} * {kept}")) + 1


def _distances(cells: int):
    """Sums of absolute differences of each two sources over the terms of a block."""

    def distances(entries: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        columns = ["lang", "source", "item", "value"]
        if not len(groups):
            return pd.DataFrame(columns=columns)
        names = groups["source"].to_numpy()
        order = np.argsort(names, kind="stable")
        names, absent = names[order], groups["absent"].to_numpy(dtype=np.int64)[order]
        total = np.zeros((len(names), len(names)), dtype=np.int64)
        at = np.searchsorted(names, entries["source"].to_numpy()) if len(entries) else np.zeros(0, dtype=np.int64)
        term = pd.factorize(entries["term"])[0]
        p = entries["p"].to_numpy(dtype=np.int64)
        by = np.argsort(term, kind="stable")
        at, term, p = at[by], term[by], p[by]
        wide = max(1, cells // len(names))
        for low in range(0, int(term[-1]) + 1 if len(term) else 0, wide):
            lo, hi = np.searchsorted(term, [low, low + wide])
            held = np.repeat(absent[:, None], int(term[hi - 1]) - low + 1, axis=1)
            held[at[lo:hi], term[lo:hi] - low] = p[lo:hi]
            for i in range(len(names) - 1):
                total[i, i + 1 :] += np.abs(held[i + 1 :] - held[i]).sum(axis=1)
        i, j = np.triu_indices(len(names), 1)
        return pd.DataFrame({"lang": groups["lang"].iloc[0], "source": names[i], "item": names[j], "value": total[i, j]}, columns=columns)

    return distances


def audit(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, smooth: int = SMOOTH, block_entries: int = _BLOCK_ENTRIES
) -> DataFrame:
    """For each source of a language: its distance to every other source, and the terms it uses most above the language.

    Rows: lang, source, part (`pair` or `term`), item, value, rank. Takes any table with text, lang and source; other
    columns are not read. Nulls in the three columns count as empty. Groups without terms count; a language of one
    source has no pairs, a language without kept terms has pairs of value 0. Equal values are ranked by the item's bytes. Repeated
    rows are documents of their own; an empty table gives no rows.
    """
    counts = staged(term_counts(docs), "term-counts")
    kept = (
        counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
    ).drop("docs")
    entries = staged(counts.join(kept, ["lang", "term"]), "kept-counts")
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = entries.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("kept")
    )
    groups = staged(
        counts.where("term = ''").select("lang", "source")
        .join(own, ["lang", "source"], "left").join(whole, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "kept")]),
        "term-groups",
    )
    shares = staged(
        entries.join(groups, ["lang", "source"]).select(
            "lang", "source", "term",
            _share("n", "total", "kept", smooth).alias("p"), _share("lang_n", "lang_total", "kept", smooth).alias("q"),
        ),
        "shares",
    )
    blocks = max(1, -(-shares.count() // block_entries))
    absent = F.when(F.col("kept") > 0, _share("0", "total", "greatest(kept, 1)", smooth)).otherwise(F.lit(0))
    everywhere = groups.select("lang", "source", absent.alias("absent"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = shares.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"))
    one_way = (
        dealt.groupBy("lang", "block").cogroup(everywhere.groupBy("lang", "block"))
        .applyInPandas(_distances(_CELLS), "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )
    pairs = one_way.select(
        "lang", "value", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    ).select("lang", "x.source", "x.item", "value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair"))
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.select(*columns).unionByName(terms.select(*columns))
