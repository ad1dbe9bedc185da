"""Finding test items in training text, with an inverted index of the items and block-max WAND.

The items (question and answer: the last sentence is the answer) are the indexed documents, every passage of
every training text is a query. An item is retrieved when its BM25 score for a passage reaches the item's threshold: its
score for a passage that holds all of it, less its most telling terms, as many as may be missing where the
required share of its shingles is present. So a passage that passes the verification is always retrieved. Scores are found in steps that
never miss an item above its threshold:

1. pivots: the terms of an item of least impact that together stay below the item's threshold cannot lift it
   over, so only passages with one of its other terms go on;
2. block-max: postings lie in blocks of items, each with the term's largest impact in it; a passage goes on with
   a block only if these add up to the lowest threshold of the block;
3. the items of the blocks left are scored in full.

A text of several passages may hold the parts of an item in different ones, none of which reaches the threshold.
Each such text is also looked up by shingles: of every item the rarest, so many that a text with the required share
has one of them. The score of an item found by these alone is that of all its words in the text.

Retrieved items are verified on the whole text: shared 5-word shingles of the question and of the answer.

The index is broadcast. Items beyond `MAX_INDEX_BYTES` of text are dealt into several indexes that are queried in
turn. Passages overlap by the longest item, so that every item lies whole in a passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litevidence.llm.common import mix64, releasing, staged, wrapped

K1, B = 1.2, 0.75
OVERLAP = 0.75            # of an item's shingles that must be in the text
PART_OVERLAP = 0.5        # and of those of its question and of its answer apart
SHINGLE = 5
PASSAGE_WORDS = 128       # least length of a passage
BLOCK_ITEMS = 16
MAX_INDEX_BYTES = 4 << 20  # of the texts of items; the index takes some ten times that
_BATCH_WORDS = 100_000    # searched at once: the arrays of a search take some 0.6 KB a word
FOUND = (
    "doc_id long, text_key long, item_id long, score double, threshold double, overlap double, question_overlap double, "
    "answer_overlap double"
)
_words = re.compile(r"[^\W_]+").findall
_sentences = re.compile(r"(?<=[.!?])\s+|\n+").split


@dataclass
class Index:
    item_ids: np.ndarray
    terms: dict[str, int]
    item_terms: np.ndarray      # per item, sorted distinct terms, one item after the other
    item_impacts: np.ndarray    # BM25 impact of each of them
    item_bounds: np.ndarray
    thresholds: np.ndarray      # per item
    pivot_bounds: np.ndarray    # postings of each term's pivots
    pivot_blocks: np.ndarray
    max_bounds: np.ndarray      # postings of block maxima of each term
    max_blocks: np.ndarray
    max_impacts: np.ndarray
    block_thresholds: np.ndarray
    post_bounds: np.ndarray     # postings of each term
    post_items: np.ndarray
    post_impacts: np.ndarray
    shingles: list[tuple[np.ndarray, np.ndarray]]   # of question and answer
    lengths: np.ndarray         # words of each item
    block_items: int
    longest: int
    probes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]   # by length of shingles: codes, bounds, items


def shingle_codes(ids: np.ndarray, size: int = SHINGLE, stride: int = 1) -> np.ndarray:
    """64-bit codes of the runs of `size` words from every `stride`-th on; runs with a word outside of the index have none."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    runs = -(-n // stride)
    codes, known = np.zeros(runs, dtype=np.uint64), np.ones(runs, dtype=bool)
    for k in range(size):
        part = ids[k : k + n : stride]
        codes = mix64(codes * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1))
        known &= part >= 0
    return codes[known]


def _probes(shingles: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray, overlap: float) -> dict:
    """Of each item the rarest shingles, one more than may be missing, as postings of items."""
    out = {}
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        n = np.array([len(shingles[i][0]) + len(shingles[i][1]) for i in own])
        flat, of = np.concatenate([np.concatenate(shingles[i]) for i in own]), np.repeat(np.arange(len(own)), n)
        _, at, held = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.lexsort((flat, -held[at], of))
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        need = np.maximum(np.ceil(overlap * n - 1e-9), 1)
        kept = order[rank >= need[of] - 1]
        kept = kept[np.argsort(flat[kept], kind="stable")]
        codes, first = np.unique(flat[kept], return_index=True)
        out[size] = (codes, np.r_[first, len(kept)], own[of[kept]])
    return out


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer, which is the last sentence."""
    parts = [w for w in (_words(s.lower()) for s in _sentences(text.strip())) if w]
    if not parts:
        return [], []
    return [w for p in parts[:-1] for w in p], parts[-1]


def _postings(terms: np.ndarray, blocks: np.ndarray, n_terms: int, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((blocks, terms))
    return np.searchsorted(terms[order], np.arange(n_terms + 1)), blocks[order], *(v[order] for v in values)


def _threshold(impacts: np.ndarray, words: int, overlap: float) -> float:
    """The least score of a passage with the required share of an item's shingles: a missing word lacks one at least."""
    shingles = words - min(SHINGLE, words) + 1
    missing = shingles - int(np.ceil(overlap * shingles - 1e-9))
    return float(np.sort(impacts)[: len(impacts) - missing].sum())


def build_index(items: list[tuple[int, str]], overlap: float = OVERLAP, block_items: int = BLOCK_ITEMS) -> Index | None:
    """Items without words are left out; None if there is no other."""
    split = [(i, *split_item(t or "")) for i, t in items]
    split = [x for x in split if x[1] or x[2]]
    if not split:
        return None
    # Items of like length share a block, so that a block's lowest threshold is near those of its items.
    split.sort(key=lambda x: (len(x[1]) + len(x[2]), x[0]))
    terms: dict[str, int] = {}
    ids = [np.array([terms.setdefault(w, len(terms)) for w in [*q, *a]], dtype=np.int64) for _, q, a in split]
    counted = [np.unique(x, return_counts=True) for x in ids]
    held = np.bincount(np.concatenate([t for t, _ in counted]), minlength=len(terms))
    idf = np.log1p((len(ids) - held + 0.5) / (held + 0.5))
    mean = np.mean([len(x) for x in ids])
    impacts = [idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(x) / mean)) for (t, n), x in zip(counted, ids, strict=True)]
    thresholds = np.array([_threshold(s, len(x), overlap) for s, x in zip(impacts, ids, strict=True)])
    block = np.arange(len(ids)) // block_items
    flat_terms, flat_impacts = np.concatenate([t for t, _ in counted]), np.concatenate(impacts)
    flat_blocks = np.repeat(block, [len(s) for s in impacts])
    pivots = []
    for s, least in zip(impacts, thresholds, strict=True):
        order = np.argsort(s, kind="stable")
        chosen = np.ones(len(s), dtype=bool)
        chosen[order[np.cumsum(s[order]) < least * (1 - 1e-9)]] = False
        pivots.append(chosen)
    chosen = np.concatenate(pivots)
    keys = np.unique(np.stack([flat_terms[chosen], flat_blocks[chosen]]), axis=1)
    pivot_bounds, pivot_blocks = _postings(keys[0], keys[1], len(terms))
    pairs, at = np.unique(np.stack([flat_terms, flat_blocks]), axis=1, return_inverse=True)
    most = np.zeros(pairs.shape[1])
    np.maximum.at(most, at.ravel(), flat_impacts)
    max_bounds, max_blocks, max_impacts = _postings(pairs[0], pairs[1], len(terms), most)
    post_bounds, post_items, post_impacts = _postings(
        flat_terms, np.repeat(np.arange(len(ids)), [len(s) for s in impacts]), len(terms), flat_impacts
    )
    shingles = []
    for (_, q, _a), x in zip(split, ids, strict=True):
        size = min(SHINGLE, len(x))
        codes = shingle_codes(x, size)
        cut = max(0, len(q) - size + 1)   # shingles from here on touch the answer
        shingles.append((np.unique(codes[:cut]), np.unique(codes[cut:])))
    return Index(
        np.array([x[0] for x in split]), terms, flat_terms, flat_impacts,
        np.r_[0, np.cumsum([len(s) for s in impacts])], thresholds, pivot_bounds, pivot_blocks, max_bounds, max_blocks,
        max_impacts, np.minimum.reduceat(thresholds, np.arange(0, len(ids), block_items)), post_bounds, post_items, post_impacts, shingles,
        np.array([len(x) for x in ids]), block_items, max(len(x) for x in ids),
        _probes(shingles, np.array([min(SHINGLE, len(x)) for x in ids]), overlap),
    )


def _spread(bounds: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all postings of some terms, and which of the terms each comes from."""
    n = bounds[terms + 1] - bounds[terms]
    of = np.repeat(np.arange(len(terms)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + bounds[terms][of], of


def retrieve(index: Index, ids: np.ndarray, owner: np.ndarray, length: int, stride: int) -> pd.DataFrame:
    """Items whose score for a passage reaches their threshold: the owner of the words, item and best score.

    `ids` are the term of each word (-1: none) of some texts one after the other, `owner` their texts.
    """
    known = np.flatnonzero(ids >= 0)
    counts = np.bincount(owner, minlength=1)
    place = known - (np.cumsum(counts) - counts)[owner[known]]
    # Passage p of a text holds its words from p * stride, so a word is in each of the last length / stride ones.
    last = place // stride
    span = -(-length // stride)
    back = np.arange(span)
    passage = last[:, None] - back[None, :]
    inside = (passage >= 0) & (place[:, None] < passage * stride + length)
    which = np.nonzero(inside)
    key = (owner[known][which[0]] << 32) | passage[inside]
    passages, key = np.unique(key, return_inverse=True)
    n_terms = len(index.terms)
    pairs = np.unique(key * n_terms + ids[known][which[0]])
    key, term = pairs // n_terms, pairs % n_terms
    n_blocks = len(index.block_thresholds)
    at, of = _spread(index.pivot_bounds, term)
    live = np.unique(key[of] * n_blocks + index.pivot_blocks[at])
    if not len(live):
        return pd.DataFrame({"owner": [], "item": [], "score": []})
    keep = np.isin(key, live // n_blocks)
    key, term = key[keep], term[keep]
    at, of = _spread(index.max_bounds, term)
    place = key[of] * n_blocks + index.max_blocks[at]
    slot = np.searchsorted(live, place)
    slot[slot == len(live)] = 0
    hit = live[slot] == place
    bound = np.bincount(slot[hit], weights=index.max_impacts[at][hit], minlength=len(live))
    live = live[bound >= index.block_thresholds[live % n_blocks] * (1 - 1e-9)]
    if not len(live):
        return pd.DataFrame({"owner": [], "item": [], "score": []})
    keep = np.isin(key, live // n_blocks)
    key, term = key[keep], term[keep]
    at, of = _spread(index.post_bounds, term)
    item = index.post_items[at]
    place = key[of] * n_blocks + item // index.block_items
    slot = np.searchsorted(live, place)
    slot[slot == len(live)] = 0
    hit = live[slot] == place
    pairs, at_pair = np.unique(key[of][hit] * len(index.item_ids) + item[hit], return_inverse=True)
    score = np.bincount(at_pair, weights=index.post_impacts[at][hit], minlength=len(pairs))
    passage, item = pairs // len(index.item_ids), pairs % len(index.item_ids)
    good = score >= index.thresholds[item] * (1 - 1e-9)
    found = pd.DataFrame({"owner": passages[passage[good]] >> 32, "item": item[good], "score": score[good]})
    return found.groupby(["owner", "item"], as_index=False)["score"].max()


def scattered(index: Index, ids: np.ndarray, owner: np.ndarray, length: int) -> pd.DataFrame:
    """Owner and item for texts of more than one passage that hold one of an item's probes."""
    several = np.bincount(owner, minlength=1)[owner] > length if len(owner) else np.zeros(0, dtype=bool)
    ids, owner = ids[several], owner[several]
    pairs = [np.zeros(0, dtype=np.int64)]
    for size, (codes, bounds, items) in index.probes.items():
        n = len(ids) - size + 1
        if n <= 0:
            continue
        whole = owner[:n] == owner[size - 1 :]
        for k in range(size):
            whole &= ids[k : k + n] >= 0
        start = np.flatnonzero(whole)
        found = shingle_codes(ids[(start[:, None] + np.arange(size)).ravel()], size, size)
        at = np.searchsorted(codes, found)
        at[at == len(codes)] = 0
        hit = codes[at] == found
        keys = np.unique(owner[start[hit]] * len(codes) + at[hit])
        place, of = _spread(bounds, keys % len(codes))
        pairs.append((keys // len(codes))[of] * len(index.item_ids) + items[place])
    both = np.unique(np.concatenate(pairs))
    return pd.DataFrame({"owner": both // len(index.item_ids), "item": both % len(index.item_ids)})


def _search(index: Index, batch: pd.DataFrame, overlap: float, part_overlap: float) -> Iterator[pd.DataFrame]:
    length = max(PASSAGE_WORDS, 2 * index.longest)
    stride = length - index.longest
    lookup = index.terms.get
    held: list[tuple[tuple[int, int], np.ndarray]] = []

    def searched() -> pd.DataFrame:
        ids = np.concatenate([x for _, x in held])
        owner = np.repeat(np.arange(len(held)), [len(x) for _, x in held])
        rows = []
        near = retrieve(index, ids, owner, length, stride)
        # Rows of the second have no score; those of a pair in both are behind the first's.
        both = pd.concat([near.astype({"owner": "int64", "item": "int64"}), scattered(index, ids, owner, length)])
        for _, found in both.drop_duplicates(["owner", "item"]).groupby("owner"):
            key, own = held[int(found["owner"].iloc[0])]
            codes: dict[int, np.ndarray] = {}
            for item, score in zip(found["item"].astype(int), found["score"], strict=True):
                question, answer = index.shingles[item]
                size = min(SHINGLE, int(index.lengths[item]))
                if size not in codes:
                    codes[size] = np.unique(shingle_codes(own, size))
                q, a = (int(np.isin(x, codes[size]).sum()) for x in (question, answer))
                share = (q + a) / (len(question) + len(answer))
                if share >= overlap and q >= part_overlap * len(question) and a >= part_overlap * len(answer):
                    if np.isnan(score):
                        terms = slice(index.item_bounds[item], index.item_bounds[item + 1])
                        score = float(index.item_impacts[terms][np.isin(index.item_terms[terms], own)].sum())
                    rows.append((
                        *key, int(index.item_ids[item]), score, float(index.thresholds[item]), share,
                        q / len(question) if len(question) else None, a / len(answer) if len(answer) else None,
                    ))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")]).astype({"doc_id": "Int64"})

    size = 0
    for doc_id, text_key, text in zip(batch["doc_id"], batch["text_key"], batch["text"], strict=True):
        words = _words(text.lower())
        ids = np.fromiter(map(lookup, words, repeat(-1)), dtype=np.int64, count=len(words))
        held.append(((doc_id, text_key), ids))
        size += len(ids)
        if size >= _BATCH_WORDS:
            yield searched()
            held, size = [], 0
    if held:
        yield searched()
        held = []


def text_key(text) -> Column:
    """With the doc_id, what a verdict on a row belongs to: rows that agree in both are judged alike."""
    return F.xxhash64(text)


def _found(docs: DataFrame, items: DataFrame, overlap: float, part_overlap: float, max_index_bytes: int) -> DataFrame:
    texts = docs.select("doc_id", text_key("text").alias("text_key"), "text").where("text IS NOT NULL")
    asked = items.select("item_id", "text").where("text IS NOT NULL")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // max_index_bytes))
    shared = []
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        index = build_index([(r[0], r[1]) for r in own.collect()], overlap)  # at most about max_index_bytes
        if index is not None:
            shared.append(docs.sparkSession.sparkContext.broadcast(index))
            del index

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one in shared:
                yield from _search(one.value, batch, overlap, part_overlap)
                if len(shared) > 1:
                    vars(one).pop("_value", None)  # one index in memory at a time

    return texts.mapInPandas(releasing(search), FOUND) if shared else docs.sparkSession.createDataFrame([], FOUND)


def find_items(
    docs: DataFrame,
    items: DataFrame,
    overlap: float = OVERLAP,
    part_overlap: float = PART_OVERLAP,
    max_index_bytes: int = MAX_INDEX_BYTES,
) -> DataFrame:
    """Test items found in training texts: doc_id, item_id, score, threshold, overlap, question_overlap, answer_overlap.

    Takes documents (doc_id, text) and items (item_id, text); other columns are not read. A row for each pair of
    which the text holds at least `overlap` of the item's shingles, and at least `part_overlap` of those of its question and of its
    answer (the last sentence), where there are such; a clean document has none. Case and signs
    do not count. Null and empty texts hold no item, items without words are in no text, and an empty table on either
    side gives no rows. Rows that repeat are searched one by one. Items of more than `max_index_bytes` of text make several indexes,
    which tasks load one after the other for each batch of texts; a single item is never split, however long.
    """
    return _found(docs, items, overlap, part_overlap, max_index_bytes).drop("text_key")


def without_items(
    docs: DataFrame, items: DataFrame, overlap: float = OVERLAP, part_overlap: float = PART_OVERLAP, max_index_bytes: int = MAX_INDEX_BYTES
) -> DataFrame:
    """The documents in which no item is found, with all their columns.

    Each row is judged by its own text: others with the same doc_id, or without one, stay.
    """
    found = _found(docs, items, overlap, part_overlap, max_index_bytes).select("doc_id", "text_key").distinct()
    found = staged(found, "rows-with-items")  # its size is known then, and texts need no shuffle if it is small
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (text_key("row.text") == F.col("text_key"))
    return wrapped(docs).join(found, same, "left_anti").select("row.*")
