"""Join of documents whose sets of word shingles are similar (Jaccard), with count-vector R-trees.

1. Shingles are hashed to 64 bits. Documents with equal sets form a class; only classes go on.
2. Shingles are dealt by ranges of their hash, which counts in how many classes each occurs. A shingle of one
   class alone cannot be shared, so a class with too few shared shingles is done here.
3. The shared shingles of a class, rarest first, have a prefix of which similar classes share at least one
   (whatever the order, as long as it is the same for all). Classes that share a prefix shingle may be similar.
4. First links: in a few rounds each class is compared with one class of another component that shares one of a
   few prefix shingles, the one with the fewest shingles of its own or a random one. Most copies are then in one
   component, and from here on classes of one component need no comparison.
5. All other links: the classes of each prefix shingle with more than one component are points in an R-tree.
   Shingles are hashed into groups and a point holds the number in each group. Leaves are packed in order of
   component and size; a leaf keeps the largest count of each group and its range of sizes. The summed minima of
   counts bound the overlap: of two leaves first, then of two points. What is left is verified on the shingles: first
   the best pairs of a point with each component in a leaf, then all pairs of components that are still apart.

Links that would only repeat a connection are not sought, so the links found span the components and the work on
a group of copies grows with its size, not with its square.

Shingles that are frequent everywhere (more than `range_shingles` occurrences) are known beforehand from counts
over all documents and go to no range; they come last in the order, so no range holds more than it can.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litevidence.llm.common import mix64, releasing, staged, wrapped
from litevidence.llm.components import connected
from litevidence.operators.skew import grid_join

WORDS = 5
NUM, DEN = 75, 100          # the similarity as a fraction
GROUPS = 256                # coordinates of a point
ROUNDS = 2                  # of first links
SHARED_TRIED = 4            # prefix shingles by which a class finds another in a round
LEAF = 64                   # points of a leaf
LEAF_PAIRS = 1 << 20        # pairs of leaves of one shingle that one task may meet
RANGE_SHINGLES = 1_000_000  # occurrences of shingles in a range, on average
FREQUENT_IN_CHUNK = 4       # occurrences in a chunk from which a shingle is counted on its own
_CHUNK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=2)
def _kept_powers(base: int) -> np.ndarray:
    out = np.full(_CHUNK_BYTES * 5 // 4, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """The powers 0 to n - 1; those for a chunk are computed once in a process."""
    kept = _kept_powers(int(base))
    if n <= len(kept):
        return kept[:n]
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    joined = b"\n".join(texts).translate(_LOWER)
    raw = np.frombuffer(joined + b"\n", dtype=np.uint8)
    blank = _BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.r_[0, edge]
    starts, ends = edge[0::2], edge[1::2]
    # Polynomial hash of each word from running sums, moved to a common origin.
    total = np.cumsum(_BYTE[raw] * _powers(len(raw), _BASE), dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    word = mix64((total[ends - 1] - before) * _powers(len(raw), _INVERSE)[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    n = len(word) - words + 1
    code = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(words if n > 0 else 0):
        code = mix64(code * _ODD + word[k : k + n])
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= words:
            out.append(np.unique(code[lo : hi - words + 1]))
        elif hi > lo:
            one = np.array([hi - lo], dtype=np.uint64)
            for w in range(lo, hi):
                one = mix64(one * _ODD + word[w : w + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """doc_ids with text keys and shingle sets, about a megabyte of text at a time."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            keys.append(key)
            texts.append(raw)
            size += len(raw)
            if size >= _CHUNK_BYTES:
                yield keys, shingle_sets(texts)
                keys, texts, size = [], [], 0
    if keys:
        yield keys, shingle_sets(texts)


def _prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set that do not depend on the order of its members."""
    with np.errstate(over="ignore"):
        a = [mix64(s ^ _ODD).sum(dtype=np.uint64) for s in sets]
        b = [mix64(s + _BASE).sum(dtype=np.uint64) for s in sets]
    return np.array(a, dtype=np.uint64).view(np.int64), np.array(b, dtype=np.uint64).view(np.int64)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and print of each document's set, and counts of shingles frequent in a chunk."""
    for keys, sets in _chunks(batches):
        a, b = _prints(sets)
        n = np.array([len(s) for s in sets], dtype=np.int64)
        token, times = np.unique(np.concatenate(sets), return_counts=True)
        token, times = token[times >= FREQUENT_IN_CHUNK], times[times >= FREQUENT_IN_CHUNK]
        m, k = len(keys), len(token)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _ in keys] + [None] * k, pa.int64()), pa.array([t for _, t in keys] + [None] * k, pa.int64()), pa.array(np.r_[n, np.zeros(k, np.int64)]),
                pa.array(np.r_[a, np.zeros(k, np.int64)]), pa.array(np.r_[b, np.zeros(k, np.int64)]),
                pa.array(np.r_[np.zeros(m, np.int64), token.view(np.int64)]), pa.array(np.r_[np.zeros(m, np.int64), times]),
            ],
            names=["doc_id", "text_key", "n", "a", "b", "token", "times"],
        )


def _ranges(sets: list[np.ndarray], n_ranges: int, frequent: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Range, set and shingle of all occurrences, a range at a time; frequent shingles in ranges of their own."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token = np.concatenate(sets)
    at = ((token >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
    if len(frequent):
        place = np.searchsorted(frequent, token)
        place[place == len(frequent)] = 0
        spread = (owner.astype(np.uint64) * _ODD >> np.uint64(32)).astype(np.int64) % n_ranges
        at = np.where(frequent[place] == token, n_ranges + spread, at)
    order = np.argsort(at, kind="stable")
    at, owner, token = at[order], owner[order], token[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
    for lo, hi in zip(first, [*first[1:], len(at)], strict=True):
        yield int(at[lo]), owner[lo:hi], token[lo:hi]


_POSTED = "part long, a array<long>, b array<long>, n array<long>, held array<long>, tokens array<long>"


def _posted(n_ranges: int, frequent) -> callable:
    """Occurrences of shingles by range: the sets of a chunk, how many shingles of each, the shingles."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _chunks(batches):
            a, b = _prints(sets)
            # Copies within a chunk are one set.
            first = np.unique(np.stack([a, b]), axis=1, return_index=True)[1]
            first = [i for i in sorted(first) if len(sets[i])]
            if not first:
                continue
            sets, a, b = [sets[i] for i in first], a[first], b[first]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            rows = []
            for part, owner, token in _ranges(sets, n_ranges, frequent.value):
                own, held = np.unique(owner, return_counts=True)
                rows.append((part, a[own], b[own], n[own], held, token.view(np.int64)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), *(pa.array(list(c), pa.list_(pa.int64())) for c in columns[1:])],
                names=["part", "a", "b", "n", "held", "tokens"],
            )

    return post


_SHARED = (
    "part long, a array<long>, b array<long>, n array<long>, held array<long>, tokens array<long>, counts array<int>"
)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(name).chunks])


def _classes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each row by its print, and a row of each class."""
    order = np.lexsort((b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(a) else np.zeros(0, dtype=bool)
    cls = np.empty(len(a), dtype=np.int64)
    cls[order] = np.cumsum(new) - 1
    return cls, order[new]


def _listed(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), pa.array(values))


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)


def _counted(n_ranges: int) -> callable:
    """The shingles of a range that occur in two classes or more, with that number, by class; classes by part."""

    def count(table: pa.Table) -> pa.Table:
        a, b, n, held = (_flat(table, c) for c in ("a", "b", "n", "held"))
        token = _flat(table, "tokens").view(np.uint64)
        cls, first = _classes(a, b)
        own = np.repeat(cls, held)
        order = np.lexsort((own, token))
        token, own = token[order], own[order]
        once = np.r_[True, (token[1:] != token[:-1]) | (own[1:] != own[:-1])]
        token, own = token[once], own[once]
        start = _starts(token)
        times = np.diff(np.r_[start, len(token)])
        run = np.repeat(times, times)
        if table.column("part")[0].as_py() >= n_ranges:  # frequent everywhere, so last in the order
            run = np.full(len(token), np.iinfo(np.int32).max)
        token, own, run = token[run > 1], own[run > 1], run[run > 1]
        part = ((a[first].view(np.uint64) >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((own, part[own]))
        token, own, run = token[order], own[order], run[order]
        of_class = _starts(own)
        classes = first[own[of_class]]
        parts = part[own[of_class]]
        rows = _starts(parts)
        return pa.table({
            "part": parts[rows], "a": _listed(a[classes], rows), "b": _listed(b[classes], rows), "n": _listed(n[classes], rows),
            "held": _listed(np.diff(np.r_[of_class, len(own)]), rows), "tokens": _listed(token.view(np.int64), of_class[rows]),
            "counts": _listed(run.astype(np.int32), of_class[rows]),
        })

    return count


_POINT = "a long, b long, n long, tokens array<long>, prefix array<long>, point binary"
_FULL = 0xFFFF              # in a point: so many or more


def _points(num: int, den: int) -> callable:
    """Classes of a part that may be similar to another: shared shingles, prefix and count vector."""

    def point(table: pa.Table) -> pa.Table:
        a, b, n, held = (_flat(table, c) for c in ("a", "b", "n", "held"))
        cls, first = _classes(a, b)
        own = np.repeat(cls, held)
        token, count = _flat(table, "tokens").view(np.uint64), _flat(table, "counts")
        order = np.lexsort((token, own))
        own, token, count = own[order], token[order], count[order]
        # A frequent shingle comes once from each chunk that holds the class.
        once = np.r_[True, (token[1:] != token[:-1]) | (own[1:] != own[:-1])] if len(own) else np.zeros(0, dtype=bool)
        own, token, count = own[once], token[once], count[once]
        start = _starts(own)
        rows = []
        for c, lo, hi in zip(own[start], start, np.r_[start[1:], len(own)], strict=True):
            size = int(n[first[c]])
            least = -(-num * size // den)
            prefix = size - least + 1 - (size - (hi - lo))  # shingles of one class come first in the order
            if prefix <= 0:
                continue
            held_by, times = token[lo:hi], count[lo:hi]
            rarest = held_by[np.lexsort((held_by, times))[:prefix]]
            groups = np.bincount((held_by >> np.uint64(7)).astype(np.int64) % GROUPS, minlength=GROUPS)
            rows.append((
                a[first[c]], b[first[c]], size, held_by.view(np.int64), rarest.view(np.int64),
                np.minimum(groups, _FULL).astype("<u2").tobytes(),
            ))
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        names = [c.split()[0] for c in _POINT.split(", ")]
        return pa.table({k: pa.array(list(c), kind) for k, c, kind in zip(names, columns, kinds, strict=True)})

    return point


def _verified(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) that are similar, by their shared shingles."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, nx, ny, tx, ty = (batch.column(i) for i in range(6))
            good = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                one, two = tx[i].values.to_numpy(), ty[i].values.to_numpy()
                both = len(np.intersect1d(one, two, assume_unique=True))
                good[i] = den * both >= num * (nx[i].as_py() + ny[i].as_py() - both)
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(good)), y.filter(pa.array(good))], names=["x", "y"])

    left = points.select(F.col("v").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
    right = points.select(F.col("v").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
    joined = pairs.join(left, "x").join(right, "y").select("x", "y", "nx", "ny", "tx", "ty")
    return joined.mapInArrow(releasing(verify), "x long, y long")


def _round_pairs(points: DataFrame, labels: DataFrame, seed: int, num: int, den: int) -> DataFrame:
    """Each class with one class of another component: the head of the classes with one of its shingles."""
    order = F.array_sort(F.transform("prefix", lambda t: F.struct(F.xxhash64(t, F.lit(seed)).alias("h"), t.alias("t"))))
    entry = (
        points.select("v", "n", F.size("tokens").alias("m"), F.explode(F.slice(order, 1, SHARED_TRIED)).alias("s"))
        .select("v", "n", "m", F.col("s.t").alias("token"))
        .join(labels, "v")
    )
    # Copies with few shingles of their own are close to most others; every other round takes a random one.
    rank = F.col("m") / F.col("n") if seed % 2 else F.lit(0.0)
    head = entry.groupBy("token").agg(
        F.max(F.struct(rank.alias("rank"), F.xxhash64("v", F.lit(seed)).alias("h"), "v", "n", "root")).alias("head")
    )
    return (
        entry.join(head, "token")
        .where(F.col("root") != F.col("head.root"))
        .where((F.col("head.n") * den >= F.col("n") * num) & (F.col("n") * den >= F.col("head.n") * num))
        .groupBy(F.col("v").alias("x"))
        .agg(F.max("head").alias("head"))
        .select("x", F.col("head.v").alias("y"))
    )


def _hooked(labels: DataFrame, links: DataFrame, passes: int = 2) -> DataFrame:
    """Labels (v, root) after linked components have taken the smaller of their roots, all their classes at once.

    Two passes join a star. Labels that lag behind cost comparisons, no links.
    """
    for _ in range(passes):
        ends = links.join(labels.toDF("x", "rx"), "x").join(labels.toDF("y", "ry"), "y").where("rx != ry")
        hooks = ends.select(F.greatest("rx", "ry").alias("root"), F.least("rx", "ry").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
        labels = staged(labels.join(hooks, "root", "left").select("v", F.coalesce("to", "root").alias("root")), "labels")
    return labels


def _first_links(points: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Labels of classes by the links found in some rounds, and these links."""
    labels = points.select("v", F.col("v").alias("root"))
    tried = links = None
    for seed in range(1, ROUNDS + 1):
        pairs = _round_pairs(points, labels, seed, num, den)
        if tried is not None:
            pairs = pairs.join(tried, ["x", "y"], "left_anti")
        pairs = staged(pairs, "round-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = staged(_verified(pairs, points, num, den), "round-links")
        links = found if links is None else links.unionByName(found)
        labels = _hooked(labels, found)
    return labels, links


_LEAF_ROW = (
    "token long, leaf long, n_low long, n_high long, root_low long, root_high long, top array<int>, "
    "v array<long>, n array<long>, root array<long>, points binary"
)


def _counts_of(points: bytes) -> np.ndarray:
    """Points as rows of counts; one that may be larger than written counts as larger than any other."""
    counts = np.frombuffer(points, dtype="<u2").reshape(-1, GROUPS).astype(np.int32)
    counts[counts == _FULL] = (1 << 31) // GROUPS - 1
    return counts


def _leaves(leaf: int) -> callable:
    """Packs rows in order into leaves of one token each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            token, v, n, root = (batch.column(i).to_numpy() for i in range(4))
            points = batch.column(4).to_pylist()
            new = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            place = np.arange(len(token)) - np.repeat(new, np.diff(np.r_[new, len(token)]))
            start = np.flatnonzero(place % leaf == 0)
            stop = np.r_[start[1:], len(token)]
            lists = pa.array(np.r_[start, len(token)].astype(np.int32))
            top = np.maximum.reduceat(_counts_of(b"".join(points)), start, axis=0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(token[start]), pa.array(made + np.arange(len(start))),
                    pa.array(np.minimum.reduceat(n, start)), pa.array(np.maximum.reduceat(n, start)),
                    pa.array(np.minimum.reduceat(root, start)), pa.array(np.maximum.reduceat(root, start)),
                    pa.ListArray.from_arrays(
                        pa.array((np.arange(len(start) + 1) * GROUPS).astype(np.int32)),
                        pa.array(top.ravel()),
                    ),
                    pa.ListArray.from_arrays(lists, pa.array(v)), pa.ListArray.from_arrays(lists, pa.array(n)),
                    pa.ListArray.from_arrays(lists, pa.array(root)),
                    pa.array([b"".join(points[lo:hi]) for lo, hi in zip(start, stop, strict=True)], pa.binary()),
                ],
                names=[c.split()[0] for c in _LEAF_ROW.split(", ")],
            )
            made += len(stop)

    return pack


def _other_pairs(points: DataFrame, num: int, den: int, leaf: int, leaf_pairs: int, best: bool) -> DataFrame:
    """Pairs of different components that share a prefix shingle and whose counts allow the similarity.

    With `best`, of a point and the points of one component in a leaf only the pair with the highest bound. The leaves of a
    shingle that very many classes share meet in cells of at most `leaf_pairs` pairs.
    """
    entry = points.select(F.explode("prefix").alias("token"), "v", "root")
    mixed = entry.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    entry = entry.join(mixed.select("token"), "token").select("token", "v")
    entry = staged(entry.join(points.select("v", "n", "root", "point"), "v").select("token", "v", "n", "root", "point"), "entries")
    order = ["token", "root", "n", "v"]
    leaves = staged(
        entry.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(releasing(_leaves(leaf)), _LEAF_ROW), "leaves"
    )
    one = leaves.select("token", *[F.col(c).alias(f"{c}_1") for c in leaves.columns if c != "token"])
    two = leaves.select("token", *[F.col(c).alias(f"{c}_2") for c in leaves.columns if c != "token"])
    overlap = F.aggregate(F.zip_with("top_1", "top_2", lambda a, b: F.least(a, b)), F.lit(0), lambda s, x: s + x)
    met = grid_join([one, two], ["token"], "inner", leaf_pairs).where(
        (F.col("leaf_1") <= F.col("leaf_2"))
        & (F.least("root_low_1", "root_low_2") < F.greatest("root_high_1", "root_high_2"))
        & (F.col("n_high_1") * den >= F.col("n_low_2") * num)
        & (F.col("n_high_2") * den >= F.col("n_low_1") * num)
        & (overlap * (num + den) >= (F.col("n_low_1") + F.col("n_low_2")) * num)
    )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                v1, n1, r1, v2, n2, r2 = (batch.column(i)[row].values.to_numpy() for i in (0, 1, 2, 4, 5, 6))
                p1, p2 = (_counts_of(batch.column(i)[row].as_py()) for i in (3, 7))
                bound = np.stack([np.minimum(p, p2).sum(axis=1, dtype=np.int64) for p in p1])
                size = n1[:, None] + n2[None, :]
                good = bound * (num + den) >= size * num
                good &= (n1[:, None] * den >= n2[None, :] * num) & (n2[None, :] * den >= n1[:, None] * num)
                good &= r1[:, None] != r2[None, :]
                i, j = np.nonzero(good)
                if best and len(i):
                    order = np.lexsort((-bound[i, j] / size[i, j], r2[j], i))
                    i, j = i[order], j[order]
                    first = np.r_[True, (i[1:] != i[:-1]) | (r2[j][1:] != r2[j][:-1])]
                    i, j = i[first], j[first]
                found.append(np.stack([np.minimum(v1[i], v2[j]), np.maximum(v1[i], v2[j])]))
            both = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["x", "y"])

    columns = [f"{c}_{k}" for k in (1, 2) for c in ("v", "n", "root", "points")]
    return met.select(*columns).mapInArrow(releasing(pairs), "x long, y long").distinct()


def similar_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Takes any table with doc_id and text; other columns are not read. A-Z count as lower case, words end at
    blanks, a text of fewer than five words is one shingle. Documents link when den * shared >= num * union;
    component_id is the smallest doc_id reachable by links. Documents without words (null and empty texts
    among them) have no shingles, no links and their own doc_id. Rows with equal sets link, repeated rows too;
    null doc_ids are never the smallest unless there is no other. An empty table gives no rows. Options are those of `_members`.
    """
    return _members(docs, **options).select("doc_id", "n_shingles", "component_id")


def text_key(text) -> Column:
    """With the doc_id, what says which row of a table is meant."""
    return F.coalesce(F.xxhash64(text), F.lit(0).cast("long"))


def _members(
    docs: DataFrame, num: int = NUM, den: int = DEN, range_shingles: int = RANGE_SHINGLES, leaf: int = LEAF,
    leaf_pairs: int = LEAF_PAIRS,
) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and a key of the component (null without words) for every row."""
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), text_key("text").alias("text_key"))
    found = staged(
        texts.mapInArrow(releasing(_documents), "doc_id long, text_key long, n long, a long, b long, token long, times long"), "shingle-sets"
    )
    rows = found.where("times = 0").select("doc_id", "text_key", "n", "a", "b")
    # Each has more than range_shingles occurrences, so there are no more of them than ranges.
    frequent = found.where("times > 0").groupBy("token").agg(F.sum("times").alias("t")).where(F.col("t") > range_shingles)
    frequent = np.sort(np.array([r["token"] for r in frequent.select("token").toLocalIterator()], dtype=np.int64).view(np.uint64))
    total = rows.agg(F.sum("n")).first()[0] or 0
    n_ranges = max(8, -(-total // range_shingles))
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    classes = staged(rows.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("first_id")), "classes")

    points = staged(
        # As many tasks as ranges, however many the session would take, so a task's size does not grow with the input.
        texts.mapInArrow(releasing(_posted(n_ranges, shared)), _POSTED)
        .repartition(n_ranges + 1, "part").groupBy("part").applyInArrow(_counted(n_ranges), _SHARED)
        .repartition(n_ranges + 1, "part").groupBy("part").applyInArrow(_points(num, den), _POINT)
        .withColumn("v", F.monotonically_increasing_id()),
        "points",
    )
    labels, links = _first_links(points, num, den)
    for best in (True, False):
        known = points.select("v", "n", "prefix", "point").join(labels, "v")
        found = staged(_verified(_other_pairs(known, num, den, leaf, leaf_pairs, best), points, num, den), "more-links")
        links = links.unionByName(found)
        if best:
            labels = _hooked(labels, found)
    roots = connected(links).withColumnRenamed("node", "v")
    top = points.select("v", "a", "b").join(roots, "v", "left").select("a", "b", F.coalesce("root", "v").alias("top"))
    named = classes.join(top, ["a", "b"], "left")
    least = named.where("top IS NOT NULL").groupBy("top").agg(F.min("first_id").alias("least"))
    named = named.join(least, "top", "left").select(
        "a", "b", F.coalesce("least", "first_id").alias("component_id"),
        # What the rows of one component share, with or without doc_ids.
        F.coalesce("top", "a").alias("part_a"), F.when(F.col("top").isNull(), F.col("b")).otherwise(F.lit(0)).alias("part_b"),
    )
    columns = ["doc_id", "text_key", F.col("n").alias("n_shingles")]
    with_words = rows.where("n > 0").join(named, ["a", "b"]).select(*columns, "component_id", "part_a", "part_b")
    none = F.lit(None).cast("long")
    return with_words.unionByName(
        rows.where("n = 0").select(*columns, F.col("doc_id").alias("component_id"), none.alias("part_a"), none.alias("part_b"))
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id.

    A null doc_id is larger than any other; of several rows with that doc_id (or none), the one with the smallest
    hash of its text stays, and of rows equal in both one. Documents without words are alone in their component, but of those equal in
    doc_id and text one stays as well.
    """
    found = _members(docs, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    linked = found.where("part_a IS NOT NULL").groupBy("part_a", "part_b").agg(first).select("first.doc_id", "first.text_key")
    kept = linked.unionByName(found.where("part_a IS NULL").select("doc_id", "text_key")).distinct()
    # Which rows share doc_id and text is known from narrow rows, so that only those are reduced.
    times = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("times"))
    both = kept.withColumn("stays", F.lit(1)).withColumn("times", F.lit(0)).unionByName(times.withColumn("stays", F.lit(0)))
    kept = staged(
        both.groupBy("doc_id", "text_key").agg(F.max("stays").alias("stays"), F.sum("times").alias("times")).where("stays = 1"), "representatives"
    )
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & text_key("row.text").eqNullSafe(F.col("text_key"))
    rows = wrapped(docs).join(kept, same)
    once = rows.where("times = 1").select("row.*")
    repeated = rows.where("times > 1").dropDuplicates(["doc_id", "text_key"]).select("row.*")
    return once.unionByName(repeated)
