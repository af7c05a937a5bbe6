"""N-gram Jaccard join: shingles hashed into groups, count vectors in R-tree leaves, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.llm.byte_kernels import LAST_ID, LOWER, Words, ids_of, mix, shingles, slices
from pelagia.llm.shared import giving_back, materialize, running_total
from pelagia.llm.spans import numbered
from pelagia.operators.graph import connected_components

GROUPS = 256  # coordinates of a count vector
CELLS = 64  # least coordinates of the short vectors that buckets are compared on
PER_CELL = 16  # elements to a coordinate; sets beyond that have vectors four times as long, and so on
BUCKET = 20_000  # members of a bucket that are compared with each other; a larger bucket hangs together unseen
LEAF = 512  # documents of a leaf
NODE = 16  # documents of an inner box
SLICE = 250_000  # bytes of text that are hashed at once, which sets the memory of a task; a longer text is one slice
BAND = Fraction(3, 2)
_ONE = np.uint64(1)


@lru_cache(maxsize=8)
def bands(threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Sizes at which the bands begin, and the number of groups of each band's scheme."""
    begin = [1]
    while begin[-1] < 1 << 40:
        begin.append(ceil(begin[-1] * BAND))
    groups = [ceil(Fraction(5, 4) * (floor((b - 1) * (1 - threshold) / threshold) + 1)) for b in begin[1:]]
    return np.array(begin), np.array(groups)


def differences(sizes: np.ndarray, threshold: Fraction) -> np.ndarray:
    """How many elements a set and a partner may differ in at most, by the set's own size."""
    gap = (1 - threshold) / threshold
    return sizes * gap.numerator // gap.denominator


def signatures(text: np.ndarray, value: np.ndarray, n_texts: int, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(text number, signature): hashes of whole groups of shingles, of which linked sets share at least one.

    A scheme deals the shingles of a set into groups. A difference spoils one group, so of two linked sets, the first
    D + 1 groups that hold anything (D: the differences allowed) include one that both hold alike. Sets in reach of
    the next band sign by its scheme as well. A set with too few filled groups also signs with its scheme alone.
    """
    sizes = np.bincount(text, minlength=n_texts)
    begin, groups = bands(threshold)
    own = np.searchsorted(begin, sizes, "right") - 1
    own_hash = mix(value)
    out_text, out_sign = [], []
    for above in (0, 1):
        scheme = own + above
        part = sizes > 0
        if above:
            part &= sizes * threshold.denominator >= begin[scheme] * threshold.numerator
        pick = part[text]
        if not pick.any():
            continue
        t, v, h = text[pick], value[pick], own_hash[pick]
        s = scheme[t]
        group = (mix(v ^ (s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % groups[s].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((group, t))
        t, group, h, s = t[order], group[order], h[order], s[order]
        head = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (group[1:] != group[:-1])])
        total = np.add.reduceat(h, head)
        t, group, s = t[head], group[head], s[head]
        nth = np.arange(len(t)) - np.searchsorted(t, t, "left")
        keep = nth <= differences(sizes[t], threshold)
        sign = mix(total ^ mix(group.astype(np.uint64) * np.uint64(0x100000001B3) + s.astype(np.uint64)))
        filled = np.bincount(t, minlength=n_texts)
        scarce = np.flatnonzero(part & (filled <= differences(sizes, threshold)))
        out_text += [t[keep], scarce]
        out_sign += [sign[keep], mix(scheme[scarce].astype(np.uint64) + (_ONE << np.uint64(50)))]
    if not out_text:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(out_text), np.concatenate(out_sign)


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return shingles(Words(LOWER[data], offsets), n)


def set_sums(text: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over the elements of each set, equal for equal sets."""
    out = []
    for salt in (1, 2):
        total = np.zeros(n, np.uint64)
        np.add.at(total, text, mix(value ^ np.uint64(salt)))
        out.append(total.view(np.int64))
    return out[0], out[1]


def cell_counts(text: np.ndarray, value: np.ndarray, n: int, cells: int, kind: type) -> list[bytes]:
    """For each set, how many elements fall into each cell."""
    cell = text * cells + (mix(value ^ np.uint64(77)) % np.uint64(cells)).astype(np.int64)
    counts = np.bincount(cell, minlength=n * cells).astype(kind).reshape(n, cells)
    return [row.tobytes() for row in counts]


def short_vectors(text: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Cell counts with as many cells as the size of a set asks for, so that unlike sets of any size look unlike."""
    out = [b""] * len(sizes)
    wide = CELLS
    open_ = np.arange(len(sizes))
    while len(open_):
        fits = sizes[open_] < PER_CELL * wide
        rows = open_[fits]
        if len(rows):
            place = np.full(len(sizes), -1)
            place[rows] = np.arange(len(rows))
            mine = place[text] >= 0
            for row, cells in zip(rows.tolist(), cell_counts(place[text[mine]], value[mine], len(rows), wide, np.uint32)):
                out[row] = cells
        open_, wide = open_[~fits], 4 * wide
    return out


class ShortVectors:
    """The vectors of a block by width; a longer one folds to a shorter width by adding up its stretches."""

    def __init__(self, column: list[bytes]):
        self.width = np.array([len(c) // 4 for c in column], dtype=np.int64)
        self.by_width = {}
        for wide in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width >= wide)
            folded = np.zeros((len(rows), wide), dtype=np.int32)
            for own in np.unique(self.width[rows]).tolist():
                same = np.flatnonzero(self.width[rows] == own)
                raw = np.frombuffer(b"".join([column[r] for r in rows[same].tolist()]), np.uint32)
                folded[same] = raw.reshape(len(same), own // wide, wide).sum(axis=1)
            place = np.zeros(len(column), dtype=np.int64)
            place[rows] = np.arange(len(rows))
            self.by_width[wide] = (place, folded)

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At most how many elements rows i and j share: summed minima at the shorter width of each two."""
        out = np.zeros(len(i), dtype=np.int64)
        both = np.minimum(self.width[i], self.width[j])
        for wide, (place, folded) in self.by_width.items():
            at = np.flatnonzero(both == wide)
            for part in np.array_split(at, 1 + len(at) * wide // 4_000_000):
                out[part] = np.minimum(folded[place[i[part]]], folded[place[j[part]]]).sum(axis=1)
        return out


def set_classes(docs: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, rep, cells): documents with equal sets share the least id as ``rep``; ``cells`` counts elements."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, size=SLICE):
            text, value = sets_of(data, offsets, n)
            size = np.bincount(text, minlength=len(rows))
            sums = [pa.array(x) for x in set_sums(text, value, len(rows))]
            cells = pa.array(short_vectors(text, value, size), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(rows)), pa.array(size), *sums, cells], names=["id", "n_shingles", "a", "b", "cells"])

    rows = materialize(docs.mapInArrow(giving_back(each), "id long, n_shingles long, a long, b long, cells binary"), "sets")
    reps = rows.filter("n_shingles > 0").groupBy("n_shingles", "a", "b").agg(F.min("id").alias("rep"))
    return rows.join(reps, ["n_shingles", "a", "b"], "left").select("id", "n_shingles", F.coalesce("rep", "id").alias("rep"), "cells")


def signature_rows(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """(key, id): the signatures of every document; of equal sets in a batch, only one document signs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for rows, data, offsets in slices(iter([batch]), size=SLICE):
                text, value = sets_of(data, offsets, n)
                sums = list(zip(*(x.tolist() for x in set_sums(text, value, len(rows)))))
                ids, new = ids_of(rows), np.zeros(len(rows), dtype=bool)
                for i, pair in enumerate(sums):
                    if pair not in seen:
                        seen.add(pair)
                        new[i] = True
                pick = new[text]
                signed, sign = signatures(text[pick], value[pick], len(rows), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(sign.view(np.int64)), pa.array(ids[signed])], names=["key", "id"])

    return docs.mapInArrow(giving_back(each), "key long, id long")


def bucket_ties(block: pa.Table, threshold: Fraction, hot: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst) of ties that hang together what may be linked within each bucket of a block ordered by key.

    Members are held against the first of their bucket; those that its cell counts rule out are held against all.
    """
    num, den = threshold.numerator, threshold.denominator
    key, ids, size = (block[c].to_numpy() for c in ("key", "id", "n_shingles"))
    cells = ShortVectors(block["cells"].to_pylist())
    fits = lambda i, j: cells.shared(i, j) * (num + den) >= num * (size[i] + size[j])
    begin = np.r_[True, key[1:] != key[:-1]]
    number = np.cumsum(begin) - 1
    starts = np.flatnonzero(begin)
    head = starts[number]
    ok = fits(np.arange(len(key)), head) | (key == hot if hot is not None else False)
    src, dst = [np.flatnonzero(ok & ~begin)], [head[ok & ~begin]]
    ends = np.r_[starts[1:], len(key)]
    lost = np.bincount(number, ~ok, len(starts))
    for g in np.flatnonzero((lost > 0) & (ends - starts > 2)):
        rows = np.arange(starts[g], ends[g])
        label = np.where(ok[rows], 0, np.arange(len(rows)))
        for i in np.flatnonzero(~ok[rows]):
            near = np.flatnonzero(fits(rows, np.full(len(rows), rows[i])) & (label != label[i]))
            for other in np.unique(label[near]):
                pick = near[label[near] == other][0]
                src.append(rows[[i]])
                dst.append(rows[[pick]])
                label[label == other] = label[i]
    return ids[np.concatenate(src)], ids[np.concatenate(dst)]


def shared_signatures(docs: DataFrame, classes: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """(src, dst) between representatives: ties that hang together all pairs with an equal group that may be linked.

    Only buckets of two or more go on, with the short count vectors of their members; a tie is made where the summed
    minima allow a link, or where a bucket passes BUCKET members and hangs together as it is.
    """
    several = F.count(F.lit(1)).over(Window.partitionBy("key"))
    rows = signature_rows(docs, n, threshold).withColumn("n", several).filter("n > 1").select("key", "id")
    rep = classes.groupBy("id").agg(F.min("rep").alias("rep"))
    buckets = materialize(rows.join(rep, "id").select("key", F.col("rep").alias("id")).distinct(), "buckets")
    # Near copies meet in hundreds of buckets; of buckets with the same members one says it all.
    alike = [F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftright(F.xxhash64("id", F.lit(salt)), 30)).alias(f"s{salt}") for salt in (1, 2, 3)]]
    one = buckets.groupBy("key").agg(*alike).groupBy("n", "s1", "s2", "s3").agg(F.min("key").alias("key")).filter("n > 1").select("key")
    buckets = materialize(buckets.join(one, "key"), "bucket-members")
    cells = classes.filter("id = rep").dropDuplicates(["id"]).select("id", "n_shingles", "cells")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = None, None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            whole = new if held is None else pa.concat_tables([held, new])
            keys = whole["key"].to_numpy()
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if last:
                yield tied(whole.slice(0, last), hot)
                hot = None
            held = whole.slice(last)
            if len(held) > BUCKET:
                hot = int(keys[-1])
                yield tied(held, hot)
                held = held.slice(0, 1)
        if held is not None and len(held):
            yield tied(held, hot)

    def tied(block: pa.Table, hot: int | None) -> pa.RecordBatch:
        src, dst = bucket_ties(block, threshold, hot)
        pairs = np.unique(np.stack([src, dst], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["src", "dst"])

    dealt = buckets.join(cells, "id").repartition("key").sortWithinPartitions("key", "id")
    return dealt.select("key", "id", "n_shingles", "cells").mapInArrow(giving_back(each), "src long, dst long").distinct()


def count_vectors(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(part, leaf, id, size, elements, counts) of the members: the set itself, and its counts by group."""
    joined = docs.join(members, "id").select("part", "leaf", "id", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, size=SLICE):
            text, value = sets_of(data, offsets, n)
            size = np.bincount(text, minlength=len(rows))
            ends = np.concatenate([[0], np.cumsum(size)])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), rows.column(2), pa.array(size),
                 pa.array([value[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                 pa.array(cell_counts(text, value, len(rows), GROUPS, np.int32), pa.binary())],
                names=["part", "leaf", "id", "size", "elements", "counts"],
            )

    return joined.mapInArrow(giving_back(each), "part long, leaf long, id long, size long, elements binary, counts binary")


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 0
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[place] == a).sum())


class Box:
    """Documents of a leaf in the order of their nodes: sizes, count vectors, and each node's upper corner."""

    def __init__(self, table: pa.Table):
        order = np.lexsort((table["id"].to_numpy(), table["size"].to_numpy()))
        table = table.take(pa.array(order)).combine_chunks()
        self.ids, self.sizes = table["id"].to_numpy(), table["size"].to_numpy()
        self.counts = np.array([np.frombuffer(x.as_buffer(), np.int32) for x in table["counts"].combine_chunks()]).reshape(-1, GROUPS)
        if "elements" in table.column_names:
            self.elements = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["elements"].combine_chunks()]
        cuts = np.arange(0, len(order), NODE)
        if not len(order):
            return
        self.nodes = list(zip(cuts, np.r_[cuts[1:], len(order)]))
        self.upper = np.maximum.reduceat(self.counts, cuts, axis=0)
        self.least = self.sizes[cuts]
        self.most = self.sizes[np.array([e - 1 for _, e in self.nodes])]


def candidate_pairs(a: Box, b: Box, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs whose summed coordinate minima still allow a link, the likeliest first."""
    num, den = threshold.numerator, threshold.denominator
    first, second, bound = [], [], []
    for i, (a0, a1) in enumerate(a.nodes):
        corners = np.minimum(a.upper[i], b.upper).sum(axis=1)
        open_ = (corners * (num + den) >= num * (a.least[i] + b.least)) & (a.most[i] * den >= num * b.least) & (b.most * den >= num * a.least[i])
        for j in np.flatnonzero(open_):
            if a is b and j < i:
                continue
            b0, b1 = b.nodes[j]
            shared = np.minimum(a.counts[a0:a1, None, :], b.counts[None, b0:b1, :]).sum(axis=2)
            fits = shared * (num + den) >= num * (a.sizes[a0:a1, None] + b.sizes[None, b0:b1])
            x, y = np.nonzero(fits)
            if a is b and i == j:
                x, y = x[x < y], y[x < y]
            first.append(x + a0)
            second.append(y + b0)
            bound.append(shared[x, y] / (a.sizes[a0 + x] + b.sizes[b0 + y]))
    if not first:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(-np.concatenate(bound), kind="stable")
    return np.concatenate(first)[order], np.concatenate(second)[order]


def linked(a: Box, b: Box, threshold: Fraction, forest: Forest, shift: int) -> list[tuple[int, int]]:
    """Verified links that join what is not joined yet; b's documents are the positions from ``shift``."""
    num, den = threshold.numerator, threshold.denominator
    out = []
    for x, y in zip(*(p.tolist() for p in candidate_pairs(a, b, threshold))):
        if forest.find(x) == forest.find(y + shift):
            continue
        both = overlap(a.elements[x], b.elements[y])
        if both * (num + den) >= num * int(a.sizes[x] + b.sizes[y]):
            forest.join(x, y + shift)
            out.append((int(a.ids[x]), int(b.ids[y])))
    return out


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Complete groups of equal keys from batches that are ordered by them."""
    held: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        whole = new if held is None else pa.concat_tables([held, new])
        ids = [whole[k].to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([np.r_[True, x[1:] != x[:-1]] for x in ids], axis=0)) if len(whole) else []
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield whole.slice(i, j - i)
        if len(cuts):
            held = whole.slice(cuts[-1])
    if held is not None and len(held):
        yield held


LINKS = "part long, leaf long, src long, dst long, least long, most long, upper array<int>"


def leaf_links(vectors: DataFrame, threshold: Fraction) -> DataFrame:
    """Within each leaf: links that span its components, and one row (src null) with the leaf's sizes and upper corner."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in ("part", "leaf", "src", "dst", "least", "most", "upper")}
        for group in by_group(batches, ["part", "leaf"]):
            box = Box(group)
            part, leaf = group["part"][0].as_py(), group["leaf"][0].as_py()
            pairs = linked(box, box, threshold, Forest(len(box.ids)), 0)
            out["part"] += [part] * (len(pairs) + 1)
            out["leaf"] += [leaf] * (len(pairs) + 1)
            out["src"] += [p[0] for p in pairs] + [None]
            out["dst"] += [p[1] for p in pairs] + [None]
            out["least"] += [None] * len(pairs) + [int(box.sizes.min())]
            out["most"] += [None] * len(pairs) + [int(box.sizes.max())]
            out["upper"] += [None] * len(pairs) + [box.upper.max(axis=0).tolist()]
        types = [pa.int64()] * 6 + [pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return vectors.repartition("part", "leaf").sortWithinPartitions("part", "leaf").mapInArrow(giving_back(each), LINKS)


def cross_links(vectors: DataFrame, leaves: DataFrame, within: DataFrame, threshold: Fraction) -> DataFrame:
    """Links between leaves of one part whose boxes may hold a link; what a leaf has joined already is known."""
    num, den = threshold.numerator, threshold.denominator
    a, b = (leaves.select("part", *[F.col(c).alias(f"{c}_{x}") for c in ("leaf", "least", "most", "upper")]) for x in "ab")
    corner = F.aggregate(F.zip_with("upper_a", "upper_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, v: s + v)
    pairs = a.join(b, "part").filter(
        (F.col("leaf_a") < F.col("leaf_b")) & (F.col("most_a") * den >= F.col("least_b") * num) & (F.col("most_b") * den >= F.col("least_a") * num)
        & (corner * (num + den) >= (F.col("least_a") + F.col("least_b")) * num)
    ).select("part", "leaf_a", "leaf_b")
    labels = connected_components(within).withColumnRenamed("node", "id")
    sides = pairs.select("part", "leaf_a", "leaf_b", F.explode(F.array(
        F.struct(F.col("leaf_a").alias("leaf"), F.lit(0).cast("long").alias("side")), F.struct(F.col("leaf_b").alias("leaf"), F.lit(1).cast("long").alias("side"))
    )).alias("s")).select("part", "leaf_a", "leaf_b", "s.*")
    rows = vectors.join(sides, ["part", "leaf"]).join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    pair = ["part", "leaf_a", "leaf_b"]

    def sides_of(group: pa.Table) -> tuple[Box, Box, Forest]:
        side = group["side"].to_numpy()
        one, two = (Box(group.filter(pa.array(side == s))) for s in (0, 1))
        label = dict(zip(group["id"].to_pylist(), group["label"].to_pylist()))
        forest, seen = Forest(len(side)), {}
        for place, doc in enumerate([*one.ids.tolist(), *two.ids.tolist()]):
            forest.join(place, seen.setdefault(label[doc], place))
        return one, two, forest

    def open_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, pair):
            one, two, forest = sides_of(group)
            root = np.array([forest.find(i) for i in range(len(group))])
            x, y = candidate_pairs(one, two, threshold)
            apart = root[x] != root[y + len(one.ids)]
            ids = np.unique(np.concatenate([one.ids[x[apart]], two.ids[y[apart]]]))
            key = [pa.array(np.full(len(ids), group[k][0].as_py())) for k in pair]
            yield pa.RecordBatch.from_arrays([*key, pa.array(ids)], names=[*pair, "id"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, pair):
            one, two, forest = sides_of(group)
            found = linked(one, two, threshold, forest, len(one.ids)) if len(one.ids) and len(two.ids) else []
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["src", "dst"])

    # First the count vectors alone, to see which documents have an open partner; then only those with their sets.
    dealt = lambda df: df.repartition(*pair).sortWithinPartitions(*pair)
    wanted = materialize(dealt(rows.drop("elements")).mapInArrow(giving_back(open_ones), "part long, leaf_a long, leaf_b long, id long"), "open")
    return dealt(rows.join(wanted, [*pair, "id"])).mapInArrow(giving_back(verified), "src long, dst long")


def jaccard_components(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, rep, component): classes of texts reachable by Jaccard links of their n-word shingle sets.

    Words are runs of non-separators with A-Z lower-cased; a text with fewer words than ``n`` is one shingle. Two texts
    link when the intersection is at least ``threshold`` of the union; ``component`` is the least id reachable.

    1. Equal sets share a representative, and only representatives go on.
    2. Shingles are hashed into groups, and every linked pair has an equal group. Documents of a bucket (an equal group)
       are tied where their short count vectors allow a link, so the parts that the ties hang together hold all links.
    3. A part is cut into leaves of ``LEAF`` documents by size. Their count vectors are boxed; a pair of boxes or of
       documents goes on only if the summed coordinate minima allow the overlap. Pairs that are joined already are
       skipped, the others verified on their whole sets; a large part is thus never in one task.

    Null, empty and blank texts have no shingles and link with nothing; null ids count as the last id and come back
    null; rows that repeat an id belong to one class. An empty table gives an empty result.
    """
    rows = numbered(docs, id_col, text_col)
    classes = materialize(set_classes(rows, n), "classes")
    ties = materialize(shared_signatures(rows, classes, n, threshold), "ties")
    parts = connected_components(ties).select(F.col("component").alias("part"), F.col("node").alias("id"))
    sizes = classes.select("id", "n_shingles").dropDuplicates(["id"])
    placed = running_total(parts.join(sizes, "id").withColumn("one", F.lit(1)), "part", "n_shingles", "one", "nth", width=32)
    members = materialize(placed.select("id", "part", F.floor((F.col("nth") - 1) / LEAF).alias("leaf")), "members")
    vectors = materialize(count_vectors(rows, members, n), "vectors")
    found = materialize(leaf_links(vectors, threshold), "leaf-links")
    within = found.filter("src is not null").select("src", "dst")
    across = cross_links(vectors, found.filter("src is null"), within, threshold)
    components = connected_components(within.unionByName(across))
    return classes.drop("cells").join(components.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.when(F.col("id") != LAST_ID, F.col("id")).alias("id"), "n_shingles", "rep", F.coalesce("component", "rep").alias("component"),
    )


def drop_near_copies(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, the one with the least id; documents without words all stay.

    Null ids count as the last id, so they go if a document with an id is in their class, and else stay together. Rows
    that repeat an id stay or go together. All columns pass through; an empty table gives no rows.
    """
    found = jaccard_components(docs, n, threshold, id_col, text_col)
    drop = found.filter((F.col("n_shingles") > 0) & F.coalesce(F.col("id") != F.col("component"), F.col("component") != LAST_ID)).select(F.col("id").alias("drop_id_")).distinct()
    drop = materialize(drop, "near-copies")  # of a size that Spark knows, so that few ids do not make it deal out all texts
    return docs.join(drop, docs[id_col].eqNullSafe(drop["drop_id_"]), "left_anti")
