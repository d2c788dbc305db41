"""SimHash near-duplicates, found by BK-trees.

Fingerprints of equal value are one node. Two fingerprints within RADIUS bits agree in at least m - RADIUS of m blocks
of bits, so those that share such blocks form a shard, and each shard has its BK-tree: a child's edge is its Hamming
distance to its parent, and a search follows only edges that differ from the query's distance by at most the radius. A
shard larger than SHARD fingerprints is cut into parts with a tree each. Every tree is built once and kept as bytes in a
table. Where all trees together have at most TREE_BYTES they are broadcast, and each fingerprint searches the trees of its
shards where it is; larger forests meet their fingerprints by shard in a shuffle, so that a task holds one tree at a time.
Either way no link is lost, and a task returns a spanning forest of the links it found, not all pairs; the forests are
joined by alternating star contractions, with a written table after each round.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import combinations, groupby, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import fresh, small_batches, written

WORDS, SEED, RADIUS, SHARD = 3, 42, 3, 8192
#: Broadcast trees take at most so many bytes; links a task gathers before it returns their forest.
TREE_BYTES, LINKS = 32 << 20, 100_000


def fingerprint(text: bytes) -> int:
    """64 bits; bit k is set if it is in over half of the shingles' XXH64. No words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(WORDS)), strict=False)) if len(words) >= WORDS else [b" ".join(words)]
    n = max(1, len(words) - WORDS + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        ones += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: str = "text") -> Column:
    """The fingerprint of a text column as a long; null text has no words."""

    @F.arrow_udf("long")
    def of(col: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t) for t in col.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64))

    return of(F.coalesce(F.col(text), F.lit("")))


class BKTree:
    """Fingerprints as Python numbers, all different, each inserted below the nodes on its way."""

    def __init__(self, values: Iterable[int] = ()):
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []
        for x in values:
            self.insert(x)

    def insert(self, x: int) -> None:
        me, at = len(self.value), 0
        self.value.append(x)
        self.children.append({})
        while me:
            d = (self.value[at] ^ x).bit_count()
            if (child := self.children[at].get(d)) is None:
                self.children[at][d] = me
                break
            at = child

    def packed(self) -> bytes:
        """The tree level by level, so that a node's children stand together: values, where each node's children begin, edges."""
        order, edges, begin = [0], [0], [1]
        for at in order:
            for d, child in self.children[at].items():
                order.append(child)
                edges.append(d)
            begin.append(len(order))
        return array("Q", [self.value[k] for k in order]).tobytes() + array("I", begin).tobytes() + bytes(edges)


class Tree:
    """A packed tree, searched in place."""

    def __init__(self, packed: bytes | memoryview):
        n = (len(packed) - 4) // 13
        view = memoryview(packed)
        self.value, self.begin, self.edge = view[: 8 * n].cast("Q"), view[8 * n : 12 * n + 4].cast("I"), view[12 * n + 4 :]

    def within(self, x: int, radius: int) -> list[int]:
        """The fingerprints at most radius bits from x."""
        found, todo, value, begin, edge = [], [0], self.value, self.begin, self.edge
        while todo:
            at = todo.pop()
            v = value[at]
            d = (v ^ x).bit_count()
            if d <= radius:
                found.append(v)
            first, stop = begin[at], begin[at + 1]
            if first < stop:
                low, high = d - radius, d + radius
                todo += [k for k in range(first, stop) if low <= edge[k] <= high]
        return found


class Forest:
    """Sets of linked fingerprints; rows() gives (fingerprint, smallest of its set) for all but the smallest."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def link(self, x: int, found: Iterable[int]) -> None:
        for y in found:
            if y != x:
                a, b = self.root(x), self.root(y)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)

    def rows(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks such that two values within radius agree under at least one; longer ones for more fingerprints, so that shards stay small."""
    m = radius + (1 if n <= 1 << 24 else 2 if n <= 1 << 33 else 3)
    cuts = [64 * k // m for k in range(m + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def members(fps: DataFrame, n: int, radius: int, shard: int) -> DataFrame:
    """fp, mask, bits, part, parts of the fingerprints that share a shard with others."""
    keys = F.array(*(F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(masks(n, radius))))
    member = fps.select("fp", F.explode(keys).alias("key")).select("fp", "key.*")
    count = member.groupBy("mask", "bits").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / shard).cast("int")
    return member.join(count, ["mask", "bits"]).select("fp", "mask", "bits", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"), parts.alias("parts"))


def _numbers(col: pa.Array) -> list[int]:
    return col.to_numpy().view(np.uint64).tolist()


def trees(member: DataFrame) -> DataFrame:
    """mask, bits, part, parts, tree: the packed BK-tree of each part of a shard, built once and written."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True), _numbers(b.column(0)), strict=True)

        out, size = [], 0
        for key, some in groupby(rows(), key=lambda r: r[0]):
            out.append((*key, BKTree(x for _, x in some).packed()))
            size += len(out[-1][-1])
            if len(out) >= 10_000 or size >= 1 << 20:
                yield _trees(out)
                out, size = [], 0
        yield _trees(out)

    group = ["mask", "bits", "part", "parts"]
    dealt = member.select("fp", *group).repartition("mask", "bits", "part").sortWithinPartitions(*group, "fp")
    return written(dealt.mapInArrow(build, "mask int, bits long, part int, parts int, tree binary"), "trees")


def _trees(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["mask", "bits", "part", "parts", "tree"])


def _forests(found: Iterator[tuple[int, list[int]]]) -> Iterator[pa.RecordBatch]:
    """Links (a fingerprint, those near it) as rows of spanning forests."""
    forest = Forest()
    for x, near in found:
        forest.link(x, near)
        if len(forest.parent) >= LINKS:
            yield _pairs(forest.rows())
            forest = Forest()
    yield _pairs(forest.rows())


def links_by_broadcast(fps: DataFrame, forest: DataFrame, n: int, radius: int) -> DataFrame:
    """u, v from a forest small enough to go to every task: each fingerprint searches its shards' trees where it is."""
    got = forest.select("mask", "bits", "tree").orderBy("mask", "bits").toArrow()
    mask, bits = got.column("mask").to_numpy(), got.column("bits").to_numpy()
    tree = got.column("tree").combine_chunks()
    sizes = pc.binary_length(tree).to_numpy()
    ends = np.cumsum(sizes, dtype=np.int64)
    edges = [(int(np.searchsorted(mask, k)), int(np.searchsorted(mask, k, "right"))) for k in range(len(masks(n, radius)))]
    shared = fps.sparkSession.sparkContext.broadcast((edges, bits, ends - sizes, ends, b"".join(tree.to_pylist())))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            edges, bits, begin, end, data = shared.value
            data, cuts = memoryview(data), masks(n, radius)
            for b in batches:
                fp = b.column(0).to_numpy().view(np.uint64)
                value = fp.tolist()
                for m, (low, high) in zip(cuts, edges, strict=True):
                    mine = (fp & np.uint64(m)).view(np.int64)
                    first, stop = (low + np.searchsorted(bits[low:high], mine, side) for side in ("left", "right"))
                    for k in np.flatnonzero(first < stop).tolist():
                        for t in range(first[k], stop[k]):
                            yield value[k], Tree(data[begin[t] : end[t]]).within(value[k], radius)

        yield from _forests(found())

    return fps.select("fp").mapInArrow(search, "u long, v long").distinct()


def links_by_shuffle(member: DataFrame, forest: DataFrame, radius: int) -> DataFrame:
    """u, v from trees that meet fingerprints by shard. A tree's own members are its queries; members of later parts come to it."""
    pair = ["mask", "bits", "i", "j"]
    tree_rows = forest.select("mask", "bits", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), F.lit(0).cast("long").alias("fp"), "tree")
    queries = member.where("part > 0").select("mask", "bits", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("i"), F.col("part").alias("j"), "fp", F.lit(None).cast("binary").alias("tree"))
    both = tree_rows.unionByName(queries).select(*pair, "fp", "tree").repartition(*pair).sortWithinPartitions(*pair, F.isnull("tree"))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            tree = Tree(BKTree([0]).packed())
            for b in batches:
                for i, j, x, packed in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), _numbers(b.column(4)), b.column(5).to_pylist(), strict=True):
                    if packed is None:
                        yield x, tree.within(x, radius)
                    else:
                        tree = Tree(packed)
                        if i == j:
                            yield from ((y, tree.within(y, radius)) for y in tree.value)

        yield from _forests(found())

    return both.mapInArrow(search, "u long, v long").distinct()


def links(fps: DataFrame, n: int, radius: int = RADIUS, shard: int = SHARD, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """u, v (longs, u is not v) that connect the fingerprints of fps (column fp, distinct, n of them) as all links within radius do."""
    small_batches(fps.sparkSession)
    member = members(fps, n, radius, shard)
    forest = trees(member)
    size = forest.agg(F.sum(F.octet_length("tree") + 24)).first()[0] or 0
    if size <= tree_bytes:
        return links_by_broadcast(fps, forest, n, radius)
    return links_by_shuffle(member, forest, radius)


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(rows, np.uint64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy().view(np.int64)), pa.array(a[:, 1].copy().view(np.int64))], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of edges (u, v) that isn't its own root.

    Large and small stars in turn (Kiveris et al.) until the edges stay the same, which they do after a number of rounds in
    proportion to the logarithm of the nodes; minima are pre-aggregated.
    """
    check = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    before = check(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = written(small.where("u > v").distinct(), "edges")
        after = check(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (long), component_id, root (smallest fingerprint of the component) for every row of docs (doc_id, text; others are left out).

    component_id is the smallest doc_id reachable over links of at most radius bits. Texts are read whole, however long. Null text has no words and so
    fingerprint 0. Null doc_ids are never the smallest; a component of null ids alone has a null id. Repeated rows stay.
    """
    small_batches(docs.sparkSession)
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column().alias("fp")), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    distinct, total = fps.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = components(links(fps.select("fp"), distinct, radius))
    node = fps.join(roots, fps.fp == roots.node, "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))
    names = node.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(node.join(names, "root").select("fp", "n", "component_id", "root"), "components")
    # Fingerprints of at least a 200th of all rows (so 200 at most) are broadcast; other rows are dealt by fingerprint.
    hot = F.broadcast(named.where(F.col("n") * 200 >= total).drop("n"))
    cold = rows.join(hot.select("fp"), "fp", "left_anti").join(named.drop("n"), "fp")
    columns = ["doc_id", "fp", "component_id", "root"]
    return rows.join(hot, "fp").select(columns).union(cold.select(columns))


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, with one of each component: that of the smallest doc_id, and one row if it repeats.

    Rows without doc_id stay if their component has no doc_id at all, one of each component.
    """
    found = written(near_duplicates(docs, radius), "near")
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    one = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    fp, root = fresh(docs, "fp"), fresh(docs, "root")
    nameless = found.where("component_id is null").select(F.col("fp").alias(fp), F.col("root").alias(root)).distinct()
    more = docs.where("doc_id is null").withColumn(fp, fingerprint_column()).join(nameless, fp).dropDuplicates([root]).select(docs.columns)
    return one.union(more)
