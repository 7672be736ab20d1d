"""N-gram Jaccard join: documents whose sets of word n-grams are alike, by prefix filters and prefix trees, exactly.

Equal sets are one class. All n-grams have one global order, frequent ones last; two sets that are alike share one of the first
few n-grams (the prefix). Candidates come in two rounds, so that a group of copies never meets pair by pair: first each class
with one head of each of its prefix n-grams, then, where a group still falls apart, its parts within bounded tiles. Filters on lengths,
positions and a parity sketch drop pairs that cannot be alike; a tile gives out no pairs, but a forest that connects the candidates it
found. All that such forests connect is a cluster, and every alike pair lies within one. A cluster's sets are sent once to a
bounded block, where a trie of the globally ordered sets is walked with each set, sharing the overlap of common beginnings and leaving
subtrees that are too short or in which too little can still match. A cluster beyond a block is first joined with its heads; then
its largest part meets, block by block, only what lies outside that part. Links are exact; components follow by star contraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.words import hashes, mix, slices, split_words
from docloom.session import forget, materialize, partitions

N = 5
#: Sets are alike if intersection / union >= NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 4, 5
#: An n-gram in this share of a slice's documents is reported as frequent; most frequent n-grams that the order knows.
FREQUENT, MOST_FREQUENT = 1 / 500, 200_000
#: Members of a group that are compared at once, rows of groups handled together, bits of the largest sketch, rows that may be broadcast.
TILE, BUCKET, SKETCH_BITS, SMALL = 1024, 100_000, 1 << 15, 1_000_000
#: Sets of a block of tries and their bytes; bytes of the blocks that a call handles one after the other.
BLOCK, BLOCK_BYTES, CALL_BYTES = 1024, 8 << 20, 4 << 20
#: Edges that a task turns into a forest at once, and pairs after which a bucket does.
EDGES, PAIRS = 1_000_000, 200_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Numbers from here on stand for frequent n-grams.
TOP = np.uint64(1 << 63)


def shingle_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """For each text the sorted 63-bit hashes of its distinct word n-grams; with fewer words, of the whole sequence; none without words."""
    counts, ids, words = split_words(texts)
    h = mix(hashes(words) + np.uint64(1))[ids] if len(ids) else np.zeros(0, np.uint64)
    m = max(len(h) - n + 1, 0)
    grams = np.zeros(m, np.uint64)
    for k in range(n):
        grams = grams * FACTOR + h[k : k + m]
    grams = mix(grams) >> np.uint64(1)
    out = []
    for end, count in zip(np.cumsum(counts), counts, strict=True):
        if count >= n:
            out.append(np.unique(grams[end - count : end - n + 1]))
        elif count:
            value = int(count)
            for x in h[end - count : end].tolist():
                value = (value * int(FACTOR) + x) % (1 << 64)
            out.append(mix(np.array([value ^ 0x5BD1E995], np.uint64)) >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(grams: np.ndarray) -> bytes:
    """By bit: whether an odd number of n-grams falls there. Two sets differ in at least as many n-grams as their sketches in bits.

    A bit for an n-gram, two in small sets: sets that are nearly alike shall rarely pass for alike.
    """
    bits, least = 64, len(grams) if len(grams) > 256 else 2 * len(grams)
    while bits < min(least, SKETCH_BITS):
        bits *= 2
    return np.packbits(np.bincount((mix(grams) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def keys_of(grams: np.ndarray) -> tuple[int, int]:
    """Two numbers for a set: equal sets have equal ones, others differ but for an accident of 128 bits."""
    m, size = mix(grams), np.uint64(len(grams))
    sums = np.array([m.sum(dtype=np.uint64), mix(grams ^ FACTOR).sum(dtype=np.uint64)])
    return tuple(mix(np.array([sums[0] ^ mix(sums[1:] + size)[0], sums[1] + mix(sums[:1] ^ size)[0]])).view(np.int64).tolist())


def ordinals(grams: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A set's n-grams as numbers that ascend in the global order: rare ones by hash, then the frequent ones by their place."""
    numbers = grams.copy()
    if len(frequent) and len(grams):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        known = frequent[at] == grams
        numbers[known] = TOP | place[at[known]]
        numbers.sort()
    return numbers


def _folded(data: bytes, size: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint64)
    while len(a) > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = shingle_sets(batch.column("text"))
        grams, count = np.unique(np.concatenate(sets), return_counts=True)
        often = count >= max(3, FREQUENT * len(sets))
        yield pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(count[often])], names=["gram", "df"])


def _indexer(frequent: np.ndarray, place: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for grams in shingle_sets(batch.column("text")):
                size = len(grams)
                prefix = size - -(-NUMERATOR * size // DENOMINATOR) + 1 if size else 0
                rows.append((size, *keys_of(grams), sketch(grams) if size else b"", ordinals(grams, frequent, place)[:prefix].view(np.int64)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["id", "n", "h1", "h2", "sketch", "prefix"])

    return run


class Trie:
    """A prefix tree of ordered sets; a node holds a run of items that all sets below share."""

    __slots__ = ("children", "items", "longest", "member", "one", "shortest")

    def __init__(self, items: np.ndarray):
        self.items, self.children, self.member = items, {}, -1
        self.shortest, self.longest, self.one = 1 << 60, 0, -1  # sizes of the sets below; a member if all are known to be linked

    def insert(self, items: np.ndarray, member: int, same: Callable[[int, int], bool]) -> None:
        node, at, size = self, 0, len(items)
        while True:
            node.shortest, node.longest = min(node.shortest, size), max(node.longest, size)
            if node.one != -2:
                node.one = member if node.one == -1 or same(node.one, member) else -2
            if at == size:
                node.member = member
                return
            child = node.children.get(items[at])
            if child is None:
                leaf = node.children[items[at]] = Trie(items[at:])
                leaf.shortest = leaf.longest = size
                leaf.one = leaf.member = member
                return
            m = min(len(child.items), size - at)
            differ = np.flatnonzero(child.items[:m] != items[at : at + m])
            shared = int(differ[0]) if len(differ) else m
            if shared < len(child.items):
                upper = Trie(child.items[:shared])
                upper.shortest, upper.longest, upper.one = child.shortest, child.longest, child.one
                child.items = child.items[shared:]
                upper.children[child.items[0]] = child
                node.children[items[at]] = upper
                child = upper
            node, at = child, at + shared


def alike(overlap: int, a: int, b: int) -> bool:
    return DENOMINATOR * overlap >= NUMERATOR * (a + b - overlap)


def trie_links(sets: list[np.ndarray], known: list[int] | None = None) -> np.ndarray:
    """For each set (distinct non-empty ones, ascending in the global order) the smallest index of a set that links lead to, by an exact trie join.

    known: sets with equal numbers are linked already.
    """
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def same(i: int, j: int) -> bool:
        return find(i) == find(j)

    def unite(i: int, j: int) -> None:
        low, high = sorted((find(i), find(j)))
        parent[high] = low

    first: dict[int, int] = {}
    for i, k in enumerate(known or []):
        unite(first.setdefault(k, i), i)
    if len(sets) == 2:
        if not same(0, 1) and alike(len(np.intersect1d(*sets, assume_unique=True)), len(sets[0]), len(sets[1])):
            unite(0, 1)
        return np.array([find(0), find(1)])
    grams, places = np.unique(np.concatenate(sets), return_inverse=True)
    ordered = np.split(places, np.cumsum([len(s) for s in sets])[:-1])
    root = Trie(np.zeros(0, np.int64))
    has = np.zeros(len(grams), bool)
    for q in sorted(range(len(sets)), key=lambda i: len(ordered[i])):
        items = ordered[q]
        size = len(items)
        has[items] = True
        upto = np.searchsorted(items, np.arange(len(grams) + 1)) if len(grams) < 4 * size else None
        stack = [(root, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            if node.one >= 0 and same(node.one, q):
                continue
            if DENOMINATOR * node.longest < NUMERATOR * size:
                continue
            if len(node.items):
                overlap += int(np.count_nonzero(has[node.items]))
                depth += len(node.items)
            if node.member >= 0 and node.member != q and not same(node.member, q) and alike(overlap, len(ordered[node.member]), size):
                unite(node.member, q)
            if node.children:
                past = int(node.items[-1]) + 1 if len(node.items) else 0
                left = size - int(upto[past] if upto is not None else np.searchsorted(items, past))
                for child in node.children.values():
                    # At most what is left of both can still match; the least that a set below needs has the shortest one's size.
                    most = overlap + min(left, child.longest - depth)
                    if (NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (size + child.shortest):
                        stack.append((child, overlap, depth))
        has[items] = False
        root.insert(items, q, same)
    return np.array([find(i) for i in range(len(sets))])


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (u, v) as stars: from every node but the smallest of its component to that one."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        best = label.copy()
        for side in (a, b):
            np.minimum.at(best, label[side], low)
        best = best[best]
        while (best[best] != best).any():
            best = best[best]
        if (best[label] == label).all():
            break
        label = best[label]
    leaf = label != np.arange(len(nodes))
    return nodes[leaf], nodes[label[leaf]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of each stretch of a partition as stars."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        found = _stars(*(np.concatenate([np.asarray(p.column(c)) for p in held]) for c in ("u", "v")))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= EDGES:
            yield stars()
            held = []
    if sum(x.num_rows for x in held):
        yield stars()


def components(edges: DataFrame, forests: bool = False) -> DataFrame:
    """(node, component): for each node of edges (u, v) the smallest node that edges lead to.

    Up to EDGES edges are one task's work; more of them go through rounds of large-star and small-star over local forests. forests: the
    edges come from such already.
    """
    kind = "u long, v long"
    e = edges.select("u", "v").where("u <> v")
    e = materialize((e if forests else e.mapInArrow(_forest, kind)).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, written = mark(e), e
    if before[0] <= EDGES:
        e = e.coalesce(1).mapInArrow(_forest, kind)
    while before[0] > EDGES:
        e = e.mapInArrow(_forest, kind)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = materialize(small.where("u <> v").distinct(), "edges")
        forget(written)
        after, written = mark(e), e
        if after == before:
            break
        before = after
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = materialize(stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    forget(written)
    return found


def _could_link(a_n: str, b_n: str) -> F.Column:
    return (F.least(a_n, b_n) * DENOMINATOR >= F.greatest(a_n, b_n) * NUMERATOR)


def _position_ok(a_n: str, a_pos: str, b_n: str, b_pos: str) -> F.Column:
    """If the first n-gram that two sets share is at these places, enough can follow."""
    most = F.least(F.col(a_n) - F.col(a_pos), F.col(b_n) - F.col(b_pos))
    return most * (NUMERATOR + DENOMINATOR) >= (F.col(a_n) + F.col(b_n)) * NUMERATOR


def _by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, a_n, b_n, a_sketch, b_sketch) whose sketches allow them to be alike."""
    for batch in batches:
        keep = []
        for n, x, y in zip((np.array(batch.column("a_n")) + np.array(batch.column("b_n"))).tolist(), batch.column("a_sketch").to_pylist(), batch.column("b_sketch").to_pylist(), strict=True):
            size = min(len(x), len(y)) // 8
            differ = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
            keep.append((NUMERATOR + DENOMINATOR) * differ <= (DENOMINATOR - NUMERATOR) * n)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sketch_fits(sketches: list[np.ndarray], where: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For pairs of rows (a, b): whether their sketches allow them to be alike. sketches: by power of two of the length, a matrix; where: a row's place in it."""
    fits = np.zeros(len(a), bool)
    low, high = np.minimum(words[a], words[b]), np.maximum(words[a], words[b])
    swap = words[a] > words[b]
    small, large = np.where(swap, b, a), np.where(swap, a, b)
    for lo, hi in {(int(x), int(y)) for x, y in zip(low, high, strict=True)}:
        if hi > lo + 1:
            continue  # sizes too far apart
        at = np.flatnonzero((low == lo) & (high == hi))
        x, y = sketches[lo][where[small[at]]], sketches[hi][where[large[at]]]
        if hi > lo:
            half = y.shape[1] // 2
            y = y[:, :half] ^ y[:, half:]
        differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        fits[at] = (NUMERATOR + DENOMINATOR) * differ <= (DENOMINATOR - NUMERATOR) * n[at]
    return fits


def _across(rows: pa.Table) -> pa.Table:
    """A forest (u, v) of the candidates within the groups (gram, i, j) of a bucket that are not connected yet.

    All groups advance together. A group's components stand one after the other, the largest first, and a row meets the rows behind
    its component only, so that a large component costs no more than the rows that are not in it. Pairs that
    found ones connect are not looked at again.
    """
    numbers = {c: rows.column(c).to_numpy().astype(np.int64) for c in ("gram", "i", "j", "side", "n", "pos", "node", "component")}
    by_part = np.lexsort([numbers[c] for c in ("component", "j", "i", "gram")])
    fresh = np.flatnonzero(np.r_[True, np.any([numbers[c][by_part][1:] != numbers[c][by_part][:-1] for c in ("component", "j", "i", "gram")], axis=0)])
    own = np.empty(len(by_part), np.int64)
    own[by_part] = np.repeat(np.diff(np.r_[fresh, len(by_part)]), np.diff(np.r_[fresh, len(by_part)]))
    order = np.lexsort([numbers["component"], -own, *(numbers[c] for c in ("j", "i", "gram"))])
    gram, i, j, side, n, pos, component = (numbers[c][order] for c in ("gram", "i", "j", "side", "n", "pos", "component"))
    sketch = rows.column("sketch").take(pa.array(order)).to_pylist()
    new = np.r_[True, (gram[1:] != gram[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]

    def ends(first: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(first)
        after = np.r_[starts[1:], len(first)]
        return np.repeat(after, after - starts)

    end, behind = ends(new), ends(new | np.r_[True, component[1:] != component[:-1]])
    size = np.array([len(x) // 8 for x in sketch])
    words = np.round(np.log2(size)).astype(np.int64)
    where, sketches = np.zeros(len(size), np.int64), []
    for w in range(int(words.max()) + 1):
        at = np.flatnonzero(words == w)
        where[at] = np.arange(len(at))
        sketches.append(np.frombuffer(b"".join([sketch[k] for k in at]), np.uint64).reshape(len(at), 1 << w))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    label, waiting = component.copy(), 0

    def contract() -> None:
        """What was found becomes a forest, and the rows' labels follow it."""
        nonlocal held, label, waiting
        u, v = _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held, waiting = [(u, v)], 0
        if len(u):
            at = np.minimum(np.searchsorted(u, component), len(u) - 1)
            label = np.where(u[at] == component, v[at], component)

    a = np.arange(len(gram))
    for distance in range(int((end - behind).max(initial=0))):
        a = a[behind[a] + distance < end[a]]
        b = behind[a] + distance
        may = (label[a] != label[b]) & ((i[a] == j[a]) | (side[a] != side[b]))
        may &= np.minimum(n[a], n[b]) * DENOMINATOR >= np.maximum(n[a], n[b]) * NUMERATOR
        may &= np.minimum(n[a] - pos[a], n[b] - pos[b]) * (NUMERATOR + DENOMINATOR) >= (n[a] + n[b]) * NUMERATOR
        x, y = a[may], b[may]
        if len(x):
            fits = _sketch_fits(sketches, where, words, x, y, n[x] + n[y])
            if fits.any():
                held.append((component[x[fits]], component[y[fits]]))
                waiting += int(fits.sum())
                if waiting > PAIRS or distance < 4 or distance & (distance - 1) == 0:
                    contract()
    if held:
        contract()
    u, v = held[0] if held else (np.zeros(0, np.int64),) * 2
    return pa.table({"u": pa.array(u), "v": pa.array(v)})


def _join_blocks(rows: pa.Table) -> pa.Table:
    """Links from each set (node, known, grams) of a block to the smallest one that it is connected with; all blocks of a call."""
    block, node, known = (rows.column(c).to_numpy() for c in ("block", "node", "known"))
    order = np.lexsort((node, block))
    grams = rows.column("grams")
    u, v = [], []
    fresh = np.r_[True, (np.diff(block[order]) != 0) | (np.diff(node[order]) != 0)][: len(order)]
    order = order[fresh]
    for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        if len(part) > 1:
            to = part[trie_links([np.frombuffer(grams[int(k)].as_buffer(), np.uint64) for k in part], known[part].tolist())]
            u.append(node[part[to != part]])
            v.append(node[to[to != part]])
    none = np.zeros(0, np.int64)
    return pa.table({"u": pa.array(np.concatenate([none, *u])), "v": pa.array(np.concatenate([none, *v]))})


class _Sets:
    """The sets of classes, read again from the documents that stand for them."""

    def __init__(self, docs: DataFrame, classes: DataFrame, frequent: np.ndarray, place: np.ndarray):
        self.docs, self.classes, self.frequent, self.place = docs, classes, frequent, place

    def of(self, nodes: DataFrame) -> DataFrame:
        """(node, grams) for each of nodes."""
        wanted = materialize(self.classes.select("node", "id", "h1", "h2").join(nodes.select("node").distinct(), "node", "left_semi"), "wanted")
        if wanted.count() <= SMALL:
            wanted = F.broadcast(wanted)
        frequent, place = self.frequent, self.place

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in slices(batches, "text"):
                nodes, own = batch.column("node").to_pylist(), []
                sets = shingle_sets(batch.column("text"))
                keys = list(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True))
                for k, s in enumerate(sets):
                    if nodes[k] not in seen and keys_of(s) == keys[k]:  # an id may stand for several rows and other texts
                        seen.add(nodes[k])
                        own.append(k)
                grams = pa.array([ordinals(sets[k], frequent, place).tobytes() for k in own], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(own, pa.int64())), grams], names=["node", "grams"])

        return self.docs.join(wanted, "id").select("node", "h1", "h2", "text").mapInArrow(read, "node long, grams binary")

    def links(self, placed: DataFrame) -> DataFrame:
        """Exact links (u, v) within the blocks of placed (block, node, known, n), at least those that connect all alike pairs."""
        placed = materialize(placed, "placed")
        total = placed.agg(F.sum(F.col("n").cast("long") * 8)).first()[0] or 0
        calls = max(partitions(self.docs.sparkSession), -(-total // CALL_BYTES))
        dealt = placed.drop("n").withColumn("call", F.pmod(F.xxhash64("block"), F.lit(calls)))
        if dealt.count() <= SMALL:
            dealt = F.broadcast(dealt)
        links = materialize(self.of(placed).join(dealt, "node").groupBy("call").applyInArrow(_join_blocks, "u long, v long"), "links")
        forget(placed)
        return links


def _exact(sets: _Sets, clusters: DataFrame, stars: DataFrame) -> DataFrame:
    """(node, component) of all linked classes, exactly. clusters: (node, component) within which all links are; stars: candidates (a, b) that joins start from."""
    sized = sets.classes.select("node", "n").join(clusters, "node")
    tiles = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).cast("long")
    tiled = materialize(sized.groupBy("component").agg(tiles.alias("tiles")), "tiles")
    sized = sized.join(_few(tiled), "component")
    one = sized.where("tiles = 1").select(F.xxhash64(F.lit(0), "component").alias("block"), "node", F.col("node").alias("known"), "n")
    large = materialize(sized.where("tiles > 1"), "large")
    if not large.count():
        return components(sets.links(one))
    # A large cluster's sets against their heads first, in blocks of a head's candidates.
    n_of = large.select("node", "n")
    ends = stars.join(n_of.withColumnRenamed("node", "a"), "a").join(n_of.select(F.col("node").alias("b"), F.col("n").alias("b_n")), "b")
    blocks = ends.groupBy("b").agg(F.first("b_n").alias("b_n"), F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).cast("long").alias("blocks"))
    members = ends.drop("b_n").join(blocks, "b").select(F.xxhash64("b", F.pmod(F.xxhash64("a"), "blocks")).alias("block"), F.col("a").alias("node"), F.col("a").alias("known"), "n")
    heads = blocks.select(F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.xxhash64("b", k))).alias("block"), F.col("b").alias("node"), F.col("b").alias("known"), F.col("b_n").alias("n"))
    known = components(sets.links(members.unionByName(heads)))
    # Then a cluster's largest part against what lies outside, and that against itself.
    parts = large.join(_few(known.withColumnRenamed("component", "known")), "node", "left").withColumn("known", F.coalesce("known", "node"))
    sizes = materialize(parts.groupBy("component", "known").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("grams")), "parts")
    inner = sizes.groupBy("component").agg(F.max_by("known", F.struct("m", "known")).alias("inner"), F.max("m").alias("most"), F.sum("m").alias("m"), F.sum("grams").alias("all"), F.max_by("grams", F.struct("m", "known")).alias("grams"))
    count = lambda m, grams: F.ceil(F.greatest(m / BLOCK, grams * 8 / BLOCK_BYTES)).cast("long")
    inner = inner.select("component", "inner", count(F.col("most"), F.col("grams")).alias("t_in"), count(F.col("m") - F.col("most"), F.col("all") - F.col("grams")).alias("t_out")).where("t_out > 0")
    parts = parts.drop("tiles").join(_few(materialize(inner, "inner")), "component")
    is_in = F.col("known") == F.col("inner")
    tile = F.pmod(F.xxhash64(F.lit(5), "node"), F.when(is_in, F.col("t_in")).otherwise(F.col("t_out")))
    upto = lambda t: F.sequence(F.lit(0).cast("long"), t - 1)
    met_in = F.transform(upto(F.col("t_out")), lambda o: F.xxhash64(F.lit(1), "component", F.col("tile"), o))
    met_out = F.concat(F.transform(upto(F.col("t_in")), lambda k: F.xxhash64(F.lit(1), "component", k, F.col("tile"))), F.transform(upto(F.col("t_out")), lambda o: F.xxhash64(F.lit(2), "component", F.greatest(o, F.col("tile")), F.least(o, F.col("tile")))))
    rest = parts.withColumn("tile", tile).select(F.explode(F.when(is_in, met_in).otherwise(met_out)).alias("block"), "node", "known", "n")
    more = sets.links(one.unionByName(rest))
    return components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))


def _per_gram(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """rows with aggregates over the rows of their n-gram; a frequent n-gram's rows, and there are at most MOST_FREQUENT such, are never gathered in one place."""
    rare, common, by_gram = rows.where("gram >= 0"), rows.where("gram < 0"), Window.partitionBy("gram")
    found = common.groupBy("gram").agg(*[value.alias(name) for name, value in values.items()])
    rare = rare.select("*", *[value.over(by_gram).alias(name) for name, value in values.items()])
    return rare.unionByName(common.join(F.broadcast(found), "gram"))


def _few(df: DataFrame) -> DataFrame:
    """df, which was materialized, to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= SMALL else df


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs.

    Words are those after lower-casing A to Z; the set holds the distinct N-word n-grams, with fewer words the whole sequence, and is
    empty for a null or blank text. Two documents link if their sets' intersection is at least 4/5 of their union;
    component_id is the smallest id that links lead to, the own one included. An empty set links with nothing. Rows with equal ids are
    documents each for itself. A row with a null id takes no part and has a null component. Other columns are
    neither read nor returned; an empty table gives no rows. N-grams are compared by 63-bit hashes, whole sets by 128-bit ones.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    reports = rows.select("text").mapInArrow(_reports, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    most = reports.where("df >= 8").orderBy(F.desc("df"), "gram").limit(MOST_FREQUENT).toArrow()  # a bounded list; any list gives the same links
    frequent = most["gram"].to_numpy().view(np.uint64)
    order = np.argsort(frequent)
    frequent, place = frequent[order], np.arange(len(frequent), dtype=np.uint64)[::-1][order]  # the most frequent one is the last of all
    index = materialize(rows.mapInArrow(_indexer(frequent, place), "id long, n int, h1 long, h2 long, sketch binary, prefix array<bigint>"), "index")

    classes = index.where("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min_by(F.struct("n", "sketch", "prefix"), "id").alias("x"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "id", "x.*"), "classes")
    entries = classes.select("node", "n", F.posexplode("prefix").alias("pos", "gram"))
    # A head is, of near copies, that with the fewest n-grams of its own, which come first in the order.
    shared = _per_gram(entries, {"df": F.count(F.lit(1)), "head": F.min(F.struct("pos", "node", "n"))}).where("df > 1")
    shared = materialize(shared.select("gram", "node", "n", "pos", "head"), "shared")

    # First round: every class against the head of each of its n-grams.
    ends = shared.where("node <> head.node").select(F.col("node").alias("a"), F.col("head.node").alias("b"), "pos", F.col("head.pos").alias("b_pos"), "n", F.col("head.n").alias("b_n"))
    ends = ends.where(_could_link("n", "b_n") & _position_ok("n", "pos", "b_n", "b_pos")).groupBy("a", "b").agg(F.first("n").alias("a_n"), F.first("b_n").alias("b_n"))
    sketches = classes.select("node", "sketch")
    ends = ends.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("a_sketch")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("b_sketch")), "b")
    stars = materialize(ends.mapInArrow(_by_sketch, "a long, b long"), "stars")
    first = components(stars.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # Second round: groups that still have several components, each distinct group once, in tiles.
    known = shared.drop("head").join(_few(first), "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = {"df": F.count(F.lit(1)), "low": F.min("component"), "high": F.max("component"), "inner": F.min_by("component", F.struct("pos", "node")), "at": F.sum("pos")}
    who = {f"who{k}": F.bit_xor(F.xxhash64(F.lit(k), "node")) for k in (1, 2)}
    torn = _per_gram(known, whole | who).where("low <> high").drop("low", "high")
    torn = materialize(_per_gram(torn, {"n_out": F.count_if(F.col("component") != F.col("inner"))}), "torn")
    # Of n-grams that the same sets have, only the first one can be the first that two of them share.
    once = materialize(torn.groupBy("df", "who1", "who2").agg(F.min_by("gram", F.struct("at", "gram")).alias("gram")).select("gram"), "once")
    chosen = torn.join(_few(once), "gram", "left_semi")
    # Tiles of a group's inner component meet those of the rows outside, and these meet each other; of two tiles, one side meets the other.
    zero, is_in = F.lit(0).cast("long"), F.col("component") == F.col("inner")
    t_out, t_in = F.ceil(F.col("n_out") / TILE), F.ceil((F.col("df") - F.col("n_out")) / TILE)
    tile = F.pmod(F.xxhash64(F.lit(3), "node"), F.when(is_in, t_in).otherwise(t_out))
    seat = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    met_in = F.transform(F.sequence(zero, t_out - 1), lambda o: seat(-1 - F.col("tile"), o, F.lit(0)))
    met_out = F.concat(F.transform(F.sequence(zero, t_in - 1), lambda k: seat(-1 - k, F.col("tile"), F.lit(1))), F.transform(F.sequence(zero, t_out - 1), lambda o: seat(F.greatest(o, "tile"), F.least(o, "tile"), o > F.col("tile"))))
    one = F.col("df") <= TILE  # all in one tile
    copies = chosen.agg(F.sum(F.when(one, 1).when(is_in, t_out).otherwise(t_in + t_out))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-copies // BUCKET))
    placed = chosen.join(sketches, "node").withColumn("tile", tile).select("gram", "node", "n", "pos", "component", "sketch", F.explode(F.when(one, F.array(seat(zero, zero, F.lit(0)))).when(is_in, met_in).otherwise(met_out)).alias("t")).select("*", "t.*").drop("t")
    second = components(placed.withColumn("bucket", F.pmod(F.xxhash64("gram", "i", "j"), F.lit(buckets))).groupBy("bucket").applyInArrow(_across, "u long, v long"), True)
    forget(torn)
    forget(shared)
    whole = second.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    clusters = first.join(_few(whole), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    clusters = materialize(clusters.unionByName(second.join(_few(first.select("node")), "node", "left_anti")), "clusters")

    final = _exact(_Sets(rows, classes, frequent, place), clusters, stars)
    labelled = classes.select("h1", "h2", "node", "id").join(_few(final), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
    labelled = labelled.join(smallest, "component").select("h1", "h2", "component_id")
    found = index.select("id", "n", "h1", "h2").join(labelled, ["h1", "h2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("id")))
    return found.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
