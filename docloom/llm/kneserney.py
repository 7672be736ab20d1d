"""Language-model scoring with an interpolated modified Kneser-Ney model of order 2 or 3.

Documents are read once into chunks: a sorted array of the hashes of a chunk's distinct words, and its tokens as
numbers in that array. A chunk's distinct trigrams (u, v, w), with their counts in training documents, go to shards by a hash of
the middle word v, so that a shard sees all of a context (u, v), all that comes before a pair (v, w), and all of a context v. Where v makes
up much of the corpus they are dealt by (v, w) instead, and where the pair (v, w) does by the whole trigram, so no shard grows
with one word or pair; what such a v or pair needs is then summed over shards. Shards are worked off in rounds, so that only one round's
trigrams are on disk at a time. A shard merges what it gets into sorted hash arrays, maps these from a file into memory, answers every chunk
from them by binary search, and sums what it knows about words (as contexts and as continuations). Shards of words
merge these sums likewise and answer for the chunks' words. A chunk then has all counts that its probabilities need.
All chunks, shards and answers are bounded; the model as a whole is never in one place. In a model of order 2, u is nothing everywhere.
"""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import gathered, hashes, mix, slices, split_words
from docloom.session import materialize

#: Text bytes of a chunk and tokens of a shard (of order 2; half of it for order 3), and the share of the corpus from which a word or pair is dealt out.
#: A word of a smaller share stays in one shard, whose size therefore is bounded up to SHARD_TOKENS / HOT tokens, and grows with the corpus beyond.
CHUNK_BYTES, SHARD_TOKENS, HOT = 16 << 20, 4_000_000, 1 / 4000
#: A word has no white space, so these are no words' hashes but by chance.
END, START = np.uint64(xxhash.xxh64_intdigest(b" end")), np.uint64(xxhash.xxh64_intdigest(b" start"))
NOTHING = np.uint64(xxhash.xxh64_intdigest(b" nothing"))
#: For each order, the rounds in which its shards are worked off.
ROUNDS = {2: 1, 3: 2}
FRONT = 255
ODD = np.uint64(0x9E3779B97F4A7C15)


def squeeze(values: np.ndarray) -> bytes:
    """An array's bytes, lowest first for all items, then the next ones, compressed; before them the size of an item."""
    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(data: bytes, kind: type | None = None) -> np.ndarray:
    """What squeeze made bytes of; without a kind these are counts, of the size they were stored with."""
    kind = np.dtype(f"u{data[0]}" if kind is None else kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(data)[1:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def counts(x: np.ndarray) -> np.ndarray:
    """Whole numbers in 32 bits where all fit, else in 64."""
    return x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64)


def _put(into: np.ndarray, at: object, x: np.ndarray) -> np.ndarray:
    """into with x at a place, widened where x is wider."""
    into = into if into.dtype.itemsize >= x.dtype.itemsize else into.astype(x.dtype)
    into[at] = x
    return into


class HashTable:
    """Sorted 64-bit hashes with columns of numbers, mapped into memory from an unnamed file."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray):
        with tempfile.TemporaryFile() as f:
            for a in (keys, *columns):
                f.write(np.ascontiguousarray(a).data)
            f.flush()
            at, self.arrays = 0, []
            for a in (keys, *columns):
                self.arrays.append(np.memmap(f, a.dtype, "r", at, a.shape) if len(a) else a)
                at += a.nbytes

    def get(self, keys: np.ndarray) -> list[np.ndarray]:
        """The columns at keys; 0 where a key is absent."""
        own, *columns = self.arrays
        if not len(own):
            return [np.zeros(len(keys), c.dtype) for c in columns]
        order = np.argsort(keys)  # searched in order, neighbours share what they touch
        at = np.empty(len(keys), np.int64)
        at[order] = np.minimum(np.searchsorted(own, keys[order]), len(own) - 1)
        found = own[at] == keys
        return [np.where(found, c[at], c.dtype.type(0)) for c in columns]


def _encode(order: int, chunk_bytes: int):
    return lambda batches: _encoded(batches, order, chunk_bytes)


def _encoded(batches: Iterator[pa.RecordBatch], order: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    name = f"{context.partitionId()}-{context.taskAttemptId()}" if context else "0"
    for k, batch in enumerate(slices(gathered(batches, "text", chunk_bytes), "text", 2 * chunk_bytes)):
        counts, ids, words = split_words(batch.column("text"))
        own = np.append(hashes(words), END)
        size = counts + 1
        ends = np.cumsum(size) - 1
        seq = np.full(size.sum(), len(words), np.int64)
        inside = np.ones(len(seq), bool)
        inside[ends] = False
        seq[inside] = ids
        used = np.unique(seq)
        vocab, rank = np.unique(own[used], return_inverse=True)
        place = np.zeros(len(own), np.int64)
        place[used] = rank
        seq = place[seq]
        often = np.bincount(seq, minlength=len(vocab))
        front = np.argsort(-often, kind="stable")[:FRONT]
        code = np.arange(len(vocab)) + FRONT
        code[front] = np.arange(len(front))
        is_heavy = often > HOT * 2 * len(seq)
        heavy = np.flatnonzero(is_heavy)
        at = np.flatnonzero(is_heavy[seq[:-1]] & is_heavy[seq[1:]]) if order > 2 else np.zeros(0, np.int64)
        pairs, times = np.unique(seq[at] * len(vocab) + seq[at + 1], return_counts=True)
        v, w = np.divmod(pairs[times > HOT * 2 * len(seq)], len(vocab))
        v, w, times = vocab[v].view(np.int64), vocab[w].view(np.int64), times[times > HOT * 2 * len(seq)]
        train = np.array(batch.column("train").to_pylist(), np.uint8)
        yield pa.RecordBatch.from_pydict({
            "chunk": [f"{name}-{k}"], "ids": [batch.column("id").to_pylist()], "train": [train.tobytes()], "size": [squeeze(size.astype(np.int32))],
            "vocab": [squeeze(vocab)], "front": [front.astype(np.int32).tobytes()], "seq": [squeeze(code[seq].astype(np.uint32))],
            "n_tokens": [len(seq)], "n_train": [int(train.sum())],
            "heavy": [[{"hash": int(h), "n": int(n)} for h, n in zip(vocab[heavy].view(np.int64), often[heavy], strict=True)]],
            "heavy_pairs": [[{"v": int(a), "w": int(b), "n": int(n)} for a, b, n in zip(v, w, times, strict=True)]],
        }, schema=_ENCODED)


_ENCODED = pa.schema([
    ("chunk", pa.string()), ("ids", pa.list_(pa.int64())), ("train", pa.binary()), ("size", pa.binary()), ("vocab", pa.binary()), ("front", pa.binary()), ("seq", pa.binary()),
    ("n_tokens", pa.int64()), ("n_train", pa.int64()), ("heavy", pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64())]))),
    ("heavy_pairs", pa.list_(pa.struct([("v", pa.int64()), ("w", pa.int64()), ("n", pa.int64())]))),
])
_ENCODED_SQL = "chunk string, ids array<bigint>, train binary, size binary, vocab binary, front binary, seq binary, n_tokens bigint, n_train bigint, heavy array<struct<hash: bigint, n: bigint>>, heavy_pairs array<struct<v: bigint, w: bigint, n: bigint>>"
_PARTS = "kind string, part int, chunk string, a binary, b binary, c binary, d binary, e binary, f binary, g binary"


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * ODD + b)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])


@dataclass
class Grams:
    """A chunk's distinct trigrams by shard, pair and first word, all as places in its words (see Chunk.own)."""

    v: np.ndarray  # of the distinct pairs
    w: np.ndarray
    pair: np.ndarray  # of the trigrams: place among the pairs
    u: np.ndarray
    count: np.ndarray
    shard: np.ndarray
    place: np.ndarray  # of the tokens: place among the trigrams


@dataclass
class Chunk:
    """A chunk as its tokens' places in vocab."""

    vocab: np.ndarray
    size: np.ndarray
    train: np.ndarray
    tokens: np.ndarray
    contexts: np.ndarray  # place of the token before; len(vocab) at a start
    before: np.ndarray  # place of the token before that; len(vocab) + 1 where there is none or the order is 2

    @classmethod
    def read(cls, vocab: bytes, front: bytes, seq: bytes, size: bytes, train: bytes, order: int) -> Chunk:
        words, first, code, sizes = expand(vocab, np.uint64), np.frombuffer(front, np.int32), expand(seq, np.uint32).astype(np.int64), expand(size, np.int32).astype(np.int64)
        tokens = np.where(code < FRONT, first[np.minimum(code, len(first) - 1)], code - FRONT)
        begin = np.cumsum(sizes) - sizes
        contexts, before = np.empty_like(tokens), np.full_like(tokens, len(words) + 1)
        contexts[1:] = tokens[:-1]
        contexts[begin] = len(words)
        if order > 2:
            before[1:] = contexts[:-1]
            before[begin] = len(words) + 1
        return cls(words, sizes, np.frombuffer(train, np.uint8), tokens, contexts, before)

    @property
    def own(self) -> np.ndarray:
        """The hashes at all places."""
        return np.append(self.vocab, [START, NOTHING])

    def grams(self, layout: Layout) -> Grams:
        own, width = self.own, len(self.vocab) + 2
        distinct, back = np.unique(self.contexts * width + self.tokens, return_inverse=True)
        v, w = np.divmod(distinct, width)
        distinct, back = np.unique(back * width + self.before, return_inverse=True)
        pair, u = np.divmod(distinct, width)
        del distinct
        count = np.bincount(back, np.repeat(self.train, self.size), minlength=len(pair)).astype(np.uint32)
        key = pair_hash(own[v], own[w])
        by_pair = np.where(np.isin(own, np.array(layout.hot, np.uint64))[v], key, mix(own)[v]) % np.uint64(layout.shards)
        shard = by_pair[pair]
        hot = np.isin(key, layout.pair_keys())[pair]
        shard[hot] = pair_hash(key[pair[hot]], own[u[hot]]) % np.uint64(layout.shards)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return Grams(v, w, pair[order], u[order], count[order], shard[order].astype(np.int64), place[back])


def _top_bits(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def _cut(values: np.ndarray, parts: int) -> np.ndarray:
    """Where each of 0..parts starts in sorted values."""
    return np.searchsorted(values, np.arange(parts + 1))


@dataclass(frozen=True)
class Layout:
    shards: int
    bits: int  # word shards are the hash's top bits
    hot: tuple[int, ...]
    pairs: tuple[tuple[int, int], ...]  # hot ones
    order: int
    rounds: int

    def pair_keys(self) -> np.ndarray:
        """The pairs' hashes in the order of pairs."""
        both = np.array(self.pairs, np.uint64).reshape(-1, 2)
        return pair_hash(both[:, 0], both[:, 1])


def _send_grams(layout: Layout, turn: int):
    """The trigrams of the shards that are numbered turn modulo the rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.read(row["vocab"], row["front"], row["seq"], row["size"], row["train"], layout.order)
                g, own = chunk.grams(layout), chunk.own
                cuts = _cut(g.shard, layout.shards)
                for s in range(turn, layout.shards, layout.rounds):
                    a, b = cuts[s], cuts[s + 1]
                    if a < b:
                        first = _starts(g.pair[a:b])
                        pairs = g.pair[a:b][first]
                        contexts, n = np.unique(g.v[pairs], return_counts=True)
                        words, at = np.unique(np.concatenate([g.w[pairs], g.u[a:b]]), return_inverse=True)
                        at = at.astype(np.uint32)
                        yield _row("grams", s, row["chunk"], own[contexts], n.astype(np.uint32), own[words], at[: len(pairs)], np.diff(np.append(first, b - a)).astype(np.uint32), at[len(pairs) :], g.count[a:b])

    return run


_PARTS_ARROW = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("chunk", pa.string()), *((c, pa.binary()) for c in "abcdefg")])


def _row(kind: str, part: int, chunk: str | None, *arrays: np.ndarray) -> pa.RecordBatch:
    packed = [squeeze(a) for a in arrays] + [None] * (7 - len(arrays))
    return pa.RecordBatch.from_pydict({"kind": [kind], "part": [part], "chunk": [chunk], **{c: [x] for c, x in zip("abcdefg", packed, strict=True)}}, schema=_PARTS_ARROW)


def _merge_grams(layout: Layout):
    def run(rows: pa.Table) -> pa.Table:
        out, us, vs, ws, repeats, times, chunks = [], [], [], [], [], [], []
        for row in rows.to_pylist():
            words = expand(row["c"], np.uint64)
            vs.append(np.repeat(expand(row["a"], np.uint64), expand(row["b"], np.uint32)))
            ws.append(words[expand(row["d"], np.uint32)])
            repeats.append(expand(row["e"], np.uint32))
            us.append(words[expand(row["f"], np.uint32)])
            times.append(expand(row["g"], np.uint32))
            chunks.append((row["part"], row["chunk"], len(vs[-1]), len(us[-1])))
        u, v, w, c, repeat = (np.concatenate(x) for x in (us, vs, ws, times, repeats))
        del us, vs, ws, times, repeats, rows
        pair_key = pair_hash(v, w)
        of = np.repeat(np.arange(len(v), dtype=np.int32), repeat)
        key = pair_hash(pair_key[of], u)
        order = np.argsort(key)
        begin = _starts(key[order])
        total = np.add.reduceat(c[order].astype(np.int64), begin)
        del c
        grams = HashTable(key[order][begin], counts(total))
        seen = total > 0
        first, total = order[begin[seen]], total[seen]
        del order, begin, seen
        # Of the distinct trigrams: what they add to their pair, and what they are to their context.
        one, of = u[first], of[first]
        whole, adds = one != NOTHING, np.where(one != NOTHING, 1, total)
        raw = np.bincount(of, total, minlength=len(v))
        is_shared = np.isin(v, np.array(layout.hot, np.uint64))
        context, at, back = np.unique(pair_hash(one[whole], v[of[whole]]), return_index=True, return_inverse=True)
        partial = is_shared[of[whole][at]]
        stats = [counts(np.bincount(back, x, minlength=len(context))) for x in _counted(total[whole])]
        contexts = HashTable(context, *stats)
        distinct, at, back = np.unique(pair_key[of], return_index=True, return_inverse=True)
        a2, at = np.bincount(back, adds, minlength=len(distinct)).astype(np.int64), of[at]
        hot = layout.pair_keys()
        mine = np.zeros(len(hot), np.int64)
        is_hot = np.isin(distinct, hot)
        if is_hot.any():
            place = np.argsort(hot)
            mine[place[np.searchsorted(hot[place], distinct[is_hot])]] = a2[is_hot]
        pairs = HashTable(distinct[~is_hot], counts(a2[~is_hot]))
        end, pair_end = 0, 0
        where = np.repeat(np.arange(len(v), dtype=np.int32), repeat)
        for part, chunk, n_pairs, n in chunks:
            k, p = slice(end, end + n), slice(pair_end, pair_end + n_pairs)
            of_context = [np.where(is_shared[where[k]], x.dtype.type(0), x) for x in contexts.get(pair_hash(u[k], v[where[k]]))]
            out.append(_row("gram answers", part, chunk, grams.get(key[k])[0], pairs.get(pair_key[p])[0], *of_context))
            end, pair_end = end + n, pair_end + n_pairs
        by_v, back = np.unique(v, return_inverse=True)
        sums = [counts(np.bincount(back[at[~is_hot]], x, minlength=len(by_v))) for x in _counted(a2[~is_hot])]
        sums.append(counts(np.bincount(back, raw, minlength=len(by_v))))
        by_w, continued = np.unique(w[at[~is_hot]], return_counts=True)
        known = sums[-1] > 0
        for kind, keys, columns in (("contexts", by_v[known], [x[known] for x in sums]), ("continuations", by_w, [counts(continued)]), ("pair contexts", context[partial], [x[partial] for x in stats])):
            cuts = _cut(_top_bits(keys, layout.bits), 1 << layout.bits)
            for s in range(1 << layout.bits):
                a, b = cuts[s], cuts[s + 1]
                if a < b:
                    out.append(_row(kind, s, None, keys[a:b], *[x[a:b] for x in columns]))
        out.append(_row("trigram totals", 0, None, _times(total[whole])))
        out.append(_row("bigram totals", 0, None, _times(a2[~is_hot])))
        out.append(_row("hot pairs", 0, None, mine))
        return pa.Table.from_batches(out, _PARTS_ARROW)

    return run


def _counted(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """What n-grams counted x add to their context: the count, and whether it is 1, 2 or more."""
    return x, x == 1, x == 2, x >= 3


def _times(x: np.ndarray) -> np.ndarray:
    """How many are 1, 2, 3 and 4."""
    return np.array([(x == k).sum() for k in (1, 2, 3, 4)], np.int64)


def _shared_contexts(layout: Layout, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The places of the tokens before which a hot word and another one stand, and the hashes of these two."""
    own = chunk.own
    at = np.flatnonzero(np.isin(own, np.array(layout.hot, np.uint64))[chunk.contexts] & (chunk.before <= len(chunk.vocab)))
    return at, pair_hash(own[chunk.before[at]], own[chunk.contexts[at]])


def _send_words(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.read(row["vocab"], row["front"], row["seq"], row["size"], row["train"], layout.order)
                for kind, keys in (("words", chunk.vocab), ("shared", np.unique(_shared_contexts(layout, chunk)[1]))):
                    cuts = _cut(_top_bits(keys, layout.bits), 1 << layout.bits)
                    for s in range(1 << layout.bits):
                        if cuts[s] < cuts[s + 1]:
                            yield _row(kind, s, row["chunk"], keys[cuts[s] : cuts[s + 1]])

    return run


def _sums(rows: list[dict], n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    if not rows:
        return np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * n
    keys = np.concatenate([expand(r["a"], np.uint64) for r in rows])
    distinct, back = np.unique(keys, return_inverse=True)
    return distinct, [np.bincount(back, np.concatenate([expand(r[c]) for r in rows]), minlength=len(distinct)).astype(np.int64) for c in "bcdef"[:n]]


def _merge_words(rows: pa.Table) -> pa.Table:
    by_kind: dict[str, list[dict]] = {}
    for row in rows.to_pylist():
        by_kind.setdefault(row["kind"], []).append(row)
    contexts, stats = _sums(by_kind.get("contexts", []), 5)
    shared, of_pair = _sums(by_kind.get("pair contexts", []), 4)
    words, continued = _sums(by_kind.get("continuations", []), 1)
    as_context = HashTable(contexts, *map(counts, stats))
    as_pair = HashTable(shared, *map(counts, of_pair))
    as_word = HashTable(words, counts(continued[0]))
    out = []
    for row in by_kind.get("words", []):
        keys = expand(row["a"], np.uint64)
        answers = as_context.get(keys) + as_word.get(keys)
        out.append(_row("word answers", row["part"], row["chunk"], *answers))
    for row in by_kind.get("shared", []):
        out.append(_row("shared answers", row["part"], row["chunk"], *as_pair.get(expand(row["a"], np.uint64))))
    real = contexts != START
    start = [int(x) for x in (s[~real].sum() for s in stats[:4])]
    n = continued[0]
    totals = [(n == 1).sum(), (n == 2).sum(), (n == 3).sum(), (n == 4).sum(), (n >= 3).sum(), n.sum(), real.sum(), stats[4][real].sum(), *start]
    out.append(_row("word totals", 0, None, np.array(totals, np.int64)))
    return pa.Table.from_batches(out, _PARTS_ARROW)


def discounts(t: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, from the numbers of entries counted 1 to 4 times; rough ones where these are too few."""
    if min(t) <= 0:
        return 0.5, 1.0, 1.5
    y = t[0] / (t[0] + 2 * t[1])
    return tuple(min(max(k + 1 - (k + 2) * y * t[k + 1] / t[k], 0.0), k + 1.0) for k in range(3))


@dataclass(frozen=True)
class Totals:
    """Sums over the training documents that all probabilities share."""

    tokens: int
    words: int
    documents: int
    bigrams: int
    trigram_discounts: tuple[float, float, float]
    bigram_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    unigram_rest: float  # mass that the unigram discounts leave, for each of the words and an unknown one
    start: tuple[int, int, int, int]
    hot_pairs: tuple[int, ...]


def _discount(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


def _backoff(den: np.ndarray, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(den > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / np.maximum(den, 1), 1.0)


def _score(layout: Layout, totals: Totals):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        rows = answers.to_pylist()
        for row in chunks.to_pylist():
            chunk = Chunk.read(row["vocab"], row["front"], row["seq"], row["size"], row["train"], layout.order)
            g, hashed = chunk.grams(layout), chunk.own
            count, pairs, of_context = np.zeros(len(g.u), np.uint32), np.zeros(len(g.v), np.int64), np.zeros((4, len(g.u)), np.uint32)
            cuts = _cut(g.shard, layout.shards)
            stats = np.zeros((6, len(chunk.vocab) + 1), np.int64)
            word_cuts = _cut(_top_bits(chunk.vocab, layout.bits), 1 << layout.bits)
            at, key = _shared_contexts(layout, chunk)
            shared, back = np.unique(key, return_inverse=True)
            shared_cuts = _cut(_top_bits(shared, layout.bits), 1 << layout.bits)
            of_shared = np.zeros((4, len(shared)), np.uint32)
            for answer in rows:
                s = answer["part"]
                if answer["kind"] == "gram answers":
                    own = slice(cuts[s], cuts[s + 1])
                    count = _put(count, own, expand(answer["a"]))
                    pairs[g.pair[own][_starts(g.pair[own])]] = expand(answer["b"])
                    for k, c in enumerate("cdef"):
                        of_context = _put(of_context, (k, own), expand(answer[c]))
                elif answer["kind"] == "shared answers":
                    for k, c in enumerate("abcd"):
                        of_shared = _put(of_shared, (k, slice(shared_cuts[s], shared_cuts[s + 1])), expand(answer[c]))
                else:
                    for k, c in enumerate("abcdef"):
                        stats[k, word_cuts[s] : word_cuts[s + 1]] = expand(answer[c])
            of_context = _put(of_context, (slice(None), g.place[at]), of_shared[:, back])
            if layout.pairs:
                hot = layout.pair_keys()
                key = pair_hash(hashed[g.v], hashed[g.w])
                is_hot = np.flatnonzero(np.isin(key, hot))
                place = np.argsort(hot)
                pairs[is_hot] = np.array(totals.hot_pairs, np.int64)[place[np.searchsorted(hot[place], key[is_hot])]]
            stats[:4, -1] = totals.start
            den, n1, n2, n3, raw, continued = stats
            d, e = totals.bigram_discounts, totals.word_discounts
            unigram = (continued - _discount(continued, e)) / max(totals.bigrams, 1) + totals.unigram_rest
            bigram = (pairs - _discount(pairs, d)) / np.maximum(den, 1)[g.v] + _backoff(den, n1, n2, n3, d)[g.v] * unigram[g.w]
            p = (count - _discount(count, totals.trigram_discounts)) / np.maximum(of_context[0], 1) + _backoff(*of_context, totals.trigram_discounts) * bigram[g.pair]
            p = np.where(g.u <= len(chunk.vocab), p, bigram[g.pair])[g.place]
            w = chunk.tokens
            own = raw.copy()
            own[np.flatnonzero(chunk.vocab == END)] = totals.documents
            base = np.log10((own + 0.1) / (totals.tokens + 0.1 * (totals.words + 1)))
            begin = np.cumsum(chunk.size) - chunk.size
            add = lambda x: np.add.reduceat(x, begin)
            n = len(chunk.size)
            out.append(pa.table({"id": pa.array(row["ids"], pa.int64()), "train": pa.array(chunk.train.astype(bool)), "n_tokens": pa.array(chunk.size), "n_known": pa.array(add((own[w] > 0).astype(np.int64))),
                                 "train_tokens": pa.array(np.full(n, totals.tokens, np.int64)), "base_score": pa.array(add(base[w])), "score": pa.array(add(np.log10(p)))}))
        if not out:
            return pa.table({"id": pa.array([], pa.int64()), "train": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        return pa.concat_tables(out)

    return run


def _release(spark) -> None:
    """Let Spark drop the shuffle files of steps whose results are written; what Python lets go the first time is collected the second time."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def _hot_rows(layout: Layout, found: list[int]) -> list[tuple]:
    """What the hot pairs, at most 1 / HOT, add to their words as contexts and continuations."""
    seen = np.flatnonzero(np.array(found) > 0)
    v, w = np.array(layout.pairs, np.uint64)[seen].T
    stats = [counts(np.asarray(x)) for x in (*_counted(np.array(found)[seen]), np.zeros(len(seen), np.int64))]
    rows = []
    for kind, keys, columns in (("contexts", v, stats), ("continuations", w, [counts(np.ones(len(seen), np.int64))])):
        part = _top_bits(keys, layout.bits)
        for s in np.unique(part):
            rows += _row(kind, int(s), None, keys[part == s], *[x[part == s] for x in columns]).to_pylist()
    return [tuple(r.values()) for r in rows]


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """For each row of docs: id (as long), train, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Tokens are the words of the text after lower-casing A to Z, then an end. The model learns from rows for which `train` holds. score is
    its log10 probability of the text: of each token given the order - 1 before; order is 2 or 3. Orders below the highest count the words that
    an n-gram follows, and those of n-grams at a text's start how often it occurs. base_score is the sum of log10((c + 0.1) / (N + 0.1 (V + 1))) of the
    tokens' counts c among the N training tokens with V distinct ones; n_known counts tokens with c > 0. perplexity is 10 ** (-score / n_tokens).

    A null or empty text has the end alone. Repeated rows are documents each for itself, a null id stays null, and a null `train` counts
    as false; other columns are neither read nor returned. An empty table gives no rows; without training rows every token has probability 1.
    """
    if order not in ROUNDS:
        raise ValueError(f"order must be one of {sorted(ROUNDS)}")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    encoded = materialize(rows.mapInArrow(_encode(order, CHUNK_BYTES // (order - 1)), _ENCODED_SQL), "chunks")
    n_tokens, documents = encoded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    least = int(n_tokens * HOT) + 1
    heavy = encoded.select(F.explode("heavy").alias("h")).groupBy("h.hash").agg(F.sum("h.n").alias("n")).where(F.col("n") >= F.lit(least))
    hot = [r["hash"] % (1 << 64) for r in heavy.collect()]  # at most 1 / HOT words
    heavy = encoded.select(F.explode("heavy_pairs").alias("h")).groupBy("h.v", "h.w").agg(F.sum("h.n").alias("n")).where(F.col("n") >= F.lit(least))
    hot_pairs = [(r["v"] % (1 << 64), r["w"] % (1 << 64)) for r in heavy.collect()]  # at most 1 / HOT pairs
    if documents >= n_tokens * HOT:
        hot.append(int(START))
    shards = max(8, -(-n_tokens // (SHARD_TOKENS // (order - 1))))
    layout = Layout(shards, (shards - 1).bit_length(), tuple(sorted(hot)), tuple(sorted(hot_pairs)), order, ROUNDS[order])
    body = encoded.select("chunk", "ids", "vocab", "front", "seq", "size", "train")

    merged = None
    for turn in range(layout.rounds):
        sent = body.drop("ids").mapInArrow(_send_grams(layout, turn), _PARTS)
        part = materialize(sent.groupBy("part").applyInArrow(_merge_grams(layout), _PARTS), "grams")
        merged = part if merged is None else merged.unionByName(part)
        del sent
        _release(spark)

    def total(df: DataFrame, kind: str, n: int) -> list[int]:
        """Sums over shards of their few totals; one row a shard."""
        got = None
        for r in df.where(F.col("kind") == kind).select("a").toLocalIterator():
            x = expand(r["a"], np.int64)
            got = x if got is None else got + x
        return [0] * n if got is None else [int(x) for x in got]

    hot_counts = total(merged, "hot pairs", len(hot_pairs)) if hot_pairs else []
    asked = body.drop("ids").mapInArrow(_send_words(layout), _PARTS)
    known = merged.where(F.col("kind").isin("contexts", "continuations", "pair contexts"))
    if any(hot_counts):
        known = known.unionByName(spark.createDataFrame(_hot_rows(layout, hot_counts), _PARTS))
    words = materialize(known.unionByName(asked).groupBy("part").applyInArrow(_merge_words, _PARTS), "words")
    del known, asked
    _release(spark)

    t = [a + b for a, b in zip(total(merged, "bigram totals", 4), [sum(x == k for x in hot_counts) for k in (1, 2, 3, 4)], strict=True)]
    u = total(words, "word totals", 12)
    e = discounts(u[:4])
    rest = (e[0] * u[0] + e[1] * u[1] + e[2] * u[4]) / u[5] if u[5] else 1.0
    n_words = u[6] + (documents > 0)
    totals = Totals(u[7] + documents, n_words, documents, u[5], discounts(total(merged, "trigram totals", 4)), discounts(t), e, rest / (n_words + 1), tuple(u[8:12]), tuple(hot_counts))
    answers = merged.where(F.col("kind") == "gram answers").unionByName(words.where(F.col("kind").isin("word answers", "shared answers")))
    found = body.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(layout, totals), "id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return found.withColumnRenamed("id", id_col).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
