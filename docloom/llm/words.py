"""Words of whole texts in Arrow batches, without a Python loop over words.

A word is a maximal run of characters other than space and U+0009 to U+000D, after lower-casing A to Z.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches, cut so that the texts of a cut have about `most` bytes (a longer text is alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
        part = (np.cumsum(size) // most).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """batches put together until the texts of one have about `most` bytes, however small they come."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        own = batch.column(column).nbytes
        if held and size + own / 2 > most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words of each text, numbers of all words in order, the distinct words that the numbers stand for).

    A null text has no words. A distinct word may have no occurrence. With lower=False the case stays.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten().dictionary_encode()
    ids = flat.indices.to_numpy(zero_copy_only=False)
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(flat.dictionary, pa.scalar("", flat.dictionary.type)).as_py()
    if empty >= 0:
        keep = ids != empty
        total = np.concatenate([[0], np.cumsum(keep)])
        ends = np.cumsum(counts)
        counts = total[ends] - total[ends - counts]
        ids = ids[keep]
    return counts, ids.astype(np.int32), flat.dictionary


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    f = xxhash.xxh64_intdigest
    return np.fromiter((f(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits (splitmix64's finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def unpack(data: bytes | None, kind: str) -> np.ndarray:
    return np.frombuffer(data or b"", dtype=kind)


def keep_rows(docs: DataFrame, text_col: str, judge: Callable[[pa.Array], np.ndarray], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs, unchanged, for whose texts `judge` says so. Columns may have any names: on the way they go by number."""
    at = f"c{docs.columns.index(text_col)}"
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, slice_bytes):
            yield batch.filter(pa.array(judge(batch.column(at)), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
