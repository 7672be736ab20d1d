"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Words of equal length advance together: hashes of all their substrings probe the sorted keys of the vocabulary's pieces, and
for each end position the best of the candidate last pieces, by vectorised maxima, is stored as a backpointer.
The segmentation has the greatest sum of piece scores, the longest last piece among equals; a character in no
piece is spelt in byte pieces. A unigram model's scores are its own. A model of merges has ranks in their place, which are no
probabilities: a rank r there counts as log(1 / (r + RANK_OFFSET)), the law of Zipf and Mandelbrot for the r-th most frequent piece.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import mix, slices

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
#: A text's own U+2581 is not a space: it takes this code, which no piece has, and so is spelt in bytes.
OWN_SPACE = 0x110000
UNKNOWN_PENALTY = 10.0
#: Kind of model with merge ranks for scores, what is added to a rank, and scores below which a piece is there for completeness only.
MERGES, RANK_OFFSET, NEVER = 2, 100.0, -1e8
BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK, GROUP = 2048, 1 << 18


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffers message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class Pieces:
    """A vocabulary as read from a SentencePiece model file."""

    texts: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Pieces:
        out, kind = cls([], [], []), 1
        for number, value in _fields(data):
            if number == 1:
                fields = dict(_fields(value))
                out.texts.append(fields[1].decode())
                out.scores.append(struct.unpack("<f", fields[2])[0] if 2 in fields else 0.0)
                out.kinds.append(fields.get(3, NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("only the identity normaliser is supported")
                out.dummy_prefix = bool(spec.get(3, 1))
                if spec.get(4, 1):
                    raise ValueError("a model that drops white space cannot be decoded to the text")
        if kind == MERGES:
            out.scores = [score if score < NEVER else -float(np.log(RANK_OFFSET - score)) for score in out.scores]
        return out


class Codec:
    """Encodes texts to piece numbers and back, without loss."""

    def __init__(self, pieces: Pieces):
        self.dummy_prefix = pieces.dummy_prefix
        usable = [i for i, kind in enumerate(pieces.kinds) if kind in (NORMAL, USER_DEFINED)]
        self.longest = max(len(pieces.texts[i]) for i in usable)
        #: Words can be encoded each for itself if no piece has a space after something else, and lines if none has a line end.
        by_word = not any(SPACE in pieces.texts[i].lstrip(SPACE) for i in usable)
        by_line = not any("\n" in pieces.texts[i] for i in usable)
        self.split = re.compile(r"(?s).+" if not by_word else r" *[^ \n]+|\n| +" if by_line else r" *[^ ]+| +")
        keys = np.zeros(len(usable), np.uint64)
        for m in range(1, self.longest + 1):
            at = [k for k, i in enumerate(usable) if len(pieces.texts[i]) == m]
            if at:
                codes = np.array([[ord(c) for c in pieces.texts[usable[k]]] for k in at], np.uint32)
                keys[at] = self._key(self._prefix(codes)[:, m], np.zeros(len(at), np.uint64), m)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable, np.int32)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        #: Which low bits of a key occur at all: most substrings are no pieces and end here.
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.keys & np.uint64((1 << 20) - 1)] = True
        self.scores = np.array(pieces.scores, np.float64)
        self.unknown = min(pieces.scores[i] for i in usable) - UNKNOWN_PENALTY
        self.bytes = np.full(256, -1, np.int32)
        self.spell: list[bytes] = []
        for i, (text, kind) in enumerate(zip(pieces.texts, pieces.kinds, strict=True)):
            if kind == BYTE:
                self.bytes[int(text[1:-1], 16)] = i
                self.spell.append(bytes([int(text[1:-1], 16)]))
            else:
                self.spell.append(text.replace(SPACE, " ").encode() if kind in (NORMAL, USER_DEFINED) else b"")
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte pieces")

    @staticmethod
    def _prefix(codes: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes of each row, the empty one first."""
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        for t in range(codes.shape[1]):
            out[:, t + 1] = out[:, t] * BASE + codes[:, t] + np.uint64(1)
        return out

    @staticmethod
    def _key(end: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
        power = np.uint64(pow(int(BASE), m, 1 << 64))
        return mix(end - start * power + np.uint64(m * 0xD6E8FEB86659FD93 % (1 << 64)))

    def _viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece numbers of all rows of equally long words, number in each row); -1 - code for a character in no piece."""
        n, length = codes.shape
        hashes = self._prefix(codes)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back_len = np.zeros((length + 1, n), np.uint8 if self.longest < 256 else np.uint16)
        back_id = np.zeros((length + 1, n), np.int32)
        longest = min(self.longest, length)
        lengths = np.arange(longest, 0, -1)
        rows = np.arange(n)
        for a in range(1, length + 1, BLOCK):
            b = min(a + BLOCK, length + 1)
            found = np.full((longest, b - a, n), -1, np.int32)
            gain = np.full((longest, b - a, n), -np.inf)
            for k, m in enumerate(lengths):
                s = max(a, m)
                if s < b:
                    keys = self._key(hashes[:, s:b], hashes[:, s - m : b - m], int(m)).T
                    maybe = np.nonzero(self.filter[keys & np.uint64((1 << 20) - 1)])
                    probe = keys[maybe]
                    at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
                    true = self.keys[at] == probe
                    ids, t, row = self.ids[at[true]], s - a + maybe[0][true], maybe[1][true]
                    found[k, t, row] = ids
                    gain[k, t, row] = self.scores[ids]
            gain[-1][found[-1] < 0] = self.unknown
            for t in range(a, b):
                k0 = max(0, longest - t)
                total = gain[k0:, t - a] + best[t - lengths[k0:]]
                pick = total.argmax(0)
                best[t] = total[pick, rows]
                back_len[t] = lengths[k0 + pick]
                back_id[t] = found[k0 + pick, t - a, rows]
        # All rows go back together, a piece a step.
        at, taken = np.full(n, length), []
        none = np.iinfo(np.int64).min
        while (live := at > 0).any():
            ids = back_id[at, rows].astype(np.int64)
            unknown = ids < 0
            if unknown.any():
                ids[unknown] = -1 - codes[rows, np.maximum(at - 1, 0)][unknown].astype(np.int64)
            taken.append(np.where(live, ids, none))
            at = np.where(live, at - back_len[at, rows], 0)
        path = np.array(taken[::-1]).T
        kept = path != none
        return path[kept], kept.sum(1)

    def _spelt(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with unknown characters as byte pieces."""
        if not len(ids) or ids.min() >= 0:
            return ids.astype(np.int32), counts
        codes, which = np.unique(-1 - ids[ids < 0], return_inverse=True)
        spelt = [self.bytes[list((SPACE if c == OWN_SPACE else chr(c)).encode())] for c in codes.tolist()]
        size = np.ones(len(ids), np.int64)
        size[ids < 0] = np.array([len(x) for x in spelt])[which]
        start = np.cumsum(size) - size
        out = np.empty(size.sum(), np.int32)
        out[start[ids >= 0]] = ids[ids >= 0]
        for k, x in enumerate(spelt):
            at = start[ids < 0][which == k]
            for j, piece in enumerate(x.tolist()):
                out[at + j] = piece
        return out, np.add.reduceat(size, np.cumsum(counts) - counts)

    def _words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces of all words, where each word's begin, how many they are)."""
        begin, count, flat, used = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        size = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(size):
            same = np.flatnonzero(size == length)
            step = max(1, GROUP // int(length))
            for a in range(0, len(same), step):
                part = same[a : a + step]
                codes = np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le"), np.uint32).reshape(len(part), length)
                codes = np.where(codes == ord(SPACE), np.uint32(OWN_SPACE), np.where(codes == 32, np.uint32(ord(SPACE)), codes))
                ids, n = self._spelt(*self._viterbi(codes))
                flat.append(ids)
                count[part] = n
                begin[part] = used + np.cumsum(n) - n
                used += len(ids)
        return np.concatenate(flat), begin, count

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of pieces of each text, pieces of all texts in order); the distinct words of the texts are encoded once."""
        find = self.split.findall
        known: dict[str, int] = {}
        counts = np.zeros(len(texts), np.int64)
        numbers: list[int] = []
        for k, text in enumerate(texts):
            found = find(" " + text if self.dummy_prefix and text else text)
            counts[k] = len(found)
            numbers.extend([known.setdefault(w, len(known)) for w in found])
        if not known:
            return counts, np.zeros(0, np.int32)
        flat, begin, size = self._words(list(known))
        order = np.array(numbers, np.int64)
        own = size[order]
        ends = np.cumsum(own)
        ids = flat[np.repeat(begin[order] - (ends - own), own) + np.arange(own.sum())]
        total = np.concatenate([[0], ends])
        upto = np.cumsum(counts)
        return total[upto] - total[upto - counts], ids

    def decode(self, ids: Sequence[int]) -> str:
        """The text of piece numbers: control pieces vanish, and so does the space that encoding put first."""
        spell = self.spell
        text = b"".join([spell[i] for i in ids]).decode(errors="replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id, token_ids, n_tokens, decoded_crc32 (of the decoded text's UTF-8) and round_trip.

    model is a SentencePiece model file's content, which is a bounded parameter of the program and goes to the workers with
    the code. Texts are taken whole. A null or empty text has no tokens and decodes to the empty text; repeated rows are encoded each
    for itself; a null id stays null; other columns are neither read nor returned; an empty table gives no rows.
    round_trip tells that decoding gave the text back.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Pieces.parse(model))
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, ids = codec.encode(texts)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            crc, same = [], []
            for k, text in enumerate(texts):
                back = codec.decode(ids[offsets[k] : offsets[k + 1]].tolist())
                crc.append(zlib.crc32(back.encode()))
                same.append(back == text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(counts, pa.int32()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                names=[id_col, "token_ids", "n_tokens", "decoded_crc32", "round_trip"],
            )

    kind = dict(narrow.dtypes)["id"]
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, token_ids array<int>, n_tokens int, decoded_crc32 long, round_trip boolean")
