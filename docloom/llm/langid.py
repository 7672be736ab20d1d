"""Language identification of possibly mixed documents.

Character n-grams give each word a likelihood under each language. Expectation-maximisation estimates from these what
share of a document's words each language has; among nested sets of its likeliest languages the one of greatest penalised
likelihood is taken, and the language with the largest share in it is the document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import SLICE_BYTES, keep_rows, mix, slices, split_words

ORDERS, BUCKETS = (1, 2, 3), 1 << 15
#: Labelled documents of a language that are learned from (chosen by a hash of the id), and languages up to which each has BUCKETS buckets of n-grams.
SAMPLE, MANY_LANGUAGES = 2000, 64
ROUNDS, PENALTY, SMOOTHING = 10, 3.0, 0.5
#: Distinct words that are scored at once, and languages up to which a slice of texts has its full size.
WORDS_AT_ONCE, FEW_LANGUAGES = 16384, 8
UNDETERMINED = "und"
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Scripts that are written without spaces, and characters of them that are taken together as a word is in others.
SPACELESS, UNIT = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}", 4


def n_buckets(languages: int) -> int:
    """Buckets for so many languages: fewer for more of them, so that a table of all has a bounded size; a power of two, 64 at least."""
    return max(64, min(BUCKETS, 1 << (MANY_LANGUAGES * BUCKETS // max(languages, 1)).bit_length() - 1))


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """split_words of texts, with runs of scripts that have no spaces cut into units of UNIT characters."""
    return split_words(pc.replace_substring_regex(pc.fill_null(texts, ""), pattern=f"([{SPACELESS}]{{{UNIT}}})", replacement=r"\1 "))


def ngram_buckets(words: list[str], size_of: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, orders, word numbers) of the n-grams of the letter runs in words, each run padded by a space on both sides."""
    runs = [(k, f" {run} ") for k, w in enumerate(words) for run in LETTERS.findall(w.lower())]
    codes = np.frombuffer("".join(r for _, r in runs).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(r) for _, r in runs), np.int64, len(runs))
    word = np.repeat(np.fromiter((k for k, _ in runs), np.int64, len(runs)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # characters from here to the run's end
    buckets, orders, owners = [], [], []
    key = np.zeros(len(codes), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        m = max(len(codes) - order + 1, 0)
        key = key[:m] * np.uint64(0x1F123BB5) + codes[order - 1 : order - 1 + m] + np.uint64(1)
        if order in ORDERS:
            whole = left[:m] >= order
            if order == 1:
                whole &= codes[:m] != 32
            buckets.append((mix(key[whole] + np.uint64(order) * np.uint64(0x51ED27)) % np.uint64(size_of)).astype(np.int64))
            orders.append(np.full(whole.sum(), ORDERS.index(order)))
            owners.append(word[:m][whole])
    return np.concatenate(buckets), np.concatenate(orders), np.concatenate(owners)


@dataclass
class Model:
    """languages, and table[order, bucket, language]: log-likelihood of an n-gram, divided by the number of orders."""

    languages: list[str]
    table: np.ndarray

    @property
    def chance(self) -> float:
        """The log-likelihood of an n-gram that is no likelier than any other, divided by the number of orders."""
        return -float(np.log(self.table.shape[1])) / len(ORDERS)

    @property
    def slice_bytes(self) -> int:
        """Text that is handled at once: there is a number for each word and language."""
        return SLICE_BYTES * FEW_LANGUAGES // max(FEW_LANGUAGES, len(self.languages))

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (words, languages), all nan for a word without letters, and how many n-grams of all orders each word has."""
        step = max(1, WORDS_AT_ONCE * MANY_LANGUAGES // max(MANY_LANGUAGES, len(self.languages)))
        parts = [self._some_scores(words[a : a + step]) for a in range(0, len(words), step)]
        if not parts:
            return np.zeros((0, len(self.languages))), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

    def _some_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = np.full((len(words), len(self.languages)), np.nan)
        buckets, orders, owners = ngram_buckets(words, self.table.shape[1])
        order = np.argsort(owners, kind="stable")
        owners = owners[order]
        if len(owners):
            begin = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
            out[owners[begin]] = np.add.reduceat(self.table[orders[order], buckets[order]], begin, axis=0, dtype=np.float64)
        return out, np.bincount(owners, minlength=len(words))


def _em(likelihood: np.ndarray, offset: np.ndarray, begin: np.ndarray, size: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents, languages) after ROUNDS of EM and the log-likelihoods. allowed: languages of each document's set."""
    share = allowed / allowed.sum(1, keepdims=True)
    total = np.zeros(len(begin))
    for k in range(ROUNDS + 1):
        joint = likelihood * np.repeat(share.astype(np.float32), size, axis=0)
        each = joint.sum(1)
        if k == ROUNDS:
            total = np.add.reduceat(np.log(np.maximum(each, 1e-30), dtype=np.float64) + offset, begin)
            break
        joint /= np.maximum(each, 1e-30)[:, None]
        share = np.add.reduceat(joint, begin, axis=0, dtype=np.float64) / size[:, None]
    return share, total


def infer(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shares over all languages, shares in the chosen set, fit), the first two (texts, languages) and 0 where a text has no letter.

    fit: by how much the chosen set makes the text's n-grams likelier than chance, as a log-likelihood for all; 0 where a text has no letter.
    """
    n, n_langs = len(texts), len(model.languages)
    plain, chosen, fit = np.zeros((n, n_langs)), np.zeros((n, n_langs)), np.zeros(n)
    counts, ids, words = units(texts)
    scores, grams = model.word_scores(words.to_pylist())
    keep = ~np.isnan(scores[ids, 0]) if n_langs and len(ids) else np.zeros(len(ids), bool)
    doc = np.repeat(np.arange(n), counts)[keep]
    ids = ids[keep]
    if not len(ids):
        return plain, chosen, fit
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    rows = doc[begin]
    size = np.diff(np.r_[begin, len(doc)])
    best = scores.max(1)
    likelihood = np.exp(scores - best[:, None]).astype(np.float32)[ids]
    offset = best[ids]
    share, full = _em(likelihood, offset, begin, size, np.ones((len(rows), n_langs)))
    plain[rows] = share
    single = np.add.reduceat(scores[ids], begin, axis=0)
    picked = np.zeros_like(share)
    picked[np.arange(len(rows)), single.argmax(1)] = 1
    value = single.max(1)
    likelihood_of = value.copy()
    price = PENALTY * np.log(size + 1.0)
    order = np.argsort(-share, axis=1, kind="stable")
    for k in range(2, n_langs + 1):
        # No set of k languages is likelier than all languages together: most documents end here.
        maybe = np.flatnonzero(full - (k - 1) * price > value)
        if not len(maybe):
            break
        tokens = np.repeat(np.isin(np.arange(len(rows)), maybe), size)
        allowed = np.zeros((len(maybe), n_langs))
        np.put_along_axis(allowed, order[maybe, :k], 1.0, axis=1)
        sizes = size[maybe]
        got, total = _em(likelihood[tokens], offset[tokens], np.cumsum(sizes) - sizes, sizes, allowed)
        better = total - (k - 1) * price[maybe] > value[maybe]
        picked[maybe[better]] = got[better]
        value[maybe[better]] = (total - (k - 1) * price[maybe])[better]
        likelihood_of[maybe[better]] = total[better]
    chosen[rows] = picked
    fit[rows] = likelihood_of - np.add.reduceat(grams[ids], begin) * model.chance
    return plain, chosen, fit


def learn(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the languages of docs' rows for which `train` holds and lang is not null.

    It is fitted on about `sample` documents of each language, whole texts, chosen by a hash of the id. Beyond MANY_LANGUAGES
    languages n-grams share fewer buckets; no language is left out.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = rows.groupBy(F.col(lang_col).alias("lang")).count().collect()  # one row a language
    if not found:
        return Model([], np.zeros((len(ORDERS), BUCKETS, 0), np.float32))
    languages = sorted(r["lang"] for r in found)
    width = n_buckets(len(languages))
    at = {lang: i for i, lang in enumerate(languages)}
    share = F.element_at(F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, sample / r["count"]))]), F.col("lang"))
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * len(ORDERS) * width, np.int64)
        for batch in slices(batches, "text"):
            counts, ids, words = units(batch.column("text"))
            lang = np.repeat(np.array([at[x] for x in batch.column("lang").to_pylist()]), counts)
            buckets, orders, owners = ngram_buckets(words.to_pylist(), width)
            uses, back = np.unique(ids.astype(np.int64) * len(languages) + lang, return_counts=True)
            word_of, lang_of = uses // len(languages), uses % len(languages)
            by_word = np.argsort(owners, kind="stable")
            start = np.searchsorted(owners[by_word], np.arange(len(words) + 1))
            size = start[word_of + 1] - start[word_of]
            gram = by_word[np.repeat(start[word_of] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            cell = (np.repeat(lang_of, size) * len(ORDERS) + orders[gram]) * width + buckets[gram]
            total += np.bincount(cell, np.repeat(back, size), minlength=len(total)).astype(np.int64)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    cells = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most languages * orders * buckets rows
    total = np.zeros((len(languages), len(ORDERS), width))
    total.reshape(-1)[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    table = np.log((total + SMOOTHING) / (total.sum(2, keepdims=True) + SMOOTHING * width)) / len(ORDERS)
    return Model(languages, np.ascontiguousarray(table.transpose(1, 2, 0)).astype(np.float32))


def _judge(model: Model, texts: pa.Array) -> tuple[list[str], list[float], list[list[str]], list[list[float]], list[float]]:
    plain, chosen, fit = infer(model, texts)
    top = chosen.argmax(1) if model.languages else np.zeros(len(texts), int)
    langs, scores, sets, shares = [], [], [], []
    for k in range(len(texts)):
        if not model.languages or not chosen[k].any():
            langs.append(UNDETERMINED)
            scores.append(0.0)
            sets.append([])
            shares.append([])
            continue
        langs.append(model.languages[top[k]])
        scores.append(float(min(1.0, plain[k, top[k]])))
        parts = [i for i in np.argsort(-chosen[k], kind="stable") if chosen[k, i] > 0]
        sets.append([model.languages[i] for i in parts])
        shares.append([float(chosen[k, i]) for i in parts])
    return langs, scores, sets, shares, fit.tolist()


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """For each row of docs: id, the columns `extra`, lang_pred, score, languages and shares of its set.

    score is the predicted language's share among all learned languages. A text that is null or has no letter, and any
    text if no language was learned, is `und` with score 0 and an empty set. Equal shares go to the language that sorts first. Repeated rows are judged
    each for itself; a null id stays null; other columns are neither read nor returned; an empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col), *extra, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", model.slice_bytes):
            langs, scores, sets, shares, _ = _judge(model, batch.column("__text"))
            columns = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score", "languages", "shares"])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in narrow.dtypes[:-1])
    return narrow.mapInArrow(run, f"{kinds}, lang_pred string, score double, languages array<string>, shares array<double>")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, but for those that are `und`, and those whose chosen languages explain their n-grams no better than chance does.

    A text that mixes languages stays, however even their shares are.
    """

    def judge(texts: pa.Array) -> np.ndarray:
        langs, _, _, _, fit = _judge(model, texts)
        return (np.array(langs, object) != UNDETERMINED) & (np.array(fit) > 0)

    return keep_rows(docs, text_col, judge, model.slice_bytes)
