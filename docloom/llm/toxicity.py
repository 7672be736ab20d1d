"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

Features are densities of lexicon words, their proximity to the second person, capitals, punctuation and signs of obfuscation
(digits or symbols for letters, letters drawn out, letters set apart). The lexicon has a few fixed words and those that labelled documents show
to go with toxicity. Lexicon, trees and calibration are learned on three disjoint parts of a bounded sample of labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import keep_rows, slices, split_words
from docloom.session import materialize

#: Labelled documents that are learned from, about (chosen by a hash of the id); most learned lexicon words.
SAMPLE, MOST_WORDS = 30_000, 2000
#: A word enters the lexicon if so many toxic documents have it and its log odds are so high; a beginning of words, which stands for all of them, needs more.
LEAST_DOCS, LEAST_ODDS, LEAST_BEGINNING_DOCS, LEAST_BEGINNING_ODDS = 5, 1.2, 8, 2.0
BEGINNINGS = (5, 6)
TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 80, 4, 0.12, 64, 20, 5.0

#: Words that insult in common use, as a start for the lexicon.
INSULTS = (
    "idiot idiots stupid moron morons loser losers pathetic scum trash worthless disgusting dumb clown clowns garbage filth vermin imbecile "
    "dumbass jerk creep freak retard bastard bitch asshole whore slut shit fuck fucking crap "
    "dumm dummkopf abschaum trottel arschloch scheisse scheiße versager wertlos widerlich "
    "idiote stupide crétin imbécile abruti connard salaud merde ordure minable dégoûtant "
    "idiota estúpido estúpida imbécil basura escoria inútil patético asqueroso mierda cabrón"
).split()
SECOND_PERSON = frozenset("you your yours yourself youre you're u ur du dich dir dein deine deiner deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "|": "i"})
EDGES = regex.compile(r"^[^\p{L}\p{N}@$*]+|[^\p{L}\p{N}@$*]+$")
DRAWN_OUT = regex.compile(r"(\p{L})\1{2,}")
NOT_LETTER = regex.compile(r"[^\p{L}]+")
HIDDEN = regex.compile(r"\p{L}[^\p{L}\s'’\-/.,:;]+\p{L}|\p{L}[.*_\-]\p{L}[.*_\-]\p{L}")
NAMES = ("log_words", "hit_rate", "log_hits", "weight_rate", "max_weight", "distinct_hits", "second_rate", "proximity", "nearest", "hidden_hit_rate", "hidden_rate", "drawn_rate", "single_rate", "caps_word_rate", "capital_rate", "punct_rate", "exclaim_rate", "digit_rate", "star_rate", "word_length")


def plain(word: str) -> tuple[str, str]:
    """(the word in lower case without punctuation around it, the same with obfuscation undone)."""
    low = EDGES.sub("", word.lower())
    return low, NOT_LETTER.sub("", DRAWN_OUT.sub(r"\1", low.translate(LEET)))


def beginnings(word: str) -> list[str]:
    """Marked beginnings of a word, by which its other forms are known."""
    return ["^" + word[:k] for k in reversed(BEGINNINGS) if len(word) >= k]


def _classes() -> np.ndarray:
    """By byte: 1 capital, 2 other letter or part of a longer character, 3 punctuation, 4 digit, 5 `!` or `?`, 6 symbol that hides letters."""
    out = np.zeros(256, np.int8)
    out[128:] = 2
    for c in range(33, 127):
        s = chr(c)
        out[c] = 1 if s.isupper() else 2 if s.isalpha() else 4 if s.isdigit() else 5 if s in "!?" else 6 if s in "*@$#" else 3
    return out


CLASSES = _classes()


@dataclass
class Lexicon:
    """Weights of words, as `plain` gives them, and of marked beginnings."""

    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 2.0))


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """(texts, len(NAMES)); a null text is an empty one, and that is all zeros."""
    texts = texts.fill_null("")
    n = len(texts)
    counts, ids, words = split_words(texts, lower=False)
    raw = words.to_pylist()
    weight, hidden_hit, hidden, drawn, second, caps, single, length = (np.zeros(len(raw)) for _ in range(8))
    known = lexicon.weights
    for k, w in enumerate(raw):
        low, bare = plain(w)
        length[k] = len(low)
        if low in SECOND_PERSON:
            second[k] = 1
        if low in known:
            weight[k] = known[low]
        elif bare != low and bare in known:
            weight[k] = known[bare]
            hidden_hit[k] = 1
        else:
            for beginning in beginnings(low):
                if beginning in known:
                    weight[k] = known[beginning]
                    break
        if not low.isalpha():
            hidden[k] = HIDDEN.search(low) is not None
        if len(low) >= 3:
            caps[k] = w.isupper()
            drawn[k] = DRAWN_OUT.search(low) is not None
        elif len(low) == 1:
            single[k] = 1
    out = np.zeros((n, len(NAMES)))
    doc = np.repeat(np.arange(n), counts)
    total = np.maximum(counts, 1)

    def add(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values[ids], minlength=n)

    at = {name: i for i, name in enumerate(NAMES)}
    hit = (weight > 0).astype(float)
    hits = add(hit)
    out[:, at["log_words"]] = np.log1p(counts)
    out[:, at["hit_rate"]] = hits / total
    out[:, at["log_hits"]] = np.log1p(hits)
    out[:, at["weight_rate"]] = add(weight) / total
    places = np.flatnonzero(hit[ids] > 0)
    if len(places):
        np.maximum.at(out[:, at["max_weight"]], doc[places], weight[ids[places]])
        pairs = np.unique(doc[places] * (len(raw) + 1) + ids[places])
        out[:, at["distinct_hits"]] = np.bincount(pairs // (len(raw) + 1), minlength=n)
        persons = np.flatnonzero(second[ids] > 0)
        gap = np.full(len(places), np.inf)
        if len(persons):
            after = np.searchsorted(persons, places)
            for near in (np.maximum(after - 1, 0), np.minimum(after, len(persons) - 1)):
                other = persons[near]
                gap = np.minimum(gap, np.where(doc[other] == doc[places], np.abs(other - places), np.inf))
        close = 1 / (1 + gap)
        out[:, at["proximity"]] = np.bincount(doc[places], close, minlength=n) / total
        np.maximum.at(out[:, at["nearest"]], doc[places], close)
    for name, values in (("second_rate", second), ("hidden_hit_rate", hidden_hit), ("hidden_rate", hidden), ("drawn_rate", drawn), ("single_rate", single), ("caps_word_rate", caps), ("word_length", length)):
        out[:, at[name]] = add(values) / total
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    kinds = CLASSES[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.int8)
    size = np.maximum(np.diff(offsets), 1)
    for name, kind in (("capital_rate", 1), ("punct_rate", 3), ("digit_rate", 4), ("exclaim_rate", 5), ("star_rate", 6)):
        upto = np.concatenate([[0], np.cumsum(kinds == kind)])
        out[:, at[name]] = np.diff(upto[offsets - offsets[0]]) / size
    return out


@dataclass
class Trees:
    """Boosted trees of one depth: node k of a tree has children 2k + 1 and 2k + 2; a leaf adds its value to the log odds."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting for the logistic loss on quantile histograms."""
    n, width = x.shape
    least_leaf, ridge = int(np.clip(n // 100, 3, LEAST_LEAF)), float(np.clip(n / 1000, 1.0, RIDGE))  # few labels allow less
    rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    # Quantiles alone would put a rare value with zeros in one bin; the positive part has quantiles of its own.
    for j in range(width):
        above = x[x[:, j] > 0, j]
        if len(above):
            edges[j] = np.unique(np.r_[edges[j], 0.0, np.quantile(above, np.linspace(0, 1, BINS // 2))])
    most = max(len(e) for e in edges) + 1
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    cells = bins + np.arange(width) * most
    base = math.log(rate / (1 - rate))
    margin = np.full(n, base)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, threshold, value = (np.zeros((TREES, m), t) for m, t in ((inner, np.int64), (inner, float), (leaves, float)))
    threshold[:] = np.inf
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            where = (node - first)[:, None] * (width * most) + cells
            shape = (many, width, most)
            sums = [np.bincount(where.ravel(), np.repeat(v, width), minlength=many * width * most).reshape(shape) for v in (g, h, np.ones(n))]
            left = [s.cumsum(2) for s in sums]
            whole = [s[:, :, -1:] for s in left]
            gain = left[0] ** 2 / (left[1] + ridge) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
            gain[(left[2] < least_leaf) | (whole[2] - left[2] < least_leaf)] = 0
            flat = gain.reshape(many, -1)
            pick = flat.argmax(1)
            for k in range(many):
                if flat[k, pick[k]] > 1e-6:
                    j, b = divmod(int(pick[k]), most)
                    if b < len(edges[j]):
                        feature[tree, first + k], threshold[tree, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[tree, node]] > threshold[tree, node])
        leaf = node - inner
        sums = [np.bincount(leaf, v, minlength=leaves) for v in (g, h)]
        value[tree] = -RATE * sums[0] / (sums[1] + ridge)
        margin += value[tree, leaf]
    return Trees(base, feature, threshold, value)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margins, probabilities) of the non-decreasing least-squares fit: pool adjacent violators, a block at its mean margin.

    Every block has one case of either kind added, spread evenly, so that small pure blocks at the ends are not certain.
    """
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, sum of margins
    for m, v in zip(margin[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    mean = float(y.mean())
    at = np.array([b[2] / b[1] for b in blocks])
    p = np.array([(b[0] + mean) / (b[1] + 1.0) for b in blocks])
    return at, np.maximum.accumulate(p)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    calibration: tuple[np.ndarray, np.ndarray]

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), float(self.calibration[1][0]))
        margin = self.trees.margin(features(texts, self.lexicon))
        return np.clip(np.interp(margin, *self.calibration), 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model of label_col (0 or 1) for the documents whose id satisfies `train` (a condition on a column named as id_col).

    About `sample` labelled documents, chosen by a hash of the id, are learned from: half for lexicon words, three tenths for trees and two
    tenths for calibration. Rows of labels with a null id or label are left out; of several labels of an id the greatest counts.
    Without labels of both kinds the model gives all texts one score: the mean label, or 0.
    """
    rows = labels.where(train & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    n = rows.count()
    rows = rows.where(F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(n, 1))))
    rows = rows.groupBy("id").agg(F.max("y").cast("int").alias("y"))  # about `sample` rows
    part = F.pmod(F.xxhash64(F.lit(14), "id"), F.lit(10)).cast("int")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "id")
    texts = materialize(texts.select("text", "y", part.alias("part")), "labelled")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in slices(batches, "text"):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                own = {b for t in set((text or "").split()) for b in plain(t)} - {""}
                for w in own | {b for w in own for b in beginnings(w)}:
                    found.setdefault(w, [0, 0])[y > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.int64())], names=["word", "clean", "toxic"])

    lexicon = Lexicon()
    n_clean, n_toxic = (int(x or 0) for x in texts.where("part < 5").agg(F.sum(F.when(F.col("y") > 0, 0).otherwise(1)), F.sum(F.when(F.col("y") > 0, 1).otherwise(0))).first())
    if n_clean and n_toxic:
        odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
        table = texts.where("part < 5").select("text", "y").distinct().mapInArrow(words, "word string, clean long, toxic long")
        table = table.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).withColumn("odds", odds)
        whole = f"toxic >= {LEAST_DOCS} and odds >= {LEAST_ODDS}"
        begun = f"toxic >= {LEAST_BEGINNING_DOCS} and odds >= {LEAST_BEGINNING_ODDS}"
        best = table.where(F.when(F.startswith("word", F.lit("^")), F.expr(begun)).otherwise(F.expr(whole))).orderBy(F.desc(F.col("odds") * F.log("toxic")), "word").limit(MOST_WORDS)
        lexicon.weights |= {r["word"]: float(r["odds"]) for r in best.collect()}

    def table_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features(batch.column("text"), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("part"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "part", "x"])

    got = texts.where("part >= 5").mapInArrow(table_of, "y int, part int, x array<double>").orderBy("part", "x", "y").toArrow()  # half the sample at most
    y = (got["y"].to_numpy() > 0).astype(float)
    x = np.array(got["x"].to_pylist(), float).reshape(len(y), len(NAMES))
    fit = got["part"].to_numpy() < 8
    if not (0 < y[fit].sum() < fit.sum()) or fit.sum() < 12:
        every = n_clean + n_toxic + len(y)
        return Model(lexicon, None, (np.zeros(1), np.array([(n_toxic + y.sum()) / every if every else 0.0])))
    trees = fit_trees(x[fit], y[fit])
    other = ~fit if (~fit).any() else fit
    return Model(lexicon, trees, fit_isotonic(trees.margin(x[other]), y[other]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """For each row of docs: id, the columns `extra`, score (0 to 1) and predicted (1 if score >= 0.5).

    A null or empty text is scored as one with all features 0. Repeated rows are scored each for itself; a null id stays null; other columns
    are neither read nor returned; an empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col), *extra, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            score = model.score(batch.column("__text"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in narrow.dtypes[:-1])
    return narrow.mapInArrow(run, f"{kinds}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, whose score is under 0.5."""

    return keep_rows(docs, text_col, lambda texts: model.score(texts) < 0.5)
