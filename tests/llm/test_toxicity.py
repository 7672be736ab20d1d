import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.llm import toxicity
from tests.llm.helpers import ODD, documents, words


def rows():
    r = random.Random(8)
    out = []
    for i in range(900):
        w = words(i, r.randint(5, 80), 300).split()
        toxic = i % 6 == 0
        for _ in range(max(1, len(w) // 12) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(["you idiot", "scum", "blargh", "YOU blargh", "st*pid"]))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_held_out(spark):
    data = rows()
    docs = documents(spark, [(i, t) for i, t, _ in data] + ODD)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data] + [(None, 0, 1), (3, 1, None), (5000, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels, F.col("doc_id") % 5 != 0)
    assert "blargh" in model.lexicon.weights
    got = {r.doc_id: r for r in toxicity.predict(docs, model).collect()}
    held = [(got[i], y) for i, _, y in data if i % 5 == 0]
    assert sum(r.predicted == y for r, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[1000].score == got[1001].score and toxicity.predict(docs, model).count() == len(data) + len(ODD)
    kept = toxicity.keep_clean(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(r.predicted == 0 for r in got.values()) + 1
    assert toxicity.predict(docs.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.score for r in toxicity.predict(docs, toxicity.learn(docs, none, F.lit(True))).collect()} == {0.0}


def test_features():
    lexicon = toxicity.Lexicon({"idiot": 2.0, "stupid": 1.0})
    x = dict(zip(toxicity.NAMES, toxicity.features(pa.array(["You IDIOT! 1d10t st*pid, stuuupid a b c"]), lexicon)[0]))
    assert x["hit_rate"] * 8 == 3 and abs(x["nearest"] - 0.5) < 1e-9 and x["distinct_hits"] == 3
    assert abs(x["hidden_hit_rate"] * 8 - 2) < 1e-9 and x["caps_word_rate"] * 8 == 1 and x["single_rate"] * 8 == 3
    assert not toxicity.features(pa.array(["", None, "  "]), lexicon)[:2].any()


def test_isotonic_and_trees():
    g = np.random.default_rng(9)
    m = g.normal(size=500)
    y = (g.random(500) < 1 / (1 + np.exp(-2 * m))).astype(float)
    at, p = toxicity.fit_isotonic(m, y)
    assert (np.diff(at) > 0).all() and (np.diff(p) >= 0).all() and abs(np.interp(m, at, p).mean() - y.mean()) < 0.02
    x = g.random((2000, 3))
    z = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((toxicity.fit_trees(x, z).margin(x) > 0) == (z > 0)).mean() > 0.97


def test_isotonic_against_its_formula():
    """The fit at i is the greatest over a <= i of the least over b >= i of the mean of a..b; blocks of one value then get a case of either kind."""
    g = np.random.default_rng(10)
    for n in (1, 2, 7, 60):
        m = np.sort(g.normal(size=n))
        y = (g.random(n) < 0.5).astype(float)
        fitted = [max(min(y[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        want, i = [], 0
        while i < n:
            j = next((k for k in range(i, n) if abs(fitted[k] - fitted[i]) > 1e-9), n)
            want.append((m[i:j].mean(), (y[i:j].sum() + y.mean()) / (j - i + 1)))
            i = j
        at, p = toxicity.fit_isotonic(m, y)
        assert np.allclose(at, [a for a, _ in want]) and np.allclose(p, np.maximum.accumulate([b for _, b in want]))


def test_trees_against_plain_loops(monkeypatch):
    """Each split by trying every feature and threshold, each leaf by its Newton step."""
    import math

    monkeypatch.setattr(toxicity, "TREES", 3)
    monkeypatch.setattr(toxicity, "DEPTH", 2)
    monkeypatch.setattr(toxicity, "BINS", 8)
    g = np.random.default_rng(11)
    x = np.round(g.random((120, 3)), 2)
    x[:, 2] = np.where(x[:, 2] > 0.8, x[:, 2], 0)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3) | (x[:, 2] > 0)).astype(float)
    ridge, least = 1.0, 3
    margin = [math.log(y.mean() / (1 - y.mean()))] * 120
    thresholds = []
    for j in range(3):
        own = set(np.quantile(x[:, j], np.linspace(0, 1, 9)[1:-1]).tolist()) | {0.0} | set(np.quantile(x[x[:, j] > 0, j], np.linspace(0, 1, 4)).tolist())
        thresholds.append(sorted(own))
    for _ in range(3):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad, hess = [a - b for a, b in zip(p, y)], [max(a * (1 - a), 1e-9) for a in p]
        value = lambda rows: sum(grad[i] for i in rows) ** 2 / (sum(hess[i] for i in rows) + ridge)
        leaves = [list(range(120))]
        for _ in range(2):
            after = []
            for rows in leaves:
                best = (1e-6, None)
                for j in range(3):
                    for t in thresholds[j]:
                        left, right = [i for i in rows if x[i, j] <= t], [i for i in rows if x[i, j] > t]
                        if len(left) >= least and len(right) >= least and (gain := value(left) + value(right) - value(rows)) > best[0] + 1e-12:
                            best = (gain, (left, right))
                after += best[1] or (rows, [])
            leaves = after
        for rows in leaves:
            step = -toxicity.RATE * sum(grad[i] for i in rows) / (sum(hess[i] for i in rows) + ridge)
            for i in rows:
                margin[i] += step
    assert np.allclose(toxicity.fit_trees(x, y).margin(x), margin, atol=1e-9)


def test_proximity_against_plain_loops():
    r = random.Random(12)
    lexicon = toxicity.Lexicon({"scum": 2.0, "idiot": 1.0})
    texts = [" ".join(r.choice(["scum", "idiot", "you", "x", "yy", "your"]) for _ in range(r.randint(0, 30))) for _ in range(80)]
    got = toxicity.features(pa.array(texts), lexicon)
    at = {n: i for i, n in enumerate(toxicity.NAMES)}
    for t, row in zip(texts, got):
        w = t.split()
        persons = [i for i, x in enumerate(w) if x in ("you", "your")]
        near = [1 / (1 + min((abs(i - k) for k in persons), default=float("inf"))) for i, x in enumerate(w) if x in lexicon.weights]
        assert abs(row[at["proximity"]] - sum(near) / max(len(w), 1)) < 1e-12 and abs(row[at["nearest"]] - max(near, default=0)) < 1e-12
        assert row[at["distinct_hits"]] == len({x for x in w if x in lexicon.weights})


def test_lexicon_against_plain_counts(spark):
    """Which words were learned, and their weights: counts of distinct texts in the first half of the labelled sample."""
    import math

    data = rows()
    docs = documents(spark, [(i, t) for i, t, _ in data])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True))
    part = {r.id: r.p for r in spark.createDataFrame([(i,) for i, *_ in data], "id long").select("id", F.pmod(F.xxhash64(F.lit(14), "id"), F.lit(10)).alias("p")).collect()}
    half = {(t, y) for i, t, y in data if part[i] < 5}
    n = [sum(1 for i, _, y in data if part[i] < 5 and (y > 0) == kind) for kind in (False, True)]
    seen = {}
    for t, y in half:
        for w in {b for x in set(t.split()) for b in toxicity.plain(x)} - {""}:
            seen.setdefault(w, [0, 0])[y] += 1
    odds = {w: math.log((b + 0.5) / (n[1] + 1)) - math.log((a + 0.5) / (n[0] + 1)) for w, (a, b) in seen.items() if b >= toxicity.LEAST_DOCS}
    want = {w: o for w, o in odds.items() if o >= toxicity.LEAST_ODDS}
    assert want and all(abs(model.lexicon.weights[w] - o) < 1e-9 for w, o in want.items())
    assert not [w for w in model.lexicon.weights if w not in want and w not in toxicity.INSULTS and not w.startswith("^")]
