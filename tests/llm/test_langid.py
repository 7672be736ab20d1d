import random

from pyspark.sql import functions as F

from docloom.llm import langid
from tests.llm.helpers import documents

LANGS = {"aa": "ka to mi re la so fa".split(), "bb": "zh qu vu jo xe wy gh".split(), "cc": "st br cl dr fl gr pr".split()}


def text(seed, lang, n):
    r = random.Random(f"{seed}{lang}")
    return " ".join("".join(r.choice(LANGS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def table(spark):
    rows = [(i, text(i, lang := "aabbcc"[2 * (i % 3) : 2 * (i % 3) + 2], 3 + i % 90), lang) for i in range(240)]
    rows += [(500, text(1, "aa", 60) + " " + text(2, "bb", 30), "aa"), (501, None, "aa"), (502, " 12 !? ²", None), (503, "日本", "bb"), (None, text(3, "cc", 9), "cc"), (240, text(9, "aa", 20000), None), (241, "", "zz")]
    return documents(spark, rows)


def test_held_out_accuracy_and_mixture(spark):
    docs = table(spark)
    model = langid.learn(docs, (F.col("doc_id") % 5 != 0) & (F.col("doc_id") < 240))
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in langid.predict(docs, model, extra=("lang",)).collect()}
    assert len(got) == 247
    held = [r for i, r in got.items() if i is not None and i < 240 and i % 5 == 0]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[500].lang_pred == "aa" and got[500].languages == ["aa", "bb"] and abs(got[500].shares[1] - 1 / 3) < 0.08
    assert [got[i].lang_pred for i in (501, 502, 241)] == ["und"] * 3 and got[501].languages == [] and got[502].score == 0
    assert got[503].lang_pred in model.languages and got[None].lang_pred == "cc" and got[240].lang_pred == "aa"
    kept = langid.keep_identified(docs, model)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.schema == docs.schema and not ids & {501, 502, 503, 241} and len(ids) == 243  # 503 is in no language that was learned


def test_nothing_learned(spark):
    docs = table(spark)
    model = langid.learn(docs, F.lit(False))
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_em_finds_the_shares():
    import numpy as np

    likelihood = np.array([[0.9, 0.1]] * 30 + [[0.1, 0.9]] * 10, np.float32)
    share, total = langid._em(likelihood, np.zeros(40), np.array([0]), np.array([40]), np.ones((1, 2)))
    grid = np.linspace(0.001, 0.999, 999)
    value = 30 * np.log(0.9 * grid + 0.1 * (1 - grid)) + 10 * np.log(0.1 * grid + 0.9 * (1 - grid))
    assert abs(share[0, 0] - grid[value.argmax()]) < 0.02 and abs(total[0] - value.max()) < 0.05


def test_every_language_is_learned(spark):
    """More languages than share the full buckets; the rarest ones are learned too."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{k:02}" for k in range(70)]
    word = lambda k, j: letters[k % 26] + letters[k // 26] + letters[(k * 7 + j) % 26] + letters[k % 26]
    rows = [(i, " ".join(word(i % 70, j % 3) for j in range(20 + i % 5)), names[i % 70]) for i in range(60 + 70 * 4)]  # the last ten occur least
    docs = documents(spark, rows)
    model = langid.learn(docs, F.lit(True))
    assert model.languages == names and model.table.shape[1] < langid.BUCKETS
    got = langid.predict(docs, model, extra=("lang",)).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got) and {r.lang_pred for r in got} == set(names)


def test_mixture_of_six_languages(spark):
    syllables = [[c + v + c for v in "aeiou"] for c in "bdfgkmnpr"]

    def of(seed, k, n):
        r = random.Random(seed * 100 + k)
        return " ".join("".join(r.choice(syllables[k]) for _ in range(2)) for _ in range(n))

    rows = [(i, of(i, i % 9, 60), f"l{i % 9}") for i in range(180)] + [(500, " ".join(of(7, k, 80) for k in range(6)), None)]
    docs = documents(spark, rows)
    model = langid.learn(docs, F.col("doc_id") < 180)
    found = langid.predict(docs.where("doc_id = 500"), model).first()
    assert sorted(found.languages) == [f"l{k}" for k in range(6)] and all(abs(x - 1 / 6) < 0.03 for x in found.shares)


def test_choice_of_the_set_against_brute_force(spark):
    """For each document: EM over all languages orders them, then each nested set has its own EM, all in plain loops; the best penalised likelihood wins."""
    import math

    import numpy as np
    import pyarrow as pa

    docs = table(spark).where("doc_id < 240")
    model = langid.learn(docs, F.lit(True))
    texts = [text(900 + i, "aa", 3 + 4 * i) + " " + text(950 + i, "bb", 2 * i) + " " + text(970 + i, "cc", i % 3 * 8) for i in range(12)] + ["zhqu", "ka 12 !"]
    _, chosen, fit = langid.infer(model, pa.array(texts))

    def em(rows, allowed):
        share = [1 / len(allowed) if i in allowed else 0.0 for i in range(3)]
        for _ in range(langid.ROUNDS):
            new = [0.0] * 3
            for r in rows:
                joint = [share[i] * math.exp(r[i] - max(r)) for i in range(3)]
                for i in range(3):
                    new[i] += joint[i] / max(sum(joint), 1e-30)
            share = [x / len(rows) for x in new]
        return share, sum(math.log(max(sum(share[i] * math.exp(r[i] - max(r)) for i in range(3)), 1e-30)) + max(r) for r in rows)

    for k, t in enumerate(texts):
        scores, grams = model.word_scores(t.split())
        rows = [r for r in scores.tolist() if not math.isnan(r[0])]
        full, _ = em(rows, {0, 1, 2})
        order = sorted(range(3), key=lambda i: -full[i])
        single = [sum(r[i] for r in rows) for i in range(3)]
        best, share, likelihood = max(single), [float(i == single.index(max(single))) for i in range(3)], max(single)
        for n in (2, 3):
            got, total = em(rows, set(order[:n]))
            value = total - (n - 1) * langid.PENALTY * math.log(len(rows) + 1)
            if value > best:
                best, share, likelihood = value, got, total
        assert np.allclose(chosen[k], share, atol=1e-3), (k, chosen[k], share)
        assert grams.tolist() == [sum(len(run) + 2 - order + 1 if order > 1 else len(run) for run in langid.LETTERS.findall(w) for order in langid.ORDERS) for w in t.split()]
        grams = sum(grams)
        assert abs(fit[k] - (likelihood - grams * model.chance)) < 1e-2 * max(1, abs(fit[k]))


def test_scripts_without_spaces(spark):
    """A paragraph without spaces is many units, so that it can have a mixture, and even mixtures of all languages are kept."""
    r = random.Random(8)
    han = lambda base, n: "".join(chr(base + r.randrange(60)) for _ in range(n))
    rows = [(i, han(0x4E00, 80) if i % 2 else han(0x5E00, 80), f"h{i % 2}") for i in range(60)] + [(100, han(0x4E00, 60) + han(0x5E00, 60), None)]
    docs = documents(spark, rows)
    model = langid.learn(docs, F.col("doc_id") < 60)
    found = langid.predict(docs.where("doc_id = 100"), model).first()
    assert sorted(found.languages) == ["h0", "h1"] and all(abs(x - 0.5) < 0.1 for x in found.shares)
    assert langid.keep_identified(docs, model).count() == 61
