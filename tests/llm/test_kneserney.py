import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import kneserney, queries
from tests.llm.helpers import ODD, documents


def brute(rows, train):
    """The model by its formulas, with dictionaries."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + ["</s>"]
    docs = [(i, token(t)) for i, t in rows]
    learn = [w for i, w in docs if train(i)]
    c = Counter(x for w in learn for x in w)
    n, v = sum(c.values()), len(c)
    bi = Counter(b for w in learn for b in zip(["<s>", *w], w))
    follow = defaultdict(list)
    for (a, _), k in bi.items():
        follow[a].append(k)
    cont = Counter(b for _, b in bi)
    d = (0.0, *kneserney.discounts([sum(k == x for k in bi.values()) for x in (1, 2, 3, 4)]))
    e = (0.0, *kneserney.discounts([sum(k == x for k in cont.values()) for x in (1, 2, 3, 4)]))
    total = len(bi)
    rest = sum(e[min(k, 3)] for k in cont.values()) / total if total else 1.0

    def uni(w):
        return (cont[w] - e[min(cont[w], 3)]) / max(total, 1) + rest / (v + 1)

    def p(a, w):
        f = follow.get(a)
        if not f:
            return uni(w)
        k = bi[a, w]
        return (k - d[min(k, 3)]) / sum(f) + sum(d[min(x, 3)] for x in f) / sum(f) * uni(w)

    if total:  # a distribution over the words, the end and one unknown word
        for a in list(follow)[:20]:
            assert abs(sum(p(a, w) for w in [*c, object()]) - 1) < 1e-9
    return sorted((str(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6), round(sum(math.log10(p(a, x)) for a, x in zip(["<s>", *w], w)), 6)) for i, w in docs)


@pytest.mark.parametrize("kind", ["all", "none"])
def test_against_brute_force(spark, monkeypatch, kind):
    r = random.Random(10)
    words = [f"W{int(r.paretovariate(0.7))}" for _ in range(6000)]
    rows = [(i, r.choice([" ", "\t", "\x0b ", "\n"]).join(words[r.randrange(5900) :][: r.randint(0, 90)]) + r.choice(["", " "])) for i in range(250)] + ODD
    train = (lambda i: i is not None and i % 4 != 0) if kind == "all" else (lambda i: False)
    monkeypatch.setattr(kneserney, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(kneserney, "SHARD_TOKENS", 1500)
    docs = documents(spark, rows)
    got = kneserney.score(docs, F.col("doc_id") % 4 != 0 if kind == "all" else F.lit(False)).collect()
    assert sorted((str(x.doc_id), x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), round(x.score, 6)) for x in got) == brute(rows, train)
    assert kneserney.score(docs.limit(0), F.lit(True)).count() == 0


def test_hash_table_and_packing():
    g = np.random.default_rng(11)
    keys = np.unique(g.integers(0, 1 << 63, 1000).astype(np.uint64))
    table = kneserney.HashTable(keys, np.arange(len(keys), dtype=np.uint32))
    assert isinstance(table.arrays[0], np.memmap)
    assert (table.get(keys[::7])[0] == np.arange(len(keys))[::7]).all() and not table.get(keys + np.uint64(1))[0][1:5].any()
    for a in (keys, np.zeros(0, np.uint32), np.array([5], np.int32)):
        assert (kneserney.expand(kneserney.squeeze(a), a.dtype) == a).all()


def test_counts_beyond_32_bits():
    """A word that occurs five thousand million times: sums of shards, answers and what is put together of them."""
    many = np.array([3, 5 * 10**9, 1], np.int64)
    packed = kneserney.squeeze(kneserney.counts(many))
    assert kneserney.counts(many[:1]).dtype == np.uint32 and kneserney.expand(packed).tolist() == many.tolist()
    keys = np.array([1, 2, 3], np.uint64)
    rows = [{"a": kneserney.squeeze(keys), "b": packed}, {"a": kneserney.squeeze(keys[:2]), "b": kneserney.squeeze(kneserney.counts(many[:1].repeat(2)))}]
    distinct, (sums,) = kneserney._sums(rows, 1)
    assert sums.tolist() == [6, 5 * 10**9 + 3, 1]
    assert kneserney.HashTable(distinct, kneserney.counts(sums)).get(keys)[0].tolist() == sums.tolist()
    into = kneserney._put(np.zeros((2, 3), np.uint32), (1, slice(0, 3)), kneserney.expand(packed))
    assert into.tolist() == [[0, 0, 0], many.tolist()]


def brute_trigram(rows, train):
    """score of the model of order 3 by its formulas, with dictionaries."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(i, ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), "</s>"]) for i, t in rows]
    learn = [w for i, w in docs if train(i)]
    tri = Counter(t for w in learn for t in zip(w, w[1:], w[2:]))
    bi = Counter((b, c) for _, b, c in tri) + Counter((w[0], w[1]) for w in learn)
    uni = Counter(b for _, b in bi)
    v = len(uni)
    tables = []
    for table in (tri, bi, uni):
        d = (0.0, *kneserney.discounts([sum(k == x for k in table.values()) for x in (1, 2, 3, 4)]))
        follow = defaultdict(list)
        for g, k in table.items():
            follow[g[:-1] if table is not uni else ()].append(k)
        tables.append((table, d, {g: (sum(f), sum(d[min(k, 3)] for k in f)) for g, f in follow.items()}))

    def p(level, context, w):
        if level == 2:
            table, d, follow = tables[2]
            total, left = follow.get((), (0, 1.0))
            return (table[w] - d[min(table[w], 3)]) / max(total, 1) + left / max(total, 1) / (v + 1)
        table, d, follow = tables[level]
        low = p(level + 1, context[1:], w)
        if context not in follow:
            return low
        total, left = follow[context]
        k = table[(*context, w)]
        return (k - d[min(k, 3)]) / total + left / total * low

    for level in (0, 1):
        for context in list(tables[level][2])[:10]:
            assert abs(sum(p(level, context, w) for w in [*uni, object()]) - 1) < 1e-9
    return sorted((str(i), round(p(1, ("<s>",), w[1]) and sum(math.log10(p(1, ("<s>",), w[1]) if k == 1 else p(0, (w[k - 2], w[k - 1]), w[k])) for k in range(1, len(w))), 6)) for i, w in docs)


@pytest.mark.parametrize("kind", ["rare", "hot"])
def test_trigrams_against_brute_force(spark, monkeypatch, kind):
    r = random.Random(12)
    words = [f"W{int(r.paretovariate(0.7))}" for _ in range(6000)]
    rows = [(i, " ".join(words[r.randrange(5900) :][: r.randint(0, 90)] + ["very", "common"] * (i % 7))) for i in range(250)] + ODD
    monkeypatch.setattr(kneserney, "CHUNK_BYTES", 8000)
    monkeypatch.setattr(kneserney, "SHARD_TOKENS", 3000)
    docs = documents(spark, rows)
    seen = []
    layout = kneserney.Layout
    monkeypatch.setattr(kneserney, "Layout", lambda *a: seen.append(layout(*a)) or seen[-1])
    if kind == "rare":
        monkeypatch.setattr(kneserney, "HOT", 1.0)
    got = kneserney.score(docs, F.col("doc_id") % 4 != 0, order=3).collect()
    assert sorted((str(x.doc_id), round(x.score, 6)) for x in got) == brute_trigram(rows, lambda i: i is not None and i % 4 != 0)
    assert (len(seen[0].pairs) > 5) == (kind == "hot")
    low = {x.doc_id: x.score for x in kneserney.score(docs, F.col("doc_id") % 4 != 0).collect()}
    assert any(abs(x.score - low[x.doc_id]) > 1 for x in got)
    assert kneserney.score(docs.limit(0), F.lit(True), order=3).count() == 0
    with pytest.raises(ValueError):
        kneserney.score(docs, F.lit(True), order=1)


def test_query_uses_trigrams():
    assert queries.LM_ORDER == 3
