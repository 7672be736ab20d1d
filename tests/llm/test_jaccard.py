import random
import re

import numpy as np
import pytest

from docloom.llm import jaccard
from tests.llm.helpers import ODD, documents


def brute(rows):
    sets = []
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and sets[a][0] is not None and sets[b][0] is not None and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None and s:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), len(s), str(i if not s or i is None else least[find(k)])) for k, (i, s) in enumerate(sets))


def corpus(seed, n=260):
    """Chains of copies with growing edits, boilerplate that many share, and short texts."""
    r = random.Random(seed)
    boiler = [f"b{k}" for k in range(40)]
    rows = []
    while len(rows) < n:
        w = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 6, 20, 60, 150]))]
        if r.random() < 0.4:
            at = r.randrange(len(w) + 1)
            w[at:at] = boiler
        for _ in range(r.choice([1, 1, 2, 12])):
            rows.append((len(rows) * 3 % 1009, " ".join(w)))
            w = w[:]
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return rows


@pytest.mark.parametrize("seed,tile,block", [(1, 1024, 256), (2, 5, 4)])
def test_against_brute_force(spark, monkeypatch, seed, tile, block):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FREQUENT", 1 / 40)
    rows = corpus(seed) + ODD + [(2000, "A b C d E f"), (2000, "a b c d e f g")]
    got = jaccard.join(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_empty_and_alone(spark):
    docs = documents(spark, [(1, "p q r s t u v"), (2, None)])
    assert sorted(map(tuple, jaccard.join(docs).collect())) == [(1, 3, 1), (2, 0, 2)]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_trie_links_are_exact():
    r = random.Random(12)
    for _ in range(30):
        base = [np.unique(np.array([r.randrange(60) for _ in range(r.randint(1, 40))], np.uint64)) for _ in range(6)]
        sets = list({tuple(np.setdiff1d(b, np.array([r.randrange(60) for _ in range(r.randint(0, 8))], np.uint64)).tolist()): 1 for b in base for _ in range(6)})
        sets = [np.array(s, np.uint64) for s in sets if s]
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(len(sets)):
            for b in range(a):
                o = len(np.intersect1d(sets[a], sets[b]))
                if jaccard.alike(o, len(sets[a]), len(sets[b])):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
        assert jaccard.trie_links(sets).tolist() == [find(i) for i in range(len(sets))]


def test_components(spark):
    r = random.Random(13)
    edges = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(500, i) for i in range(200, 230)]
    got = {x.node: x.component for x in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in list(parent)}
