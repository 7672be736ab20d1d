import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.llm import mixing
from tests.llm.helpers import ODD, documents, words

def levels():
    return {"domain": F.substring("source", 1, 1), "source": F.col("source")}



def brute_fill(children, budget):
    """Shares by weight; whoever is full leaves, and the rest share again."""
    alloc, left = {}, dict(children)
    while left:
        whole = sum(w for w, _ in left.values())
        full = {k: c for k, (w, c) in left.items() if c <= budget * w / whole + 1e-9} if whole else {k: 0 for k in left}
        if not full:
            return alloc | {k: budget * w / whole for k, (w, _) in left.items()}
        for k, c in full.items():
            alloc[k] = c
            budget -= c
            del left[k]
    return alloc


@pytest.mark.parametrize("share,epochs", [(0.5, 2), (0.9, 1), (1.7, 2), (0.0, 1)])
def test_against_brute_force(spark, share, epochs):
    r = random.Random(3)
    rows = [(i, words(i, r.randint(0, 30)), "en", r.choice(["a1", "a2", "b1", "b2", "b2", "b2", "c1"])) for i in range(300)] + [(i, t, None, None) for i, t in ODD]
    weights = {("a",): 5.0, ("c",): 9.0, ("b", "b1"): 3.0}
    tokens = lambda t: len((t or "").split())
    leaves = defaultdict(list)
    for i, t, _, s in rows:
        s = s or "(null)"
        leaves[(s[0] if s != "(null)" else "(null)", s)].append((i, tokens(t)))
    budget = int(sum(n for d in leaves.values() for _, n in d) * share)
    cap = {k: epochs * sum(n for _, n in d) for k, d in leaves.items()}
    top = brute_fill({a: (weights.get((a,), 1.0), sum(c for k, c in cap.items() if k[0] == a)) for a in {k[0] for k in cap}}, budget)
    want = []
    for a, given in top.items():
        for leaf, alloc in brute_fill({k: (weights.get(k, 1.0), c) for k, c in cap.items() if k[0] == a}, given).items():
            left = int(alloc + 1e-6)
            for e in range(epochs):
                order = sorted(leaves[leaf], key=lambda x: (hashlib.md5(f"17:{e}:{'null' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))
                whole = sum(n for _, n in order)
                if whole and left >= whole:
                    want += [(str(i), *leaf, e, n) for i, n in order]
                    left -= whole
                    continue
                for i, n in order:
                    if n > left:
                        break
                    left -= n
                    want.append((str(i), *leaf, e, n))
                break
    got = mixing.mix(documents(spark, rows), levels(), weights, share=share, max_epochs=epochs).collect()
    assert sorted((str(x.doc_id), x.domain, x.source, x.epoch, x.n_tokens) for x in got) == sorted(want)


def test_many_buckets_and_empty(spark, monkeypatch):
    docs = documents(spark, [(i, words(i, 1 + i % 7), "en", "a1") for i in range(500)])
    whole = sorted(map(tuple, mixing.mix(docs, levels()).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert sorted(map(tuple, mixing.mix(docs, levels()).collect())) == whole
    assert mixing.mix(docs.limit(0), levels()).count() == 0
    kept = mixing.mix(docs, levels(), keep=("text", "shard")).first()
    assert kept.text is not None and kept["shard"] == 99
