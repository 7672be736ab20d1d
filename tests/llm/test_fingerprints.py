import hashlib
import random

from docloom.llm import fingerprints
from tests.llm.helpers import ODD, documents, words


def test_pairs(spark, monkeypatch):
    rows = [(3 * i, words(i, 20 + i % 200, 500)) for i in range(150)] + [(7, "a b c"), (8, "a b c"), (10, "a " * 300), (-5, "z"), *ODD]
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 16)
    got = fingerprints.fingerprint_pairs(documents(spark, rows)).collect()
    tie = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), tie[x[1]], x[1]))
    want = []
    for k, (i, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        cut = len(t) // 3
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    text = {}
    for i, t in rows:
        text.setdefault(i, t or "")
    by_text = {}
    for r in got:
        assert by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in got if r.n_chars > 500 and r.doc_id != 10]
    assert sum(r.near_edited for r in long) / len(long) > 0.2 > sum(r.near_next for r in long) / len(long)
    assert fingerprints.fingerprint_pairs(documents(spark, rows).limit(0)).count() == 0
    alone = fingerprints.fingerprint_pairs(documents(spark, [(1, "p q r s t u")])).first()
    assert alone.near_next == 1.0


def test_against_brute_force(spark):
    """The entries by the definition, with the engine's own hash of k-mers."""
    r = random.Random(7)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 80))) for _ in range(60)] + ["x y z x y z x y z x y z", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.fingerprint for x in fingerprints.fingerprint(df).collect()}

    def xx(columns, rows):
        names = [f"c{k}" for k in range(columns[1])]
        kind = columns[0]
        frame = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], "n long, " + ", ".join(f"{c} {kind}" for c in names))
        from pyspark.sql import functions as F

        return [x.h for x in frame.select("n", F.xxhash64(*names).alias("h")).orderBy("n").collect()]

    k = fingerprints.K
    grams = [[tuple((t.split() + [None] * k)[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))] if t.split() else [] for t in texts]
    flat = sorted({g for d in grams for g in d}, key=str)
    h = dict(zip(flat, xx(("string", k), flat)))
    numbered = []
    for d in grams:
        seen, own = {}, []
        for i, g in enumerate(d):
            key = (h[g] % (1 << 64)) >> 64 - fingerprints.KMER_BITS
            own.append((key, seen.setdefault(key, 0), i, h[g]))
            seen[key] += 1
        numbered.append(own)
    flat2 = sorted({(a, b) for d in numbered for a, b, *_ in d})
    import pyspark.sql.functions as F

    frame = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(flat2)], "n long, a long, b int")
    h2 = dict(zip(flat2, [x.h % (1 << 64) for x in frame.select("n", F.xxhash64("a", "b").alias("h")).orderBy("n").collect()]))
    entries, tuples = [], []
    for n, d in enumerate(numbered):
        bins = {}
        for a, b, i, g in d:
            v = h2[a, b]
            bins.setdefault(v >> 58, []).append(((v >> 58 - fingerprints.RANK_BITS) & ((1 << fingerprints.RANK_BITS) - 1), i, g))
        chosen = [(b, sorted([x[1:] for x in sorted(own)[: fingerprints.TUPLE]])) for b, own in sorted(bins.items())]
        for k, (b, least) in enumerate(chosen):
            if len(least) == 1 and len(chosen) > 1:
                least = sorted([*least, chosen[(k + 1) % len(chosen)][1][0]])
            tuples.append(([g for _, g in least] + [None])[: fingerprints.TUPLE])
            entries.append((n, b))
    hashes = xx(("bigint", fingerprints.TUPLE), tuples)
    want = {n: "" for n in range(len(texts))}
    for (n, b), x in zip(entries, hashes):
        want[n] += f"{b:02X}{(x % (1 << 64)) >> 32:08X}"
    assert got == want


def test_buckets_whatever_ids_are_like(spark, monkeypatch):
    """Bounded buckets for an outlier, an id that half of the rows have, and nulls; their order is that of the rows."""
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 20)
    monkeypatch.setattr(fingerprints, "REGIONS", 16)
    r = random.Random(3)
    rows = [(r.choice([77] * 5 + [None] * 2 + [10**15, -(2**63), 2**63 - 1] + [r.randrange(3000) for _ in range(5)]), words(i, 8)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = fingerprints._with_buckets(docs).collect()
    assert len(got) == 2000
    size, ids = {}, {}
    for x in got:
        size[x.bucket] = size.get(x.bucket, 0) + 1
        ids.setdefault(x.id, set()).add(x.bucket)
    assert max(size.values()) <= 2 * 2000 / 16 and len(size) > 50  # an id of less than two regions' rows stays whole
    assert len(ids[77]) > 15 and max(size[b] for b in ids[77]) < 50 and len(ids[None]) > 5 and max(size[b] for b in ids[None]) < 50
    ordered = sorted(got, key=lambda x: (x.id is None, -(x.id or 0), x.tie))
    assert [x.bucket for x in ordered] == sorted((x.bucket for x in got), reverse=True)
    near = fingerprints._neighbours(docs)
    assert near.where("guest = 0").count() == 2000 and near.where("guest = 1").count() == len(size)


def test_order_counts_in_short_texts(spark):
    """Passages of a text of 40 words that change places: the sets of k-mers are nearly the same, the fingerprint is not."""
    rows = []
    for i in range(60):
        w = words(i, 40, 10**6).split()
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[20:] + w[:20]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: x.fingerprint for x in fingerprints.fingerprint(df).collect()}
    cut = lambda f: {f[k : k + 10] for k in range(0, len(f), 10)}
    same = [len(cut(found[2 * i]) & cut(found[2 * i + 1])) / len(cut(found[2 * i])) for i in range(60)]
    assert sum(same) / 60 < 0.6 and all(found[2 * i] != found[2 * i + 1] for i in range(60))
