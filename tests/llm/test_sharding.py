import itertools
import random
import zlib

from pyspark.sql import functions as F

from docloom.llm import queries
from docloom.llm.sharding import even, min_cost_flow, reshard, rewrite, rewrite_affected, stay_or_move
from tests.llm.helpers import ODD, documents, words


def test_flow_is_cheapest():
    r = random.Random(2)
    for _ in range(40):
        n, m = r.randint(1, 3), r.randint(1, 3)
        supply = [r.randint(0, 3) for _ in range(n)]
        capacity = [r.randint(0, 4) for _ in range(m)]
        if sum(supply) > sum(capacity):
            continue
        cost = [[r.randint(0, 3) for _ in range(m)] for _ in range(n)]
        flow = min_cost_flow(supply, capacity, cost)
        assert [sum(x) for x in flow] == supply and all(sum(c) <= k for c, k in zip(zip(*flow), capacity))
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        best = min((sum(cost[i][j] for i, j in zip(units, to)) for to in itertools.product(range(m), repeat=len(units)) if all(to.count(j) <= capacity[j] for j in range(m))), default=0)
        assert sum(f * c for a, b in zip(flow, cost) for f, c in zip(a, b)) == best


def test_sparse_flow_costs_what_the_full_one_does():
    r = random.Random(3)
    for _ in range(60):
        n, m = r.randint(1, 6), r.randint(1, 6)
        supply, capacity = [r.randint(0, 9) for _ in range(n)], [r.randint(0, 12) for _ in range(m)]
        if sum(supply) > sum(capacity):
            continue
        full = min_cost_flow(supply, capacity, [[int(i != j) for j in range(m)] for i in range(n)])
        found = stay_or_move(supply, capacity)
        assert [sum(a for i, _, a in found if i == k) for k in range(n)] == supply and all(sum(a for _, j, a in found if j == k) <= c for k, c in enumerate(capacity))
        assert sum(a for i, j, a in found if i != j) == sum(full[i][j] for i in range(n) for j in range(m) if i != j)
        assert len(found) <= 2 * n + m and all(a > 0 for *_, a in found)


def test_reshard(spark, tmp_path):
    rows = [(i, words(i, 1 + i % 50)) for i in range(600)] + [x for x in ODD if len(x[1] or "") < 1000]
    docs = documents(spark, rows)
    old = F.pmod(F.xxhash64("doc_id"), F.lit(4)).cast("int")
    got = reshard(docs, old, 4, 6).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(6)]
    assert max(sizes) - min(sizes) <= 2 * max(x[1] for x in want)
    for s in range(6):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    stay = sum(r["size"] for r in got if r.shard == r.old_shard)
    olds = [sum(r["size"] for r in got if r.old_shard == s) for s in range(4)]
    assert stay >= 0.97 * sum(min(a, b) for a, b in zip(olds, even(sum(olds), 6)))
    assert reshard(docs.limit(0), old, 4, 6).count() == 0

    small = docs.where("doc_id < 600").select("doc_id", "text", old.alias("old_shard"))
    moves = reshard(small, F.col("old_shard"), 4, 6).select("doc_id", "old_shard", "shard", "slot")
    touched = rewrite_affected(small.select("doc_id", "text"), moves, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.shard for r in back.select("shard").distinct().collect()} == set(touched)
    assert back.count() == moves.where(F.col("shard").isin(touched)).count()


def text_of(rows):
    return sorted((str(r.doc_id), r.text or "", r.lang) for r in rows)


def test_rewrite(spark, tmp_path):
    rows = [(i % 500 if i % 9 else None, words(i, 1 + i % 50)) for i in range(600)] + ODD
    docs = documents(spark, rows).drop("shard")
    old, path = F.pmod(F.xxhash64("doc_id"), F.lit(4)).cast("int"), str(tmp_path / "out")
    docs.withColumn("shard", old).write.partitionBy("shard").parquet(path)
    want = sorted(map(str, reshard(docs, old, 4, 6).select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot").collect()))
    got = rewrite(docs, old, 4, 6, path)
    assert sorted(map(str, got.select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot").collect())) == want
    files = spark.read.parquet(path)
    assert text_of(files.collect()) == text_of(docs.collect())  # the old files are gone: no row twice
    touched = {s for r in got.collect() if r.shard != r.old_shard for s in (r.shard, r.old_shard)}
    written = sorted((r.shard, r.slot) for r in files.collect() if r.slot is not None)  # an untouched shard's old files have no slot
    assert written == sorted((r.shard, r.slot) for r in got.collect() if r.shard in touched) and {0, 4, 5} <= touched
    # To fewer shards: those that end empty lose their files; from the files themselves.
    now = spark.read.parquet(path).select("doc_id", "text", "lang", F.col("shard").alias("was"))
    rewrite(now, F.col("was"), 6, 2, path).collect()
    files = spark.read.parquet(path)
    assert text_of(files.collect()) == text_of(docs.collect()) and {r.shard for r in files.select("shard").distinct().collect()} == {0, 1}
    assert rewrite(docs.limit(0), old, 4, 6, str(tmp_path / "none")).count() == 0
    # Nothing moves: nothing is written, all rows are still returned.
    assert rewrite(docs, F.lit(0), 1, 1, str(tmp_path / "none")).count() == len(rows) and not (tmp_path / "none").exists()


def test_rewrite_affected_keeps_every_row_once(spark, tmp_path):
    rows = [(i % 500 if i % 9 else None, words(i, 1 + i % 50)) for i in range(600)]
    docs, path = documents(spark, rows).select("doc_id", "text", "lang"), str(tmp_path / "out")
    old = F.pmod(F.xxhash64("doc_id"), F.lit(4)).cast("int")
    docs.withColumn("shard", old).write.partitionBy("shard").parquet(path)
    moves = reshard(docs, old, 4, 6)
    touched = set(rewrite_affected(docs, moves, path))
    files = spark.read.parquet(path)
    assert text_of(files.collect()) == text_of(docs.collect())
    written = sorted((r.shard, r.slot) for r in files.collect() if r.slot is not None)
    assert written == sorted((r.shard, r.slot) for r in moves.collect() if r.shard in touched) and {4, 5} <= touched


def test_query_writes_files(spark, tmp_path, monkeypatch):
    rows = [(i, words(i, 1 + i % 50)) for i in range(300)]
    documents(spark, rows).drop("shard").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries, "scratch", lambda *_: str(tmp_path / "shards"))
    got = queries.op8_sharding(spark, str(tmp_path)).collect()
    files = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.shard, r.slot) for r in files) and len(got) == 300
