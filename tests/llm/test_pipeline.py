import os

import pytest

import corpus_pipeline
from docloom.llm import jaccard, langid, toxicity
from docloom.session import table
from tests.llm.helpers import ODD, documents, words

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_stages(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    seen = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == columns
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        if name == "jaccard_join":
            left = jaccard.join(out)
            assert left.where("component_id <> doc_id").count() == 0
        seen.append(out.count())
        docs = out
    assert seen == sorted(seen, reverse=True) and seen[1] >= 0.95 * seen[0] and seen[-1] == seen[-2] > 0
    assert docs.where("not round_trip").count() == 0
    ids = sorted(r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in docs.select("doc_id").collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_stages_on_odd_rows(spark):
    """Nulls in every column, blanks, repeated rows, columns with clashing names, and no rows at all."""
    rows = [(i, words(i, 5 + i % 40)) for i in range(40)] + ODD + [(50, words(1, 30), None, None), (51, words(1, 30), "en", "x y")]
    docs = documents(spark, rows).selectExpr("*", "1 AS epoch", "'q' AS n_tokens", "2 AS id", "3 AS component_id", "4 AS row", "CAST(NULL AS INT) AS nothing", "5 AS `a.b`", "6 AS `c d`")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.schema.names == docs.schema.names, name
            kept = out.collect()
            assert len(kept) <= len(rows)
            if name == "jaccard_join":
                assert sum(r.doc_id is None for r in kept) == 1 and sum(r.doc_id == 50 for r in kept) == 1 and not [r for r in kept if r.doc_id == 51]
        else:
            assert out.where("not round_trip").count() == 0 and out.count() == len(rows)
        nothing = stage(spark, docs.limit(0), DATA)
        assert nothing.count() == 0, name


def test_near_duplicates_go_by_row(spark):
    """Of exact repeats one stays; an id's other text stays when one of its texts is a copy."""
    rows = [(1, words(1, 40)), (2, words(1, 40)), (2, words(2, 40)), (3, words(3, 40)), (3, words(3, 40)), (3, words(3, 40)), (4, words(3, 40)), (5, ""), (None, words(1, 40))]
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), DATA).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", words(1, 40)), ("2", words(2, 40)), ("3", words(3, 40)), ("5", ""), ("None", words(1, 40))])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_run_against_brute_force(spark):
    """All stages in plain loops over the rows, a text at a time; only what is learned comes from the operators."""
    import hashlib
    import re
    from collections import defaultdict

    import pyarrow as pa

    from docloom.llm import pieces, queries
    from tests.llm.test_jaccard import brute
    from tests.llm.test_mixing import brute_fill

    docs = table(spark, DATA, "documents")
    rows = docs.collect()
    model = langid.learn(docs, queries.remainder(5) != 0)

    def identified(text):
        _, chosen, fit = langid.infer(model, pa.array([text]))
        return bool(chosen[0].any()) and fit[0] > 0

    rows = [r for r in rows if identified(r.text)]
    judge = toxicity.learn(spark.createDataFrame(rows, docs.schema), table(spark, DATA, "labels"), queries.remainder(5) != 0)
    rows = [r for r in rows if judge.score(pa.array([r.text], pa.string()))[0] < 0.5]
    component = {i: c for i, _, c in brute([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if component[str(r.doc_id)] == str(r.doc_id)]

    leaves = defaultdict(list)
    for r in rows:
        number = re.search(r"(\d{1,9})$", r.source or "")
        path = (f"domain{int(number[1]) % 4 if number else 0}", r.lang or "(null)", r.source or "(null)")
        leaves[path].append((hashlib.md5(f"17:0:{r.doc_id}".encode()).hexdigest(), len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r))
    cap = {k: sum(n for _, n, _ in d) for k, d in leaves.items()}

    def spread(prefix, given):
        children = {k[: len(prefix) + 1] for k in cap if k[: len(prefix)] == prefix}
        got = brute_fill({c: (queries.MIX_WEIGHTS.get(c, 1.0), sum(n for k, n in cap.items() if k[: len(c)] == c)) for c in children}, given)
        return got if len(prefix) == 2 else {k: v for c, alloc in got.items() for k, v in spread(c, alloc).items()}

    taken = []
    for path, alloc in spread((), int(sum(cap.values()) * corpus_pipeline.MIX_SHARE)).items():
        left = int(alloc + 1e-6)
        for _, n, r in sorted(leaves[path], key=lambda x: x[:2]):
            if n > left:
                break
            left -= n
            taken.append(r)
    codec = pieces.Codec(pieces.Pieces.parse(queries.pieces_model(spark)))
    want = {r.doc_id: codec.encode([r.text or ""])[1].tolist() for r in taken}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id: r.token_ids for r in got} == want and len(got) == len(taken) > 50
    text = {r.doc_id: r.text for r in taken}
    assert all(r.round_trip and codec.decode(r.token_ids) == text[r.doc_id] for r in got)
