"""The DataFrame path: columns against kernels, batches, sinks and streams."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from docloom.functions import limits
from docloom.functions import markdown as md
from docloom.functions.limits import ConversionError, Options
from docloom.kernels import base, router
from docloom.kernels.layout import usable_text
from docloom.operators import batch
from docloom.operators.convert import convert, html_to_markdown, xml_to_markdown
from docloom.sources import files as sources
from docloom.sources import models
from docloom.streaming import ingest
from tests import fixtures as fx

TEXTS = ["", "a|b `c` *d* _e_ [f] <g> & \\", "x\r\ny\rz\n", "```` ``` ``", "مرحبا 😀 b", "\ufeffq", "12", "□??? ab", "a\u00a0b\u2003 c1"]


def files():
    return {
        "a.html": b"<h1>Hi</h1>", "b.csv": b"x,y\n1,2\n", "c.json": b'{"k":1}', "d.xml": b"<a/>", "e.docx": fx.docx(), "f.epub": fx.epub(), "g.pptx": fx.pptx(), "h.xlsx": fx.xlsx(), "i.xls": fx.xls(),
        "j.zip": fx.zip_files({"in.json": "[]"}), "k.pdf": fx.pdf([fx.lines((40, 700, "Hello World"))]), "l.JSON": b"{", "m.xlsx": b"text", "n.zip": fx.zip_files({"../x.json": "{}"}), "o.mp3": b"x",
    }


def table(spark, rows=None):
    return spark.createDataFrame([(n, d) for n, d in (rows or files()).items()], "name string, content binary")


def test_columns_agree_with_kernels(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i long, t string")
    md.register(spark)
    df.createOrReplaceTempView("t")
    got = df.select("i", "t", md.md_cell(F.col("t")).alias("cell"), md.md_heading(F.col("t")).alias("h"), md.md_text(F.col("t")).alias("b"), md.md_fence(F.col("t"), "x").alias("f"), md.usable_text(F.col("t")).alias("u"), md.decode_utf8(F.encode("t", "UTF-8")).alias("d")).collect()
    sql = {r.i: r for r in spark.sql("SELECT i, md_cell(t) AS cell, md_fence(t, 'x') AS f FROM t").collect()}
    for r in got:
        assert r.cell == base.cell(r.t) == sql[r.i].cell and r.h == base.heading(r.t) and r.b == base.body_text(r.t)
        if r.t is not None:
            assert r.f == base.fenced(r.t, "x") == sql[r.i].f and r.u == usable_text(r.t) and r.d == base.decode_text(r.t.encode())
    plan = spark.sql("SELECT md_cell(t) FROM t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Eval" not in plan
    rows = [[["a", "b"], ["1"]], [[]], [["x|y", None, "z"]], []]
    tables = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, r array<array<string>>").select("i", md.md_table(F.col("r")).alias("m")).collect()
    for r in tables:
        assert r.m == base.table(rows[r.i])


def test_names_formats_and_paths(spark):
    names = ["report.xlsx", "CON.csv", "../bad:name.csv", "com1.x", "a.b.c", ".hidden", "x" * 200, " . ", "noext", "tab\t.csv", "end. .txt", "csv", "A.HTM", "photo.JPeG", "x.", "a/b.zip"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r for r in df.select("n", md.output_name(F.col("n")).alias("o"), md.detect_format(F.col("n"), F.lit("text/csv")).alias("f"), md.unsafe_path(F.col("n")).alias("u")).collect()}
    want = {"report.xlsx": "report.md", "CON.csv": "_CON.md", "../bad:name.csv": ".._bad_name.md", "com1.x": "_com1.md", "a.b.c": "a.b.md", ".hidden": "document.md", "x" * 200: "x" * 100 + ".md", "noext": "noext.md", "tab\t.csv": "tab_.md", "end. .txt": "end.md", "x.": "x.md", "a/b.zip": "a_b.md"}
    assert {n: got[n].o for n in want} == want
    for n in names:
        try:
            fmt = limits.detect_format(n, "text/csv")
        except ConversionError:
            fmt = None
        assert got[n].f == fmt, n
    assert got["../bad:name.csv"].u and not got["a.b.c"].u
    paths = spark.createDataFrame([(p,) for p in ("", "../x", "/x", "C:/x", "a/../x", "a\\x", "a..b", "a/b")], "p string")
    assert [r.u for r in paths.select(md.unsafe_path(F.col("p")).alias("u")).collect()] == [True] * 6 + [False] * 2


def test_convert_agrees_with_kernels(spark):
    got = {r["name"]: r for r in convert(table(spark)).collect()}
    for name, data in files().items():
        row = got[name]
        try:
            result = router.convert(name, data)
            assert (row.state, row.markdown, row.warnings, row.error) == ("done", result.markdown, result.warnings, None), name
            assert row.bytes == len(result.markdown.encode())
        except ConversionError as e:
            assert (row.state, row.error.code, row.error.message, row.markdown) == ("error", e.code, e.message, None), name
    assert sorted(r.error.code for r in got.values() if r.error) == ["INVALID_JSON", "INVALID_SPREADSHEET", "UNSAFE_ARCHIVE", "UNSUPPORTED_FORMAT"]
    odd = spark.createDataFrame([("a.csv", None, 7), (None, b"x", 8), ("big.csv", b"x" * (limits.MAX_FILE_BYTES + 1), 9)], "name string, content binary, state_of int")
    rows = {r.state_of: r.error.code for r in convert(odd, spread=2).collect()}
    assert rows == {7: "INPUT_MISSING", 8: "UNSUPPORTED_FORMAT", 9: "FILE_TOO_LARGE"}
    pages = spark.createDataFrame([(1, "<p>a</p>"), (2, None)], "id long, html string")
    assert {r.id: (r.state, r.markdown) for r in html_to_markdown(pages).collect()} == {1: ("done", "a\n"), 2: ("error", None)}
    xml = xml_to_markdown(spark.createDataFrame([(1, b"<a/>"), (2, b"\xff")], "id long, content binary")).collect()
    assert [r.markdown for r in xml] == ["```xml\n<a/>\n```\n", None]
    shout = convert(table(spark, {"a.csv": b"x"}), kernels={"csv": lambda data, context: base.Result("LOUD")}).first()
    assert shout.markdown == "LOUD"


def test_batch_life(spark, tmp_path):
    store = batch.BatchStore(spark, str(tmp_path / "store"))
    first = store.stage(table(spark), Options(cache_hours=2), at=1000)
    assert store.status().collect()[0].asDict() == {"batch_id": first, "total": 15, "finished": 0, "errors": 0, "cancelled": 0, "state": "queued"}
    done = store.pending(first).where("name = 'b.csv'")
    early = done.select("job_id", "ordinal", "name", F.lit("done").alias("state"), F.lit("early").alias("markdown"), F.array().cast("array<string>").alias("warnings"), F.lit(None).cast("struct<code:string,message:string>").alias("error"), F.lit(5).cast("long").alias("bytes"), F.lit(2000).cast("long").alias("created_at"))
    early.write.mode("append").parquet(f"{store.root}/results/batch_id={first}")
    assert store.status().first().state == "interrupted" and store.pending(first).count() == 14
    store.run(first, at=3000)
    store.run(first, at=4000)
    assert store.status().first().asDict() == {"batch_id": first, "total": 15, "finished": 15, "errors": 4, "cancelled": 0, "state": "done"}
    ordered = store.in_order(first).collect()
    assert [r["name"] for r in ordered] == list(files()) and ordered[1].markdown == "early"
    assert store.stats().first()["count"] == 11 and store.inputs().count() == 0
    hour = 3_600_000
    assert store.outputs(at=2000 + hour - 1, hours=1).count() == 11 and store.outputs(at=2000 + hour, hours=1).count() == 10 and store.outputs(at=3000 + hour, hours=1).count() == 0
    shown = {r["name"]: (r.state, r.shown) for r in store.messages(at=2500 + hour, hours=1).collect()}
    assert shown["b.csv"][1] == "This result has expired." and shown["o.mp3"][0] == "error" and shown["a.html"][1] == "# Hi\n"
    second = store.stage(table(spark, {"z.csv": b"1"}), at=10)
    store.cancel(second, at=20)
    assert {r.batch_id: r.state for r in store.status().collect()} == {first: "done", second: "cancelled"}
    store.prune(at=2000 + hour, hours=1, budget=10_000_000)
    assert store.outputs(at=2000 + hour, hours=1).count() == 10 and store.results().count() == 15
    store.prune(at=10 + limits.ABANDONED_MS + 500, hours=720)
    assert [r.batch_id for r in store.jobs().select("batch_id").distinct().collect()] == [first]
    os.rename(f"{store.root}/results", f"{store.root}/results-new-x")  # a crash between the two renamings of prune
    assert batch.BatchStore(spark, store.root).results().count() == store.results().count() > 0
    store.clear()
    assert store.results().count() == 0


def test_batch_limits(spark):
    check = lambda rows, **k: batch.check_batch(spark.createDataFrame(rows, "name string, size long"), **k)
    for rows, want in (([], "EMPTY_BATCH"), ([("x", 1)] * 26, "TOO_MANY_FILES"), ([("x", -1)], "INVALID_FILE"), ([(None, 1)], "INVALID_FILE"), ([("x", limits.MAX_FILE_BYTES + 1)], "FILE_TOO_LARGE"), ([("x", limits.MAX_FILE_BYTES)] * 6, "BATCH_TOO_LARGE")):
        with pytest.raises(ConversionError) as e:
            check(rows)
        assert e.value.code == want
    check([("x", 1)] * 1000, max_files=None, max_bytes=None)
    large, bad, fine = ("z", 30 << 20), ("", 1), ("m", 1)
    for rows, want in (([large, bad], "FILE_TOO_LARGE"), ([fine, bad, large], "INVALID_FILE"), ([bad, large] * 13, "TOO_MANY_FILES"), ([("y", 25 << 20), ("a", 25 << 20)], "FILE_TOO_LARGE")):
        numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, name string, size long").repartition(4)
        with pytest.raises(ConversionError) as e:
            batch.check_batch(numbered, order="place")
        assert e.value.code == want and (rows[0][0] != "y" or str(e.value).startswith("y "))


def test_retention_is_greedy(spark):
    items = spark.createDataFrame([("a", 4, 60), ("b", 3, 50), ("c", 2, 30), ("d", 1, 10), ("e", 0, 1)], "job_id string, created_at long, bytes long")
    assert sorted(r.job_id for r in batch.retained(items, 100).collect()) == ["a", "c", "d"]
    assert sorted(r.job_id for r in batch.evicted_oldest_first(items, 200, 60).collect()) == ["a", "b", "c"][:2] + ["c"] * 1
    assert batch.retained(items, 0).count() == 0


def test_retention_by_key_against_a_loop(spark):
    import random

    r = random.Random(4)
    rows = [(i, r.randrange(5), r.randrange(40), r.choice([0, 1, 5, 30, 70, 200])) for i in range(400)]
    items = spark.createDataFrame(rows, "job_id long, owner int, created_at long, bytes long").repartition(7)
    want = set()
    for owner in range(5):
        used = 0
        for i, _, _, size in sorted((x for x in rows if x[1] == owner), key=lambda x: (-x[2], x[0])):
            if used + size <= 500:
                used += size
                want.add(i)
    assert {x.job_id for x in batch.retained(items, 500, ("owner",)).collect()} == want


def test_sql_functions_agree_with_columns(spark):
    md.register(spark)
    rows = spark.createDataFrame([("a|b.CSV", [["x", "y|_"], ["1"], []]), ("con.txt", [["*"]]), ("...", []), ("q:w?.pdf ", [["a", None]]), ("plain", [["r\ns"]])], "n string, t array<array<string>>")
    rows.createOrReplaceTempView("sql_functions_rows")
    got = spark.sql("SELECT md_table(t) AS t, md_output_name(n) AS o, md_detect_format(n, 'text/csv') AS f FROM sql_functions_rows").collect()
    want = rows.select(md.md_table(F.col("t")).alias("t"), md.output_name(F.col("n")).alias("o"), md.detect_format(F.col("n"), F.lit("text/csv")).alias("f")).collect()
    assert got == want


def test_save_never_overwrites(spark, tmp_path):
    out = spark.createDataFrame([(i, n, f"text {i}") for i, n in enumerate(["a.csv", "a.json", "b.csv", "a.xml"])], "ordinal long, name string, markdown string")
    taken = spark.createDataFrame([("b.md",), ("a (3).md",)], "file string")
    assert {r.ordinal: r.file for r in batch.numbered_names(out, taken=taken).collect()} == {0: "a.md", 1: "a (2).md", 2: "b (2).md", 3: "a (4).md"}
    clash = spark.createDataFrame([(0, "a.html"), (1, "a.html"), (2, "a (2).html"), (3, "b.x"), (4, "c (07).y"), (5, "c.y")], "ordinal long, name string")
    assert {r.ordinal: r.file for r in batch.numbered_names(clash, taken=spark.createDataFrame([("b.md",), ("b (3).md",), ("b (2).md",)], "file string")).collect()} == {0: "a.md", 1: "a (3).md", 2: "a (2).md", 3: "b (4).md", 4: "c (07).md", 5: "c.md"}
    many = spark.range(limits.SAVE_ATTEMPTS + 500).select(F.col("id").alias("ordinal"), F.lit("n.csv").alias("name"))
    got = [r.file for r in batch.numbered_names(many).orderBy("ordinal").collect()]
    assert got[:2] == ["n.md", "n (2).md"] and got[limits.SAVE_ATTEMPTS - 1] == f"n ({limits.SAVE_ATTEMPTS}).md" and set(got[limits.SAVE_ATTEMPTS :]) == {None}
    named = batch.numbered_names(out)
    batch.save_markdown(named, str(tmp_path))
    assert {n: (tmp_path / n).read_text() for n in sorted(os.listdir(tmp_path))} == {"a.md": "text 0", "a (2).md": "text 1", "b.md": "text 2", "a (3).md": "text 3"}
    with pytest.raises(Exception):
        batch.save_markdown(named, str(tmp_path))


def test_sources_and_streaming(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    for name, data in list(files().items())[:5]:
        (folder / name).write_bytes(data)
    read = sources.read_files(spark, str(folder))
    assert {r["name"]: r["size"] for r in read.select("name", "size").collect()} == {n: len(d) for n, d in list(files().items())[:5]}
    assert "LessThanOrEqual(length" in sources.read_files(spark, str(folder), largest=100)._jdf.queryExecution().executedPlan().toString()
    assert sources.size_report(read).first().asDict() == {"files": 5, "bytes": sum(len(d) for d in list(files().values())[:5]), "too_large": 0}
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest.start(spark, str(folder), target, state).awaitTermination()
    assert ingest.results(spark, target).count() == 5
    (folder / "sub" / "l.json").write_bytes(b"{")
    ingest.start(spark, str(folder), target, state).awaitTermination()
    got = {r["name"]: r.state for r in ingest.results(spark, target).collect()}
    assert len(got) == 6 and got["l.json"] == "error" and ingest.results(spark, target).count() == 6


def test_models(spark, tmp_path):
    from hashlib import sha256

    (tmp_path / "det").write_bytes(b"abc")
    (tmp_path / "bad").write_bytes(b"abd")
    catalogue = [models.Model("det", 3, sha256(b"abc").hexdigest()), models.Model("bad", 3, sha256(b"abc").hexdigest(), "en"), models.Model("big", limits.MODEL_BYTES + 1, "", "ar")]
    got = models.load_models(spark, str(tmp_path), catalogue)
    assert {r.id: r.content for r in got.collect()} == {"det": b"abc", "bad": None}
    assert models.model_stats(got).first().asDict() == {"count": 2, "bytes": 6} and models.supported(got, catalogue[:1]).count() == 1
    assert [m.id for m in models.model_set(catalogue, "en")] == ["det", "bad"]
    for model, data, want in ((catalogue[0], None, "MODEL_UNAVAILABLE"), (catalogue[1], b"abd", "MODEL_INTEGRITY"), (catalogue[2], b"", "MODEL_BUDGET")):
        with pytest.raises(ConversionError) as e:
            models.check_model(model, data)
        assert e.value.code == want
    assert models.check_model(catalogue[0], b"abc") == b"abc"


def test_table_functions_and_scalars(spark):
    from docloom.functions import scalars, udtfs

    udtfs.register(spark)
    df = spark.createDataFrame([(1, 'a,b\n"c', '<a href="/x">t</a><a href="javascript:1">u</a>', fx.zip_files({"p.txt": "hi", "q/r.txt": ""})), (2, "a,b\nc", "", b"no")], "id int, csv string, html string, zip binary")
    df.createOrReplaceTempView("u")
    assert [tuple(r) for r in spark.sql("SELECT id, c.* FROM u, LATERAL csv_rows(csv) c ORDER BY id, row_no").collect()] == [(1, None, None, "INVALID_CSV"), (2, 0, ["a", "b"], None), (2, 1, ["c"], None)]
    assert [tuple(r) for r in spark.sql("SELECT l.* FROM u, LATERAL html_links(html) l ORDER BY link_no").collect()] == [(0, "/x", "/x", "t"), (1, "javascript:1", "", "u")]
    got = spark.sql("SELECT id, z.name, z.bytes, z.content, z.error FROM u, LATERAL zip_entries(zip) z ORDER BY id, entry_no").collect()
    assert [(r.id, r["name"], r.bytes, r.error) for r in got] == [(1, "p.txt", 2, None), (1, "q/r.txt", 0, None), (2, None, None, "UNSAFE_ARCHIVE")]
    texts = spark.createDataFrame([("ﬁne  text", "fine text"), ("abcd", "abxd")], "a string, b string")
    assert [r.r for r in texts.select(scalars.character_error_rate(F.col("a"), F.col("b")).alias("r")).collect()] == [0.0, 0.25]
    assert scalars.memory_budget(None) == 512 * limits.MIB and scalars.memory_budget(64) == 1024 * limits.MIB and scalars.memory_budget(4) == int(614.4 * limits.MIB)
    with pytest.raises(ConversionError):
        scalars.memory_budget(2)


def test_clean_removes_what_was_materialized(spark):
    from docloom import session

    kept = list(session._written)
    session._written.clear()
    df = session.materialize(spark.range(3), "t")
    assert df.count() == 3
    path = session._written[0]
    session.clean(spark)
    assert not os.path.exists(path)
    session._written.extend(kept)


def test_store_of_settings_labels_and_states(spark, tmp_path):
    store = batch.BatchStore(spark, str(tmp_path / "s"))
    key = store.stage(table(spark, {"a.csv": b"x", "b.csv": b"y"}), at=5)
    assert store.update(key, "mine", at=9) and not store.update("nothing", "x")
    assert store.batches().first().asDict() == {"batch_id": key, "created_at": 5, "updated_at": 9, "label": "mine"}
    store._running.add(key)
    assert store.status().first().state == "running" and batch.BatchStore(spark, store.root).status().first().state == "queued"
    store._running.clear()
    seen = spark.sparkContext.accumulator(0)
    assert convert(table(spark, {"a.csv": b"x", "b.json": b"1"}), report=lambda stage: seen.add(1)).count() == 2
    convert(table(spark, {"a.csv": b"x", "b.json": b"1"}), report=lambda stage: seen.add(1)).collect()
    assert seen.value >= 2
    later = batch.BatchStore(spark, store.root, prune_hours=1)  # the batch was staged in 1970
    assert later.jobs().count() == 0
    settings = batch.SettingsStore(spark, store.root)
    assert settings.load() == Options()
    assert settings.save(cache_hours=5) == Options(cache_hours=5) and settings.save(ocr_language="ar").cache_hours == 5
    with pytest.raises(ValueError):
        settings.save(cache_hours=0)
    assert settings.load() == Options(cache_hours=5, ocr_language="ar")


def test_model_store(spark, tmp_path):
    from hashlib import sha256

    model = lambda name, data: models.Model(name, len(data), sha256(data).hexdigest())
    catalogue = [model("a", b"x" * 40), model("b", b"y" * 50), model("c", b"z" * 30)]
    store = models.ModelStore(spark, str(tmp_path), catalogue)
    assert store.get(catalogue[0], 0) is None
    for at, (m, data) in enumerate(zip(catalogue, (b"x" * 40, b"y" * 50, b"z" * 30), strict=True)):
        store.put(m, data, at, budget=100)
    assert sorted(r.id for r in store.records().collect()) == ["b", "c"] and store.get(catalogue[1], 5) == b"y" * 50
    hour = 3_600_000
    assert store.get(catalogue[1], 1 + 24 * hour) is None and store.get(catalogue[2], 1 + 24 * hour) == b"z" * 30
    with pytest.raises(ConversionError):
        store.put(catalogue[0], b"wrong", 9)
    store.prune(at=5, budget=60)
    assert [r.id for r in store.records().collect()] == ["c"]
    models.ModelStore(spark, str(tmp_path), catalogue[:2]).prune(at=5)
    assert store.records().count() == 0
    store.clear()


def test_units(spark):
    rows = ["abc", "a\U0001f600b", "\U0001f600\U0001f600", "", "abcdef"]
    got = [r.u for r in spark.createDataFrame([(x,) for x in rows], "t string").select(md.left_units(F.col("t"), 3).alias("u")).collect()]
    assert got == [limits.left_units(x, 3) for x in rows] == ["abc", "a\U0001f600", "\U0001f600\ufffd", "", "abc"]
