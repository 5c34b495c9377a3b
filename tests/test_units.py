import datetime
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from mnemis.functions import chunker, embed, quant
from mnemis.functions import text as tx
from mnemis.operators import fingerprint as fp
from mnemis.operators import entries, knowledge, linalg, search, sessions, store
from mnemis.plans import queries as plans
from mnemis.sources import eng, state_blob
from mnemis.streaming import history as live


def _row(**more):
    rng = np.random.default_rng(1)
    return {"vec_perdoc": rng.standard_normal(6), "vec_fcdb": rng.standard_normal(6), "joint_center": rng.standard_normal(128), "cache_id": "é" * 40, "task_description": "d" * 300, "model_id": "m", "layer_lo": 8, "layer_hi": 200} | more


def test_certificate():
    data = eng.encode(_row(vec_fourier=[1, 2], vec_fourier_v2=[3.0], confusion_flag=True))
    back = eng.decode(data)
    assert np.allclose(back["vec_perdoc"], _row()["vec_perdoc"], atol=2e-3) and back["vec_fourier"] == [1, 2] and back["vec_fourier_v2"] == [3]
    assert back["confusion_flag"] and back["layer_hi"] == 127 and back["task_description"] == "d" * 256 and back["cache_id"] == "é" * 32
    plain = eng.decode(eng.encode(_row()))
    assert plain["vec_fourier"] is None and not plain["confusion_flag"]
    for bad in (b"XXXX" + data[4:], data[:4] + b"\x63" + data[5:], data[:20], data[:150]):
        with pytest.raises((ValueError, struct.error)):
            eng.decode(bad)


def test_certificate_first_form():
    data = eng.encode(_row())
    old = eng.decode(data[: eng._HEAD.size] + data[eng._HEAD.size + eng._EXTRA.size :])
    assert old["cache_id"] == "é" * 32 and old["vec_fourier"] is None


def test_certificate_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.eng").write_bytes(eng.encode(_row(cache_id="x")))
    (tmp_path / "y.eng").write_bytes(b"broken")
    spark.dataSource.register(eng.EngDataSource)
    for df in (spark.read.format("eng").load(str(tmp_path)), eng.read_binary(spark, str(tmp_path))):
        rows = {r["cache_id"]: r for r in df.collect()}
        assert rows["x"]["corrupt"] is None and rows[None]["corrupt"]


@pytest.mark.parametrize("turned", [False, True])
def test_state_blob(spark, tmp_path, turned):
    rng = np.random.default_rng(2)
    parts = [(rng.standard_normal((2, 3, 5, 4)), rng.standard_normal((2, 3, 5, 4))), (rng.standard_normal((1, 2, 4, 8)), rng.standard_normal((1, 2, 4, 8)))]
    data = state_blob.encode(parts, turned)
    (tmp_path / "b.bin").write_bytes(data)
    cells = state_blob.cells_of(spark.read.format("binaryFile").load(str(tmp_path)), [state_blob.Section(3, 4), state_blob.Section(2, 8)])
    for r in cells.collect():
        want = parts[r["section"]][r["kind"] == "V"][r["layer"], r["head"], r["cell"]]
        assert np.allclose(r["vec"], want, atol=2e-3)
    one = state_blob.encode(parts[:1], False)
    assert len(one) == state_blob.estimate_size(2, 3, 5, 4)
    for bad in (one[:100], struct.pack("<I", 999) + one[4:], one[:9] + struct.pack("<I", 2) + one[13:]):
        with pytest.raises((ValueError, struct.error)):
            list(state_blob.decode(bad, [state_blob.Section(3, 4)]))


def test_chunks():
    assert chunker.chunks(" \n ") == [] and chunker.chunks("# a\n\nb") == [chunker.Chunk(0, 6, ())]
    text = "# A\n\n" + "x" * 1500 + "\n\n## B\n\n" + "y" * 1500 + "\n\n" + "z" * 1500 + "\n\n\n\n### C\n" + "w" * 900
    out = chunker.chunks(text, 2000)
    assert all(a.end == b.start for a, b in zip(out, out[1:])) and (out[0].start, out[-1].end) == (0, len(text))
    assert [c.headers for c in out][0] == ("# A",) and ("# A", "## B", "### C") in [c.headers for c in out] and all(c.end - c.start <= 2000 for c in out)
    tiny = chunker.chunks("# A\nx\n# B\ny\n# C\nz", 15)
    assert len(tiny) == 2 and tiny[0].headers == ("# A",)
    assert len(chunker.chunks("v" * 3000, 2000)) == 1


def test_names(spark):
    df = spark.createDataFrame([("a/FORMAT_SPEC v1.md", 0, 3), ("coding--style!.md", 1, 1)], "p string, i int, n int")
    out = df.select(tx.slug(F.col("p")).alias("s"), tx.file_name(tx.slug(F.col("p")), F.lit("2026-01-02"), F.col("i"), F.col("n"), F.lit("0930")).alias("f")).collect()
    assert [tuple(r) for r in out] == [("format-spec-v1", "format-spec-v1_001_2026-01-02_0930.eng"), ("coding-style", "coding-style_2026-01-02_0930.eng")]


def test_fourier_matches_numpy(spark):
    x = np.random.default_rng(3).standard_normal((8, 4))
    long = spark.createDataFrame([(1, layer, d, float(x[layer, d])) for layer in range(8) for d in range(4)], "id long, layer long, dim int, x double")
    amp = np.abs(np.fft.rfft(x, axis=0))
    got = {(r["freq"], r["dim"]): r["x"] for r in fp.fourier(long, [0, 1], 8).collect()}
    for f in (0, 1):
        assert np.allclose([got[f, d] for d in range(4)], amp[f] / np.linalg.norm(amp[f]))
    with pytest.raises(ValueError):
        fp.fourier(long, [5], 8)


def test_corpus_basis_matches_svd(spark):
    x = np.random.default_rng(4).standard_normal((50, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, vec array<double>")
    want = np.linalg.svd(x, full_matrices=False)[2][:3]
    assert np.allclose(np.abs(linalg.corpus_basis(rows, 5, 3) @ want.T), np.eye(3), atol=1e-6)


def test_polar_error_bound(spark):
    x = np.random.default_rng(5).standard_normal((200, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    back = {r["id"]: r["vec"] for r in quant.polar(df, 16, (x @ quant.rotation(16)).std(axis=0, ddof=1).tolist()).collect()}
    y = np.array([back[i] for i in range(200)])
    assert ((x - y) ** 2).mean() / (x**2).mean() < 0.15


def test_search_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 40)
    x = np.random.default_rng(6).standard_normal((150, 8)).round(1)
    x[10:20] = x[10]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = search.top_k(df.filter("id in (10, 77)").withColumnRenamed("id", "query_id"), df, 4, cosine=True).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 10] == [10, 11, 12, 13]
    assert search.top_k(df.limit(0).withColumnRenamed("id", "query_id"), df, 4).count() == 0


def test_search_leaves_out_nulls_other_dimensions_and_itself(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [1.0, 0.0, 0.0]), (5, []), (6, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    asked = df.withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["rank"]): r["id"] for r in search.top_k(asked, df, 5, cosine=True, others=True).collect()}
    assert got == {(1, 0): 2, (1, 1): 6, (2, 0): 1, (2, 1): 6, (6, 0): 2, (6, 1): 1}
    assert search.top_k(asked, df, 5).filter("query_id = 4").count() == 1


def test_search_screen_loses_nothing(monkeypatch):
    """Small tiles, copies, ties within single precision, vectors of zeros and infinite values, against all products."""
    for name, v in (("AT_ONCE", 16), ("WIDE", 128), ("GROUP", 8), ("SLOWLY", 7), ("AGAIN", 600)):
        monkeypatch.setattr(search, name, v)
    r = np.random.default_rng(8)
    for kind in range(5):
        x = r.standard_normal((700, 6))
        if kind == 1:
            x[100:600] = x[3]
        if kind == 2:
            x[100:300] = x[3] * (1 + 1e-9 * r.random((200, 1)))
        if kind == 3:
            x = x.round(0)
        y, own = x[::9].copy(), np.arange(0, 700, 9)
        if kind == 3:
            y[:5] = 0
        if kind == 4:
            x[5, 2] = np.inf
        with np.errstate(invalid="ignore"):
            want = np.stack([np.einsum("ij,ij->i", np.broadcast_to(q, x.shape), x) for q in y])
        want[np.isnan(want) | (own[:, None] == np.arange(700))] = -np.inf
        order = np.argsort(-want, axis=1, kind="stable")[:, :4]
        places, scores = search.nearest(y, x, 4, (own, np.arange(700)))
        assert (places == order).all() and np.allclose(scores, np.take_along_axis(want, order, 1))


def test_search_blocks_stay_few():
    """615,384 queries against as many vectors: tasks for 12 cores, not 38 times 38, nor each row 76 times in the shuffle."""
    n, m = search._blocks(615_384, 615_384)
    assert 48 <= n * m <= 2 * search.TASKS and n + m <= 34
    assert search._blocks(102_564, 102_564) == (7, 7) and search._blocks(0, 0) == (1, 1)


def test_search_task_holds_few_queries_at_once(spark, monkeypatch):
    """Eight times the queries of a block, and numpy's part of a task's memory is no larger; a block of several parts finds what single queries do."""
    tasks, send = [], PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, f, schema: tasks.append(f) or send(self, f, schema))
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<float>")
    search.top_k(df.withColumnRenamed("id", "query_id"), df, 20, cosine=True)
    x = np.random.default_rng(10).standard_normal((32_768, 16)).astype(np.float32)
    x[7, 3], x[5000, 3] = np.nan, np.inf
    table = lambda name, n: pa.table({name: np.arange(n), "vec": pa.array(list(x[:n]), pa.list_(pa.float32()))})
    corpus, held = table("id", 3000), {}
    for n in (4096, 32_768):
        asked = table("query_id", n)
        tracemalloc.start()
        out = tasks[0](corpus, asked)
        held[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(out) == 21 * (n - 1 - (n > 5000))
    # What is found stays in arrays of numpy's: 24 bytes a row.
    assert held[32_768] - 24 * 21 * (32_768 - 4096) < 1.2 * held[4096]
    got = out.to_pandas().groupby("query_id")[["id", "score"]].agg(list)
    for q in (0, 4095, 4096, 20_000, 32_767):
        one = tasks[0](corpus, asked.slice(q, 1)).to_pydict()
        assert one["id"] == got.loc[q, "id"] and one["score"] == got.loc[q, "score"]


def test_search_of_views_is_that_of_their_components(spark):
    x = np.random.default_rng(9).standard_normal((60, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    views = {"a": [0, 1], "b": [1, 4, 5]}
    got = search.top_k(df.withColumnRenamed("id", "query_id"), df, 3, cosine=True, others=True, views=views).collect()
    for view, at in views.items():
        part = spark.createDataFrame([(i, v[at].tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
        want = search.top_k(part.withColumnRenamed("id", "query_id"), part, 3, cosine=True, others=True).collect()
        assert {(r["query_id"], r["rank"], r["id"], round(r["margin"], 9)) for r in want} == {(r["query_id"], r["rank"], r["id"], round(r["margin"], 9)) for r in got if r["view"] == view}


def test_keywords_are_found_once_a_text(spark, tmp_path):
    rows = [(1, "The cat, the CAT; a dog-house\n\u212aelvin na\u00efve 12 123 \u0130stanbul"), (2, ""), (3, None), (4, "  the of ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["w"] for r in df.select("doc_id", tx.keywords(F.col("text")).alias("w")).collect()}
    assert got == {1: ["cat", "dog", "house", "kelvin", "123", "stanbul"], 2: [], 3: None, 4: []}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    plan = plans.keyword_overlap(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(text") == 1


def test_hash_embedder_sends_no_texts(spark):
    df = spark.createDataFrame([(1, "na\u00efve text"), (2, ""), (3, None)], "id long, text string")
    out = df.select("id", embed.embed(F.col("text")).alias("vec"))
    got = {r["id"]: r["vec"] for r in out.collect()}
    assert got[3] is None and got[1] == embed.hash_embed("na\u00efve text").tolist() and got[2] == embed.hash_embed("").tolist()
    assert "sha2" in out._jdf.queryExecution().optimizedPlan().toString()


def test_fourier_in_rows_matches_cells(spark):
    x = np.random.default_rng(7).standard_normal((3, 24))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    for unit in (False, True):
        a, b = fp.fourier_rows(rows, [0, 2], 4, 6, unit), fp.fourier(fp.cells(rows, 4), [0, 2], 6, unit)
        a, b = ({(r["id"], r["freq"], r["dim"]): r["x"] for r in d.collect()} for d in (a, b))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    with pytest.raises(ValueError):
        fp.fourier_rows(rows, [4], 4, 6)


def test_chunks_as_before():
    """Ranges with two characters for each break, and headers of nested parts named again, by hand."""
    assert chunker.paragraphs("aaa\n\n\n\nbbb", 6, compat=True) == [(0, 5), (5, 10)]
    assert chunker.paragraphs("aaa\n\n\n\nbbb", 6) == [(0, 7), (7, 10)]
    text = "# A\n" + "x" * 30 + "\n## B\n" + "y" * 30 + "\n### C\n" + "z" * 30
    assert [c.headers for c in chunker.chunks(text, 45, compat=True)] == [("# A",), ("# A", "## B", "## B"), ("# A", "## B", "## B", "### C")]
    assert [c.headers for c in chunker.chunks(text, 45)] == [("# A",), ("# A", "## B"), ("# A", "## B", "### C")]


def test_half_precision(spark):
    x = np.concatenate([np.random.default_rng(8).standard_normal(300) * 10.0 ** np.arange(300 // 50).repeat(50) / 1000, [0.0, 1e-8, 6e-8, 65504.0, 65519.0, 65520.0, -70000.0, 1 / 3, 2.0**-14]])
    got = spark.createDataFrame([(x.tolist(),)], "v array<double>").select(quant.halves(F.col("v")).alias("h")).first()["h"]
    assert np.array_equal(np.array(got), x.astype(np.float16).astype(np.float64))


def test_methods(spark):
    v = np.random.default_rng(9).standard_normal(100)
    df = spark.createDataFrame([(v.tolist(),)], "v array<double>")
    for method, most in (("fp16", 1e-6), ("q8_0", 1e-2), ("q4_0", 1e-2), ("int8", 1e-2)):
        back = np.array(df.select(quant.round_trip(F.col("v"), method).alias("b")).first()["b"])
        assert len(back) == 100 and ((back - v) ** 2).sum() / (v**2).sum() < most
    for method in ("zip", "polarquant"):
        with pytest.raises(ValueError):
            quant.round_trip(F.col("v"), method)


def test_store(spark, tmp_path):
    s = entries.Store(spark, f"{tmp_path}/s")
    assert s.entries().count() == 0 and s.health().first()["n_entries"] == 0
    row = lambda i, text: (str(i), text, [float(i), 1.0], None, f"f{i % 2}")
    make = lambda rows: spark.createDataFrame(rows, "cache_id string, task_description string, vec array<double>, agent string, family string")
    s.put(make([row(i, "old") for i in range(6)]), 1)
    s.put(make([row(2, "new")]), 2)
    ids = make([row(1, ""), row(2, "")])
    s.delete(ids, 3)
    s.put(make([row(1, "again")]), 4)
    got = {r["cache_id"]: (r["task_description"], r["agent"], r["day"]) for r in s.entries().collect()}
    assert got.keys() == {"0", "1", "3", "4", "5"} and got["1"] == ("again", "unknown", "unknown")
    assert {(r["cache_id"], r["there"]) for r in s.exists(ids).collect()} == {("1", True), ("2", False)}
    new = s.vacuum(f"{tmp_path}/t")
    assert tuple(new.health().first()) == (5, 5, 0, 5)
    hits = new.retrieve(spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vec array<double>"), 2, where=F.col("family") == "f1").collect()
    assert [r["cache_id"] for r in sorted(hits, key=lambda r: r["rank"])] == ["5", "3"]


def test_containers(spark):
    x = np.random.default_rng(10).standard_normal((2, 5, 3, 4))
    cells = spark.createDataFrame([(d, "K", la, 0, c, x[d, la, c].tolist()) for d in range(2) for la in range(5) for c in range(3)], "doc long, kind string, layer int, head int, cell int, vec array<double>")
    for method in ("fp16", "q8_0", "int8", "layer_delta"):
        back = {(r["doc"], r["layer"], r["cell"]): r["vec"] for r in entries.decoded(entries.coded(cells, method)).collect()}
        assert len(back) == 30 and all(np.abs(np.array(v) - x[k]).max() < 0.1 for k, v in back.items())
    with pytest.raises(ValueError):
        entries.coded(cells, "zip")


def test_knowledge(spark, tmp_path):
    (tmp_path / "a" / ".git").mkdir(parents=True)
    for name, text in (("a/One Two.md", "# T\n\nhello"), ("a/b.md", "word " * 900), ("a/.git/c.md", "x"), ("a/LICENSE.md", "x"), ("a/d.md", ""), ("a/e.txt", "x")):
        (tmp_path / name).write_text(text)
    sources = knowledge.read_markdown(spark, str(tmp_path), "p")
    assert sources.count() == 2 and [r["path"].rsplit("/")[-1] for r in knowledge.listed(spark, [str(tmp_path / "a"), str(tmp_path)], "*.txt").collect()] == ["e.txt"]
    empty = spark.createDataFrame([], "path string, hash string, project string, file_size long, n_chunks long")
    chunks, manifest = knowledge.index_sources(sources, empty, "2026-01-01")
    rows = {r["cache_id"]: r for r in chunks.collect()}
    assert rows["p/one-two"]["text"].endswith("One Two.md | Project: p\n\n# T\n\nhello") and rows["p/one-two"]["file_name"].endswith("_2026-01-01.eng")
    store.save_manifest(manifest, f"{tmp_path}/m")
    kept = store.load_manifest(spark, f"{tmp_path}/m", "path string, hash string, project string, file_size long, n_chunks long")
    assert knowledge.index_sources(sources, kept, "2026-01-02")[0].count() == 0 and kept.count() == 2
    assert knowledge.index_sources(sources, kept, "2026-01-02", force=True)[0].count() == len(rows)
    assert store.load_manifest(spark, f"{tmp_path}/none", "path string").count() == 0
    with pytest.raises(ValueError):
        knowledge.build_index(chunks, "other")


def test_sidecar_descriptions(spark):
    certs = spark.createDataFrame([("a", "short"), ("b", "short"), ("c", "longer than that"), ("d", None)], "path string, task_description string").withColumn("cache_id", F.col("path")).withColumn("corrupt", F.lit(None).cast("string"))
    side = spark.createDataFrame([("a", "a longer one", "s", "p", "h", 0, 1, None), ("b", "", "s", "p", "h", 0, 1, None), ("c", "less", "s", "p", "h", 0, 1, None)], "path string, task_description string, source_path string, project string, fp_source string, chunk_index int, chunk_total int, headers array<string>")
    text = lambda longer: {r["path"]: r["task_description"] for r in knowledge.with_sidecars(certs, side, longer).collect()}
    assert text(False) == {"a": "a longer one", "b": "short", "c": "less", "d": ""}
    assert text(True) == {"a": "a longer one", "b": "short", "c": "longer than that", "d": ""}


def test_sessions(spark, tmp_path):
    log, ts = sessions.Log(spark, f"{tmp_path}/log"), datetime.datetime(2026, 1, 1)
    for day, pairs in (("s1", [("a", "b", False), ("a", "a", True)]), ("s2", [("a", "b", False), ("c", "d", False)])):
        s = sessions.Session(log, day)
        for q, r, ok in pairs:
            s.record(query_doc_id=q, result_doc_id=r, correct=ok, confidence="low", stages_used=1, ts=ts)
        out = s.end().collect()
        assert [(x["session_id"], x["n_total"], x["n_new_pairs"]) for x in out] == [(day, 2, 1)]
    assert log.rows().count() == 4
    docs = spark.createDataFrame([("a",), ("z",)], "query_doc_id string")
    assert {r["query_doc_id"]: r["chronic"] for r in sessions.Session(log, "s3").priors(docs).collect()} == {"a": True, "z": False}
    with pytest.raises(ValueError):
        s.record(query_doc_id="a")


def test_blob_header_of_odd_blobs():
    x = np.zeros((7, 2, 3, 4))
    head = state_blob.header(state_blob.encode([(x, x)]))
    assert (head["arch"], head["streams"], head["cells"], head["layers"], len(head["keys"]), head["error"]) == ("llama", 1, 3, 7, 5, None)
    assert state_blob.header(b"\x05\0\0\0ll")["error"] and state_blob.header(b"")["error"]


def test_new_vectors_in_a_stream(spark, tmp_path):
    x = np.zeros((12, 4))
    x[:, 0] = 1.0
    x[8:, 1] = np.arange(4) * 5 + 5
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    rows.filter("id = 0").write.parquet(f"{tmp_path}/in")
    seen = []
    run = live.density_on_insert(lambda: rows, lambda df, _: seen.extend(df.collect()), 0.9)
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    stream.writeStream.option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).foreachBatch(run).start().awaitTermination()
    assert {r["id"] for r in seen} == set(range(1, 8)) and all(r["density"] == 7 and r["confused"] for r in seen)


def test_embedder():
    assert np.array_equal(embed.hash_embed("a"), embed.hash_embed("a")) and abs(np.linalg.norm(embed.hash_embed("a", 256)) - 1) < 1e-5


def test_blocks(spark):
    cells = spark.createDataFrame([(1, i) for i in range(300)], "stream int, cell long")
    b = store.segments(cells)
    assert sorted(r["n_tokens"] for r in b.collect()) == [44, 256]
    more = store.extended(b, spark.createDataFrame([(1, 300), (2, 5)], "stream int, n long"))
    assert sorted((r["stream"], r["n_tokens"]) for r in more.collect()) == [(1, 88), (1, 256), (1, 256), (2, 5)]


def test_stateful_block_counter(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(1, 200), (2, 10)], "stream string, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("stream string, n long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    q = live.block_counter(rows).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect()))).start()
    q.awaitTermination()
    assert ("1", 400, 2) in seen and ("2", 20, 1) in seen
