"""Each registered corpus query on small tables, against its whole contract recomputed in plain Python, or its SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import ODD, _removed, _texts, _words
from tokenizers import Tokenizer

import __spark_entry__ as entry
from mnemis.llm import bpe, pii

SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(_texts(), 20))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, texts):
    top, rng = tmp_path_factory.mktemp("tables"), np.random.default_rng(1)
    put = lambda name, rows, kinds: spark.createDataFrame(rows, kinds).repartition(2).write.parquet(f"{top}/{name}.parquet")
    put("documents", [(i, t, "en", "src1", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    put("labels", [(i, int(len(t or "") % 3 > 0), 0) for i, t in texts.items() if i % 2], "doc_id long, quality int, toxic int")
    x = rng.standard_normal((300, 64)).astype(np.float32)
    x[60:70] = x[50]
    put("embeddings", [(i, v.tolist(), i % 10) for i, v in enumerate(x)] + [(350, None, 1), (400, [0.0] * 64, 1)], "vec_id long, embedding array<float>, label int")
    turns = [(c, t, r, text) for c, text in enumerate(ODD) for t, r in enumerate(("system", "user", "assistant"))] + [(70, 0, "user", "only"), (71, 1, "assistant", "b"), (71, 0, "assistant", "a")]
    put("conversations", turns, "conv_id long, turn long, role string, text string")
    return str(top)


def _run(spark, sf, start):
    name = next(n for n in entry.queries() if n.startswith(start + "_"))
    return name, entry.queries()[name](spark, sf)


@pytest.mark.parametrize("start", ["op1", "op2", "op8", "op9"])
def test_against_sql(spark, sf, start):
    name, df = _run(spark, sf, start)
    duck, columns = duckdb.connect(), sorted(df.columns)
    for table in ("documents", "conversations"):
        duck.sql(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet/*.parquet')")
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    plain = lambda rows: sorted(map(tuple, rows), key=repr)
    assert plain(df.select(*columns).collect()) == plain(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())


def test_op2(spark, sf, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in _run(spark, sf, "op2")[1].select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == {i: (n, gone, SHA(kept)) for i, (n, gone, kept) in _removed(texts).items()}


def test_op3(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = zip(*((r["vec_id"], r["embedding"]) for r in rows if r["embedding"] and any(r["embedding"])))
    u = np.array(x, np.float64)
    u, at = u / np.linalg.norm(u, axis=1, keepdims=True), {i: k for k, i in enumerate(ids)}
    got, hits = defaultdict(list), 0
    for r in _run(spark, sf, "op3")[1].collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [i for i in sorted(ids) if i % 50 == 0]
    for q, found in got.items():
        found.sort()
        s = u @ u[at[q]]
        best = sorted((-round(s[k], 9), i) for i, k in at.items() if i != q)[:5]
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(s[at[i]] - c) < 1e-12 for _, i, c in found)
        assert [(-round(c, 9), i) for _, i, c in found] == sorted((-round(c, 9), i) for _, i, c in found)
        hits += len({i for _, i, _ in found} & {i for _, i in best})
    assert hits >= 0.9 * 5 * len(got)


def test_op4(spark, sf, texts):
    rows = _run(spark, sf, "op4")[1].collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op4_learns_nothing_from_held_out_labels(spark, sf, texts, tmp_path):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.lit("xx")).write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{tmp_path}/labels.parquet")
    scores = [{r["doc_id"]: round(r["score"], 9) for r in _run(spark, d, "op4")[1].collect()} for d in (sf, str(tmp_path))]
    assert scores[0] == scores[1]


def test_op5(spark, sf, texts):
    rows = {r["doc_id"]: r for r in _run(spark, sf, "op5")[1].collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        t, want = t or "", []
        want += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in re.finditer(r"[0-9]([ -]?[0-9])+", t) if 16 <= len(re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(re.sub("[ -]", "", m[0]))]
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        joined = [":".join(map(str, s)) for s in want]
        counts = Counter(k for k, _, _ in want)
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [counts[k] for k in pii.KINDS] and rows[i]["base_sha256"] == SHA(",".join(joined))
        spans = rows[i]["spans"].split(",") if rows[i]["spans"] else []
        assert {*joined} <= {*spans} and spans == sorted(spans, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))


def test_op6(spark, sf, texts):
    prints = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[j : j + 4]) for j in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in texts}
    for _ in texts:
        root = {i: min(root[j] for j in texts if (prints[i] ^ prints[j]).bit_count() <= 4) for i in texts}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in _run(spark, sf, "op6")[1].collect()}
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in texts}


def test_op7(spark, sf, texts):
    t = Tokenizer.from_file(bpe.default_path())
    got = {r["doc_id"]: tuple(r)[1:] for r in _run(spark, sf, "op7")[1].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    for i, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got.pop(i) == (len(ids), SHA(",".join(map(str, ids))), SHA(t.decode(ids, skip_special_tokens=False)))
    assert not got


@pytest.mark.parametrize("block", [1, 3, 50])
def test_op7_digests_in_any_blocks(spark, texts, block):
    docs = spark.createDataFrame([(i, t[:300]) for i, t in texts.items() if t], "doc_id long, text string")
    assert sorted(map(tuple, bpe.digests(docs, block=block).collect())) == sorted(map(tuple, bpe.digests(docs).collect()))


def test_op8(spark, sf, texts):
    rows = _run(spark, sf, "op8")[1].collect()
    slots = defaultdict(list)

    def best(key, n):
        u = lambda s: (int(hashlib.md5(f"k{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return max(range(n), key=lambda s: (1 / -np.log(u(s)), -s))

    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (best(r["doc_id"], 16), best(r["doc_id"], 17)) and r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op9(spark, sf):
    text = r"\### Assistant: </turn> ok"
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    turns[-7] = [("user", text), ("assistant", text)]
    rows = {r["conv_id"]: r for r in _run(spark, sf, "op9")[1].collect()}
    assert rows.keys() == turns.keys()
    for c, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        r = rows[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), SHA("".join(f"{a}\n{b}\n" for a, b in own)), len(loss), SHA(loss))
        assert r["formatted_chars"] > sum(len(a) + len(b) for a, b in own)


def test_op10(spark, sf, texts):
    t, by, seq = Tokenizer.from_file(bpe.default_path()), defaultdict(list), defaultdict(list)
    for r in _run(spark, sf, "op10")[1].collect():
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by.keys() == texts.keys()
    for i, rows in by.items():
        ids = np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        rows.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows))) and (len(rows) == 1 or len(ids) > 2048)
        assert [r["start"] for r in rows] == [0, *np.cumsum([r["length"] for r in rows])[:-1].tolist()] and sum(r["length"] for r in rows) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in rows) and all(r["length"] == 2048 for r in rows[1:])
    for places in seq.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)]).tolist()]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048
    total = sum(len(_words(x)) >= 0 for x in texts.values())
    assert total == len(by) and len(seq) <= sum(r["length"] for rows in by.values() for r in rows) // 2048 + 2


def test_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, fn in entry.queries().items():
        if name.startswith("op") and "_" in name and name[2].isdigit():
            assert fn(spark, str(tmp_path)).count() == (1 if name.startswith("op9") else 0), name
    assert entry.queries()["pipeline"](spark, str(tmp_path)).count() == 0
