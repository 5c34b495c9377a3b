"""The corpus operators against brute force, on texts with nulls, ties, repeats and odd characters."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemis.llm import ann, bpe, chat, classifier, packing, pii, quality, sharding, simhash, substring

WORDS = "the of and river stone light paper garden window quiet yellow harbour signal copper".split()


def _texts():
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    passage, long = say(60), say(900)
    out = [None, "", "   \n\t ", "one", "the " * 300, "a\nb\na\n\n a\nb", long, long, long + " tail", "<|endoftext|> x <|endo", "é中😀 \x1c ½ ٣" * 3]
    out += [say(30) + " " + passage + " " + say(25) for _ in range(6)]
    out += [passage, passage + " " + passage, "mail me: ann.b@mail.example.com or 4111 1111 1111 1111, ip 10.0.0.256 10.0.0.25, tel +1 (555) 010-9999"]
    out += ["word " * 19 + "end", "x" * 3000, "1.2.3.4.5.6.7 +1 2 a@b@c.de 5@.x a..b@c-d.e.f", "### Assistant: </turn> \\"]
    return out + [say(rng.randrange(1, 200)) for _ in range(40)]


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(_texts()))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", i) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, shard int").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_counts(docs, texts, none):
    out = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, t in texts.items():
        w, lines = _words(t), [x for x in (t or "").split("\n") if _words(x)]
        seen = Counter(zip(w, w[1:], w[2:]))
        again = {k for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        want = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(none).count() == 0


def _removed(texts, window=20):
    first, out = {}, {}
    for i in sorted(texts):
        w = (texts[i] or "").encode().split()
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), (i, j))
    for i in texts:
        w = (texts[i] or "").encode().split()
        gone = {k for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < (i, j) for k in range(j, j + window)}
        out[i] = len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring(docs, texts, none, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    got = {r[0]: tuple(r)[1:] for r in substring.remove_repeats(docs).collect()}
    assert {i: r[:3] for i, r in got.items()} == _removed(texts)
    assert all(sum(b - a for a, b in r[3]) == r[1] for r in got.values())
    assert substring.remove_repeats(none).count() == 0


def test_substring_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = substring.remove_repeats(spark.createDataFrame([(5, t), (5, t), (None, t)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in rows) == [(False, 40), (False, 40), (True, 0)]


def test_substring_carry(spark):
    """Rows that share a doc_id keep their own text and columns."""
    t, u = (" ".join(f"{x}{i}" for i in range(40)) for x in "tu")
    rows = [(1, t, "a"), (5, t + "\nend", "b"), (5, u, "c"), (None, None, "d")]
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, kept string"), carry=["kept"])
    got = sorted((r["row"]["kept"], r["doc_id"], r["text"], r["n_removed"], r["kept"]) for r in out.collect())
    assert got == [("a", 1, t, 0, t), ("b", 5, t + "\nend", 40, "end"), ("c", 5, u, 0, u), ("d", None, None, 0, "")]


def test_substring_many_buckets(docs, texts, monkeypatch):
    """The number of buckets follows the bytes of the texts."""
    monkeypatch.setattr(substring, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(substring, "FLUSH", 50)
    assert {r[0]: tuple(r)[1:4] for r in substring.remove_repeats(docs).collect()} == _removed(texts)


def test_fm_index_counts():
    rng = np.random.default_rng(0)
    text = np.concatenate([rng.integers(1, 4, 300), [0]])
    fm = substring.FMIndex(text)
    for n in range(2, 7):
        for start in range(60):
            p = text[start : start + n]
            low, high = np.array([fm.first[p[-1]]]), np.array([fm.first[p[-1] + 1]])
            for c in p[-2::-1]:
                low, high = fm.back(np.array([c]), low, high)
            assert high[0] - low[0] == sum(np.array_equal(text[i : i + n], p) for i in range(len(text) - n + 1))


def test_matching_statistics():
    """Against all places, also with texts that stand more than once and are indexed once."""
    rng = np.random.default_rng(4)
    text = np.concatenate([rng.integers(2, 5, 60), [1], rng.integers(2, 5, 60), [2] * 70, [0]])
    fm = substring.FMIndex(text)
    ends = np.array([i for i in range(5, len(text)) if min(text[i - 4 : i + 1]) > 1])
    for least in (1, 2):
        length, low, high = substring.matching_statistics(fm, text, ends, 5, np.full(len(ends), least))
        first = substring.first_places(fm, low[length == 5], high[length == 5]).tolist()
        for end, n in zip(ends.tolist(), length.tolist()):
            places = lambda k: [i for i in range(len(text) - k + 1) if np.array_equal(text[i : i + k], text[end - k + 1 : end + 1])]
            assert n == max(k for k in range(6) if k == 0 or len(places(k)) >= least)
            if n == 5:
                assert first.pop(0) == places(5)[0]
    assert sorted(fm.locate(np.arange(len(text))).tolist()) == list(range(len(text)))


def test_equal_hashes_are_not_equal_words(monkeypatch):
    """Segments whose hashes agree are compared by their words."""
    seg = np.zeros(3, substring._SEGMENT)
    seg["doc"], seg["n"], seg["id"], seg["text"] = [1, 2, 3], 1, 7, [0, 1, 2]
    found = substring.search_shard(seg, np.array([0, 1, 2, 0, 1, 3, 0, 1, 3]), 3)
    assert found["doc"].tolist() == [3]


def test_simhash(docs, texts, none):
    prints = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[j : j + 4]) for j in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in texts}
    for _ in texts:
        for i in texts:
            root[i] = min(root[j] for j in texts if (prints[i] ^ prints[j]).bit_count() <= 4)
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.classes(docs).collect()}
    assert got == {i: (prints[i], root[i]) for i in texts}
    assert simhash.classes(none).count() == 0


def test_simhash_heads(spark):
    """One row a class: null doc_ids come last, texts that share a doc_id are told apart."""
    t, u, v = (" ".join(f"{x}{i}" for i in range(60)) for x in "tuv")
    rows = [(None, t, "a"), (7, t, "b"), (7, u, "c"), (7, u, "c"), (None, v, "d"), (None, v, "d"), (9, None, "e"), (8, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r["fp"], r["doc_id"]) for r in simhash.heads(df).collect())
    assert got == [("b", 7), ("c", 7), ("d", None), ("f", 8)]
    assert simhash.heads(df.limit(0)).count() == 0


def _near_texts():
    """Texts of 1 to 120 words with copies of 1 to 12 changed words; chains, and a cluster round one text."""
    rng = random.Random(11)
    say = lambda n: [rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n)]
    out = []
    for n in [1, 3, 4, 5, 6, 8, 9, 12, 30, 60, 120] * 4:
        w = say(n)
        out.append(w)
        for _ in range(3):
            w = list(w)
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(1000))
            out.append(w + say(rng.randrange(2)))
    base = say(100)
    for _ in range(40):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(1000))
        out.append(w)
    rng.shuffle(out)
    return [" ".join(w) for w in out]


def _heads(texts):
    """The smallest id of each class of texts that are near over any number of steps."""
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    for i in texts:
        for j in texts:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                x, y = sorted((root[i], root[j]))
                root = {k: x if r == y else r for k, r in root.items()}
    return set(root.values())


@pytest.mark.parametrize("group", [4096, 3])
def test_near_copies_in_a_cluster(spark, group, monkeypatch):
    """Many copies of one text, each near to some others only; also where groups are dealt in blocks."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "ROUNDS", 1)
    rng = random.Random(12)
    base = [rng.choice(WORDS) + str(i) for i in range(90)]
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(90)] = f"x{i}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in simhash.heads(df).collect()} == _heads(texts)


def test_near_copies_by_five_word_jaccard(spark):
    """Every pair at 4 / 5 or more is linked and none below, against all pairs."""
    texts = _near_texts()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    far = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
                far += (simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[j], 5)).bit_count() > 4
    assert far > 10  # pairs that fingerprints alone would miss
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in simhash.heads(df).collect()) == sorted(set(root))


@pytest.mark.parametrize("hot", [20_000, 10])
def test_simhash_links(spark, hot, monkeypatch):
    """Every chain of near fingerprints is one set, also when start segments are hot."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(200)} | {0}
    for f in list(fps):
        for _ in range(rng.randrange(4)):
            for _ in range(rng.randrange(1, 7)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    order, signed = sorted(fps), lambda x: x - (1 << 64) if x >> 63 else x
    root = {f: f for f in order}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= 4:
                root[top(a)] = top(b)
    edges = simhash.links(spark.createDataFrame([(signed(f),) for f in order], "fp long"))
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    mine = defaultdict(set)
    for f in order:
        mine[found.get(signed(f), signed(f))].add(f)
    want = defaultdict(set)
    for f in order:
        want[top(f)].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_bpe(docs, texts):
    t = Tokenizer.from_file(bpe.default_path())
    for r in bpe.encode_decode(docs).collect():
        ids = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False)


def test_bpe_streams_in_any_blocks(monkeypatch):
    v, t, rng = bpe.vocabulary(bpe.default_path()), Tokenizer.from_file(bpe.default_path()), random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'ll", "12", "é", "中", "😀", "!!", "<|endoftext|>", "<|end", " ", "\x1c", "_", "aaaa" * 20, " " * 70, "!" * 90]
    for size in (50, 1 << 16):
        monkeypatch.setattr(bpe, "BLOCK", size)
        for _ in range(300):
            s = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
            want = t.encode(s, add_special_tokens=False).ids
            for block in (1, 7, 1 << 16):
                assert np.frombuffer(bpe.encode(s, v, block), "<u4").tolist() == want, (size, block, s)


def test_every_piece_goes_through_the_transducer(texts, monkeypatch):
    """Pieces of any length are fed to a stream, all of their bytes, before their tokens are known."""
    v, fed = bpe.Vocabulary(bpe.default_path()), set()
    feed = bpe.PieceStream.feed
    monkeypatch.setattr(bpe.PieceStream, "feed", lambda self, data: fed.add(data) or feed(self, data))
    seen = set()
    for text in texts.values():
        bpe.encode(text or "", v)
        for part in v.mark.split(text or "")[::2]:
            seen |= {m[0].encode() for m in bpe._PIECE.finditer(part)}
    assert seen == fed and len(seen) > 50 and max(map(len, seen)) > 1000


def test_tokens_are_emitted_within_the_lookahead():
    """A piece of any length holds a bounded window: what is emitted is all but the last few tokens."""
    v, rng = bpe.vocabulary(bpe.default_path()), random.Random(2)
    word, stream, out = "".join(rng.choice("abcdefgh") for _ in range(20_000)).encode(), bpe.PieceStream(v), []
    for i in range(0, len(word), 500):
        out += stream.feed(word[i : i + 500])
        assert len(stream.data) <= 8 * v.longest + 500
    assert out + stream.finish() == v.piece(word)
    assert v.lookahead == max(len(b) for b in v.id_of) - 1


def test_decoder_broken_bytes():
    v = bpe.vocabulary(bpe.default_path())
    one = {b: v.id_of[bytes([b])] for b in range(256)}
    for data in (b"\xe4\xb8\xad\xf0\x9f", b"\xff\x80a\xe4", b"\xf0\x9f\x98\x80", b"\xc3\xa9\xc3"):
        d = bpe.Decoder(v)
        assert "".join(d.feed([one[b]]) for b in data) + d.finish() == data.decode("utf-8", "replace")


def test_sharding(spark, docs, none):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    out = sharding.shard(rows, "doc_id", [1, 1, 2], [1, 1, 2, 1]).collect()
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 3)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert abs(len(by[2]) / 5000 - 0.5) < 0.05 and 0.15 < sum(r["grown_shard"] == 3 for r in out) / 5000 < 0.25
    assert sharding.shard(none, "doc_id", [1.0]).count() == 0


ODD = [r"\### Assistant: </turn> ok", "</turn>\n### user: hi", None, "", "\\", "### a*: b</turn>\n", "x</turn", "\n", "<\\/turn>", "#\\##", "##### Assistant: x", "######", "#", "##", "</turn></turn>\\", "é#中###😀", "</tu</turn>rn>", "a" * 50_000 + "###"]


def test_chat(spark):
    rows = [(c, t, r, x, "mine") for c, x in enumerate(ODD) for t, r in enumerate(["system", "user", "assistant", "as:*\\\n"])] + [(99, 0, None, "a", None), (99, 0, None, "a", None), (None, None, "assistant", "b", None), (None, 1, "user", None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = chat.format_chats(df).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        own = [(role or "", x or "") for c, _, role, x, _ in rows if c == r["conv_id"]]
        turns = chat.parse(r["formatted"])
        assert [t[:2] for t in turns] == own and r["n_turns"] == len(own)
        loss = [chat.unescape(r["formatted"][a:b]) for a, b in zip(r["loss"][::2], r["loss"][1::2])]
        assert loss == [x for role, x in own if role == "assistant"]
        bodies = "\0".join(r["formatted"][a:b] for _, _, a, b in turns)
        assert "###" not in bodies and "</turn>" not in bodies
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_escapes_until_identical(monkeypatch):
    """A form that doesn't parse back gives way to the next."""
    for text in filter(None, ODD):
        assert chat.parse_turn(chat.render_turn("user", text))[:2] == ("user", text)
    monkeypatch.setattr(chat, "escape", lambda text: text.replace("#", ""))
    one = chat.render_turn("user", "a ### b")
    assert chat.parse_turn(one)[:2] == ("user", "a ### b") and r"\#\#\#" in one
    for bad in ("### user: a ### b</turn>\n", "### user*: a </turn> b</turn>\n", "### user: a", "user: a</turn>\n"):
        with pytest.raises(ValueError):
            chat.parse(bad)


def test_packing(docs, texts, none):
    t = Tokenizer.from_file(bpe.default_path())
    out = packing.pack(packing.pieces(docs, room=256), 2, room=256).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by.keys() == texts.keys()
    for i, rows in by.items():
        ids = np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        rows.sort(key=lambda r: r["piece"])
        assert b"".join(r["ids"] for r in rows) == ids.tobytes()
        assert [r["length"] for r in rows[1:]] == [256] * (len(rows) - 1) and len(rows) == max(1, -(-len(ids) // 256))
    for places in seq.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)]).tolist()]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 256
    assert packing.pack(packing.pieces(none), 1).count() == 0


def test_placing_is_sum_of_squares():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 40, 300)
    bins, offsets = packing.place(sizes, 64)
    gaps: dict[int, int] = {}
    for size, b, off in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        count = Counter(g for g in gaps.values() if g)
        cost = lambda g: sum(n * n for n in (count - Counter([g]) + Counter([g - size] if g > size else [])).values())
        best = min(cost(g) for g in {64, *(g for g in count if g >= size)})
        assert cost(gaps.get(b, 64)) == best and off == 64 - gaps.get(b, 64)
        gaps[b] = gaps.get(b, 64) - size


def test_best_order_keeps_places():
    sizes = np.sort(np.random.default_rng(1).integers(1, 65, 400))[::-1]
    bins, offsets = packing.place_best(sizes, 64)
    assert bins.max() <= packing.place(sizes, 64)[0].max()
    for b in range(bins.max() + 1):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == [0, *np.cumsum(sizes[own]).tolist()][:-1] and sizes[own].sum() <= 64


def test_pii_base(docs, texts, none):
    for t in texts.values():
        t, want = t or "", []
        want += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in re.finditer(r"[0-9]([ -]?[0-9])+", t) if 16 <= len(re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(re.sub("[ -]", "", m[0]))]
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(t) == want
    assert pii.find(none).count() == 0
    found = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert found.keys() == texts.keys() and found[0]["spans"] == []


def _private(rng):
    """A text and its personal data, some in wider forms, among numbers that are none."""
    digit = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))

    def card(good):
        while True:
            x = rng.choice("45") + rng.choice("12345") + digit(14)
            if pii.luhn(x) == good:
                return x

    name, site, cue = rng.choice(WORDS), rng.choice(WORDS), rng.choice(["", "", "write to ", "call ", "card ", "host "])
    ip = [str(rng.randrange(1, 256)) for _ in range(4)]
    truth = [("email", f"{name}@{site}.com"), ("ip", ".".join(ip)), ("card", card(True)), ("phone", f"+1 ({rng.randrange(200, 999)}) 555-{digit(4)}")]
    wide = [("email", f"{name} [at] {site} [dot] com"), ("ip", "[.]".join(ip)), ("phone", f"({rng.randrange(200, 999)}) 555-{digit(4)}")]
    decoys = [card(False), digit(3) + " " + digit(9), "9" + digit(2) + ".1.2.3", f"{name} (at) {site} today", "0" + digit(2) + "-" + digit(3) + "-" + digit(4), digit(9)]
    parts = [*rng.sample(truth, 2), *rng.sample(wide, 1), *((None, d) for d in rng.sample(decoys, 2))]
    rng.shuffle(parts)
    text, spans = "", []
    for kind, part in parts:
        text += " ".join(rng.choice(WORDS) for _ in range(6)) + " " + cue
        if kind:
            spans.append((kind, len(text), len(text) + len(part)))
        text += part + " "
    return text + "end", spans


def test_pii_precision_of_added_spans(spark):
    """Fitted on one half of made texts, the spans that the classifier adds to the other half are right."""
    rng = random.Random(9)
    made = [_private(rng) for _ in range(800)]
    model = pii.fit(spark.createDataFrame([(t,) for t, _ in made[:400]], "text string").repartition(3))
    added = right = wanted = 0
    for text, truth in made[400:]:
        base = {s for s in pii.base_spans(text)}
        more = {(c.kind, c.start, c.end) for c in pii.spans_of(text, model)} - base
        added, right, wanted = added + len(more), right + len(more & {*truth}), wanted + len({*truth} - base)
    print("added", added, "right", right, "wanted", wanted)
    assert right / added > 0.95 and right / wanted > 0.9


def test_pii_context_votes_and_masks():
    votes = {c.votes[3:] for t in ("call +1 (234) 555-0100 now", "12 (234) 555-0100 13", "x +1 (234) 555-0100") for c in pii.candidates(t)}
    assert votes == {(1, 1), (0, -1), (0, 1)}
    assert pii.masked("to a@b.cd now", pii.spans_of("to a@b.cd now", pii.SpanModel(None))) == "to [EMAIL] now"


def test_pii_many_spans_in_one_text():
    """Time grows with a text's spans, not with their square."""
    text = "call (234) 555-0199 or 4111111111111111 at 10.0.0.1 " * 20_000
    assert len(pii.candidates(text)) == 60_000


def test_classifier(spark, none):
    rng = random.Random(5)
    good = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(120)]
    bad = [" ".join(rng.choice(WORDS).upper() + "!!" for _ in range(60)) for _ in range(60)] + [" ".join([rng.choice(WORDS)] * 60) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(999, None), (999, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(None, 1, 0), (3, None, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    scores = classifier.Model.fit(docs, labels.filter(~classifier.held_out())).score(docs).collect()
    held = [r for r in scores if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] < 240]
    assert np.mean([(r["score"] >= 0.3) == (r["doc_id"] < 120) for r in held]) > 0.9
    assert len(scores) == 242 and all(0 <= r["score"] <= 1 for r in scores)
    assert {r["score"] for r in classifier.Model.fit(docs, labels.limit(0)).score(docs).collect()} == {0.5}


@pytest.mark.parametrize("batch", [1 << 16, 7])
def test_context_covers_all_texts(docs, texts, batch, monkeypatch):
    monkeypatch.setattr(classifier, "BATCH", batch)
    want = np.zeros((classifier.BUCKETS, classifier.DIM))
    for t in texts.values():
        h = [xxhash.xxh64_intdigest(w) for w in (t or "").split()]
        v = classifier.index_vectors(np.array(h, np.uint64))
        for i, x in enumerate(h):
            for j in range(max(0, i - classifier.NEAR), min(len(h), i + classifier.NEAR + 1)):
                if j != i:
                    want[x % classifier.BUCKETS] += v[j]
    want = (want / (np.linalg.norm(want, axis=1, keepdims=True) + 1e-9)).astype(np.float32)
    assert np.array_equal(classifier.context(docs), want)


def test_words_have_their_own_vectors(monkeypatch):
    """Words of one bucket and form differ, and a memo that is cleared gives the same vectors."""
    names = [f"w{i}" for i in range(30_000)]
    words = classifier._Words(classifier.vectors_of(np.zeros((classifier.BUCKETS, classifier.DIM), np.float32)))
    rows = words.rows(names)
    v = words.vectors[rows]
    assert len({x.tobytes() for x in v}) == len(names)
    monkeypatch.setattr(classifier, "MEMO", 10)
    for i in range(0, 300, 50):
        rows = words.rows(names[i : i + 50])
        assert np.array_equal(words.vectors[rows], v[i : i + 50])


@pytest.mark.parametrize("n", [2, 3, 12, 49, 400])
def test_temperature_is_fitted_at_any_size(n):
    """Labels that the features only half explain make the network less sure of itself."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((n, 5))
    y = (x[:, 0] + 2 * rng.standard_normal(n) > 0).astype(float)
    y[:2] = [0, 1]
    net = classifier.Network(x, y)
    assert net.temperature != 1.0
    assert n < 400 or net.temperature > 2
    assert classifier.Network(x[:1], y[:1]).temperature == 1.0


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 64)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(800, None), (801, [0.0] * 64), (802, [float("nan")] * 64), (803, [1.0]), (804, []), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    d = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    assert sorted(got) == list(range(0, 700, 50))
    for q, rows in got.items():
        s = d @ d[q]
        s[q] = -2
        best = sorted(range(700), key=lambda i: (-round(s[i], 9), i))[:5]
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
        assert all(abs(s[i] - c) < 1e-9 for _, i, c in rows)
        hits += len({i for _, i, _ in rows} & set(best))
    assert hits / (5 * len(got)) >= 0.9
    assert [i for _, i, _ in got[100]] == [101, 102, 103, 104, 105]
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "vec_id long, embedding array<float>")
    assert ann.nearest(few, few.filter("vec_id = 0")).count() == 2
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 63, 500, dtype=np.uint64) & rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    index = ann.MultiIndex(codes)
    for r in (0, 1, 5, 14, 27, 64):
        for c in codes[:20]:
            assert index.within(c, r).tolist() == np.flatnonzero(np.bitwise_count(codes ^ c) <= r).tolist()


CLASH = ["kept", "N_WORDS", "_words", "_text", "_row", "row", "n_removed", "_copy", "node", "root", "spans", "sequence_id", "offset", "_group", "at", "shard", "slot", "_mix", "_key", "bucket"]


@pytest.fixture(scope="module")
def clashing(spark, texts):
    """Texts with nulls, repeats and every name that the operators use, each column holding its own value."""
    clean = {1000 + i: f"{' '.join(WORDS)} of the and {i} " + " ".join(f"{w}{i}x{k}" for k, w in enumerate(WORDS * 5)) for i in range(4)}
    rows = [(i if i % 11 else None, t, *(f"{c}{i}" for c in CLASH)) for i, t in (texts | clean).items()] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(3)


def test_stages_keep_columns_of_any_name(spark, clashing):
    import corpus_pipeline as p

    docs = clashing
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == clashing.columns, name
        rows = out.collect()
        assert rows and all(len({r[c].removeprefix(c) for c in CLASH}) == 1 for r in rows), name
        assert stage(spark, clashing.limit(0), "").count() == 0
        assert stage(spark, clashing.select("doc_id", "text"), "").columns == ["doc_id", "text"]
    last = p.STAGES[-1][1](spark, clashing, "")
    assert last.count() >= clashing.count() and p.STAGES[-1][1](spark, clashing.limit(0), "").count() == 0


def test_operators_replace_columns_of_their_own_names(spark, clashing):
    n = clashing.count()
    judged = quality.judge(clashing)
    assert judged.count() == n and dict(judged.dtypes)["kept"] == "boolean" and sum(c.lower() == "n_words" for c in judged.columns) == 1
    assert {r["_words"][:6] for r in judged.collect()} == {"_words"}
    dealt = sharding.shard(clashing, "doc_id", [1.0] * 3)
    assert dealt.columns.count("shard") == 1 and dealt.count() == n and all(r["_mix"].startswith("_mix") for r in dealt.collect())
    sized = clashing.withColumn("piece", F.lit(0)).withColumn("length", F.lit(5)).withColumn("doc_id", F.lit(None).cast("long"))
    packed = packing.pack(sized, 2, 64)
    assert packed.columns.count("offset") == 1 and packed.count() == n and all(r["at"].startswith("at") for r in packed.collect())
    for r in pii.find(clashing.select("doc_id", "text", "spans")).collect():
        assert r["spans"] is not None


def test_equal_rows_are_dealt_over_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RUN", 50)
    rows = spark.createDataFrame([(None, "x")] * 700 + [(i, "y") for i in range(300)], "doc_id long, t string").repartition(4)
    by = defaultdict(list)
    for r in sharding.shard(rows, "doc_id", [1.0] * 4).collect():
        by[r["shard"]].append(r["slot"])
    assert sum(map(len, by.values())) == 1000 and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_equal_rows_are_packed_in_groups_of_one_size(spark):
    rows = spark.createDataFrame([(None, 0, 7)] * 1000, "doc_id long, piece int, length long").repartition(4)
    out = packing.pack(rows, 4, 64).collect()
    sizes = Counter(r["sequence_id"] >> 32 for r in out)
    assert len(out) == 1000 and len(sizes) == 4 and max(sizes.values()) < 260
    text = "a b " * 100_000
    assert packing.groups_for(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), 10) >= 4


def test_very_long_texts(spark):
    """One text of a million characters goes through every operator whole."""
    rng = random.Random(8)
    text = " ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(110_000)) + " call me: ann@mail.example.com"
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    n = len(text.split())
    assert {r["n_words"] for r in quality.judge(docs).collect()} == {n}
    assert sorted(r["n_removed"] for r in substring.remove_repeats(docs).collect()) == [sum(r["n_removed"] for r in substring.remove_repeats(docs.limit(1)).collect()), n]
    assert {r["component_id"] for r in simhash.classes(docs).collect()} == {1} and simhash.heads(docs).count() == 1
    assert all(r["spans"][0]["end"] == len(text) for r in pii.find(docs).collect())
    tokens = Tokenizer.from_file(bpe.default_path()).encode(text, add_special_tokens=False).ids
    assert {r["ids_sha256"] for r in bpe.digests(docs).collect()} == {hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest()}
    packed = packing.pack(packing.pieces(docs), 1).collect()
    assert sum(r["length"] for r in packed) == 2 * (len(tokens) + 1) and max(r["length"] for r in packed) == 2048
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert len({r["score"] for r in classifier.Model.fit(docs, labels).score(docs).collect()}) == 1
    chats = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text")
    assert {r["loss_chars"] for r in chat.digests(chat.format_turns(chats)).collect()} == {len(text)}


def test_pipeline(spark, tmp_path, texts):
    """Each stage on its own input, by what its operator's test holds."""
    import corpus_pipeline as p

    clean = [f"{' '.join(WORDS)} of the and {i} " + " ".join(f"{w}{i}x{k}" for k, w in enumerate(WORDS * 5)) for i in range(12)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*clean, clean[0], clean[1] + " ann@mail.example.com", *texts.values()])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = p.STAGES[0][1](spark, docs, str(tmp_path))
    assert {*range(12)} <= {r[0] for r in kept.collect()} and kept.columns == columns
    once = p.STAGES[1][1](spark, kept, str(tmp_path))
    ids = {r[0] for r in once.collect()}
    assert ids == _heads({r["doc_id"]: r["text"] for r in kept.collect()}) and 12 not in ids and once.columns == columns
    less = p.STAGES[2][1](spark, once, str(tmp_path))
    before = {r["doc_id"]: r["text"] for r in once.collect()}
    want = _removed(before)
    assert {r["doc_id"]: r["text"] for r in less.collect()} == {i: want[i][2] if want[i][1] else before[i] for i in before}
    safe = p.STAGES[3][1](spark, less, str(tmp_path))
    assert not any("@mail.example" in r["text"] for r in safe.collect()) and safe.columns == columns and safe.count() == less.count()
    out = p.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == ids
    assert hashlib.sha256(b"".join(r["ids"] for r in out.filter("doc_id = 3").orderBy("piece").collect())).hexdigest() == hashlib.sha256(bpe.encode(before[3], bpe.vocabulary(bpe.default_path())) + b"\0" * 4).hexdigest()
    assert out.filter(F.col("offset") + F.col("length") > 2048).count() == 0
