"""Byte-level BPE as a streaming transducer, and the decoder back.

Encoding rests on two facts about merge lists in which a token is made after its halves.
A token sequence is the merge result of its bytes exactly if each pair of neighbours is: no merge
ever crosses their border. And each prefix of a piece has one last token. So what a later byte can
still change starts at most `lookahead` bytes back, the longest token's bytes less one; tokens on
which the prefixes that end in this window agree are final, and are emitted.

Pieces (words with their space, numbers, signs, white space) never share tokens; a space before
anything but white space starts a piece. Texts are read in blocks and cut there. Every piece goes through
the transducer; what it gave for a short word is remembered.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from mnemis.llm.common import map_rows, table

#: White space of the piece pattern.
_WS = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = regex.compile(rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_ODD_SPACE = regex.compile(rf" (?:[{_WS}]|$)")
_CUT = regex.compile(rf" (?=[^{_WS}])")
_KINDS = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", rf"[^{_WS}\p{{L}}\p{{N}}]+", rf"[{_WS}]+")]
#: Characters of a block, and entries of the memo of what the transducer gave for short words.
BLOCK, MEMO = 1 << 16, 700_000
#: Bytes of a piece's start whose states are remembered.
HEAD = 6
#: Characters without a space beyond which the compiled library isn't asked: its time can grow with the square of a piece.
RUN = 512


def _byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str, plain: Callable[[str], list[int]] | None = None):
        """plain: a compiled way to the same tokens of text without special strings or long runs."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _byte_chars()
        self.bytes_of: dict[int, bytes] = {}
        self.id_of: dict[bytes, int] = {}
        for text, i in spec["model"]["vocab"].items():
            if all(c in of for c in text):
                self.bytes_of[i] = bytes(of[c] for c in text)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        ids = spec["model"]["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        self.made: list[int] = []  # by rank
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = ids[a], ids[b], ids[a + b]
            self.rank[a, b] = r
            self.made.append(whole)
            self.halves.setdefault(whole, (r, a, b))
        special = {*self.special.values()}
        for i, b in self.bytes_of.items():
            if i not in special and (len(b) == 1 or i in self.halves):
                self.id_of[b] = i
        self.longest = max(map(len, self.id_of))
        self.tails = _Tails(self.id_of)
        self.heads: dict[bytes, tuple[list[int], list[int]]] = {}
        self.lookahead = self.longest - 1
        self.of_byte = [self.id_of[bytes([b])] for b in range(256)]
        self.good: dict[tuple[int, int], bool] = {}
        self.four = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.plain = plain
        self.pieces: dict[str, bytes] = _Memo(self._piece, MEMO // 7)
        self.words: dict[str, bytes] = _Memo(self._word, MEMO)
        marks = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.mark = regex.compile(f"({marks})") if marks else None

    def _spine(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens that stand at one end while `token` is made: (rank of the merge that makes it, token), in time."""
        out = []
        while token in self.halves:
            r, a, b = self.halves[token]
            out.append((r, token))
            token = b if right else a
        return [(-1, token), *reversed(out)]

    def neighbours(self, a: int, b: int) -> bool:
        """If the bytes of a and b merge to just these two: no merge over their border comes before a's and b's own."""
        known = self.good.get((a, b))
        if known is None:
            if len(self.good) >= MEMO // 3:
                self.good.clear()
            known = self.good[a, b] = self._neighbours(a, b)
        return known

    def _neighbours(self, a: int, b: int) -> bool:
        left, right, i, j, far = self._spine(a, True), self._spine(b, False), 0, 0, 1 << 40
        while True:
            over = self.rank.get((left[i][1], right[j][1]), far)
            next_left = left[i + 1][0] if i + 1 < len(left) else far - 1
            next_right = right[j + 1][0] if j + 1 < len(right) else far - 1
            if over < next_left and over <= next_right:  # equal merges go from left to right
                return False
            if next_left == next_right == far - 1:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def piece(self, data: bytes) -> list[int]:
        """Tokens of a whole piece, by the transducer whatever its length."""
        stream = PieceStream(self)
        return [*stream.feed(data), *stream.finish()]

    def _piece(self, text: str) -> bytes:
        return b"".join([self.four[i] for i in self.piece(text.encode())])

    def _word(self, word: str) -> bytes:
        """A space and a word; most are letters and perhaps one sign."""
        if word.isalpha():
            return self._piece(" " + word)
        core, last = word[:-1], word[-1:]
        if last in _COMMON and core.isalpha():
            return self.words[core] + self.pieces[last]
        head, cut, tail = word.partition("\n")
        if tail.isalpha() and head and not head[-1].isspace():
            return self.words[head] + self.pieces[cut] + self.pieces[tail]
        return self.packed(" " + word)

    def packed(self, text: str) -> bytes:
        """Ids of a whole stretch of text, as little-endian 32-bit numbers."""
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))

    def stretch(self, text: str) -> bytes:
        """`packed`, by a memo of words; each space before anything but white space starts a piece."""
        if self.plain is not None and max(map(len, text.split(" "))) <= RUN:
            return np.array(self.plain(text), "<u4").tobytes()
        first, *rest = _CUT.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        out = b"".join(map(self.words.__getitem__, rest))
        return self.packed(first) + out


_COMMON = frozenset(".,!?;:")


class _Memo(dict):
    """What `make` gives for short texts on one line, and so many at most."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most = make, most

    def __missing__(self, text: str) -> bytes:
        out = self.make(text)
        if len(text) <= 24 and (len(text) == 1 or text[-1] not in _COMMON and "\n" not in text):
            if len(self) >= self.most:
                self.clear()
            self[text] = out
        return out


class _Tails(dict):
    """The lengths of tokens that end in one to three given bytes, longest first."""

    def __init__(self, id_of: dict[bytes, int]):
        self.id_of, of = id_of, {}
        for b in id_of:
            if len(b) >= 3:
                of.setdefault(b[-3:], []).append(len(b))
        self.update((tail, (*sorted({*n}, reverse=True), *self._short(tail[1:]))) for tail, n in of.items())

    def _short(self, tail: bytes) -> tuple[int, ...]:
        return tuple(n for n in range(len(tail), 0, -1) if tail[-n:] in self.id_of)

    def __missing__(self, tail: bytes) -> tuple[int, ...]:
        out = self._short(tail)
        if len(self) < MEMO:
            self[tail] = out
        return out


class PieceStream:
    """Tokens of one piece of any length, fed in parts. Holds the window and what isn't final yet."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.data, self.last, self.back = vocabulary, b"", [None], [0]

    def feed(self, data: bytes) -> list[int]:
        """last[p], back[p]: the last token of the prefix that ends at p, and where it starts."""
        v, known = self.v, self.v.good
        start, self.data = len(self.data), self.data + data
        data, last, back, tails, of = self.data, self.last, self.back, v.tails, v.id_of.get
        head = data[:HEAD] if not start and len(data) > HEAD else None
        if head in v.heads:  # what a prefix gives doesn't hang on what follows
            tokens, begins = v.heads[head]
            last += tokens
            back += begins
            start, head = HEAD, None
        for p in range(start + 1, len(data) + 1):
            for size in tails[data[p - 3 if p > 3 else 0 : p]]:
                if size > p:
                    continue
                token = of(data[p - size : p])
                if token is not None:
                    before = last[p - size]
                    if before is None:  # the piece starts here
                        break
                    fits = known.get((before, token))
                    if fits or fits is None and v.neighbours(before, token):
                        break
            last.append(token)
            back.append(p - size)
        if head is not None and len(v.heads) < MEMO:
            v.heads[head] = last[1 : HEAD + 1], back[1 : HEAD + 1]
        return self._final() if len(data) > 8 * v.longest else []

    def _path(self, end: int, start: int) -> list[int]:
        out = []
        while end > start:
            out.append(self.last[end])
            end = self.back[end]
        return out[::-1]

    def _final(self) -> list[int]:
        """Emits the tokens on which all prefixes that end in the window agree, and forgets them."""
        ends = {*range(max(0, len(self.data) - self.v.lookahead), len(self.data) + 1)}
        while len(ends) > 1:
            ends.add(self.back[top := max(ends)])
            ends.discard(top)
        at = ends.pop()
        out = self._path(at, 0)
        if at:
            self.data, self.last, self.back = self.data[at:], self.last[at:], [max(0, b - at) for b in self.back[at:]]
        return out

    def finish(self) -> list[int]:
        return self._path(len(self.data), 0)


class Encoder:
    """Feeds of text in, packed ids out as soon as no later text can change them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held, self.run, self.kind = vocabulary, "", None, None
        self.hold = max(map(len, vocabulary.special), default=1) - 1

    def feed(self, text: str) -> bytes:
        out = []
        text = self.held + text
        if self.run is not None:
            text = self._go_on(text, out, False)
            if self.run is not None:
                self.held = text
                return b"".join(out)
        text = self._marked(text, out)
        at = self._stable(text)
        if at:
            out.append(self.v.stretch(text[:at]))
        self.held = text[at:]
        if self.run is None and len(self.held) > BLOCK:
            self._stream(out)
        return b"".join(out)

    def finish(self) -> bytes:
        out = []
        if self.run is not None:
            self.held = self._go_on(self.held, out, True)
        out.append(self._all(self._marked(self.held, out)))
        self.held = ""
        return b"".join(out)

    def _marked(self, text: str, out: list[bytes]) -> str:
        """Emits all up to the last special string; returns what follows it."""
        if self.v.mark is not None and self.v.mark.search(text):
            *before, text = self.v.mark.split(text)
            for i, x in enumerate(before):
                out.append(self.v.four[self.v.special[x]] if i % 2 else self._all(x))
        return text

    def _all(self, text: str) -> bytes:
        return self.v.stretch(text) if text else b""

    def _stable(self, text: str) -> int:
        """Where the last piece starts that a space opens; a partial special string has no space and comes later."""
        at = len(text)
        while (at := text.rfind(" ", 0, at)) > 0:
            if at + 1 < len(text) and _CUT.match(text, at):
                return at
        return 0

    def _stream(self, out: list[bytes]) -> None:
        """No space in a whole block: emits all but the last pieces; a last piece that fills the block is streamed."""
        pieces = [m.span() for m in _PIECE.finditer(self.held)]
        safe = len(self.held) - self.hold - 4
        keep = next((a for a, b in reversed(pieces) if a < safe), 0)
        if keep:
            out += [self.v.pieces[self.held[a:b]] for a, b in pieces if a < keep]
            self.held = self.held[keep:]
        if len(self.held) > BLOCK // 2:
            lead = self.held[0] == " " and len(self.held) > 1 and not _KINDS[3].match(self.held, 1)
            self.kind = next(k for k in _KINDS if k.match(self.held, int(lead)))
            self.run = PieceStream(self.v)
            if lead:
                self._emit(self.run.feed(b" "), out)
                self.held = self.held[1:]
            self.held = self._go_on(self.held, out, False)

    def _emit(self, ids: list[int], out: list[bytes]) -> None:
        out.append(b"".join([self.v.four[i] for i in ids]))

    def _go_on(self, text: str, out: list[bytes], last: bool) -> str:
        """Feeds the open piece; returns what follows it. A special string's possible start and a run's last blank wait."""
        m = self.kind.match(text)
        end = m.end() if m else 0
        mark = self.v.mark.search(text, 0) if self.v.mark is not None else None
        limit = len(text) if last else len(text) - self.hold - 1
        if mark and mark.start() <= end:
            end, closed = mark.start(), True
        else:
            closed = last or end <= limit
            if not closed:
                end = max(0, min(end, limit))
            elif self.kind is _KINDS[3] and end < len(text):
                end -= 1
        if end > 0:
            self._emit(self.run.feed(text[:end].encode()), out)
        if closed:
            self._emit(self.run.finish(), out)
            self.run = self.kind = None
        return text[end:]


class Decoder:
    """Bytes in, text out: an incomplete character at the end waits for its next bytes; a broken one becomes U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held = vocabulary, b""
        top = max(vocabulary.bytes_of) + 1
        self.table = [vocabulary.bytes_of.get(i, b"") for i in range(top)]

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end may be the start of a character: state by lead byte and those still due."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                due = 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF8 else 1
                return back if due > back else 0
            if b < 0x80:
                return 0
        return 0

    def feed(self, ids: list[int]) -> str:
        table = self.table
        data = self.held + b"".join([table[i] for i in ids])
        wait = self._open(data)
        self.held = data[len(data) - wait :] if wait else b""
        return (data[: len(data) - wait] if wait else data).decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str, ranks: str | None = None) -> Vocabulary:
    """ranks: the same vocabulary as a file of ranks, by which a compiled library encodes plain text."""
    if ranks is None:
        return Vocabulary(path)
    import tiktoken

    with open(ranks, "rb") as f:
        of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("ranks", pat_str=_PIECE.pattern, mergeable_ranks=of, special_tokens={})
    return Vocabulary(path, known.encode_ordinary)


def _blocks(text: str, v: Vocabulary, block: int) -> Iterator[bytes]:
    e = Encoder(v)
    for i in range(0, len(text), block):
        yield e.feed(text[i : i + block])
    yield e.finish()


def encode(text: str, v: Vocabulary, block: int = BLOCK) -> bytes:
    """All ids of a text, packed. Read in blocks; only the ids grow with the text."""
    return b"".join(_blocks(text, v, block))


def round_trip(text: str, v: Vocabulary, decoder: Decoder, block: int = BLOCK) -> Iterator[tuple[np.ndarray, str]]:
    """The ids of a text and the text that they decode to, in blocks as they get final. Nothing else is held."""
    for ids in _blocks(text, v, block):
        numbers = np.frombuffer(ids, "<u4")
        yield numbers, decoder.feed(numbers.tolist())
    yield np.zeros(0, "<u4"), decoder.finish()


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (packed little-endian 32-bit), decoded: each text's tokens, and the text that they decode to.

    docs: doc_id and text; other columns are left out. A null text is empty; an empty text has no
    tokens and decodes to an empty text. Rows are independent: repeated rows give repeated results.
    A text of any length is read and decoded in blocks.
    """
    path = path or default_path()

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        v = vocabulary(path)
        decoder = Decoder(v)
        for doc, text in it:
            ids, shown = zip(*round_trip(text or "", v, decoder))
            yield doc, b"".join(x.tobytes() for x in ids), "".join(shown)

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, ids binary, decoded string", batch=512)


def digests(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 of each text, as `encode_decode` has them.

    Blocks are encoded, decoded and digested one after the other, so what is held doesn't grow with a text.
    """
    path = path or default_path()

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        v = vocabulary(path)
        decoder, names = Decoder(v), [b",%d" % i for i in range(max(v.bytes_of) + 1)]
        for doc, text in it:
            n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
            for ids, shown in round_trip(text or "", v, decoder, block):
                joined = b"".join([names[i] for i in ids.tolist()])
                of_ids.update(joined if n else joined[1:])
                of_text.update(shown.encode())
                n += len(ids)
            yield doc, n, of_ids.hexdigest(), of_text.hexdigest()

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded texts of documents. A null text is empty; rows are judged alone."""
    return digests(table(spark, sf_dir, "documents"))
