r"""Personal data by weak supervision.

Base spans come from fixed patterns and checks. Further candidates come from wider patterns. Labelers vote on
every candidate: its form, a checksum, gazetteers, words that announce a kind, and what stands beside it.
Expectation-maximisation over the histogram of votes estimates how far each labeler can be relied on. A logistic
classifier, trained on the estimated labels, sees the span and its neighbours instead of the votes, and alone
decides which further candidates are spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemis.llm.common import cut, map_rows, short_batches, table, whole

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match always starts where a run of digits starts, so nothing is tried inside a run.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS, _DIGIT_RUNS = re.compile(r"[0-9]"), re.compile(r"[0-9]+")
#: Wider forms: other spellings, and what a base match that failed its check has run together.
_AT, _DOT = r" ?(?:@|[\[({<] ?at ?[\])}>]) ?", r" ?(?:\.|[\[({<] ?(?:dot|\.) ?[\])}>]) ?"
_MORE = {
    "email": re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}", re.I),
    "ip": re.compile(rf"(?<![0-9A-Za-z])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9A-Za-z])|(?<![0-9A-Za-z:])(?:[0-9a-f]{{1,4}}:){{7}}[0-9a-f]{{1,4}}(?![0-9A-Za-z:])", re.I),
    "card": re.compile(r"(?<![0-9A-Za-z+.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z-])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+().-])(?:\+[0-9]{1,3}[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"),
}
#: What a text must hold for a wider form to be tried; all other forms have digits.
_OPENS = {"email": re.compile(r"[\[({<] ?at ?[\])}>]|[\[({<] ?dot ?[\])}>]| @|@ ", re.I), "ip": re.compile(r"[0-9][^0-9]{1,7}[0-9]{1,3}[^0-9]{1,7}[0-9]|:[0-9a-f]{1,4}:", re.I)}
#: Top-level domains, card issuers' first digits, words that announce a kind.
TLDS = frozenset("com org net edu gov io de fr es it uk eu ch at info biz".split())
ISSUERS = ("34", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "65")
CUES = {
    "email": re.compile(r"e-?mail|contact|write|correo|kontakt|courriel|mailto", re.I),
    "ip": re.compile(r"\bip\b|addr|host|server|login|client", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|karte|tarjeta|carte|pay", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|cell|telefon|llam|appel", re.I),
}
_NEAR = 40
LABELERS = 5
#: Probability from which a further candidate is a span; candidates of a vote pattern that the classifier is fitted on, at most.
THRESHOLD, FIT_ROWS = 0.9, 64


class Candidate(NamedTuple):
    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, ...]  # form, checksum, gazetteer, cue, neighbours: 1 for, -1 against, 0 none; a wider form says nothing


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: at each @, the longest run before it that no earlier match holds, then a domain."""
    done, at = 0, -1
    while (at := text.find("@", at + 1)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
            at = done - 1


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _beside(text: str, start: int, end: int) -> tuple[str, str]:
    """What stands before and after a span, past one blank: a word, a number, a sign, or the end of the text."""

    def kind(at: int, step: int) -> str:
        if 0 <= at < len(text) and text[at] == " ":
            at += step
        if not 0 <= at < len(text) or text[at] == "\n":
            return "end"
        return "number" if text[at].isdigit() else "word" if text[at].isalpha() else "sign"

    return kind(start - 1, -1), kind(end, 1)


def _octets(span: str) -> list[str]:
    return _DIGIT_RUNS.findall(span)


def _checks(kind: str, span: str) -> tuple[int, int]:
    """Votes of a checksum or range, and of a gazetteer."""
    digits = "".join(_DIGITS.findall(span))
    if kind == "card":
        return 1 if luhn(digits) else -1, 1 if digits.startswith(ISSUERS) else -1
    if kind == "email":
        return 0, 1 if re.split(r"[^A-Za-z0-9]+", span.lower().rstrip("])}> "))[-1] in TLDS else -1
    if kind == "ip":
        if ":" in span:
            return 1, 0
        return 1 if all(map(_byte, _octets(span))) else -1, -1 if any(len(x) > 1 and x[0] == "0" for x in _octets(span)) else 1
    area = digits[-10:-7]
    return 1 if len(digits) >= 10 and area[:1] not in ("0", "1") else -1, 1 if span.startswith(("+", "(")) else 0


def _votes(kind: str, text: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    check, known = _checks(kind, text[start:end])
    beside = _beside(text, start, end)
    alone = -1 if beside.count("number") == 2 else 1 if "number" not in beside else 0
    return (1 if base else 0, check, known, 1 if CUES[kind].search(text, max(0, start - _NEAR), start) else 0, alone)


class _Taken:
    """Places of a text that spans hold, as sorted runs apart from each other."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Holds a to b, unless some of it is held already."""
        i = bisect_left(self.starts, b)
        if i and self.ends[i - 1] > a:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


def candidates(text: str) -> list[Candidate]:
    """All base spans, and further candidates that overlap none."""
    base = base_spans(text)
    out = [Candidate(k, a, b, True, _votes(k, text, a, b, True)) for k, a, b in base]
    taken, digits = _Taken([(a, b) for _, a, b in base]), bool(_DIGITS.search(text))
    for kind, pattern in _MORE.items():
        if not _OPENS[kind].search(text) if kind in _OPENS else not digits:
            continue
        for m in pattern.finditer(text):
            if taken.add(*m.span()):
                out.append(Candidate(kind, *m.span(), False, _votes(kind, text, *m.span(), False)))
    return out


def pattern_of(c: Candidate) -> int:
    code = KINDS.index(c.kind)
    for v in c.votes:
        code = 3 * code + v + 1
    return code


def _unpack(code: int) -> tuple[int, list[int]]:
    votes = []
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, votes[::-1]


#: How often each labeler is taken to be right at first: form, checksum, gazetteer, cue, neighbours; and the weight of that beside what is counted.
TRUST, TRUST_WEIGHT = np.array([0.9, 0.98, 0.75, 0.7, 0.55]), 1.0


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of each vote pattern, by EM with a reliability for each labeler and kind.

    Labelers are taken as independent given the truth; those that don't vote say nothing. Reliabilities start at
    TRUST, which goes on counting as a share of the candidates, so results don't change as the corpus grows. No
    labeler is taken to be worse than chance.
    """
    kinds, votes = zip(*(_unpack(int(p)) for p in patterns))
    kinds, votes = np.array(kinds), np.array(votes, float)
    prior, right = np.full(len(KINDS), 0.5), np.tile(TRUST, (len(KINDS), 2, 1))
    for _ in range(rounds):
        yes, no = np.log(prior[kinds]), np.log1p(-prior[kinds])
        for j in range(votes.shape[1]):
            v = votes[:, j]
            p, q = right[kinds, 1, j], right[kinds, 0, j]
            yes = yes + np.where(v > 0, np.log(p), np.where(v < 0, np.log1p(-p), 0))
            no = no + np.where(v < 0, np.log(q), np.where(v > 0, np.log1p(-q), 0))
        post = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
        for k in range(len(KINDS)):
            own = kinds == k
            held = TRUST_WEIGHT * counts[own].sum() + 1
            w1, w0 = counts[own] * post[own], counts[own] * (1 - post[own])
            prior[k] = (w1.sum() + held / 2) / (w1.sum() + w0.sum() + held)
            for j in range(votes.shape[1]):
                v = votes[own, j]
                right[k, 1, j] = np.clip((w1[v > 0].sum() + held * TRUST[j]) / (w1[v != 0].sum() + held), 0.02, 0.98)
                q = (w0[v < 0].sum() + held * TRUST[j]) / (w0[v != 0].sum() + held)
                right[k, 0, j] = np.clip(max(q, 1 - right[k, 1, j]), 0.02, 0.98)
    return post


_SIDES = ("word", "number", "sign", "end")


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """What the classifier sees of a span: its make-up, what can be computed from it, and its neighbours. No vote on its form."""
    span = text[start:end]
    digits = "".join(_DIGITS.findall(span))
    check, known = _checks(kind, span)
    before, after = _beside(text, start, end)
    letters, signs = sum(c.isalpha() for c in span), sum(not c.isalnum() for c in span)
    own = [1.0, len(span) / 32, len(digits) / 16, len(set(digits)) / 10, letters / len(span), signs / 8, float(" " in span), float(span[0] in "+("), float(check), float(known)]
    beside = [float(x == s) for x in (before, after) for s in _SIDES]
    cue = [float(bool(CUES[kind].search(text, max(0, start - _NEAR), start)))]
    shared = [1.0, *beside, *cue]
    return shared + [x if kind == k else 0.0 for k in KINDS for x in own]


class SpanModel:
    """Logistic regression on `features`, its classes the labels that EM estimated."""

    def __init__(self, weights: np.ndarray | None):
        self.weights = weights

    def probability(self, c: Candidate, text: str) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(np.dot(features(c.kind, text, c.start, c.end), self.weights), -30, 30))))


def train(patterns: np.ndarray, counts: np.ndarray, sample: list[tuple[int, list[float]]]) -> SpanModel:
    """sample: (pattern, features) of candidates. Each pattern weighs as it is counted, to the power 1/2, so rare ones are heard."""
    if not sample:
        return SpanModel(None)
    post = dict(zip(patterns.tolist(), estimate(patterns, counts)))
    of, x = np.array([p for p, _ in sample]), np.array([f for _, f in sample])
    y = np.array([post[int(p)] for p in of])
    n, have = dict(zip(patterns.tolist(), counts)), dict(zip(*np.unique(of, return_counts=True)))
    weight = np.array([np.sqrt(n[int(p)]) / have[p] for p in of])
    weight, w = weight / weight.sum(), np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-4 * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return SpanModel(w)


def fit(docs: DataFrame) -> SpanModel:
    """The classifier. EM runs on the votes on all candidates of all documents, whose histogram has 4 * 243 patterns at most;
    the classifier is fitted on FIT_ROWS candidates of each pattern at most, those with the smallest hash."""

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        counts: dict[int, int] = {}
        some: dict[int, dict[int, bytes]] = {}
        for (text,) in it:
            for c in candidates(text or ""):
                k = pattern_of(c)
                counts[k] = counts.get(k, 0) + 1
                h, held = xxhash.xxh64_intdigest(text[max(0, c.start - _NEAR) : c.end + _NEAR]) >> 1, some.setdefault(k, {})
                if h not in held and (len(held) < FIT_ROWS or h < max(held)):
                    held[h] = np.array(features(c.kind, text, c.start, c.end)).tobytes()
                    if len(held) > FIT_ROWS:
                        del held[max(held)]
        for k, n in counts.items():
            yield k, n, None, None
            yield from ((k, 0, h, x) for h, x in some[k].items())

    rows = cut(map_rows(docs.select("text"), run, "pattern int, n long, h long, x binary"))
    counts = sorted(rows.groupBy("pattern").agg(F.sum("n").alias("n")).collect())
    one = rows.filter("h is not null").groupBy("pattern", "h").agg(F.first("x").alias("x"))
    few = one.withColumn("k", F.row_number().over(Window.partitionBy("pattern").orderBy("h"))).filter(F.col("k") <= FIT_ROWS).select("pattern", "h", "x").collect()
    if not counts:
        return SpanModel(None)
    sample = [(r["pattern"], np.frombuffer(r["x"]).tolist()) for r in sorted(few, key=lambda r: (r["pattern"], r["h"]))]
    return train(np.array([r[0] for r in counts]), np.array([r[1] for r in counts], float), sample)


def spans_of(text: str, model: SpanModel) -> list[Candidate]:
    """Base spans, and the further candidates that the classifier takes, by kind as listed, then start."""
    take = (c for c in candidates(text) if c.base or model.probability(c, text) >= THRESHOLD)
    return sorted(take, key=lambda c: (KINDS.index(c.kind), c.start))


def find(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """doc_id, text, spans (kind, start, end, base) of each row of docs; positions count code points, end exclusive.

    docs: doc_id and text; other columns are left out. A null text is empty and has no spans. Rows are judged
    alone, so repeated rows get equal spans. An empty table gives no rows. model: that of `fit`, by default fitted on docs.
    """
    model = fit(docs) if model is None else model

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc, text in it:
            yield doc, text or "", [{"kind": c.kind, "start": c.start, "end": c.end, "base": c.base} for c in spans_of(text or "", model)]

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, text string, spans array<struct<kind:string,start:int,end:int,base:boolean>>", batch=512)


def masked(text: str, spans: list[Candidate]) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the first, then longest, is taken."""
    out, at = [], 0
    for c in sorted(spans, key=lambda c: (c.start, -c.end)):
        if c.start >= at:
            out += [text[at : c.start], f"[{c.kind.upper()}]"]
            at = c.end
        else:
            at = max(at, c.end)
    return "".join([*out, text[at:]])


def masked_rows(docs: DataFrame, model: SpanModel) -> DataFrame:
    """docs with each span in text replaced by its kind; all other columns stay, whatever their names and types. A null text stays null."""
    held = docs.select("text", whole(docs).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else masked(t, spans_of(t, model)) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b["row"]], names=["text", "row"])

    short_batches(docs.sparkSession)
    out = held.mapInArrow(run, T.StructType([T.StructField("text", T.StringType()), held.schema["row"]]))
    return out.select(*(F.col("text").alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in documents; n_<kind> and base_sha256 are of base spans. A null text has none."""
    found = find(table(spark, sf_dir, "documents")).select("doc_id", "spans")
    join = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(join(base), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))
