"""Markdown into chunks of bounded length, by headers, then paragraphs, then merging neighbours.

A text that fits is one chunk, as it is. Headers keep their marks; headers inside code fences count, as in any line
scan. Offsets are true character offsets into the content, and a header above a part is named once. With `compat`
both are as tools that this one replaces have them: each paragraph counts two characters more, so offsets drift where
breaks are longer, the last range of a part may overshoot by two, and headers of nested parts are named again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

_HEADER = re.compile(r"^(#{1,6})\s+(.+)$", re.M)
_BREAK = re.compile(r"\n{2,}")


class Chunk(NamedTuple):
    start: int
    end: int
    headers: tuple[str, ...]


def sections(text: str, level: int) -> list[Chunk]:
    """Parts of text that headers up to `level` open; a part carries the headers above it. Blank parts vanish."""
    out: list[Chunk] = []
    stack: list[tuple[int, str]] = []
    at = 0
    for m in _HEADER.finditer(text):
        depth = len(m[1])
        if depth <= level:
            if m.start() > at:
                out.append(Chunk(at, m.start(), tuple(h for _, h in stack)))
                at = m.start()
            stack = [*(h for h in stack if h[0] < depth), (depth, m[0].strip())]
    out.append(Chunk(at, len(text), tuple(h for _, h in stack)))
    return [c for c in out if text[c.start : c.end].strip()]


def paragraphs(text: str, most: int, compat: bool = False) -> list[tuple[int, int]]:
    """text in runs of paragraphs of at most `most` characters, each with the break behind it; a longer paragraph stays whole."""
    breaks = [m.span() for m in _BREAK.finditer(text)]
    if compat:
        sizes = [b - a + 2 for a, b in zip([0, *(e for _, e in breaks)], [*(s for s, _ in breaks), len(text)])]
    else:
        ends = [*(e for _, e in breaks), len(text)]
        sizes = [b - a for a, b in zip([0, *ends], ends)]
    out, start, end = [], 0, 0
    for size in sizes:
        if end > start and end - start + size > most:
            out.append((start, end))
            start = end
        end += size
    return [*out, (start, end)] if end > start else out


def chunks(text: str, most: int = 2000, compat: bool = False) -> list[Chunk]:
    if not text.strip():
        return []
    if len(text) <= most:
        return [Chunk(0, len(text), ())]
    parts: list[Chunk] = []
    for s in sections(text, 2):
        body = text[s.start : s.end]
        inner = sections(body, 4) if len(body) > most else []
        for t in inner if len(inner) > 1 else [Chunk(0, len(body), ())]:
            headers = (*s.headers, *t.headers) if compat else tuple(dict.fromkeys((*s.headers, *t.headers)))
            runs = [(t.start, t.end)] if t.end - t.start <= most else [(t.start + a, t.start + b) for a, b in paragraphs(body[t.start : t.end], most, compat)]
            parts += [Chunk(s.start + a, s.start + b, headers) for a, b in runs]
    out: list[Chunk] = []
    for p in parts:
        if not text[p.start : p.end].strip():
            continue
        if out and (out[-1].end - out[-1].start) + (p.end - p.start) <= most:
            out[-1] = Chunk(out[-1].start, p.end, out[-1].headers)
        else:
            out.append(p)
    return out


SCHEMA = "source string, chunk_index int, chunk_total int, char_start long, char_end long, headers array<string>, raw_text string"


def chunk_rows(docs: DataFrame, most: int = 2000, compat: bool = False) -> DataFrame:
    """Chunks of each row of docs (source, content); a blank or null content has none. raw_text is stripped, but not that of a text that fits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for source, content in zip(pdf["source"], pdf["content"]):
                parts = chunks(content or "", most, compat)
                raw = lambda c: content if len(content) <= most else content[c.start : c.end].strip()
                rows += [(source, i, len(parts), c.start, c.end, list(c.headers), raw(c)) for i, c in enumerate(parts)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("source", "content").mapInPandas(run, SCHEMA)
