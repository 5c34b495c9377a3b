"""Model state blobs: binary streams of cells and per-layer key and value matrices, as rows of one cell each."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

F16 = 1
SCHEMA = "path string, section int, kind string, layer int, head int, cell int, pos int, vec array<float>"


class Section(NamedTuple):
    n_heads: int
    head_dim: int


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("short blob")
        self.at += n
        return self.data[self.at - n : self.at]

    def read(self, form: str) -> tuple:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))


def decode(data: bytes, sections: list[Section]) -> Iterator[tuple[int, str, int, np.ndarray, list[int]]]:
    """(section, kind, layer, values by head, cell and dim, cell positions). One stream for each section."""
    if len(data) < 20:
        raise ValueError("short blob")
    b = _Bytes(data)
    (n,) = b.read("I")
    if n > 100:
        raise ValueError(f"architecture name of {n} bytes")
    b.take(n)
    (streams,) = b.read("I")
    if streams != len(sections):
        raise ValueError(f"{streams} streams for {len(sections)} sections")
    for k, s in enumerate(sections):
        (cells,) = b.read("I")
        if not 1 <= cells <= 200_000:
            raise ValueError(f"{cells} cells")
        positions = []
        for _ in range(cells):
            pos, seqs = b.read("iI")
            b.take(4 * seqs)
            positions.append(pos)
        turned, layers = b.read("II")
        if not 1 <= layers <= 200:
            raise ValueError(f"{layers} layers")
        width = s.n_heads * s.head_dim
        for kind in "KV":
            for layer in range(layers):
                (form,) = b.read("i")
                if form != F16:
                    raise ValueError(f"type {form}")
                if kind == "V" and turned:
                    size, embd = b.read("II")
                    if size != 2 or embd != width:
                        raise ValueError("value width")
                    x = np.frombuffer(b.take(2 * embd * cells), "<f2").reshape(width, cells).T
                else:
                    (row,) = b.read("Q")
                    if row != 2 * width:
                        raise ValueError("row width")
                    x = np.frombuffer(b.take(row * cells), "<f2").reshape(cells, width)
                yield k, kind, layer, x.reshape(cells, s.n_heads, s.head_dim).transpose(1, 0, 2), positions


def header(data: bytes, most: int = 5) -> dict:
    """What a blob's first stream says of itself, without its matrices: architecture, streams, cells, layers, and the type and
    row size of the keys of the first `most` layers. A short or odd blob gives what could be read, and an error."""
    out: dict = {"size": len(data), "arch": None, "streams": None, "cells": None, "turned": None, "layers": None, "keys": [], "error": None}
    b = _Bytes(data)
    try:
        (n,) = b.read("I")
        out["arch"] = b.take(min(n, 100)).decode("utf-8", "replace")
        (out["streams"],) = b.read("I")
        (out["cells"],) = b.read("I")
        for _ in range(out["cells"]):
            b.take(4 * b.read("iI")[1])
        turned, out["layers"] = b.read("II")
        out["turned"] = bool(turned)
        for _ in range(min(most, out["layers"])):
            form, row = b.read("iQ")
            out["keys"].append({"type": form, "row": row})
            b.take(row * out["cells"])
    except (ValueError, struct.error) as e:
        out["error"] = str(e)
    return out


HEADER = "path string, size long, arch string, streams long, cells long, turned boolean, layers long, keys array<struct<type:int,row:long>>, error string"


def headers_of(files: DataFrame) -> DataFrame:
    """`header` of each file. files: path and content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in HEADER.split(", ")]
        for pdf in batches:
            rows = [{"path": path} | header(bytes(data)) for path, data in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame([[r[n] for n in names] for r in rows], columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, HEADER)


def encode(parts: list[tuple[np.ndarray, np.ndarray]], turned: bool = False, arch: bytes = b"llama") -> bytes:
    """A blob of sections (keys, values), each by layer, head, cell and dim."""
    out = [struct.pack("<I", len(arch)), arch, struct.pack("<I", len(parts))]
    for keys, values in parts:
        layers, heads, cells, dims = keys.shape
        out += [struct.pack("<I", cells), *(struct.pack("<iIi", i, 1, 0) for i in range(cells)), struct.pack("<II", turned, layers)]
        for kind, x in (("K", keys), ("V", values)):
            for layer in x.astype("<f2"):
                flat = layer.transpose(1, 0, 2).reshape(cells, heads * dims)
                if kind == "V" and turned:
                    out += [struct.pack("<iII", F16, 2, heads * dims), flat.T.tobytes()]
                else:
                    out += [struct.pack("<iQ", F16, 2 * heads * dims), flat.tobytes()]
    return b"".join(out)


def estimate_size(layers: int, heads: int, cells: int, dims: int, arch: int = 5) -> int:
    """Bytes of a one-section blob with one sequence for each cell."""
    return 4 + arch + 4 + 4 + 12 * cells + 8 + 2 * layers * (12 + 2 * heads * dims * cells)


def cells_of(files: DataFrame, sections: list[Section]) -> DataFrame:
    """Rows of cells. files: path and content, as Spark's binary file reader gives them. A bad blob is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                for k, kind, layer, x, positions in decode(bytes(data), sections):
                    heads, cells, _ = x.shape
                    yield pd.DataFrame({
                        "path": path, "section": k, "kind": kind, "layer": layer, "head": np.repeat(np.arange(heads), cells), "cell": np.tile(np.arange(cells), heads),
                        "pos": np.tile(positions, heads), "vec": list(x.reshape(heads * cells, -1).astype(np.float32)),
                    })

    return files.select("path", "content").mapInPandas(run, SCHEMA)
