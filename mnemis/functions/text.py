"""Names, hashes and keyword overlap of texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keyword overlap leaves out.
STOP_WORDS = "the a an is are was were in of to and or that this it with for on at by from be has have had".split()
#: Model families by the first part of a name that fits, in this order.
FAMILIES = (("llama", "llama"), ("phi", "phi"), ("gemma", "gemma"), ("qwen", "qwen"), ("mistral", "mistral"), ("deepseek", "deepseek"))


def slug(path: Column) -> Column:
    """The file name without extension in lower case: blanks and underscores are dashes, other signs go, dashes don't repeat."""
    name = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")
    plain = F.regexp_replace(F.lower(F.regexp_replace(name, r"[_\s]+", "-")), "[^a-z0-9-]", "")
    return F.btrim(F.regexp_replace(plain, "-+", "-"), F.lit("-"))


def file_name(slugged: Column, date: Column, index: Column, total: Column, time: Column | None = None) -> Column:
    """slug[_part]_date[_time].eng; part is the index from 0 plus one in three digits, if there is more than one."""
    part = F.when(total > 1, F.lpad((index + 1).cast("string"), 3, "0"))
    return F.concat(F.concat_ws("_", slugged, part, date, F.nullif(time, F.lit("")) if time is not None else F.lit(None).cast("string")), F.lit(".eng"))


def family(model: Column) -> Column:
    out = F.lit("unknown")
    for part, name in reversed(FAMILIES):
        out = F.when(F.contains(F.lower(model), F.lit(part)), name).otherwise(out)
    return out


def keywords(text: Column) -> Column:
    """Distinct words of letters and digits, longer than two, in lower case, without stop words."""
    words = F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def truncated(text: Column, n_bytes: int) -> Column:
    """text cut to so many UTF-8 bytes, an incomplete last character dropped."""
    short = F.substring(text.cast("binary"), 1, n_bytes).cast("string")
    return F.when(F.octet_length(text) <= n_bytes, text).otherwise(F.regexp_replace(F.make_valid_utf8(short), "\ufffd$", ""))


def context(prefix: Column, headers: Column, raw: Column) -> Column:
    """Prefix line, headers line, blank line, text; what is empty is left out."""
    head = F.concat_ws("\n", F.nullif(prefix, F.lit("")), F.nullif(F.array_join(headers, " > "), F.lit("")))
    return F.when(head == "", raw).otherwise(F.concat(head, F.lit("\n\n"), raw))


def default_if_falsy(value: Column, default: float) -> Column:
    """value, or the default where it is null or zero."""
    return F.coalesce(F.nullif(value, F.lit(0).cast("double")), F.lit(default))


def token_hash(tokens: Column) -> Column:
    """SHA-256 of whole numbers as 32-bit little-endian bytes, marked as such; empty for no tokens."""
    hexed = F.transform(tokens, lambda t: F.lpad(F.hex(t.cast("long")), 8, "0"))
    little = F.transform(hexed, lambda h: F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1))))
    return F.when(F.size(tokens) > 0, F.concat(F.lit("sha256:"), F.sha2(F.unhex(F.array_join(little, "")), 256))).otherwise("")


def short_model_id(path: Column) -> Column:
    """The model's name by its file: sizes that are known by name, else the first 15 characters."""
    name = F.regexp_replace(path, r"^.*/", "")
    return F.when(F.lower(name).contains("3b"), "Llama-3.2-3B").when(F.lower(name).contains("8b"), "Llama-3.1-8B").otherwise(F.substring(name, 1, 15))


def first_of(entries: Column, keys: list[str], default: str | None = None) -> Column:
    """The value of the first of the keys that a map has, as models name one thing under several prefixes; else the default."""
    return F.coalesce(*(F.try_element_at(entries, F.lit(k)) for k in keys), F.lit(default))
