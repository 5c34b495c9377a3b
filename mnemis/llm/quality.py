"""Quality rules: a table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemis.llm.common import BLANK, table, unpacked, whole

#: Frequent function words of English, German, Spanish and French.
STOP_WORDS = (
    "the of and in to is for with that by on are this from at be it as an a was or "
    "der die das und ist den von zu mit dem nicht ein eine sich auf im in auch es "
    "el la los las de que y en un una es por con para del se no su lo "
    "le les des et en une du est dans pour que qui sur au par avec ne pas"
).split()

_SYMBOLS = r"[^#*$%&|<>]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, though body names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that a text holds twice or more, each word once.

    Windows are sorted by hash and words, so equal ones are neighbours and none is missed;
    the starts of repeated ones, in order, each add the words not covered by the one before.
    """

    def window(w: Column, i: Column) -> Column:
        a, b, c = F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)
        return F.struct(F.xxhash64(a, b, c).alias("h"), a.alias("a"), b.alias("b"), c.alias("c"), i.alias("i"))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    def starts(s: Column) -> Column:
        again = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(r: Column) -> Column:
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        add = lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"))
        return F.aggregate(r, first, add, lambda s: s["n"].cast("long"))

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: window(w, i))
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), lambda s: covered(starts(s))))

    return let(words, of)


class Rule(NamedTuple):
    """A text passes if least <= value <= most; a null value passes."""

    name: str
    value: Column
    least: float | None
    most: float | None


def base_counts(text: Column, words: Column) -> dict[str, Column]:
    """The counts that rules are made of; all are of the whole text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, BLANK, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, _SYMBOLS, "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words),
        "n_lines": F.size(lines).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS + [s.capitalize() for s in STOP_WORDS]))).cast("long"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> list[Rule]:
    """The thresholds in use, over the columns of `base_counts`."""
    n = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    lines = F.nullif(F.col("n_lines"), F.lit(0)).cast("double")
    return [
        Rule("mean_word_length", F.col("word_chars") / n, 2.0, 25.0),
        Rule("symbols_per_word", F.col("n_symbols") / n, None, 0.2),
        Rule("stop_word_ratio", F.col("n_stop_words") / n, 0.04, None),
        Rule("duplicate_line_ratio", F.col("n_dup_lines") / lines, None, 0.5),
    ]


def _judged(docs: DataFrame, table_of: list[Rule] | None) -> tuple[DataFrame, list[str]]:
    """The rows of docs as the struct `_row`, beside the columns that are added, and the names of these."""
    table_of = rules() if table_of is None else table_of
    held = docs.select(whole(docs).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    counts = base_counts(F.col("_text"), F.col("_words"))
    counted = held.withColumn("_words", words_of(F.col("_text"))).withColumns(counts).drop("_words", "_text")
    flags = {}
    for r in table_of:
        fails = F.lit(False)
        if r.least is not None:
            fails = fails | (r.value < r.least)
        if r.most is not None:
            fails = fails | (r.value > r.most)
        flags[f"fails_{r.name}"] = F.coalesce(fails, F.lit(False))
    out = counted.withColumns({"base_failed": base_failed()} | flags)
    out = out.withColumn("kept", ~reduce(lambda a, b: a | b, (F.col(c) for c in flags), F.col("base_failed")))
    return out, [*counts, "base_failed", *flags, "kept"]


def judge(docs: DataFrame, table_of: list[Rule] | None = None) -> DataFrame:
    """docs with the base counts, base_failed, a boolean fails_<rule> for each rule, and kept.

    docs: text and any other columns; columns with the added names are replaced. Built-in functions
    in one projection chain, so no shuffle: a text of any length is judged alone and whole, however often it is
    repeated. A null text has no words and is rejected like an empty one. An empty table gives no rows.
    """
    out, added = _judged(docs, table_of)
    return unpacked(out, "_row", added)


def passing(docs: DataFrame, table_of: list[Rule] | None = None) -> DataFrame:
    """The rows of docs that `judge` keeps, with all their columns as they are, whatever their names."""
    return _judged(docs, table_of)[0].filter("kept").select("_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents by the base rules and the thresholds. Nulls as in `judge`."""
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SQL_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS + [s.capitalize() for s in STOP_WORDS]))
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
c AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    len(l) AS n_lines, len(list_filter(w, lambda x: x IN ({_SQL_STOP}))) AS n_stop
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR coalesce(word_chars / nullif(n_words, 0)::DOUBLE NOT BETWEEN 2.0 AND 25.0, FALSE)
    OR coalesce(n_symbols / nullif(n_words, 0)::DOUBLE > 0.2, FALSE) OR coalesce(n_stop / nullif(n_words, 0)::DOUBLE < 0.04, FALSE)
    OR coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE > 0.5, FALSE)) AS kept
FROM b"""
