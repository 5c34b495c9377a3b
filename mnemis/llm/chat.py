r"""Chat formatting that is checked by parsing it back.

A turn is rendered as

    ### role: text</turn>

followed by a line feed. In the grammar a text holds no control string: no `###`, no `</turn>`, no backslash.
A turn is rendered as it is and parsed; if the parser refuses it or gives something else, its text is escaped,
the header then ends in `*:` instead of `:`, and it is parsed again; and so on, in forms that escape more, until
what comes back is identical. The last form escapes every character and always does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemis.llm.common import map_rows, parts, table

OPEN, END = "### ", "</turn>\n"
_HEAD = re.compile(r"### ((?:[^\\:*\n]|\\.)*)(\*?): ", re.S)
_ROLE = re.compile(r"[\\:*\n]")
_UNDO = re.compile(r"\\(.)", re.S)
#: What no text may hold unescaped: the end of a turn, a header, an escape.
_CONTROL = re.compile(r"\\|</turn>|###")
#: Escaped, each of them gets a backslash inside it; so does every # that starts ###, also in a longer run.
_MARKS = re.compile(r"\\|</turn>|#(?=##)")


def _escaped_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], role)


def _role(text: str) -> str:
    return _UNDO.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def escape(text: str) -> str:
    """Each control string gets a backslash inside it, so none is left whole; undone by `unescape`."""
    return _MARKS.sub(lambda m: {"\\": "\\\\", "</turn>": "<\\/turn>", "#": "#\\"}[m[0]], text)


def escape_all(text: str) -> str:
    return re.sub(r"(.)", r"\\\1", text, flags=re.S)


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def parse_turn(rendered: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """The turn that starts at `at`: role, text, where the text stands (code points, end exclusive), and where the next turn starts.

    A ValueError says where the rendered text breaks the grammar."""
    head = _HEAD.match(rendered, at)
    end = rendered.find(END, head.end()) if head else -1
    if end < 0:
        raise ValueError(f"no turn at {at}")
    body = rendered[head.end() : end]
    if bad := _CONTROL.search(_UNDO.sub("\0", body) if head[2] else body):
        raise ValueError(f"control string {bad[0]!r} in the turn at {at}")
    return _role(head[1]), unescape(body) if head[2] else body, head.end(), end, end + len(END)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """The turns of a rendered conversation: role, text, and where the text stands."""
    turns, at = [], 0
    while at < len(rendered):
        *turn, at = parse_turn(rendered, at)
        turns.append(tuple(turn))
    return turns


def render_turn(role: str, text: str) -> str:
    """A turn that parses back to the same role and text, in the first form that does."""
    name = _escaped_role(role)
    for star, form in (("", str), ("*", escape), ("*", escape_all)):
        one = f"{OPEN}{name}{star}: {form(text)}{END}"
        try:
            *turn, end = parse_turn(one)
        except ValueError:
            continue
        if turn[:2] == [role, text] and end == len(one):
            return one
    raise AssertionError("every character is escaped, so this can't be reached")


def render(turns: list[tuple[str, str]]) -> str:
    """The turns' text, which parses back to the same turns. A turn is parsed alone as in its conversation, as the
    parser starts anew behind each END."""
    return "".join(render_turn(role, text) for role, text in turns)


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_start, loss_end: each turn's rendered text and, of an assistant's, where its text stands in it; else null.

    rows: conv_id, turn, role, text; other columns are left out, whatever their names. The formatted texts of a
    conversation, in the order of rows in their partition, are its formatted text: by turn, ties by role and text;
    repeated rows are repeated turns. A null text or role is empty, a null turn comes first, null conv_ids are one
    conversation. Rows are dealt by conv_id, sorted (on disk if need be) and streamed, so a task holds one turn at a
    time, however long its conversations are. An empty table gives no rows.
    """

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for conv, role, text in it:
            one = render_turn(role, text)
            start, end = parse_turn(one)[2:4]
            yield conv, one, *((start, end) if role == "assistant" else (None, None))

    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = clean.repartition(parts(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_rows(dealt.select("conv_id", "role", "text"), run, "conv_id long, formatted string, loss_start int, loss_end int")


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (start and end of each assistant text in formatted), n_turns: whole conversations.

    As `format_turns`, but a conversation must fit in a row.
    """

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        key, pieces, loss, size = None, [], [], 0
        for conv, one, start, end in it:
            if pieces and conv != key:
                yield key, "".join(pieces), loss, len(pieces)
                pieces, loss, size = [], [], 0
            key = conv
            pieces.append(one)
            loss += [size + start, size + end] if start is not None else []
            size += len(one)
        if pieces:
            yield key, "".join(pieces), loss, len(pieces)

    return map_rows(format_turns(rows), run, "conv_id long, formatted string, loss array<int>, n_turns long")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of `format_turns`' rows, all read back from their text."""

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        key, n, chars, loss, every, under = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for conv, one, start, end in it:
            if n and conv != key:
                yield key, n, every.hexdigest(), loss, under.hexdigest(), chars
                n, chars, loss, every, under = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            key, n, chars = conv, n + 1, chars + len(one)
            role, text, a, b, _ = parse_turn(one)
            every.update(f"{role}\n{text}\n".encode())
            if (start, end) == (a, b):
                under.update(text.encode())
                loss += len(text)
        if n:
            yield key, n, every.hexdigest(), loss, under.hexdigest(), chars

    return map_rows(turns, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of conversations and conversation -7, all read back from the formatted text. Nulls as in `format_turns`."""
    text = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(format_turns(rows.unionByName(more)))


#: A backslash for each control string, and for each # of a run that two more follow.
ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, len(regexp_extract_all(role, '[\\:*\n]')) AS more_role,
    len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '</turn>'))
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS more
  FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + more_role + length(text) + more + CASE WHEN more > 0 THEN 1 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
