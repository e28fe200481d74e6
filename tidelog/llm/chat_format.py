"""Chat formatting: a finite-state machine over roles, driven by a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Template:
    """What surrounds each role's text, which roles are learnt, and which turn may follow which.

    ``marks``: role -> (before, after); a role without marks gets ``other``,
    whose opening names the role. ``moves``: state -> role -> next state.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>"),
    })
    other: tuple[str, str] = ("[TURN] ", " [/TURN]")
    learnt: frozenset[str] = frozenset({"assistant"})
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "asked", "user": "open"}, "asked": {"user": "open"},
        "open": {"assistant": "answered"}, "answered": {"user": "open"},
    })
    final: frozenset[str] = frozenset({"answered"})


#: A control string, with any number of back slashes after its first character.
CONTROL = r"([<\[])(\\*)(/?s>|/?(?:SYS|INST|OUT|TURN)\])"
_CONTROL = re.compile(CONTROL)
_STUFFED = re.compile(r"([<\[])\\(\\*)(/?s>|/?(?:SYS|INST|OUT|TURN)\])")


def escape(text: str) -> str:
    """No control string is left; one more back slash stands in each place where one was."""
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _STUFFED.sub(r"\1\2\3", text)


def escape_name(role: str) -> str:
    """A role's name in one line: a line break is back slash and n; back slashes right before a line break or an n are doubled."""
    return re.sub(r"(\\*)\n|(\\+)n", lambda m: 2 * (m[1] or "") + "\\n" if m[2] is None else 2 * m[2] + "n", escape(role))


def unescape_name(name: str) -> str:
    return unescape(re.sub(r"(\\+)n", lambda m: m[1][: len(m[1]) // 2] + ("\n" if len(m[1]) % 2 else "n"), name))


SEGMENTS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("part", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("loss", T.BooleanType()), T.StructField("state", T.StringType()),
])
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("segment", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("part", pa.string()),
    ("text", pa.string()), ("loss", pa.bool_()), ("state", pa.string()),
])


def _step(template: Template, state: str, role: str | None) -> str:
    return template.moves.get(state, {}).get(role or "", "invalid")


def chat_segments(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Three segments for each turn (opening, body, closing): conv_id, segment, turn, role, part, text, loss, state.

    Rows are dealt out by conversation and sorted by turn; then one pass
    carries only the machine's state, so that a conversation of any length
    needs no more memory than one batch; it takes one task, as each state
    depends on the turn before. ``loss`` is true for the body of a
    learnt role alone. ``state`` is the machine's state after the turn;
    ``invalid`` from the first turn that may not follow on, and the turns
    behind it are formatted all the same.

    Defined cases: a null text is empty, a null role is written as an empty
    name, a null conv_id is a conversation of its own; equal turns go by role,
    then text; repeated rows are turns of their own.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, segment = object(), "start", 0
        for batch in batches:
            out: list[tuple] = []
            for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if conv != last:
                    last, state, segment = conv, "start", 0
                state = _step(template, state, role)
                if role in template.marks:
                    before, after = template.marks[role]
                else:
                    before, after = template.other[0] + escape_name(role or "") + "\n", template.other[1]
                loss = role in template.learnt
                for part, piece, flag in (("open", before, False), ("body", escape(text), loss), ("close", after, False)):
                    out.append((conv, segment, turn, role, part, piece, flag, state))
                    segment += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _ARROW)], schema=_ARROW)

    return rows.mapInArrow(run, SEGMENTS)


class Reader:
    """Takes a formatted text piece by piece, wherever it is cut, and gives its turns by the template's marks alone."""

    def __init__(self, template: Template) -> None:
        self.roles = {before: role for role, (before, _) in template.marks.items()}
        self.after = {role: after for role, (_, after) in template.marks.items()}
        self.other = template.other
        self.longest = max(map(len, [*self.roles, template.other[0]]))
        self.held, self.role, self.close, self.sought = "", None, None, 0

    def _opened(self) -> bool:
        """Reads the opening that the held text begins with; false if it is not whole yet."""
        for before, role in self.roles.items():
            if self.held.startswith(before):
                self.role, self.close, self.held = role, self.after[role], self.held[len(before) :]
                return True
        if self.held.startswith(self.other[0]):
            name, line, rest = self.held[len(self.other[0]) :].partition("\n")
            if line:
                self.role, self.close, self.held = unescape_name(name), self.other[1], rest
            return bool(line)
        if len(self.held) >= self.longest:
            raise ValueError(f"no turn begins with {self.held[: self.longest]!r}")
        return False

    def turns(self, piece: str) -> Iterator[tuple[str, str]]:
        """(role, escaped text) of each turn that ends with this piece."""
        self.held += piece
        while self.held:
            if self.close is None:
                if not self._opened():
                    return
                self.sought = 0
            at = self.held.find(self.close, self.sought)
            if at < 0:
                self.sought = max(0, len(self.held) - len(self.close) + 1)
                return
            yield self.role, self.held[:at]
            self.held, self.close = self.held[at + len(self.close) :], None

    def ended(self) -> None:
        if self.held or self.close is not None:
            raise ValueError("the text ends within a turn")


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Parses the formatted text and sums it up for each conversation.

    Needs ``segments`` as :func:`chat_segments` gives them: a conversation's
    rows together and in order. Of them only the text and the loss flags are
    read: a conversation's texts, one behind the other, are parsed by the
    template's marks, and what stands under the flags is taken as it stands.
    Text that is not in the template's form is an error. Returns conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = run
        n = loss_chars = chars = 0
        state = "start"
        turns, learnt, reader = hashlib.sha256(), hashlib.sha256(), Reader(template)

        def row() -> tuple:
            reader.ended()
            return last, n, turns.hexdigest(), loss_chars, learnt.hexdigest(), chars, state in template.final

        def made(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            names = [x.split()[0] for x in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("conv_id", "text", "loss")]
            for conv, text, loss in zip(*columns, strict=True):
                if conv != last:
                    if last is not run:
                        out.append(row())
                    last, n, loss_chars, chars, state = conv, 0, 0, 0, "start"
                    turns, learnt, reader = hashlib.sha256(), hashlib.sha256(), Reader(template)
                chars += len(text)
                for role, body in reader.turns(text):
                    state = _step(template, state, role)
                    n += 1
                    turns.update(f"{role}\n{unescape(body)}\n".encode())
                if loss:
                    plain = unescape(text)
                    loss_chars += len(plain)
                    learnt.update(plain.encode())
            if out:
                yield made(out)
        if last is not run:
            yield made([row()])

    return segments.mapInArrow(run, schema)


def formatted(segments: DataFrame) -> DataFrame:
    """conv_id and the whole formatted text, for conversations that fit in a row."""
    return segments.groupBy("conv_id").agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda x: x["text"])).alias("text")
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """Adds conversation -1, whose two texts hold the template's own control strings; rows that have this id already are its turns, too."""
    spark, probe = conversations.sparkSession, "</s>[INST] ok [/INST]"
    rows = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?(?:SYS|INST|OUT|TURN)\])', '\1\\\2\3', 'g'))
    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 17 + length(coalesce(role, '')) END AS chars,
    role IS NOT NULL AND role = 'assistant' AS learnt,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
    count(*) OVER (PARTITION BY conv_id) AS total
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (learnt), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (learnt), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  coalesce(bool_and(CASE WHEN n = 1 THEN role IN ('system', 'user') WHEN role = 'assistant' THEN before = 'user'
                WHEN role = 'user' THEN before = 'assistant' OR before = 'system' AND n = 2 ELSE false END)
    AND bool_or(n = total AND role = 'assistant'), false) AS valid
FROM marked GROUP BY conv_id
"""
