"""Chat formatting by event-sourced reconstruction.

A log has events (conv_id, seq, kind, msg, role, text): `message` opens a message, `delta` appends to it, `edit` replaces its text,
`regenerate` empties it for the deltas that follow, `delete` takes it away. The log is dealt by conversation and
sorted by sequence; every task folds its conversations one after the other as a stream, so that it holds one
conversation at a time, and renders the final messages.

The template: a system turn is <<SYS>>...<</SYS>>, a user turn [INST]...[/INST], an assistant turn [ASST]...</s>, any other
<|role|>...<|/|>. Inside texts (and other roles) a backslash is written \\\\, < is \\l and [ is \\b (and |, in roles, \\p), so no marker
occurs in them, and the output can be read back. The loss mask covers what stands between [ASST] and </s>.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[ASST]", "</s>")}
#: What stands for a character inside texts.
CODES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_ESCAPE, _UNESCAPE = re.compile(r"[\\<\[]"), re.compile(r"\\([\\lbp])")
_PLAIN = {"\\": "\\", "l": "<", "b": "[", "p": "|"}
_TEXT = r"((?:[^\\<\[]|\\.)*+)"
_TURN = re.compile(rf"<<SYS>>{_TEXT}<</SYS>>|\[INST\]{_TEXT}\[/INST\]|\[ASST\]{_TEXT}</s>|<\|((?:[^\\<\[|]|\\.)*+)\|>{_TEXT}<\|/\|>", re.S)
KINDS = ("message", "delta", "edit", "regenerate", "delete")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: CODES[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _PLAIN[m[1]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's string, and the spans that training loss covers."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        start, end = MARKS.get(role) or (f"<|{escape(role).replace('|', chr(92) + 'p')}|>", "<|/|>")
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(start), at + len(start) + len(body)))
        parts += [start, body, end]
        at += len(start) + len(body) + len(end)
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        system, user, assistant, role, other = m.groups()
        named = next(((k, v) for k, v in (("system", system), ("user", user), ("assistant", assistant)) if v is not None), None)
        out.append((named[0], unescape(named[1])) if named else (unescape(role), unescape(other)))
        at = m.end()
    return out


def fold(events: list[tuple]) -> list[tuple[str, str]]:
    """Final (role, text) messages, in order of their opening, of a conversation's events (kind, msg, role, text) in
    order. An event without an open message of its number opens one."""
    order: list[list] = []
    latest: dict = {}
    for kind, msg, role, text in events:
        if kind == "message" or msg not in latest and kind != "delete":
            latest[msg] = [role or "", [text or ""]]
            order.append(latest[msg])
        elif kind == "delta":
            latest[msg][1].append(text or "")
        elif kind in ("edit", "regenerate"):
            latest[msg][1] = [text or ""] if kind == "edit" else []
        elif kind == "delete":
            if msg in latest:
                latest.pop(msg)[0] = None
        else:
            raise ValueError(f"unknown kind of event {kind!r}")
    return [(role, "".join(parts)) for role, parts in order if role is not None]


def turns_as_events(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A log in which every row opens a message."""
    return conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("seq"), F.lit("message").alias("kind"), F.col(turn_col).cast("long").alias("msg"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))


def reconstruct(events: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, mask (array of start, end in code points), n_turns.

    Events with equal seq come in order of kind (messages first), msg, role and text, nulls first. Repeated events count each. Null
    texts and roles are empty; a null conv_id is a conversation. Extra columns are left out; an empty log has no
    conversations. A conversation is one output value, so one task writes it whatever its length.
    """
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    log = events.select("conv_id", "seq", kind.alias("k"), "msg", "role", "text", "kind")
    order = ["conv_id", "seq", "k", "msg", "role", "text"]
    conv_type = events.schema["conv_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def rows(done: list[tuple], type_: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([x[0] for x in done], type_), pa.array([x[1] for x in done], pa.string()), pa.array([[{"start": a, "end": b} for a, b in x[2]] for x in done], span), pa.array([x[3] for x in done], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "formatted", "mask", "n_turns"])

        def end(conv, held: list[tuple]) -> tuple:
            turns = fold(held)
            return conv, *render(turns), len(turns)

        held, now, type_ = [], None, None
        for batch in batches:
            done = []
            type_ = batch.schema.field(0).type
            for conv, _, _, msg, role, text, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and conv != now:
                    done.append(end(now, held))
                    held = []
                now = conv
                held.append((kind, msg, role, text))
            if done:
                yield rows(done, type_)
        if held:
            yield rows([end(now, held)], type_)

    dealt = log.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(scan, f"conv_id {conv_type}, formatted string, mask array<struct<start: bigint, end: bigint>>, n_turns long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the rendered strings alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    conv_type = formatted.schema["conv_id"].dataType.simpleString()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, turns, chars, loss, size = [], [], [], [], []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                read = parse(text)
                n.append(len(read))
                turns.append(sha("".join(f"{role}\n{body}\n" for role, body in read)))
                learnt = "".join(unescape(text[x["start"] : x["end"]]) for x in mask)
                chars.append(len(learnt))
                loss.append(sha(learnt))
                size.append(len(text))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "mask").mapInArrow(scan, f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(probe)
    return read_back(reconstruct(turns_as_events(rows)))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') ro, coalesce(text, '') t, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, 2 * length(t) - length(translate(t, '\<[', '')) + CASE ro WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 10 ELSE 9 + 2 * length(ro) - length(translate(ro, '\<[|', '')) END n FROM c)
SELECT CAST(conv_id AS BIGINT) conv_id, count(*) n_turns, sha256(string_agg(ro || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) turns_sha256, CAST(sum(CASE WHEN ro = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) loss_chars, sha256(coalesce(string_agg(CASE WHEN ro = 'assistant' THEN t END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST), '')) loss_sha256, CAST(sum(n) AS BIGINT) formatted_chars FROM e GROUP BY conv_id
"""
