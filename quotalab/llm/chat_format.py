"""Chat formatting: records of many layouts become one marked text for each piece of a conversation.

A record is JSON. The hash of its nested field paths, its schema fingerprint, selects a declarative mapping, and the
mapping gives the record's turns. The template marks each turn and escapes its control strings inside texts, so that
turns and the text under the loss mask can be read back exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved, small_batches

#: A turn is written as OPEN role NAME text CLOSE. The marks inside roles and texts get a backslash before them.
OPEN, NAME, CLOSE = "### ", ": ", "</turn>\n"
_ESCAPED = re.compile(r"\\|###|</turn>|: ")
_BACK = re.compile(r"\\(\\|###|</turn>|: )")
#: Turns of a conversation in one record; longer ones are cut, so that no record grows with its conversation.
RECORD_TURNS = 64


@dataclass(frozen=True)
class Mapping:
    """How a layout gives turns: each (role, path) in order, or the objects of a list with a role and a text field.

    A path that the record lacks or that is null gives no turn in the first form; a null text is empty in the second.
    """

    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict)

    def read(self, record: dict) -> list[tuple[str, str]]:
        if not self.items:
            return [(role, _text(record[path])) for role, path in self.turns if record.get(path) is not None]
        return [(self.roles.get(x.get(self.role), _text(x.get(self.role))), _text(x.get(self.text))) for x in record[self.items] if x]


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def field_paths(value: object, prefix: str = "") -> set[str]:
    """Nested field paths, [] for list elements; what a list holds only once counts once."""
    if isinstance(value, dict):
        return set().union(*({f"{prefix}{k}"} if not isinstance(v, (dict, list)) else field_paths(v, f"{prefix}{k}.") for k, v in value.items())) if value else {f"{prefix}{{}}"}
    if isinstance(value, list):
        base = prefix.rstrip(".") + "[]"
        inner = set().union(*(field_paths(v, f"{base}.") if isinstance(v, (dict, list)) else {base} for v in value))
        return inner or {base}
    return {prefix.rstrip(".")}


def fingerprint(paths: set[str] | tuple[str, ...]) -> str:
    """The hash of a layout: its sorted field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


_SHARED = {"human": "user", "gpt": "assistant", "bot": "assistant"}
LAYOUTS = (
    Mapping(("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping(("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping(("prompt", "response", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping(("answer", "question"), (("user", "question"), ("assistant", "answer"))),
    Mapping(("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping(("instruction", "output", "system"), (("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping(("input", "instruction", "output"), (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(("messages[].content", "messages[].role"), items="messages", role="role", text="content"),
    Mapping(("conversations[].from", "conversations[].value"), items="conversations", role="from", text="value", roles=_SHARED),
    Mapping(("dialog[].speaker", "dialog[].utterance"), items="dialog", role="speaker", text="utterance", roles=_SHARED),
    Mapping(("messages[]",)),
)


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def render(turns: list[tuple[str, str]], loss_roles: tuple[str, ...] = ("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """(text, loss mask as code point spans): the whole written text of each turn of loss_roles is a span."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{NAME}", escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{CLOSE}")
        at += len(out[-1])
    return "".join(out), spans


#: The first unescaped mark ends a role or a text; a backslash always comes with what it escapes.
_TURN = re.compile(r"### ((?:[^\\:]|\\(?:\\|###|</turn>|: )|:(?! ))*+): ((?:[^\\<]|\\(?:\\|###|</turn>|: )|<(?!/turn>))*+)</turn>\n", re.S)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def _formatted(layouts: tuple[Mapping, ...]):
    known = {fingerprint(m.paths): m for m in layouts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, turns, texts, spans = [], [], [], []
            for raw in batch.column("record").to_pylist():
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                mark = fingerprint(field_paths(record)) if isinstance(record, dict) else None
                found = known[mark].read(record) if mark in known else None
                text, loss = render(found) if found is not None else (None, None)
                marks.append(mark)
                turns.append(len(found) if found is not None else None)
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in loss] if loss is not None else None)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = [pa.array(x, k) for x, k in zip((marks, turns, texts, spans), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seq"), *columns], ["conv_id", "seq", "fingerprint", "n_turns", "text", "loss"])

    return run


def format_records(records: DataFrame, layouts: tuple[Mapping, ...] = LAYOUTS, id_col: str = "conv_id", seq_col: str = "seq", record_col: str = "record") -> DataFrame:
    """One row for each record: conv_id, seq, fingerprint, n_turns, text, loss (code point spans of the loss mask).

    A record that is null, no JSON object, or of a layout without a mapping has a null text, n_turns and loss, and its
    fingerprint tells which layout to add. Rows that repeat are formatted each.
    """
    small_batches(records.sparkSession)
    picked = records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(seq_col).cast("long").alias("seq"), F.col(record_col).cast("string").alias("record"))
    return picked.mapInArrow(_formatted(layouts), "conv_id long, seq long, fingerprint string, n_turns long, text string, loss array<struct<start:long,end:long>>")


def _as_record(turns: list[tuple[str, str]]) -> str:
    roles = [r for r, _ in turns]
    texts = [t for _, t in turns]
    if roles == ["user", "assistant"]:
        record = dict(zip(("prompt", "completion"), texts, strict=True))
    elif roles == ["system", "user", "assistant"]:
        record = dict(zip(("system", "instruction", "output"), texts, strict=True))
    else:
        record = {"messages": [{"role": r, "content": t} for r, t in turns]}
    return json.dumps(record, ensure_ascii=False)


def _in_order(df: DataFrame, *by: str) -> DataFrame:
    """Rows of a conversation together and in order; they stream, so that a long conversation needs no memory."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *by)


def to_records(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most: int = RECORD_TURNS) -> DataFrame:
    """(conv_id, seq, record): rows of turns as records, at most `most` turns each, ordered by seq.

    Turns go by turn number, then role and text. Null roles and texts are empty; rows without an id form one
    conversation of a null id.
    """
    picked = rows.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, held = object(), 0, []
        out: list[tuple] = []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if held and (conv != now or len(held) == most):
                    out.append((now, seq, _as_record(held)))
                    held, seq = [], seq + 1
                if conv != now:
                    now, seq = conv, 0
                held.append((role, text))
            if len(out) >= 256:
                yield _record_batch(out)
                out = []
        if held:
            out.append((now, seq, _as_record(held)))
        if out:
            yield _record_batch(out)

    return _in_order(picked, "turn", "role", "text").mapInArrow(run, "conv_id long, seq long, record string")


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "seq", "record"])


_DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out = object(), []
    state: list = []

    def close() -> None:
        out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        done = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], _DIGESTS)
        out.clear()
        return done

    for batch in batches:
        for conv, text, loss in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "text", "loss")), strict=True):
            if conv != now or not state:
                if state:
                    close()
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text or ""):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for span in loss or ():
                own = unescape(text[span["start"] : span["end"]])
                state[2] += len(own)
                state[3].update(own.encode())
            state[4] += len(text or "")
        if len(out) >= 1000:
            yield flush()
    if state:
        close()
    if out:
        yield flush()


def conversation_digests(rows: DataFrame, extra: list[tuple[int, int, str, str]] = ()) -> DataFrame:
    """Digests of all conversations (with extra rows of turns), read back from their written formatted text."""
    spark = rows.sparkSession
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    if extra:
        turns = turns.unionByName(spark.createDataFrame(list(extra), turns.schema))
    written = saved(format_records(to_records(turns)), "chat")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _in_order(written.select("conv_id", "seq", "text", "loss"), "seq").mapInArrow(_digests, schema)
