"""Chat formatting by schema fingerprint: the paths of a record's fields choose the declared mapping that makes turns of it."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]

#: Layouts by the paths that mark them. each: a list of turns with its role and text fields; fields: one turn a field,
#: of which those that are there and not empty count; several paths of a field are joined by an empty line.
LAYOUTS: list[dict] = [
    {"paths": ["messages[].role", "messages[].content"], "each": ("messages", "role", "content")},
    {"paths": ["messages[].role", "messages[].text"], "each": ("messages", "role", "text")},
    {"paths": ["conversations[].from", "conversations[].value"], "each": ("conversations", "from", "value")},
    {"paths": ["instruction", "input", "output"], "fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"paths": ["instruction", "output"], "fields": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"paths": ["system", "prompt", "response"], "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    {"paths": ["prompt", "response"], "fields": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"paths": ["prompt", "completion"], "fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"paths": ["question", "answer"], "fields": [("user", ["question"]), ("assistant", ["answer"])]},
    {"paths": ["role", "text"], "each": (None, "role", "text")},
]
#: Other names of the three roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a record; a list's items share one path."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(found: set[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(found)))


def registry(layouts: list[dict] = LAYOUTS) -> dict[int, dict]:
    return {fingerprint(set(x["paths"])): x for x in layouts}


class Mapper:
    """Chooses the layout of records, once for each fingerprint; fields that no layout knows don't stand in the way."""

    def __init__(self, layouts: list[dict] = LAYOUTS, roles: dict[str, str] = ROLES):
        self.layouts, self.roles, self.known = layouts, roles, dict(registry(layouts))

    def layout(self, found: set[str]) -> dict | None:
        key = fingerprint(found)
        if key not in self.known:
            fitting = [x for x in self.layouts if found >= set(x["paths"])]
            self.known[key] = max(fitting, key=lambda x: len(x["paths"]), default=None)
        return self.known[key]

    def turns(self, record: object) -> list[Turn] | None:
        layout = self.layout(paths(record)) if isinstance(record, dict) else None
        if layout is None:
            return None
        if "each" in layout:
            items, role, text = layout["each"]
            return [(self.role(x.get(role)), _text(x.get(text))) for x in (record[items] if items else [record]) if isinstance(x, dict)]
        out = []
        for role, fields in layout["fields"]:
            if parts := [_text(record[f]) for f in fields if record.get(f) not in (None, "")]:
                out.append((role, "\n\n".join(parts)))
        return out

    def role(self, name: object) -> str:
        return self.roles.get(name, name) if isinstance(name, str) else ""


def _text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


_OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
_CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
_CONTROL = r"<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[/ROLE\]|\[TURN\]|\[/TURN\]"
_IN_TEXT = re.compile(rf"\\*(?:{_CONTROL})")
_ESCAPED = re.compile(rf"\\(\\*(?:{_CONTROL}))")
_MARK = re.compile(rf"(?<!\\)(?:{_CONTROL})")


def escape(text: str) -> str:
    """A backslash before every control string, and before those that precede it: real marks never have one."""
    return _IN_TEXT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's formatted text, and the part of it under the loss mask: the text of an assistant. Marks and texts are apart by a space."""
    body = escape(text)
    if role in _OPEN:
        head, tail = f"{_OPEN[role]} ", f" {_CLOSE[role]}"
    else:
        head, tail = f"[ROLE] {escape(role)} [/ROLE][TURN] ", " [/TURN]"
    masked = role == "assistant"
    return head + body + tail, len(head) * masked, (len(head) + len(body)) * masked


def format_turns(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    out, mask, at = [], [], 0
    for role, text in turns:
        piece, a, b = format_turn(role, text)
        out.append(piece)
        if role == "assistant":
            mask.append((at + a, at + b))
        at += len(piece)
    return "".join(out), mask


def parse(formatted: str) -> list[Turn]:
    """Turns back from formatted text."""
    marks = [(m[0], m.start(), m.end()) for m in _MARK.finditer(formatted)]
    roles, out, role = {v: k for k, v in _OPEN.items()}, [], ""
    for (mark, _, a), (_, b, _) in zip(marks, marks[1:], strict=False):
        body = unescape(formatted[a + 1 : b - 1])
        if mark == "[ROLE]":
            role = body
        elif mark in roles or mark == "[TURN]":
            out.append((roles.get(mark, role), body))
    return out


def format_records(records: DataFrame, column: str = "record") -> DataFrame:
    """For JSON records: all columns, and fingerprint, formatted and mask (pairs of code points under the loss).

    Records that are null, no JSON object or of no known layout keep their row, with null formatted and mask.
    """
    taken = [c for c in records.columns if c not in ("fingerprint", "formatted", "mask")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = Mapper()
        for batch in batches:
            prints, texts, masks = [], [], []
            for x in batch[column]:
                try:
                    record = json.loads(x.as_py() or "null")
                except ValueError:
                    record = None
                turns = mapper.turns(record)
                text, mask = format_turns(turns) if turns is not None else (None, None)
                prints.append(f"{fingerprint(paths(record)):016x}" if isinstance(record, dict) else None)
                texts.append(text)
                masks.append(None if mask is None else [list(p) for p in mask])
            yield pa.record_batch([*batch.columns, pa.array(prints, pa.string()), pa.array(texts, pa.string()), pa.array(masks, pa.list_(pa.list_(pa.int64())))], names=[*batch.schema.names, "fingerprint", "formatted", "mask"])

    own = records.select(*taken)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(run, f"{fields}, fingerprint string, formatted string, mask array<array<long>>")


def format_conversations(rows: DataFrame) -> DataFrame:
    """Conversations given a row a turn: conv_id, seq (from 0), piece and mask (two offsets in the piece, or null).

    The pieces of a conversation, by seq, are its formatted text; they stand in order in one partition, and no more
    than one turn is held, however long a conversation is. Turns come by turn, then role, then text, nulls first;
    repeated turns are turns of their own. Roles stay as they are. Null role or text counts as empty; null conv_id is one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper, last, seq = Mapper(roles={}), (None, False), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                out = []
                for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                    seq = seq + 1 if last == (conv, True) else 0
                    last = (conv, True)
                    ((own, body),) = mapper.turns({"role": role, "text": text})
                    piece, a, b = format_turn(own, body)
                    out.append((conv, seq, piece, [a, b] if own == "assistant" else None))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())), strict=True)], names=["conv_id", "seq", "piece", "mask"])

    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), "role", "text")
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, seq long, piece string, mask array<long>")


def read_back(formatted: DataFrame) -> DataFrame:
    """What format_conversations() gave, parsed again: a row of digests for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def told() -> tuple:
            return held[0], held[1], held[2].hexdigest(), held[3], held[4].hexdigest(), held[5]

        for batch in batches:
            done = []
            for conv, seq, piece, mask in zip(*(batch[c].to_pylist() for c in ("conv_id", "seq", "piece", "mask")), strict=True):
                if seq == 0:
                    if held:
                        done.append(told())
                    held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(piece):
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode())
                if mask:
                    loss = unescape(piece[mask[0] : mask[1]])
                    held[3] += len(loss)
                    held[4].update(loss.encode())
                held[5] += len(piece)
            if done:
                yield _rows(done)
        if held:
            yield _rows([told()])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
