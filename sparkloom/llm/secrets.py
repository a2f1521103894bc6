"""Secret scans: three base patterns, and an assignment-aware lexer that scores literals by the names they reach."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import trimmed

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a shorter run fails as a whole, and so does every later start in it
_HEX = re.compile(r"[0-9a-f]{32,}")

_QUOTED = r'"(?:[^"\\\n]|\\.)*"' + r"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
_TERM = rf"(?:{_QUOTED}|[A-Za-z_][\w.]*)"
#: name = literal, "name": literal, name["x"] = literal, name := literal + NAME + literal, name: >- with indented lines; <name>literal</name>.
_PAIR = re.compile(
    rf"""(?:(?P<tag><(?P<element>[A-Za-z_][\w.-]{{0,63}})>)(?P<inner>[^<\n]+)</(?P=element)>)
    |(?:(?P<name>(?<![\w.])[A-Za-z_][\w.-]{{0,127}})(?:\[(?P<q>["'])(?P<key>[^"'\n]{{1,64}})(?P=q)\])?|(?P<k>["'])(?P<string>[A-Za-z_][\w. -]{{0,127}})(?P=k))
    [\x20\t]*(?::=|=>|(?<![=!<>])=(?![=~])|:(?![:/]))[\x20\t]*
    (?P<value>(?P<block>[|>][-+0-9]{{0,2}}[\x20\t]*(?=\n))|(?P<sum>{_TERM}(?:[\x20\t]*\+[\x20\t]*(?:{_QUOTED})|[\x20\t]+\+[\x20\t]+{_TERM})+)|(?:{_QUOTED})|[^\s"'`,;(){{}}<>\[\]]+)""",
    re.X | re.A,
)
_PART = re.compile(rf"(?P<quoted>{_QUOTED})|[A-Za-z_][\w.]*", re.A)
_LINE = re.compile(r"\n(?:(?P<indent>[\x20\t]*)(?P<line>\S[^\n]*)|[\x20\t]*(?=\n|\Z))")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NAME = re.compile(r"[A-Za-z_][\w.]*\Z", re.A)
#: What makes a name sensitive, and what makes it name something about a secret and not the secret.
_SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "passcode": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "bearer": 2, "auth": 2, "authorization": 2, "private": 1, "access": 1, "api": 1, "client": 1, "signing": 2, "encryption": 2, "key": 1, "pin": 2, "salt": 1, "session": 1, "webhook": 1, "dsn": 2}
_ABOUT = {"count", "length", "len", "limit", "max", "min", "type", "url", "uri", "path", "file", "name", "id", "ttl", "expiry", "expires", "field", "label", "hint", "policy", "prompt", "size", "budget", "tokens", "tokenizer"}
_PLACEHOLDER = re.compile(r"(?:x+|\*+|\.+|-+|null|none|nil|true|false|undefined|todo|changeme|change_me|example\w*|placeholder|redacted|your[\w-]*|\$\{.*|\$[A-Z_]+|%\w+%|<.*>|\{\{.*)\Z", re.I)


def name_score(name: str) -> int:
    words = [w.lower() for w in _WORDS.findall(name)]
    return sum(_SENSITIVE.get(w, 0) for w in set(words)) - 3 * (bool(words) and words[-1] in _ABOUT)


def literal_score(value: str) -> int:
    """0 for what can't be a secret, else 1 to 4: by length, kinds of characters and entropy."""
    if len(value) < 6 or " " in value or _PLACEHOLDER.match(value):
        return 0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return 1 + (n >= 12) + (bits >= 3.0) + (kinds >= 2)


def _block(text: str, name_at: int, at: int) -> tuple[str, list[tuple[int, int]]]:
    """The lines after at that are indented deeper than the line of name_at: joined, and as one span."""
    own = text[text.rfind("\n", 0, name_at) + 1 : name_at]
    depth, lines, span = len(own) - len(own.lstrip("\x20\t-")), [], []
    while (m := _LINE.match(text, at)) and (m["line"] is None or len(m["indent"]) > depth):
        at = m.end()
        if m["line"]:
            lines.append(m["line"].rstrip())
            span += [m.start("line"), m.start("line") + len(lines[-1])]
    return "".join(lines), [(span[0], span[-1])] if span else []


def lexed(text: str, least: int = 5) -> list[tuple[int, int]]:
    """Literals whose value reaches a sensitive name, directly or through constants: start and end.

    A name's value is a literal, a name seen before, or a sum of both; it keeps the places of all literals in it.
    """
    found, constants = set(), {}
    if not ("=" in text or ":" in text or "</" in text):
        return []
    for m in _PAIR.finditer(text):
        if m["tag"]:
            name, literal, spans = m["element"], m["inner"], [m.span("inner")]
        else:
            name, literal, (start, end) = m["key"] or m["name"] or m["string"], m["value"], m.span("value")
            if m["block"]:
                literal, spans = _block(text, m.start(), end)
            elif m["sum"] or literal[0] in "\"'`":
                literal, spans, joined = "", [], True
                for part in _PART.finditer(text, start, end):
                    if part["quoted"]:
                        literal, a, b = literal + part[0][1:-1], part.start() + 1, part.end() - 1
                        spans = [*spans[:-1], (spans[-1][0], b)] if spans and joined else [*spans, (a, b)]
                        joined = True
                    else:  # a name: its literals, where they stand; nothing where it isn't known
                        more, places = constants.get(part[0], ("", []))
                        literal, joined = literal + more, False
                        spans += [p for p in places if p not in spans]
                constants[name] = (literal, spans)
            elif (known := constants.get(literal)) and _NAME.match(literal):
                literal, spans = constants[name] = known  # a name for a name: the same literal
            else:
                literal = literal.rstrip(".:")
                spans = [(start, start + len(literal))]
        if spans and (score := name_score(name)) >= 2 and (worth := literal_score(literal)) and score + worth >= least:
            found.update(spans)
    return sorted(found)


def base(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans by start: the base ones, and literals that lie in none of them."""
    known = base(text)
    more = [("literal", a, b) for a, b in lexed(text) if not any(x <= a and b <= y for _, x, y in known)]
    return sorted(known + more, key=_order)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with a mark instead of each run of overlapping spans."""
    out, at, end = [], 0, 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[at:a], f"[{kind.upper()}]"]
        end = at = max(end, b)
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row.

    Offsets are code points, ends exclusive. Null text counts as empty and has no spans; null and repeated doc_ids stay
    rows of their own. Whole texts are scanned, each within one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch["text"]:
                spans = scan(x.as_py() or "")
                own = [s for s in spans if s[0] != "literal"]
                n = Counter(s[0] for s in own)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(spans)))
            if rows:
                yield pa.record_batch([batch["doc_id"], *(pa.array(c) for c in zip(*rows, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs with its secrets replaced by marks; other columns stay. Null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if (t := x.as_py()) is None or not (spans := scan(t)) else redacted(t, spans) for x in batch["text"]]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(trimmed(run), docs.schema)
