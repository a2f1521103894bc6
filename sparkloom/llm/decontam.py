"""Benchmark decontamination by pigeonhole edit matching: error-budget-plus-one exact pieces, verified by Myers' bit-parallel distance."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import binary, trimmed, written

#: Edits allowed for each character of an item; characters below which an item is matched as it stands, between word boundaries.
RATE, LEAST = 0.08, 30
#: Bytes of items that are sent to the executors at once (their automaton takes some fifty times as much); more are matched in several passes.
BLOCK = 4 << 20
#: The matcher that a worker has built, by the name of its block: one at a time.
_BUILT: dict[str, Matcher] = {}


def normal(text: bytes) -> str:
    """Lower-cased A-Z, one space between words."""
    return b" ".join(text.lower().split()).decode("utf-8", "replace")


class Item:
    """One test item: its budget, its pieces, and the bit masks of its characters."""

    def __init__(self, item_id: int, text: str, rate: float, least: int = 0):
        self.item_id, self.text, self.short = item_id, text, len(text) < least
        self.budget = 0 if self.short else int(rate * len(text))
        n = self.budget + 1
        cuts = [len(text) * i // n for i in range(n + 1)]
        self.pieces = [(text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str) -> tuple[int, int]:
        """The least edit distance between the item and any part of text, and where the first such part ends."""
        if (at := text.find(self.text)) >= 0:
            return 0, at + len(self.text)
        m, get = len(self.text), self.masks.get
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score, best, end = full, 0, m, m, 0
        for i, c in enumerate(text, 1):
            eq = get(c, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            more, less = down | (full & ~(diagonal | up)), diagonal & up
            if more & top:
                score += 1
            elif less & top:
                score -= 1
                if score < best:
                    best, end = score, i
            more, less = more << 1 & full, less << 1 & full
            up, down = less | (full & ~(diagonal | more)), more & diagonal
        return best, end


class Matcher:
    """All items of a block: one automaton finds every exact piece in one walk over a text."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int = LEAST):
        import ahocorasick

        self.items = [Item(i, t, rate, least) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for piece, at in item.pieces:
                where.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def match(self, text: str) -> list[tuple[int, int, int]]:
        """item_id, distance and end in text of each item within its budget, its best place only."""
        regions: dict[tuple[int, int], None] = {}
        best: dict[int, tuple[int, int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for k, at in places:
                if not self.items[k].short:
                    regions[k, end - length + 1 - at >> 6] = None
                elif not text[max(0, end - length) : end - length + 1].isalnum() and not text[end + 1 : end + 2].isalnum():
                    best.setdefault(k, (0, end + 1))
        for k, cell in regions:
            item = self.items[k]
            if k in best and best[k][0] == 0:
                continue
            a = max(0, (cell << 6) - item.budget)
            d, end = item.distance(text[a : (cell + 1 << 6) + len(item.text) + item.budget])
            if d <= item.budget and (k not in best or (d, a + end) < best[k]):
                best[k] = d, a + end
        return [(self.items[k].item_id, d, end) for k, (d, end) in sorted(best.items())]


def _blocks(benchmark: DataFrame) -> Iterator[tuple[bool, list[tuple[int, str]]]]:
    """The items in blocks of bounded size, by hash; and whether there are several blocks."""
    own = binary(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK) or 1
    for i in range(n):
        rows = own.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect()  # BLOCK bytes, about
        items = sorted({(r["item_id"], normal(bytes(r["text"]))) for r in rows if r["item_id"] is not None})
        if items := [x for x in items if x[1]]:
            yield n > 1, items


def _task(docs: DataFrame, items: list[tuple[int, str]], rate: float, least: int, run):
    sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:  # once a worker, not once a task
            _BUILT.clear()
            _BUILT[name] = Matcher(sent.value, rate, least)
        for batch in batches:
            yield from run(_BUILT[name], batch)

    return task


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, distance and end (code points of the normalised text) of every match.

    A row of docs and an item match if some part of the text is within rate x length edits of the item, after lower-casing
    A-Z and single spaces. Null or empty texts match nothing; items that are null, empty or without
    id are left out; those under `least` characters match without edits, between word boundaries. Repeated doc_ids each give their rows; repeated items count once.
    """

    def run(matcher: Matcher, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [(d, *m) for d, x in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True) for m in matcher.match(normal(x.as_py()))]
        if rows:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "distance", "end"])

    schema = "doc_id long, item_id long, distance long, end long"
    own = binary(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = [written(x) if several else x for several, items in _blocks(benchmark) for x in [own.mapInArrow(trimmed(_task(docs, items, rate, least, run)), schema)]]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """The rows of docs, whole, that match no item."""

    def run(matcher: Matcher, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array([not matcher.match(normal((x.as_py() or "").encode())) for x in batch["text"]], pa.bool_()))

    for several, items in _blocks(benchmark):
        docs = docs.mapInArrow(trimmed(_task(docs, items, rate, least, run)), docs.schema)
        docs = written(docs) if several else docs  # a block is done before the next one comes
    return docs
