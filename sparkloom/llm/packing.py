"""Best-fit packing planned on a histogram of lengths: documents take planned slots by their rank within their length."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import CHUNK, binary, buckets, trimmed, word_chunks, written

CAPACITY, END = 2048, 0
#: Words whose ids a worker remembers.
REMEMBERED = 1_000_000
#: Documents whose pieces are told together.
TOGETHER = 250
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the others by turns from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


class WordIds(dict):
    """Ids of words as little-endian 32-bit numbers: this vocabulary never joins what white space parts, so a word's ids
    are always the same, and a text's are those of its words. A word is looked up once while it is remembered: in two
    generations, so that words in use stay when the older goes.
    """

    def __init__(self, path: str, remembered: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.remembered, self.old = remembered, {}
        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.model.tokenize
        self.packed = [np.uint32(i).tobytes() for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]

    def __missing__(self, word: bytes) -> bytes:
        if (ids := self.old.get(word)) is None:
            ids = self.learn(word)
        self[word] = ids
        return ids

    def learn(self, word: bytes) -> bytes:
        """A word that is one run of lower-case letters is the model's input as it stands; others take the whole way."""
        packed = self.packed
        if word.isalpha() and word.islower():
            return b"".join([packed[x.id] for x in self.split(word.decode())])
        text = word.decode("utf-8", "replace")
        if text.isalpha() and text == text.lower() and is_normalized("NFC", text) and "\ufffd" not in text:
            return b"".join([packed[x.id] for x in self.split(word.decode("latin-1").translate(_BYTE_LETTERS))])
        return b"".join([packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def of(self, words: list[bytes]) -> bytes:
        if len(self) > self.remembered // 2:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, words))


_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True


def _stops_apart(text: bytes) -> bytes:
    """A space between a letter and a full stop or comma. The vocabulary parts them there anyway; so there are fewer words."""
    raw = np.frombuffer(text, np.uint8)
    at = np.flatnonzero((raw == ord(",")) | (raw == ord(".")))
    at = at[at > 0]
    at = at[_LETTER[raw[at - 1]]]
    return np.insert(raw, at, ord(" ")).tobytes() if len(at) else text


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Words whose ids make up the text's. Case goes first, as the vocabulary has lower case only, but for texts with
    what may become one of its special marks."""
    for at, words in enumerate(word_chunks(text if b"<|" in text else _stops_apart(text.lower()))):
        if words or not at:
            yield words


@lru_cache(1)
def word_ids(path: str, remembered: int = REMEMBERED) -> WordIds:
    return WordIds(path, remembered)


def _cut(path: str, capacity: int, end: int, keep: bool, remembered: int = REMEMBERED):
    size, last = 4 * capacity, np.uint32(end).tobytes()

    def short(words: list[bytes]) -> list[bytes]:
        whole = word_ids(path, remembered).of(words) + last
        return [whole[at : at + size] for at in range(0, len(whole), size)]

    def long(text: bytes) -> Iterator[bytes]:
        held = b""
        for words in words_of(text):
            held += word_ids(path, remembered).of(words)
            cut = len(held) - len(held) % size
            yield from (held[at : at + size] for at in range(0, cut, size))
            held = held[cut:]
        yield held + last

    def told(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    def numbered(d: int, parts: Iterable[bytes]) -> Iterator[tuple]:
        return ((d, i, i * capacity, len(p) // 4, zlib.crc32(p), p if keep else None) for i, p in enumerate(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                rows = []
                for d, x in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                    text = x.as_py()
                    rows += numbered(d, short(next(words_of(text))) if len(text) <= CHUNK // 2 else long(text))
                    if len(rows) >= 10 * TOGETHER:
                        yield told(rows)
                        rows = []
                if rows:
                    yield told(rows)

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Each document's ids and the end id, cut at every capacity ids; ids: the ids themselves, too."""
    return binary(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(trimmed(_cut(tokenizer, capacity, end, ids, remembered)), _PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sequences for so many pieces of each length, as (how many alike, [(length, times)]).

    Best-fit decreasing over counts: a sequence opens with the longest length left and takes, again and again, the
    longest that fits. The same filling then repeats until a length runs out, so that the work depends on the
    lengths there are and not on the number of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    lengths = np.flatnonzero(left).tolist()
    while lengths:
        room, used, at = capacity, [], len(lengths)
        while room and at:
            at = min(at, int(np.searchsorted(lengths, room, "right")))
            if not at:
                break
            length = lengths[at - 1]
            n = int(min(left[length], room // length))
            used.append((length, n))
            room -= n * length
            at -= 1
        times = min(int(left[length]) // n for length, n in used)
        out.append((times, used))
        for length, n in used:
            left[length] -= n * times
        if any(left[length] == 0 for length, _ in used):
            lengths = [x for x in lengths if left[x]]
    return out


class Slots:
    """The planned slots by length and rank."""

    def __init__(self, plan: list[tuple[int, list[tuple[int, int]]]]):
        taken: dict[int, int] = {}
        rows, first = [], 0
        for times, used in plan:
            offset = 0
            for length, n in used:
                rank = taken.get(length, 0)
                rows.append((length, rank, first, n, offset))
                taken[length] = rank + n * times
                offset += length * n
            first += times
        self.rows = np.array(sorted(rows) or np.zeros((0, 5)), np.int64)
        self.sequences = first

    def take(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.rows
        at = np.searchsorted(r[:, 0] << 48 | r[:, 1], length << 48 | rank, "right") - 1
        turn = rank - r[at, 1]
        return r[at, 2] + turn // r[at, 3], r[at, 4] + turn % r[at, 3] * length


def placed(own: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (a written table) with sequence_id and offset.

    Ranks within a length, without one task for a frequent length: pieces are dealt into cells by hash, ranked within
    cell and length, and shifted by what lower cells hold. The histogram (a row a length) and the plan, a few rows a
    length, are all that the driver sees.
    """
    cells = buckets(own, 16)
    own = own.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells)))
    per = written(own.groupBy("length", "cell").agg(F.count("*").alias("n")))
    slots = Slots(best_fit({r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    before = W.partitionBy("length").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    shift = per.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    rank = F.row_number().over(W.partitionBy("cell", "length").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = own.withColumn("rank", rank).join(shift, ["length", "cell"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("cell", "shift")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = slots.take(batch["length"].to_numpy(), batch["rank"].to_numpy())
            kept = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.record_batch([*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], names=[*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` ids.

    Returns for each piece: doc_id, piece (from 0), start (the document's ids before it), length, ids_crc32 (of the ids
    as little-endian 32-bit numbers), sequence_id, offset in the sequence, and ids if asked for. Only documents longer
    than a sequence are cut. Null or empty text: the end id alone. Null or repeated doc_ids: each row is a document of
    its own. An empty table gives no rows. remembered: words whose ids a worker keeps. Other columns are ignored.
    """
    own = written(pieces(docs, tokenizer or default_tokenizer(), capacity, end, ids, remembered))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed(own, capacity).select(*names, *["ids"] * ids)
