"""Substring dedup by seed and extend: documents meet on winnowed anchors, matches are extended word by word both ways,
and maximal repeats of a window or more are cut from later copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import binary, trimmed, word_chunks
from sparkloom.llm.repeats import covered, merged, repeats, tag_of

WINDOW, ANCHOR = 13, 5


#: Rows of text that are held at a time in their cut form.
ROWS = 500


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for their way to their ranges."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.record_batch([batch["doc_id"], pa.array([pack(x.as_py()) for x in batch["text"]], pa.binary())], names=["doc_id", "text"])


def unpacked(text: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(text)


def _cut(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        rows = []
        for doc_id, text, flags in zip(batch["doc_id"].to_pylist(), batch["text"], batch["flags"], strict=True):
            raw, flags = unpacked(text.as_py()), flags.as_py()
            own = covered(flags, tag_of(raw)) if flags else np.zeros((0, 4), np.int64)
            spans = merged(own[own[:, 2] == 1])
            sha, n, gap, kept = hashlib.sha256(), 0, b"", []
            at = iter([*spans, (1 << 62, 1 << 62)])
            a, b = next(at)
            for words in word_chunks(raw):
                end, stay, here = n + len(words), [], n
                while here < end:
                    if here >= b:
                        a, b = next(at)
                    elif here < a:
                        stay += words[here - n : min(a, end) - n]
                        here = min(a, end)
                    else:
                        here = min(b, end)
                n = end
                if stay:
                    piece = gap + b" ".join(stay)
                    sha.update(piece)
                    if texts:
                        kept.append(piece)
                    gap = b" "
            rows.append((doc_id, b"".join(kept).decode() if texts else None, n, sum(y - x for x, y in spans), sha.hexdigest(), [f"{x}:{y}" for x, y in spans]))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())), strict=True)], names=["doc_id", "kept", "n_words", "n_removed", "kept_sha256", "removed"]) if rows else pa.RecordBatch.from_pylist([], _KEPT)


_KEPT = pa.schema([("doc_id", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.string()))])


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts: bool = True) -> DataFrame:
    """Cuts from each document the words of windows that also start in a document of smaller doc_id.

    Anchors are grams of `anchor` words, of which every window chooses one (winnowing); repeats() extends them.

    Returns for each row: doc_id, kept (its other words, one space between; null unless texts are wanted), n_words, n_removed, kept_sha256 of kept,
    removed (maximal ranges first:end of words). Null text: no words. A null doc_id is neither smaller nor larger than
    any: its row stays whole. Rows that repeat a doc_id are each compared with smaller ids only. Words are told by
    bytes. Columns other than doc_id and text are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return binary(own).mapInArrow(trimmed(_packed), "doc_id long, text binary").join(repeats(own, window, anchor, window - anchor), "doc_id", "left").select("doc_id", "text", "flags").mapInArrow(partial(_cut, texts=texts), "doc_id long, kept string, n_words long, n_removed long, kept_sha256 string, removed array<string>")


def digests(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
