"""Suffix-array dedup: suffixes at minimiser positions are sorted by their words, neighbours compared, and matches extended.

The suffix array is sparse: a suffix is kept where a gram is the least of SPREAD + 1 in a row, one in some eleven. It
lies in ranges by its first passage - SPREAD words, which every two occurrences of a passage share from the minimiser
that both choose. Within a range suffixes are sorted by the words that follow, neighbours' common prefixes tell how far
matches go to the right, and the same order of the words before them how far they go to the left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.repeats import merged, repeats, told

#: Words of a repeated passage at least, of the gram whose hash selects a suffix, and places of a passage after the first where that may be.
PASSAGE, MINIMISER, SPREAD = 50, 8, 21


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, flags in zip(batch["doc_id"].to_pylist(), batch["flags"], strict=True):
            own = told(flags.as_py())
            for tag in np.unique(own[:, 3]):
                mine = own[own[:, 3] == tag]
                every, copies = merged(mine), merged(mine[mine[:, 2] == 1])
                rows.append((doc_id, int(tag), sum(b - a for a, b in every), sum(b - a for a, b in copies), ",".join(f"{a}:{b}" for a, b in every), ",".join(f"{a}:{b}" for a, b in copies)))
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["doc_id", "row_tag", "n_repeated", "n_copied", "repeated", "copied"])


def suffix_dedup(docs: DataFrame, passage: int = PASSAGE, minimiser: int = MINIMISER, spread: int = SPREAD) -> DataFrame:
    """The passages of at least `passage` words that several documents hold.

    Matches of neighbouring suffixes, extended to the left, of `passage` words together are repeats; those that overlap or
    touch are merged to maximal ranges. One row for each document that holds any: doc_id,
    row_tag (tells rows of one doc_id apart), n_repeated and repeated (words in maximal ranges first:end that another
    document holds too), n_copied and copied (those that a smaller doc_id holds, which dedup would cut). Documents
    without repeats, empty or null texts and rows of null doc_id give no row; a document isn't compared with itself.
    """
    return repeats(docs.select("doc_id", "text"), passage, minimiser, spread).mapInArrow(_spans, "doc_id long, row_tag long, n_repeated long, n_copied long, repeated string, copied string")
