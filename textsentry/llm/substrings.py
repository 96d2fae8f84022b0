"""Substring dedup by Rabin-Karp hashes of every fixed-length window of words.

A word goes if it lies in a window whose words also occur as a window earlier
(in a smaller id, or earlier in the same document). Hashes of windows that
cannot recur are left out of the count by :mod:`repeats`; the windows found
merge into maximal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textsentry.llm import repeats as R
from textsentry.llm import symbols as S

WINDOW = 20
GRAM = 6


def dedup_substrings(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``id_col``, ``kept_text``, ``n_words``, ``n_removed``, ``removed`` and ``kept_sha256`` for every row.

    ``removed`` are the maximal intervals of removed words (first word, number).
    ``kept_text`` joins the kept words by one space. Null and empty texts have
    no words; texts of fewer words than a window keep them all. Rows that agree
    in id and text are one document; with equal ids the order of unequal texts
    is that of a hash. Null ids come first. Other columns are ignored.
    """
    scheme = S.Scheme(True, window, min(gram, window))
    keyed = R.keyed_documents(docs, id_col, text_col)
    kind = keyed.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.column_bytes(batch.column(1))
            bounds, lo, n = R.run_lists(batch.column(2))
            for first, last in S.byte_slices(offsets):
                part = offsets[first : last + 1]
                yield _cut(batch.column(0).slice(first, last - first), data[part[0] : part[-1]], part - part[0],
                           bounds[first : last + 1], lo, n, window)

    columns = "kept_text string, n_words long, n_removed long, removed array<struct<first:long,words:long>>, kept_sha256 string"
    out = R.with_runs(keyed, R.repeated_runs(keyed, scheme, True)).mapInArrow(run, f"_key {kind}, {columns}")
    return out.select(R.key_id(id_col, keyed), *out.columns[1:])


def _cut(keys, data, offsets, bounds, lo, n, window) -> pa.RecordBatch:
    starts, ends, at = S.word_bounds(data, offsets)
    drop = np.zeros(len(starts), bool)
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        mine = slice(bounds[k], bounds[k + 1])
        drop[at[k] : at[k + 1]] = S.covered(int(at[k + 1] - at[k]), lo[mine], n[mine], window)
    kept = np.flatnonzero(~drop)
    rows = np.searchsorted(at, kept, side="right") - 1
    # Kept words' bytes, and the byte after each but the last of a row, as a space.
    marks = np.zeros(len(data) + 1, np.int8)
    marks[starts[kept]] += 1
    np.add.at(marks, ends[kept], -1)
    keep = np.cumsum(marks[:-1], dtype=np.int8).astype(bool)
    follows = np.zeros(len(kept), bool)
    follows[:-1] = rows[1:] == rows[:-1]
    gaps = ends[kept[follows]]
    keep[gaps] = True
    out = data.copy()
    out[gaps] = 32
    out = out[keep].tobytes()
    cuts = np.concatenate([[0], np.cumsum(keep)])[offsets]
    texts = [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    removed = np.concatenate([[0], np.cumsum(drop)])
    rise = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])) == 1)
    spans = []
    for k in range(len(texts)):
        d = np.diff(np.concatenate([[0], drop[at[k] : at[k + 1]].astype(np.int8), [0]])) if removed[at[k + 1]] > removed[at[k]] else rise[:0]
        a, b = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
        spans.append([{"first": x, "words": y - x} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    return pa.RecordBatch.from_arrays(
        [
            keys,
            pa.array(texts, pa.binary()).cast(pa.string()),
            pa.array(np.diff(at)),
            pa.array(removed[at[1:]] - removed[at[:-1]]),
            pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
        ],
        ["_key", "kept_text", "n_words", "n_removed", "removed", "kept_sha256"],
    )
