"""Exact substring dedup over the suffix order of a prefix-free parse.

A rolling hash over the bytes of each document triggers phrase ends: a phrase
holds the starts of all windows that share their least gram, and overlaps the
next by a window less one byte, so a dictionary suffix of at least one window
settles a place of the corpus to that depth by itself. Dictionary: distinct
phrases, with their number in the parse. Two places tie in the corpus order to
window depth if they are the same dictionary suffix of a phrase that occurs
twice in the parse, or suffixes of two phrases that tie; the first kind is read
off the parse, the second is found among phrases that share a trigger. Only
these ties are needed, never the order between them, so suffixes are named by
fingerprints and no global sort takes place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textsentry.llm import repeats as R
from textsentry.llm import symbols as S

WINDOW = 200
GRAM = 48


def dedup_bytes(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``id_col``, ``kept`` (binary), ``n_bytes``, ``n_removed``, ``spans`` and ``kept_sha256`` for every row.

    Every byte in a ``window``-byte string that also starts elsewhere, in this
    or another document, goes. ``spans`` are the maximal removed runs (start,
    length). What is kept may split a character, so it is binary. Null texts are
    empty. Rows that agree in id and text are one document. Other columns are
    ignored.
    """
    scheme = S.Scheme(False, window, min(gram, window))
    keyed = R.keyed_documents(docs, id_col, text_col)
    kind = keyed.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.column_bytes(batch.column(1))
            bounds, lo, n = R.run_lists(batch.column(2))
            for first, last in S.byte_slices(offsets):
                yield _cut(batch.column(0).slice(first, last - first), data, offsets[first : last + 1],
                           bounds[first : last + 1], lo, n, window)

    columns = "kept binary, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept_sha256 string"
    out = R.with_runs(keyed, R.repeated_runs(keyed, scheme, False)).mapInArrow(run, f"_key {kind}, {columns}")
    return out.select(R.key_id(id_col, keyed), *out.columns[1:])


def _cut(keys, data, offsets, bounds, lo, n, window) -> pa.RecordBatch:
    texts, spans, removed = [], [], []
    for k in range(len(offsets) - 1):
        text = data[offsets[k] : offsets[k + 1]]
        found: list[dict] = []
        if bounds[k + 1] > bounds[k]:
            mine = slice(bounds[k], bounds[k + 1])
            drop = S.covered(len(text), lo[mine], n[mine], window)
            step = np.diff(np.concatenate([[0], drop.astype(np.int8), [0]]))
            a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            found = [{"start": x, "length": y - x} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            text = text[~drop]
        texts.append(text.tobytes())
        spans.append(found)
        removed.append(int(offsets[k + 1] - offsets[k]) - len(texts[-1]))
    return pa.RecordBatch.from_arrays(
        [
            keys,
            pa.array(texts, pa.binary()),
            pa.array(np.diff(offsets)),
            pa.array(removed, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
        ],
        ["_key", "kept", "n_bytes", "n_removed", "spans", "kept_sha256"],
    )
