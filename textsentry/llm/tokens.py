"""Token counts of a SentencePiece model, encoded in batches balanced by bytes.

Arrow batches of texts come in, lengths go out. Texts are split at safe
boundaries: before a run of spaces that follows another character, because no
piece of the vocabulary holds a word mark after anything but word marks (checked
when the model is loaded; else texts are encoded whole). The one space such a
part loses is the one the encoder puts before every input. Parts that recur are
encoded once; the others are encoded in batches of at most ``BATCH_BYTES``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
# Bytes of text encoded in one call, and parts remembered by a worker.
BATCH_BYTES = 1 << 20
REMEMBERED = 1 << 18

_MARK = "▁"
# A part: spaces before it, if any, up to the next space that precedes something else.
_PARTS = re.compile(r" *[^ ]+(?: +\Z)?| +\Z")


def load_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits_safely(model) -> bool:
    """Whether texts may be cut before spaces without changing their pieces."""
    inner = re.compile(f"[^{_MARK}]{_MARK}")
    whole = ("a b", " a", "a  b ", "\na b", "a")
    parts = {"a b": ["a", "b"], " a": [" a"], "a  b ": ["a", " b "], "\na b": ["\na", "b"], "a": ["a"]}
    return not any(inner.search(model.id_to_piece(i)) for i in range(model.get_piece_size())) and all(
        model.encode(t) == [x for p in parts[t] for x in model.encode(p)] for t in whole
    )


def safe_parts(text: str) -> list[str]:
    """``text`` in parts, each to be encoded by itself; no text has no parts."""
    parts = _PARTS.findall(text.replace(_MARK, " "))  # the encoder takes a mark for a space
    return parts[:1] + [p[1:] if p[0] == " " and p.strip(" ") else p for p in parts[1:]]


class Counter:
    """Counts tokens; ``encode`` maps a list of strings to lists of ids."""

    def __init__(self, encode: Callable[[list[str]], list], safe: bool):
        self.encode, self.safe, self.known = encode, safe, {}

    def _learn(self, parts: list[str]) -> None:
        batch, size = [], 0
        for part in parts:
            batch.append(part)
            size += len(part.encode("utf-8", "surrogatepass"))
            if size >= BATCH_BYTES:
                self._store(batch)
                batch, size = [], 0
        if batch:
            self._store(batch)

    def _store(self, batch: list[str]) -> None:
        self.known.update(zip(batch, map(len, self.encode(batch)), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        split = [safe_parts(t) if self.safe else [t] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self._learn(list({p for parts in split for p in parts if p not in self.known}))
        known = self.known
        counts = [sum([known[p] for p in parts]) for parts in split]
        if not self.safe:
            known.clear()
        return counts


def by_bytes(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Runs of ``texts`` of about ``limit`` characters; a longer text is a run by itself."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def token_lengths(docs: DataFrame, id_col: str, text_col: str, model_path: str) -> DataFrame:
    """``id_col``, ``n_bytes`` and ``n_tokens`` of every row; null texts are empty and have no tokens.

    ``model_path`` must be readable on every executor. Rows are neither merged
    nor dropped, null ids are kept, other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        counter = Counter(lambda texts: model.encode(texts, num_threads=1), splits_safely(model))
        for batch in batches:
            counts: list[int] = []
            for texts in by_bytes(batch.column(2).to_pylist()):
                counts += counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["_id", "n_bytes", "n_tokens"]
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("n_bytes"), text)
    return rows.mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long").withColumnRenamed("_id", id_col)
