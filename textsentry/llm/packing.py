"""Lexical retrieval packing: sequences filled with neighbours found by BM25.

Every document becomes token ids and an end id. Whole windows of a document are
sequences by themselves; its tail, shorter than a window, goes to a shard. A
shard holds about ``SHARD_TOKENS`` tokens and an inverted index over its tails,
with token ids as terms and BM25 weights in the postings. A tail no sequence
has yet is a window's seed: its rarest terms are looked up, and unused neighbours fill the
window in the order of their scores, the last one cut where the window ends.
What is cut off seeds the next window, so documents stay together. When a
seed's neighbours run out the next tail is the seed. A shard's last, partly
filled window is cut into sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsentry.llm import symbols as S
from textsentry.session import materialise

WINDOW = 2048
END_ID = 1
# Tokens of a shard, and what a tail counts besides its tokens: shards of tiny tails stay small too.
SHARD_TOKENS = 1 << 20
TAIL_COST = 32
# BM25's constants, and the rarest terms of a seed that are looked up.
K1, B = 1.2, 0.75
QUERY_TERMS = 32
# Neighbours ranked at first; all of them only if these do not fill the window.
RANKED = 64
# Pieces of texts a worker remembers before it forgets those not used of late, and the longest of them.
REMEMBERED = 1 << 19
LONGEST = 64
# Bytes of text encoded in one go; a longer text is encoded by itself.
BATCH_BYTES = 8 << 20

# The pieces a byte-level tokenizer cuts texts into that hold no two blanks
# in a row, and the letters its model has for bytes: printable ones are themselves, the
# others follow one another from U+0100.
BYTE_LEVEL_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\pL+| ?\pN+| ?[^\s\pL\pN]+|\s"
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(_OTHERS)}
# Texts with blanks in a row, blanks that regexes disagree about, the separator, or letters
# from U+0250 on, whose classes versions of Unicode disagree about.
_SEPARATOR = "\x01"
ODD_TEXTS = r"\s\s|[\x01\x0b\x1c-\x1f\x{85}\x{a0}]|[^\x00-\x{24f}]"

PIECE = "start long, length long, doc_tokens long, sequence_id long, offset long, role string, ids binary"


class _Remembered(dict):
    """Ids of strings, made when first asked for; those not used of late are forgotten once it is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key) or self.make(key)
        if len(key) <= LONGEST:
            self[key] = ids
        return ids

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Token ids of texts, many at a time.

    A byte-level tokenizer cuts texts into pieces and encodes each by itself.
    Arrow cuts and tells them apart; only pieces not seen of late reach the
    tokenizer's model, and the ids are gathered by the pieces' numbers. Other
    tokenizers, and texts the cut is not made for, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        split, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        self.plain = bool(
            split.get("type") == "ByteLevel"
            and split.get("use_regex")
            and not split.get("add_prefix_space")
            and not spec["normalizer"]
            and all(t["content"].isascii() for t in added)
        )
        self.odd = "|".join([ODD_TEXTS, *(re.sub(r"(\W)", r"\\\1", t["content"]) for t in added)])
        self.tokenize = self.tokenizer.model.tokenize
        self.pieces = _Remembered(self._piece)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(letters)])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (without nulls) behind one another, and where each text's begin and end."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.plain else np.ones(len(texts), bool)
        wholes = [self.whole(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        cut = pc.split_pattern(pc.replace_substring_regex(texts.filter(pa.array(~odd)), BYTE_LEVEL_PIECES, _SEPARATOR + r"\0"), _SEPARATOR)
        coded = cut.flatten().dictionary_encode()
        number, names = coded.indices.to_numpy().astype(np.int32), coded.dictionary.to_pylist()
        self.pieces.age()
        known = self.pieces
        flat, at = _joined([*(known[p] if p else b"" for p in names), *wholes])
        # Pieces of each text in the order of the texts; a whole text is one piece.
        count = np.ones(len(texts), np.int64)
        count[~odd] = np.diff(cut.offsets.to_numpy())
        own = np.repeat(odd, count)
        order = np.empty(len(own), np.int32)
        order[~own] = number
        order[own] = len(names) + np.arange(len(wholes))
        sizes = at[order + 1] - at[order]
        ends = np.append(0, np.cumsum(sizes))
        places = np.repeat((at[order] - ends[:-1]).astype(np.int32), sizes)
        places += np.arange(len(places), dtype=np.int32)
        return flat[places], ends[np.append(0, np.cumsum(count))]


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), "<u4"), np.cumsum([0] + [len(p) // 4 for p in parts])


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One per worker and tokenizer: what a task has learned the worker's next task knows."""
    return Encoder(path)


def encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``_id``, ``_row`` (long, one per row) and the columns of a piece: the whole windows and the tail of every row.

    Written down, as what follows counts and deals it, and row numbers must not change.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    width, end = 4 * window, np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        row = sequence = TaskContext.get().partitionId() << 36
        names = ["_id", "_row", *(f.split()[0] for f in PIECE.split(", "))]
        kinds = [pa.int64()] * 6 + [pa.string(), pa.binary()]
        for batch in batches:
            texts = batch.column(1)
            _, offsets = S.column_bytes(texts)
            for first, last in S.byte_slices(offsets, BATCH_BYTES):
                ids, bounds = encoder.ids(texts.slice(first, last - first))
                of, rows = [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own = ids[a:b].tobytes() + end
                    n = len(own) // 4
                    for begin in range(0, len(own), width):
                        part = own[begin : begin + width]
                        whole = len(part) == width
                        # Odd numbers are sequences of one document, even ones are the shards'.
                        at = (2 * sequence + 1, 0, "window") if whole else (None, None, "tail")
                        of.append(first + i)
                        rows.append((row, begin // 4, len(part) // 4, n, *at, part))
                        sequence += whole
                    row += 1
                columns = [batch.column(0).take(pa.array(of, pa.int64()))]
                columns += [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return materialise(rows.mapInArrow(run, f"_id {kind}, _row long, {PIECE}"), "encoded")


class Index:
    """An inverted index of one shard: for each term the tails that hold it, with their BM25 weights."""

    def __init__(self, tails: list[np.ndarray]):
        n = len(tails)
        lengths = np.array([len(t) for t in tails], np.int64)
        of = np.repeat(np.arange(n, dtype=np.int64), lengths)
        flat = np.concatenate(tails).astype(np.int64) if n else np.zeros(0, np.int64)
        pair, times = np.unique(flat * n + of, return_counts=True)
        term, self.tail = pair // max(n, 1), (pair % max(n, 1)).astype(np.int32)
        names, self.first = np.unique(term, return_index=True)
        self.last = np.append(self.first[1:], len(term))
        held = self.last - self.first
        self.rarity = np.log1p((n - held + 0.5) / (held + 0.5))
        self.names = names
        norm = K1 * (1 - B + B * lengths / max(lengths.mean(), 1.0)) if n else np.zeros(0)
        self.weight = (np.repeat(self.rarity, held) * times * (K1 + 1) / (times + norm[self.tail])).astype(np.float32)
        self.size = n

    def scores(self, seed: np.ndarray) -> np.ndarray:
        """Each tail's score for the seed's rarest terms that another tail may hold."""
        numbers = np.searchsorted(self.names, np.unique(seed))
        shared = numbers[self.last[numbers] - self.first[numbers] > 1]
        asked = shared[np.argsort(-self.rarity[shared], kind="stable")[:QUERY_TERMS]]
        if not len(asked):
            return np.zeros(self.size)
        spans = [slice(self.first[i], self.last[i]) for i in asked]
        return np.bincount(
            np.concatenate([self.tail[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), minlength=self.size
        )


def neighbours(index: Index, seed: np.ndarray, unused: np.ndarray) -> Iterator[int]:
    """Unused tails with a score, best first, ties in their order; all of them if they are asked for."""
    score = np.where(unused, index.scores(seed), 0.0)
    found = np.flatnonzero(score > 0)
    done = 0
    if len(found) > RANKED:
        least = np.partition(score[found], -RANKED)[-RANKED]
        top = found[score[found] >= least]
        top = top[np.argsort(-score[top], kind="stable")]
        yield from top.tolist()
        done = len(top)
    yield from found[np.argsort(-score[found], kind="stable")][done:].tolist()


def fill_windows(tails: list[np.ndarray], window: int = WINDOW) -> Iterator[list[tuple[int, int, int, str]]]:
    """Windows of one shard as lists of (tail, from, to, role); every token is in one of them.

    All but the last hold ``window`` tokens. The role is ``seed``, ``neighbour`` or,
    for what a window's end cut off, ``rest``.
    """
    index, unused, next_seed = Index(tails), np.ones(len(tails), bool), 0
    pieces: list[tuple[int, int, int, str]] = []
    room, carried = window, None
    ranked: Iterator[int] = iter(())
    while True:
        if carried is not None:
            one, begin, role = *carried, "rest"
            carried, ranked = None, neighbours(index, tails[one], unused)
        else:
            one, begin, role = next(ranked, None), 0, "neighbour"
            if one is None:
                while next_seed < len(tails) and not unused[next_seed]:
                    next_seed += 1
                if next_seed == len(tails):
                    break
                one, role = next_seed, "seed"
                unused[one] = False
                ranked = neighbours(index, tails[one], unused)
            unused[one] = False
        end = min(len(tails[one]), begin + room)
        pieces.append((one, begin, end, role))
        room -= end - begin
        if end < len(tails[one]):
            carried = (one, end)
        if not room:
            yield pieces
            pieces, room = [], window
            if carried is None:
                ranked = iter(())
    if pieces:
        yield pieces


def powers(pieces: list[tuple[int, int, int, str]], window: int) -> Iterator[list[tuple[int, int, int, str]]]:
    """``pieces`` as one sequence if they fill the window, else cut at falling powers of two."""
    left = sum(b - a for _, a, b, _ in pieces)
    if left == window:
        yield pieces
        return
    rest = list(reversed(pieces))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            one, a, b, role = rest.pop()
            cut = min(b, a + room)
            out.append((one, a, cut, role))
            room -= cut - a
            if cut < b:
                rest.append((one, cut, b, "rest"))
        yield out


def pack(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    tokenizer_path: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """``id_col`` and a row per piece: ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``role``, ``ids``.

    ``ids`` holds little-endian unsigned 32-bit numbers. Null and empty texts are
    the end id alone. Rows are packed one by one, whatever their ids: rows that
    repeat and null ids stay. No rows give no pieces; other columns are ignored.
    ``tokenizer_path`` must be readable on every executor. Shards are dealt by
    row, so no text, copy or id can fill one; a task holds one shard.
    """
    pieces = encoded(docs, id_col, text_col, tokenizer_path, window, end_id)
    kind = pieces.schema["_id"].dataType.simpleString()
    tails = pieces.where("role = 'tail'")
    size = tails.agg(F.sum(F.col("length") + TAIL_COST)).first()[0] or 0
    shards = max(1, -(-size // shard_tokens))
    dealt = tails.select(
        F.pmod(F.xxhash64("_row"), F.lit(shards)).alias("_shard"), "_id", "_row", "start", "length", "doc_tokens", "ids"
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row").combine_chunks()
        tokens = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("ids")]
        begins = table.column("start").to_numpy()
        rows, start, length, number, offset, roles, ids = [], [], [], [], [], [], []
        sequence = int(table.column("_shard")[0].as_py()) << 36
        for window_pieces in fill_windows(tokens, window):
            for one_sequence in powers(window_pieces, window):
                at = 0
                for one, a, b, role in one_sequence:
                    rows.append(one)
                    start.append(int(begins[one]) + a)
                    length.append(b - a)
                    number.append(2 * sequence)
                    offset.append(at)
                    roles.append(role)
                    ids.append(tokens[one][a:b].tobytes())
                    at += b - a
                sequence += 1
        taken = pa.array(rows, pa.int64())
        return pa.table(
            {
                "_id": table.column("_id").take(taken),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "doc_tokens": table.column("doc_tokens").take(taken),
                "sequence_id": pa.array(number, pa.int64()),
                "offset": pa.array(offset, pa.int64()),
                "role": pa.array(roles, pa.string()),
                "ids": pa.array(ids, pa.binary()),
            }
        )

    schema = f"_id {kind}, {PIECE}"
    filled = dealt.groupBy("_shard").applyInArrow(run, schema)
    whole = pieces.where("role = 'window'").drop("_row")
    return whole.unionByName(filled).withColumnRenamed("_id", id_col)
