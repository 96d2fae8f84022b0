"""Near-duplicates by an inverted join on MinHash signature coordinates.

Documents with equal shingle sets form a class, and one member stands for it.
A signature has ``COORDINATES`` minima; a posting is a (coordinate, value) pair.
Two sets of the wanted similarity agree in ``MATCHES`` coordinates (all but
about three pairs in ten million at the threshold itself, fewer above), so each
must hold one of the other's ``COORDINATES - MATCHES + 1`` rarest postings:
only that prefix is posted, and a document with that many postings of its own
has no partner at all. Postings are merged in two passes:

1. every posting names ``HUBS`` of its documents, by as many seeded orders.
   Collisions with them are counted over all postings of a document, and of each
   order the hub it meets most often is its candidate. Pairs that match become
   links and components; large groups of copies are one component after this;
2. documents in one posting that are not in one component yet are all compared,
   which skips the members of large groups and loses no link between groups.
   However little the first pass found, this one completes the result.

Pairs are judged by the number of equal coordinates, then confirmed on the full
sets. The second pass first compares parity bitmaps of the sets: the bits two of
them differ in are at most the shingles only one has, so no link is lost by this
bound, and hardly any pair below the threshold is even written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textsentry.llm import repeats as R
from textsentry.llm import symbols as S
from textsentry.llm.components import components
from textsentry.session import broadcast_if_small, materialise

SHINGLE = 5
SIMILARITY = 80
COORDINATES = 64
MATCHES = 34
HUBS = 4
# Keys of at most this size are broadcast to pick out texts; more are joined by shuffle.
BROADCAST_BYTES = 16 << 20
# Signatures of at most this size are broadcast; the driver holds several times as much while it builds the table.
SIGNATURE_BYTES = 2 << 20

# Bits of a set's parity bitmap.
PARITY_BITS = 1024

_RNG = np.random.default_rng(20240501)
_A = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``size`` are one shingle."""
    data = _LOWER[data]
    starts, ends, at = S.word_bounds(data, offsets)
    words = S.word_symbols(data, starts, ends)
    grams = np.zeros(0, np.uint64)
    if len(words) >= size:
        grams = np.zeros(len(words) - size + 1, np.uint64)
        for i in range(size):
            grams = S.mix(grams + words[i : len(words) - size + 1 + i])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for i in range(a, b):
                one = S.mix(one + words[i : i + 1])
            out.append(S.mix(one + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """32 bits of the minimum of each coordinate's hash; zeros for an empty set."""
    out = np.zeros((len(sets), COORDINATES), np.uint32)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        joined = np.concatenate([sets[k] for k in full])
        first = np.cumsum([0] + [len(sets[k]) for k in full[:-1]])
        for j in range(COORDINATES):
            out[full, j] = np.minimum.reduceat(joined * _A[j] + _B[j], first) >> np.uint64(32)
    return out


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, whether an odd number of its shingles falls on each bit, in words of 64 bits."""
    out = np.zeros((len(sets), PARITY_BITS // 64), np.int64)
    for k, shingles in enumerate(sets):
        bits = (S.mix(shingles + np.uint64(3)) % np.uint64(PARITY_BITS)).astype(np.int64)
        odd = np.bincount(bits, minlength=PARITY_BITS).astype(np.uint8) & 1
        out[k] = np.packbits(odd).view(np.int64)
    return out


def _fixed_lists(rows: np.ndarray) -> pa.ListArray:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, width, dtype=np.int32)), pa.array(rows.ravel()))


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offsets = S.column_bytes(batch.column(1))
    for first, last in S.byte_slices(offsets, 2 * S.BUFFER):
        part = offsets[first : last + 1]
        yield first, last, shingle_sets(data[part[0] : part[-1]], part - part[0], size)


def sketches(keyed: DataFrame, size: int) -> DataFrame:
    """``_key``, ``n`` (set size), ``s1``, ``s2`` (fingerprint of the set), ``sig`` and ``bits``."""
    kind = keyed.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, sets in _slices(batch, size):
                prints = np.array(
                    [[S.mix(s + np.uint64(k)).sum(dtype=np.uint64) for k in (1, 2)] for s in sets], np.uint64
                ).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(prints[:, 0].view(np.int64) if len(sets) else [], pa.int64()),
                        pa.array(np.ascontiguousarray(prints[:, 1]).view(np.int64) if len(sets) else [], pa.int64()),
                        _fixed_lists(signatures(sets).view(np.int32)),
                        _fixed_lists(parities(sets)),
                    ],
                    ["_key", "n", "s1", "s2", "sig", "bits"],
                )

    # Strided columns are copied above, as Arrow needs them in one piece.
    return keyed.mapInArrow(run, f"_key {kind}, n long, s1 long, s2 long, sig array<int>, bits array<long>")


def full_sets(keyed: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """``_key`` and ``_set`` of the documents in ``keys``."""
    kind = keyed.schema["_key"].dataType.simpleString()
    wanted = keyed.join(broadcast_if_small(keys, BROADCAST_BYTES), "_key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, sets in _slices(batch, size):
                flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["_key", "_set"],
                )

    if keyed.schema["_key"].dataType.typeName() == "struct":  # else rows are one to a key
        wanted = wanted.dropDuplicates(["_key"])
    return wanted.mapInArrow(run, f"_key {kind}, _set array<long>")


def prefixes(reps: DataFrame) -> DataFrame:
    """``rep``, ``token``, ``n``: each document's prefix of postings that another shares."""
    postings = reps.select("rep", "n", F.posexplode("sig").alias("_j", "_x")).select(
        "rep", "n", (F.shiftleft(F.col("_j").cast("long"), 32) + F.col("_x")).alias("token")
    )
    counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = (
        postings.join(counts, "token")
        .groupBy("rep", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("_t"))
    )
    # Postings no one shares come first in the order of rarity and take up places of the prefix.
    room = F.size("_t") - F.lit(MATCHES - 1)
    cut = shared.where(room > 0).withColumn("_t", F.slice("_t", F.lit(1), room))
    return cut.select("rep", "n", F.explode("_t.token").alias("token"))


def _close(a, b):
    """Whether two set sizes allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * SIMILARITY


def confirm(pairs: DataFrame, reps: DataFrame, keyed: DataFrame, size: int) -> DataFrame:
    """The links among ``pairs`` (``u``, ``v``): by signature first, then on the full sets."""
    sig = reps.select("rep", "sig")
    if isinstance(reps.schema["rep"].dataType, (T.LongType, T.IntegerType)) and reps.count() * (4 * COORDINATES + 24) <= SIGNATURE_BYTES:
        sig = F.broadcast(sig)
    agree = F.expr("size(filter(zip_with(_a, _b, (x, y) -> x = y), z -> z))")
    likely = (
        pairs.join(sig.select(F.col("rep").alias("u"), F.col("sig").alias("_a")), "u")
        .join(sig.select(F.col("rep").alias("v"), F.col("sig").alias("_b")), "v")
        .where(agree >= MATCHES)
        .select("u", "v")
    )
    likely = materialise(likely, "pairs")
    keys = likely.select(F.explode(F.array("u", "v")).alias("_key")).distinct()
    sets = full_sets(keyed, keys, size)
    common = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - common
    return (
        likely.join(sets.select(F.col("_key").alias("u"), F.col("_set").alias("_a")), "u")
        .join(sets.select(F.col("_key").alias("v"), F.col("_set").alias("_b")), "v")
        .where(common * 100 >= union * SIMILARITY)
        .select("u", "v")
    )


def meetings(posts: DataFrame) -> DataFrame:
    """``u``, ``v``: each document with the hubs it meets most often, one of each seeded order."""
    orders = range(HUBS)
    named = [F.min_by("rep", F.xxhash64("rep", F.lit(k))).alias(f"_h{k}") for k in orders]
    hubs = posts.groupBy("token").agg(F.count(F.lit(1)).alias("_c"), *named).where("_c > 1").drop("_c")
    met = (
        posts.join(hubs, "token")
        .select("rep", F.posexplode(F.array(*[f"_h{k}" for k in orders])).alias("_k", "_hub"))
        .where("rep != _hub")
        .groupBy("rep", "_k", "_hub")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    most = met.groupBy("rep", "_k").agg(F.max_by("_hub", F.struct("_c", F.xxhash64("_hub"))).alias("_hub"))
    return most.select(F.greatest("rep", "_hub").alias("u"), F.least("rep", "_hub").alias("v")).distinct()


def unsettled(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """The postings with documents of several components, with ``root``."""
    grouped = posts.join(roots.withColumnRenamed("u", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    grouped = materialise(grouped, "rooted")
    mixed = grouped.groupBy("token").agg(F.min("root").alias("_a"), F.max("root").alias("_z")).where("_a != _z").select("token")
    return grouped.join(mixed, "token", "left_semi")


def pairs_apart(open_posts: DataFrame, reps: DataFrame) -> DataFrame:
    """``u``, ``v``: every pair of different components that shares a posting, made at the least of these.

    Pairs whose sizes or parity bitmaps rule the similarity out are not made.
    """
    words = PARITY_BITS // 64
    bits = reps.select("rep", *[F.col("bits")[i].alias(f"_b{i}") for i in range(words)])
    held = open_posts.groupBy("rep").agg(F.sort_array(F.collect_list("token")).alias("_t"))
    posts = materialise(open_posts.join(held, "rep").join(bits, "rep"), "unsettled")

    def side(name: str) -> DataFrame:
        names = {"rep": name, "root": f"_r{name}", "n": f"_n{name}", "_t": f"_t{name}", **{f"_b{i}": f"_b{name}{i}" for i in range(words)}}
        return posts.select("token", *[F.col(old).alias(new) for old, new in names.items()])

    apart = (F.col("u") < F.col("v")) & (F.col("_ru") != F.col("_rv")) & _close(F.col("_nu"), F.col("_nv"))
    differ = F.expr(" + ".join(f"bit_count(_bu{i} ^ _bv{i})" for i in range(words)))
    possible = differ * (100 + SIMILARITY) <= (F.col("_nu") + F.col("_nv")) * (100 - SIMILARITY)
    left, right = side("u"), side("v")
    once = F.get(F.array_intersect("_tu", "_tv"), F.lit(0)) == left["token"]  # dear, so it comes last
    return left.join(right, (left["token"] == right["token"]) & apart & possible & once).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """``_key``, ``n_shingles``, ``component``: one row per row; components are named by their least key.

    Null and empty texts, and texts of white space, have no shingles and are
    linked with nothing. Rows that agree in id and text are one document and share
    a key. Keys without an id are the greatest. Copies are not expanded into pairs;
    a component of one has the document's own key.
    """
    keyed = R.keyed_documents(docs, id_col, text_col)
    if keyed.schema["_key"].dataType.typeName() == "struct":
        no_id = F.col("_key.id").isNull().alias("no_id")
        keyed = keyed.withColumn("_key", F.struct(no_id, F.col("_key.id"), F.col("_key.hash")))
    sketch = materialise(sketches(keyed, size), "sketches")
    reps = (
        sketch.where("n > 0")
        .groupBy("s1", "s2", "n")
        .agg(F.min(F.struct("_key", "sig", "bits")).alias("_m"))
        .select(F.col("_m._key").alias("rep"), "n", "_m.sig", "_m.bits", "s1", "s2")
    )
    reps = materialise(reps, "classes")
    posts = materialise(prefixes(reps), "postings")

    links = materialise(confirm(meetings(posts), reps, keyed, size), "links")
    roots = components(links)
    more = materialise(confirm(pairs_apart(unsettled(posts, roots), reps), reps, keyed, size), "links")
    # What the first pass settled is a star per component, so few rounds are left to do.
    named = components(roots.select("u", F.col("root").alias("v")).unionByName(more))
    return (
        sketch.select("_key", "n", "s1", "s2")
        .join(reps.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"], "left")
        .join(named.withColumnRenamed("u", "rep"), "rep", "left")
        .select("_key", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "_key").alias("component"))
    )


def one_kept(found: DataFrame) -> DataFrame:
    """``found`` (of :func:`near_duplicates`) with ``kept``, true for one row of each component."""
    least = F.col("_key") == F.col("component")
    if found.schema["_key"].dataType.typeName() != "struct":
        return found.withColumn("kept", least)
    # Rows of one key are all alike, so they are counted and written out again, not ranked.
    rows = found.groupBy("_key", "n_shingles", "component").agg(F.count(F.lit(1)).alias("_c"))
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_c"))).select(
        *found.columns, (least & (F.col("_i") == 1)).alias("kept")
    )


def _first_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of those that agree in id and text; only such rows are moved."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumns({"_copy_id": F.col(id_col), "_copy_hash": F.xxhash64(text)})
    counts = marked.groupBy("_copy_id", "_copy_hash").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    repeated = counts.select(F.col("_copy_id").alias("_r_id"), F.col("_copy_hash").alias("_r_hash"))
    repeated = materialise(repeated, "repeated")
    repeated = broadcast_if_small(repeated, BROADCAST_BYTES)
    on = F.col("_copy_id").eqNullSafe(F.col("_r_id")) & (F.col("_copy_hash") == F.col("_r_hash"))
    copies = marked.join(repeated, on, "left_semi").withColumn("_copy_text", text)
    alone = marked.join(repeated, on, "left_anti")
    return alone.select(*docs.columns).unionByName(copies.dropDuplicates(["_copy_id", "_copy_text"]).select(*docs.columns))


def keep_one(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, copies: bool = True) -> DataFrame:
    """``docs`` without near-duplicates: of each component the least document stays, with all its columns.

    Rows that repeat its id and text stay with it, or one of them does without ``copies``.
    """
    gone = near_duplicates(docs, id_col, text_col, size).where("_key != component").select("_key")
    if gone.schema["_key"].dataType.typeName() == "struct":
        gone = gone.select(F.col("_key.id").alias("_gone"), F.col("_key.hash").alias("_gone_hash"))
        text = F.coalesce(docs[text_col], F.lit(""))
        on = docs[id_col].eqNullSafe(gone["_gone"]) & (F.xxhash64(text) == gone["_gone_hash"])
        kept = docs.join(gone, on, "left_anti")
        return kept if copies else _first_copies(materialise(kept, "kept"), id_col, text_col)
    gone = materialise(gone.withColumnRenamed("_key", "_gone"), "gone")
    return docs.join(broadcast_if_small(gone, BROADCAST_BYTES), docs[id_col] == gone["_gone"], "left_anti")
