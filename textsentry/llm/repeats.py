"""Windows that occur more than once in a corpus, as runs per document.

1. Every document is cut into phrases: runs of windows with the same anchor
   (:mod:`symbols`). Equal windows have equal anchor grams, so an anchor whose
   gram occurs once cannot hold a repeat; the others are counted by gram.
2. Phrases with equal text form a class; all windows of a class repeat at once.
   If no other class shares the gram, that settles its windows.
3. Only where different classes share a gram are windows fingerprinted one by
   one, from the first member of each class, and counted. Where windows are much
   longer than grams, it is first counted how far to the left and to the right
   the surroundings of a gram are shared by another class; windows that reach
   further cannot recur and are left out.

What the steps share is written to the shared folder. All counting is by partial aggregates and joins whose repeated side has one row
per key, so a gram, phrase or window may recur any number of times. Texts move
only to meet their own runs. Places are ``(key, offset)``, and two rows with
one key and text count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsentry.llm import symbols as S
from textsentry.session import materialise


# Reaches at which surroundings are compared, and how much longer than a gram a window is for that to pay.
STEPS = 8
LONGER = 64


def keyed_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_key`` and ``_text``: the id where ids are unique and not null, else the id with a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    doubtful = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c").__gt__(1) | F.col(id_col).isNull())
    if doubtful.isEmpty():
        return docs.select(F.col(id_col).alias("_key"), text)
    return docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash")).alias("_key"), text)


def key_id(id_col: str, keyed: DataFrame):
    column = F.col("_key.id") if keyed.schema["_key"].dataType.typeName() == "struct" else F.col("_key")
    return column.alias(id_col)


def phrases(keyed: DataFrame, scheme: S.Scheme) -> DataFrame:
    """``_key``, ``lo``, ``n``, ``gram``, ``c1``, ``c2``, ``anchor``: the phrases of every document."""
    kind = keyed.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.column_bytes(batch.column(1))
            for first, last in S.byte_slices(offsets):
                part = offsets[first : last + 1]
                for buffer in S.buffers(scheme, data[part[0] : part[-1]], part - part[0], scheme.window):
                    a = S.anchors(scheme, buffer)
                    if len(a.row):
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).take(pa.array(a.row + first)),
                                pa.array(a.lo),
                                pa.array(a.n.astype(np.int32)),
                                pa.array(a.gram.view(np.int64)),
                                pa.array(a.text.view(np.int64)),
                                pa.array((a.text2 >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                                pa.array(a.anchor.astype(np.int32)),
                            ],
                            ["_key", "lo", "n", "gram", "c1", "c2", "anchor"],
                        )

    return keyed.mapInArrow(run, f"_key {kind}, lo long, n int, gram long, c1 long, c2 int, anchor int")


def _lists(column) -> tuple[np.ndarray, object]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.diff(column.offsets.to_numpy()), column.flatten()


def narrowed(keyed: DataFrame, runs: DataFrame, scheme: S.Scheme, steps: int = STEPS) -> DataFrame:
    """``runs`` without the windows that reach further than another class shares their surroundings."""
    kind = keyed.schema["_key"].dataType.simpleString()
    lists = runs.groupBy("_key").agg(F.sort_array(F.collect_set(F.col("lo") + F.col("anchor"))).alias("_grams"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.column_bytes(batch.column(1))
            sizes, flat = _lists(batch.column(2))
            at = np.concatenate([[0], np.cumsum(sizes)])
            grams = flat.to_numpy(zero_copy_only=False)
            for first, last in S.byte_slices(offsets):
                part, mine = offsets[first : last + 1], grams[at[first] : at[last]]
                row = np.repeat(np.arange(last - first), sizes[first:last])
                for buffer in S.buffers(scheme, data[part[0] : part[-1]], part - part[0], scheme.window):
                    which, side, prints = S.surroundings(scheme, buffer, row, mine, steps)
                    if len(which):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(prints.view(np.int64)),
                                batch.column(0).take(pa.array(row[which] + first)),
                                pa.array(mine[which]),
                                pa.array(side.astype(np.int32)),
                            ],
                            ["print", "_key", "gram_at", "side"],
                        )

    probes = keyed.join(lists, "_key").select("_key", "_text", "_grams").mapInArrow(
        run, f"print long, _key {kind}, gram_at long, side int"
    )
    probes = materialise(probes.select("print", F.struct("_key", "gram_at").alias("_p"), "side"), "surroundings")
    alike = probes.groupBy("print").agg(F.min("_p").alias("_a"), F.max("_p").alias("_z")).where("_a != _z").select("print")
    alike = materialise(alike, "alike")
    # The first reach that is not shared, to either side; what is shared is shared at every shorter reach too.
    reach = S.reaches(scheme, steps).tolist()
    shared = probes.join(alike, "print", "left_semi").groupBy("_p").agg(
        *[F.coalesce(F.max(F.when(F.col("side") % 2 == s, F.floor(F.col("side") / 2) + 1)), F.lit(0)).alias(f"_s{s}") for s in (0, 1)]
    )
    beyond = F.array(*[F.lit(r - 1) for r in reach], F.lit(reach[-1]))
    lengths = shared.select(
        "_p._key", "_p.gram_at", *[F.get(beyond, F.col(f"_s{s}").cast("int")).alias(f"_r{s}") for s in (0, 1)]
    )
    # Grams none of whose surroundings are shared may still share less than the first reach.
    least = F.lit(reach[0] - 1)
    there = runs.withColumn("gram_at", F.col("lo") + F.col("anchor")).join(lengths, ["_key", "gram_at"], "left")
    low = F.greatest(F.col("lo"), F.col("gram_at") - F.coalesce("_r0", least))
    high = F.least(F.col("lo") + F.col("n"), F.col("gram_at") - (scheme.window - scheme.gram) + F.coalesce("_r1", least) + 1)
    return there.select("_key", low.alias("lo"), (high - low).cast("int").alias("n"), "multi").where("n > 0")


def fingerprints(keyed: DataFrame, runs: DataFrame, scheme: S.Scheme) -> DataFrame:
    """``w1``, ``w2``, ``place``, ``multi`` of every window in ``runs`` (``_key``, ``lo``, ``n``, ``multi``)."""
    kind = keyed.schema["_key"].dataType.simpleString()
    lists = runs.groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("lo", "n", "multi"))).alias("_runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.column_bytes(batch.column(1))
            sizes, flat = _lists(batch.column(2))
            at = np.concatenate([[0], np.cumsum(sizes)])
            lo, n, multi = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for first, last in S.byte_slices(offsets):
                part, mine = offsets[first : last + 1], slice(at[first], at[last])
                row = np.repeat(np.arange(last - first), sizes[first:last])
                for buffer in S.buffers(scheme, data[part[0] : part[-1]], part - part[0], scheme.window):
                    which, place, one, two = S.window_prints(scheme, buffer, row, lo[mine], n[mine])
                    if len(which):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(one.view(np.int64)),
                                pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                                batch.column(0).take(pa.array(row[which] + first)),
                                pa.array(place),
                                pa.array(multi[mine][which].astype(bool)),
                            ],
                            ["w1", "w2", "_key", "at", "multi"],
                        )

    joined = keyed.join(lists, "_key").select("_key", "_text", "_runs")
    return joined.mapInArrow(run, f"w1 long, w2 int, _key {kind}, at long, multi boolean")


def repeated_runs(keyed: DataFrame, scheme: S.Scheme, spare_first: bool) -> DataFrame:
    """``_key`` and ``runs`` (sorted array of ``lo``, ``n``): window starts of repeated windows.

    With ``spare_first`` a window is repeated if it also starts earlier (in the
    order of keys, then places); otherwise if it also starts anywhere else.
    Documents without such windows are left out.
    """
    place = F.struct(F.col("_key").alias("key"), F.col("lo").alias("at"))
    every = phrases(keyed, scheme)
    # Python output can't be pruned, so the counted side asks for the gram alone.
    # What is counted is written before it is joined: a join whose sides are both dealt out for it
    # can split the rows of a hot key, one that goes on in the counting's partitions cannot.
    again = materialise(every.groupBy("gram").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("gram"), "grams")
    seeds = materialise(every.join(again, "gram", "left_semi").withColumn("place", place).drop("_key", "lo"), "seeds")
    classes = seeds.groupBy("gram", "c1", "c2").agg(F.min("place").alias("_first"), F.max("place").alias("_last"))
    shared = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("gram", F.lit(True).alias("_shared"))
    known = materialise(
        classes.join(shared, "gram", "left")
        .withColumn("multi", F.col("_first") != F.col("_last"))
        .where("multi OR _shared")
        .select("gram", "c1", "c2", "_first", "multi", F.coalesce("_shared", F.lit(False)).alias("_shared")),
        "classes",
    )
    members = materialise(seeds.join(known, ["gram", "c1", "c2"]), "members")
    is_first = F.col("place") == F.col("_first")
    at = [F.col("place.key").alias("_key"), F.col("place.at").alias("lo"), F.col("n")]
    whole = members.where(~is_first if spare_first else F.col("multi")).select(*at)
    unsettled = members.where(is_first & F.col("_shared")).select(*at, "multi", "anchor")
    if scheme.window - scheme.gram >= LONGER:
        unsettled = narrowed(keyed, unsettled, scheme)

    windows = fingerprints(keyed, unsettled, scheme).withColumn("place", F.struct(F.col("_key").alias("key"), "at")).drop("_key", "at")
    windows = materialise(windows, "windows")
    counted = windows.groupBy("w1", "w2").agg(
        F.min("place").alias("_first"), F.max("place").alias("_last"), F.max("multi").alias("_multi"), F.min("multi").alias("_all")
    )
    if spare_first:
        counted = materialise(counted.where("_first != _last"), "counted")
        found = windows.join(counted.select("w1", "w2", "_first"), ["w1", "w2"]).where("place != _first")
    else:
        counted = materialise(counted.where("NOT _all AND (_multi OR _first != _last)"), "counted")
        found = windows.where("NOT multi").join(counted.select("w1", "w2"), ["w1", "w2"], "left_semi")
    single = found.select(F.col("place.key").alias("_key"), F.col("place.at").alias("lo"), F.lit(1).alias("n"))
    runs = whole.unionByName(single).groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("lo", "n"))).alias("runs"))
    # Written, so that the windows' shuffle is gone before the texts are shuffled to meet their runs.
    return materialise(runs, "runs")


def with_runs(keyed: DataFrame, runs: DataFrame) -> DataFrame:
    """Every document with its runs; null where it has none."""
    return keyed.join(runs, "_key", "left").select("_key", "_text", "runs")


def run_lists(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of each row's runs, and all ``lo`` and ``n``, of an Arrow column of runs."""
    sizes, flat = _lists(column.fill_null([]) if column.null_count else column)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return bounds, flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
