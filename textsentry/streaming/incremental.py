"""Scans that continue where an earlier one stopped."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from functools import reduce
from operator import and_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from textsentry.operators.scan import prepare, scan
from textsentry.schemas import FINDING_FIELDS
from textsentry.session import BROADCAST_BYTES, estimated_bytes, materialise

# Fields of a rule that decide what a scan returns.
_RULE_IDENTITY = (
    "group",
    "name",
    "f_regex",
    "engine",
    "sensitive",
    "context_left",
    "context_right",
)


def rules_hash(pack: list[dict]) -> str:
    """One hash for a whole pack, whatever the order of its rules."""
    rules = sorted(json.dumps([rule[f] for f in _RULE_IDENTITY]) for rule in pack)
    return hashlib.sha256("\n".join(rules).encode()).hexdigest()


# Bits of the map that stands for a list of keys too large to broadcast: 64 MB at most, 16 a key below that.
MAP_BITS = 8 * BROADCAST_BYTES
_BITS_PER_KEY = 16
_BLOCK_BITS = 32768  # what one bitmap of Spark's functions holds


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class ScanStore:
    """Manifest of finished texts and their findings, as two parquet tables.

    Each run appends its findings under a run id of its own and then its
    manifest. Findings whose run has no manifest come from a run that was
    interrupted; they are never read.
    """

    def __init__(self, spark: SparkSession, path: str, texts: DataFrame, id_cols: list[str]):
        self.spark, self.path, self.id_cols = spark, path.rstrip("/"), id_cols
        ids = [texts.schema[c] for c in id_cols]
        stamp = [T.StructField("text_sha2", T.StringType()), T.StructField("rules_hash", T.StringType())]
        run = [T.StructField("run", T.StringType())]
        done = [T.StructField("done_at", T.StringType())]
        file = [T.StructField("file", T.StringType())]
        self.manifest_schema = T.StructType([*ids, *stamp, *done, *run])
        self.held_schema = T.StructType([*file, *ids, *stamp, *run])
        self.files_schema = T.StructType([*file, stamp[1], *run])
        self.finding_schema = T.StructType([*ids, *FINDING_FIELDS.fields, *stamp, *run])

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        path = f"{self.path}/{table}"
        if not _exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def manifest(self, pack_hash: str) -> DataFrame:
        return self._read("manifest", self.manifest_schema).where(F.col("rules_hash") == pack_hash)

    def findings(self, pack_hash: str) -> DataFrame:
        """Findings of finished runs."""
        finished = self.manifest(pack_hash).select("run").distinct()
        stored = self._read("findings", self.finding_schema).where(F.col("rules_hash") == pack_hash)
        return stored.join(finished, "run", "left_semi")

    def files(self, pack_hash: str) -> DataFrame:
        """Files whose texts are all done, by the digest of their path, time and size."""
        return self._read("files", self.files_schema).where(F.col("rules_hash") == pack_hash).select("file").distinct()

    def held(self, pack_hash: str) -> DataFrame:
        """The keys of the texts in each of :meth:`files`."""
        rows = self._read("held", self.held_schema).where(F.col("rules_hash") == pack_hash)
        return rows.select("file", *self.id_cols, "text_sha2")

    def append_files(self, rows: DataFrame, run: str) -> None:
        """Note which texts files hold, then that the files are done; what is half written is never read."""
        for table, part in (("held", rows), ("files", rows.select("file", "rules_hash").distinct())):
            part.hint("rebalance").write.mode("overwrite").parquet(f"{self.path}/{table}/run={run}")

    def finished(self, run: str) -> bool:
        """Whether a run has written all it found; the manifest comes last."""
        return _exists(self.spark, f"{self.path}/manifest/run={run}/_SUCCESS")

    def append(self, keys: DataFrame, findings: DataFrame, run: str) -> None:
        """Write a run's findings, then its manifest; what an earlier try of the run left is replaced."""
        # Spark fixes the time once per query, so it is that of the run.
        keys = keys.withColumn("done_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
        for table, rows in (("findings", findings), ("manifest", keys)):
            rows.hint("rebalance").write.mode("overwrite").parquet(f"{self.path}/{table}/run={run}")

    def clear(self) -> None:
        """Forget everything, as after a complete scan that need not be resumed."""
        for table in ("files", "held", "findings", "manifest"):
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def _fingerprint(text_col: str) -> Column:
    return F.coalesce(F.sha2(F.col(text_col).cast("binary"), 256), F.lit(""))


def _keep(texts: DataFrame, keys: DataFrame, on: list[str], how: str, limit: int) -> DataFrame:
    """Semi or anti join that broadcasts ``keys`` while they are small and shuffles otherwise; null ids are ids."""
    side = F.broadcast(keys) if estimated_bytes(keys) <= limit else keys
    side = side.select(*[F.col(c).alias(f"_k_{c}") for c in on])
    return texts.join(side, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in on]), how)


def _slot(key: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(bits).cast("long"))


def _probable(texts: DataFrame, keys: DataFrame, on: list[str], max_bits: int) -> DataFrame:
    """``texts`` whose key may be among ``keys``: all that are, and few that are not; no text is moved.

    The keys become a map of bits, one per key, whose size is bounded whatever
    their number. It is broadcast in blocks, and a text looks up its one bit.
    """
    blocks = min(-(-max_bits // _BLOCK_BITS), -(-keys.count() * _BITS_PER_KEY // _BLOCK_BITS) or 1)
    bits = blocks * _BLOCK_BITS
    slot = _slot(on, bits)
    bitmap = (
        keys.select(F.expr(f"{_BLOCK_BITS}L").alias("_n"), slot.alias("_slot"))
        .groupBy(F.floor(F.col("_slot") / F.col("_n")).alias("_block"))
        .agg(F.bitmap_construct_agg(F.col("_slot") % F.col("_n")).alias("_map"))
    )
    place = slot % _BLOCK_BITS
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    here = (F.floor(slot / _BLOCK_BITS) == F.col("_block")) & (F.getbit(byte, (place % 8).cast("int")) == 1)
    return texts.join(F.broadcast(bitmap), here, "left_semi")


def resume_scan(
    texts: DataFrame,
    rules: DataFrame | list[dict],
    store_path: str,
    id_cols: list[str],
    text_col: str = "text",
    *,
    broadcast_limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Findings of all ``texts``; only texts the store does not know yet are scanned.

    A text counts as known when its id, its content and the rule pack are all
    unchanged. What is left to do is settled on narrow (id, hash) rows that are
    written down first. Texts are never shuffled: where both the done and the open
    list are too large to broadcast, a bounded bitmap of the open one picks the
    texts, and findings of the few it picks in vain are dropped by an exact join.
    """
    pack = rules if isinstance(rules, list) else prepare(rules)
    store = ScanStore(texts.sparkSession, store_path, texts, id_cols)
    current = _scan_open(store, texts, pack, text_col, uuid.uuid4().hex, broadcast_limit)
    known = store.findings(rules_hash(pack))
    return _keep(known, current, [*id_cols, "text_sha2"], "left_semi", broadcast_limit).select(
        *id_cols, *FINDING_FIELDS.fieldNames()
    )


def _open_texts(
    stamped: DataFrame, done: DataFrame, todo: DataFrame, key: list[str], limit: int, max_bits: int = MAP_BITS
) -> tuple[DataFrame, bool]:
    """The texts left to scan, and whether a few others may be among them."""
    if min(estimated_bytes(done), estimated_bytes(todo)) > limit:
        return _probable(stamped, todo, key, max_bits), True
    if estimated_bytes(done) < estimated_bytes(todo):
        return _keep(stamped, done, key, "left_anti", limit), False
    return _keep(stamped, todo, key, "left_semi", limit), False


def _scan_open(
    store: ScanStore,
    texts: DataFrame,
    pack: list[dict],
    text_col: str,
    run: str,
    broadcast_limit: int,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """Scan what no other run of the store has finished, as ``run``; the keys of all ``texts``, with ``carried``."""
    pack_hash, id_cols = rules_hash(pack), store.id_cols
    key = [*id_cols, "text_sha2"]
    stamped = texts.select(*id_cols, text_col, *carried).withColumn("text_sha2", _fingerprint(text_col))
    # Whole texts are read twice at most: here for their keys, below to be scanned.
    rows = materialise(stamped.select(*carried, *key).distinct(), "keys")
    current = rows.select(*key).distinct() if carried else rows
    done = store.manifest(pack_hash).where(F.col("run") != run).select(*key)
    vague = False
    if done.isEmpty():
        todo, open_texts = current, stamped
    else:
        todo = materialise(_keep(current, done, key, "left_anti", broadcast_limit), "todo")
        open_texts, vague = _open_texts(stamped, done, todo, key, broadcast_limit)
    pack_column = F.lit(pack_hash).alias("rules_hash")
    # The finding carries the hash of the very text it was found in.
    fresh = scan(open_texts, pack, key, text_col).select("*", pack_column)
    if vague:
        fresh = _keep(fresh, todo, key, "left_semi", broadcast_limit)
    store.append(todo.select(*key, pack_column), fresh, run)
    return rows


def _file_digest(source: str = "_metadata") -> Column:
    """One digest of a file's path, modification time and size."""
    changed = F.unix_micros(f"{source}.file_modification_time").cast("string")
    return F.sha2(F.concat_ws("|", f"{source}.file_path", changed, F.col(f"{source}.file_size").cast("string")), 256)


def resume_files(
    spark: SparkSession,
    path: str,
    rules: DataFrame | list[dict],
    store_path: str,
    id_cols: list[str],
    text_col: str = "text",
    *,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    broadcast_limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """:func:`resume_scan` of a table in a folder of files, which opens only files that are new or changed.

    The store notes each file it has been through, by path, modification time and
    size, and the keys of its texts. Files it knows are not opened again; their
    findings come from the store. Texts of the others are looked up one by one,
    so a file that was rewritten with the same texts costs their reading only.
    The listing, which the driver holds for any read, is all that passes it.
    """
    pack = rules if isinstance(rules, list) else prepare(rules)
    pack_hash = rules_hash(pack)
    table = (spark.read.schema(schema) if schema else spark.read).format(fmt).load(path)
    store = ScanStore(spark, store_path, table, id_cols)
    # A reader that yields a row per file; contents are not asked for.
    listed = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("path"), _file_digest().alias("file")
    )
    listed = materialise(listed, "files")
    known = store.files(pack_hash)
    fresh = [r["path"] for r in _keep(listed, known, ["file"], "left_anti", broadcast_limit).collect()]
    key = [*id_cols, "text_sha2"]
    current = _keep(store.held(pack_hash), listed.join(known, "file", "left_semi"), ["file"], "left_semi", broadcast_limit)
    current = materialise(current.select(*key), "held")
    if fresh:
        # Names come as URIs; what a pattern would read as a wildcard is escaped.
        names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(name)) for name in fresh]
        root = path if _is_folder(spark, path) else path.rsplit("/", 1)[0]
        texts = spark.read.schema(table.schema).format(fmt).option("basePath", root).load(names)
        run = uuid.uuid4().hex
        texts = texts.select(*id_cols, text_col, _file_digest().alias("file"))
        rows = _scan_open(store, texts, pack, text_col, run, broadcast_limit, ("file",))
        store.append_files(rows.withColumn("rules_hash", F.lit(pack_hash)), run)
        current = current.union(rows.select(*key))
    found = store.findings(pack_hash)
    return _keep(found, current, key, "left_semi", broadcast_limit).select(*id_cols, *FINDING_FIELDS.fieldNames())


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def stream_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream over a parquet table, be it a folder of part files or a single file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if _is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


def stream_scan(
    stream: DataFrame,
    rules: DataFrame | list[dict],
    out_path: str,
    checkpoint: str,
    id_cols: list[str],
    text_col: str = "text",
    partitions: int | None = None,
) -> StreamingQuery:
    """Scan a stream of texts into a parquet table, processing what is available now.

    The checkpoint remembers which input files are done, so calling this again
    scans only what arrived in between. The scan has no state: every micro-batch
    runs the batch plan. ``partitions`` spreads each micro-batch, for sources
    whose few files would leave most of the cluster idle.
    """
    texts = stream.select(*id_cols, text_col)
    if partitions:
        texts = texts.repartition(partitions)
    return (
        scan(texts, rules, id_cols, text_col)
        .writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a streaming query keeps over restarts, from its checkpoint."""
    stored = spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata")
    return stored.first()["id"]


def stream_to_store(
    stream: DataFrame,
    rules: DataFrame | list[dict],
    store_path: str,
    checkpoint: str,
    id_cols: list[str],
    text_col: str = "text",
    *,
    broadcast_limit: int = BROADCAST_BYTES,
) -> StreamingQuery:
    """Scan a stream into the store :func:`resume_scan` uses, processing what is available now.

    Each micro-batch is a run named by the query's id and the batch's number. A
    batch that Spark runs again, because its commit was lost, is left alone if its
    manifest is there and replaces its own findings if not: no finding is stored
    twice. Texts any run or stream has finished with these rules are not scanned
    again. Findings are rebalanced into few files; texts stay where they are
    unless both id lists are too large to broadcast.
    """
    pack = rules if isinstance(rules, list) else prepare(rules)
    schema = stream.select(*id_cols, text_col)

    def scan_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = ScanStore(spark, store_path, schema, id_cols)
        run = f"{_stream_id(spark, checkpoint)}-{number}"
        if not store.finished(run):
            _scan_open(store, batch, pack, text_col, run, broadcast_limit)

    return (
        schema.writeStream.foreachBatch(scan_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored_findings(
    spark: SparkSession, store_path: str, rules: DataFrame | list[dict], texts: DataFrame, id_cols: list[str]
) -> DataFrame:
    """All findings the store holds for these rules; ``texts`` gives the types of the ids."""
    pack = rules if isinstance(rules, list) else prepare(rules)
    found = ScanStore(spark, store_path, texts, id_cols).findings(rules_hash(pack))
    return found.select(*id_cols, *FINDING_FIELDS.fieldNames())


def read_stream_output(spark: SparkSession, out_path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(out_path)
