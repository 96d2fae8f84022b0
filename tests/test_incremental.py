from pyspark.sql import functions as F

from textsentry import resume_scan, scan, stream_scan
from textsentry.operators.scan import prepare
from textsentry.streaming.incremental import ScanStore, read_stream_output, rules_hash


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_resume_scans_only_what_is_new(spark, tmp_path, texts, one_rule):
    store = str(tmp_path / "store")
    pack = prepare(one_rule(r"secret\d+", sensitive=True))
    first = texts("secret1", "none", "secret2 secret2", None)
    assert rows(resume_scan(first, pack, store, ["id"])) == rows(scan(first, pack, ["id"]))
    manifest = spark.read.parquet(f"{store}/manifest")
    assert manifest.count() == 4
    assert manifest.where("done_at RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2} '").select("done_at").distinct().count() == 1
    # One text edited, one gone, one new.
    second = texts("secret1", "none", "secret3").union(
        spark.createDataFrame([(9, "secret9")], "id long, text string")
    )
    assert rows(resume_scan(second, pack, store, ["id"])) == rows(scan(second, pack, ["id"]))
    assert spark.read.parquet(f"{store}/manifest").count() == 6
    # Nothing new: no row is added.
    assert rows(resume_scan(second, pack, store, ["id"])) == rows(scan(second, pack, ["id"]))
    assert spark.read.parquet(f"{store}/manifest").count() == 6


def test_other_rules_scan_again(tmp_path, texts, one_rule):
    store = str(tmp_path / "store")
    docs = texts("secret1 number22")
    one, two = prepare(one_rule(r"secret\d+")), prepare(one_rule(r"number\d+"))
    assert rules_hash(one) != rules_hash(two)
    assert rows(resume_scan(docs, one, store, ["id"])) == rows(scan(docs, one, ["id"]))
    assert rows(resume_scan(docs, two, store, ["id"])) == rows(scan(docs, two, ["id"]))


def test_interrupted_run_is_not_read(spark, tmp_path, texts, one_rule):
    path = str(tmp_path / "store")
    pack = prepare(one_rule(r"secret\d+"))
    docs = texts("secret1", "secret2")
    store = ScanStore(spark, path, docs, ["id"])
    # Findings written, manifest not: as if the job died in between.
    key = docs.withColumn("text_sha2", F.sha2(F.col("text").cast("binary"), 256))
    half = scan(key, pack, ["id", "text_sha2"]).withColumn("rules_hash", F.lit(rules_hash(pack)))
    half.withColumn("run", F.lit("dead")).write.partitionBy("run").parquet(f"{path}/findings")
    assert rows(resume_scan(docs, pack, path, ["id"])) == rows(scan(docs, pack, ["id"]))
    store.clear()
    assert store.manifest(rules_hash(pack)).count() == 0
    assert rows(resume_scan(docs, pack, path, ["id"])) == rows(scan(docs, pack, ["id"]))


def test_joins_beyond_the_broadcast_limit_agree(tmp_path, texts, one_rule):
    store = str(tmp_path / "store")
    pack = prepare(one_rule(r"secret\d+"))
    docs = texts(*[f"secret{i}" for i in range(50)])
    resume_scan(docs.where("id < 30"), pack, store, ["id"], broadcast_limit=0)
    resumed = resume_scan(docs, pack, store, ["id"], broadcast_limit=0)
    assert rows(resumed) == rows(scan(docs, pack, ["id"]))


def test_large_lists_move_no_text(spark, tmp_path, texts, one_rule):
    from textsentry.streaming.incremental import _open_texts, _probable

    keys = ["id", "text_sha2"]
    docs = texts(*[f"secret{i}" for i in range(3000)]).withColumn("text_sha2", F.sha2(F.col("text").cast("binary"), 256))
    docs = docs.union(spark.createDataFrame([(None, "secret", "a"), (-1, None, "")], docs.schema))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    half = F.coalesce(F.col("id") % 2 != 0, F.lit(True))
    todo, done = docs.where(half).select(*keys), docs.where(~half).select(*keys)
    want = {r["text"] for r in docs.where(half).collect()}
    for bits, most in ((1 << 29, 1650), (1, 3002)):
        got, vague = _open_texts(docs, done, todo, keys, 0, bits)
        assert vague and want <= {r["text"] for r in got.collect()} and got.count() <= most
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "rangepartitioning" not in plan and "SortMergeJoin" not in plan
        above = plan.split("BroadcastExchange")[0]  # the side of the texts comes first
        assert "Exchange" not in above
    # Every map of a bit per key, also the smallest, holds all keys; no keys, no texts.
    assert _probable(docs, todo.limit(0), keys, 1).count() == 0


def test_files_that_are_done_are_not_opened(spark, tmp_path, texts, one_rule):
    import os

    from textsentry import resume_files

    pack = prepare(one_rule(r"secret\d+"))
    where, store = tmp_path / "a%20 d", str(tmp_path / "store")
    schema = texts("x").schema

    def run():
        found = rows(resume_files(spark, str(where), pack, store, ["id"], schema=schema))
        return found, spark.read.parquet(f"{store}/manifest").count()

    first = texts(*[f"secret{i}" for i in range(20)], "none", None)
    first.repartition(3).write.parquet(str(where))
    want = rows(scan(first, pack, ["id"]))
    assert len(want) == 20 and run() == (want, 22)
    # Made unreadable without a trace: opening them would fail.
    done = sorted(where.glob("part-*"))
    kept = {}
    for file in done:
        kept[file], stat = file.read_bytes(), file.stat()
        file.write_bytes(b"\0" * stat.st_size)
        os.utime(file, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert run() == (want, 22)
    more = texts("secret1", "secret2").selectExpr("id + 50 AS id", "text")
    more.coalesce(1).write.mode("append").parquet(str(where))
    # Characters that a path pattern would read as wildcards.
    added = next(f for f in where.glob("part-*") if f not in kept)
    (where / f".{added.name}.crc").unlink()
    added.rename(where / "part-[x] {y,z}*?.parquet")
    want = rows(scan(first.union(more), pack, ["id"]))
    assert run() == (want, 24)
    # A file gone takes its findings along; one touched is read, but its texts are known.
    for file, data in kept.items():
        file.write_bytes(data)
        (where / f".{file.name}.crc").unlink(missing_ok=True)
        os.utime(file, ns=(1, 10**18))
    assert run() == (want, 24)
    gone = spark.read.parquet(str(where)).where(F.col("_metadata.file_name") != done[0].name).select("id", "text")
    want = rows(scan(gone, pack, ["id"]))
    done[0].unlink()
    assert 0 < len(want) < 22 and run() == (want, 24)
    # Other rules open all files again.
    other = prepare(one_rule(r"secret\d"))
    assert rows(resume_files(spark, str(where), other, store, ["id"])) == rows(scan(spark.read.parquet(str(where)), other, ["id"]))


def test_stream_picks_up_new_files_once(spark, tmp_path, texts, one_rule):
    pack = prepare(one_rule(r"secret\d+"))
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = texts("x").schema

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        stream_scan(stream, pack, out, checkpoint, ["id"]).awaitTermination()
        return rows(read_stream_output(spark, out, scan(texts("x"), pack, ["id"]).schema))

    texts("secret1", "none").write.parquet(source)
    assert [r[3] for r in run()] == ["secret1"]
    texts("none", "secret2").write.mode("append").parquet(source)
    assert [r[3] for r in run()] == ["secret1", "secret2"]
    assert [r[3] for r in run()] == ["secret1", "secret2"]


def test_streams_one_file_and_a_folder_alike(spark, tmp_path, texts, one_rule):
    from textsentry.streaming.incremental import stream_table

    pack = prepare(one_rule(r"secret\d+"))
    docs = texts(*[f"secret{i}" for i in range(40)])
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    single = tmp_path / "single" / "docs.parquet"
    single.parent.mkdir()
    next((tmp_path / "one").glob("part-*.parquet")).rename(single)
    docs.repartition(4).write.parquet(str(tmp_path / "docs.parquet"))
    got = []
    for k, path in enumerate((single, tmp_path / "docs.parquet")):
        out = str(tmp_path / f"out{k}")
        stream_scan(stream_table(spark, str(path), docs.schema), pack, out, str(tmp_path / f"cp{k}"), ["id"]).awaitTermination()
        got.append(rows(read_stream_output(spark, out, scan(docs, pack, ["id"]).schema)))
    assert got[0] == got[1] and len(got[0]) == 40


def test_stream_and_batch_share_one_store(spark, tmp_path, texts, one_rule):
    from textsentry.streaming.incremental import stored_findings, stream_to_store

    pack = prepare(one_rule(r"secret\d+"))
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "store", "cp"))
    schema = texts("x").schema

    def manifest():
        return spark.read.parquet(f"{path}/manifest")

    def run(cp=checkpoint):
        stream = spark.readStream.schema(schema).parquet(source)
        stream_to_store(stream, pack, path, cp, ["id"]).awaitTermination()
        return rows(stored_findings(spark, path, pack, texts("x"), ["id"]))

    first = texts(*[f"secret{i}" for i in range(20)], "none", None)
    first.repartition(4).write.parquet(source)
    want = rows(scan(first, pack, ["id"]))
    assert len(want) == 20 and run() == want and manifest().count() == 22
    # The batch run finds everything done; it adds its own text, which the stream then skips.
    more = first.union(spark.createDataFrame([(90, "secret90")], "id long, text string"))
    assert rows(resume_scan(more, pack, path, ["id"])) == rows(scan(more, pack, ["id"]))
    assert manifest().count() == 23
    more.where("id = 90").write.mode("append").parquet(source)
    want = rows(scan(more, pack, ["id"]))
    assert run() == want and manifest().count() == 23
    # Few findings make few files.
    assert len(list((tmp_path / "store" / "findings").glob("run=*-0/part-*"))) == 1
    # A replayed batch, its commit lost, with and without its manifest.
    (tmp_path / "cp" / "commits" / "1").unlink()
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert run() == want and manifest().count() == 23
    (tmp_path / "cp" / "commits" / "1").unlink()
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    run_folder = next((tmp_path / "store" / "manifest").glob("run=*-1"))
    (run_folder / "_SUCCESS").unlink()
    assert run() == want and manifest().count() == 23
    # Null ids and null texts are done like others.
    odd = spark.createDataFrame([(None, "secret77"), (None, None), (78, None)], "id long, text string")
    for _ in range(2):
        assert rows(resume_scan(odd, pack, path, ["id"])) == rows(scan(odd, pack, ["id"]))
        assert manifest().count() == 26
    # A new checkpoint is another stream: its first batch is not taken for the old one's.
    texts("secret1").selectExpr("id + 70 AS id", "text").write.mode("append").parquet(source)
    assert len(run(str(tmp_path / "cp2"))) == 23


def test_few_findings_make_few_files(spark, tmp_path, texts, one_rule):
    from textsentry.operators import sinks

    docs = texts(*[f"secret{i}" if i % 8 == 0 else "none" for i in range(200)]).repartition(64)
    found = scan(docs, prepare(one_rule(r"secret\d+")), ["id"])
    for split in (False, True):
        path = sinks.write(found, str(tmp_path / f"out{split}"), sinks.JSON, split)
        files = spark.read.json(path).select("_metadata.file_path").distinct().count()
        assert files <= 4 and spark.read.json(path).count() == 25
