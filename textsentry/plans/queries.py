"""One registered query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textsentry.functions import regex, text
from textsentry.operators import findings as post
from textsentry.operators import rules as ruleops
from textsentry.operators import sinks, stats, validation
from textsentry.operators.scan import long_enough, prepare, scan, scan_large
from textsentry.operators.sqlfunction import register_scan
from textsentry.plans.catalogue import nested_catalogue, part_catalogue
from textsentry.plans.pipeline import scan_table, scan_tree
from textsentry.schemas import FINDING_COLUMNS, FINDING_FIELDS, RULE_FIELDS
from textsentry.session import spread, work_path
from textsentry.sources import files
from textsentry.sources.catalogue import catalogue_frame, flatten_catalogue
from textsentry.sources.packs import default_rules
from textsentry.streaming.incremental import (
    read_stream_output,
    resume_files,
    resume_scan,
    stream_scan,
    stream_table,
    stream_to_store,
)

BLOCK_WORDS = ["example.org", "/the", "0"]
GROUP_WORDS = [" Brand#1 ", "#25", "  "]
NAME_WORDS = ["SMALL", " ring"]
DIGITS = r"\s\d+\s"
CAPTURE_EMAIL = r"([a-z0-9._]+)@([a-z0-9-]+)\.([a-z.]+)"
DOMAIN = r"@(?:([a-z0-9-]+)\.)+[a-z]{2,5}"
# One round of its repeated group; mail domains are short, so the loop is harmless.
LABEL = r"([a-z0-9-]+)\."
# Repeated groups of three kinds, and the number of the group.
HISTORIES = {
    "labels": (DOMAIN, 1),
    "numbers": (r"(?:([0-9]{1,3})\.){2,}[0-9]{1,3}", 1),
    "hyphens": (r"([a-z]+)(?:-([a-z]+))+", 2),
}
# A conditional group, which Java does not have, and the same without it.
CONDITIONAL = r"(\()?[0-9]{3}(?(1)\)|-) ?[0-9]{3}-[0-9]{4}"
UNCONDITIONAL = r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}- ?[0-9]{3}-[0-9]{4}"
# Nested, quoted, following, endless and possessive repeats; the same text in both engines' SQL.
LOOPED_PATTERN = """CASE rule_ord % 8
  WHEN 0 THEN concat('(?:(?:', replace(name, ' ', '|'), '){', rule_ord % 40, '}){', CAST(floor(rule_ord / 7) AS INT) % 25, '}')
  WHEN 1 THEN concat(chr(92), 'Q', name, ')+(', chr(92), 'E')
  WHEN 2 THEN concat('(', name, '){', rule_ord % 90, '}[)+]')
  WHEN 3 THEN concat('((', name, ')?){', rule_ord % 70, ',}')
  WHEN 4 THEN concat('(', name, '){1,', rule_ord % 50 + 1, '}(b|c){2}', chr(92), '(x){7}')
  ELSE f_regex END"""
SIZE_LIMIT_MB = 0.002
CHUNK_THRESHOLD_MB = 4 / 1024
CHUNK_BYTES = 2048
CHUNK_OVERLAP = 1024
TILE = {"name": "Tile", "f_regex": r"[^\n]{48}", "engine": "go", "sensitive": False}
PAGES_PER_FILE = 25
EXCLUDED_EXTENSIONS = ["html", ".PHP"]
EXCLUDED_PATHS = ["/en/", "blog."]
FIRST_N = 2


@lru_cache(maxsize=8)
def full_pack(spark: SparkSession) -> list[dict]:
    return prepare(default_rules(spark, extended=True))


@lru_cache(maxsize=8)
def tile_pack(spark: SparkSession) -> list[dict]:
    rule = {**TILE, "loaded": True, "context_left": 0, "context_right": 0}
    return prepare(flatten_catalogue(catalogue_frame(spark, {"rules": [{"group": "Layout", "rule": [rule]}]})))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


# Scans -----------------------------------------------------------------------


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_table(documents(spark, sf_dir), full_pack(spark), ["doc_id"])


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_table(pages(spark, sf_dir), full_pack(spark), ["page_id"], "html")


def scan_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_table(
        table(spark, sf_dir, "conversations"), full_pack(spark), ["conv_id", "turn"]
    )


def scan_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pack as a SQL function, called in a statement."""
    register_scan(spark, full_pack(spark), "scan_text")
    spread(documents(spark, sf_dir).select("doc_id", "text")).createOrReplaceTempView("scanned_documents")
    return spark.sql(
        """SELECT doc_id, f.* FROM (SELECT doc_id, explode_outer(found) AS f
             FROM (SELECT doc_id, scan_text(text) AS found FROM scanned_documents))
           WHERE f IS NOT NULL"""
    )


def scan_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipped default pack, sensitive rules only."""
    return scan_table(
        documents(spark, sf_dir), default_rules(spark), ["doc_id"], only_sensitive=True
    )


def scan_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join plan: texts look up which rules may match and join them by number."""
    texts = spread(documents(spark, sf_dir).select("doc_id", "text"))
    return scan(texts, full_pack(spark), ["doc_id"], plan="join")


def scan_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule with syntax Java does not have, run by another spelling."""
    rule = {"name": "Phone", "f_regex": CONDITIONAL, "loaded": True, "engine": "java"}
    document = {"rules": [{"group": "Contact Numbers", "rule": [rule]}]}
    compiled = ruleops.compile_rules(
        flatten_catalogue(catalogue_frame(spark, document)),
        gates={CONDITIONAL: ["-"]},
        forms={CONDITIONAL: UNCONDITIONAL},
    )
    return scan_table(documents(spark, sf_dir), compiled, ["doc_id"])


def scan_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables in one pass, told apart by ``source``."""

    def part(name: str, key, column: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.lit(name).alias("source"), key.alias("id"), F.col(column).alias("text")
        )

    conversation = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    texts = (
        part("documents", F.col("doc_id").cast("string"), "text")
        .unionByName(part("pages", F.col("page_id").cast("string"), "html"))
        .unionByName(part("conversations", conversation, "text"))
    )
    return scan_table(texts, full_pack(spark), ["source", "id"])


def chunked_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in chunks, also by a rule whose matches lie side by side through the whole text."""
    texts = spread(documents(spark, sf_dir).select("doc_id", "text"))
    return scan_large(
        texts,
        [*full_pack(spark), *tile_pack(spark)],
        ["doc_id"],
        threshold_mb=CHUNK_THRESHOLD_MB,
        chunk_bytes=CHUNK_BYTES,
        overlap=CHUNK_OVERLAP,
    )


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_table(documents(spark, sf_dir), full_pack(spark), ["doc_id"])


def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_table(pages(spark, sf_dir), full_pack(spark), ["page_id"], "html")


# Match primitives -------------------------------------------------------------


def _documents_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(documents(spark, sf_dir).select("doc_id", "text"))


def _email_pattern() -> str:
    return regex.JAVA_FLAGS + CAPTURE_EMAIL


def _email() -> Column:
    return F.lit(_email_pattern())


def match_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents_text(spark, sf_dir)
    return docs.select("doc_id", regex.match_any(F.col("text"), _email()).alias("hit"))


def match_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("text")
    first = F.array(regex.match_first(body, _email_pattern()))
    start = text.byte_position(text.before_first(body, F.col("match")))
    return (
        _documents_text(spark, sf_dir)
        # Exploded, so that the null test below cannot move the regex into a filter.
        .select("doc_id", "text", F.explode_outer(first).alias("match"))
        .where("match IS NOT NULL")
        .select("doc_id", "match", start.alias("position"))
    )


def match_all_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regex.match_all(F.col("text"), F.lit(regex.JAVA_FLAGS + r"[^\W\d_]{12,}"), FIRST_N)
    return (
        _documents_text(spark, sf_dir)
        .select("doc_id", F.posexplode_outer(found).alias("n", "match"))
        .where("match IS NOT NULL")
    )


def match_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regex.match_groups(F.col("text"), _email(), 3)
    return (
        _documents_text(spark, sf_dir)
        .select("doc_id", F.explode_outer(found).alias("g"))
        .where("g IS NOT NULL")
        .select("doc_id", "g.*")
    )


def match_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captures of a repeated group: the labels of mail domains."""
    found = regex.match_all(F.col("text"), F.lit(regex.JAVA_FLAGS + DOMAIN))
    labels = F.regexp_extract_all("match", F.lit(regex.JAVA_FLAGS + LABEL), F.lit(1))
    return (
        _documents_text(spark, sf_dir)
        .select("doc_id", F.explode_outer(F.when(F.contains("text", F.lit("@")), found)).alias("match"))
        .where("match IS NOT NULL")
        .select("doc_id", "match", F.concat_ws(",", labels).alias("labels"))
    )


def capture_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captures of repeated groups, with the pattern of a round taken from the rule itself."""

    def history(kind: str, pattern: str, group: int) -> Column:
        found = regex.match_all(F.col("text"), F.lit(regex.JAVA_FLAGS + pattern))
        pairs = F.transform(found, lambda m: F.struct(m.alias("match"), regex.capture_history(m, pattern, group).alias("captures")))
        return F.struct(F.lit(kind).alias("kind"), pairs.alias("found"))

    docs = _documents_text(spark, sf_dir)
    found = [history(kind, *rule) for kind, rule in HISTORIES.items()]
    return (
        docs.select("doc_id", F.explode(F.array(*found)).alias("k"))
        .select("doc_id", "k.kind", F.explode_outer("k.found").alias("f"))
        .where("f IS NOT NULL")
        .select("doc_id", "kind", "f.match", F.concat_ws(",", "f.captures").alias("captures"))
    )


def findings_min_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regex.match_all(F.col("text"), F.lit(regex.JAVA_FLAGS + DIGITS))
    return (
        _documents_text(spark, sf_dir)
        .select("doc_id", F.explode_outer(found).alias("match"))
        .where(F.col("match").isNotNull() & long_enough(F.col("match")))
    )


# Rules as data ----------------------------------------------------------------


def rules_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = nested_catalogue(part_catalogue(spark, sf_dir))
    return flatten_catalogue(nested).drop("rule_ord", "group_ord")


def rules_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of groups in a catalogue and of rules in their group, many catalogues of many groups."""
    rule = F.struct("rule_ord", F.struct(*RULE_FIELDS.fieldNames()).alias("r"))
    groups = (
        part_catalogue(spark, sf_dir)
        .groupBy("group", F.expr("rule_ord DIV 100").alias("entry"))
        .agg(F.array_sort(F.collect_list(rule)).alias("rules"))
        .select("entry", F.struct("group", F.transform("rules", lambda x: x["r"]).alias("rule")).alias("g"))
    )
    nested = groups.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct(F.col("g.group").alias("k"), "g"))).alias("gs"))
    flat = flatten_catalogue(nested.select(F.transform("gs", lambda x: x["g"]).alias("rules")))
    return flat.select("group_ord", "rule_ord", "group", "name", "f_regex")


def rules_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruleops.usable(part_catalogue(spark, sf_dir))


def rules_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruleops.by_group(part_catalogue(spark, sf_dir), GROUP_WORDS)


def rules_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruleops.by_name(part_catalogue(spark, sf_dir), NAME_WORDS)


def rules_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruleops.sensitive_only(part_catalogue(spark, sf_dir))


def rules_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruleops.fill_context(part_catalogue(spark, sf_dir)).select(
        "rule_ord", "sensitive", "context_left", "context_right"
    )


def rules_group_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruleops.last_group_wins(ruleops.usable(part_catalogue(spark, sf_dir)))


def rules_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruleops.select_rules(
        part_catalogue(spark, sf_dir), groups=GROUP_WORDS, names=NAME_WORDS, only_sensitive=True
    )


def rules_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = regex.resolve_engine(F.col("engine"), F.col("f_regex"))
    return part_catalogue(spark, sf_dir).select(
        "rule_ord", "engine", F.coalesce(resolved, F.lit("error")).alias("engine_resolved")
    )


def rules_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = ruleops.usable(part_catalogue(spark, sf_dir))
    return ruleops.compile_rules(usable).select(
        "rule_ord", "engine_resolved", "pattern", "compile_ok"
    )


def rules_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruleops.listing(part_catalogue(spark, sf_dir))


def rules_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruleops.count_rules(ruleops.usable(part_catalogue(spark, sf_dir)))


def rules_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate(part_catalogue(spark, sf_dir)).drop("scan_compile_ok")


def rules_validate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validation_summary(validation.validate(part_catalogue(spark, sf_dir)))


def rule_test_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.self_test(part_catalogue(spark, sf_dir))


def rule_test_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.self_test_summary(validation.self_test(part_catalogue(spark, sf_dir)))


def rules_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts each rule of the shipped pack hits, rules without a hit included."""
    hits = (
        scan_table(documents(spark, sf_dir), default_rules(spark), ["doc_id"])
        .groupBy("group", F.col("rule_name").alias("name"))
        .agg(F.count("*").alias("n"))
    )
    return (
        default_rules(spark)
        .select("group", "name", "f_regex", "sensitive")
        .join(hits, ["group", "name"], "left")
        .fillna(0, ["n"])
    )


# Files ------------------------------------------------------------------------


def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as a tree of text files, many to a file in order, then scanned as files."""
    tree = work_path(spark, "tree")
    folder = F.expr(f"page_id DIV {PAGES_PER_FILE}").alias("folder")
    (
        pages(spark, sf_dir)
        .select("page_id", "html", folder)
        .repartition("folder")
        .sortWithinPartitions("folder", "page_id")
        .select("html", "folder")
        .write.partitionBy("folder")
        .text(tree)
    )
    found, _ = scan_tree(spark, tree, full_pack(spark))
    place = F.regexp_extract("path", r"folder=(\d+)/", 1).cast("long")
    return found.select(place.alias("folder"), *FINDING_COLUMNS)


def _stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes: English in UTF-8, Spanish and French in UTF-16 with a mark, others in GB18030."""
    docs = spread(documents(spark, sf_dir).select("doc_id", "lang", "text"))

    def marked(digits: str, name: str) -> Column:
        return F.concat(F.unhex(F.lit(digits)), F.encode("text", name))

    with files.java_charsets(spark):
        return docs.select(
            "doc_id",
            F.when(F.col("lang") == "en", F.col("text").cast("binary"))
            .when(F.col("lang") == "es", marked("FFFE", "UTF-16LE"))
            .when(F.col("lang") == "fr", marked("FEFF", "UTF-16BE"))
            .otherwise(F.encode("text", "GB18030"))
            .alias("content"),
        )


def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = files.decode_text(_stored_documents(spark, sf_dir))
    return decoded.select("doc_id", "charset", F.md5(F.col("text").cast("binary")).alias("md5"))


def decode_unmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes without a mark: Spanish and French in UTF-16, German in Latin-1, others in UTF-8."""
    docs = spread(documents(spark, sf_dir).select("doc_id", "lang", "text"))
    charset = {"es": "UTF-16LE", "fr": "UTF-16BE", "de": "ISO-8859-1"}
    with files.java_charsets(spark):
        content = F.col("text").cast("binary")
        for lang, name in charset.items():
            content = F.when(F.col("lang") == lang, F.encode("text", name)).otherwise(content)
        stored = docs.select("doc_id", content.alias("content"))
    decoded = files.decode_text(stored, charsets=("GB18030", "ISO-8859-1"))
    return decoded.select("doc_id", "charset", F.md5(F.col("text").cast("binary")).alias("md5"))


def errors_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the German ones empty, the French ones not decodable."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    content = (
        F.when(F.col("lang") == "de", F.lit(b""))
        .when(F.col("lang") == "fr", F.concat(body, F.unhex(F.lit("FF"))))
        .otherwise(body)
    )
    stored = documents(spark, sf_dir).select("doc_id", content.alias("content"))
    return files.scan_errors(files.decode_text(stored), ["doc_id"])


def scan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, the French ones with a byte at the end that no charset of the chain has."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    content = F.when(F.col("lang") == "fr", F.concat(body, F.unhex(F.lit("FF")))).otherwise(body)
    stored = documents(spark, sf_dir).select("doc_id", content.alias("content"))
    return files.scan_errors(files.decode_text(stored), ["doc_id"])


def docs_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the size limit leaves out, one error row each."""
    docs = documents(spark, sf_dir)
    return files.size_errors(docs, ["doc_id"], SIZE_LIMIT_MB, F.octet_length("text"))


def rules_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules a scan would refuse, and why; a part of the catalogue repeats groups within groups."""
    looped = part_catalogue(spark, sf_dir).withColumn("f_regex", F.expr(LOOPED_PATTERN))
    usable = ruleops.usable(looped)
    return ruleops.compile_rules(usable).select("rule_ord", ruleops.verdict().alias("verdict"))


def files_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = pages(spark, sf_dir).select("page_id", "url")
    return files.exclude_extensions(listed, EXCLUDED_EXTENSIONS, "url")


def files_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.exclude_paths(pages(spark, sf_dir).select("page_id", "url"), EXCLUDED_PATHS, "url")


def docs_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    small = files.limit_size(docs, SIZE_LIMIT_MB, F.octet_length("text"))
    return small.select("doc_id", F.octet_length("text").cast("long").alias("bytes"))


# Post-processing --------------------------------------------------------------


def findings_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_findings(spark, sf_dir).select("page_id", "rule_name", "match", "position")


def findings_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_findings(spark, sf_dir).select("doc_id", "rule_name", "match", "line_number")


def findings_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_findings(spark, sf_dir).select("doc_id", "rule_name", "match", "context")


def findings_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.clean(page_findings(spark, sf_dir))


def findings_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.block(page_findings(spark, sf_dir), BLOCK_WORDS)


def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.block_counts(page_findings(spark, sf_dir), BLOCK_WORDS)


def findings_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.select_keys(
        page_findings(spark, sf_dir), ["rule_name", "file", "match"], ["page_id"]
    )


def findings_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.group_findings(page_findings(spark, sf_dir), "rule_name", ["page_id"])


def _written(spark: SparkSession, sf_dir: str, fmt: str, split: bool) -> DataFrame:
    found = page_findings(spark, sf_dir)
    path = sinks.write(found, work_path(spark, "out"), fmt, split)
    return sinks.read_back(spark, path, found.schema, fmt)


def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, sinks.JSON, False)


def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, sinks.CSV, False)


def sink_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, sinks.JSON, True)


# Statistics -------------------------------------------------------------------


def stats_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.overview(scan_documents(spark, sf_dir), ["doc_id"])


def stats_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_group(scan_documents(spark, sf_dir))


def stats_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_rule(scan_documents(spark, sf_dir))


def stats_rules_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sorted_rules(scan_documents(spark, sf_dir))


def stats_top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_rules(scan_documents(spark, sf_dir))


def files_with_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.files_with_findings(scan_documents(spark, sf_dir), ["doc_id"])


# Incremental ------------------------------------------------------------------


def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run that saw the labelled documents, then the rest of them."""
    store = work_path(spark, "store")
    rules = full_pack(spark)
    docs = _documents_text(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    resume_scan(docs.join(labelled, "doc_id", "left_semi"), rules, store, ["doc_id"])
    return resume_scan(docs, rules, store, ["doc_id"])


def resumed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of files, scanned; then files of the labelled documents join it, and only those are opened."""
    store, where = work_path(spark, "store"), work_path(spark, "texts")
    docs, rules = _documents_text(spark, sf_dir), full_pack(spark)
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    for how in ("left_anti", "left_semi"):
        docs.join(labelled, "doc_id", how).write.mode("append").parquet(where)
        found = resume_files(spark, where, rules, store, ["doc_id"])
    return found


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    )
    stream = stream_table(spark, f"{sf_dir}/documents.parquet", schema)
    out, checkpoint = work_path(spark, "stream"), work_path(spark, "stream-checkpoint")
    cores = spark.sparkContext.defaultParallelism
    stream_scan(
        stream, full_pack(spark), out, checkpoint, ["doc_id"], partitions=cores
    ).awaitTermination()
    return read_stream_output(
        spark, out, T.StructType([schema.fields[0], *FINDING_FIELDS.fields])
    )


def stream_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the documents, then a batch run that finds them done, from one store."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    store, checkpoint = work_path(spark, "store"), work_path(spark, "stream-checkpoint")
    stream = stream_table(spark, f"{sf_dir}/documents.parquet", schema)
    stream_to_store(stream, full_pack(spark), store, checkpoint, ["doc_id"]).awaitTermination()
    return resume_scan(_documents_text(spark, sf_dir), full_pack(spark), store, ["doc_id"])


# Scalars ----------------------------------------------------------------------


def scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("text")
    lines = text.count_newlines(body)
    name = F.concat_ws(".", F.concat_ws("/", "source", F.col("doc_id").cast("string")), "lang")
    return documents(spark, sf_dir).select(
        "doc_id",
        F.octet_length(body).cast("long").alias("bytes"),
        lines.alias("newlines"),
        F.octet_length(text.trim_space(body)).cast("long").alias("trimmed"),
        text.elide(text.strip_extension(name), 10).alias("stem"),
        text.extension(name).alias("extension"),
        text.percent(lines, F.octet_length(body)).alias("newline_pct"),
        F.greatest(F.lit(0), F.least(F.col("n_chars"), F.lit(1000))).cast("long").alias("clamped"),
        text.contains_any(F.lower(body), ["licensed", "token"]).alias("has_word"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_documents": scan_documents,
    "scan_pages": scan_pages,
    "scan_conversations": scan_conversations,
    "scan_sql": scan_sql,
    "scan_sensitive": scan_sensitive,
    "scan_joined": scan_joined,
    "scan_fallback": scan_fallback,
    "scan_union": scan_union,
    "chunked_scan": chunked_scan,
    "match_any": match_any,
    "match_first": match_first,
    "match_all_n": match_all_n,
    "match_groups": match_groups,
    "match_history": match_history,
    "capture_history": capture_history,
    "findings_min_len": findings_min_len,
    "rules_flatten": rules_flatten,
    "rules_ordinals": rules_ordinals,
    "rules_default": rules_default,
    "rules_usable": rules_usable,
    "rules_by_group": rules_by_group,
    "rules_by_name": rules_by_name,
    "rules_sensitive": rules_sensitive,
    "rules_context": rules_context,
    "rules_group_last": rules_group_last,
    "rules_selected": rules_selected,
    "rules_engine": rules_engine,
    "rules_compiled": rules_compiled,
    "rules_listing": rules_listing,
    "rules_count": rules_count,
    "rules_validate": rules_validate,
    "rules_validate_summary": rules_validate_summary,
    "rule_test_status": rule_test_status,
    "rule_test_summary": rule_test_summary,
    "file_scan": file_scan,
    "decode_text": decode_text,
    "decode_unmarked": decode_unmarked,
    "scan_errors": scan_errors,
    "errors_by_kind": errors_by_kind,
    "docs_skipped": docs_skipped,
    "rules_verdict": rules_verdict,
    "files_by_ext": files_by_ext,
    "files_by_path": files_by_path,
    "docs_by_size": docs_by_size,
    "findings_position": findings_position,
    "findings_line": findings_line,
    "findings_context": findings_context,
    "findings_clean": findings_clean,
    "findings_block": findings_block,
    "block_counts": block_counts,
    "findings_keys": findings_keys,
    "findings_grouped": findings_grouped,
    "sink_json": sink_json,
    "sink_csv": sink_csv,
    "sink_by_group": sink_by_group,
    "stats_overview": stats_overview,
    "stats_by_group": stats_by_group,
    "stats_by_rule": stats_by_rule,
    "stats_rules_sorted": stats_rules_sorted,
    "stats_top_rules": stats_top_rules,
    "files_with_findings": files_with_findings,
    "resume_scan": resumed,
    "resume_files": resumed_files,
    "stream_scan": streamed,
    "stream_store": stream_store,
    "scalar_text": scalar_text,
}
