"""The registered queries: thin digests of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsentry.llm import (
    audit,
    decontamination,
    minhash,
    mixing,
    neighbours,
    packing,
    sharding,
    substrings,
    suffixes,
    tokens,
    toxicity,
    warc,
    whitening,
)
from textsentry.llm.common import table
from textsentry.session import work_path

TOKENIZER = "piece_bpe_32k.model"
PACKING_TOKENIZER = "byte_bpe_50k.json"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.dedup_bytes(table(spark, sf_dir, "documents"), "doc_id", "text")
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.hits_by_document(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.transform("items", lambda x: x.cast("string"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(names)), 256).alias("items_sha256"),
        decontamination.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_lengths(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > tokens.LIMIT)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.one_kept(minhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", size=2))
    key = "_key.id" if found.schema["_key"].dataType.typeName() == "struct" else "_key"
    return found.select(
        F.col(key).alias("doc_id"),
        "n_shingles",
        F.col(key.replace("_key", "component")).alias("component_id"),
        "kept",
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.dedup_substrings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.tag_documents(docs.select("doc_id", "text"), model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("toxic_spans").alias("n_spans"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    path = work_path(spark, "warc")
    warc.write_archives(warc.records(pages, "page_id", "url", "html", size, null_ids=True), path)
    back = warc.resolve(warc.reassemble(warc.read_records(spark, path)))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def packing_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(PACKING_TOKENIZER)


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", packing_tokenizer())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "role"
    )


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_shard": op3_shard,
    "op4_token_counts": op4_token_counts,
    "op5_near_dedup": op5_near_dedup,
    "op6_mix": op6_mix,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_neighbours": op10_neighbours,
    "op11_pack": op11_pack,
    "op12_whiten": op12_whiten,
    "op13_filter_audit": op13_filter_audit,
}
