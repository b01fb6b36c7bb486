"""Registered queries of the operators: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscope.llm import (
    block_anchors, chosen_path, edit_match, importance, interleave, line_chunks, noisy_or, packed_negatives, packing, pivot_search, subword, token_files, warc,
)
from crawlscope.llm.common import floor_of, remainder_of, shared_folder, written


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return token_files.token_digest(token_files.read_tokens(spark, path))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, target = shared_folder(spark, "warc-raw"), shared_folder(spark, "warc")
    warc.write_archives(warc.page_records(table(spark, sf_dir, "pages")), raw)
    index = written(warc.normalise(spark, raw, target), "warc-index")
    refers = F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1).cast("long")
    return warc.read_records(index).select(
        "page_id", F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"), F.coalesce("payload_digest", "stated_digest").alias("payload_digest"),
        "record_type", F.when(F.col("record_type") == "revisit", refers).alias("refers_to"),
    )


def op3_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), remainder_of(F.col("doc_id"), 5)
    model = noisy_or.fit(docs, table(spark, sf_dir, "labels"), "toxic", fold != 0)
    out = noisy_or.offending_in(noisy_or.scored(docs.select("doc_id", "text"), model), model)
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op4_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), remainder_of(F.col("doc_id"), 4)
    model = subword.fit(docs, table(spark, sf_dir, "labels"), "quality", fold != 2)
    out = subword.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, transform=lambda x: floor_of(x * 256), k=5)


def op6_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = interleave.interleaved(table(spark, sf_dir, "documents"), shards=24)
    return places.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.components(table(spark, sf_dir, "documents"), share=85)


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.repeats(table(spark, sf_dir, "documents"))


def op9_edit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_match.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), piece=512, block=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = block_anchors.deduplicated(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), runs=(1, 1), buckets=10_000, share=10, least_words=20, seed=2024)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_packed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return packed_negatives.mined(rows, lambda i: i % 100 == 0, label, lambda x: floor_of(x * 256), positives=5, negatives=5, share=80)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_warc, op3_noisy_or, op4_subword, op5_pivots, op6_interleave, op7_chosen_path, op8_line_chunks, op9_edit_match, op10_packing,
        op11_block_anchors, op12_importance, op13_packed_negatives,
    )
}
