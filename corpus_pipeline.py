"""From raw documents to packed training windows: five stages, each written and read again before the next.

Quality: documents that the classifier gives less than 0.5 go. Line dedup: repeated chunks of lines but for the first of each are
cut out; a text of which nothing is left goes. Near duplicates: of each component of the chosen-path join (five words, similarity
0.8) the document with the smallest id stays. Decontamination: documents in which a benchmark item occurs within its edit budget
go. Packing: what is left becomes windows of 2048 ids.

Null texts are kept as they are by every filter, as are texts without words, which are like nothing else. A null id is an id of its
own to the classifier and the search, the smallest id to line dedup, and near-duplicate rows without an id stay only if no row of
their component has one. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscope.llm import chosen_path, edit_match, line_chunks, packing, subword
from crawlscope.llm.common import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The classifier's draws and the tokenizer's ids can't be stated in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are likelier good than not; learned from the labelled documents among those given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = subword.fit(docs, labels, "quality")
    return subword.scored(docs.select(*COLUMNS), model, "_llm_score").filter("_llm_score >= 0.5 or text is null").drop("_llm_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out repeated chunks; drop texts that consist of them."""
    docs = docs.select(*COLUMNS)
    left = line_chunks.without_repeats(docs, line_chunks.repeats(docs))
    rest = left.filter((F.col("_llm_cut") == 0) | (F.trim(F.translate("text", "\n\r\t", "   ")) != ""))
    return rest.withColumn("n_chars", F.when(F.col("_llm_cut") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each component; each row goes or stays by its own text."""
    found = chosen_path.by_row(docs, share=80)
    gone = found.filter("not kept").select(F.col("doc_id").alias("_llm_id"), F.col("text_hash").alias("_llm_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_llm_id")) & (F.xxhash64("text") == F.col("_llm_hash"))
    return docs.select(*COLUMNS).join(gone, same, "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark item occurs."""
    return edit_match.without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and places in windows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), piece=512, block=1024)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", windows)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's result written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`run` with the ids as a checksum."""
    return run(spark, sf_dir).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
