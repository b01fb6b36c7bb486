"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are ranked in a seeded shuffle within their source; a row's place is its fractional rank, so every stretch of the order
mixes the sources as the whole does; the order is cut into shards whose row counts differ by one at most. Sources start at a seeded
fraction of a step, which keeps many small sources from meeting at one place.

No window sees a whole source: ranks are counted in hash buckets and the buckets' sizes summed before them, and so for the order
of all rows. Texts are read once; what is shuffled holds no text.

Cases: a null text counts as empty; a null source is a source of its own; equal ids are ordered by size and crc, and rows alike in
all of these get different slots in any order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.llm.common import before, crc32, written

#: Hash values are 60 bits of an md5, which other SQL engines have too.
SPAN = float(1 << 60)


def hashed(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def interleaved(docs: DataFrame, shards: int = 24, seed: int = 0, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", bucket_rows: int = 256) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes plus 8), text_crc32, shard, slot."""
    text, salt = F.coalesce(docs[text_column], F.lit("")), F.lit(str(seed))
    rows = docs.select(
        docs[id_column].cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), docs[source_column]), F.lit("n")).alias("_source"),
        (F.octet_length(text) + 8).cast("long").alias("size"), crc32(text).alias("text_crc32"),
    )
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = written(rows.withColumn("_hash", hashed(salt, name, F.col("text_crc32").cast("string"))), "shard-rows")
    total = rows.count()
    buckets = max(1, total // bucket_rows)
    place = lambda share: F.least(F.floor(share * buckets), F.lit(buckets - 1))

    rows = rows.withColumn("_bucket", place(F.col("_hash") / SPAN))
    sizes = before(rows.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n")), ["_source"], "_bucket", "_n", "_before")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id", "size")
    ranked = rows.withColumn("_rank", F.row_number().over(inside)).join(sizes.drop("_n"), ["_source", "_bucket"])
    start = hashed(salt, F.col("_source")) / SPAN
    ranked = written(
        ranked.select("doc_id", "_source", "size", "text_crc32", "_hash", ((F.col("_before") + F.col("_rank") - 1 + start) / F.col("_before_all")).alias("_place")),
        "shard-ranks",
    )

    ranked = ranked.withColumn("_part", place(F.col("_place")))
    sizes = before(ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), [], "_part", "_n", "_before")
    inside = Window.partitionBy("_part").orderBy("_place", "_source", "_hash", "doc_id", "size")
    placed = ranked.withColumn("_rank", F.row_number().over(inside)).join(sizes.drop("_n"), "_part").withColumn("_at", F.col("_before") + F.col("_rank") - 1)
    shard = F.floor(F.col("_at") * shards / F.lit(max(total, 1)))
    first = F.ceil(shard * F.lit(total) / shards)
    return placed.select(
        "doc_id", F.when(F.col("_source") != "n", F.substring("_source", 2, 1 << 30)).alias("source"), "size", "text_crc32",
        shard.cast("int").alias("shard"), (F.col("_at") - first).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 0) -> DataFrame:
    """Write the rows of `docs` (ids unique), a folder per shard, in slot order; return the places."""
    places = written(interleaved(docs, shards, seed), "shard-places")
    rows = docs.join(places.select("doc_id", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")), "doc_id")
    rows.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
    return places
