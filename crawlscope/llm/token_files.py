"""Token ids in Parquet: written in id order, read column by column.

Each row is a document. `tokens` is a list column with dictionary encoding; `doc_id`, `shard_start` and `n_tokens` are delta
encoded. Row groups and pages have set sizes and the files carry page indexes, so a reader that wants some documents or only the
counts skips the rest. The files are written by Spark's own committer: a task that is run again replaces its file.

Cases: a null text counts as empty and gives the end id alone; rows with equal or null ids are all kept, null ids first, equal
ids in order of the text's hash; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlscope.llm.common import piece_encoder, shared_folder, slices, small_batches

FILE_SCHEMA = "shard int, doc_id long, shard_start long, n_tokens long, tokens array<int>"


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str | None = None, kind: str = "byte", end_id: int = 0, row_group_bytes: int = 32 << 20, page_rows: int = 2000,
) -> str:
    """Encode every text, append `end_id`, write the lists in ascending doc_id order and return the folder."""

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        coder, shard, start = piece_encoder(tokenizer, kind), TaskContext.get().partitionId(), 0
        end, none = (pa.scalar(x, pa.large_binary()) for x in (np.array([end_id], dtype="<u4").tobytes(), b""))
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for a, b in slices(pc.binary_length(texts).to_pylist(), 1 << 20):
                _, ends, raw = pc.binary_join_element_wise(coder.encoded(texts.slice(a, b - a)), end, none).buffers()
                ends = np.frombuffer(ends, dtype=np.int64)[: b - a + 1] // 4
                n = np.diff(ends)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(raw, dtype="<i4", count=ends[-1])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, shard, dtype=np.int32)), ids.slice(a, b - a), pa.array(start + ends[:-1]), pa.array(n), lists], names=["shard", "doc_id", "shard_start", "n_tokens", "tokens"])
                start += int(ends[-1])

    small_batches(docs.sparkSession)
    path = path or shared_folder(docs.sparkSession, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, FILE_SCHEMA)
    writer = out.write.option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows).option("parquet.writer.version", "PARQUET_2_0")
    for column in ("shard", "doc_id", "shard_start", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.option("compression", "zstd").parquet(path)
    return path


def token_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per file: the ids before it and in it. Reads the counts only; one row per file written."""
    sizes = spark.read.schema(FILE_SCHEMA).parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    lower = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", "shard_tokens", F.coalesce(F.sum("shard_tokens").over(lower), F.lit(0)).alias("first"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents with `start`, the ids of all documents before them. Columns not asked for are not read.

    The joined table has one row per file, far below any broadcast limit.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    return rows.join(F.broadcast(token_shards(spark, path)), "shard").select(
        "doc_id", (F.col("first") + F.col("shard_start")).alias("start"), "n_tokens", "tokens", "shard"
    )


def token_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("tokens")
            values, cuts = np.asarray(lists.values).astype("<u4", copy=False), np.asarray(lists.offsets)
            view = memoryview(np.ascontiguousarray(values)).cast("B")
            crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            n = pa.array(np.diff(cuts).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), n, pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "tokens").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
