"""Joins and numbering that stay even when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARE = 256
FLOOR = 0  # rows below which no key is split; at 0 small tables take the same plan as large ones
SALTS = 128


def heavy_keys(df: DataFrame, keys: list[str], share: int = SHARE, floor: int = FLOOR) -> DataFrame:
    """Keys that hold more than 1/share of the rows.

    There are fewer than `share` of them whatever the data, so this list may be broadcast. Counting combines on
    the map side and reads only the key columns.
    """
    return heavy_from_counts(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys, share, floor)


def heavy_from_counts(counts: DataFrame, keys: list[str], share: int = SHARE, floor: int = FLOOR) -> DataFrame:
    """`heavy_keys` from a table that has the row count per key in `_rows` already."""
    total = counts.agg(F.sum("_rows"))
    return counts.filter((F.col("_rows") >= floor) & (F.col("_rows") * share > total.scalar())).select(*keys)


def join_on_hot_key(
    big: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str], how: str = "left",
    hot: DataFrame | None = None, salts: int = SALTS,
) -> DataFrame:
    """Join `big` to `small` (few rows per key), splitting heavy keys over `salts` tasks.

    Rows of a heavy key are spread by the hash of `spread_by`; the matching rows of `small` are repeated once per
    salt, for heavy keys only.
    """
    marked = F.broadcast((hot if hot is not None else heavy_keys(big, keys)).select(*keys).withColumn("_hot", F.lit(True)))
    left = big.join(marked, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    ).drop("_hot")
    right = small.join(marked, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str = "seq") -> DataFrame:
    """Row number per group without sending a whole group to one task.

    `bucket` must grow with the order. Rows are numbered inside (group, bucket); the starting offset of each
    bucket is a running sum over the much smaller table of bucket sizes.
    """
    marked = df.withColumn("_bucket", bucket)
    sizes = marked.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        marked.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*group, "_bucket"])
        .withColumn(name, F.col("_rank") + F.col("_offset"))
        .drop("_rank", "_offset", "_bucket")
    )


def best_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Top k rows per group. Spark limits each group before the shuffle (WindowGroupLimit), so a heavy group sends
    at most k rows per task."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)
