"""Fetch-log reports: stop conditions, politeness and usage, without one task per host."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscope import registry
from crawlscope.operators.skew import best_per_group, join_on_hot_key

B = registry.BUDGETS


def stop_points(log: DataFrame, rate_limit: int = B["rate_limit_stop"], challenges: int = B["challenge_stop"]) -> DataFrame:
    """Sequence number at which each site's run stops, with the reason.

    The n-th event is found with a top-n per site instead of a running count, so no site is read by one task.
    """
    limited = best_per_group(log.filter("status = 429").select("site", "seq"), ["site"], [F.col("seq")], rate_limit, "n").filter(F.col("n") == rate_limit)
    firsts = log.filter("challenged").groupBy("site", "url").agg(F.min("seq").alias("seq"))
    stuck = best_per_group(firsts.select("site", "seq"), ["site"], [F.col("seq")], challenges, "n").filter(F.col("n") == challenges)
    both = limited.select("site", "seq", F.lit("RATE_LIMITED").alias("stop_reason")).union(stuck.select("site", "seq", F.lit("CHALLENGED").alias("stop_reason")))
    return both.groupBy("site").agg(F.min("seq").alias("stop_seq"), F.min_by("stop_reason", F.struct("seq", "stop_reason")).alias("stop_reason"))


def issued_requests(log: DataFrame, stops: DataFrame) -> DataFrame:
    """Mark log rows after the stop point as not issued."""
    joined = join_on_hot_key(log, stops, ["site"], ["seq"])
    return joined.withColumn("issued", F.col("stop_seq").isNull() | (F.col("seq") <= F.col("stop_seq")))


def gaps(log: DataFrame, bucket_seconds: int = 3600, min_gap_ms: int = B["min_gap_ms"]) -> DataFrame:
    """Time since the previous request of the same host, and whether it was too short.

    Neighbours are found inside (host, time bucket); the first row of a bucket takes the last row of the latest
    earlier bucket, from a table with one row per bucket.
    """
    log = log.withColumn("started_at", F.col("started_at").cast("timestamp"))
    marked = log.withColumn("_bucket", F.floor(F.unix_micros("started_at") / (bucket_seconds * 1_000_000)))
    inside = Window.partitionBy("host", "_bucket").orderBy("started_at", "seq")
    rows = marked.withColumns({"_before": F.lag("started_at").over(inside), "_no": F.row_number().over(inside)})
    ends = marked.groupBy("host", "_bucket").agg(F.max("started_at").alias("_end"))
    carried = ends.select("host", "_bucket", F.lag("_end").over(Window.partitionBy("host").orderBy("_bucket")).alias("_carry"), F.lit(1).alias("_no"))
    joined = rows.join(carried, ["host", "_bucket", "_no"], "left")
    gap = (F.unix_micros("started_at") - F.unix_micros(F.coalesce("_before", "_carry"))) / 1000
    return joined.withColumn("gap_ms", gap).withColumn("too_fast", F.coalesce(F.col("gap_ms") < min_gap_ms, F.lit(False))).drop("_bucket", "_before", "_carry", "_no")


def usage(log: DataFrame, purposes: list[str]) -> DataFrame:
    return log.groupBy("site").agg(F.count(F.lit(1)).alias("requests"), *[F.count_if(F.col("purpose") == p).alias(p) for p in purposes])
