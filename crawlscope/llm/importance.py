"""Target-distribution importance resampling: array-scored weights, then a distributed quickselect.

Features are runs of words, hashed into buckets. Two passes over the corpus: the first counts every bucket, the second adds up each
document's weight from an array with one gain a bucket (how much likelier the bucket is in the target texts). Adding Gumbel noise
that depends on the id alone turns "the k highest scores" into a draw of k documents without replacement in proportion to their
weights. The k-th score is found by quickselect: a few random rows of the range still open are pivots, one aggregation counts
exactly how many rows are before, at and after each, and the range shrinks to the gap that holds the k-th key. Only winners are
sorted and numbered.

What is held at once: one count and one gain for each bucket (`buckets`, a parameter) and `pivots` keys. Nothing is gathered by
source, id or text, so no key is hot; texts are read twice and never shuffled. Keys end with a row number, so no two are equal.

Cases: null and empty texts and texts without words have no features, weight 0 and fewer than `least_words` words; a null id draws
its noise from the text "null" and comes after all others among equal scores; repeated rows each take part, and among equal scores and
ids the one with fewer features comes first; an empty corpus gives no rows, an empty target counts nothing and the gains follow from
the formula; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.llm.common import small_batches, written

#: Bytes as words see them: A-Z in lower case, all other ASCII signs but digits and letters blank.
SEEN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(SEEN).split()


class Buckets(dict):
    """The bucket of a word or run, kept while the table is small."""

    def __init__(self, buckets: int, limit: int = 500_000):
        super().__init__()
        self.buckets, self.limit = buckets, limit

    def __missing__(self, run: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[run] = bucket = zlib.crc32(run) % self.buckets
        return bucket

    def of(self, found: list[bytes], runs: tuple[int, int]) -> np.ndarray:
        """Buckets of all runs of `runs` (least, most) consecutive words, repeats counted."""
        out = []
        for n in range(runs[0], runs[1] + 1):
            every = found if n == 1 else [b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)]
            out.append(np.fromiter(map(self.__getitem__, every), np.int64, len(every)))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def bucket_counts(rows: DataFrame, runs: tuple[int, int], buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts: a task sends one row a bucket it met."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    total += np.bincount(seen.of(words(text), runs), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    met = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[met["bucket"].to_numpy(np.int64)] = met["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, one added to each count."""
    size, s_all, t_all = float(len(corpus)), float(corpus.sum()), float(target.sum())
    every = zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in every], dtype=np.int64)


def weighted(docs: DataFrame, table: np.ndarray, runs: tuple[int, int]) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(table), len(table)

    def weigh(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen, gain = Buckets(buckets), held.value
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found = words(text) if text else []
                met = seen.of(found, runs)
                out.append((len(found), len(met), int(gain[met].sum())))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A thousandfold Gumbel variate, rounded down, from a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def before(key: list[str], than: tuple) -> Column:
    """Whether a row's key comes before `than`, column by column."""
    steps = list(zip(map(F.col, key), map(F.lit, than), strict=True))
    return reduce(lambda rest, step: (step[0] < step[1]) | ((step[0] == step[1]) & rest), reversed(steps[:-1]), steps[-1][0] < steps[-1][1])


def at(key: list[str], than: tuple) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(key, than, strict=True)])


def kth_key(rows: DataFrame, key: list[str], k: int, pivots: int = 15) -> tuple:
    """The k-th smallest key (from 1) of a written table with at least k rows, its columns not null.

    Each turn draws up to `pivots` random keys of the open range and counts the rows before and at each of them; a turn leaves about one part
    in `pivots` of the range, so the number of turns grows with the logarithm of the rows.
    """
    low = high = None
    passed, turn = 0, 0  # passed: rows up to and with `low`
    while True:
        turn += 1
        left = rows if low is None else rows.filter(~before(key, low) & ~at(key, low))
        left = left if high is None else left.filter(before(key, high))
        drawn = left.select(*key).orderBy(F.xxhash64(F.lit(turn), *key)).limit(pivots).collect()
        tried = sorted({tuple(r) for r in drawn})
        if not tried:
            raise ValueError("fewer rows than the rank asked for")
        counted = left.agg(*[F.struct(F.count_if(before(key, p)), F.count_if(at(key, p))) for p in tried]).first()
        base = passed
        for pivot, (less, equal) in zip(tried, counted, strict=True):
            if k <= base + less:
                high = pivot
                break
            if k <= base + less + equal:
                return pivot
            low, passed = pivot, base + less + equal


def numbered(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Rows in order of a unique key with their number from 1: sorted ranges, then one offset a range (broadcast: a row for each partition)."""
    ranges = written(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id()), "winners")
    ranges = ranges.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    lower = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_first"))
    return ranges.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_first") + F.col("_at") + 1).drop("_part", "_at", "_first")


def resampled(
    docs: DataFrame, target: DataFrame, runs: tuple[int, int] = (1, 2), buckets: int = 10_000, share: int = 10, least_words: int = 20, seed: int = 2024, pivots: int = 15
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; `share` per cent of those with `least_words` words are drawn, the others' rank is null."""
    small_batches(docs.sparkSession)
    table = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    scored = weighted(docs, table, runs).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    keyed = {"_key": -F.col("score"), "_none": F.col("doc_id").isNull().cast("int"), "_id": F.coalesce("doc_id", F.lit(0)), "_row": F.monotonically_increasing_id()}
    scored = written(scored.withColumns(keyed), "importance")
    key, out = ["_key", "_none", "_id", "n_features", "_row"], ["doc_id", "n_words", "n_features", "weight", "score"]
    fit = scored.filter(F.col("n_words") >= least_words)
    k = fit.count() * share // 100
    if not k:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    last = kth_key(fit, key, k, pivots)
    wins = (F.col("n_words") >= least_words) & (before(key, last) | at(key, last))
    drawn = numbered(scored.filter(wins), key, "rank").select(*out, F.col("rank").cast("long"))
    return drawn.unionAll(scored.filter(~wins).select(*out, F.lit(None).cast("long").alias("rank")))
