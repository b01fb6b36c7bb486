"""Exact top-k inner products by pivot-table elimination.

The distances of every vector to many pivots are computed once and stored. By the triangle inequality the largest difference of a
query's and a candidate's distances to the same pivot is a lower bound of their distance, hence an upper bound of their inner
product. Candidates are evaluated in order of that bound until the k-th best score is above all bounds left; the result is exact.

The query set meets all vectors in blocks: a task holds a block of queries and a block of candidates and returns k rows a query.

Cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; shorter vectors count as
padded with zeros; products with a vector whose squared length reaches 2**50 are summed in Python integers, and scores beyond a long count as the nearest long; a query never meets rows of its own id; rows that share an id are each candidates, and the query of that id is the
smallest of its vectors; equal scores go to smaller ids; fewer than k others give all of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.llm.common import written

#: Rounding of distances and bounds, as a share of the squared lengths.
SLACK = 1e-9
#: Squared lengths below which every inner product is an exact double.
WIDE = float(1 << 50)


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part."""
    v = rows[vector_column].cast("array<double>")
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return rows.select(rows[id_column].cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & finite)


def padded(vectors, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.nan_to_num(np.maximum(squares, 0)))


def spread(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots: each is the sample's vector farthest from those before it."""
    if not len(sample):
        return sample
    chosen, nearest = [0], distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def exact(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size, then as longs."""
    q = [int(c) for c in query.tolist()]
    sums = [sum(int(a) * b for a, b in zip(row, q, strict=True)) for row in x.tolist()]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in sums], dtype=np.int64)


def best(query: np.ndarray, own: int, to_pivots: np.ndarray, ids: np.ndarray, x: np.ndarray, table: np.ndarray, squares: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (id, score) of one query in a block, ties to smaller ids."""
    length = float(query @ query)
    low = np.abs(table - to_pivots).max(1) if table.shape[1] else np.zeros(len(x))
    scale = squares + length
    bound = (scale - low * low) / 2 + SLACK * scale * len(query) + 1e-6
    wide = ~(squares < WIDE) | (not length < WIDE)  # no bounds for these: all are evaluated
    bound[wide] = np.inf
    bound[ids == own] = -np.inf
    top, batch = [], 64
    left = np.arange(len(x))
    while len(left):
        if len(top) == k:
            left = left[bound[left] >= top[-1][0]]  # exact stop: what is left can't reach the k-th
        part = left if len(left) <= batch else left[np.argpartition(-bound[left], batch)[:batch]]
        part = part[bound[part] > -np.inf]
        if not len(part):
            break
        scores = np.zeros(len(part), np.int64)
        plain = ~wide[part]
        scores[plain] = np.rint(x[part[plain]] @ query)
        scores[~plain] = exact(x[part[~plain]], query)
        keep = np.lexsort((ids[part], ~scores))[:k]
        top = sorted([*top, *((int(scores[i]), int(ids[part[i]])) for i in keep)], key=lambda s: (-s[0], s[1]))[:k]
        left = np.setdiff1d(left, part, assume_unique=True)
        batch *= 4
    return [(i, s) for s, i in top]


def nearest(
    rows: DataFrame, is_query, id_column: str = "vec_id", vector_column: str = "embedding", transform=None, k: int = 5, pivots: int = 32, sample: int = 2048,
    query_block: int = 2048, candidate_block: int = 8192,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of every row whose id satisfies `is_query` (a function of a column).

    `transform` turns a component into the integer that is compared (none: components are integers already). Pivots are chosen from
    at most `sample` rows.
    """
    spark = rows.sparkSession
    clean = usable(rows, id_column, vector_column)
    if transform is not None:
        clean = clean.withColumn("v", F.transform("v", transform)).filter(F.forall("v", lambda x: F.abs(x) < float("inf")))
    clean = written(clean, "pivot-vectors")
    facts = clean.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("size")).first()
    count, size = facts["n"], facts["size"] or 0
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    first = clean.filter(square < WIDE).orderBy(F.xxhash64("id"), "id", "v").limit(sample).select("v").toPandas()["v"]
    held = spark.sparkContext.broadcast(spread(padded(list(first), size), pivots))

    def measure(batches: Iterator) -> Iterator:
        for batch in batches:
            x = padded(list(batch["v"]), size)
            batch["x"] = [r.tobytes() for r in x]
            batch["d"] = [r.tobytes() for r in distances(x, held.value)]
            yield batch[["id", "x", "d"]]

    table = written(clean.mapInPandas(measure, "id long, x binary, d binary"), "pivot-table")
    asked = table.filter(is_query(F.col("id"))).groupBy("id").agg(F.min(F.struct("x", "d")).alias("_q")).select("id", "_q.*")
    parts = max(1, -(-count // candidate_block))
    sets = max(1, -(-asked.count() // query_block))
    block = lambda n: F.pmod(F.xxhash64("id", "x"), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("q", block(sets)).withColumn("c", copies(parts))
    right = table.withColumn("c", block(parts)).withColumn("q", copies(sets))

    def search(queries, candidates):
        import pandas as pd

        out = []
        if len(queries) and len(candidates):
            unpack = lambda c: np.frombuffer(b"".join(c), dtype=np.float64).reshape(len(c), -1)
            ids, x, d = candidates["id"].to_numpy(), unpack(candidates["x"]), unpack(candidates["d"])
            squares = (x * x).sum(1)
            for own, v, p in zip(queries["id"].tolist(), unpack(queries["x"]), unpack(queries["d"]), strict=True):
                out += [(own, i, s) for i, s in best(v, own, p, ids, x, d, squares, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
