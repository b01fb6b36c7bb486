"""Hard negatives by Kronecker-packed products.

Components are integers. The j-th components of many candidates, made non-negative by a bias, stand side by side in fields of one
wide integer; a field holds the largest sum that can occur. An anchor's scores with all of these candidates then take one
multiplication for each of its components: the products add up inside their fields, and taking the biases off again leaves the
exact inner products. Components and sums may be of any size, as the integers are as wide as needed.

Anchors (a stated set) meet all rows in blocks of about `block_bytes` each, laid out as a grid; a cell holds a block of anchors and one of rows.
Rows are copied once for each block of anchors; a block of anchors costs each copied row some ten thousand inner products, so moving
rows stays a small part of the work at any size. Blocks are chosen by a hash of the row, so one label may hold all rows. The first
turn over the grid multiplies within labels and leaves each anchor's positives; the second multiplies with all and keeps the first few
negatives for each positive. A cell returns at most k rows an anchor or positive, so nothing is gathered without a bound.

Cases: rows without id or label, null vectors and vectors with a null or non-finite component (or multiple) take no part; shorter
vectors count as padded with zeros; rows that share an id are each candidates, the anchor of that id is the smallest of its labels
and vectors, and an anchor never meets rows of its own id; equal scores go to smaller ids; scores beyond a long count as the
nearest long; an anchor without positives, and a positive without fitting negatives, give no rows; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from operator import mul

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.llm.common import floor_of, written

#: Components from here on are packed as Python integers, below as 64-bit ones.
WIDE = 1 << 30
LONG = (-(1 << 63), (1 << 63) - 1)


def usable(rows: DataFrame, label: Column, transform: Callable, id_column: str, vector_column: str) -> DataFrame:
    """id, label and vector (integers as doubles) of the rows that take part."""
    finite = lambda v: F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    some = rows.select(rows[id_column].cast("long").alias("id"), label.cast("long").alias("label"), rows[vector_column].cast("array<double>").alias("v"))
    some = some.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v"))).withColumn("v", F.transform("v", transform))
    return some.filter(finite(F.col("v")))


def matrix(vectors, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def whole(x: np.ndarray) -> np.ndarray:
    """As 64-bit integers, or as Python integers where a component is wide."""
    if not x.size or np.abs(x).max() < WIDE:
        return x.astype(np.int64)
    return np.array([[int(c) for c in row] for row in x.tolist()], dtype=object)


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


class Pack:
    """Candidates side by side: one wide integer for each component."""

    def __init__(self, x: np.ndarray, most: int):
        """`most` is the largest absolute component of any anchor."""
        self.count, self.size = x.shape
        self.most, self.bias = max(1, most), max(1, largest(x))
        self.width = -(-(self.size * 2 * self.most * 2 * self.bias + 1).bit_length() // 8)  # bytes of a field
        if x.dtype == np.int64 and self.width <= 8:
            fields = (x + self.bias).astype("<u8").view(np.uint8).reshape(self.count, self.size, 8)
            columns = [fields[:, j, : self.width].tobytes() for j in range(self.size)]
        else:
            columns = [b"".join((int(c) + self.bias).to_bytes(self.width, "little") for c in column) for column in x.T.tolist()]
        self.wide = [int.from_bytes(c, "little") for c in columns]
        self.sums = [sum(map(int, row)) for row in x.tolist()] if x.dtype == object else x.sum(1).tolist()

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner products with every candidate: exact, or the nearest 64-bit integer."""
        raw = sum(map(mul, [a + self.most for a in anchor], self.wide)).to_bytes(self.count * self.width, "little")
        over = self.bias * sum(anchor) + self.size * self.most * self.bias
        if self.width <= 8:  # the result is within 2**62, so sums may wrap around at 2**64
            fields = np.zeros((self.count, 8), np.uint8)
            fields[:, : self.width] = np.frombuffer(raw, np.uint8).reshape(self.count, self.width)
            taken = np.array(self.sums, np.int64).view(np.uint64) * np.uint64(self.most) + np.uint64(over % (1 << 64))
            return (fields.view("<u8")[:, 0] - taken).view(np.int64)
        each = (int.from_bytes(raw[i : i + self.width], "little") for i in range(0, len(raw), self.width))
        exact = [f - over - self.most * s for f, s in zip(each, self.sums, strict=True)]
        return np.array([min(max(s, LONG[0]), LONG[1]) for s in exact], dtype=np.int64)


class Packed:
    """Rows of a cell, packed by `fields` at a time; wide ones apart, so that they widen no other's fields."""

    def __init__(self, x: np.ndarray, most: int, fields: int):
        wide = np.abs(x).max(1, initial=0) >= WIDE
        self.count, self.packs = len(x), []
        for rows in (np.flatnonzero(~wide), np.flatnonzero(wide)):
            for i in range(0, len(rows), fields):
                part = rows[i : i + fields]
                self.packs.append((part, Pack(whole(x[part]), most)))

    def scores(self, anchor: list[int]) -> np.ndarray:
        out = np.zeros(self.count, np.int64)
        for part, pack in self.packs:
            out[part] = pack.scores(anchor)
        return out


def products(anchors: np.ndarray, x: np.ndarray, fields: int):
    """(number of the anchor, its scores with all rows of x); anchors with wide components use packs of their own."""
    wide = np.abs(anchors).max(1, initial=0) >= WIDE
    for own in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        if len(own):
            integers = whole(anchors[own])
            packed = Packed(x, largest(integers), fields)
            for i, anchor in zip(own.tolist(), integers.tolist(), strict=True):
                yield i, packed.scores(anchor)


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    some = np.arange(len(ids))
    if len(ids) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(ids) - k)[len(ids) - k])
    return some[np.lexsort((ids[some], ~scores[some]))[:k]]  # ~s falls as s rises, for every long


def grid(anchors: DataFrame, rows: DataFrame, sets: int, parts: int, work: Callable, schema: str) -> DataFrame:
    """Apply `work` (anchor frame, row frame -> rows) to every block of anchors with every block of rows."""
    names = [x.split()[0] for x in schema.split(", ")]
    block = lambda n: F.pmod(F.xxhash64("id", "label", "v"), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def cell(left, right):
        import pandas as pd

        return pd.DataFrame(work(left, right) if len(left) and len(right) else [], columns=names)

    left = anchors.withColumn("_q", block(sets)).withColumn("_c", copies(parts)).groupBy("_q", "_c")
    return left.cogroup(rows.withColumn("_c", block(parts)).withColumn("_q", copies(sets)).groupBy("_q", "_c")).applyInPandas(cell, schema)


def mined(
    rows: DataFrame, is_anchor: Callable, label: Column, transform: Callable = floor_of, positives: int = 5, negatives: int = 5, share: int = 80, id_column: str = "vec_id",
    vector_column: str = "embedding", fields: int = 2048, block_bytes: int = 8 << 20,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of every row whose id satisfies `is_anchor` (a function of a column), the first `positives` other rows of its label; for each of them, the first
    `negatives` rows of other labels with share * positive_score <= 100 * negative_score <= 100 * positive_score. `transform` makes
    integers of components; `fields` candidates are packed together.
    """
    clean = written(usable(rows, label, transform, id_column, vector_column), "mined-vectors")
    facts = clean.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("size")).first()
    count, size = facts["n"], facts["size"] or 0
    anchors = clean.filter(is_anchor(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "v")).alias("_a")).select("id", "_a.*")
    anchors = written(anchors, "mined-anchors")
    held = max(1, block_bytes // (8 * max(size, 1)))
    sets, parts = max(1, -(-anchors.count() // held)), max(1, -(-count // held))

    def same(left, right) -> list[tuple]:
        out, groups = [], right.groupby("label").indices
        for own, ours in left.groupby("label").indices.items():
            theirs = groups.get(own)
            if theirs is None:
                continue
            ids, anchor_ids = right["id"].to_numpy()[theirs], left["id"].to_numpy()[ours].tolist()
            x = matrix(right["v"].iloc[theirs], size)
            for i, scores in products(matrix(left["v"].iloc[ours], size), x, fields):
                others = np.flatnonzero(ids != anchor_ids[i])
                best = others[first(ids[others], scores[others], positives)]
                out += [(anchor_ids[i], int(a), int(s)) for a, s in zip(ids[best], scores[best], strict=True)]
        return out

    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = grid(anchors, clean, sets, parts, same, "anchor_id long, positive_id long, positive_score long")
    near = written(near.withColumn("_p", F.row_number().over(order)).filter(F.col("_p") <= positives), "mined-positives")
    asked = near.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_set("positive_score")).alias("bars"))  # at most `positives`
    asked = anchors.join(asked, "id")

    def other(left, right) -> list[tuple]:
        out, ids, labels = [], right["id"].to_numpy(), right["label"].to_numpy()
        anchor_ids, anchor_labels, bars = left["id"].tolist(), left["label"].tolist(), left["bars"].tolist()
        for i, scores in products(matrix(left["v"], size), matrix(right["v"], size), fields):
            fit = (labels != anchor_labels[i]) & (ids != anchor_ids[i])
            for bar in map(int, bars[i]):
                low = -(-share * bar // 100)
                some = np.flatnonzero(fit & (scores >= low) & (scores <= bar)) if low <= bar else []
                if len(some):
                    best = some[first(ids[some], scores[some], negatives)]
                    out += [(anchor_ids[i], bar, int(a), int(s)) for a, s in zip(ids[best], scores[best], strict=True)]
        return out

    found = grid(asked, clean, sets, parts, other, "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return near.join(found, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
