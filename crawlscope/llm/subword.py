"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors: one for each word, each character n-gram of a word and each pair of neighbouring
words, hashed into buckets; two softmax outputs follow. Vectors and outputs are trained by numpy stochastic gradient descent on a
bounded sample of labelled documents. Since the average is linear, a bucket's share in the score is one number: the score of a
document sums these over its words, whose sums are kept by word, and its word pairs.

Cases: a null or empty text has no features and scores by the output bias alone; repeated rows score alike; null labels and labels
of unknown documents are not used; several labels of a document count as their maximum; an empty table gives no rows; without
labels of both classes fitting raises ValueError; other columns pass through `scored` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import labelled_sample, series_udf, slices, small_batches

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Shape:
    """Hashing of features: number of buckets (two to the power of `bits`), lengths of the character n-grams."""

    bits: int = 17
    shortest: int = 3
    longest: int = 5

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(29))) * M2 >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, ids: np.ndarray) -> np.ndarray:
        """Buckets of neighbouring words, from the words' hashes; a repeated word is one feature whatever the word."""
        a, b = ids[:-1], ids[1:]
        return np.where(a == b, 0, self.bucket(a * M1 + (b ^ (b >> np.uint64(31)))))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of different words: hashes; then the buckets of all their features and the word each belongs to."""
        raw = [f"<{w}>" for w in words]
        sizes = np.array([len(x) for x in raw])
        codes = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(raw)), sizes)
        powers = np.cumprod(np.full(sizes.max(), M1, dtype=np.uint64), dtype=np.uint64)
        ids = np.add.reduceat(codes * powers[np.arange(len(codes)) - starts[owner]], starts)
        buckets, owners = [self.bucket(ids)], [np.arange(len(raw))]
        for n in range(self.shortest, self.longest + 1):
            last = len(codes) - n + 1
            if last > 0:
                inside = np.flatnonzero(owner[:last] == owner[n - 1 :])
                gram = np.full(len(inside), n, dtype=np.uint64)
                for j in range(n):
                    gram = gram * M1 + codes[inside + j]
                buckets.append(self.bucket(gram))
                owners.append(owner[inside])
        return ids, np.concatenate(buckets), np.concatenate(owners)


class Words:
    """What is known of words met so far: number, hash, sum of shares, number of features, and for training the buckets."""

    def __init__(self, shape: Shape, share: np.ndarray | None = None, limit: int = 200_000):
        self.shape, self.share, self.limit = shape, share, limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.sums, self.sizes = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
        self.buckets: list[np.ndarray] = []

    def split(self, texts: list[str]) -> list[list[str]]:
        """The texts' words, all of them known afterwards."""
        found = [t.split() for t in texts]
        if len(self.number) > self.limit:
            self.clear()
        new = list(set().union(*found).difference(self.number))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            ids, buckets, owner = self.shape.words(part)
            self.number.update(zip(part, range(len(self.ids), len(self.ids) + len(part)), strict=True))
            self.ids = np.concatenate([self.ids, ids])
            sizes = np.bincount(owner, minlength=len(part))
            self.sizes = np.concatenate([self.sizes, sizes])
            if self.share is None:
                self.buckets += np.split(buckets[np.argsort(owner, kind="stable")], np.cumsum(sizes)[:-1])
            else:
                self.sums = np.concatenate([self.sums, np.bincount(owner, weights=self.share[buckets], minlength=len(part))])
        return found

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))


def features(texts: list[str], words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different buckets of each text and the share of its features in each."""
    for found in words.split(texts):
        at = words.numbers(found)
        own = [words.buckets[i] for i in at.tolist()]
        counts = np.bincount(np.concatenate([*own, words.shape.pairs(words.ids[at])])) if own else np.zeros(0, np.int64)
        buckets = np.flatnonzero(counts)
        yield buckets.astype(np.int32), (counts[buckets] / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    """share: a bucket's part in the difference of the two outputs; bias: that difference for no features."""

    shape: Shape
    share: np.ndarray
    bias: float

    def scores(self, texts: list[str], words: Words) -> np.ndarray:
        """Probability of label 1. `words` was made with this model's shape and shares."""
        z = []
        for found in words.split(texts):
            at = words.numbers(found)
            pairs = self.shape.pairs(words.ids[at])
            total = words.sums[at].sum() + self.share[pairs].sum(dtype=np.float64)
            z.append(self.bias + total / max(1, int(words.sizes[at].sum()) + len(pairs)))
        return 1 / (1 + np.exp(-np.clip(np.array(z, dtype=np.float64), -60, 60)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], shape: Shape, size: int = 10, epochs: int = 8, rate: float = 1.0, seed: int = 0) -> Model:
    """Stochastic gradient descent over (buckets, shares, label) rows; the rate falls to zero in a line."""
    if len({y for *_, y in rows}) < 2:
        raise ValueError("labels of both classes are needed")
    dice = np.random.default_rng(seed)
    vectors = dice.uniform(-1 / size, 1 / size, (1 << shape.bits, size)).astype(np.float32)
    output, bias = np.zeros((2, size), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in dice.permutation(len(rows)):
            buckets, w, y = rows[i]
            own = vectors[buckets]
            hidden = w @ own if len(w) else np.zeros(size, dtype=np.float32)
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            now = rate * (1 - step / steps)
            step += 1
            back = p @ output
            output -= now * np.outer(p, hidden)
            bias -= 0.1 * now * p
            if len(w):
                scaled = w * (now * len(w) ** 0.5)  # larger texts spread their gradient over more vectors
                vectors[buckets] = own - scaled[:, None] * back
    return Model(shape, (vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, most: int = 2500, most_chars: int = 1 << 24, shape: Shape = Shape(), **settings) -> Model:
    """Train on at most `most` labelled documents (whole texts, `most_chars` together); features are counted by the executors."""

    def count(batches: Iterator) -> Iterator:
        import pandas as pd

        words = Words(shape)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in slices([len(t) for t in texts], 1 << 20):
                got = list(features(texts[a:b], words))
                yield pd.DataFrame({"doc_id": batch["doc_id"][a:b], "y": batch["y"][a:b], "buckets": [g[0].tobytes() for g in got], "weights": [g[1].tobytes() for g in got]})

    small_batches(docs.sparkSession)
    usable = F.lit(True) if usable is None else usable
    rows = labelled_sample(docs, labels, label, usable, most, most_chars).mapInPandas(count, "doc_id long, y int, buckets binary, weights binary").toPandas()
    rows = rows.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    bags = [(np.frombuffer(b, np.int32), np.frombuffer(w, np.float32), int(y)) for b, w, y in zip(rows["buckets"], rows["weights"], rows["y"], strict=True)]
    return train(bags, shape, **settings)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with the probability of label 1. The model has one number per bucket and travels with the tasks."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        import pandas as pd

        model = held.value
        words = Words(model.shape, model.share)
        for batch in batches:
            texts = [t or "" for t in batch]
            parts = [model.scores(texts[a:b], words) for a, b in slices([len(t) for t in texts], 1 << 20)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, series_udf(score)(docs["text"]))
