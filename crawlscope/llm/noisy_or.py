"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from the weights of its words and their character n-grams; the document's is their noisy-or:
one minus the chance that no sentence offends. Weights are trained through the noisy-or from document labels alone, on a bounded
sample; afterwards the sentence probabilities tell where a text offends.

A long text has many sentences, and a small chance from each would add up to a large one from length alone. So sentences of a text with more
than `crowd` of them (the 95th percentile of the sample's clean texts) are judged as if their odds were spread over it: each one's logit falls
by ln(sentences / crowd), and clean sentences in any number score like `crowd` of them. Lines and sentences without a word count for nothing.

Cases: a null or empty text, or one without words, has one empty sentence and scores by the bias alone; repeated rows score alike; null labels and labels
of unknown documents are not used; several labels of a document count as their maximum; an empty table gives no rows; without
labels of both classes fitting raises ValueError; other columns pass through `scored` untouched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import labelled_sample, series_udf, slices, small_batches
from crawlscope.llm.subword import Shape

EDGE = re.compile(r"^\W+|\W+$")
STOPS = ".!?"
BREAK = re.compile(r"[^\S\n]*\n\s*")
LONE = re.compile(r"(?:^|\s+)(?=[.!?]+(?:\s|$))")
SENTENCE = re.compile(r"[^\n]+?(?:[.!?](?=\s|$)|(?=\n)|$)")


def bare(token: str) -> str:
    return EDGE.sub("", token.lower())


def tokens(text: str) -> list[str]:
    """White-space tokens; a line break ends a sentence as a full stop does, and lone stops belong to the word before."""
    if "\n" in text:
        text = BREAK.sub(". ", text)
    if LONE.search(text):
        text = LONE.sub("", text)
        return [t for t in text.split() if t.strip(STOPS)]
    return text.split()


def crowding(sentences: int, crowd: float) -> float:
    return math.log(max(1.0, sentences / crowd))


@dataclass
class Model:
    """Weights of hashed words and character n-grams (see subword.Shape), the bias of a sentence, and the sentences that make a crowd."""

    shape: Shape
    weights: np.ndarray
    bias: float
    crowd: float = math.inf

    def logits(self, words: list[str]) -> np.ndarray:
        """The sum of the weights of each word's features."""
        _, buckets, owner = self.shape.words([bare(w) for w in words])
        return np.bincount(owner, weights=self.weights[buckets], minlength=len(words))

    def offending(self, text: str, least: float) -> list[tuple[int, int, float]]:
        """Start, end and probability of the sentences of at least `least`."""
        found = [(m, sorted(set(tokens(m.group() + text[m.end() : m.end() + 1])))) for m in SENTENCE.finditer(text)]
        found, out = [(m, words) for m, words in found if words], []
        for m, words in found:
            z = self.bias + float(self.logits(words).sum()) - crowding(len(found), self.crowd)
            if (p := 1 / (1 + np.exp(-z))) >= least:
                out.append((m.start(), m.end(), float(p)))
        return out


class Reader:
    """Scores texts; what tokens weigh is kept by token."""

    def __init__(self, model: Model, limit: int = 400_000):
        self.model, self.limit, self.codes, self.values = model, limit, {}, np.zeros(1)

    def scores(self, texts: list[str]) -> np.ndarray:
        found = [tokens(t) for t in texts]
        if len(self.codes) > self.limit:
            self.codes, self.values = {}, np.zeros(1)
        new = list(set().union(*found).difference(self.codes))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for n, t in enumerate(part, len(self.values)):
                self.codes[t] = -n if t[-1] in STOPS else n  # negative: it ends a sentence
            self.values = np.concatenate([self.values, self.model.logits(part)])
        return np.array([self.score(words) for words in found])

    def score(self, words: list[str]) -> float:
        bias = self.model.bias
        if not words:
            return float(-np.expm1(-np.logaddexp(0, bias)))
        at, sentence = placed(words, self.codes)
        n = int(sentence[-1]) + 1
        z = bias + np.bincount(sentence, weights=self.values[at], minlength=n) - crowding(n, self.model.crowd)
        return float(-np.expm1(-np.logaddexp(0, z).sum()))


def placed(words: list[str], codes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The different tokens of each sentence: token number and sentence, in order of the sentences."""
    at = np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words))
    ends = at < 0
    sentence = np.cumsum(ends) - ends
    both = np.unique(sentence << 32 | np.abs(at))
    return both & 0xFFFFFFFF, both >> 32


def train(rows: list[tuple[str, int]], shape: Shape = Shape(18, 5, 5), rare: int = 5, epochs: int = 8, rate: float = 0.5, shrink: float = 0.15, seed: int = 0) -> Model:
    """Adaptive gradient steps document by document through the noisy-or.

    Features in fewer than `rare` documents have no weight; the end of each epoch draws weights towards zero by `shrink`.
    """
    if len({y for _, y in rows}) < 2:
        raise ValueError("labels of both classes are needed")
    codes: dict[str, int] = {}
    words = [tokens(t) for t, _ in rows]
    for t in sorted(set().union(*words)):
        codes[t] = -len(codes) - 1 if t[-1] in STOPS else len(codes) + 1
    features: list[np.ndarray] = [np.zeros(0, np.int64)]
    names = list(codes)
    for i in range(0, len(names), 20_000):
        part = [bare(t) for t in names[i : i + 20_000]]
        _, buckets, owner = shape.words(part)
        features += np.split(buckets[np.argsort(owner, kind="stable")], np.cumsum(np.bincount(owner, minlength=len(part)))[:-1])
    bags, seen = [], np.zeros(1 << shape.bits, np.int64)
    for found, (_, y) in zip(words, rows, strict=True):
        at, sentence = placed(found, codes) if found else (np.zeros(0, np.int64),) * 2
        own, token = np.unique(at, return_inverse=True)
        flat = np.concatenate([features[0], *(features[i] for i in own.tolist())])
        sizes = [len(features[i]) for i in own.tolist()]
        some, bucket = np.unique(flat, return_inverse=True)
        seen[some] += 1
        bags.append((some.astype(np.int32), bucket.astype(np.int32), np.repeat(np.arange(len(own), dtype=np.int32), sizes), token.astype(np.int32), sentence.astype(np.int32), int(sentence[-1]) + 1 if found else 1, y))
    use = seen >= rare
    w, past, bias, past_bias = np.zeros(1 << shape.bits), np.full(1 << shape.bits, 1e-2), -5.0, 1.0
    dice = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in dice.permutation(len(bags)):
            some, bucket, owner, token, sentence, n, y = bags[i]
            by_token = np.bincount(owner, weights=w[some][bucket], minlength=1)
            z = bias + np.bincount(sentence, weights=by_token[token], minlength=n)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            if y:
                any_one = max(-np.expm1(-np.logaddexp(0, z).sum()), 1e-12)
                p = -p * (1 - any_one) / any_one
            back = np.bincount(token, weights=p[sentence], minlength=1)
            g = np.bincount(bucket, weights=back[owner], minlength=len(some)) * use[some]
            past[some] += g * g
            w[some] -= rate * g / np.sqrt(past[some])
            past_bias += p.sum() ** 2
            bias -= rate * p.sum() / np.sqrt(past_bias)
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
    return Model(shape, w, float(bias), max(1.0, float(np.quantile([n for *_, n, y in bags if not y], 0.95))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", usable: Column | None = None, most: int = 4000, most_chars: int = 1 << 26, **settings) -> Model:
    """Train on at most `most` labelled documents (whole texts, `most_chars` together)."""
    rows = labelled_sample(docs, labels, label, F.lit(True) if usable is None else usable, most, most_chars).toPandas()
    rows = rows.sort_values(["doc_id", "text"], kind="stable").drop_duplicates("doc_id")
    return train([(t, int(y)) for t, y in zip(rows["text"], rows["y"], strict=True)], **settings)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with the probability that a text offends. The model has one weight per bucket."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        import pandas as pd

        reader = Reader(held.value)
        for batch in batches:
            texts = [t or "" for t in batch]
            parts = [reader.scores(texts[a:b]) for a, b in slices([len(t) for t in texts], 1 << 20)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, series_udf(score)(docs["text"]))


def offending_in(docs: DataFrame, model: Model, name: str = "offending", score: str = "score", least: float = 0.5) -> DataFrame:
    """`docs` with the places of the worst sentences of texts whose score is `least` or more: start, length (characters) and probability; else none.

    Sentences of at least `least` are named; where only several together reach it, the most probable ones.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches):
        import pandas as pd

        model = held.value
        for batch in batches:
            out = []
            for text in batch:
                places = model.offending(text, least) or model.offending(text, 0.0) if text else []
                top = max((p for *_, p in places), default=0.0)
                out.append([{"start": s, "length": e - s, "probability": p} for s, e, p in places if p >= min(least, top)])
            yield pd.Series(out)

    text = F.when(F.col(score) >= least, docs["text"])
    return docs.withColumn(name, series_udf(find, "array<struct<start:long,length:long,probability:double>>")(text))


def located(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The sentences of at least `least`: doc_id, start (characters), sentence, probability."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for a, b in slices([len(t) for t in batch["text"]], 1 << 22):
                rows = [(i, s, t[s:e], p) for i, t in zip(batch["doc_id"][a:b], batch["text"][a:b], strict=True) for s, e, p in held.value.offending(t, least)]
                yield pd.DataFrame(rows, columns=["doc_id", "start", "sentence", "probability"])

    return docs.select(docs["doc_id"], F.coalesce("text", F.lit("")).alias("text")).mapInPandas(find, "doc_id long, start long, sentence string, probability double")
