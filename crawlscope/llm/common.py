"""What several operators share: written intermediate tables, prefix sums, a memoising tokenizer."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder the cluster names in spark.checkpoint.dir; a folder of our own only in a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Whole texts go to Python in batches of at most `rows`, for this session from here on: a batch of long texts must fit beside the others."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there and a lost executor costs nothing more.

    The shuffle files behind it are let go at once, as nothing reads them again.
    """
    spark, path, key = df.sparkSession, shared_folder(df.sparkSession, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def before(counts: DataFrame, keys: list[str], order: str, value: str, name: str, group: int = 4096) -> DataFrame:
    """Add `name`: the sum of `value` over the smaller `order` of the same keys, and `name`_all: the sum over all of them.

    `order` is a non-negative bucket number. Sums run in two levels, over `group` buckets at a time and over the groups, so no
    task sees all buckets of a key.
    """
    counts = counts.withColumn("_coarse", F.floor(F.col(order) / F.lit(group)))
    coarse = counts.groupBy(*keys, "_coarse").agg(F.sum(value).alias("_sum"))
    whole = Window.partitionBy(*keys)
    lower = whole.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select(
        *keys, "_coarse", F.coalesce(F.sum("_sum").over(lower), F.lit(0)).alias("_base"), F.sum("_sum").over(whole).alias(f"{name}_all")
    )
    inside = Window.partitionBy(*keys, "_coarse").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(coarse, [*keys, "_coarse"])
        .withColumn(name, F.col("_base") + F.col("_inside"))
        .drop("_coarse", "_base", "_inside")
    )


def floor_of(x: Column) -> Column:
    """Rounded down, as a double; doubles from 2**53 on are integers already."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def crc32(text: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes."""
    return F.crc32(text)


def remainder_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`: the folds of the label tables."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, most_chars: int) -> DataFrame:
    """doc_id, text, y of at most `most` labelled documents with at most `most_chars` characters together.

    They are the first in order of a hash of the id; texts over a 64th of `most_chars` come after all others, the shortest first, so
    that no text takes the place of many. The list of ids is bounded by `most`, so it may be broadcast, and one task may add up the
    lengths: it sees ids and lengths only, and the texts are joined to those that fit.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    lengths = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y", "_hash").agg(F.max(F.length("text")).alias("_one"), F.sum(F.length("text")).alias("_chars"))
    late = F.when(F.col("_one") > most_chars // 64, F.col("_one")).otherwise(0)
    first = Window.orderBy(late, F.xxhash64("doc_id"), "doc_id", "_one", "_hash").rowsBetween(Window.unboundedPreceding, 0)
    fit = lengths.withColumn("_sum", F.sum("_chars").over(first)).filter(F.col("_sum") <= most_chars).select("doc_id", "y", "_hash")
    return rows.join(F.broadcast(fit), ["doc_id", "_hash"]).select("doc_id", "text", "y").orderBy(F.xxhash64("doc_id"), "doc_id", F.length("text"), "text")


def series_udf(of_batches, kind: str = "double"):
    """A pandas UDF over an iterator of series, which keeps what it has learned from one batch to the next."""
    import pandas as pd

    of_batches.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(of_batches, kind)


#: ASCII signs that are neither letters, digits nor white space.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Letters of Latin-1.
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())


def latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class PieceEncoder:
    """The ids of a text by a public tokenizer, each different piece encoded once.

    Both supported pre-tokenizers never let a token cross a line break or the space before a word, so a text's ids are those of
    its pieces in turn; nor does a token join letters and the signs after them. Arrow divides the texts, numbers the different
    words and signs and strings their ids together, so Python sees each once per call. New words of letters go to the library's
    model as they stand, many to a call where no token of the vocabulary joins two; other new ones are sent together,
    with a separator whose id is known between them. Texts for which the rule isn't certain (runs of spaces or line breaks) go to
    the library whole. `kind` is "byte" for byte level BPE, where a word keeps its leading space, and "word" for BPE on lower-cased
    words without white space.
    """

    def __init__(self, path: str, kind: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.limit = Tokenizer.from_file(path), kind, limit
        self.model = self.tokenizer.model
        self.glue, self.mark = ("\n", "\n") if kind == "byte" else (" | ", "|")
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.mark_ids = self.whole(self.mark)
        plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # fixed values: bytes that byte level BPE writes as themselves
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        space, vocab, byte = self.letters[32], self.tokenizer.get_vocab(with_added_tokens=False), {c: b for b, c in self.letters.items()}
        across = [bytes(map(byte.__getitem__, t)).decode("utf-8", "replace") for t in vocab if space in t.lstrip(space)] if kind == "byte" else []
        self.together = kind == "byte" and all(set(t).difference(LETTERS, " \ufffd") for t in across)  # such tokens hold other signs, as no-break spaces
        self.starts_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.starts_word[[i for token, i in vocab.items() if token[0] == space]] = True
        self.memo: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def uncertain(self, texts):
        """Per text of an Arrow array, whether it goes to the library whole."""
        import pyarrow as pa
        import pyarrow.compute as pc

        return pa.array([False] * len(texts)) if self.kind == "word" else pc.match_substring_regex(texts, r"\A[ \n]|[ \n][ \n]|[ \n]\z|\t")

    def pieces(self, texts):
        """Byte kind: a piece is a word after a blank, or, with a line break before it, one that starts a line; the first word has a tab."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.kind == "word":
            lower = pc.if_else(pc.match_substring_regex(texts, r"[^\x00-\x{ff}]"), texts, pc.utf8_lower(texts))
            return pc.split_pattern(pc.replace_substring(lower, "\n", " "), " ")
        tab, none = (pa.scalar(x, texts.type) for x in ("\t", ""))
        return pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(tab, texts, none), "\n", " \n"), " ")

    def parted(self, pieces):
        """Of different pieces: which start a line, and the two texts to encode, a word with its space and the signs after it.

        A piece that isn't latin letters (which normalisation leaves alone but for their case) and signs is one text as it stands.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        space, none = (pa.scalar(x, pieces.type) for x in (" ", ""))
        lined = pc.starts_with(pieces, "\n")
        headed = pc.or_(lined, pc.starts_with(pieces, "\t")) if self.kind == "byte" else None
        body = pieces if headed is None else pc.if_else(headed, pc.utf8_slice_codeunits(pieces, 1), pieces)
        stem = pc.utf8_rtrim(body, SIGNS)
        plain = pc.and_(pc.not_equal(stem, none), pc.equal(pc.utf8_ltrim(stem, LETTERS), none))
        word, signs = pc.if_else(plain, stem, body), pc.utf8_ltrim(pc.if_else(plain, body, none), LETTERS)
        return lined, word if headed is None else pc.binary_join_element_wise(pc.if_else(headed, none, space), word, none), signs

    def spelled(self, words: str) -> str:
        """As the model spells them: a letter for each byte."""
        return words.replace(" ", self.letters[32]) if words.isascii() else words.encode().decode("latin-1").translate(self.letters)

    def of_words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of words of letters, all with a space before them or none."""
        import numpy as np

        tokenize, lower = self.model.tokenize, self.kind == "word"
        if not self.together or words[:1] and words[0][0] != " ":
            for w in words:
                yield np.array([t.id for t in tokenize(self.spelled(w.lower() if lower else w))], dtype="<u4").tobytes()
            return
        ids = np.array([t.id for i in range(0, len(words), 32) for t in tokenize(self.spelled("".join(words[i : i + 32])))], dtype="<u4")
        cuts, raw = [*(4 * np.flatnonzero(self.starts_word[ids])).tolist(), 4 * len(ids)], ids.tobytes()
        if len(cuts) != len(words) + 1:
            raise ValueError("a space met inside a token")
        yield from (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def learn(self, new: list[str]) -> None:
        import numpy as np

        known = self.memo
        parts: tuple[list[str], ...] = ([], [], [])  # words without a space before, with one, with one and letters beyond ASCII
        others = []
        for w in new:
            spaced = w[0] == " "
            if not (w[1:] if spaced else w).isalpha() or not latin(w):
                others.append(w)
            else:
                parts[(1 if w.isascii() else 2) if spaced else 0].append(w)
        for part in parts:
            known.update(zip(part, self.of_words(part), strict=True))
        rest = []
        for w in others:
            if self.mark in w or len(w.split()) != 1:
                known[w] = self.whole(w)
            else:
                rest.append(w)
        glued = [rest[i : i + 256] for i in range(0, len(rest), 256)]
        for part, got in zip(glued, self.tokenizer.encode_batch_fast([self.glue.join(p) for p in glued], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) != len(part) - 1:
                raise ValueError("the separator met inside a piece")
            raw, at = ids.tobytes(), 0
            for w, cut in zip(part, [*cuts.tolist(), len(ids)], strict=True):
                known[w] = raw[4 * at : 4 * cut]
                at = cut + 1

    def known(self, words: list[str]) -> list[bytes]:
        """The ids of different words and signs, new ones learned."""
        if len(self.memo) > self.limit:  # those met again move on from the older half, the others go
            self.older, self.memo = self.memo, {"": b""}
        memo, older = self.memo, self.older
        found = list(map(memo.get, words))
        missing = [w for w, ids in zip(words, found, strict=True) if ids is None]
        memo.update({w: older[w] for w in missing if w in older})
        self.learn([w for w in missing if w not in memo])
        return [memo[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def encoded(self, texts):
        """Little-endian unsigned 32-bit ids of each text of an Arrow array without nulls, as an array of large binaries."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        kind, texts = pa.large_binary(), texts.cast(pa.large_string())
        uncertain = self.uncertain(texts)
        alone = [self.whole(t) for t in texts.filter(uncertain).to_pylist()]
        if len(alone) == len(texts):
            return pa.array(alone, kind)
        lists = self.pieces(texts.filter(pc.invert(uncertain)) if alone else texts)
        numbered = lists.values.dictionary_encode()
        lined, *parts = self.parted(numbered.dictionary)
        words = pa.concat_arrays(parts).dictionary_encode()
        ids = pa.array(self.known(words.dictionary.to_numpy(zero_copy_only=False).tolist()), kind)
        n, mark, none = len(lined), pa.scalar(self.mark_ids if self.kind == "byte" else b"", kind), pa.scalar(b"", kind)
        ids = pc.binary_join_element_wise(pc.if_else(lined, mark, none), ids.take(words.indices[:n]), ids.take(words.indices[n:]), none)
        _, ends, raw = ids.take(numbered.indices).buffers()
        ends = np.frombuffer(ends, dtype=np.int64)[np.asarray(lists.offsets)]
        out = pa.Array.from_buffers(kind, len(lists), [None, pa.py_buffer(ends), raw or pa.py_buffer(b"")])
        if not alone:
            return out
        place = np.argsort(np.argsort(uncertain.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        return pa.concat_arrays([out, pa.array(alone, kind)]).take(pa.array(place))

    def encode(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa

        return self.encoded(pa.array(texts, pa.large_string())).to_pylist()


@lru_cache(maxsize=4)
def piece_encoder(path: str, kind: str, limit: int = 500_000) -> PieceEncoder:
    """One encoder for each worker process."""
    return PieceEncoder(path, kind, limit)


def slices(sizes: list[int], most: int):
    """Ranges of rows that hold about `most` bytes, at least one row each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
