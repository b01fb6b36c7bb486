"""Near duplicates by a chosen-path set similarity join.

A document's set holds its different five-word shingles. Documents with equal sets are one class from the start. Every class has a
sketch of minwise tokens; independent trees branch all classes again and again by the values of tokens that the path chooses, with as
many branches as keep two sets at the threshold together once on average. A node of few classes is compared exhaustively: pairs
that the sketches allow form clusters, and each different cluster is confirmed once on the full sets of its texts. Confirmed links are
joined to components by star contraction.

Nodes are counted and their members joined by node, so large groups never meet in one task. A node that is still large after the
last round is compared in pairs of blocks, which is exact too. Recall: a link at the threshold is together in a tree with
probability 0.85 if its node is small after one step and about a half after many, so twelve trees miss less than one in ten
thousand; pairs whose sketches agree less than 4.5 standard deviations below the threshold's mean are not confirmed.

Cases: null and empty texts and texts without words have an empty set and are linked with nothing; fewer words than a shingle
make one shingle; sets are linked, not ids, so each row of a repeated id goes by its own text; a null id is never a representative,
and rows without an id get the smallest id of their component, or null if no row of it has one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import small_batches, written

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    x = (x ^ (x >> np.uint64(29))) * M3
    return x ^ (x >> np.uint64(32))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted different shingle hashes; only A-Z are lower-cased, and words end at ASCII white space."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(width, len(h))
    rolled = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        rolled = mixed(rolled * M1 + h[j : len(h) - n + 1 + j])
    return np.unique(rolled)


def sketch(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each factor the least value of the hashed set, the upper 31 bits."""
    least = np.full(len(factors), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(found), 1024):
        least = np.minimum(least, (mixed(found[i : i + 1024])[:, None] * factors[None]).min(0))
    return (least >> np.uint64(33)).astype(np.int32)


def factors(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 62, (1 << 64) - 1, count, dtype=np.uint64) | np.uint64(1)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and text: rows of equal id and text are alike in all that follows."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"), docs["text"].alias("text"))


def sketched(docs: DataFrame, width: int, tokens: int, seed: int) -> DataFrame:
    """doc_id, text_hash, n (set size), two hashes of the set and its sketch."""
    own = factors(tokens, seed)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pandas(), batch.column("text").to_pylist()
            rows = []
            for t in texts:
                s = shingles(t or "", width)
                m = mixed(s * M3)
                rows.append((len(s), int(np.bitwise_xor.reduce(m).view(np.int64)) if len(s) else 0, int(m.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0, sketch(s, own) if len(s) else None))
            import pyarrow as pa

            frame = pd.DataFrame(rows, columns=["n", "a", "b", "sig"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(frame["n"], pa.int64()), pa.array(frame["a"], pa.int64()), pa.array(frame["b"], pa.int64()), pa.array(list(frame["sig"]), pa.list_(pa.int32()))], names=["doc_id", "text_hash", "n", "a", "b", "sig"])
            del ids

    return keyed(docs).mapInArrow(run, "doc_id long, text_hash long, n long, a long, b long, sig array<int>")


def by_group(df: DataFrame, key: str, parts: int, work: Callable, schema: str) -> DataFrame:
    """Apply `work` (key, frame -> rows) to the rows of each key. Keys come in order from sorted partitions, so a task holds one group at a time."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [x.split()[0] for x in schema.split(", ")]
        held, out = [], []

        def close() -> None:
            if held:
                frame = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                out.extend(work(frame[key].iloc[0], frame))
                held.clear()

        for batch in batches:
            keys = batch[key].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    if held and held[0][key].iloc[0] != keys[a]:
                        close()
                    held.append(batch.iloc[a:b])
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        close()
        yield pd.DataFrame(out, columns=names)

    return df.repartition(parts, key).sortWithinPartitions(key).mapInPandas(run, schema)


def agreeing(sig: np.ndarray, n: np.ndarray, least: int, share: int) -> np.ndarray:
    """Which pairs' sketches agree in at least `least` tokens and whose sizes allow the threshold; -1 for the others."""
    equal = np.zeros((len(sig), len(sig)), dtype=np.int16)
    for c in range(sig.shape[1]):
        equal += sig[:, c][:, None] == sig[:, c][None]
    fits = 100 * np.minimum(n[:, None], n[None]) >= share * np.maximum(n[:, None], n[None])
    return np.where((equal >= least) & fits, equal, -1)


def labels_of(near: np.ndarray) -> np.ndarray:
    """The smallest member of each member's connected part of a small graph."""
    label = np.arange(len(near))
    while True:
        met = np.minimum(label, np.where(near, label[None], len(near)).min(1))
        met = met[met]
        if (met == label).all():
            return label
        label = met


class Sets:
    """Union-find over a few members."""

    def __init__(self, count: int):
        self.up = list(range(count))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.top(i), self.top(j)))
        self.up[b] = a


def nodes_of(classes: DataFrame, trees: int, tokens: int, small: int, heavy: int, rounds: int, share: float, seed: int) -> list[DataFrame]:
    """Tables (node, id, n) of small nodes, each set of members once a table."""
    at = lambda *what: F.pmod(F.xxhash64(F.lit(seed), *what), F.lit(tokens)).cast("int")
    rows = classes.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).select(F.xxhash64("t", F.get("sig", at(F.col("t")))).alias("node"), "id", "n")
    out = []
    for turn in range(rounds):
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_w"), F.bit_xor(F.xxhash64("id", "n")).alias("_m")).filter("_c > 1")
        large = (F.col("_c") > small) | ((F.col("_w") > heavy) & (F.col("_c") > 8))
        counts = written(counts.withColumn("_l", large), "path-nodes")
        once = counts.filter("not _l").groupBy("_c", "_w", "_m").agg(F.min("node").alias("node")).select("node")
        out.append(rows.join(once, "node"))
        left = counts.filter("_l").select("node", "_c", "_w")
        if left.isEmpty():
            return out
        kept = rows.join(left, "node")
        if turn == rounds - 1:
            half = max(1, small // 2)
            blocks = F.ceil(F.greatest(F.col("_c") / half, F.col("_w") * 2 / heavy))
            kept = kept.withColumn("_b", F.pmod(F.xxhash64("id", "n"), blocks)).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
            out.append(kept.select(F.xxhash64("node", F.least("_b", "_o"), F.greatest("_b", "_o")).alias("node"), "id", "n"))
            return out
        steps = F.least(F.lit(4), F.greatest(F.lit(1), F.floor(F.log(F.col("_c") / small) * 5))).cast("int")
        wanted = F.pow(F.lit(share), -steps)
        branches = (F.floor(wanted) + F.when(F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(1000)) < (wanted - F.floor(wanted)) * 1000, 1).otherwise(0)).cast("int")
        kept = kept.join(classes.select("id", "n", "sig"), ["id", "n"]).withColumn("_s", steps).withColumn("_i", F.explode(F.sequence(F.lit(1), branches)))
        values = F.transform(F.sequence(F.lit(1), F.col("_s")), lambda q: F.get(F.col("sig"), at(F.col("node"), F.col("_i"), q)))
        rows = written(kept.select(F.xxhash64("node", "_i", values).alias("node"), "id", "n"), "path-rows")
    return out


def contracted(links: DataFrame) -> DataFrame:
    """id, top: the smallest id of each linked id's component, by alternating large and small stars."""
    edges, past = written(links.select("u", "v").distinct(), "links"), None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        star = down.join(least, "u")
        edges = written(star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(star.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == past:
            return edges.groupBy("u").agg(F.min("v").alias("top")).withColumnRenamed("u", "id")
        past = now


def links(docs: DataFrame, classes: DataFrame, nodes: list[DataFrame], parts: int, tokens: int, width: int, share: int) -> DataFrame:
    """Confirmed links (u, v) between classes, enough of them to connect all that are linked within a cluster."""
    mean = share / 100
    least = int(tokens * mean - 4.5 * (tokens * mean * (1 - mean)) ** 0.5)

    def cluster(_, frame) -> list[tuple]:
        import xxhash

        ids, n, sig = frame["id"].to_numpy(), frame["n"].to_numpy(), np.array(frame["sig"].tolist(), dtype=np.int32)
        label = labels_of(agreeing(sig, n, least, share) >= 0)
        out = []
        for top in np.unique(label[np.bincount(label, minlength=len(label))[label] > 1]).tolist():
            own = np.flatnonzero(label == top)
            own = own[np.lexsort((n[own], ids[own]))]
            key = xxhash.xxh64_intdigest(ids[own].tobytes() + n[own].tobytes()) - (1 << 63)
            out += [(key, int(ids[i]), int(n[i]), sig[i].tobytes()) for i in own.tolist()]
        return out

    rows = nodes[0]
    for more in nodes[1:]:
        rows = rows.unionAll(more)
    rows = rows.join(classes.select("id", "n", "sig"), ["id", "n"])
    found = written(by_group(rows, "node", parts, cluster, "cluster long, id long, n long, sig binary"), "path-clusters").dropDuplicates(["cluster", "id", "n"])

    def confirm(_, frame) -> list[tuple]:
        sets = [shingles(t, width) for t in frame["text"]]
        n, told = np.array([len(s) for s in sets]), frame["n"].to_numpy()
        keep = np.flatnonzero(n == told)
        ids, sig = frame["id"].to_numpy(), np.frombuffer(b"".join(frame["sig"]), dtype=np.int32).reshape(len(frame), -1)
        equal = agreeing(sig[keep], n[keep], least, share)
        a, b = np.nonzero(np.triu(equal >= 0, 1))
        order = np.argsort(-equal[a, b], kind="stable")
        joined, out = Sets(len(keep)), []
        for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
            if joined.top(i) == joined.top(j):
                continue
            x, y = sets[keep[i]], sets[keep[j]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= share * (len(x) + len(y) - both):
                joined.join(i, j)
                u, v = sorted((int(ids[keep[i]]), int(ids[keep[j]])))
                if u != v:
                    out.append((u, v))
        return out

    wanted = classes.join(found.select("id").distinct(), "id").select("id", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    texts = keyed(docs).filter("text is not null").join(wanted, same).select("id", "text").dropDuplicates(["id"])  # one text a class
    return by_group(found.join(texts, "id"), "cluster", parts, confirm, "u long, v long")


def by_row(
    docs: DataFrame, width: int = 5, share: int = 80, trees: int = 12, tokens: int = 64, small: int = 512, heavy: int = 1 << 22, rounds: int = 12, parts: int | None = None, seed: int = 1,
) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of every row; linked are sets with 100 * shared >= share * united.

    `small` classes, or `heavy` shingles, are the most that a node is compared with at once; `parts` tasks compare (default: as many
    as the session shuffles to).
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small_batches(docs.sparkSession)
    own = written(sketched(docs, width, tokens, seed), "path-sketches")
    key = ["n", "a", "b"]
    classes = own.filter("n > 0").groupBy(*key).agg(F.min(F.struct(F.col("doc_id").isNull().alias("_no"), "doc_id", "text_hash")).alias("_one"), F.first("sig").alias("sig"))
    classes = classes.select(*key, F.xxhash64(*key).alias("id"), "_one.doc_id", "_one.text_hash", "sig")  # the smallest id of a class, null if it has none
    classes = written(classes, "path-classes")
    nodes = nodes_of(classes.select("id", "n", "sig"), trees, tokens, small, heavy, rounds, share / 100, seed)
    tops = contracted(links(docs, classes, nodes, parts, tokens, width, share))
    owner = classes.select(*key, "id", "doc_id").join(tops, "id", "left").select(*key, "doc_id", F.coalesce("top", "id").alias("_part"))
    least = owner.groupBy("_part").agg(F.min("doc_id").alias("_top"))
    owner = owner.drop("doc_id").join(least, "_part").select(*key, "_top")
    out = own.select("doc_id", "text_hash", *key).join(owner, key, "left")
    component = F.when(F.col("n") > 0, F.col("_top")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def components(docs: DataFrame, **settings) -> DataFrame:
    """`by_row` without the hash of the text: doc_id, n_shingles, component_id, kept of every row."""
    return by_row(docs, **settings).drop("text_hash")
