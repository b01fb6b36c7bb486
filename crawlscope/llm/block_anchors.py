"""Exact substring dedup by fixed-block anchors.

A text is a sequence of words. The reference blocks are its non-overlapping blocks of `block` words, half as long as a window, so
every window of `window` words, wherever it stands, holds exactly one whole reference block. Blocks are indexed by hash and every rolling run of
`block` words of every text probes the index: a block that no other run equals can't lie in a repeated window. Around blocks
that are met elsewhere the hits are extended: the windows that hold such a block are compared whole, by two independent hashes
(64 bits of the first, and of the second what chooses the part), and windows met twice or more are merged to maximal repeats. Every word of a repeat goes, in all its places.

Probes and windows travel as sorted lists of hashes, each list without its repeats but for one (met once, met again), cut
by hash into `parts`. So a passage that stands in a third of all texts costs each list two entries, no pair of places is ever formed, and
a task's share is a share of the hash range. Texts are put into chunks by row number, which no key can make hot. The rows are
written once so that all passes see the same row numbers; the second and third pass bring each chunk's texts and its hits together.

Cases: null and empty texts have no words; texts shorter than a window keep all words; equal texts, in rows of equal or null ids
too, are places like any others, so of texts of a window or more all copies go whole; an empty table gives no rows; other columns are
ignored. Nothing of the result depends on chunks, parts or the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import small_batches, written

#: Odd multipliers of the two rolling hashes, and of the mixing step (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Bits of a block's hash that travel, beside the part it is sent to: blocks are only candidates, windows decide.
BLOCK_BITS = 40


class Words(dict):
    """Hashes of words, kept while the table is small."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, text: str) -> np.ndarray:
        found = text.encode().split()  # of bytes, this divides at space, tab, line feed, vertical tab, form feed and return
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, MIX[0]), (27, MIX[1])):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(words: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of each run of `size` words: a difference of prefix sums of a polynomial, in arithmetic modulo 2**64."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(base, len(words)), dtype=np.uint64)])
    back = powers(pow(base, -1, 1 << 64), len(words) - size + 1)
    return mixed((total[size:] - total[:-size]) * back)


def second(words: np.ndarray, size: int) -> tuple:
    """What the second hash of runs is made of."""
    return mixed(words + np.uint64(1)), size, BASES[1]


def windows_of(words: np.ndarray, size: int) -> np.ndarray:
    """Two independent hashes of each run of `size` words, as columns."""
    return np.stack([rolling(words, size), rolling(*second(words, size))], axis=1)


def planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, first all first bytes and so on: sorted numbers compress well so."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T).tobytes()


def numbers(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, 8 - width :] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view(">u8")[:, 0].astype(np.uint64)


def twice(ordered: np.ndarray) -> np.ndarray:
    """Which entries of a sorted array stay when each value is kept at most twice."""
    keep = np.ones(len(ordered), bool)
    keep[2:] = ordered[2:] != ordered[:-2]
    return keep


def member(ordered: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of `asked` occur in a sorted array."""
    if not len(ordered):
        return np.zeros(len(asked), bool)
    return ordered[np.minimum(np.searchsorted(ordered, asked), len(ordered) - 1)] == asked


class Known:
    """The windows of a chunk that are met elsewhere, looked up through a table of their low bits."""

    def __init__(self, hits, parts: int):
        lists = [numbers(x, 8) for x in hits["windows"]]
        first = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
        part = np.repeat(hits["part"].to_numpy(np.uint64), [len(x) for x in lists])
        order = np.argsort(first, kind="stable")
        self.first, self.part, self.parts = first[order], part[order], np.uint64(parts)
        self.mask = np.uint64((1 << max(8, (8 * len(first)).bit_length())) - 1)
        self.low = np.zeros(int(self.mask) + 1, bool)
        self.low[self.first & self.mask] = True

    def starts(self, words: np.ndarray, window: int) -> np.ndarray:
        """Where the repeated windows of a text begin."""
        first = rolling(words, window)
        maybe = np.flatnonzero(self.low[first & self.mask])
        maybe = maybe[member(self.first, first[maybe])]
        if len(maybe):
            own = rolling(*second(words, window))[maybe] % self.parts
            low, high = (np.searchsorted(self.first, first[maybe], side) for side in ("left", "right"))
            maybe = maybe[(self.part[low] == own) | (self.part[high - 1] == own)]
        return maybe


def cut(parts: np.ndarray):
    """(part, from, to) of an array in order of its parts."""
    edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
    return [(int(parts[a]), a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def addressed(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part in the high bits, BLOCK_BITS of the rest of the hash below."""
    n, bits = np.uint64(parts), np.uint64(BLOCK_BITS)
    return hashes % n << bits | hashes // n & np.uint64((1 << BLOCK_BITS) - 1)


def packed_blocks(probes: np.ndarray, own: np.ndarray, rows: np.ndarray, places: np.ndarray, parts: int) -> list[tuple]:
    """(part, probes, own, rows, places): all rolling hashes, at most twice each, and the reference blocks with where they stand."""
    width, bits = BLOCK_BITS // 8, np.uint64(BLOCK_BITS)
    probes = np.sort(addressed(probes, parts))
    probes = probes[twice(probes)]
    out = {p: [p, planes(probes[a:b], width), b"", b"", b""] for p, a, b in cut(probes >> bits)}
    own = addressed(own, parts)
    order = np.argsort(own, kind="stable")
    own, rows, places = own[order], rows[order].astype("<i8"), places[order].astype("<i4")
    for p, a, b in cut(own >> bits):
        out[p][2:] = planes(own[a:b], width), rows[a:b].tobytes(), places[a:b].tobytes()
    return [tuple(x) for x in out.values()]


def packed_windows(hashes: np.ndarray, parts: int) -> list[tuple]:
    """(part, windows): first hashes, at most twice each; the part is chosen by the second, so its bits count too."""
    first, part = hashes[:, 0], hashes[:, 1] % np.uint64(parts)
    order = np.lexsort((first, part))
    return [(p, planes(own[twice(own)], 8)) for p, a, b in cut(part[order]) for own in (first[order[a:b]],)]


def probing(block: int, parts: int, most: int):
    """Pass 1: the rolling hashes and reference blocks of some texts."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        seen, held, size = Words(), [], 0

        def sent():
            probes, own, rows, places = (np.concatenate(x) for x in zip(*held, strict=True))
            return pd.DataFrame(packed_blocks(probes, own, rows, places, parts), columns=["part", "probes", "own", "rows", "places"])

        for batch in batches:
            for row, text in zip(batch["row"].tolist(), batch["text"].tolist(), strict=True):
                probes = rolling(seen.of(text), block)
                if len(probes):
                    own = probes[::block]
                    held.append((probes, own, np.full(len(own), row, np.int64), np.arange(len(own), dtype=np.int64) * block))
                    size += len(probes)
                if size >= most:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    return run


def met_blocks(frame):
    """Reference blocks whose hash some other run has too."""
    import pandas as pd

    width = BLOCK_BITS // 8
    found = np.sort(np.concatenate([numbers(x, width) for x in frame["probes"]]))
    own = np.concatenate([numbers(x, width) for x in frame["own"]])
    again = np.searchsorted(found, own, "right") - np.searchsorted(found, own, "left") > 1
    rows, places = np.frombuffer(b"".join(frame["rows"]), "<i8"), np.frombuffer(b"".join(frame["places"]), "<i4")
    return pd.DataFrame({"row": rows[again], "place": places[again]})


def extending(window: int, block: int, parts: int):
    """Pass 2: the windows of a chunk that hold a block met elsewhere."""

    def run(key, texts, hits):
        import pandas as pd

        seen, out = Words(), []
        places = {row: group.to_numpy() for row, group in hits.groupby("row")["place"]}
        for row, text in zip(texts["row"].tolist(), texts["text"].tolist(), strict=True):
            if row in places:
                words = seen.of(text)
                if len(words) >= window:
                    starts = np.unique((places[row][:, None] - np.arange(window - block + 1)[None]).ravel())
                    starts = starts[(starts >= 0) & (starts <= len(words) - window)]
                    out.append(windows_of(words, window)[starts])
        rows = packed_windows(np.concatenate(out), parts) if out else []
        return pd.DataFrame([(p, int(key[0]), w) for p, w in rows], columns=["part", "chunk", "windows"])

    return run


def met_windows(frame):
    """Windows that are met twice or more, for each chunk that has them."""
    import pandas as pd

    lists, out = [numbers(x, 8) for x in frame["windows"]], []
    every, counts = np.unique(np.concatenate(lists), return_counts=True)
    again = every[counts > 1]
    for chunk, own in zip(frame["chunk"].tolist(), lists, strict=True):
        own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        keep = own[member(again, own)]
        if len(keep):
            out.append((chunk, int(frame["part"].iloc[0]), planes(keep, 8)))
    return pd.DataFrame(out, columns=["chunk", "part", "windows"])


def removing(window: int, parts: int):
    """Pass 3: the words of a chunk's texts without those that lie in a repeated window."""

    def run(key, texts, hits):
        import pandas as pd

        seen, out, known = Words(), [], Known(hits, parts)
        for doc_id, text in zip(texts["doc_id"], texts["text"].tolist(), strict=True):
            words = text.encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            if len(known.first) and len(words) >= window:
                starts = known.starts(seen.of(text), window)
                gone[starts] += 1
                gone[starts + window] -= 1
            lost = np.cumsum(gone)[: len(words)] > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8)))
            spans = [{"from": int(a), "to": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
            kept = b" ".join([w for w, x in zip(words, lost.tolist(), strict=True) if not x]) if spans else b" ".join(words)
            out.append((None if pd.isna(doc_id) else int(doc_id), len(words), int(lost.sum()), spans, kept.decode()))
        frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "spans", "kept"])
        return frame.astype({"doc_id": "Int64"})

    return run


def deduplicated(docs: DataFrame, window: int = 35, chunk_bytes: int = 8 << 20, part_hashes: int = 1 << 21) -> DataFrame:
    """doc_id, n_words, n_removed, spans (words from, to, of the maximal repeats) and kept (the other words, a blank between) of every row.

    A chunk holds texts of about `chunk_bytes` bytes, a part about `part_hashes` probes.
    """
    block = (window + 1) // 2
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(rows.withColumn("bytes", F.octet_length("text")), "anchor-rows")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    chunks, parts = max(1, -(-total // chunk_bytes)), min(1 << 24, max(1, -(-total // (6 * part_hashes))))
    chunk = F.pmod(F.xxhash64("row"), F.lit(chunks))

    sent = rows.select("row", "text").mapInPandas(probing(block, parts, part_hashes), "part long, probes binary, own binary, rows binary, places binary")
    blocks = written(sent.groupBy("part").applyInPandas(met_blocks, "row long, place int"), "anchor-blocks").withColumn("chunk", chunk)
    texts = rows.select("row", "doc_id", "text", chunk.alias("chunk"))
    sent = texts.drop("doc_id").groupBy("chunk").cogroup(blocks.groupBy("chunk")).applyInPandas(extending(window, block, parts), "part long, chunk long, windows binary")
    found = written(sent.groupBy("part").applyInPandas(met_windows, "chunk long, part long, windows binary"), "anchor-windows")
    out = "doc_id long, n_words long, n_removed long, spans array<struct<from:long,to:long>>, kept string"
    return texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(removing(window, parts), out)
