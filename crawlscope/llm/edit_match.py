"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces: wherever the item occurs with at most k edits, one piece
occurs unchanged. An automaton finds the pieces in every text; each hit names a diagonal, and the text around it is compared with the
whole item by Myers' bit-parallel edit distance. Texts and items are taken in lower case with single blanks; places refer to that form.

Items are read in blocks of bounded size, which travel to the tasks; every block meets all texts. Nothing is shuffled. All blocks are
held by each worker, so what it needs grows with the test items (about a hundred bytes a character), not with the documents.

Short items (under `least_chars`) are met without edits only, and only where no word goes on before or after them.

Cases: null and empty texts have no hits; null and blank items are not searched; items with equal
texts are all reported; rows with equal or null ids are each searched; empty tables give no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import series_udf, small_batches

HIT = "array<struct<item_id:long,start:long,length:long,distance:long,budget:long>>"


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def budget(size: int, share: float, least_piece: int) -> int:
    """Edits allowed for an item: a share of its length, with pieces of at least `least_piece` characters."""
    return max(0, min(int(size * share), size // least_piece - 1))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """Start and text of edits + 1 pieces of nearly equal length."""
    n = edits + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def myers(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of the pattern to a stretch of `text`, and the first end of such a stretch.

    A column of the edit matrix is kept as two bit vectors of vertical differences; `anchored` stretches begin where the text does.
    """
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance, best, end = ones, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = (minus | ~(across | plus)) & ones, plus & across
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = up << 1 & ones | (1 if anchored else 0), down << 1 & ones
        plus, minus = (down | ~(vertical | up)) & ones, up & vertical
        if distance < best:
            best, end = distance, j
    return best, end


def inside_word(text: str, start: int, end: int) -> bool:
    """Whether a word goes on over either end of a stretch."""
    return text[max(0, start - 1) : start + 1].isalnum() and start > 0 or text[end - 1 : end + 1].isalnum() and end < len(text)


class Finder:
    """Searches texts for a block of items."""

    def __init__(self, items: list[tuple[int, str]], share: float, least_piece: int, least_chars: int):
        import ahocorasick

        self.items, by_piece, self.least_chars = [], {}, least_chars
        for number, (item_id, item) in enumerate(items):
            edits = budget(len(item), share, least_piece) if len(item) >= least_chars else 0
            self.items.append((item_id, item, edits, masks(item), masks(item[::-1])))
            for at, piece in pieces(item, edits):
                by_piece.setdefault(piece, []).append((number, at))
        self.machine = ahocorasick.Automaton()
        for piece, places in by_piece.items():
            self.machine.add_word(piece, (len(piece), places))
        self.machine.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int, int]]:
        text, diagonals = plain(text), {}
        for end, (size, places) in self.machine.iter(text):
            for number, at in places:
                diagonals.setdefault(number, set()).add(end + 1 - size - at)
        out = []
        for number, starts in diagonals.items():
            item_id, item, edits, peq, back = self.items[number]
            done = min(starts) - 1  # below any diagonal: an item whose head is missing begins before the text
            for start in sorted(starts):
                if start <= done:  # within a stretch that was found or searched
                    continue
                if len(item) < self.least_chars and inside_word(text, start, start + len(item)):
                    continue
                low = max(0, start - edits)
                distance, end = myers(peq, len(item), text[low : start + len(item) + edits])
                done = start + edits
                if distance <= edits:
                    stop = low + end
                    _, size = myers(back, len(item), text[max(0, stop - len(item) - edits) : stop][::-1], anchored=True)
                    out.append((item_id, stop - size, size, distance, edits))
                    done = max(done, stop - 1 - edits)
        return sorted(out)


@lru_cache(maxsize=4)
def finder(items: tuple, share: float, least_piece: int, least_chars: int) -> Finder:
    """One automaton for each block and worker process."""
    return Finder(list(items), share, least_piece, least_chars)


def blocks(items: DataFrame, block_chars: int) -> Iterator[tuple]:
    """Items in blocks of about `block_chars` characters."""
    held, size = [], 0
    usable = items.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    for row in usable.toLocalIterator():
        text = plain(row["text"])
        if text:
            held.append((row["item_id"], text))
            size += len(text)
        if size >= block_chars:
            yield tuple(sorted(held))
            held, size = [], 0
    if held:
        yield tuple(sorted(held))


def matched(docs: DataFrame, items: DataFrame, share: float = 0.06, least_piece: int = 16, least_chars: int = 32, block_chars: int = 1 << 21, name: str = "hits") -> DataFrame:
    """`docs` with the array of places where an item occurs within its error budget."""
    def searcher(held):
        def search(batches):
            import pandas as pd

            machine = finder(held.value, share, least_piece, least_chars)
            for batch in batches:
                yield pd.Series([[dict(zip(("item_id", "start", "length", "distance", "budget"), h, strict=True)) for h in machine.hits(t)] if t else [] for t in batch])

        return series_udf(search, HIT)

    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    found = [searcher(context.broadcast(block))(docs["text"]) for block in blocks(items, block_chars)]
    none = F.array().cast(HIT)
    return docs.withColumn(name, F.concat(*found) if len(found) > 1 else found[0] if found else none)


def leaks(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """One row per occurrence: doc_id, item_id, start, length, distance, budget (the edits that were allowed; 0 also for short items, which are met at word bounds)."""
    hits = matched(docs.select("doc_id", "text"), items, name="_hits", **settings)
    return hits.select("doc_id", F.explode("_hits").alias("_h")).select("doc_id", "_h.*")


def without_leaks(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The documents in which no item occurs."""
    return matched(docs, items, name="_llm_hits", **settings).filter("size(_llm_hits) = 0").drop("_llm_hits")
