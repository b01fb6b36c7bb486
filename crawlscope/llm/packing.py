"""Pack documents into windows by Karmarkar-Karp multiway differencing.

Every document's ids are cut at the window size; what is left over of each is packed. A task reads its rows in blocks of bounded
size and differences each block: partial partitions with opposing imbalances are merged, the largest difference first, until one
partition into near-equal windows is left. The number of windows starts at the least that could hold the block and rises while
a window is over capacity. Nothing is shuffled, and a block never grows with the input.

Cases: a null text counts as empty and gives the end id alone; rows with equal or null ids are packed each on their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame

from crawlscope.llm.common import piece_encoder, slices, small_batches

PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Different words that a worker's table takes before a new one is begun; the last one is kept beside it. Both stay while the worker waits for the next task or stage.
WORDS = 125_000


def differenced(sizes: list[int], windows: int) -> list[list[int]]:
    """Item numbers by window. A partial partition holds its non-empty windows, largest sum first; the others are empty."""
    heap = [(-n, i, [(n, [i])]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        over = max(0, len(a) + len(b) - windows)  # so many of the smallest of a meet the smallest of b, small to large
        keep_a, keep_b = len(a) - over, len(b) - over
        met = [(a[keep_a + j][0] + b[len(b) - 1 - j][0], a[keep_a + j][1] + b[len(b) - 1 - j][1]) for j in range(over)]
        both = sorted(a[:keep_a] + b[:keep_b] + met, key=lambda x: -x[0])
        least = both[-1][0] if len(both) == windows else 0
        tick += 1
        heapq.heappush(heap, (least - both[0][0], tick, both))
    return [items for _, items in heap[0][2]] if heap else []


def packed(sizes: list[int], capacity: int) -> list[list[int]]:
    """The differenced partition with few windows in which none is over capacity; sizes are at most the capacity."""
    if not sizes:
        return []
    fits = lambda w: all(sum(sizes[i] for i in items) <= capacity for items in w)
    least = max(1, -(-sum(sizes) // capacity))
    step, low, best = 1, least - 1, differenced(sizes, least)
    high = least
    while not fits(best):
        low, high, step = high, min(len(sizes), high + step), step * 2
        best = differenced(sizes, high)
    while high - low > 1:
        middle = (low + high) // 2
        if fits(found := differenced(sizes, middle)):
            high, best = middle, found
        else:
            low = middle
    return best


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, capacity: int = 2048, piece: int | None = None, block: int = 768) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit) and their place: sequence and offset in it.

    What is left of a document is cut into parts of at most `piece` ids (default: not cut); `block` parts are differenced at a time.
    Sequence ids are unique: the task's number times 2**32 plus a count.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        coder, sequence = piece_encoder(tokenizer, kind, WORDS), TaskContext.get().partitionId() << 32
        end, schema = end_id.to_bytes(4, "little"), pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in "doc_id start length ids doc_tokens sequence_id offset".split()])
        rows: list[tuple] = []
        rest: list[tuple] = []

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        def difference() -> None:
            nonlocal sequence
            for window in packed([r[2] for r in rest], capacity):
                offset = 0
                for i in sorted(window):
                    rows.append((*rest[i], sequence, offset))
                    offset += rest[i][2]
                sequence += 1
            rest.clear()

        held = 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").fill_null("")
            for a, b in slices(pc.binary_length(texts).to_pylist(), 1 << 20):
                for doc, raw in zip(ids[a:b], coder.encoded(texts.slice(a, b - a)).to_pylist(), strict=True):
                    raw += end
                    n, at = len(raw) // 4, 0
                    held += n
                    while n - at >= capacity:
                        rows.append((doc, at, capacity, raw[4 * at : 4 * (at + capacity)], n, sequence, 0))
                        sequence, at = sequence + 1, at + capacity
                    while at < n:
                        size = min(n - at, piece or capacity)
                        rest.append((doc, at, size, raw[4 * at : 4 * (at + size)], n))
                        at += size
                    if len(rest) >= block:
                        difference()
                    if held > 1 << 19 and rows:
                        yield full()
                        held = 0
        difference()
        if rows:
            yield full()
        pa.default_memory_pool().release_unused()

    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE_SCHEMA)
