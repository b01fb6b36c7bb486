"""Block anchors, importance resampling and packed negatives against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlscope.llm import block_anchors, importance, packed_negatives
from crawlscope.llm.common import written
from tests.llm.test_operators import odd_documents


def plain_repeats(rows, window):
    """(doc_id, n_words, n_removed, spans, kept) of each (doc_id, text), by counting windows as word lists."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {p for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] > 1 for p in range(s, s + window)}
        edges = [p for p in range(len(w) + 1) if (p in gone) != (p - 1 in gone)]
        spans = tuple(zip(edges[::2], edges[1::2], strict=True))
        out.append((i, len(w), len(gone), spans, " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def told_repeats(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, tuple((s["from"], s["to"]) for s in r.spans), r.kept) for r in df.collect()], key=str)


@pytest.mark.parametrize("window", [1, 2, 5, 8])
def test_block_anchors_equal_counted_windows(spark, window):
    dice = random.Random(window)
    texts = [" ".join(dice.choice("abcde") * dice.randint(1, 2) for _ in range(dice.randrange(60))) for _ in range(60)]
    passage = " ".join(f"w{i}" for i in range(3 * window))
    texts += [f"x{i} " * dice.randrange(9) + passage + f"\ty{i}" * dice.randrange(9) for i in range(9)]  # at every offset to the blocks
    texts += ["same " * 40, " ".join(f"n{i}" for i in range(50)), texts[0], texts[0]]
    rows = [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for sizes in ({"chunk_bytes": 600, "part_hashes": 40}, {}):
        assert told_repeats(block_anchors.deduplicated(docs, window=window, **sizes)) == plain_repeats(rows, window)


def test_block_anchors_on_odd_rows(spark):
    docs = odd_documents(spark).withColumn("row", F.lit("clash")).withColumn("kept", F.lit(0))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = block_anchors.deduplicated(docs, window=35)
    assert got.columns == ["doc_id", "n_words", "n_removed", "spans", "kept"] and told_repeats(got) == plain_repeats(rows, 35)
    assert block_anchors.deduplicated(docs.limit(0)).count() == 0


def test_rolling_hashes_tell_order_and_length():
    words = block_anchors.Words()
    a, b = words.of("p q r s t p q r t s p q r s t"), words.of("p q r s t")
    got = block_anchors.rolling(a, 5)
    assert got[0] == got[10] == block_anchors.rolling(b, 5)[0] and len(set(got.tolist())) == 10
    assert not len(block_anchors.rolling(b, 6))
    values = np.array([0, 1, (1 << 40) - 1], np.uint64)
    assert block_anchors.numbers(block_anchors.planes(values, 5), 5).tolist() == values.tolist()


def plain_resampled(rows, targets, runs, buckets, share, least):
    def met(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        grams = [" ".join(w[i : i + n]) for n in range(runs[0], runs[1] + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(g.encode()) % buckets for g in grams]

    found, t = [met(x) for _, x in rows], Counter(b for x in targets for b in met(x)[1])
    s = Counter(b for _, m in found for b in m)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for (i, _), (n, m) in zip(rows, found, strict=True):
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, m))
        out.append([i, n, len(m), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted([r for r in out if r[1] >= least], key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for rank, r in enumerate(fit[: len(fit) * share // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("runs", "share", "least"), [((1, 1), 10, 20), ((1, 2), 100, 0), ((2, 3), 35, 3), ((1, 1), 0, 0)])
def test_importance_equals_brute_force(spark, runs, share, least):
    dice = random.Random(4)
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(100 + i, " ".join(dice.choice(["Tea", "MILK", "é", "x9", "a-b"]) for _ in range(dice.randrange(40)))) for i in range(150)]
    rows += [(500, "tie and tie again " * 9)] * 60
    target = ["tea tea milk", None, "", "É x9"]
    got = importance.resampled(
        spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, weight string, _row int").repartition(5),
        spark.createDataFrame([(x,) for x in target], "text string"), runs=runs, buckets=50, share=share, least_words=least, pivots=3,
    )
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_resampled(rows, target, runs, 50, share, least)


def test_importance_of_nothing(spark):
    docs = odd_documents(spark)
    assert importance.resampled(docs.limit(0), docs).count() == 0
    assert importance.resampled(docs, docs.select("text").limit(0)).count() == docs.count()
    assert importance.Buckets(7, limit=2).of([b"a", b"b", b"c", b"a"], (1, 1)).tolist() == [zlib.crc32(x) % 7 for x in (b"a", b"b", b"c", b"a")]


@pytest.mark.parametrize("pivots", [1, 2, 15])
def test_kth_key_of_skewed_keys(spark, pivots):
    dice = random.Random(pivots)
    rows = [(dice.choice([5, 5, 5, dice.randrange(-9, 9)]), i) for i in range(400)]
    df = written(spark.createDataFrame(rows, "a long, b long"), "keys")
    order = sorted(rows)
    for k in (1, 2, 200, 399, 400):
        assert importance.kth_key(df, ["a", "b"], k, pivots) == order[k - 1]
    with pytest.raises(ValueError):
        importance.kth_key(df, ["a", "b"], 401, pivots)


def plain_mined(rows, k, share):
    """Brute force in Python integers over (vec_id, vector, label)."""
    fit = [(i, [0 if not f else f for f in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [(i, [math.floor(c) for c in v], y) for i, v, y in fit]
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b, strict=False)), -(1 << 63)), (1 << 63) - 1)
    anchors = {}
    for i, v, y in fit:
        if i % 3 == 0 and (i not in anchors or (y, v) < anchors[i]):
            anchors[i] = (y, v)
    out = []
    for i, (y, v) in anchors.items():
        others = sorted((-score(v, w), j, z) for j, w, z in fit if j != i)
        for p, j, _ in [o for o in others if o[2] == y][:k]:
            negatives = [o for o in others if o[2] != y and share * -p <= 100 * -o[0] <= 100 * -p][:k]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(negatives, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 40.0, 3e9, 1e30])
def test_packed_negatives_equal_brute_force(spark, scale):
    dice = random.Random(6)
    rows = [(i, [math.floor(dice.gauss(0.3, 1) * 4) * float(math.floor(scale)) for _ in range(dice.choice([3, 5]))], dice.choice([1, 1, 1, 2, 3])) for i in range(90)]
    rows += [(91, [2.0, 1.0], 1), (93, [1e300, 1.0], 2), (94, None, 1), (95, [1.0, None], 1), (96, [math.nan], 1), (97, [math.inf], 1), (98, [], 2), (99, [1.0], None), (None, [1.0], 1), (12, [4.0, 4.0, 4.0], 3), rows[7], rows[9]]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, id string, v int").repartition(3)
    want = plain_mined(rows, 4, 70)
    for sizes in ({"block_bytes": 800, "fields": 7}, {}):
        got = packed_negatives.mined(df, lambda i: i % 3 == 0, F.col("label"), positives=4, negatives=4, share=70, **sizes)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, got.collect())) == want and want
    assert packed_negatives.mined(df.limit(0), lambda i: i % 3 == 0, F.col("label")).count() == 0


def test_packs_of_any_width():
    dice = random.Random(2)
    for top in (0, 1, 200, 1 << 20, (1 << 30) - 1, 1 << 40, 1 << 90):
        x = [[dice.randint(-top, top) for _ in range(6)] for _ in range(11)]
        anchor = [dice.randint(-top, top) for _ in range(6)]
        pack = packed_negatives.Pack(np.array(x, dtype=np.int64 if top < 1 << 30 else object), max(map(abs, anchor)))
        want = [sum(a * b for a, b in zip(anchor, row, strict=True)) for row in x]
        assert pack.scores(anchor).tolist() == [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in want]
