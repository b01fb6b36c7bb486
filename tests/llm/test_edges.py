"""Cases at the edges of the operators: starts of texts, wide vectors, very long texts, rows met many times, file layout."""

import glob
import math
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from crawlscope.llm import edit_match, line_chunks, noisy_or, pivot_search, token_files
from crawlscope.llm.common import shared_folder


def plain_distance(item, text):
    """Least edit distance of the item to any stretch of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return min(row)


def test_edit_match_misses_nothing_at_the_head_of_a_text():
    dice, found = random.Random(5), 0
    for _ in range(400):
        item = "".join(dice.choice("ab ") for _ in range(dice.randrange(34, 90))).strip()
        item = edit_match.plain(item) or "a"
        share, piece = 0.1, 4
        edits = edit_match.budget(len(item), share, piece)
        text = item[dice.randrange(edits + 2) :]
        for _ in range(dice.randrange(edits + 1)):
            at = dice.randrange(len(text))
            text = text[:at] + dice.choice(["", "a", "b "]) + text[at + dice.randrange(2) :]
        text = edit_match.plain(text + dice.choice(["", " ba", " ab ab ab ba"]))
        hits = edit_match.Finder([(1, item)], share, piece, 8).hits(text)
        want = plain_distance(item, text)
        assert bool(hits) == (want <= edits) and (not hits or min(h[3] for h in hits) == want)
        assert all(h[4] == edits for h in hits)
        found += bool(hits)
    assert found > 100


def test_pivot_search_takes_wide_vectors(spark):
    dice = random.Random(1)
    rows = [(i, [float(dice.randrange(-200, 200)) for _ in range(4)]) for i in range(300)]
    rows += [(300, [300_000.0, 1.0, 2.0, 3.0]), (350, [3e9, -3e9, 5.0, 1.0]), (351, [3e9, 3e9, 7.0, -1.0]), (352, [1e300, 0.0, 0.0, 0.0]), (353, [float(1 << 26), 1.0, 0.0, 0.0])]
    got = {}
    for r in pivot_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0, pivots=4, query_block=3, candidate_block=90).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: [math.floor(x) for x in v] for i, v in rows}
    for q in (i for i in whole if i % 50 == 0):
        score = {i: min(max(sum(a * b for a, b in zip(whole[q], v, strict=True)), -(1 << 63)), (1 << 63) - 1) for i, v in whole.items() if i != q}
        best = sorted((-s, i) for i, s in score.items())[:5]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]


@pytest.fixture(scope="module")
def toxic_model():
    dice = random.Random(3)
    words = [a + b for a in ("tre", "hou", "riv", "sto", "clo", "bre", "lig", "gre") for b in ("en", "se", "er", "ne", "ud", "ad", "ht", "el")]
    sentence = lambda bad: " ".join(dice.choice(words) for _ in range(8)) + (" vexgorp" if bad else "") + "."
    clean = lambda n: " ".join(sentence(False) for _ in range(n))
    rows = [(clean(dice.randrange(2, 30)) + (" " + sentence(True) if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(600)]
    return noisy_or.train(rows), clean, sentence


def test_noisy_or_does_not_score_by_length(toxic_model):
    model, clean, sentence = toxic_model
    texts = [clean(n) for n in (3, 30, 300, 3000, 30_000)] + [clean(3) + "\n" * 10_000, "Fine day. " * 10_000, ". ! ? " * 5000, "\n \n" * 5000]
    scores = noisy_or.Reader(model).scores(texts)
    assert scores.max() < 0.5
    assert abs(scores[5] - noisy_or.Reader(model).scores([clean(3)])[0]) < 0.2
    bad = [clean(n) + " " + sentence(True) for n in (3, 30, 100)]
    assert noisy_or.Reader(model).scores(bad).min() >= 0.5


def test_noisy_or_of_its_sentences_is_the_score(toxic_model):
    model, clean, sentence = toxic_model
    for text in ["one. two\nthree ! four\n\n\nfive?\n . six", clean(80), f"{clean(2)}\n{sentence(True)} . \n x", ". a", "a .\n b"]:
        parts = model.offending(text, 0.0)
        assert abs(1 - np.prod([1 - p for *_, p in parts]) - noisy_or.Reader(model).scores([text])[0]) < 1e-9


def test_offending_sentences_are_named(spark, toxic_model):
    model, clean, sentence = toxic_model
    texts = [clean(5), f"{clean(3)} {sentence(True)} {clean(3)}", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("p", F.lit("x"))
    got = {r.doc_id: r for r in noisy_or.offending_in(noisy_or.scored(docs, model), model).collect()}
    assert not got[0].offending and not got[2].offending and not got[3].offending and got[1].p == "x"
    (place,) = got[1].offending
    assert "vexgorp" in texts[1][place.start : place.start + place.length] and place.probability >= 0.5


def test_line_chunks_of_one_document_in_many_rows(spark):
    text = "\n".join(f"this is line number {i} of a text that many rows hold" for i in range(40))
    other = "\n".join(f"another text has line {i} and more words to it" for i in range(40))
    rows = [(7, text)] * 60 + [(None, text)] * 50 + [(8, text), (9, other), (10, other + "\nand an end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_chunks.repeats(docs).collect()
    assert sorted((r.doc_id, r.start, r.kept_doc_id) for r in found) == [(7, 0, None), (8, 0, None), (10, 0, 9)]
    left = line_chunks.without_repeats(docs, line_chunks.repeats(docs)).collect()
    assert len(left) == len(rows) and all(r.text == text for r in left if r.doc_id is None) and {r.text for r in left if r.doc_id in (7, 8)} == {""}


def test_token_files_have_the_stated_layout(spark):
    docs = spark.createDataFrame([(i, " ".join(str(i * k % 9973) for k in range(40))) for i in range(6_000)], "doc_id long, text string").repartition(2)
    path = token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), path=shared_folder(spark, "layout"), row_group_bytes=64 << 10, page_rows=500)
    files = glob.glob(f"{path.removeprefix('file:')}/*.parquet")
    assert files
    for file in files:
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            by_name = {meta.row_group(g).column(c).path_in_schema.split(".")[0]: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert all("DELTA_BINARY_PACKED" in by_name[c].encodings and by_name[c].dictionary_page_offset is None for c in ("doc_id", "shard_start", "n_tokens"))
            assert by_name["tokens"].has_dictionary_page and "RLE_DICTIONARY" in by_name["tokens"].encodings
            assert all(c.has_offset_index and c.has_column_index for c in by_name.values())
    assert sum(pq.ParquetFile(f).metadata.num_row_groups for f in files) > len(files)
