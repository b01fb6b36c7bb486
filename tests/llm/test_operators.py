"""Each operator against a plain version, and on odd rows."""

import base64
import gzip
import hashlib
import random
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from crawlscope.llm import chosen_path, edit_match, interleave, line_chunks, noisy_or, packing, pivot_search, subword, token_files, warc
from crawlscope.llm.common import PieceEncoder, labelled_sample, shared_folder, written

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, node long, hash string, _n int, score string, start string"
ODD = [
    "a b\nc d", "", " a", "a ", "a\n", "\na", "a  b", "a\n\nb", "a \nb", "<|endoftext|>", "a<|endoftext|> b", "\t a\tb", "a b c", "a | b||c |d", "\x1ca b", "é é. é́x ΑΣ",
    "1 2\n3 45", "a\r\nb c", "\0a b", "foo!! bar.## a_b x's y'", "ﬁn ǅ x²", "İstanbul Å Œuvre ’x", "日本 語。x", "naïve|x | y|", "Ünïcode, MIXED Case!!",
]


def odd_documents(spark):
    texts = [None, "", "   ", "one", "the same text here. twice over it goes.", "the same text here. twice over it goes.", "w" * 60_000, "word and line. " * 8000, *ODD]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), 1, 2, 3, "x", 4, "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id here", None, None, None, *rows[0][5:])], SCHEMA)


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_piece_encoder_equals_the_library(path, kind):
    dice, coder = random.Random(3), PieceEncoder(path, kind, limit=500)
    signs = ["a", "B", "é", "ß", " ", "  ", "\n", ".", ",", "!!", "'s", "|", "9", "\t", "Ω", "é", "the", "ing", "-"]
    texts = ODD + ["".join(dice.choice(signs) for _ in range(dice.randrange(40))) for _ in range(600)]
    for i in range(0, len(texts), 100):
        assert coder.encode(texts[i : i + 100]) == [coder.whole(t) for t in texts[i : i + 100]]


def test_piece_encoder_learns_a_word_once_and_many_together():
    coder, calls, sent = PieceEncoder(BYTE, "byte"), [], []
    model, tokenizer = coder.model, coder.tokenizer
    coder.model = SimpleNamespace(tokenize=lambda w: calls.append(w) or model.tokenize(w))
    batch = lambda texts, **how: sent.extend("\n".join(texts).split("\n")) or tokenizer.encode_batch_fast(texts, **how)
    coder.tokenizer = SimpleNamespace(encode_batch_fast=batch, encode=tokenizer.encode)
    words = [a + b + c for a in ("ka", "né", "Über", "st") for b in ("lor", "mî", "tesch") for c in ("en", "ing", "ça", "")]
    text = "x " + " ".join([*words, *(w + "," for w in words), *(w + "!?" for w in words), *words])
    assert coder.encode([text, text, "\n".join(words)]) == [coder.whole(text), coder.whole(text), coder.whole("\n".join(words))]
    runs = [w for w in calls if w.startswith(coder.letters[32])]
    assert sum(w.count(coder.letters[32]) for w in runs) == len(words) and len(runs) < len(words) / 8
    assert sorted(sent) == ["!?", ","]
    assert len(calls) - len(runs) <= len(words) + 1  # those that start a line or a text


def test_token_files(spark):
    docs, coder = odd_documents(spark), Tokenizer.from_file(BYTE)
    path = token_files.write_tokens(docs, BYTE)
    got = token_files.token_digest(token_files.read_tokens(spark, path)).collect()
    want = sorted(zlib.crc32(np.array([*coder.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in docs.collect())
    assert sorted(r.ids_crc32 for r in got) == want
    got = sorted(got, key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: -1 if i is None else i)
    few = token_files.read_tokens(spark, path).filter("doc_id = 7").select("n_tokens")
    assert "tokens:array" not in few._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert token_files.read_tokens(spark, token_files.write_tokens(docs.limit(0), BYTE)).count() == 0


def page_rows(spark):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2 b\r\n", "<p>x</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", "é\r\n\r\nWARC/1.1\r\n" * 9), (6, "u", "<p>y</p>"), (6, "u", "<p>y</p>"), (None, "n", "<p>x</p>"), (9, "long", "z" * 3_000_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    pages, raw, target = page_rows(spark).withColumn("digest", F.lit(1)), shared_folder(spark, "raw"), shared_folder(spark, "warc")
    warc.write_archives(warc.page_records(pages), raw, file_records=3)
    index = written(warc.normalise(spark, raw, target), "index")
    assert index.filter("error is not null").count() == 0
    got = warc.read_records(index).collect()
    assert len(got) == 9 and len({r.file for r in got}) > 1
    by_id = {r.page_id: r for r in got}
    html = {r.page_id: r.html or "" for r in pages.collect()}
    for i, r in by_id.items():
        want = base64.b32encode(hashlib.sha1(html[i].encode()).digest()).decode()
        assert r.stated_digest == want and r.payload_length == len(html[i].encode())
        assert r.record_type == "revisit" or (r.payload_digest == want and r.payload == html[i].encode())
    assert {i: r.record_type for i, r in by_id.items()} == {1: "revisit", 2: "response", 3: "revisit", 4: "response", 5: "response", 6: "response", None: "revisit", 9: "response"}
    assert by_id[1].refers_to == "<urn:page:2>" and by_id[2].target_uri == "http://a/2%20b%20%20"
    one = next(r for r in index.collect() if r.record_id == "<urn:page:5>")
    data = open(one.file.removeprefix("file:"), "rb").read()[one.offset : one.offset + one.length]
    assert gzip.decompress(data).count(b"WARC/1.1") == 10
    warc.write_archives(warc.page_records(pages.limit(0)), empty := shared_folder(spark, "raw"))
    assert warc.read_records(warc.normalise(spark, empty, target + "-none")).count() == 0


def test_warc_damage_keeps_what_stands_before(tmp_path):
    record = b"WARC/1.1\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "x.gz").write_bytes(gzip.compress(record % 1) + gzip.compress(record % 2 + b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort"))
    got = list(warc.rewrite(f"file://{tmp_path}/x.gz", f"file://{tmp_path}/out/x.warc.gz"))
    assert [r[2] for r in got] == ["<urn:page:1>", "<urn:page:2>", None] and "EOFError" in got[2][3]


def test_noisy_or_finds_the_sentence(spark):
    dice = random.Random(1)
    words = ["tree", "house", "river", "stone", "cloud", "bread", "light", "green", "walks", "under"]
    sentence = lambda bad: " ".join(dice.choice(words) for _ in range(6)) + (" vexgorp" if bad else "") + "."
    rows = [(i, " ".join(sentence(i % 4 == 0 and j == 2) for j in range(dice.randrange(3, 9))), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, y) for i, _, y in rows), (1, None), (None, 1), (10**9, 1)], "doc_id long, toxic int")
    model = noisy_or.fit(docs, labels, usable=F.col("doc_id") < 300)
    got = noisy_or.scored(docs, model).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got if r.doc_id >= 300)
    places = noisy_or.located(docs, model).collect()
    assert {r.doc_id for r in places if "vexgorp" in r.sentence} == set(range(0, 400, 4))
    text = {i: t for i, t, _ in rows}
    assert all(text[r.doc_id][r.start : r.start + len(r.sentence)] == r.sentence for r in places)
    odd = noisy_or.scored(odd_documents(spark), model, "p").collect()
    assert all(0 <= r.p <= 1 and r.score == "y" for r in odd)
    assert noisy_or.scored(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        noisy_or.fit(docs, labels.filter("toxic = 0"))


def test_reader_equals_the_sum_over_sentences():
    shape = subword.Shape(10, 5, 5)
    model = noisy_or.Model(shape, np.random.default_rng(0).normal(0, 1, 1 << 10), -2.0)
    for text in ["", "a b. c d! e", "alpha beta\ngamma alpha alpha. alpha", *ODD]:
        clear = 1.0
        found, current = [[]], None
        for t in noisy_or.tokens(text):
            current = found[-1]
            current.append(t)
            if t[-1] in ".!?":
                found.append([])
        for s in [s for s in found if s] or [[]]:
            z = -2.0 + sum(float(model.logits([t])[0]) for t in set(s))
            clear *= 1 / (1 + np.exp(z))
        assert abs(noisy_or.Reader(model).scores([text])[0] - (1 - clear)) < 1e-9


def test_subword_classifier(spark):
    dice = random.Random(2)
    good = lambda: " ".join(dice.choice(["plain", "words", "about", "many", "things", "and", "more"]) for _ in range(30))
    rows = [(i, good() if i % 3 else good().upper().replace(" ", "!! "), int(bool(i % 3))) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, y) for i, _, y in rows), (1, None), (None, 1)], "doc_id long, quality int")
    model = subword.fit(docs, labels, usable=F.col("doc_id") < 200)
    got = subword.scored(docs, model).collect()
    assert all((r.score >= 0.5) == bool(r.doc_id % 3) for r in got if r.doc_id >= 200)
    odd = subword.scored(odd_documents(spark), model, "p").collect()
    assert all(0 <= r.p <= 1 and r.score == "y" for r in odd)
    assert subword.scored(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        subword.fit(docs, labels.limit(0))


def test_labelled_sample_is_not_ended_by_a_long_text(spark):
    docs = spark.createDataFrame([(i, "a" * (7000 if i % 2 else 10)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(40)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", F.lit(True), 40, 6400).collect()
    assert {r.doc_id for r in got} == set(range(0, 40, 2)) and all(r.y == r.doc_id % 3 % 2 for r in got)
    assert len(labelled_sample(docs, labels, "quality", F.lit(True), 40, 7200).collect()) == 21


def test_subword_score_is_the_average_of_features():
    shape = subword.Shape(9, 3, 4)
    model = subword.Model(shape, np.random.default_rng(1).normal(0, 1, 512).astype(np.float32), 0.3)
    for text in ["", "one", "one two two", *ODD]:
        ((buckets, shares),) = subword.features([text], subword.Words(shape))
        z = 0.3 + float((model.share[buckets].astype(float) * shares).sum())
        assert abs(model.scores([text], subword.Words(shape, model.share))[0] - 1 / (1 + np.exp(-z))) < 1e-6


def test_pivot_search_is_exact(spark):
    dice = np.random.default_rng(5)
    x = np.floor(dice.normal(0, 40, (700, 8)))
    x[100:300] = x[100]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1050, [1.0, None]), (1100, [float("nan")]), (1150, [float("inf")]), (None, [1.0]), (1200, []), (1250, [3.0]), (7, [float(v) for v in x[7]])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("x", F.lit("a")).withColumn("score", F.lit(1))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in pivot_search.nearest(df, lambda i: i % 50 == 0, pivots=6, query_block=5, candidate_block=100).collect()}
    all_rows = [*rows, (1200, []), (1250, [3.0]), (7, list(x[7]))]
    full = [(i, np.pad(np.array(v, dtype=float), (0, 8 - len(v)))) for i, v in all_rows]
    for q, v in {i: v for i, v in full if i % 50 == 0}.items():
        best = sorted(((-float(v @ c), i) for i, c in full if i != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, int(-s)) for s, i in best]
    assert pivot_search.nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0
    assert pivot_search.nearest(df.filter("vec_id in (50, 51)"), lambda i: i % 50 == 0).count() == 1


def test_interleave_laws(spark):
    rows = [(i, f"text {i}", "hot" if i % 3 else (f"s{i % 4}" if i % 2 else None)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_bucket", F.lit(1)).withColumn("slot", F.lit("s"))
    got = interleave.interleaved(docs, shards=7, bucket_rows=50).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    sizes = [len(v) for v in by.values()]
    assert len(got) == 3000 and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    hot = [sum(r.source == "hot" for r in v) for v in by.values()]
    assert max(hot) - min(hot) <= 4  # each source is even to within one row
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in interleave.interleaved(docs.repartition(9), shards=7, bucket_rows=200).collect()}
    odd = interleave.interleaved(odd_documents(spark), shards=24).collect()
    assert len(odd) == odd_documents(spark).count() and min(r.size for r in odd) == 8
    assert interleave.interleaved(docs.limit(0)).count() == 0


def plain_components(rows, share):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        return i if up[i] == i else top(up[i])

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize(("small", "rounds"), [(512, 12), (16, 12), (16, 1)])
def test_chosen_path_equals_all_pairs(spark, small, rounds):
    dice = random.Random(small + rounds)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "one two", "ONE  two", "É x y z q", "é x y z q"]
    for group, size in ((90, 60), (40, 30), (30, 8), (20, 2)):
        for _ in range(3):
            base = [dice.choice(words) for _ in range(dice.randrange(60, 300))]
            for _ in range(size if size < 60 or not group else size):
                copy = list(base)
                for _ in range(dice.randrange(4)):
                    copy[dice.randrange(len(copy))] = dice.choice(words)
                texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("node", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosen_path.components(docs, share=85, small=small, rounds=rounds, parts=4).collect()}
    assert got == plain_components(rows, 85)


def test_chosen_path_odd_rows(spark):
    got = chosen_path.components(odd_documents(spark), parts=2).collect()
    assert len(got) == odd_documents(spark).count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].component_id == 4 and by_id[0].n_shingles == 0 and by_id[0].kept and by_id[None].component_id is None
    assert chosen_path.components(odd_documents(spark).limit(0), parts=2).count() == 0


def passage(dice, sentences=9):
    return " ".join(" ".join("".join(dice.choice("abcdefgh") for _ in range(6)) for _ in range(7)) + "." for _ in range(sentences))


def test_near_dedup_decides_by_row(spark):
    dice = random.Random(13)
    a, b, c = (passage(dice, 12) for _ in range(3))
    rows = [(1, a), (None, a), (None, b), (None, ""), (None, None), (7, f"{a} one more word"), (7, c), (7, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (None, b), (None, ""), (None, None), (7, c), (7, c)], key=str)


def test_chosen_path_links_rows_without_an_id(spark):
    dice = random.Random(14)
    a, b = passage(dice, 12), passage(dice, 12)
    rows = [(None, f"{a} x"), (None, f"{a} y"), (9, f"{a} z"), (None, f"{b} x"), (None, f"{b} y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in chosen_path.components(docs, parts=2).collect()}
    assert got == {(None, 81, 9, False), (9, 81, 9, True), (None, 81, None, True)}


def test_line_chunks_cut_repeated_passages(spark):
    dice = random.Random(4)
    shared = passage(dice)
    texts = [f"{passage(dice, 3)}\n{passage(dice, 2)} {shared} {passage(dice, 2)}\n{passage(dice, 2)}" for _ in range(12)] + [passage(dice, 6) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("_lines", F.lit(2))
    found = line_chunks.repeats(docs)
    for r in found.collect():
        assert " ".join(texts[r.doc_id][r.start : r.start + r.length].split()) in " ".join(texts[r.kept_doc_id].split())
    after = {r.doc_id: r for r in line_chunks.without_repeats(docs, found).collect()}
    assert after[0].text == texts[0] and all(after[i].text == texts[i] for i in range(12, 24))
    middle = shared.split(". ")
    for i in range(1, 12):
        left = sum(s.rstrip(".") in after[i].text for s in middle)
        assert left <= 4 and after[i]._llm_cut > 0 and after[i].hash == 1
        own = [s for s in texts[i].replace("\n", " ").split(". ") if s.rstrip(".") not in shared and shared[:20] not in s]
        assert all(s.rstrip(".") in after[i].text for s in own)
    assert line_chunks.repeats(docs.limit(0)).count() == 0


def spread_passage(dice, shared):
    """A document with `shared` between foreign sentences of its own."""
    return f"{passage(dice, dice.randrange(3, 9))} {shared} {passage(dice, dice.randrange(3, 9))}"


@pytest.mark.parametrize("sentences", [2, 3, 4, 5, 6])
def test_line_chunks_cut_every_short_passage(spark, sentences):
    """Whole sentences: all of them go. Word-level ends: all but the two broken sentences go."""
    dice = random.Random(sentences)
    shared = [passage(dice, sentences) for _ in range(40)]
    texts = [spread_passage(dice, s) for s in shared for _ in range(2)]
    words = [passage(dice, sentences + 1).split(" ") for _ in range(40)]
    broken = [w[3:-3] for w in words]
    few = lambda: " ".join("".join(dice.choice("abcdefgh") for _ in range(6)) for _ in range(4))
    texts += [spread_passage(dice, f"{few()} {' '.join(b)} {few()}.") for b in broken for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    after = {r.doc_id: r.text for r in line_chunks.without_repeats(docs, line_chunks.repeats(docs)).collect()}
    for k in range(80):
        assert after[2 * k] == texts[2 * k]
    for k, s in enumerate(shared):
        assert after[2 * k + 1] == texts[2 * k + 1].replace(s + " ", "")
    for k, b in enumerate(broken):
        own = " ".join(b).split(". ")
        assert [s in after[81 + 2 * k] for s in own[1:-1]] == [sentences < 3] * (sentences - 1)


def test_line_chunks_cross_block_edges(spark):
    dice = random.Random(11)
    long = [passage(dice, 1) for _ in range(400)]
    copies = [" ".join(long), " ".join([passage(dice, 1), *long]), " ".join([*(passage(dice, 1) for _ in range(62)), *long[63:65], passage(dice, 3)])]
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    found = line_chunks.repeats(docs)
    assert sorted((r.doc_id, r.size, r.kept_doc_id, r.kept_start) for r in found.collect()) == [(1, 400, 0, 0), (2, 2, 0, len(" ".join(long[:63])) + 1)]
    after = {r.doc_id: r.text for r in line_chunks.without_repeats(docs, found).collect()}
    assert after[0] == copies[0] and after[1] == copies[1][: len(copies[1]) - len(copies[0])] and after[2] == copies[2].replace(" ".join(long[63:65]) + " ", "")


def test_line_chunks_touch_only_the_text_they_were_found_in(spark):
    dice = random.Random(12)
    shared, other = passage(dice, 4), passage(dice, 4)
    rows = [(None, spread_passage(dice, shared)), (None, passage(dice, 30)), (None, spread_passage(dice, other)), (None, passage(dice, 40))]
    rows += [(5, spread_passage(dice, shared)), (5, passage(dice, 30)), (5, spread_passage(dice, other)), (6, None), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.lit("x"))
    found = line_chunks.repeats(docs)
    after = line_chunks.without_repeats(docs, found)
    want = [(i, t.replace(f"{shared} ", "").replace(f"{other} ", "") if i == 5 else t) for i, t in rows]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in after.collect()), key=order) == sorted(want, key=order)
    assert found.count() == 2


def test_line_chunks_odd_rows(spark):
    docs = odd_documents(spark)
    found = line_chunks.repeats(docs)
    after = line_chunks.without_repeats(docs, found)
    assert after.count() == docs.count() and after.columns == [*docs.columns, "_llm_cut"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in after.collect():
        assert (r.text == texts[r.doc_id]) == (r._llm_cut == 0)
    assert texts[0] is None and {r.doc_id for r in after.filter("_llm_cut > 0").collect()} <= {4, 5, 7}


def plain_distance(p, t):
    before = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        now = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            now[j] = min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (p[i - 1] != t[j - 1]))
        before = now
    return min(before), before.index(min(before))


def test_myers_equals_the_table():
    dice = random.Random(6)
    for _ in range(500):
        p, t = "".join(dice.choice("abc") for _ in range(dice.randint(1, 12))), "".join(dice.choice("abcd") for _ in range(dice.randint(0, 20)))
        assert edit_match.myers(edit_match.masks(p), len(p), t) == plain_distance(p, t)


def test_edit_match_finds_edited_items(spark):
    dice = random.Random(7)
    items = [passage(dice, 4) for _ in range(8)]
    texts = []
    for k in range(60):
        item, edits = list(edit_match.plain(items[k % 8])), k % 16
        for _ in range(edits):
            at = dice.randrange(len(item))
            item[at : at + 1] = dice.choice([[], ["x"], [item[at], "y"]])
        texts.append(f"{passage(dice, 2)}\n{''.join(item).upper()}  {passage(dice, 2)}")
    texts += [passage(dice, 5) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("hits", F.lit(1)).withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "tiny"), (53, items[0])], "item_id long, text string")
    got = {}
    for r in edit_match.leaks(docs, bench, block_chars=500).collect():
        got.setdefault((r.doc_id, r.item_id), r)
    for k, t in enumerate(texts[:60]):
        item, t = edit_match.plain(items[k % 8]), edit_match.plain(t)
        distance, _ = plain_distance(item, t)
        assert ((k, k % 8) in got) == (distance <= edit_match.budget(len(item), 0.06, 16))
        if r := got.get((k, k % 8)):
            assert r.distance == distance and plain_distance(item, t[r.start : r.start + r.length])[0] == distance
    assert not [k for k in got if k[0] >= 60] and (0, 53) in got
    clean = edit_match.without_leaks(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(80)) - {d for d, _ in got}
    assert edit_match.leaks(docs.limit(0), bench).count() == 0 and edit_match.without_leaks(docs, bench.limit(0)).count() == 80
    assert edit_match.leaks(odd_documents(spark), bench).count() == 0


def test_edit_match_finds_short_items_at_word_bounds(spark):
    texts = ["so: What is  PI? yes", "what is pi", "what is pie?", "somewhat is pi?", "what is pi?", "nothing", "somewhat is pi? what is pi?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "What is pi?"), (2, " "), (3, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.length, r.distance) for r in edit_match.leaks(docs, bench).collect())
    assert got == [(0, 1, 4, 11, 0), (4, 1, 0, 11, 0), (6, 1, 16, 11, 0)]
    assert {r.doc_id for r in edit_match.without_leaks(docs, bench).collect()} == {1, 2, 3, 5}


def test_packing_leaves_a_small_table_in_the_worker(spark, monkeypatch):
    """Hundreds of thousands of different words, as invented names and numbers: what stays when the task is over, and the ids."""
    import pyarrow as pa
    from pyspark import TaskContext

    made, words = [], [f"{a}{b:05}" for a in ("ka", "lor", "tesch") for b in range(100_000)]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, work, schema: work)
    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    encoder = packing.piece_encoder
    monkeypatch.setattr(packing, "piece_encoder", lambda *args: made.append(encoder(*args)) or made[-1])
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 10)), pa.array(texts[i : i + 10])], names=["doc_id", "text"]) for i in range(0, len(texts), 10)]
    rows = sorted((r for out in packing.pack(docs, WORD)(batches) for r in out.to_pylist()), key=lambda r: (r["doc_id"], r["start"]))
    (coder,) = made
    assert len(coder.memo) + len(coder.older) < 280_000  # two tables, and the words of the slices that filled them
    ids = {i: b"".join(r["ids"] for r in rows if r["doc_id"] == i) for i in (0, 150, 299)}
    assert ids == {i: coder.whole(texts[i]) + (1).to_bytes(4, "little") for i in ids}


def test_packing(spark):
    docs, coder = odd_documents(spark), Tokenizer.from_file(WORD)
    pieces = packing.pack(docs.repartition(3), WORD, piece=512, block=16).collect()
    whole = {}
    for r in docs.filter("doc_id is not null").collect():
        whole[r.doc_id] = [*coder.encode(r.text or "", add_special_tokens=False).ids, 1]
    by_doc, by_window = {}, {}
    for r in pieces:
        by_window.setdefault(r.sequence_id, []).append(r)
        if r.doc_id is not None and r.doc_id != 5:
            by_doc.setdefault(r.doc_id, []).append(r)
    for i, found in by_doc.items():
        found = sorted(found, key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in found]).tolist() == whole[i] and found[0].doc_tokens == len(whole[i])
        assert [r.start for r in found] == [sum(x.length for x in found[:k]) for k in range(len(found))]
    for found in by_window.values():
        found = sorted(found, key=lambda r: r.offset)
        assert [r.offset for r in found] == [sum(x.length for x in found[:k]) for k in range(len(found))] and sum(r.length for r in found) <= 2048
    assert set(by_doc) == set(whole) - {5} and sum(r.doc_id == 5 for r in pieces) == 2
    assert packing.pack(docs.limit(0), WORD).count() == 0


def test_differencing_balances():
    dice = random.Random(8)
    for _ in range(50):
        sizes = [dice.randint(1, 2048) for _ in range(dice.randint(1, 60))]
        found = packing.packed(sizes, 2048)
        assert sorted(i for w in found for i in w) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= 2048 for w in found)
    sums = [sum(w) for w in ([8 * [1] + [2], [10]])]
    assert sums == [10, 10] and sorted(sum([4, 5, 6, 7, 8][i] for i in w) for w in packing.differenced([4, 5, 6, 7, 8], 2)) in ([14, 16], [15, 15])
    assert packing.packed([], 10) == []


def test_pipeline_stages(spark, tmp_path):
    dice = random.Random(9)
    shared, item = passage(dice), passage(dice, 4)
    rows = []
    for i in range(240):
        text = passage(dice, 8)
        if i % 6 == 0:
            text = text.upper().replace(" ", "!! ")
        elif i % 6 == 1:
            text = f"{text} {shared} {passage(dice, 2)}"
        elif i % 12 == 2:
            text = f"{text}\n{item}"
        rows.append((i, text, "en", "s", len(text)))
    rows += [(300, rows[4][1], "en", "s", 1), (301, None, None, None, None), (302, "", "en", "s", 0)]
    labels = [(i, int(i % 6 != 0), 0) for i in range(0, 240, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
    ids = lambda name: {r.doc_id for r in kept[name].select("doc_id").distinct().collect()}
    good = {i for i in range(240) if i % 6} | {300, 301, 302}
    assert ids("quality") == good
    assert ids("line_dedup") == good - {300}  # nothing was left of the copy
    assert all(kept[n].columns == corpus_pipeline.COLUMNS for n in ("quality", "line_dedup", "near_dedup", "decontaminate"))
    assert sum(shared in (r.text or "") for r in kept["line_dedup"].collect()) == 1
    assert ids("near_dedup") == good - {300}
    assert ids("decontaminate") <= good - {300} and 2 not in ids("decontaminate")
    assert ids("packing") == ids("decontaminate")
