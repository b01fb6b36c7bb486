"""The whole of the line operator against a plain version that keeps every chunk in memory."""

import random
import re
from collections import defaultdict

import pytest

from crawlscope.llm import line_chunks


def plain_lines(text):
    """(start, line with the blank or break that ends it)."""
    lines, start = [], 0
    for m in re.finditer(r"[.!?] |\n", text):
        lines.append((start, text[start : m.end()]))
        start = m.end()
    return [*lines, (start, text[start:])]


def runs(rows, key):
    """Rows of one key whose lines follow one another, with the bytes they cover."""
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["line"]):
        groups[key(r)].append(r)
    for k, group in groups.items():
        run = []
        for r in group:
            if run and r["line"] != run[-1]["line"] + 1:
                yield k, run
                run = []
            run.append(r)
        yield k, run


def plain_repeats(texts, least_bytes):
    rows = []
    for doc, text in texts.items():
        lines = plain_lines(text) if text else []
        for i in range(len(lines) - 1):
            both = lines[i][1] + lines[i + 1][1]
            head, ended = len(lines[i][1].encode()), re.search(r"([.!?] |\n)\Z", lines[i + 1][1])
            chunk = both[: len(both) - bool(ended)].replace("\n", " ")
            rows.append({"doc": doc, "line": i, "start": lines[i][0], "end": lines[i][0] + len(both), "chunk": chunk, "head": head, "tail": len(chunk.encode()) - head})
    first, last, met = {}, {}, []
    for r in rows:  # in order of ids and lines
        kept = first.setdefault(r["chunk"], r)
        if kept is not r:
            met.append(r | {"kept": kept, "before": last.get((r["doc"], r["chunk"]))})
        last[r["doc"], r["chunk"]] = r
    size = lambda run: sum(r["head"] for r in run) + run[-1]["tail"]
    out = defaultdict(list)
    for (_, kept_doc, shift), run in runs(met, lambda r: (r["doc"], r["kept"]["doc"], r["line"] - r["kept"]["line"])):
        for r in run if size(run) >= least_bytes else []:
            r["done"] = True
            out[r["doc"], True, kept_doc, shift, run[0]["line"]].append((r, r["kept"]))
    for (doc, shift), run in runs([r for r in met if r["before"]], lambda r: (r["doc"], r["line"] - r["before"]["line"])):
        for r in run if size(run) >= least_bytes else []:
            if "done" not in r:
                out[doc, False, doc, shift, run[0]["line"]].append((r, r["before"]))
    found = []
    for (doc, _, kept_doc, _, _), pairs in out.items():
        start, lines = min(r["start"] for r, _ in pairs), [r["line"] for r, _ in pairs]
        found.append((doc, start, max(r["end"] for r, _ in pairs) - start, max(lines) - min(lines) + 2, kept_doc, min(k["start"] for _, k in pairs)))
    return sorted(found)


def plain_cut(text, spans):
    gone = {i for start, length in spans for i in range(start, start + length)}
    return "".join(c for i, c in enumerate(text) if i not in gone)


@pytest.mark.parametrize(("block", "least_bytes"), [(64, 40), (4, 40), (3, 1)])
def test_repeats_equal_the_plain_version(spark, monkeypatch, block, least_bytes):
    monkeypatch.setattr(line_chunks, "BLOCK", block)
    dice = random.Random(block)
    known = [" ".join("".join(dice.choice("abcdé") for _ in range(dice.randrange(1, 6))) for _ in range(dice.randrange(1, 7))) for _ in range(60)]
    line = lambda: dice.choice(known) + dice.choice([". ", "! ", "? ", "\n", ".\n", "  ", ".  "])
    passages = ["".join(line() for _ in range(dice.randrange(1, 9))) for _ in range(12)]
    texts = {}
    for doc in range(90):
        parts = [dice.choice(passages) if dice.random() < 0.4 else line() for _ in range(dice.randrange(0, 14))]
        texts[doc] = "".join(parts) + dice.choice(["", "", "end", "\n"])
    texts |= {90: None, 91: "", 92: "one line. " * 30, 93: "a. b. " * 40, 94: "\n" * 20, 95: texts[3], 96: texts[3]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = line_chunks.repeats(docs, least_bytes=least_bytes)
    got = sorted((r.doc_id, r.start, r.length, r.size, r.kept_doc_id, r.kept_start) for r in found.collect())
    want = plain_repeats(texts, least_bytes)
    assert len(want) > 100 and got == want
    after = {r.doc_id: r.text for r in line_chunks.without_repeats(docs, found).collect()}
    assert after == {d: t and plain_cut(t, [(s, n) for i, s, n, *_ in want if i == d]) for d, t in texts.items()}
