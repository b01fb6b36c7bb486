"""Removal of repeated passages by chunks of neighbouring lines, with DataFrame functions only.

A text is taken as lines; lines of prose are divided after sentence ends too, so a passage is found wherever line breaks fall. Every
`least_lines` neighbouring lines are a chunk, so whatever stands before or after a passage, all chunks inside it are met in each of
its copies. Chunks are counted over all documents; of a repeated chunk the first occurrence (smallest id, then place) stays and the
others are removed, after their bytes, but for the ends of lines, were compared with the first's. Chunks that follow one another
here and in the kept text are one stretch, which so reaches as far as whole lines agree; stretches under `least_bytes` stay. Text
that repeats itself at once (a line again and again) is held against its own occurrence before too. A removed line always has an
equal line that is kept.

What is counted holds hashes and places only. Texts are joined by document; a chunk's occurrences are never gathered. Long texts are
taken in blocks of lines, each with the lines after it that its last chunks reach into, so no chunk is lost at an edge.

Cases: null and empty texts have no chunks and pass through as they are; a document is an id and a hash of the text, so rows that
share an id, or have none, are cut each by its own text, and only those with equal texts count as one document and are cut alike; a
null id is smaller than all, and of one id the smaller hash comes first; an empty table gives no rows; other columns pass through `without_repeats`.
Of a passage that begins or ends within a line, the whole lines go; what repeats of the broken lines stays.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.llm.common import written

#: Lines of a text that are looked at together.
BLOCK = 64
#: Where a line ends; the last character of each may be left out.
ENDS = (". ", "! ", "? ", "\n")
#: Stands between lines; in a text it is taken as a blank.
MARK = "\1"


def marked(text: Column, ends: bool = True) -> Column:
    """The text with a mark after each line, or, without `ends`, in place of the blank or line break that ends it."""
    text = F.replace(text, F.lit(MARK), F.lit(" "))
    for end in ENDS:
        text = F.replace(text, F.lit(end), F.lit((end if ends else end[:-1]) + MARK))
    return text


def plain(text: Column) -> Column:
    """Line breaks as blanks: what chunks are compared by."""
    return F.replace(text, F.lit("\n"), F.lit(" "))


def ended(line: Column) -> Column:
    """Whether a line has the blank or line break that ends it: all but the last of a text have."""
    return reduce(or_, [F.endswith(line, F.lit(end)) for end in ENDS])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and text of the rows with text: the first two name a document."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"), docs["text"].alias("text")).filter("length(text) > 0")


def chunks(docs: DataFrame, least_lines: int) -> DataFrame:
    """hash, doc_id, text_hash and line (from 0) of every `least_lines` neighbouring lines.

    Texts with fewer lines give a null list, and `outer` keeps Spark from testing the list's size first, which would divide each text twice.
    """
    every = keyed(docs).select("doc_id", "text_hash", F.transform(F.split(marked(F.col("text"), ends=False), MARK), lambda x: F.xxhash64(x)).alias("_h"))
    last = F.size("_h") - (least_lines - 1)
    hashes = F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice("_h", i, least_lines))))
    return every.select("doc_id", "text_hash", F.posexplode_outer(hashes).alias("line", "hash")).filter("hash IS NOT NULL")


def blocks(docs: DataFrame, least_lines: int) -> DataFrame:
    """doc_id, text_hash, block, base (characters before it) and lines (marked text) of every `BLOCK` lines and those their last chunks reach into.

    Only texts with more lines than a block are divided here; all else travels as one string.
    """
    rows = keyed(docs).select("doc_id", "text_hash", marked(F.col("text")).alias("_text"))
    n = F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit(MARK), F.lit("")))
    rows = rows.select("doc_id", "text_hash", "_text", F.when(n >= BLOCK, F.split("_text", MARK)).alias("_all"))
    one = F.array(F.struct(F.lit(0).alias("block"), F.lit(0).cast("long").alias("base"), F.col("_text").alias("lines")))
    several = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / BLOCK).cast("int")),
        lambda b: F.struct(
            b.alias("block"),
            F.aggregate(F.slice("_all", F.greatest((b - 1) * BLOCK + 1, F.lit(1)), F.when(b > 0, BLOCK).otherwise(0)), F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("base"),
            F.array_join(F.slice("_all", b * BLOCK + 1, BLOCK + least_lines - 1), MARK).alias("lines"),
        ),
    )
    several = F.aggregate(  # characters of the block before, summed
        several, F.array().cast("array<struct<block:int,base:bigint,lines:string>>"),
        lambda done, x: F.concat(done, F.array(F.struct(x["block"].alias("block"), (x["base"] + F.coalesce(F.get(done, F.size(done) - 1)["base"], F.lit(0))).alias("base"), x["lines"].alias("lines")))),
    )
    return rows.select("doc_id", "text_hash", F.explode_outer(F.when(F.col("_all").isNull(), one).otherwise(several)).alias("_b")).select("doc_id", "text_hash", "_b.block", "_b.base", "_b.lines")


def stretches(same: DataFrame, least_lines: int, least_bytes: int) -> DataFrame:
    """Repeated chunks joined where they follow one another in both texts.

    A chunk is held against the kept one, or, if that gives less than `least_bytes`, against the one before it in its own text.
    """
    again = Window.partitionBy("doc_id", "text_hash", "hash").orderBy("line")
    own = F.when(F.col("_own"), F.col("kept_line")), F.when(F.col("_own"), F.col("kept_start"))
    rows = same.repartition("doc_id", "text_hash").dropDuplicates(["doc_id", "text_hash", "line"]).withColumns({"_line": F.coalesce(F.lag("line").over(again), own[0]), "_start": F.coalesce(F.lag("start").over(again), own[1])})
    for name, keys, other in (("_a", ["doc_id", "text_hash", "kept_doc_id", "kept_text_hash"], "kept_line"), ("_b", ["doc_id", "text_hash"], "_line")):
        rows = rows.withColumn(f"{name}_shift", F.col("line") - F.col(other))
        keys = [*keys, f"{name}_shift"]
        rows = rows.withColumn(f"{name}_run", F.col("line") - F.row_number().over(Window.partitionBy(*keys).orderBy("line")))
        run = Window.partitionBy(*keys, f"{name}_run")
        rows = rows.withColumn(f"{name}_bytes", F.sum("_head").over(run) + F.max_by("_tail", "line").over(run))
    first = F.col("_a_bytes") >= least_bytes
    rows = rows.filter(first | (F.col("_b_shift").isNotNull() & (F.col("_b_bytes") >= least_bytes)))
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    rows = rows.select(
        "doc_id", "text_hash", "line", "start", (F.col("start") + F.col("length")).alias("_end"), first.alias("_first"),
        pick("kept_doc_id", "doc_id").alias("kept_doc_id"), pick("kept_text_hash", "text_hash").alias("kept_text_hash"),
        pick("kept_start", "_start").alias("kept_start"), pick("_a_shift", "_b_shift").alias("_shift"), pick("_a_run", "_b_run").alias("_run"),
    )
    out = rows.groupBy("doc_id", "text_hash", "_first", "kept_doc_id", "kept_text_hash", "_shift", "_run").agg(
        F.min("start").alias("start"), F.max("_end").alias("_end"), (F.max("line") - F.min("line") + least_lines).cast("int").alias("size"), F.min("kept_start").alias("kept_start")
    )
    return out.select("doc_id", "start", (F.col("_end") - F.col("start")).alias("length"), "size", "kept_doc_id", "kept_start", "text_hash", "kept_text_hash")


def repeats(docs: DataFrame, least_lines: int = 2, least_bytes: int = 40) -> DataFrame:
    """Repeated stretches but for the first of each: doc_id, start and length (characters), size (lines), kept_doc_id, kept_start, text_hash, kept_text_hash.

    Counts and kept chunks are written before they are joined: their shuffles are let go, and a hash that many lines share is split by Spark.
    """
    every, none = written(chunks(docs, least_lines), "chunks"), F.lit(-(1 << 63))  # no id is smaller than all
    shared = every.groupBy("hash").agg(F.count(F.lit(1)).alias("_n"), F.min(F.coalesce("doc_id", none)).alias("_first")).filter("_n > 1").drop("_n")
    met = every.join(written(shared, "repeated").hint("shuffle_hash"), "hash")
    place = F.col("line") % BLOCK * 2 + (F.coalesce("doc_id", none) == F.col("_first")).cast("int")  # the line in its block, and whether the chunk's first document has this id
    block = F.floor(F.col("line") / BLOCK).cast("int")
    by_block = met.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), block.alias("_block")).agg(F.collect_set(place).alias("_met"))  # a document's own lines, once for all rows that are this document
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")) & (F.col("block") == F.col("_block"))
    rows = blocks(docs, least_lines).join(by_block.hint("shuffle_hash"), own).select("doc_id", "text_hash", (F.col("block") * BLOCK).alias("_line"), "base", F.split("lines", MARK).alias("_l"), "_met")
    starts = F.aggregate("_l", F.array(F.col("base")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x))))  # at most a block and a chunk
    rows = rows.withColumn("_starts", starts).select("doc_id", "text_hash", "_line", "_l", "_starts", F.explode_outer("_met").alias("_m"))
    at = F.floor(F.col("_m") / 2).cast("int")
    rows = rows.select(
        "doc_id", "text_hash", (F.col("_line") + at).alias("line"), F.get("_starts", at).alias("start"), (F.col("_m") % 2 == 1).alias("_own"),
        F.octet_length(F.get("_l", at)).alias("_head"), F.array_join(F.slice("_l", at + 1, least_lines), "").alias("_text"), ended(F.get("_l", at + (least_lines - 1))).alias("_ended"),
    )
    length = F.length("_text")
    chunk = plain(F.left(F.col("_text"), length - F.col("_ended").cast("int")))  # equal for equal lines and no others
    rows = rows.select("doc_id", "text_hash", "line", "start", "_own", "_head", length.alias("length"), chunk.alias("chunk"))
    texts = written(rows.withColumn("hash", F.xxhash64("chunk")), "chunk-texts")
    kept = texts.filter("_own").groupBy("hash").agg(F.min(F.struct("doc_id", "text_hash", "line", "start", "chunk")).alias("_k"))
    kept = kept.select("hash", F.col("_k.text_hash").alias("kept_text_hash"), F.col("_k.line").alias("kept_line"), F.col("_k.start").alias("kept_start"), F.col("_k.chunk").alias("kept_chunk"), F.col("_k.doc_id").alias("kept_doc_id"))
    same = texts.drop("_own").join(written(kept, "kept"), "hash").withColumn("_own", F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("text_hash") == F.col("kept_text_hash")))
    same = same.filter((F.col("chunk") == F.col("kept_chunk")) & ~(F.col("_own") & (F.col("line") == F.col("kept_line"))))
    same = same.withColumn("_tail", F.octet_length("chunk") - F.col("_head")).drop("chunk", "kept_chunk")
    return stretches(same, least_lines, least_bytes)


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`docs` with the repeated chunks cut out of the text; `_llm_cut` tells how many stretches went."""
    by_start = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    spans = found.select("doc_id", "text_hash", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    spans = spans.withColumn("_before", F.coalesce(F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    spans = spans.withColumn("_run", F.count_if(F.col("start") > F.col("_before")).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("doc_id", "text_hash", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    ahead = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    gaps = spans.select("doc_id", "text_hash", F.col("start").alias("to"), F.coalesce(F.lag("end").over(ahead), F.lit(0)).alias("from"), F.lead("start").over(ahead).isNull().alias("_last"), "end")
    kept = gaps.groupBy(F.col("doc_id").alias("_llm_id"), F.col("text_hash").alias("_llm_hash")).agg(
        F.array_sort(F.collect_list(F.struct("from", "to"))).alias("_llm_kept"), F.max(F.when(F.col("_last"), F.col("end"))).alias("_llm_end"), F.count(F.lit(1)).cast("int").alias("_llm_n")
    )
    joined = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_llm_id")) & (F.xxhash64("text") == F.col("_llm_hash")), "left")
    cut = F.array_join(F.transform("_llm_kept", lambda k: F.substring(F.col("text"), (k["from"] + 1).cast("int"), (k["to"] - k["from"]).cast("int"))), "")
    rest = F.substring(F.col("text"), (F.col("_llm_end") + 1).cast("int"), F.length("text"))
    text = F.when(F.col("_llm_n").isNull(), F.col("text")).otherwise(F.concat(cut, rest))
    return joined.select(*[(text if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns], F.coalesce("_llm_n", F.lit(0)).alias("_llm_cut"))
