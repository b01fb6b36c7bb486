"""Content review: deterministic observations and the gate for recorded reviewer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window

from crawlscope.functions.sql import F

from crawlscope.functions.expr import choose, let
from crawlscope.functions.text import truncate, word_count

MIN_WORDS, LONG_PAGE, SHORT_ANSWER, QUESTIONS = 30, 600, 25, 3
URL_PATTERN = r"(?i)https?://|www\."
# Fixed value: wording of figures a reviewer made up.
METRIC_PATTERN = r"(?i)\b\d+(\.\d+)?\s?(%|percent|x more|times more)|\bscore of\b|\bvisibility (score|index)\b"


def unanswered(blocks: Column, headings: Column) -> Column:
    """Question headings (at most three looked at) that little or no answer follows."""
    texts = F.transform(headings, lambda h: h["text"])
    asked = F.slice(F.filter(texts, lambda t: t.endswith("?")), 1, QUESTIONS)

    def open_ones(p: Column) -> Column:
        return F.filter(p["asked"], lambda q: let(F.array_position(p["blocks"], q).cast("int"), lambda at: (at > 0) & let(
            F.coalesce(F.get(p["blocks"], at), F.lit("")), lambda answer: (F.length(answer) < SHORT_ANSWER) | F.array_contains(p["texts"], answer))))

    return let(F.struct(asked.alias("asked"), blocks.alias("blocks"), texts.alias("texts")), open_ones)


def observations(pages: DataFrame) -> DataFrame:
    """site, page_id, area, excerpt. Input: site, page_id, page_type, title, h1, headings, author_signals, date_signals, blocks."""
    text = F.array_join("blocks", "\n")
    ready = pages.withColumn("_words", word_count(text)).filter(F.col("_words") >= MIN_WORDS)
    name = F.coalesce(F.get("h1", F.lit(0)), F.col("title"), F.col("url"))
    found = F.concat(
        F.transform(unanswered(F.col("blocks"), F.col("headings")), lambda q: F.struct(F.lit("answer_completeness").alias("area"), q.alias("excerpt"))),
        F.filter(F.array(
            F.when((F.col("page_type") == "article") & (F.size("author_signals") == 0), F.struct(F.lit("attribution").alias("area"), name.alias("excerpt"))),
            F.when((F.col("page_type") == "article") & (F.size("date_signals") == 0), F.struct(F.lit("dates").alias("area"), name.alias("excerpt"))),
            F.when((F.col("_words") > LONG_PAGE) & ~F.exists("headings", lambda h: h["level"] == 2), F.struct(F.lit("organization").alias("area"), truncate(F.array_join(F.slice("blocks", 1, 3), " "), 320).alias("excerpt"))),
        ), lambda x: x.isNotNull()),
    )
    return ready.select("site", "page_id", F.explode(found).alias("o")).select("site", "page_id", "o.*")


def answers_by_window(blocks: DataFrame) -> DataFrame:
    """Window form over a block table (page_id, pos, text): each question with the block after it."""
    following = F.lead("text").over(Window.partitionBy("page_id").orderBy("pos"))
    return blocks.withColumn("answer", following).filter(F.col("text").endswith("?"))


def _flat(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def gate(rows: DataFrame, supplied: DataFrame) -> DataFrame:
    """Accept or reject reviewer rows. `supplied`: page_id, evidence_id (as `own_evidence`), text given to the reviewer."""
    joined = rows.join(supplied.select("page_id", F.col("evidence_id").alias("own_evidence"), F.col("text").alias("own_text")), "page_id", "left")
    said = F.concat_ws(" ", "observation", "suggestion")
    verdict = choose(
        (F.col("own_evidence").isNull(), "UNKNOWN_PAGE"), (F.col("own_evidence") != F.col("evidence_id"), "UNKNOWN_EVIDENCE"),
        (~_flat(F.col("own_text")).contains(F.substring(_flat(F.col("excerpt")), 1, 60)), "EXCERPT_NOT_FOUND"),
        (said.rlike(URL_PATTERN), "CONTAINS_URL"), (said.rlike(METRIC_PATTERN), "INVENTED_METRIC"), default="ACCEPTED",
    )
    return joined.withColumn("verdict", verdict).drop("own_text", "own_evidence")


def input_budget(pages: DataFrame, max_chars: int = 40000, overhead: int = 120, floor: int = 200) -> DataFrame:
    """Even share of the reviewer's input per page of a site. Input: site, page_id, text, head_chars."""
    counts = pages.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"))
    from crawlscope.operators.skew import join_on_hot_key

    joined = join_on_hot_key(pages, counts, ["site"], ["page_id"])
    room = F.greatest(F.lit(floor), F.floor(F.lit(max_chars) / F.col("n_pages")) - F.col("head_chars") - overhead)
    return joined.withColumn("room", room).withColumns({"truncated": F.length("text") > F.col("room"), "used_chars": F.least(F.length("text"), F.col("room"))})
