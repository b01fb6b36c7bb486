"""Text clean-up on the JVM side: whitespace, entities, tags, truncation."""

from __future__ import annotations

from pyspark.sql import Column

from crawlscope.functions.sql import F

# Characters that count as blanks besides ASCII whitespace.
BLANKS = "[ ​‌‍﻿]"
# Whitespace as the HTML world sees it (Java's \s is ASCII only).
#: Most characters are printable ASCII, which the first half of each class turns away at once.
SPACE = r"[[^!-~]&&[\s   -     　﻿]]+"
ANY_BLANK = f"[[^!-~]&&[{BLANKS}{SPACE[:-1]}]]+"

# Named character references that occur in ordinary copy; &amp; is decoded last.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®",
    "&trade;": "™", "&middot;": "·", "&bull;": "•", "&hellip;": "…", "&ndash;": "–",
    "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”",
    "&laquo;": "«", "&raquo;": "»", "&euro;": "€", "&pound;": "£", "&times;": "×",
    "&amp;": "&",
}


def norm(s: Column) -> Column:
    """Collapse all runs of whitespace and invisible blanks to one space and trim."""
    return F.trim(F.regexp_replace(s, ANY_BLANK, " "))


def truncate(s: Column, n: int) -> Column:
    flat = F.trim(F.regexp_replace(s, SPACE, " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def _numeric_reference(ref: Column) -> Column:
    digits = F.regexp_extract(ref, r"&#[xX]?([0-9a-fA-F]+);", 1)
    code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def decode_entities(s: Column) -> Column:
    """Decode numeric references and the named ones above; unknown names stay as they are."""
    pieces = F.regexp_extract_all(s, F.lit(r"&#[xX]?[0-9a-fA-F]{1,6};|[^&]+|&"), F.lit(0))
    numeric = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^&#(?:[0-9]{1,6}|[xX][0-9a-fA-F]{1,6});$"), _numeric_reference(p)).otherwise(p)), "")
    out = F.when(s.contains("&#"), numeric).otherwise(s)
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.when(s.contains("&"), out).otherwise(s)


def strip_tags(s: Column) -> Column:
    return F.regexp_replace(s, r"<[^>]*>", "")


def inner_text(s: Column) -> Column:
    """Text of a markup fragment."""
    return norm(decode_entities(strip_tags(s)))


def word_count(s: Column) -> Column:
    return F.size(F.filter(F.split(s, SPACE), lambda w: w != ""))
