"""Body bytes to text with charset sniffing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Charsets Spark decodes itself.
NATIVE = ["utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32"]


def charset_of(body: Column, content_type: Column) -> Column:
    """Header first, then a <meta charset> in the first 2 KiB, then utf-8."""
    declared = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"""(?i)charset\s*=\s*["']?([\w-]+)""", 1))
    head = F.decode(F.substring(body, 1, 2048), "ISO-8859-1")
    sniffed = F.lower(F.regexp_extract(head, r"""(?i)<meta[^>]+charset\s*=\s*["']?([\w-]+)""", 1))
    return F.coalesce(F.nullif(declared, F.lit("")), F.nullif(sniffed, F.lit("")), F.lit("utf-8"))


@F.pandas_udf(StringType())
def _decode_other(body: pd.Series, charset: pd.Series) -> pd.Series:
    def one(raw, label):
        if raw is None:
            return None
        try:
            return bytes(raw).decode(label, errors="replace")
        except LookupError:
            return bytes(raw).decode("utf-8", errors="replace")

    return pd.Series([one(b, c) for b, c in zip(body, charset)])


def decode_body(body: Column, content_type: Column) -> Column:
    """Valid UTF-8 stays on the JVM; other charsets and malformed bytes go through Arrow batches."""
    charset = charset_of(body, content_type)
    plain = (charset == "utf-8") & F.is_valid_utf8(body.cast("string"))
    return F.when(plain, body.cast("string")).otherwise(_decode_other(body, charset))
