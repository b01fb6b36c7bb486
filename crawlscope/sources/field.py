"""Field records from recorded answers of a vitals service: JSON text in, typed rows with reasons out.

A body is parsed once into a VARIANT and read by path, whatever its shape: a 75th percentile may be a number or text that names one,
anything else counts as not measured. A record that can't be had is never a bad one: it is unavailable, and `reason` says why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope.operators.page_checks import vitals_grade

#: Names of the metrics and of the form factor asked for (fixed values).
METRICS = {"lcp_ms": "largest_contentful_paint", "inp_ms": "interaction_to_next_paint", "cls": "cumulative_layout_shift"}
FORM_FACTOR = "PHONE"
DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number_of(text: Column) -> Column:
    """The finite number a text names: decimal or 0x hexadecimal, blanks around it aside; an empty text is 0."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    value = (
        F.when(bare == "", 0.0)
        .when(bare.rlike(DECIMAL), bare.try_cast("double"))
        .when(bare.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(bare, 3, 64), 16, 10).try_cast("double"))
    )
    return F.when(F.abs(value) < float("inf"), value)


def p75(body: Column, metric: str) -> Column:
    at = f"$.record.metrics.{metric}.percentiles.p75"
    kind = F.schema_of_variant(F.try_variant_get(body, at, "variant"))
    plain = F.try_variant_get(body, at, "double")
    return F.when(kind == "STRING", number_of(F.try_variant_get(body, at, "string"))).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.abs(plain) < float("inf")), plain)


def day(body: Column, name: str) -> Column:
    part = lambda p: F.try_variant_get(body, f"$.record.collectionPeriod.{name}.{p}", "string")
    padded = lambda p: F.when(F.length(part(p)) < 2, F.lpad(part(p), 2, "0")).otherwise(part(p))
    return F.concat_ws("-", part("year"), padded("month"), padded("day"))


def field_records(answers: DataFrame) -> DataFrame:
    """Add available, reason, form_factor, period_first, period_last, lcp_ms, inp_ms, cls and assessment.

    Input: scope (URL or ORIGIN), key, status, error (name of a failed request), configured (false: no key for the service), stopped (why the
    run stopped before, or null), body. Reasons: NOT_CONFIGURED, STOPPED, FAILED, NO_RECORD, HTTP, with details after a colon.
    """
    rows = answers.withColumn("_body", F.try_parse_json("body"))
    status, name = F.col("status"), F.coalesce("error", F.lit("no answer"))
    reason = (
        F.when(~F.coalesce("configured", F.lit(True)), F.lit("NOT_CONFIGURED")).when(F.col("stopped").isNotNull(), F.concat(F.lit("STOPPED:"), F.col("stopped")))
        .when(F.col("error").isNotNull() | status.isNull(), F.concat(F.lit("FAILED:"), name)).when(status == 404, F.concat(F.lit("NO_RECORD:"), F.col("scope")))
        .when(~status.between(200, 299), F.concat(F.lit("HTTP:"), status.cast("string"))).when(F.col("_body").isNull(), F.lit("FAILED:SyntaxError"))
    )
    rows = rows.withColumn("reason", reason).withColumn("available", F.col("reason").isNull())
    known = lambda x: F.when(F.col("available"), x)
    body = F.col("_body")
    period = F.try_variant_get(body, "$.record.collectionPeriod", "variant").isNotNull()
    rows = rows.withColumns({
        "form_factor": known(F.coalesce(F.try_variant_get(body, "$.record.key.formFactor", "string"), F.lit(FORM_FACTOR))),
        "period_first": known(F.when(period, day(body, "firstDate"))), "period_last": known(F.when(period, day(body, "lastDate"))),
        **{c: known(p75(body, m)) for c, m in METRICS.items()},
    })
    return rows.withColumn("assessment", vitals_grade(F.col("lcp_ms"), F.col("inp_ms"), F.col("cls"))).drop("_body", "body")
