"""Fields of permit documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopclock.functions import text as tx


def permit_decisions(documents: DataFrame) -> DataFrame:
    """``doc_id, body binary`` to format, registration and issue dates, result, and the PDF as base64.

    A PDF is passed on whole and has no fields; anything else is read as a page.
    """
    pdf = F.coalesce(tx.is_pdf(F.col("body")), F.lit(False))
    # PDFs are neither decoded nor searched.
    page = F.when(~pdf, F.col("body")).cast("string")
    marked = documents.select(
        "doc_id", "body", pdf.alias("pdf"), tx.plain_text(F.regexp_replace(page, r"^\x{FEFF}", "")).alias("plain")
    )

    def field(value):
        return F.when(~F.col("pdf"), value)

    return marked.select(
        tx.digits_only(F.col("doc_id").cast("string")).alias("doc_id"),
        F.when(F.col("pdf"), "pdf").otherwise("html").alias("format"),
        field(tx.labelled_date(F.col("plain"), tx.LABEL_REGISTERED)).alias("registered"),
        field(tx.labelled_date(F.col("plain"), tx.LABEL_ISSUED)).alias("issued"),
        field(tx.labelled_word(F.col("plain"), tx.LABEL_RESULT)).alias("result"),
        F.when(F.col("pdf"), tx.base64_text(F.col("body"))).alias("base64"),
    )


def permit_details(documents: DataFrame) -> DataFrame:
    """``doc_id, body string`` to the nomenclature text and the distinct property codes.

    List items are joined; without any, the whole markup is stripped to text. Each step is a
    column of its own, so that long replies are unescaped once.
    """
    unescaped = documents.select("doc_id", "body", tx.nomenclature_markup(F.col("body")).alias("markup"))
    listed = unescaped.select("*", tx.list_items(F.col("markup")).alias("items"))
    text = F.when(F.size("items") > 0, F.array_join("items", " | ")).otherwise(tx.unlisted_nomenclature(F.col("markup")))
    return listed.select(
        tx.digits_only(F.col("doc_id").cast("string")).alias("doc_id"),
        F.coalesce(text, F.lit("")).alias("nomenclature"),
        tx.property_codes(F.col("body")).alias("cadastral"),
    )
