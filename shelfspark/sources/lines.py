"""Text lines with positions, derived from documents: the input that a recogniser would give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import spread, table

#: DuckDB definition of located().
LOCATED = """SELECT doc_id AS page_id, ((i - 1) % 4)::INT AS attempt, (i - 1)::INT AS ordinal, t AS text, ((i - 1) // 4 * 17 + doc_id % 5)::INT AS top, ((i - 1) % 3 * 40)::INT AS "left", (10 + doc_id % 9)::INT AS height,
    ((doc_id * 31 + (i - 1) * 17) % 100)::FLOAT AS confidence FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"""


def located(spark, sf_dir: str) -> DataFrame:
    """page_id, attempt, ordinal, text, top, left, height and confidence of every line of documents.

    Of a table that is read in fewer tasks than there are cores the documents are dealt anew before they are cut.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = docs.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return rows.select(
        "page_id", (F.col("ordinal") % 4).cast("int").alias("attempt"), "ordinal", "text", F.expr("cast(ordinal div 4 * 17 + page_id % 5 as int)").alias("top"),
        (F.col("ordinal") % 3 * 40).cast("int").alias("left"), (10 + F.col("page_id") % 9).cast("int").alias("height"), ((F.col("page_id") * 31 + F.col("ordinal") * 17) % 100).cast("float").alias("confidence"),
    )
