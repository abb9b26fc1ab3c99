"""op4: every page written to WARC archives and read back."""

from pyspark.sql import functions as F

from deskline.llm import warc as W
from deskline.llm.common import table
from deskline.llm.registry import register

ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY d) END AS latest FROM p)
SELECT page_id, payload_bytes, d AS payload_digest, CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < latest THEN latest END AS refers_to FROM w
"""


@register("op4_warc_chunks", ORACLE)
def op4_warc_chunks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    key = pages.schema["page_id"].dataType
    manifest = W.write_archives(W.plan_records(pages), W.archive_folder(spark))
    ends = W.read_archives(manifest).filter("last")
    def number(c: str):
        return F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)").cast(key)

    whole = F.col("record_type") == "response"  # what was read tells of responses, the header of revisits
    return ends.select(
        number("record_id").alias("page_id"),
        F.when(whole, F.col("offset") + F.octet_length("data")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.col("running_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"))
