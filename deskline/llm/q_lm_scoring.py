"""op3: log-probability of every document under a model of nine of ten."""

from pyspark.sql import functions as F

from deskline.llm.common import crc32_text, table
from deskline.llm.lm_scoring import score_documents
from deskline.llm.registry import register


@register("op3_gated_lm")
def op3_gated_lm(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), crc32_text(F.col("doc_id")) % 10 == 0)
