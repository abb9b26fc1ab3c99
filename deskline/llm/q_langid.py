"""op7: language of every document, learned from three of four."""

from pyspark.sql import functions as F

from deskline.llm import langid as L
from deskline.llm.common import crc32_text, table
from deskline.llm.registry import register


@register("op7_language_id")
def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_text(F.col("doc_id")) % 4 == 2
    model = L.train(docs.filter(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"),
                       L.predict_column(F.col("text"), spark, model).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")
