"""op8: components of documents whose 4-word n-gram sets have a Jaccard similarity of 0.85."""

from deskline.llm.common import table
from deskline.llm.jaccard_join import link_table
from deskline.llm.registry import register


@register("op8_ngram_jaccard")
def op8_ngram_jaccard(spark, sf_dir):
    return link_table(table(spark, sf_dir, "documents"), width=4, percent=85)
