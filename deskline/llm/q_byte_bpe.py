"""op10: every whole text encoded to ids and decoded again."""

import os

from pyspark.sql import functions as F

from deskline.llm import byte_bpe as B
from deskline.llm.common import table
from deskline.llm.registry import register


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a public rank file; DESKLINE_RANKS names another one."""
    if path := os.environ.get("DESKLINE_RANKS"):
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op10_byte_bpe")
def op10_byte_bpe(spark, sf_dir):
    path = rank_file()
    encoded = B.encode_documents(table(spark, sf_dir, "documents"), path)
    decoded = B.decode_documents(encoded, path)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
