"""Importing this module registers every query of the package."""

from deskline.llm import (  # noqa: F401
    q_byte_bpe, q_decontam, q_jaccard_join, q_langid, q_licenses, q_lm_scoring, q_merkle, q_prefix_trie,
    q_sharding, q_toxicity, q_url_filters, q_vector_near_dups, q_warc,
)
from deskline.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
