"""Corpus pipeline: language ID, near-duplicates, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. ``run`` writes
every stage's result as Parquet in the shared folder and reads it again as the next one's ``docs``.
All but the last return the columns of ``docs`` as they came, extra columns included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from deskline.llm import byte_bpe, decontam, jaccard_join, langid
from deskline.llm.common import crc32_text, prepare, small, stored, table
from deskline.llm.q_byte_bpe import rank_file

MIN_SCORE = 0.5  # a text whose best language has a smaller posterior probability is rejected
NEAR_WORDS, NEAR_PERCENT = 5, 80  # near-duplicates: 5-word n-grams, Jaccard similarity 0.8


def _free(docs: DataFrame, base: str) -> str:
    """A column name that ``docs`` does not have."""
    have = {c.lower() for c in docs.columns}
    while base in have:
        base += "_"
    return base


def _without(docs: DataFrame, key: Column, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in the one column of ``dropped``; null keys stay."""
    name = _free(docs, "_dropped")
    gone = small(stored(dropped.select(F.col(dropped.columns[0]).alias(name)).filter(F.col(name).isNotNull()).distinct(),
                        "dropped"))
    return docs.join(gone, key == F.col(name), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language: rejected are texts without a letter (null and empty ones
    too) and texts whose language is not told with a probability of MIN_SCORE.

    Learns from the rows with a language in three of four folds of ``docs``; if no row has a language
    there is nothing to tell, and every text that holds a letter stays."""
    prepare(spark)
    labelled = docs.select("doc_id", "lang", "text").filter(crc32_text(F.col("doc_id")) % 4 != 2)
    model = langid.train(labelled)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    name = _free(docs, "_language")
    told = docs.withColumn(name, langid.predict_column(F.col("text"), spark, model))
    good = (F.col(f"`{name}`.lang_pred") != "und") & (F.col(f"`{name}`.score") >= MIN_SCORE)
    return told.filter(good).select(*[F.col(f"`{c}`") for c in docs.columns])


def _text_key(docs: DataFrame) -> Column:
    """What tells (doc_id, text) apart, in the order of doc_ids: numbers as 20 digits, other types as text. Null
    for a null doc_id."""
    kind = docs.schema["doc_id"].dataType
    name = F.col("doc_id").cast("string")
    if isinstance(kind, IntegralType):
        name = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
    return F.concat(name, F.lit(":"), F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 32))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id.

    The decision is about a row's own text: rows that repeat a doc_id with other texts are judged apart.
    Of the rows of one doc_id that stay, one is kept. Rows with a null doc_id and documents without words stay."""
    prepare(spark)
    key = _text_key(docs)
    texts = docs.select(key.alias("key"), "text")
    found = jaccard_join.link_table(texts, id_col="key", width=NEAR_WORDS, percent=NEAR_PERCENT)
    kept = _without(docs, key, found.filter("component_id <> key").select("key"))
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    repeated = stored(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    rank, again = _free(docs, "_rank"), _free(docs, "_again")
    names = small(repeated.withColumnRenamed("doc_id", again))
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.hash(*[F.col(f"`{c}`") for c in docs.columns]))
    one = (kept.join(names, F.col("doc_id") == F.col(again), "left_semi").withColumn(rank, F.row_number().over(first))
           .filter(F.col(rank) == 1).drop(rank))
    return kept.join(names, F.col("doc_id") == F.col(again), "left_anti").unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window of ten words. A decision follows from the text
    alone, so rows with equal texts share it, whatever their doc_id."""
    prepare(spark)
    digest = F.sha2(F.col("text").cast("binary"), 256)
    found = decontam.decontaminate(docs.select(digest.alias("digest"), "text"), table(spark, sf_dir, "benchmark"),
                                   id_col="digest")
    return _without(docs, digest, found.filter("n_hit > 0").select("digest"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` of every document, and the SHA-256 of the decoded ids."""
    prepare(spark)
    path = rank_file()
    # Stored in between: a task that encodes and decodes at once needs two Python workers, which live on.
    encoded = stored(byte_bpe.encode_documents(docs, path).select("doc_id", "ids"), "encoded")
    out = byte_bpe.decode_documents(encoded, path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates),
          ("decontaminate", decontaminate), ("byte_bpe", encode)]

#: SQL cannot say the first stage (a learned classifier); tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
