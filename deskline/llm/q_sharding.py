"""op9: all documents into eight shards of the same source mixture."""

from pyspark.sql import functions as F

from deskline.llm.common import table
from deskline.llm.registry import register
from deskline.llm.sharding import assign_shards

SHARDS, SEED = 8, 17

# crc32 by its definition: a table by rule, then one step for each byte.
ORACLE = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k:
        CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS tab),
bytes AS (SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 1 AS size,
        hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, source, size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k,
        xor(list_reduce(list_transform(range(size - 1), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT),
            lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
      FROM bytes, crc),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id, size, text_crc32) AS i,
        count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * i - 1)::DOUBLE / (2 * n)::DOUBLE, source, k, doc_id, size, text_crc32) - 1 AS place FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law,
    ((place * {SHARDS}) // total)::INT AS shard,
    (row_number() OVER (PARTITION BY (place * {SHARDS}) // total ORDER BY place) - 1)::BIGINT AS slot,
    NULL::INT AS grown_shard, source
FROM p
"""


@register("op9_sharding", ORACLE)
def op9_sharding(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.col("source").alias("mix"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
    out = assign_shards(docs, "doc_id", "source", SHARDS, SEED, carry=["size", "text_crc32", "mix"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), F.col("mix").alias("source"))
