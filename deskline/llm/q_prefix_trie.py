"""op12: the prefix trie of all conversations, rebuilt with shared beginnings."""

from pyspark.sql import functions as F

from deskline.llm.common import crc32_text, table
from deskline.llm.prefix_trie import graft_heads, placed_turns, prefix_trie
from deskline.llm.registry import register

STEP, HEADS = 100, 6  # conversations of one beginning; the fold of the number of turns taken from it

# A node is written as its turns' digests one after another, 64 characters a turn.
ORACLE = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k:
        CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS tab),
hex_ids AS (SELECT conv_id, hex(encode(conv_id::VARCHAR)) AS x FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id AS c, conv_id - conv_id % {STEP} AS b, xor(list_reduce(list_transform(range(length(x) // 2),
        lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT),
        lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {HEADS} AS h FROM hex_ids, crc),
told AS (SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS fp,
        length(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT c, fp, size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, fp) - 1 AS p FROM told),
rebuilt AS (
    SELECT ids.c, 0 AS own, t.p, t.fp, t.size FROM ids JOIN turns t ON t.c = ids.b AND t.p < ids.h
    UNION ALL
    SELECT ids.c, 1, t.p, t.fp, t.size FROM ids JOIN turns t ON t.c = ids.c AND t.p >= ids.h),
paths AS (SELECT c, row_number() OVER w AS depth, string_agg(fp, '') OVER w AS path, size FROM rebuilt
    WINDOW w AS (PARTITION BY c ORDER BY own, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    UNION ALL SELECT c, 0, '', 0 FROM ids),
last AS (SELECT c, max(depth) AS depth FROM paths GROUP BY c),
nodes AS (SELECT path, any_value(p.depth) AS depth, min(p.c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
        coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (p.depth = last.depth), '') AS ends
    FROM paths p JOIN last ON last.c = p.c GROUP BY path),
counted AS (SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND starts_with(k.path, n.path)) AS n_children
    FROM nodes n),
below AS (SELECT substr(path, 1, (64 * k)::INT) AS path, n_children, (n_convs - 1) * size AS saved
    FROM (SELECT *, unnest(range(depth + 1)) AS k FROM counted)),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM below GROUP BY path)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
    s.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n JOIN sums s ON s.path = n.path
LEFT JOIN nodes up ON n.depth > 0 AND up.path = substr(n.path, 1, (64 * (n.depth - 1))::INT)
"""


@register("op12_prefix_trie", ORACLE)
def op12_prefix_trie(spark, sf_dir):
    conv = F.col("conv")
    turns, members = graft_heads(placed_turns(table(spark, sf_dir, "conversations")), conv - conv % STEP,
                                 crc32_text(conv) % HEADS, HEADS - 1)
    out = prefix_trie(turns, members)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
