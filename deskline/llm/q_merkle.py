"""op11: a Merkle manifest of all documents, with every document's proof checked."""

from pyspark.sql import functions as F

from deskline.llm.common import ascii_lower, crc32_text, table
from deskline.llm.merkle import leaf_digest, manifest, path_text
from deskline.llm.registry import register

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sql_field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# Level by level over all languages, then over their roots; proofs by looking up each run's other nodes.
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k:
        CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS tab),
ids AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, ''))) AS h FROM documents),
crcs AS (SELECT ids.*, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT),
            lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM ids, crc),
leaves AS (SELECT doc_id, lang, {_sql_leaf("text")} AS leaf,
        CASE WHEN crc % 3 = 0 THEN {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_sql_leaf("text")} END AS claim
    FROM crcs),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY lang) AS n FROM leaves),
up(l, lang, pos, n, h) AS (
    SELECT 0, lang, pos, n, leaf FROM placed
    UNION ALL
    SELECT l + 1, lang, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1
    GROUP BY l, lang, pos // 8),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(l, pos, n, h) AS (
    SELECT 0, pos, n, h FROM subroots
    UNION ALL
    SELECT l + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1
    GROUP BY l, pos // 8),
nodes AS (SELECT l, lang, pos, h, false AS high FROM up WHERE n > 1 UNION ALL SELECT l, NULL, pos, h, true FROM top WHERE n > 1),
low_runs AS (SELECT a.l, a.lang, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS left_h,
        coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS right_h
    FROM nodes a JOIN nodes b ON a.l = b.l AND a.lang IS NOT DISTINCT FROM b.lang AND a.pos // 8 = b.pos // 8
    WHERE NOT a.high AND NOT b.high GROUP BY a.l, a.lang, a.pos),
high_runs AS (SELECT a.l, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS left_h,
        coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS right_h
    FROM nodes a JOIN nodes b ON a.l = b.l AND a.pos // 8 = b.pos // 8 WHERE a.high AND b.high GROUP BY a.l, a.pos),
steps AS (
    SELECT p.lang, p.pos, r.l AS step, r.left_h, r.right_h FROM placed p
    JOIN low_runs r ON r.lang IS NOT DISTINCT FROM p.lang AND r.pos = p.pos // (8 ** r.l)::BIGINT
    UNION ALL
    SELECT p.lang, p.pos, 1000 + r.l, r.left_h, r.right_h FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
    JOIN high_runs r ON r.pos = s.pos // (8 ** r.l)::BIGINT),
paths AS (SELECT lang, pos, list([left_h, right_h] ORDER BY step) AS path FROM steps GROUP BY lang, pos),
folded AS (SELECT p.doc_id, p.leaf, s.h AS subroot, coalesce(q.path, []) AS path, p.claim,
        (SELECT h FROM top WHERE n = 1) AS root
    FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
    LEFT JOIN paths q ON q.lang IS NOT DISTINCT FROM p.lang AND q.pos = p.pos),
done AS (SELECT *, list_reduce(list_prepend([claim], path), lambda a, x: [sha256(x[1] || a[1] || x[2])])[1] AS folded_root FROM folded)
SELECT doc_id, leaf, subroot, root,
    sha256(array_to_string(list_transform(path, lambda x: x[1] || x[2]), '')) AS proof_sha256,
    folded_root, folded_root = root AS verified
FROM done
"""


@register("op11_merkle_manifest", ORACLE)
def op11_merkle_manifest(spark, sf_dir):
    def leaf(text):
        return leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])

    claimed = F.when(crc32_text(F.col("doc_id")) % 3 == 0, leaf(ascii_lower(F.col("text"))))
    out = manifest(table(spark, sf_dir, "documents"), "doc_id", "lang", leaf(F.col("text")), claimed)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(path_text(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
                      "folded_root", "verified")
