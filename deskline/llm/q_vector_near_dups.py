"""op6: embeddings of cosine 0.98 or more inside a label."""

from deskline.llm.common import table
from deskline.llm.registry import register
from deskline.llm.vector_near_dups import link_vectors

# Every pair inside a label, in double precision; components by reachability.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.w FROM reach r JOIN link l ON r.b = l.u),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM link GROUP BY u)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)
"""


@register("op6_pca_near_dups", ORACLE)
def op6_pca_near_dups(spark, sf_dir):
    return link_vectors(table(spark, sf_dir, "embeddings"))
