"""Registered document and text queries (N1-N9) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskline import constants as K
from deskline.operators import documents as N
from deskline.plans.registry import register
from deskline.plans.sqlbits import DESK
from deskline.session import ensure_session, scratch_dir
from deskline.sources.fixtures import AS_OF_DESK, load_table, view, with_views

SMALL_CHUNK = 200

_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def _docs(spark, sf_dir):
    ensure_session(spark)
    return load_table(spark, sf_dir, "documents")


def _chunk_sql(src: str, max_len: int, key: str = "doc_id") -> str:
    """Greedy line packing as a recursive walk over each text's lines (DuckDB oracle)."""
    return f"""
, d AS (SELECT {key}, CASE WHEN a[-1] = '' THEN a[1:len(a) - 1] ELSE a END AS lines
        FROM (SELECT {key}, regexp_split_to_array(text, '{_BREAK}') AS a FROM {src}) WHERE a IS NOT NULL)
, l AS (SELECT {key}, i, line, length(line) AS n
        FROM (SELECT {key}, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM d))
, f AS (SELECT {key}, i, CASE WHEN n > {max_len} THEN 1 ELSE 0 END AS chunk, n + 1 AS cur FROM l WHERE i = 1
        UNION ALL
        SELECT l.{key}, l.i, f.chunk + CASE WHEN f.cur + l.n > {max_len} THEN 1 ELSE 0 END,
               CASE WHEN f.cur + l.n > {max_len} THEN l.n + 1 ELSE f.cur + l.n + 1 END
        FROM f JOIN l ON l.{key} = f.{key} AND l.i = f.i + 1)
, ch AS (SELECT f.{key}, f.chunk AS chunk_no, string_agg(l.line || chr(10), '' ORDER BY f.i) AS chunk
         FROM f JOIN l ON l.{key} = f.{key} AND l.i = f.i GROUP BY f.{key}, f.chunk
         UNION ALL SELECT {key}, 0, '' FROM f WHERE i = 1 AND chunk = 1)
, chunks AS (SELECT {key}, CAST(chunk_no AS INT) AS chunk_no, chunk, CAST(length(chunk) AS INT) AS chunk_chars FROM ch)
"""


@register("chunk_documents", with_views(["documents"], _chunk_sql("documents", K.CHUNK_MAX_CHARS)
                                        + "SELECT * FROM chunks", recursive=True))
def chunk_documents(spark, sf_dir):
    """N2 over every document (6000-character chunks)."""
    return N.chunk_documents(_docs(spark, sf_dir), K.CHUNK_MAX_CHARS)


@register("chunk_documents_small", with_views(["documents"], _chunk_sql("documents", SMALL_CHUNK)
                                              + "SELECT * FROM chunks", recursive=True))
def chunk_documents_small(spark, sf_dir):
    """N2 with a 200-character limit, so every text is cut and long lines stand alone."""
    return N.chunk_documents(_docs(spark, sf_dir), SMALL_CHUNK)


_DOC_TEXT = """
, dt AS (SELECT doc_id, string_agg(coalesce(text, '') || chr(10), '' ORDER BY page_no) AS text FROM policy_pages GROUP BY doc_id)
"""


@register("document_text", with_views(["policy_pages"], _DOC_TEXT + "SELECT * FROM dt"))
def document_text(spark, sf_dir):
    """Page texts joined in page order."""
    ensure_session(spark)
    return N.document_text(view(spark, sf_dir, "policy_pages"))


@register("policy_chunks", with_views(["policy_pages"], _DOC_TEXT + _chunk_sql("dt", K.CHUNK_MAX_CHARS)
                                      + "SELECT * FROM chunks", recursive=True))
def policy_chunks(spark, sf_dir):
    """N1 -> N2: policy text cut into model-sized chunks."""
    ensure_session(spark)
    return N.chunk_documents(N.document_text(view(spark, sf_dir, "policy_pages")), K.CHUNK_MAX_CHARS)


_PARSED = """
, p AS (SELECT doc_id, answer,
               CASE WHEN json_valid(answer) AND json_type(answer) = 'ARRAY'
                    THEN from_json(answer, '[{"requirement":"VARCHAR","category":"VARCHAR"}]') END AS reqs
        FROM policy_answers)
, req AS (SELECT doc_id, CAST(i - 1 AS INT) AS req_no, r.requirement AS requirement, coalesce(r.category, 'general') AS category
          FROM (SELECT doc_id, unnest(reqs) AS r, generate_subscripts(reqs, 1) AS i FROM p WHERE reqs IS NOT NULL))
"""


def _answers(spark, sf_dir):
    ensure_session(spark)
    return view(spark, sf_dir, "policy_answers")


@register("parse_requirements", with_views(["policy_answers"], _PARSED + f"""
SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS policyId, req_no, requirement AS requirementText, category,
       {DESK} AS createdUtc
FROM req
"""))
def parse_requirements(spark, sf_dir):
    """N3 + N4: requirement rows from the model answers."""
    rows, _ = N.parse_requirements(_answers(spark, sf_dir))
    return N.requirement_rows(rows, AS_OF_DESK)


@register("requirement_rejects", with_views(["policy_answers"], _PARSED + "SELECT doc_id, answer FROM p WHERE reqs IS NULL"))
def requirement_rejects(spark, sf_dir):
    """Answers that are not a JSON list (kept, not dropped)."""
    return N.parse_requirements(_answers(spark, sf_dir))[1]


@register("requirement_categories", with_views(["policy_answers"], _PARSED + " UNION ALL ".join(
    f"SELECT '{c}' AS category, CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS requirement_count FROM req"
    for c, cond in [(c, f"category = '{c}'") for c in K.REQUIREMENT_CATEGORIES]
    + [("other", "category NOT IN (" + ", ".join(f"'{c}'" for c in K.REQUIREMENT_CATEGORIES) + ")")])))
def requirement_categories(spark, sf_dir):
    """N6."""
    rows, _ = N.parse_requirements(_answers(spark, sf_dir))
    return N.requirement_categories(rows)


@register("policy_counts", with_views(["policy_answers"], _PARSED + """
SELECT d.doc_id, sha256(CAST(d.doc_id AS VARCHAR)) AS policy_id, 1 AS tenant_id,
       sha256(CAST(d.doc_id AS VARCHAR)) || '.pdf' AS filename, CAST(coalesce(c.n, 0) AS BIGINT) AS requirement_count
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM req GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""))
def policy_counts(spark, sf_dir):
    """Policy headers with their requirement counts."""
    rows, _ = N.parse_requirements(_answers(spark, sf_dir))
    return N.policy_counts(_docs(spark, sf_dir), rows)


_PARTS = f"""
, sp AS (SELECT conv_id, turn, CAST(i - 1 AS INT) AS part_no, CASE WHEN (i - 1) % 2 = 0 THEN 'text' ELSE 'code' END AS kind,
                CASE WHEN (i - 1) % 2 = 0 THEN trim(p, {_WS}) ELSE '```' || chr(10) || trim(p, {_WS}) || chr(10) || '```' END AS text
         FROM (SELECT conv_id, turn, unnest(parts) AS p, generate_subscripts(parts, 1) AS i
               FROM (SELECT conv_id, turn, regexp_split_to_array(trim(reply, {_WS}), '```(?:\\w+\\n)?') AS parts FROM model_replies)))
"""


@register("split_fences", with_views(["model_replies"], _PARTS + "SELECT * FROM sp"))
def split_fences(spark, sf_dir):
    """N7."""
    ensure_session(spark)
    return N.split_fences(view(spark, sf_dir, "model_replies"))


@register("flatten_reply", with_views(["model_replies"], _PARTS + """
SELECT conv_id, turn, string_agg(text, ' ' ORDER BY part_no) AS response_text FROM sp GROUP BY conv_id, turn
"""))
def flatten_reply(spark, sf_dir):
    """N8."""
    ensure_session(spark)
    return N.flatten_reply(view(spark, sf_dir, "model_replies"))


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@register("chat_requests", with_views(["documents"], _chunk_sql("documents", K.CHUNK_MAX_CHARS) + f"""
SELECT doc_id, chunk_no, to_json([{{'role': 'system', 'content': {_sql_str(N.EXTRACT_SYSTEM_PROMPT)}}},
                                  {{'role': 'user', 'content': chunk}}]) :: VARCHAR AS messages,
       {K.ANSWER_MAX_TOKENS} AS max_tokens, 0.0 :: DOUBLE AS temperature
FROM chunks
""", recursive=True))
def chat_requests(spark, sf_dir):
    """One request per document chunk for the offline extraction job."""
    return N.chat_requests(N.chunk_documents(_docs(spark, sf_dir), K.CHUNK_MAX_CHARS))


@register("policy_run", with_views(["policy_pages"], _DOC_TEXT + _chunk_sql("dt", K.CHUNK_MAX_CHARS) + """
, told AS (SELECT doc_id, count(*) FILTER (WHERE (doc_id + chunk_no) % 3 <> 0) * 2 AS n FROM chunks GROUP BY doc_id)
SELECT dt.doc_id, sha256(CAST(dt.doc_id AS VARCHAR)) AS policyId, CAST(coalesce(n, 0) AS BIGINT) AS requirement_count
FROM dt LEFT JOIN told USING (doc_id)
""", recursive=True))
def policy_run(spark, sf_dir):
    """The whole ingest job, replayed once, with a stand-in for the model: two requirements for two of
    three chunks and no list for the rest."""
    from deskline.plans.jobs import ingest_policies

    def answer(requests):
        text = F.concat(F.lit('[{"requirement":"part '), F.col("chunk_no").cast("string"),
                        F.lit('"},{"requirement":"x","category":"permitted"}]'))
        return requests.select("doc_id", F.when((F.col("doc_id") + F.col("chunk_no")) % 3 != 0, text)
                               .otherwise(F.lit("none")).alias("answer"))

    ensure_session(spark)
    root = scratch_dir(spark, "policy-run")
    for _ in range(2):
        out = ingest_policies(spark, root, view(spark, sf_dir, "policy_pages"), answer, AS_OF_DESK)
    return out
