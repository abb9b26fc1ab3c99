"""Document and text operators.

All per-document work is row-local higher-order functions (``aggregate``, ``transform``,
``split``), so it runs inside the scan's stage with no shuffle and no Python. Only N1 groups
(pages of one document).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.constants import (
    ANSWER_MAX_TOKENS, CHUNK_MAX_CHARS, DEFAULT_REQUIREMENT_CATEGORY, REQUIREMENT_CATEGORIES,
)
from deskline.functions import json_valid, strip_json_ws, strip_ws

# Python's str.splitlines() boundaries.
LINE_BREAK = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029]"
# A code fence: three backticks and an optional language tag line (Unicode \w).
FENCE = "(?U)```(?:\\w+\\n)?"

EXTRACT_SYSTEM_PROMPT = (
    "You read insurance policy text and list its requirements. Reply with JSON only: a list of "
    "objects with the key 'requirement' and, when known, 'category' (permitted, prohibited or "
    "coverage_condition)."
)
REQUIREMENT_SCHEMA = "array<struct<requirement:string,category:string>>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- N1 -----------------------------------------------------------------------------------------
def document_text(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """Page texts in page order, each followed by a newline (a null page counts as '')."""
    return (pages.groupBy(doc)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"),
                                                      F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("_pg"))
            .select(doc, F.array_join(F.transform("_pg", lambda x: F.concat(x["t"], F.lit("\n"))), "")
                    .alias("text")))


# --- N2 -----------------------------------------------------------------------------------------
RARE_BREAKS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def split_lines(text) -> Column:
    """``str.splitlines()``: split on line boundaries, no trailing empty line; '' -> [].

    Texts holding only '\n' breaks take Java's literal single-character split; the full boundary
    regex runs only on texts that contain one of the rarer breaks (byte searches decide).
    """
    t = _c(text)
    rare = None
    for ch in RARE_BREAKS:
        rare = t.contains(ch) if rare is None else rare | t.contains(ch)
    parts = F.when(rare, F.split(t, LINE_BREAK, -1)).otherwise(F.split(t, "\n", -1))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def chunk_starts(lines, max_len: int = CHUNK_MAX_CHARS) -> Column:
    """N2 fold: the line index where each chunk starts.

    A chunk is cut before a line when ``len(buffer) + len(line) > max_len``. The fold runs over
    line *lengths* only, so no string is copied while packing.
    """
    lens = F.transform(_c(lines), lambda x: F.length(x))
    init = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("cur"), F.lit(0).alias("i"))

    def step(acc, n):
        cut = acc["cur"] + n > max_len
        return F.struct(
            F.when(cut, F.array_append(acc["starts"], acc["i"])).otherwise(acc["starts"]).alias("starts"),
            F.when(cut, n + 1).otherwise(acc["cur"] + n + 1).alias("cur"),
            (acc["i"] + 1).alias("i"))

    return F.aggregate(lens, init, step)["starts"]


def chunks_from_starts(lines, starts) -> Column:
    """Join each chunk's lines once, every line followed by its newline; a chunk with no lines is ''."""
    lines, starts = _c(lines), _c(starts)
    n_lines, n_chunks = F.size(lines), F.size(starts)

    def chunk(k):
        s = F.element_at(starts, k + 1)
        e = F.when(k + 1 < n_chunks, F.element_at(starts, F.least(k + 2, n_chunks))).otherwise(n_lines)
        body = F.array_join(F.slice(lines, s + 1, e - s), "\n")
        return F.when(e > s, F.concat(body, F.lit("\n"))).otherwise(F.lit(""))

    return F.when(n_lines > 0, F.transform(F.sequence(F.lit(0), n_chunks - 1), chunk)) \
            .otherwise(F.array().cast("array<string>"))


def chunk_documents(df: DataFrame, max_len: int = CHUNK_MAX_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Greedy line packing into chunks of at most ``max_len`` characters, as rows
    (key, chunk_no, chunk, chunk_chars).

    Lines are never split (a longer line is a chunk of its own), every line keeps its newline, a
    first line longer than the limit yields an empty first chunk (D27), and an empty text yields
    no rows. Lines and chunk starts are projected as columns in separate steps so each is computed
    once per row (expressions inside lambdas are not shared otherwise).
    """
    lined = df.select(key, split_lines(text).alias("_lines"))
    started = lined.select(key, "_lines", chunk_starts("_lines", max_len).alias("_starts"))
    return (started.select(key, F.posexplode(chunks_from_starts("_lines", "_starts")).alias("chunk_no", "chunk"))
            .select(key, F.col("chunk_no").cast("int"), "chunk", F.length("chunk").cast("int").alias("chunk_chars")))


# --- N3, N4 -------------------------------------------------------------------------------------
def parse_requirements(answers: DataFrame, key: str = "doc_id", col: str = "answer",
                       default_category: str = DEFAULT_REQUIREMENT_CATEGORY) -> tuple[DataFrame, DataFrame]:
    """N3 + N4: a model answer must be a JSON list of {requirement, category}.

    Returns (requirement rows, rejected answers). A bare object is rejected (Spark would wrap it
    into a one-element list), and so is a text that is not one whole JSON value; white space around
    the list is fine; a missing or null category becomes ``default_category``.
    """
    whole = json_valid(col) & strip_json_ws(col).startswith("[")
    parsed = F.when(whole, F.from_json(F.col(col), REQUIREMENT_SCHEMA))
    x = answers.select(key, col, parsed.alias("_reqs"))
    bad = x.filter(F.col("_reqs").isNull()).select(key, col)
    rows = (x.filter(F.col("_reqs").isNotNull())
            .select(key, F.posexplode("_reqs").alias("req_no", "r"))
            .select(key, F.col("req_no").cast("int"), F.col("r.requirement").alias("requirement"),
                    F.coalesce(F.col("r.category"), F.lit(default_category)).alias("category")))
    return rows, bad


def policy_id(key) -> Column:
    """Deterministic policy id from its key (re-runs are idempotent): sha-256 hex of the key text."""
    return F.sha2(_c(key).cast("string"), 256)


def requirement_rows(reqs: DataFrame, as_of, key: str = "doc_id") -> DataFrame:
    """PolicyRequirements rows (policyId, requirementText, category, createdUtc)."""
    ts = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    return reqs.select(key, policy_id(key).alias("policyId"), "req_no", F.col("requirement").alias("requirementText"),
                       "category", ts.alias("createdUtc"))


def policy_counts(policies: DataFrame, reqs: DataFrame, key: str = "doc_id", tenant_id: int = 1) -> DataFrame:
    """One Policies header per document plus its requirement count (0 shown)."""
    counts = reqs.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("requirement_count"))
    pid = policy_id(key)
    return (policies.select(key).join(counts, key, "left")
            .select(key, pid.alias("policy_id"), F.lit(tenant_id).alias("tenant_id"),
                    F.concat(pid, F.lit(".pdf")).alias("filename"),
                    F.coalesce(F.col("requirement_count"), F.lit(0).cast("bigint")).alias("requirement_count")))


def policy_headers(documents: DataFrame, as_of, key: str = "doc_id", tenant_id: int = 1) -> DataFrame:
    """Policies rows (id, tenantId, filename, uploadedUtc), one per document."""
    ts = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    pid = policy_id(key)
    return documents.select(pid.alias("id"), F.lit(tenant_id).alias("tenantId"),
                            F.concat(pid, F.lit(".pdf")).alias("filename"), ts.alias("uploadedUtc"))


# --- N6 -----------------------------------------------------------------------------------------
def requirement_categories(reqs: DataFrame, vocabulary: Sequence[str] = REQUIREMENT_CATEGORIES) -> DataFrame:
    """Tally over the vocabulary plus 'other', zero-filled."""
    cats = list(vocabulary) + ["other"]
    cat = F.when(F.col("category").isin(list(vocabulary)), F.col("category")).otherwise(F.lit("other"))
    sums = reqs.agg(*[F.count_if(cat == c).cast("bigint").alias(c) for c in cats])
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(c).alias("requirement_count")) for c in cats])).alias("x")) \
        .select("x.*")


# --- N7, N8 -------------------------------------------------------------------------------------
def reply_parts(text) -> Column:
    """Alternate text / code parts split on code fences; each trimmed, code re-fenced."""
    parts = F.split(strip_ws(text), FENCE, -1)
    return F.transform(parts, lambda p, i: F.struct(
        i.cast("int").alias("part_no"),
        F.when(i % 2 == 0, F.lit("text")).otherwise(F.lit("code")).alias("kind"),
        F.when(i % 2 == 0, strip_ws(p)).otherwise(F.concat(F.lit("```\n"), strip_ws(p), F.lit("\n```"))).alias("text")))


def split_fences(df: DataFrame, keys: Sequence[str] = ("conv_id", "turn"), col: str = "reply") -> DataFrame:
    """N7 as rows (keys..., part_no, kind, text)."""
    return df.select(*keys, F.explode(reply_parts(col)).alias("p")).select(*keys, "p.part_no", "p.kind", "p.text")


def flatten_reply(df: DataFrame, keys: Sequence[str] = ("conv_id", "turn"), col: str = "reply") -> DataFrame:
    """The rendered parts of one reply joined with a blank, inside the row (no regrouping)."""
    return df.select(*keys, F.array_join(F.transform(reply_parts(col), lambda p: p["text"]), " ").alias("response_text"))


# --- N9 -----------------------------------------------------------------------------------------
def chat_requests(chunks: DataFrame, keys: Sequence[str] = ("doc_id", "chunk_no"), col: str = "chunk",
                  system_prompt: str = EXTRACT_SYSTEM_PROMPT, max_tokens: int = ANSWER_MAX_TOKENS,
                  temperature: float = 0.0) -> DataFrame:
    """One chat request per chunk (system + user message) for an offline batch-inference job;
    answers come back as a table and go through N3."""
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
                   F.struct(F.lit("user").alias("role"), F.col(col).alias("content")))
    return chunks.select(*keys, F.to_json(msgs).alias("messages"), F.lit(max_tokens).alias("max_tokens"),
                         F.lit(float(temperature)).alias("temperature"))


def prompt_request(prompts: DataFrame, col: str = "prompt") -> Column:
    """N9 for a bare prompt: a single user message."""
    return F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col(col).alias("content"))))
