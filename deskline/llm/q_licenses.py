"""op2: licences that the sentences of every document tell of."""

from pyspark.sql import functions as F

from deskline.llm import licenses as L
from deskline.llm.common import table
from deskline.llm.registry import register


def _oracle() -> str:
    """The same rules in SQL: the sentence table is joined, runs are matched on joined identifiers."""
    known = ", ".join(f"('{k}', '{v}')" for k, v in L.SENTENCES.items())
    steps, state = [], "run"
    for i, r in enumerate(L.RULES):
        pattern = "".join(f"<{x}>" for x in r.run)
        steps.append(f"s{i} AS (SELECT *, replace({state}, '{pattern}', '|') AS r{i}, "
                     f"list_transform(range((length({state}) - length(replace({state}, '{pattern}', ''))) // {len(pattern)}), "
                     f"lambda x: '{r.name}') AS n{i} FROM {'runs' if not i else f's{i - 1}'})")
        state = f"r{i}"
    names = ", ".join(f"n{i}" for i in range(len(L.RULES)))
    return rf"""
WITH known(identifier, sentence) AS (VALUES {known}),
cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.;!?](\s|$)|\n[ \t\r]*\n', chr(1), 'g'), '[^a-z0-9' || chr(1) || ']+', ' ', 'g'), chr(1)) AS parts FROM documents),
kept AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: trim(p)), lambda p: p <> '') AS parts FROM cut),
rows AS (SELECT doc_id, i - 1 AS i, parts[i] AS s FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM kept)),
hits AS (SELECT doc_id, string_agg('<' || identifier || '>', '' ORDER BY i) AS run,
    string_agg(i || ':' || identifier, ',' ORDER BY i) AS found FROM rows JOIN known ON s = sentence GROUP BY doc_id),
runs AS (SELECT k.doc_id, len(k.parts)::BIGINT AS n_sentences, coalesce(run, '') AS run, coalesce(found, '') AS found
    FROM kept k LEFT JOIN hits USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, n_sentences, found, array_to_string(flatten([{names}]), ',') AS licences,
    (length({state}) - length(replace({state}, '<', '')))::BIGINT AS n_left FROM s{len(L.RULES) - 1}
"""


@register("op2_licence_sentences", _oracle())
def op2_licence_sentences(spark, sf_dir):
    # The SQL above looks up whole sentences of the first lists only, and the query's results are the SQL's.
    out = L.scan(table(spark, sf_dir, "documents"), known=L.SENTENCES, rules=L.RULES, lines=False)
    found = F.array_join(F.transform("found", lambda f: F.concat(f["sentence"].cast("string"), F.lit(":"), f["identifier"])), ",")
    return out.select("doc_id", "n_sentences", found.alias("found"), F.array_join("licences", ",").alias("licences"), "n_left")
