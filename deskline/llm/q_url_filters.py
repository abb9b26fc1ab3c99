"""op1: every page url judged by rules and by its redirect / canonical-link class."""

from pyspark.sql import functions as F

from deskline.llm import url_filters as U
from deskline.llm.common import table
from deskline.llm.registry import register

RULES = [U.Rule("allow", "org", "/"), U.Rule("block", "example.org", "/es/"),
         U.Rule("block", "example.org", "/en/1"), U.Rule("allow", "com", "/fr/"),
         U.Rule("block", "com", "/de/")]

# Written from the rule text: regular expressions here, substring functions on the Spark side.
ORACLE = r"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES
    ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
split AS (SELECT page_id, url, html, position('://' in url) AS mark FROM pages),
parts AS (
    SELECT page_id, url, html,
        translate(regexp_extract(CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END, '^[^/?#]*'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END, '^[^/?#]*(/[^?#]*)', 1) AS path
    FROM split),
judged AS (
    SELECT p.*, CASE WHEN host <> '' THEN host || rtrim(path, '/') END AS node,
        (SELECT {'rule': r.host || r.path, 'verdict': r.verdict} FROM rules r
         WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
         ORDER BY length(r.host || r.path) DESC, r.verdict LIMIT 1) AS hit
    FROM parts p),
tags AS (
    SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
stated AS (
    SELECT url AS src, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]*)', 1) AS dst
    FROM tags WHERE regexp_matches(tag, '(?is)^<link') AND regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b')
    UNION SELECT url, trim(regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''>]*)', 1))
    FROM tags WHERE regexp_matches(tag, '(?is)^<meta') AND regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')),
ends AS (SELECT DISTINCT a.node AS u, translate(regexp_replace(regexp_replace(s.dst, '^.*?://', ''), '[?#].*$', ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS v
         FROM stated s JOIN judged a ON a.url = s.src WHERE contains(s.dst, '://')),
both_ways AS (SELECT u, rtrim(v, '/') AS v FROM ends UNION SELECT rtrim(v, '/'), u FROM ends),
reach(a, b) AS (SELECT node, node FROM judged WHERE node IS NOT NULL
          UNION SELECT r.a, e.v FROM reach r JOIN both_ways e ON r.b = e.u),
class AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
votes AS (SELECT c.component, min(j.hit.verdict) AS v FROM judged j JOIN class c USING (node)
          WHERE j.hit IS NOT NULL GROUP BY 1)
SELECT j.page_id, j.host, j.path, j.hit.rule AS rule, coalesce(j.hit.verdict, v.v, 'allow') AS verdict, c.component
FROM judged j LEFT JOIN class c USING (node) LEFT JOIN votes v ON v.component = c.component
"""


@register("op1_url_filters", ORACLE)
def op1_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return U.judge(pages.select("page_id", "url"), RULES, U.html_edges(pages)).select(
        F.col("page_id"), "host", "path", "rule", "verdict", "component")
