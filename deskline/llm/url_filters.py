"""URL filters with redirect equivalence (operator 1), DataFrame functions only.

Rules decide a url by its host and path. Urls tied by redirect and canonical-link edges are one
class: connected components over the edges carry block decisions to aliases that no rule fits. An
explicit allow takes precedence twice: a url that a rule allows is never blocked through an alias,
and a class that holds an allowed url passes no block on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.llm.common import ascii_lower, stored
from deskline.llm.components import components


@dataclass(frozen=True)
class Rule:
    """``host`` fits itself and its subdomains; ``path`` fits every path that starts with it."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return ascii_lower(rest)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    head = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    slash = F.instr(head, "/")
    return F.when(slash > 0, F.substring(head, slash, F.length(head))).otherwise("")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def normal_form(url: Column) -> Column:
    """``host/path`` without scheme, query, fragment and closing slashes: what a canonical link says
    of a url that carries none. Null without a host."""
    key = F.concat(url_host(url), F.regexp_replace(url_path(url), "/+$", ""))
    return F.when(url_host(url) != "", key)


def rule_match(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (with ``text`` and ``verdict``) of the longest rule that fits, null if none does.

    Of equally long rules one that allows goes first, then the longer host."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "allow", -len(r.host), r.text))
    if not ordered:
        return F.lit(None).cast("struct<host:string,path:string,text:string,verdict:string>")
    known = F.array(*[F.struct(F.lit("." + r.host).alias("host"), F.lit(r.path).alias("path"),
                               F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict")) for r in ordered])
    dotted = F.concat(F.lit("."), host)
    return F.get(F.filter(known, lambda r: dotted.endswith(r["host"]) & path.startswith(r["path"])), F.lit(0))


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, its ``.`` and ``..`` segments taken out."""
    parts = F.slice(F.split(path, "/"), 2, F.length(path) + 1)
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda own, x: F.when(x == "..", F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))))
                       .when(x == ".", own).otherwise(F.concat(own, F.array(x))))
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(closed, "/"))


def resolved(src: Column, target: Column) -> Column:
    """``target`` as a whole url, relative ones as seen from the page ``src``: its scheme for ``//host``, its host
    for ``/path``, its path for ``?query``, else its directory, without dot segments. Null for empty
    targets, fragments, schemes without ``//`` (``mailto:``) and relative ones on a page without a host."""
    site = F.regexp_extract(src, r"^([^:/?#]*://[^/?#]+)", 1)
    page = F.regexp_extract(src, r"^([^?#]*)", 1)
    folder = F.regexp_extract(F.substring(page, F.length(site) + 1, F.length(page)), "^(.*/)", 1)
    path, rest = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when((target == "") | target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (site == ""), F.lit(None))
            .when(target.startswith("//"), F.concat(F.substring_index(src, "//", 1), target))
            .when(target.startswith("?"), F.concat(page, target))
            .otherwise(F.concat(site, _without_dots(full), rest)))


def html_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst)`` urls that pages themselves state: every ``<link rel=canonical>`` and meta refresh.

    Relative targets are resolved against the page's url (see `resolved`). Null html states nothing.
    """
    tags = F.regexp_extract_all(F.col("h"), F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    wanted = r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b|^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""
    target = F.regexp_extract("tag", r"""(?is)\b(?:href|url)\s*=\s*["']?([^"'\s>]*)""", 1)
    return (pages.select(F.col(url_col).alias("src"), F.col(html_col).alias("h"))
            .filter("src IS NOT NULL AND h IS NOT NULL")
            .select("src", F.explode(F.filter(tags, lambda t: t.rlike(wanted))).alias("tag"))
            .select("src", target.alias("t")).select("src", resolved(F.col("src"), F.col("t")).alias("dst")))


def judge(urls: DataFrame, rules: list[Rule], edges: DataFrame | None = None, id_col: str = "page_id",
          url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, ``host``, ``path``, ``rule``, ``verdict``, ``component``.

    ``edges`` (``src``, ``dst`` urls: redirects, canonical links) are added to the edge from each url
    to its normal form. A url's verdict is its rule's; without one it is that of its component
    (``component``: the smallest member): allow if a member is explicitly allowed, else block if a
    member is blocked, else ``default``. Decisions come from every url seen, edge ends included.
    Null urls and urls without ``://`` have empty host and path and no component.
    """
    own = urls.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    own = own.select("*", url_host(F.col("_url")).alias("_host"), url_path(F.col("_url")).alias("_path"))
    own = own.withColumn("_match", rule_match(F.col("_host"), F.col("_path"), rules))
    own = own.withColumn("_node", normal_form(F.col("_url")))
    # A url and its normal form are one node, so only edges between different normal forms are left to walk.
    if edges is None:
        joined = own.withColumn("_class", F.col("_node"))
        votes = joined.select("_class", F.col("_match.verdict").alias("v"))
    else:
        ends = stored(edges.select("src", "dst").distinct(), "url_edges").filter("src IS NOT NULL AND dst IS NOT NULL")
        walk = ends.select(normal_form(F.col("src")).alias("a"), normal_form(F.col("dst")).alias("b"))
        comp = components(walk.filter("a IS NOT NULL AND b IS NOT NULL"), "a", "b")
        joined = own.join(comp, own["_node"] == comp["node"], "left").withColumn(
            "_class", F.coalesce("component", "_node")).drop("node", "component")
        seen = ends.select(F.explode(F.array("src", "dst")).alias("u")).distinct()
        seen = seen.select(normal_form(F.col("u")).alias("_n"),
                           rule_match(url_host(F.col("u")), url_path(F.col("u")), rules)["verdict"].alias("v"))
        outside = seen.join(comp, seen["_n"] == comp["node"], "left").select(
            F.coalesce("component", "_n").alias("_class"), "v")
        votes = joined.select("_class", F.col("_match.verdict").alias("v")).unionByName(outside)
    # Only classes with a decision matter; min('allow', 'block') is the precedence.
    decided = votes.filter("_class IS NOT NULL AND v IS NOT NULL").groupBy("_class").agg(F.min("v").alias("_v"))
    out = joined.join(decided.withColumnRenamed("_class", "_c"), F.col("_class") == F.col("_c"), "left")
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
                      F.col("_match.text").alias("rule"),
                      F.coalesce(F.col("_match.verdict"), F.col("_v"), F.lit(default)).alias("verdict"),
                      F.col("_class").alias("component"))
