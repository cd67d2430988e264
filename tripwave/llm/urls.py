"""URL filters with redirect equivalence.

Host and path rules judge addresses; pages that redirect to one another or name each
other as canonical are one class of aliases, found as connected components, and a block
decision for any address of a class holds for all of it. An address that a rule allows
stays allowed: explicit allow goes before a block that was propagated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tripwave.llm.components import connected_components
from tripwave.operators.ordered import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\s[^>]*rel\s*=\s*["']?canonical[^>]*>"""
REFRESH = r"""(?is)<meta\s[^>]*http-equiv\s*=\s*["']?refresh[^>]*>"""
HREF = r"""(?is)\shref\s*=\s*["']?([^"'\s>]+)"""
CONTENT = r"""(?is)["'\s/]content\s*=\s*(?:"([^">]*)|'([^'>]*)|([^"'\s>][^\s>]*))"""
TARGET = r"""(?is)url\s*=\s*(?:"([^"]*)|'([^']*)|([^"'\s].*))"""


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, from ``path`` on. Rules become part of the plan: some hundreds are fine."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """What a URL points at: host, path and query, without scheme and fragment; NULL without a host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def resolved(link: Column, url: Column) -> Column:
    """A link target as an absolute URL, seen from the page at ``url``."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    at = F.concat(F.lit("x://"), host_of(url))
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(F.lit("x:"), link))
            .when(link.startswith("/"), F.concat(at, link)).when(link.startswith("#") | (link == ""), None)
            .when(link.startswith("?"), F.concat(at, path_of(url), link)).otherwise(F.concat(at, folder, link)))


def _quoted(text: Column, pattern: str) -> Column:
    """What ``pattern`` finds in double quotes, single quotes or none; its groups in this order."""
    return F.concat(*[F.regexp_extract(text, pattern, i) for i in (1, 2, 3)])


def links(pages: DataFrame) -> DataFrame:
    """Redirect and canonical links of the pages, from every such tag: ``address`` and ``target``, both addresses.

    The target of a refresh is what follows ``url=`` in its content, up to the closing quote.
    """
    html = F.col("html")
    canonical = F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(0)), lambda tag: F.regexp_extract(tag, HREF, 1))
    refresh = F.transform(F.regexp_extract_all(html, F.lit(REFRESH), F.lit(0)),
                          lambda tag: F.btrim(_quoted(_quoted(tag, CONTENT), TARGET), F.lit(" \t\n\f\r")))
    found = F.concat(canonical, refresh)
    rows = pages.where(html.isNotNull() & F.col("url").isNotNull()).select("url", F.explode(found).alias("link"))
    rows = rows.where("link != ''").select(address(F.col("url")).alias("address"),
                                           address(resolved(F.col("link"), F.col("url"))).alias("target"))
    return rows.where("address != target")


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct of the longest rule that fits, else NULL; of equal lengths allow goes first."""
    if not rules:
        return F.lit(None).cast("struct<length:int,allow:boolean,rule:string,verdict:string>")
    fits = F.array(*[
        F.when((F.concat(F.lit("."), host).endswith(f".{r.host}")) & path.startswith(r.path),
               F.struct(F.lit(len(r.name)).alias("length"), F.lit(r.verdict == "allow").alias("allow"),
                        F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in rules])
    return F.array_max(fits)


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every page.

    The verdict is that of the page's own rule; else ``block`` if an address that is
    equivalent by redirects or canonical links is blocked by its rule; else ``allow``.
    ``redirects`` adds links from a crawl (``url``, ``target``). A NULL url, or one without
    ``://``, has empty host and path, no rule and no aliases; NULL html has no links;
    repeated pages are judged one by one; an empty table gives no rows.
    """
    edges = links(pages)
    if redirects is not None:
        more = redirects.select(address(F.col("url")).alias("address"),
                                address(resolved(F.col("target"), F.col("url"))).alias("target"))
        edges = edges.unionByName(more.where("address != target"))
    classes = connected_components(edges, "address", "target")
    url = F.concat(F.lit("x://"), F.col("node"))
    judged = classes.withColumn("_hit", rule_of(host_of(url), path_of(url), rules))
    judged = materialize(judged.select("node", "component", (F.col("_hit.verdict") == "block").alias("blocked")))
    bad = judged.where("blocked").select("component").distinct()
    blocked = judged.join(bad, "component").select(F.col("node").alias("_address"), F.lit(True).alias("_blocked"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                        address(F.col("url")).alias("_address"))
    rows = rows.withColumn("_hit", rule_of(F.col("host"), F.col("path"), rules)).join(blocked, "_address", "left")
    verdict = F.coalesce(F.col("_hit.verdict"), F.when(F.col("_blocked"), F.lit("block")), F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("_hit.rule").alias("rule"), verdict.alias("verdict"))
