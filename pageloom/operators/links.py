"""Links of pages: extraction, rules, first rule wins, routing.

A page's links are found, filtered and made unique inside the page's own row
(an array sort, no shuffle) and then exploded.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.base import java_regex, let, strip
from ..functions.macros import fill, fixed_columns, fixed_values
from ..functions.text import strip_tags, unescape
from .dom import page_nodes
from .selectors import Selector, Wanted, node_at, outer_html, parse_selector, select_nodes, select_values, span

# One pass: comments, scripts and styles are taken whole, so anchors inside them are not seen.
_PIECE = (r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)"
          r"|a(?:rea)?\s.*?(?:</a\s*>|(?=<a(?:rea)?\s)|\z))")
# Attributes before href are taken whole, with their quoted values, so nothing in a value counts as markup.
_TO_HREF = (r"""(?:[\s/]++|(?!href\s*=)[^\s/>="']++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]*+))?+|["'=])*+"""
            r"""href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_HREF = r"(?is)^<a(?:rea)?(?=[\s/])" + _TO_HREF
_TEXT = r"""(?is)^<(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>(.*?)(?:</a\s*>|\z)"""
_BASE = r"(?is)<base(?=[\s/])" + _TO_HREF
HTML_BODY = r"(?is)^\s*(<!--.*?-->\s*)*(<!doctype html|<html)"


@dataclass(frozen=True)
class LinkRule:
    """``follow``: True follow only, False parse only, None both."""

    name: str
    match: str | None = None       # the page's own URL must match
    regex: str | None = None       # the link must match
    xpath: str | None = None       # only links inside this region
    css: str | None = None
    follow: bool | None = True
    sub: Mapping[str, str] | None = None     # {"from": regex, "to": replacement}
    pages: Mapping[str, int] | None = None   # {"start": 1, "stop": 5, "group": 1}
    vars: Mapping[str, str] = field(default_factory=dict)
    decode: bool = False           # percent escapes to readable text after the page test

    def filled(self, fixed: Mapping[str, str]) -> "LinkRule":
        """With the names in ``fixed`` filled in; an unknown ``${NAME}`` raises."""
        parts = ("match", "regex", "xpath", "css")
        return replace(self, **{p: fill(getattr(self, p), fixed, last=True) for p in parts})

    def region(self) -> Selector | None:
        if self.css:
            return parse_selector("css:" + self.css)
        return parse_selector(self.xpath) if self.xpath else None

    def page_vars(self) -> dict[str, Selector]:
        return {k: parse_selector(v) for k, v in self.vars.items() if k.isupper()}


def is_html(pages: DataFrame) -> Column:
    """By the content type where there is one, else by the start of the body."""
    if "headers" in pages.columns:
        kind = F.coalesce(F.try_element_at("headers", F.lit("content-type")),
                          F.try_element_at("headers", F.lit("Content-Type")))
        return F.lower(kind).startswith("text/html")
    return F.col("html").rlike(HTML_BODY)


def page_anchors(source: Column) -> Column:
    """``array<struct<href,text>>`` of a page's anchors by built-in functions only."""
    pieces = F.regexp_extract_all(source, F.lit(_PIECE), F.lit(0))
    found = F.transform(pieces, lambda p: F.struct(
        F.regexp_extract(p, _HREF, 1).alias("href"), F.regexp_extract(p, _TEXT, 1).alias("text")))
    found = F.filter(found, lambda a: a["href"] != "")
    return F.transform(found, lambda a: a.withField("href", unescape(strip(F.btrim(a["href"], F.lit("\"'"))))))


def region_anchors(nodes: Column, source: Column, region: Selector) -> Column:
    """The same, for anchors in or at the nodes of a region."""
    def is_anchor(i: Column) -> Column:
        n = node_at(nodes, i)
        return n["tag"].isin("a", "area") & F.try_element_at(n["attrs"], F.lit("href")).isNotNull()

    within = F.transform(select_nodes(nodes, region), lambda r: F.filter(F.concat(F.array(r), span(nodes, r)), is_anchor))
    found = F.sort_array(F.array_distinct(F.flatten(within)))
    return F.transform(found, lambda i: F.struct(
        F.try_element_at(node_at(nodes, i)["attrs"], F.lit("href")).alias("href"),
        F.regexp_extract(outer_html(node_at(nodes, i), source), _TEXT, 1).alias("text")))


def _page_base() -> Column:
    """The address that the page's references are relative to."""
    own, tag = F.col("src_url"), unescape(F.btrim(F.regexp_extract("html", _BASE, 1), F.lit("\"'")))
    given = let(urls.base_parts(own), lambda page: urls.resolve(page, tag))
    return let(F.when(F.col("html").rlike(r"(?i)<base\s"), given).otherwise(own), urls.base_parts)


def _links(anchors: Column, base: Column) -> Column:
    """Absolute address and plain text, in page order."""
    def link(a: Column, pos: Column) -> Column:
        return F.struct(pos.alias("pos"), urls.resolve(base, strip(a["href"])).alias("url"),
                        strip(unescape(strip_tags(a["text"]))).alias("text"))

    return F.filter(F.transform(anchors, link), lambda x: x["url"].rlike("^(?i:https?|file)://"))


def _apply_rule(links: Column, rule: LinkRule, index: int, sub_first: bool) -> Column:
    if rule.pages and not rule.regex:
        raise ValueError(f"rule {rule.name!r}: pages needs regex")

    def keep(url: Column) -> Column:
        test = url.rlike(java_regex(rule.regex)) if rule.regex else F.lit(True)
        return test & urls.in_page_range(url, rule.regex, **rule.pages) if rule.pages else test

    def rewrite(url: Column) -> Column:
        return urls.rewrite(url, rule.sub["from"], rule.sub["to"]) if rule.sub else url

    def final(x: Column) -> Column:
        url = x["url"] if sub_first else rewrite(x["url"])
        url = urls.decode_percent(url) if rule.decode else url
        return F.struct(url.alias("url"), x["text"].alias("text"), F.lit(index).alias("rule_idx"),
                        x["pos"].alias("pos"))

    if sub_first:
        links = F.transform(links, lambda x: x.withField("url", rewrite(x["url"])))
    if rule.regex:
        links = F.filter(links, lambda x: keep(x["url"]))
    found = F.transform(links, final)
    if not rule.match:
        return found
    return F.when(F.col("src_url").rlike(java_regex(rule.match)), found).otherwise(F.slice(found, 1, 0))


def _first_per_link(links: Column) -> Column:
    """Sorted by link, then rule and place: keep the first of each (url, text)."""
    def first(rows: Column) -> Column:
        def is_first(x: Column, i: Column) -> Column:
            before = F.get(rows, i - 1)
            same = (before["url"] == x["url"]) & (before["text"] == x["text"])
            return ~F.coalesce(same, F.lit(False))
        return F.filter(rows, is_first)
    return let(F.sort_array(links), first)


def extract_links(pages: DataFrame, rules: Iterable[LinkRule | Mapping] = (), domains: Iterable[str] = (),
                  sub_first: bool = False, keep: Iterable[str] = (), names: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per link and page; an earlier rule takes the link from later ones.

    ``match``, ``regex``, ``xpath`` and ``css`` of a rule may name what is the same for all pages:
    ``names`` (see ``fixed_columns``; by default the clock), filled in when the job is planned.
    Columns: ``src_page_id, src_url, rule, rule_idx, pos, url, text, do_follow,
    do_parse, vars`` and, if the pages have one, ``keyword``.
    """
    rules = [r if isinstance(r, LinkRule) else LinkRule(**r) for r in rules] or [LinkRule("all")]
    written = [t for r in rules for t in (r.match, r.regex, r.xpath, r.css)]
    fixed = fixed_values(pages.sparkSession, fixed_columns(F.current_timestamp()) if names is None else names, written)
    rules = [r.filled(fixed) for r in rules]
    keep = list(keep) + [c for c in ("keyword",) if c in pages.columns and c not in keep]
    inherited = F.col("vars") if "vars" in pages.columns else urls.string_map({})
    pages = pages.withColumnsRenamed({"page_id": "src_page_id", "url": "src_url"})
    if all(r.match for r in rules):  # needs only the address, so it goes below the page reader
        pages = pages.filter(F.col("src_url").rlike("|".join(f"(?:{java_regex(r.match)})" for r in rules)))

    regions = {i: r.region() for i, r in enumerate(rules)}
    var_paths = {i: r.page_vars() for i, r in enumerate(rules)}
    named = [s for s in regions.values() if s] + [s for vs in var_paths.values() for s in vs.values()]
    source = F.col("html").cast("binary")
    pages = pages.withColumn("_base", _page_base())
    base = F.col("_base")

    if named:
        wanted = Wanted.of(named, tags=["a", "area"], attrs=["href"])
        pages = pages.withColumn("_nodes", page_nodes(F.col("html"), wanted))
    nodes = F.col("_nodes") if named else None

    def new_vars(i: int) -> Column:
        found = {k: F.coalesce(F.get(select_values(nodes, s, source), F.lit(0)), F.lit(""))
                 for k, s in var_paths[i].items()}
        return urls.string_map(found)

    whole_page = [i for i, s in regions.items() if s is None]
    parts = [_apply_rule(_links(region_anchors(nodes, source, s), base), rules[i], i, sub_first)
             for i, s in regions.items() if s is not None]

    def all_rules(links: Column) -> Column:
        return F.concat(*parts, *[_apply_rule(links, rules[i], i, sub_first) for i in whole_page])

    found = let(_links(page_anchors(F.col("html")), base), all_rules) if whole_page else F.concat(*parts)
    found = _first_per_link(found)
    if domains:
        found = F.filter(found, lambda x: urls.in_domains(urls.host(x["url"]), list(domains)))
    per_rule = [F.array(*[new_vars(i) for i in range(len(rules))]).alias("_vars")] if any(var_paths.values()) else []
    out = pages.select("src_page_id", "src_url", *keep, inherited.alias("_inherited"), *per_rule, F.inline(found))

    index = F.col("rule_idx")
    routes = [(r.follow is not False, r.follow is not True) for r in rules]
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), index)
    upper = F.map_filter("_inherited", lambda k, _: k.rlike(r"\p{Lu}") & (k == F.upper(k)))
    variables = urls.merge_maps(upper, F.get("_vars", index)) if per_rule else upper
    return out.select(
        "src_page_id", "src_url", pick([r.name for r in rules]).alias("rule"), "rule_idx", "pos", "url", "text",
        pick([f for f, _ in routes]).alias("do_follow"), pick([p for _, p in routes]).alias("do_parse"),
        variables.alias("vars"), *keep)


def next_page_links(pages: DataFrame, regex: str, xpath: str | None = None, css: str | None = None,
                    start: int = 1, stop: int = 5, group: int = 1) -> DataFrame:
    """Next-page links of listing pages, for jobs without rules; such pages are parsed too."""
    page_range = {"start": start, "stop": stop, "group": group}
    return extract_links(pages, [LinkRule("pages", regex=regex, xpath=xpath, css=css, pages=page_range, follow=None)])


def first_wins(links: DataFrame) -> DataFrame:
    """The same rule for a link table. Rank 1 is cut before the shuffle (window group limit)."""
    order = Window.partitionBy("src_page_id", "url", "text").orderBy("rule_idx", "pos")
    return links.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def drop_bad_urls(links: DataFrame) -> DataFrame:
    return links.filter(~F.col("url").startswith(urls.BAD_PREFIX))


def keep_domains(links: DataFrame, domains: DataFrame) -> DataFrame:
    """Links whose host is, or lies below, a host in the table ``domains(domain)``.

    Each link meets the table by equality on its host's suffixes, in one pass over the links.
    Listed hosts below other listed ones are left out first, so a link matches once at most. A
    host with a third of all links is a hot key of a semi join, which Spark can split.
    """
    listed = domains.select(F.lower("domain").alias("_suffix")).distinct()
    above = listed.select("_suffix", F.explode(urls.host_suffixes(F.col("_suffix"))).alias("_above")).filter("_above != _suffix")
    covered = above.join(listed.toDF("_above"), "_above", "left_semi").select("_suffix")
    top = listed.join(covered, "_suffix", "left_anti")
    each = links.withColumn("_suffix", F.explode(urls.host_suffixes(urls.host(F.col("url")))))
    return each.join(top, "_suffix", "left_semi").drop("_suffix")


def request_urls(seeds: DataFrame, links: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """URLs to visit: links once per fingerprint, seeds as they are, nothing seen before."""
    from .dedup import drop_seen
    seed_rows = seeds.select("url", urls.url_sha1(F.col("url")).alias("url_sha1"))
    link_rows = links.select("url", urls.url_sha1(F.col("url")).alias("url_sha1"))
    unique = link_rows.groupBy("url_sha1").agg(F.min("url").alias("url")).select("url", "url_sha1")
    wanted = seed_rows.unionByName(unique)
    return wanted if seen is None else drop_seen(wanted, seen)
