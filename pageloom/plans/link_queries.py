"""Links, URLs, fingerprints, seen set."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.macros import fixed_columns
from ..operators import dedup, links
from ..operators.links import LinkRule, extract_links
from ..operators.walk import walk, walked_pages
from .registry import Tables, query

# --- SQL pieces ------------------------------------------------------------------

ROOT = "regexp_extract(src_url, '^[^:/?#]+://[^/?#]*')"

ANCHORS = f"""
anchors AS (
  SELECT src_page_id, src_url, pos - 1 AS pos, {ROOT} || hrefs[pos] AS url, trim(texts[pos]) AS text
  FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS pos FROM (
    SELECT page_id AS src_page_id, url AS src_url,
           regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
           regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts
    FROM pages)))"""

FIRST = "row_number() OVER (PARTITION BY src_page_id, url, text ORDER BY pos) = 1"
HOST = "lower(regexp_extract({0}, '^[^:/?#]+://([^/?#:]*)', 1))"
ENCODED = "replace(replace(url_encode({0}), '%20', '+'), '~', '%7E')"


def percent_encode(expr: str) -> str:
    """Encode what is not printable ASCII, keep the rest."""
    return (f"array_to_string(list_transform(regexp_extract_all({expr}, '[\\x21-\\x7e]+|[^\\x21-\\x7e]+'), "
            "lambda t: CASE WHEN regexp_matches(t, '^[\\x21-\\x7e]') THEN t ELSE url_encode(t) END), '')")


def canonical(expr: str) -> str:
    """Canonical URL for addresses with scheme, host and no escapes."""
    path = f"regexp_extract({expr}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
    search = f"regexp_extract({expr}, '^[^?#]*[?]([^#]*)', 1)"
    pairs = f"list_transform(string_split({search}, '&'), lambda p: {{'k': split_part(p, '=', 1), 'p': p}})"
    ordered = f"array_to_string(list_transform(list_sort({pairs}), lambda s: s.p), '&')"
    return (f"lower(regexp_extract({expr}, '^[^:/?#]+://[^/?#]*')) || "
            f"CASE WHEN {path} = '' THEN '/' ELSE {percent_encode(path)} END || "
            f"CASE WHEN {search} = '' THEN '' ELSE '?' || {ordered} END")


# --- extraction and rules ----------------------------------------------------------

@query(f"""WITH {ANCHORS}
SELECT src_page_id, src_url, CAST(pos AS INTEGER) AS pos, url, text FROM anchors QUALIFY {FIRST}""")
def links_extract(t: Tables) -> DataFrame:
    return extract_links(t.pages).select("src_page_id", "src_url", "pos", "url", "text")


@query(f"""WITH {ANCHORS}, u AS (SELECT * FROM anchors QUALIFY {FIRST})
SELECT {HOST.format('url')} AS host, count(*) AS links, count(DISTINCT url) AS urls FROM u GROUP BY 1""")
def links_host_count(t: Tables) -> DataFrame:
    found = extract_links(t.pages)
    return found.groupBy(urls.host(F.col("url")).alias("host")).agg(
        F.count("*").alias("links"), F.countDistinct("url").alias("urls"))


_TWO_RULES = [LinkRule("early", regex="//[^/]*/[a-m]", xpath="//nav"), LinkRule("rest", css="nav li a")]


@query(f"""WITH {ANCHORS}, u AS (SELECT * FROM anchors QUALIFY {FIRST})
SELECT src_page_id, CASE WHEN regexp_matches(url, '//[^/]*/[a-m]') THEN 'early' ELSE 'rest' END AS rule, url, text
FROM u""")
def links_rule_first_wins(t: Tables) -> DataFrame:
    return extract_links(t.pages, _TWO_RULES).select("src_page_id", "rule", "url", "text")


@query(f"""WITH {ANCHORS}, r AS (
  SELECT *, 0 AS rule_idx FROM anchors WHERE regexp_matches(url, 't') UNION ALL
  SELECT *, 1 FROM anchors WHERE regexp_matches(url, 'e') UNION ALL
  SELECT *, 2 FROM anchors)
SELECT rule_idx, count(*) AS links FROM (
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY src_page_id, url, text ORDER BY rule_idx, pos) = 1)
GROUP BY 1""")
def links_first_wins_table(t: Tables) -> DataFrame:
    """The same rule on a table of candidate links."""
    base = extract_links(t.pages).select("src_page_id", "pos", "url", "text")
    every = base.withColumn("rule_idx", F.explode(F.array(
        F.when(F.col("url").rlike("t"), 0), F.when(F.col("url").rlike("e"), 1), F.lit(2))))
    found = links.first_wins(every.filter("rule_idx is not null"))
    return found.groupBy("rule_idx").agg(F.count("*").alias("links"))


_ROUTES = [LinkRule("lists", regex="[aeiou]$"), LinkRule("items", regex="[a-z]$", follow=False),
           LinkRule("other", follow=None)]


@query(f"""WITH {ANCHORS}, u AS (SELECT *, CASE WHEN regexp_matches(url, '[aeiou]$') THEN 'lists'
    WHEN regexp_matches(url, '[a-z]$') THEN 'items' ELSE 'other' END AS rule FROM anchors QUALIFY {FIRST})
SELECT rule, rule <> 'items' AS do_follow, rule <> 'lists' AS do_parse, count(*) AS links FROM u GROUP BY ALL""")
def links_route(t: Tables) -> DataFrame:
    return extract_links(t.pages, _ROUTES).groupBy("rule", "do_follow", "do_parse").agg(F.count("*").alias("links"))


@query(f"""WITH {ANCHORS}
SELECT src_page_id, url FROM anchors WHERE regexp_matches(src_url, '/(en|de)/[0-9]+') QUALIFY {FIRST}""")
def links_page_match(t: Tables) -> DataFrame:
    rules = [LinkRule("guarded", match=r"/(en|de)/[0-9]+")]
    return extract_links(t.pages, rules).select("src_page_id", "url")


@query(f"""WITH {ANCHORS}, u AS (SELECT *, CASE WHEN regexp_matches(url, '//[^/]*/2') AND regexp_matches(src_url, '[.]example[.]net') THEN 'dated'
    WHEN regexp_matches(url, '[a-m][^/]*$') THEN 'region' END AS rule FROM anchors)
SELECT src_page_id, rule, url, text FROM (SELECT * FROM u WHERE rule IS NOT NULL) QUALIFY {FIRST}""")
def links_rule_macros(t: Tables) -> DataFrame:
    """Rules that name the site and the clock, filled in when the job is planned."""
    names = fixed_columns(F.lit(datetime(2024, 2, 1)), site="example")
    rules = [LinkRule("dated", match=r"[.]${SITE}[.]net", regex="//[^/]*/${IMONTH}"),
             LinkRule("region", regex="[a-m][^/]*$", xpath="//nav[not(@class='${YEAR}')]//li")]
    return extract_links(t.pages, rules, names=names).select("src_page_id", "rule", "url", "text")


_DOMAINS = r"^(www|m|blog)\."


@query(f"""WITH {ANCHORS}, u AS (SELECT *, {HOST.format('url')} AS host FROM anchors QUALIFY {FIRST}),
d AS (SELECT DISTINCT regexp_replace({HOST.format('url')}, '^(www|m|blog)\\.', '') AS domain
      FROM pages WHERE regexp_matches(url, '^https://'))
SELECT host, count(*) AS links FROM u
WHERE EXISTS (SELECT 1 FROM d WHERE host = domain OR ends_with(host, '.' || domain)) GROUP BY 1""")
def links_domain_semi(t: Tables) -> DataFrame:
    secure = t.pages.filter(F.col("url").startswith("https://"))
    domains = secure.select(F.regexp_replace(urls.host(F.col("url")), _DOMAINS, "").alias("domain")).distinct()
    kept = links.keep_domains(extract_links(t.pages), domains)
    return kept.groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("links"))


@query(f"""WITH {ANCHORS}
SELECT src_page_id, url FROM anchors
WHERE regexp_matches({HOST.format('url')}, '(^|\\.)example\\.(com|org)$') QUALIFY {FIRST}""")
def links_domain_list(t: Tables) -> DataFrame:
    return extract_links(t.pages, domains=["example.com", "example.org"]).select("src_page_id", "url")


@query("""SELECT page_id, CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS BIGINT) AS page_no FROM pages
WHERE regexp_matches(url, '[?&]page=([0-9]+)')
  AND CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS BIGINT) BETWEEN 1 AND 4""")
def url_page_range(t: Tables) -> DataFrame:
    regex = r"[?&]page=([0-9]+)"
    return t.pages.filter(urls.in_page_range(F.col("url"), regex)).select(
        "page_id", urls.page_number(F.col("url"), regex).alias("page_no"))


@query(r"""SELECT page_id, regexp_replace(url, '^(https?)://([^/]+)/(\w+)/(\d+)', '\1://\2/\4?lang=\3') AS url
FROM pages""")
def url_rewrite(t: Tables) -> DataFrame:
    pattern, to = r"^(?P<s>https?)://([^/]+)/(\w+)/(\d+)", r"\g<s>://\2/\g<4>?lang=\3"
    return t.pages.select("page_id", urls.rewrite(F.col("url"), pattern, to).alias("url"))


@query(r"""SELECT page_id, url_decode(url_encode(url)) AS url FROM pages""")
def url_decode(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.decode_percent(F.url_encode("url")).alias("url"))


def _variants(t: Tables) -> DataFrame:
    """Each address and three spellings of it."""
    url = F.col("url")
    more = F.concat(F.regexp_extract(url, r"^[^#]*", 0), F.when(url.contains("?"), "&").otherwise("?"),
                    F.lit("zeta=2&alpha=&b=é#part"))
    upper = F.concat(F.upper(F.regexp_extract(url, "^[^:/?#]+://[^/?#]*", 0)),
                     F.regexp_replace(url, "^[^:/?#]+://[^/?#]*", ""))
    return t.pages.select("page_id", F.posexplode(F.array(url, upper, more, F.concat(upper, F.lit("#x")))))\
        .withColumnsRenamed({"pos": "variant", "col": "url"})


_VARIANTS_SQL = """
variants AS (SELECT page_id, unnest([0, 1, 2, 3]) AS variant, unnest([url, up, more, up || '#x']) AS url FROM (
  SELECT page_id, url, regexp_extract(url, '^[^#]*') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END
           || 'zeta=2&alpha=&b=é#part' AS more,
         upper(regexp_extract(url, '^[^:/?#]+://[^/?#]*')) || regexp_replace(url, '^[^:/?#]+://[^/?#]*', '') AS up
  FROM pages))"""


@query(f"""WITH {_VARIANTS_SQL}, c AS (SELECT page_id, variant, {canonical('url')} AS canon FROM variants)
SELECT page_id, CAST(variant AS INTEGER) AS variant, replace(canon, 'é', '%C3%A9') AS canon,
       sha1(replace(canon, 'é', '%C3%A9')) AS url_sha1 FROM c""")
def url_canonical_sha1(t: Tables) -> DataFrame:
    return _variants(t).select("page_id", "variant", urls.canonical_url(F.col("url")).alias("canon"),
                               urls.url_sha1(F.col("url")).alias("url_sha1"))


@query(r"""SELECT page_id, regexp_replace(url, '[?][^#]*', '') AS base,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'),
    lambda p: regexp_matches(p, '^[^=]*=.'))), '&') AS fields FROM pages""")
def url_query_map(t: Tables) -> DataFrame:
    split = urls.split_url(F.col("url"))
    return t.pages.select("page_id", split["base"].alias("base"), urls.query_string(split["query"]).alias("fields"))


# --- seen set --------------------------------------------------------------------------

_CUT, _NOW = datetime(2024, 1, 8), datetime(2024, 1, 10)


def _visits(t: Tables, new: bool) -> DataFrame:
    """Events as visits, those before the cut or from it on: the user number names the page, or a site of its own."""
    events = t.events.filter(F.col("ts") >= F.lit(_CUT) if new else F.col("ts") < F.lit(_CUT))
    url = F.coalesce("url", F.concat(F.lit("http://users.example/"), "user_id"))
    return events.join(t.pages.select("page_id", "url"), events.user_id * 2 == F.col("page_id"), "left").select(
        "event_id", "ts", F.concat(url, F.lit("#visit")).alias("url"))


def _visits_sql(new: bool) -> str:
    return f"""(SELECT event_id, ts, {canonical("coalesce(url, 'http://users.example/' || user_id) || '#visit'")} AS canon
      FROM events LEFT JOIN pages ON user_id * 2 = page_id WHERE ts {'>=' if new else '<'} TIMESTAMP '2024-01-08')"""


_SEEN_SQL = f"""seen AS (SELECT sha1(canon) AS url_sha1, min(ts) AS seen_at FROM {_visits_sql(False)} GROUP BY 1)"""
_KEPT_SQL = "kept AS (SELECT * FROM seen WHERE seen_at >= TIMESTAMP '2024-01-03')"


def _seen(t: Tables) -> DataFrame:
    return dedup.record_seen(None, _visits(t, False), F.col("ts"))


@query(f"""WITH {_SEEN_SQL}, {_KEPT_SQL}
SELECT event_id, sha1(canon) AS url_sha1 FROM {_visits_sql(True)} WHERE sha1(canon) NOT IN (SELECT url_sha1 FROM kept)""")
def dedup_anti(t: Tables) -> DataFrame:
    kept = dedup.purge_seen(_seen(t), F.lit(_NOW))
    return dedup.drop_seen(_visits(t, True), kept).select("event_id", "url_sha1")


@query("""SELECT count(*) AS visited, count(DISTINCT user_id || ' ' || event_type) AS urls FROM events""")
def dedup_off(t: Tables) -> DataFrame:
    """Without a seen set every row is visited; what is recorded begins one."""
    url = F.concat(F.lit("http://s.example/"), "user_id", F.lit("?e="), "event_type")
    visits = t.events.select(url.alias("url"), "ts")
    seen = dedup.record_seen(None, visits, F.col("ts"))
    counts = dedup.drop_seen(visits, None).agg(F.count("*").alias("visited"))
    return counts.withColumn("urls", F.lit(seen.count()).cast("bigint"))


@query(f"""WITH {_SEEN_SQL}, {_KEPT_SQL}
SELECT count(*) FILTER (sha1(canon) IN (SELECT url_sha1 FROM kept)) AS item_duplicated_count, count(*) AS total
FROM {_visits_sql(True)}""")
def dedup_counts(t: Tables) -> DataFrame:
    return dedup.seen_counts(_visits(t, True), dedup.purge_seen(_seen(t), F.lit(_NOW)))


@query(f"""WITH {_SEEN_SQL} SELECT count(*) FILTER (seen_at < TIMESTAMP '2024-01-03') AS removed, count(*) AS total
FROM seen""")
def seen_purge_counts(t: Tables) -> DataFrame:
    return dedup.purge_counts(_seen(t), F.lit(_NOW))


@query(f"""WITH {_SEEN_SQL}, {_KEPT_SQL}, every AS (SELECT * FROM kept UNION ALL
  SELECT sha1(canon), ts FROM {_visits_sql(True)})
SELECT url_sha1, CAST(epoch(min(ts)) AS BIGINT) AS seen_at FROM (SELECT url_sha1, seen_at AS ts FROM every) GROUP BY 1""")
def seen_record(t: Tables) -> DataFrame:
    kept = dedup.purge_seen(_seen(t), F.lit(_NOW))
    grown = dedup.record_seen(kept, _visits(t, True), F.col("ts"))
    return grown.select("url_sha1", F.round(F.unix_micros("seen_at") / 1e6).cast("bigint").alias("seen_at"))


@query(f"""WITH {ANCHORS}, {_SEEN_SQL}, {_KEPT_SQL}, wanted AS (
  SELECT {canonical('url')} AS canon FROM pages UNION ALL SELECT DISTINCT {canonical('url')} FROM anchors)
SELECT sha1(canon) AS url_sha1 FROM wanted WHERE sha1(canon) NOT IN (SELECT url_sha1 FROM kept)""")
def request_urls(t: Tables) -> DataFrame:
    kept = dedup.purge_seen(_seen(t), F.lit(_NOW))
    return links.request_urls(t.pages.select("url"), extract_links(t.pages), kept).select("url_sha1")


# --- link metadata ------------------------------------------------------------------------

@query(f"""WITH {ANCHORS}, k AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 2) AS keyword,
  replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'),
          '&amp;', '&') AS title FROM pages)
SELECT src_page_id, url, text, keyword, 'T=' || title || ';UP=1' AS vars FROM anchors JOIN k ON page_id = src_page_id
QUALIFY {FIRST}""")
def links_meta(t: Tables) -> DataFrame:
    """Link text, rule, keyword and upper-case variables go with each link."""
    pages = t.pages.withColumns({
        "keyword": F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(2)),
        "vars": urls.string_map({"UP": "1", "low": "2"})})
    found = extract_links(pages, [LinkRule("r", vars={"T": "//title/text()", "t": "//h1"})])
    named = F.array_join(F.transform(F.sort_array(F.map_entries("vars")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"])), ";")
    return found.select("src_page_id", "url", "text", "keyword", named.alias("vars"))


@query(f"""WITH {ANCHORS} SELECT src_page_id, count(*) AS links FROM (SELECT * FROM anchors QUALIFY {FIRST})
WHERE src_page_id NOT IN (SELECT page_id FROM pages WHERE contains(html, '<html lang="de"')) GROUP BY 1""")
def links_html_only(t: Tables) -> DataFrame:
    """German pages are served as plain text here: they give no links."""
    kind = F.when(F.col("html").contains('<html lang="de"'), "text/plain").otherwise("text/html; charset=utf-8")
    pages = t.pages.withColumn("headers", urls.string_map({"content-type": kind}))
    found = extract_links(pages.filter(links.is_html(pages)))
    return found.groupBy("src_page_id").agg(F.count("*").alias("links"))


@query(f"""WITH {ANCHORS} SELECT src_page_id, url FROM anchors
WHERE NOT regexp_matches(src_url, '/es/') QUALIFY {FIRST}""")
def links_bad_url(t: Tables) -> DataFrame:
    """Pages at a placeholder address give placeholder links; those are dropped."""
    url = F.when(F.col("url").rlike("/es/"), F.lit("http://0.0.0.0/")).otherwise(F.col("url"))
    return links.drop_bad_urls(extract_links(t.pages.withColumn("url", url))).select("src_page_id", "url")


@query(r"""SELECT page_id AS src_page_id, regexp_extract(url, '^[^?#]*') || '?page=' || n || '&ref=x' AS url
FROM pages, range(1, 9) AS r(n) WHERE n BETWEEN 2 AND 5""")
def next_pages(t: Tables) -> DataFrame:
    """A pager of eight links under each page; numbers 2 to 5 are followed."""
    numbers = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda n: F.concat(
        F.lit('<a class="p" href="?page='), n, F.lit("&amp;ref=x\">"), n, F.lit("</a>")))
    pager = F.concat(F.lit('<div id="pager">'), F.array_join(numbers, " "), F.lit("</div></html>"))
    pages = t.pages.withColumn("html", F.concat(F.replace("html", F.lit("</html>"), F.lit("")), pager))
    found = links.next_page_links(pages, r"page=(\d+)", css="div#pager a.p", start=2, stop=6)
    return found.select("src_page_id", "url")


@query("""SELECT page_id AS src_page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/list?a=1&region=eu&section=2&param=x&copy=' || page_id
AS url, 'go > on' AS text, way FROM pages, (VALUES ('plain'), ('region')) AS w(way)""")
def links_query_names(t: Tables) -> DataFrame:
    """Query fields that read like entities, ``>`` and ``href=`` inside other attributes; with and without a region."""
    tag = F.concat(F.lit('<a title="a > b" data-note="see href=/wrong" href="/list?a=1&region=eu&section=2&param=x&amp;copy='),
                   "page_id", F.lit('">go &gt; on</a></body>'))
    pages = t.pages.withColumn("html", F.concat(F.regexp_replace("html", "</(body|html)>", ""), tag))
    found = [extract_links(pages, [LinkRule("r", regex="/list", css=css)]).withColumn("way", F.lit(way))
             for way, css in (("plain", None), ("region", "body"))]
    return found[0].unionByName(found[1]).select("src_page_id", "url", "text", "way")


# --- walk ------------------------------------------------------------------------------------

def _site(t: Tables) -> DataFrame:
    """Pages as a tree: page i links to pages 2i+1 and 2i+2."""
    pages = t.pages.select("page_id", "url")
    below = pages.select(F.floor((F.col("page_id") - 1) / 2).alias("page_id"), F.col("page_id").alias("child"),
                         F.col("url").alias("child_url")).filter("child > 0")
    anchor = F.concat(F.lit('<a href="'), F.replace("child_url", F.lit("&"), F.lit("&amp;")), F.lit('">c</a>'))
    html = below.groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_list(anchor)), "").alias("body"))
    return pages.join(html, "page_id", "left").select(
        "page_id", "url", F.concat(F.lit("<html><body>"), F.coalesce("body", F.lit("")), F.lit("</body></html>"))
        .alias("html"))


@query(f"""WITH RECURSIVE c AS (SELECT page_id, {canonical('url')} AS canon FROM pages),
e AS (SELECT DISTINCT p.canon AS src, k.canon AS dst FROM c k JOIN c p ON k.page_id > 0 AND (k.page_id - 1) // 2 = p.page_id),
w(canon, depth) AS (SELECT canon, 0 FROM c WHERE page_id = 0
  UNION SELECT dst, depth + 1 FROM w JOIN e ON src = w.canon WHERE depth < 100)
SELECT page_id, min(depth) AS depth FROM c JOIN w USING (canon) GROUP BY page_id""")
def walk_depth(t: Tables) -> DataFrame:
    site = _site(t)
    seeds = site.filter("page_id = 0").select("url")
    reached = walk(site, seeds, [LinkRule("down")])
    return walked_pages(site, reached).select("page_id", "depth")


@query("""SELECT page_id FROM pages
WHERE page_id = 0 OR (page_id > 0 AND regexp_matches(url, '/en/'))""")
def item_page_choice(t: Tables) -> DataFrame:
    """Targets of "parse" links give items, and the seed because it is asked for."""
    from ..operators.items import choose_item_pages
    site = _site(t)
    found = extract_links(site, [LinkRule("items", regex="/en/", follow=False), LinkRule("lists")])
    return choose_item_pages(site, found, seeds=site.filter("page_id = 0")).select("page_id")
