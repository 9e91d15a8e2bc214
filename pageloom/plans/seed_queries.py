"""Keywords, collections, seed URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.macros import Macros
from ..operators.ranks import rank_slice
from ..operators.seeds import bind_keywords, seed_urls
from ..sources import collections, keywords
from .link_queries import ENCODED
from .registry import Tables, query


def _column(df: DataFrame, name: str, order: str) -> DataFrame:
    return df.select(F.col(name).alias("keyword"), F.col(order).alias("ord"))


@query("""WITH f AS (SELECT trim(p_name) AS keyword, 0 AS source, p_partkey AS ord FROM part),
r AS (SELECT CAST(i AS VARCHAR), 1, i FROM range(1, 50, 3) AS x(i)),
l AS (SELECT lower(c_mktsegment), 2, c_custkey FROM customer),
e AS (SELECT p_name FROM part WHERE p_size = 1 UNION ALL SELECT '7')
SELECT keyword, CAST(source AS INTEGER) AS source, CAST(ord AS BIGINT) AS ord
FROM (SELECT * FROM f UNION ALL SELECT * FROM r UNION ALL SELECT * FROM l)
WHERE keyword NOT IN (SELECT p_name FROM e)
QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY source, ord) = 1""")
def kw_union_except(t: Tables) -> DataFrame:
    """File, range and list sources, first one wins; excluded words are left out of all."""
    exclude = t.part.filter("p_size = 1").select(F.col("p_name").alias("keyword"))
    exclude = exclude.union(keywords.keyword_list(t.spark, ["7"]).select("keyword"))
    segments = t.customer.select(F.lower("c_mktsegment").alias("keyword"), F.col("c_custkey").alias("ord"))
    return keywords.combine_keywords(
        [_column(t.part, "p_name", "p_partkey"), keywords.keyword_range(t.spark, 1, 50, 3), segments], exclude)


@query("""WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT DISTINCT trim(line) AS keyword FROM lines WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')""")
def kw_lines(t: Tables) -> DataFrame:
    """Each document as a keyword file: lines, without blank and ``#`` lines."""
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("value"))
    return keywords.combine_keywords([keywords.numbered_lines(lines)]).select("keyword")


@query("""SELECT CAST(i AS VARCHAR) AS keyword, count(*) AS parts FROM range(1, 51, 7) AS x(i) JOIN part ON p_size = i
GROUP BY 1""")
def kw_range(t: Tables) -> DataFrame:
    """Parts per size, for the sizes of a range source."""
    sizes = t.part.select(F.col("p_size").cast("string").alias("keyword"))
    wanted = keywords.keyword_range(t.spark, 1, 51, 7)
    return sizes.join(wanted, "keyword").groupBy("keyword").agg(F.count("*").alias("parts"))


@query("SELECT DISTINCT p_name AS keyword FROM (SELECT p_name FROM part ORDER BY p_partkey LIMIT 31 OFFSET 10)")
def kw_slice(t: Tables) -> DataFrame:
    return collections.document_keywords(t.part, "p_name[10:40]", "p_partkey")


@query("""SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS keyword FROM (
SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r >= 100""")
def kw_slice_open(t: Tables) -> DataFrame:
    """An open slice: everything from row 100 on."""
    return collections.document_keywords(t.orders, "o_custkey[100:]", "o_orderkey")


def _collection(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"),
                             F.col("c_acctbal").alias("score"))


@query("""SELECT c_name AS keyword FROM (SELECT c_name, row_number() OVER (ORDER BY c_acctbal, c_name) - 1 AS r
FROM customer WHERE c_mktsegment = 'BUILDING') WHERE r BETWEEN 5 AND 24""")
def kv_zset_slice(t: Tables) -> DataFrame:
    return collections.collection_keywords(_collection(t), "BUILDING[5:24]", "zset")


@query("""SELECT c_mktsegment AS key, c_name AS member, r AS rank FROM (SELECT *,
row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_name) - 1 AS r FROM customer) WHERE r BETWEEN 3 AND 9""")
def kv_zset_ranks(t: Tables) -> DataFrame:
    """The short slice of every key: the rank limit is applied before the shuffle."""
    return rank_slice(_collection(t), ["key"], ["score", "member"], 3, 9).select("key", "member", "rank")


@query("""SELECT c_mktsegment AS key, c_name AS member, r AS rank FROM (SELECT *,
row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_name) - 1 AS r FROM customer) WHERE r >= 10""")
def kv_zset_open(t: Tables) -> DataFrame:
    """The open slice of every key: ranked by range partitions."""
    return rank_slice(_collection(t), ["key"], ["score", "member"], 10).select("key", "member", "rank")


@query("""SELECT key, member, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS r
FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS key, c_name AS member, c_acctbal AS score FROM customer))""")
def kv_zset_null_keys(t: Tables) -> DataFrame:
    """One key is null: its first ten by the short slice, the others by the open one."""
    rows = _collection(t).withColumn("key", F.nullif("key", F.lit("BUILDING")))
    short = rank_slice(rows, ["key"], ["score", "member"], 0, 9)
    return short.unionByName(rank_slice(rows, ["key"], ["score", "member"], 10)).select("key", "member", "rank")


@query("SELECT DISTINCT c_name AS keyword FROM customer WHERE c_mktsegment = 'MACHINERY'")
def kv_set_members(t: Tables) -> DataFrame:
    return collections.collection_keywords(_collection(t), "MACHINERY", "set")


# --- seeds ---------------------------------------------------------------------------------------------

@query(f"""SELECT p_partkey, 'http://shop.example/find?brand=' || {ENCODED.format('p_brand')} || '&lang=en&q='
|| {ENCODED.format("p_name || ' *~é&='")} || '&sort=demo' AS url FROM part""")
def seed_query_urls(t: Tables) -> DataFrame:
    """Keyword as a query field; given fields replace those of the base."""
    words = t.part.select("p_partkey", "p_brand", F.concat("p_name", F.lit(" *~é&=")).alias("keyword"))
    env = Macros({"SITE": F.lit("demo"), "BRAND": F.col("p_brand")})
    found = seed_urls(words, "http://shop.example/find?lang=fr&sort=x&empty=", "q",
                      {"lang": "en", "sort": "${SITE}", "brand": {"val": "${BRAND}", "enc": "utf-8"}}, macros=env)
    return found.select("p_partkey", "url")


@query("""SELECT p_partkey, 'http://shop.example/' || p_name || '/list.html?' AS url FROM part""")
def seed_path_urls(t: Tables) -> DataFrame:
    """Keyword in place of a name in the base; the ``?`` is always there."""
    words = t.part.select("p_partkey", F.col("p_name").alias("keyword"))
    return seed_urls(words, "http://shop.example/{kw}/list.html", "{kw}", as_query=False).select("p_partkey", "url")


@query("""SELECT p_partkey, 'http://x.example/?q=' || string_split(p_name, ' ')[2] AS by_blank,
'http://x.example/?q=' || string_split(p_brand, '#')[2] AS by_sep FROM part""")
def seed_columns(t: Tables) -> DataFrame:
    """One column of the keyword: cut at blanks, or at a given separator."""
    blank = seed_urls(t.part.withColumn("keyword", F.concat(F.lit("  "), "p_name")), "http://x.example/", "q", col=2)
    both = seed_urls(blank.withColumnRenamed("url", "by_blank").withColumn("keyword", F.col("p_brand")),
                     "http://x.example/", "q", col=2, sep="#")
    return both.select("p_partkey", "by_blank", F.col("url").alias("by_sep"))


@query(f"""SELECT p_partkey, 'http://x.example/?q=' || {ENCODED.format("regexp_replace(p_name, '^(.)\\w* (.*)$', '" + chr(92) + "2-" + chr(92) + "1')")} AS url
FROM part""")
def seed_sub(t: Tables) -> DataFrame:
    words = t.part.withColumn("keyword", F.col("p_name"))
    return seed_urls(words, "http://x.example/", "q", sub={"from": r"^(.)\w* (.*)$", "to": r"\2-\1"}).select(
        "p_partkey", "url")


@query("""SELECT o_orderkey, coalesce(c_name, '') AS keyword FROM orders LEFT JOIN customer
ON c_custkey = o_custkey AND c_mktsegment <> 'BUILDING'""")
def seed_binding(t: Tables) -> DataFrame:
    """Orders as pages whose URL names the customer; the keyword is looked up by URL."""
    words = t.customer.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_name").alias("keyword"),
                                                                   F.col("c_custkey").alias("ord"))
    seeds = seed_urls(words, "http://shop.example/c", "name")
    number = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    pages = t.orders.select("o_orderkey", F.concat(F.lit("http://shop.example/c?name=Customer%23"), number).alias("url"))
    return bind_keywords(pages, seeds).select("o_orderkey", "keyword")
