"""Field-cleaning parsers over documents, pages, conversations and events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import parse_array, parse_value, register_parser
from .item_queries import plain
from .registry import Tables, query

LINES = {"type": "string", "method": "split", "args": ["\n"]}
SPLIT = "string_split(text, chr(10))"
BLANKS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||'" \
    + "                　'"


def strip_sql(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def docs(t: Tables, spec, text: Column | None = None, glue: str = "|", dtype: str = "string") -> DataFrame:
    """Document number and the parsed values, joined to one text."""
    values = parse_value(F.col("text") if text is None else text, spec)
    return t.documents.select("doc_id", F.array_join(values.cast("array<string>"), glue).alias("parsed"))


def doc_sql(values: str, glue: str = "|") -> str:
    return f"SELECT doc_id, coalesce(array_to_string({values}, '{glue}'), '') AS parsed FROM documents"


@query(doc_sql("regexp_extract_all(text, '[A-Z][a-z]{3,}')"))
def parse_grep(t: Tables) -> DataFrame:
    return docs(t, {"type": "grep", "pattern": "[A-Z][a-z]{3,}"})


@query(doc_sql("""list_transform(list_zip(regexp_extract_all(text, '([a-z]+), ([a-z])', 1),
regexp_extract_all(text, '([a-z]+), ([a-z])', 2)), lambda z: z[1] || '|' || z[2])"""))
def parse_grep_groups(t: Tables) -> DataFrame:
    return docs(t, {"type": "grep", "pattern": "([a-z]+), ([a-z])"})


@query(doc_sql(f"[{SPLIT}[1]]"))
def parse_head(t: Tables) -> DataFrame:
    return docs(t, [LINES, "head"])


@query(doc_sql(f"{SPLIT}[2:]"))
def parse_tail(t: Tables) -> DataFrame:
    return docs(t, [LINES, "tail"])


@query(doc_sql(f"[{SPLIT}[-1]]"))
def parse_last(t: Tables) -> DataFrame:
    return docs(t, [LINES, "last"])


@query(f"SELECT doc_id, CAST(len({SPLIT}) AS BIGINT) AS n FROM documents")
def parse_len(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.get(parse_value(F.col("text"), [LINES, "len"]), F.lit(0)).alias("n"))


@query(doc_sql(f"[array_to_string({SPLIT}, ' / ')]"))
def parse_join(t: Tables) -> DataFrame:
    return docs(t, [LINES, {"type": "join", "sep": " / "}])


@query(doc_sql(f"list_transform({SPLIT}, lambda x: {strip_sql('x')})", "; "))
def parse_list(t: Tables) -> DataFrame:
    """Lines wrapped in tags; the parser takes the tags off and joins the lines."""
    tagged = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<li class='x'> "), x, F.lit(" </li>")))
    return t.documents.select("doc_id", F.get(parse_array(tagged, {"type": "list", "sep": "; "}), F.lit(0))
                              .alias("parsed"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '#1[0-9]*$')
  THEN 'one:' || regexp_extract(p_brand, '#(1[0-9]*)$', 1)
  WHEN regexp_matches(p_brand, '^Brand.2') THEN 'two' ELSE 'other' END AS kind FROM part""")
def parse_map(t: Tables) -> DataFrame:
    spec = {"type": "map", "map": {"#(?P<n>1[0-9]*)$": r"one:\g<n>", "^Brand.2": "two"}, "default": "other"}
    return t.part.select("p_partkey", F.get(parse_value(F.col("p_brand"), spec), F.lit(0)).alias("kind"))


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '[13579]$')")
def parse_map_drops(t: Tables) -> DataFrame:
    """A value that no key matches is dropped when there is no default."""
    spec = {"type": "map", "map": {"[13579]$": r"\g<0>"}}
    kept = t.part.select("p_partkey", F.explode(parse_value(F.col("p_brand"), spec)).alias("p_brand"))
    return kept


@query("""SELECT o_orderkey, coalesce(TRY_CAST(regexp_extract(o_orderpriority, '[0-9]+') AS BIGINT), 0) AS rank,
CAST(floor(o_totalprice) AS BIGINT) AS price, CAST(0 AS BIGINT) AS none, -o_custkey AS neg, CAST(0 AS BIGINT) AS gap
FROM orders""")
def parse_int(t: Tables) -> DataFrame:
    one = lambda x: F.get(parse_value(x, "int"), F.lit(0))
    grouped = F.format_number(F.floor("o_totalprice"), 0)  # 1,234
    return t.orders.select("o_orderkey", one(F.col("o_orderpriority")).alias("rank"), one(grouped).alias("price"),
                           one(F.col("o_orderstatus")).alias("none"),
                           one(F.concat(F.lit("no. -"), F.col("o_custkey"))).alias("neg"),
                           one(F.concat(F.lit("- "), F.col("o_custkey"))).alias("gap"))


@query("""SELECT event_id, value, -value AS neg, CAST(0 AS DOUBLE) AS bad FROM events""")
def parse_float(t: Tables) -> DataFrame:
    one = lambda x: F.get(parse_value(x, "float"), F.lit(0))
    text = F.col("value").cast("decimal(18,2)").cast("string")
    return t.events.select("event_id", one(F.concat(F.lit("EUR "), text)).alias("value"),
                           one(F.concat(F.lit("x-"), text, F.lit(" y"))).alias("neg"),
                           one(F.concat(text, F.lit(".1.2"))).alias("bad"))


@query("""SELECT page_id, CASE WHEN regexp_extract(url, '[?](.*)', 1) = '' THEN 'no query'
ELSE regexp_extract(url, '[?](.*)', 1) END AS q FROM pages""")
def parse_default(t: Tables) -> DataFrame:
    spec = [{"type": "sub", "from": r"^[^?]*\??", "to": ""}, {"type": "default", "value": "no query"}]
    return t.pages.select("page_id", F.get(parse_value(F.col("url"), spec), F.lit(0)).alias("q"))


@query(f"""SELECT page_id, md5({strip_sql("regexp_replace(html, '</?[^ >/][^>]*>', '', 'g')")}) AS hash FROM pages""")
def parse_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(F.get(parse_value(F.col("html"), "text"), F.lit(0))).alias("hash"))


@query(doc_sql(f"[{strip_sql('text')}]"))
def parse_str(t: Tables) -> DataFrame:
    return docs(t, "str", F.concat(F.lit("　\t "), "text", F.lit("  \n")))


@query(doc_sql(f"[{strip_sql('text')}]"))
def parse_trim(t: Tables) -> DataFrame:
    return docs(t, "trim", F.concat(F.lit(" \r\n"), "text", F.lit("　")))


@query(doc_sql(f"""[{strip_sql("regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')")}]"""))
def parse_norm(t: Tables) -> DataFrame:
    return docs(t, "norm")


@query(doc_sql(r"""[regexp_replace(text, '(\w+), (\w+)', '\2 & \1', 'g'), regexp_replace(text, '(\w+), (\w+)', '$\1', 'g')]"""))
def parse_sub(t: Tables) -> DataFrame:
    return docs(t, {"type": "sub", "from": r"(\w+), (?P<b>\w+)", "to": [r"\g<b> & \1", r"$\1"]})


@query("""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
'<script.*?</script>|<style.*?</style>', '', 'gs'), '<meta[^>]*>', '', 'g')) AS hash FROM pages""")
def parse_clean(t: Tables) -> DataFrame:
    """Handlers are put on the headings first, so that there is something to take off."""
    html = F.replace("html", F.lit("<h1>"), F.lit('<h1 onclick="a(1)" ONLOAD=go>'))
    return t.pages.select("page_id", F.md5(F.get(parse_value(html, "clean"), F.lit(0))).alias("hash"))


@query(f"""SELECT page_id, md5({plain('html')} || 'é☃ &nope; A') AS hash FROM pages""")
def parse_unesc(t: Tables) -> DataFrame:
    html = F.concat("html", F.lit("&eacute;&#9731; &nope; &#x41;"))
    return t.pages.select("page_id", F.md5(F.get(parse_value(html, "unesc"), F.lit(0))).alias("hash"))


@query(doc_sql("[text]"))
def parse_base64(t: Tables) -> DataFrame:
    return docs(t, "base64", F.base64(F.encode("text", "utf-8")))


# --- string methods --------------------------------------------------------------------------------

def _up(x: str) -> str:
    return f"replace(upper({x}), 'ẞ', 'ß')"


_TITLE = (r"array_to_string(list_transform(regexp_extract_all(text, '\p{L}+|[^\p{L}]+'), "
          f"lambda w: {_up('w[1]')} || lower(w[2:])), '')")
_SWAP = (r"array_to_string(list_transform(regexp_extract_all(text, '\p{Lu}+|\P{Lu}+'), "
         rf"lambda w: CASE WHEN regexp_matches(w, '^\p{{Lu}}') THEN lower(w) ELSE {_up('w')} END), '')")


@query(f"""SELECT conv_id, turn, md5(lower(text)) AS low, md5({_up('text')}) AS up, md5({_TITLE}) AS ti,
md5({_up('text[1]')} || lower(text[2:])) AS cap, md5({_SWAP}) AS sw, md5(replace(text, 'e', 'EE')) AS rep,
CAST(strpos(text, ',') - 1 AS BIGINT) AS fnd,
CAST((length(text) - length(replace(text, 'an', ''))) // 2 AS BIGINT) AS cnt,
lpad(CAST(turn AS VARCHAR), 4, '0') AS zf, lpad(role, 10, '*') AS rj, rpad(role, 5, '.')
 || CASE WHEN length(role) > 5 THEN role[6:] ELSE '' END AS lj, ltrim(rtrim(role, 'tr'), 'us') AS st
FROM conversations""")
def parse_string_methods(t: Tables) -> DataFrame:
    one = lambda x, m, *args: F.get(parse_value(x, {"type": "string", "method": m, "args": list(args)}), F.lit(0))
    text, role = F.col("text"), F.col("role")
    return t.conversations.select(
        "conv_id", "turn", F.md5(one(text, "lower")).alias("low"), F.md5(one(text, "upper")).alias("up"),
        F.md5(one(text, "title")).alias("ti"), F.md5(one(text, "capitalize")).alias("cap"),
        F.md5(one(text, "swapcase")).alias("sw"), F.md5(one(text, "replace", "e", "EE")).alias("rep"),
        one(text, "find", ",").alias("fnd"), one(text, "count", "an").alias("cnt"),
        one(F.col("turn").cast("string"), "zfill", 4).alias("zf"), one(role, "rjust", 10, "*").alias("rj"),
        one(role, "ljust", 5, ".").alias("lj"),
        F.get(parse_value(role, [{"type": "string", "method": "rstrip", "args": ["tr"]},
                                 {"type": "string", "method": "lstrip", "args": ["us"]}]), F.lit(0)).alias("st"))


@query("""SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(trim(text, chr(10)||' '), '\\s+'),
lambda w: w <> '')) AS INTEGER) AS words, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(
CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))) END AS INTEGER) AS lines FROM conversations""")
def parse_split(t: Tables) -> DataFrame:
    return t.conversations.select(
        "conv_id", "turn", F.size(parse_value(F.col("text"), "split")).alias("words"),
        F.size(parse_value(F.col("text"), "splitlines")).alias("lines"))


def _words(spec, name: str) -> Column:
    return F.size(parse_array(F.split("text", r"[ \n]"), spec)).alias(name)


_W = "string_split_regex(text, '[ \\n]')"


@query(f"""SELECT conv_id, turn, {', '.join(f"CAST(len(list_filter({_W}, lambda w: {test})) AS INTEGER) AS {name}"
  for name, test in {
    'alpha': r"regexp_matches(w, '^\p{L}+$')", 'digit': r"regexp_matches(w, '^\p{Nd}+$')",
    'alnum': r"regexp_matches(w, '^[\p{L}\p{N}]+$')", 'upperc': r"w = replace(upper(w), 'ẞ', 'ß') AND regexp_matches(w, '\p{L}')",
    'lowerc': r"w = lower(w) AND regexp_matches(w, '\p{L}')", 'starts': "starts_with(w, 'a') OR starts_with(w, 'e')",
    'ends': "NOT ends_with(w, '.')", 'inlist': "w IN ('the', 'und', 'les', 'que')",
    'nin': "w NOT IN ('the', 'und')", 'insub': "contains('the and of', w)", 'swapped': "contains(w, 'en')",
    'eq': "w = 'de'", 'ne': "w <> 'de'", 'lt': "w < 'b'", 'gte': "w >= 'b'", 'between': "w > 'b' AND w <= 'm'",
    'regex': "regexp_matches(w, '[aeiou]{2}')", 'none': "NOT (w > 'b') AND NOT (w = 'a')", 'swaplt': "'m' < w",
  }.items())} FROM conversations""")
def parse_filter_ops(t: Tables) -> DataFrame:
    def f(**spec):
        return {"type": "filter", **{k.replace("op_", "$"): v for k, v in spec.items()}}

    return t.conversations.select(
        "conv_id", "turn", _words(f(string="isalpha"), "alpha"), _words(f(string="isdigit"), "digit"),
        _words(f(string="isalnum"), "alnum"), _words(f(string="isupper"), "upperc"),
        _words(f(string="islower"), "lowerc"), _words(f(string="startswith", args=[("a", "e")]), "starts"),
        _words(f(string="endswith", args=["."], **{"not": True}), "ends"),
        _words(f(op_in=["the", "und", "les", "que"]), "inlist"), _words(f(op_nin=["the", "und"]), "nin"),
        _words(f(op_in="the and of"), "insub"), _words(f(op_in="en", swap=True), "swapped"),
        _words(f(op_eq="de"), "eq"), _words(f(op_ne="de"), "ne"), _words(f(op_lt="b"), "lt"),
        _words(f(op_gte="b"), "gte"), _words(f(op_gt="b", op_lte="m"), "between"),
        _words(f(op_regex="[aeiou]{2}"), "regex"), _words(f(op_gt="b", op_eq="a", **{"not": True}), "none"),
        _words(f(op_lt="m", swap=True), "swaplt"))


@query("""SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-20 06:00:00') - floor(epoch(ts)) < 172800""")
def parse_filter_delta(t: Tables) -> DataFrame:
    """Younger than two days at a fixed time; future times pass."""
    now = F.lit(datetime(2024, 1, 20, 6))
    kept = parse_value(F.col("ts"), {"type": "filter", "delta": 172800}, now, "timestamp")
    return t.events.select("event_id", F.explode(kept).alias("ts")).select("event_id")


@query("""SELECT conv_id, turn, upper(role) || '|' || role || '|' || length(role) AS parsed FROM conversations""")
def parse_tee(t: Tables) -> DataFrame:
    register_parser("width", lambda x: F.char_length(x).cast("string"))
    spec = {"type": "tee", "tee": ["upper", [], "width"]}
    return t.conversations.select("conv_id", "turn", F.array_join(parse_value(F.col("role"), spec), "|").alias("parsed"))


@query("""SELECT doc_id, coalesce(list_aggregate(list_transform(list_filter(regexp_extract_all(text, '[A-Z][a-z]+'),
lambda w: length(w) > 0 AND NOT starts_with(w, 'T')), lambda w: lower(w)), 'string_agg', '-'), '') AS parsed
FROM documents""")
def parse_pipe(t: Tables) -> DataFrame:
    spec = [{"type": "grep", "pattern": "[A-Z][a-z]+"},
            {"type": "filter", "string": "startswith", "args": ["T"], "not": True}, "lower", {"type": "join", "sep": "-"}]
    return docs(t, spec)


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events""")
def parse_jpath(t: Tables) -> DataFrame:
    text = F.concat(F.lit("var x = "), "props", F.lit("; y = 1;"))
    spec = {"type": "jpath", "query": "$.k"}
    return t.events.select("event_id", F.explode(parse_value(text, spec)).alias("k"))
