"""Dates written as text in the ways the parser reads, over orders, lineitem and events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, macros
from ..functions.parse import parse_value
from ..operators import quality
from ..operators.links import LinkRule, extract_links
from .link_queries import ANCHORS, FIRST
from .registry import Tables, query

NOW = datetime(2024, 2, 1, 6, 30, 15)
NOW_SQL = "TIMESTAMP '2024-02-01 06:30:15'"
LOCAL_SQL = "TIMESTAMP '2024-02-01 14:30:15'"  # at +08:00


def seconds(x: Column, fmt: str = "auto", tz: str = "+08:00") -> Column:
    return dates.seconds(dates.parse_date(x, fmt, tz, F.lit(NOW)))


def epoch_sql(local: str, hours: int = 8) -> str:
    return f"CAST(epoch({local}) AS BIGINT) - {hours * 3600}"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, {epoch_sql('l_shipdate')} AS at,
{epoch_sql("l_shipdate + INTERVAL 9 HOUR + INTERVAL 5 MINUTE")} AS at_clock FROM lineitem""")
def date_absolute(t: Tables) -> DataFrame:
    """Five spellings of a day, chosen by line number, and one with a clock time."""
    day = F.col("l_shipdate")
    forms = ["yyyy-M-d", "yyyy/MM/dd", "yyyy.M.d", "yyyy年MM月dd日", "'at 'yyyy' 年 'M' 月 'd' 日'"]
    text = None
    for i, form in enumerate(forms):
        text = (F if text is None else text).when(F.col("l_linenumber") % 5 == i, F.date_format(day, form))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", seconds(text).alias("at"),
                             seconds(F.concat(text, F.lit(" 9:05"))).alias("at_clock"))


@query(f"""SELECT o_orderkey, {epoch_sql("make_timestamp(2024, month(o_orderdate), day(o_orderdate), 18, 30, 0)")} AS at
FROM orders""")
def date_month_day(t: Tables) -> DataFrame:
    """Month and day without a year: the current year."""
    return t.orders.select("o_orderkey", seconds(F.date_format("o_orderdate", "M月d日 18:30")).alias("at"))


_UNITS = [("秒前", "second", -1), ("分钟前", "minute", -60), ("小时前", "hour", -3600), ("天前", "day", -86400),
          ("周前", "day", -604800), ("月前", "month", -2592000), ("年前", "year", -31536000), ("天后", "day", 86400)]


@query(f"""SELECT event_id, CASE u {' '.join(
    f"WHEN {i} THEN {epoch_sql(f'''date_trunc('{unit}', {LOCAL_SQL} + to_seconds(n * {size}))''')}"
    for i, (_, unit, size) in enumerate(_UNITS))} END AS at
FROM (SELECT event_id, user_id % 8 AS u, CAST(floor(value) AS BIGINT) AS n FROM events)""")
def date_relative(t: Tables) -> DataFrame:
    """``<n> <unit> ago`` and ``later``, cut to the unit; the number is the event's value."""
    word = F.element_at(F.array(*[F.lit(w) for w, _, _ in _UNITS]), (F.col("user_id") % 8 + 1).cast("int"))
    text = F.concat(F.floor("value").cast("string"), F.lit(" "), word)
    return t.events.select("event_id", seconds(text).alias("at"))


_HALVES = [("半分钟前", "second", 30), ("半小时前", "minute", 1800), ("半天前", "hour", 43200),
           ("半周前", "hour", 302400), ("半月前", "day", 1296000), ("半年前", "month", 15552000)]


@query(f"""SELECT event_id, CASE user_id % 6 {' '.join(
    f"WHEN {i} THEN CAST(epoch(date_trunc('{unit}', ts - to_seconds({size}))) AS BIGINT)"
    for i, (_, unit, size) in enumerate(_HALVES))} END AS at FROM events""")
def date_halves(t: Tables) -> DataFrame:
    """Halves of a unit before each event's own time: ``now`` may be a column."""
    word = F.element_at(F.array(*[F.lit(w) for w, _, _ in _HALVES]), (F.col("user_id") % 6 + 1).cast("int"))
    at = dates.parse_date(word, "auto", "utc", F.date_trunc("SECOND", F.col("ts")))
    return t.events.select("event_id", dates.seconds(at).alias("at"))


@query(f"""SELECT event_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) + CASE event_type WHEN 'view' THEN -172800
WHEN 'click' THEN -86400 WHEN 'error' THEN 0 WHEN 'signup' THEN 86400 ELSE 172800 END + 43920 AS at FROM events""")
def date_day_words(t: Tables) -> DataFrame:
    words = {"view": "前天", "click": "昨日", "error": "今天", "signup": "明日"}
    word = F.lit("后天")
    for kind, name in words.items():
        word = F.when(F.col("event_type") == kind, name).otherwise(word)
    at = dates.parse_date(F.concat(word, F.lit(" 12:12")), "auto", "utc", F.col("ts"))
    return t.events.select("event_id", dates.seconds(at).alias("at"))


@query("""SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) AS ms,
CAST(epoch(date_trunc('day', ts)) AS BIGINT) - 28800 AS day, CAST(0 AS BIGINT) AS bad FROM events""")
def date_digits(t: Tables) -> DataFrame:
    """10 and 13 digits are instants, 8 digits a local day, 9 digits nothing."""
    s = F.unix_seconds("ts").cast("string")
    return t.events.select("event_id", seconds(s).alias("s"), seconds(F.concat(F.lit("t="), s, F.lit("123"))).alias("ms"),
                           seconds(F.date_format("ts", "yyyyMMdd")).alias("day"),
                           seconds(F.concat(F.lit("1"), F.date_format("ts", "yyyyMMdd"))).alias("bad"))


@query("""SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) - 28800 AS cst, CAST(epoch(o_orderdate) AS BIGINT) AS utc,
CAST(epoch(o_orderdate) AS BIGINT) + 12600 AS west, CAST(epoch(o_orderdate) AS BIGINT) - 28800 AS parsed FROM orders""")
def date_tz(t: Tables) -> DataFrame:
    text = F.date_format("o_orderdate", "MM/dd/yyyy HH:mm:ss")
    fmt = "%m/%d/%Y %H:%M:%S"
    parsed = F.get(parse_value(text, [{"type": "cst", "fmt": fmt}, "epoch"]), F.lit(0))
    return t.orders.select("o_orderkey", seconds(text, fmt, "cst").alias("cst"), seconds(text, fmt, "utc").alias("utc"),
                           seconds(text, fmt, "-03:30").alias("west"), parsed.alias("parsed"))


@query("""SELECT event_id, """ + ", ".join(
    f"CAST(epoch(date_trunc('{u}', ts)) AS BIGINT) AS {u}_start" for u in ("second", "minute", "hour", "day", "month", "year"))
    + " FROM events")
def date_trunc_unit(t: Tables) -> DataFrame:
    return t.events.select("event_id", *[dates.seconds(dates.truncate(F.col("ts"), u)).alias(f"{u}_start")
                                         for u in dates.TRUNC_UNITS])


@query("""SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at, CAST(floor(epoch(ts)) AS BIGINT) AS again FROM events""")
def date_epoch(t: Tables) -> DataFrame:
    """Timestamp to epoch seconds, and epoch text back to a timestamp."""
    at = F.get(parse_value(F.col("ts"), "epoch", dtype="timestamp"), F.lit(0))
    return t.events.select("event_id", at.alias("at"), seconds(at.cast("string"), "epoch", "+05:00").alias("again"))


@query("""SELECT doc_id, NOT regexp_matches(text, '[0-9]') AS failed, CASE WHEN regexp_matches(text, '[0-9]')
THEN CAST(epoch(TIMESTAMP '2013-03-01') AS BIGINT) + 86400 * (doc_id % 28) ELSE 0 END AS at FROM documents""")
def date_failure(t: Tables) -> DataFrame:
    """Documents without digits hold no date: the failure value, or null on request. The others are dated by their number."""
    day = F.format_string("2013-03-%02d", F.col("doc_id") % 28 + 1)
    text = F.when(F.col("text").rlike("[0-9]"), day).otherwise(F.col("text"))
    lost = dates.parse_date(text, "auto", "utc", F.lit(NOW))
    null = dates.parse_date(text, "auto", "utc", F.lit(NOW), on_error="null")
    return t.documents.select("doc_id", null.isNull().alias("failed"), dates.seconds(lost).cast("bigint").alias("at"))


@query("""SELECT CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 'future'
WHEN epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts)) > 86400 THEN 'stale' ELSE 'fresh' END AS freshness,
count(*) AS n FROM events GROUP BY 1""")
def freshness(t: Tables) -> DataFrame:
    return quality.freshness_counts(t.events, F.col("ts"), F.lit(datetime(2024, 1, 20)))


@query(f"""WITH {ANCHORS}, u AS (SELECT * FROM anchors QUALIFY {FIRST})
SELECT src_page_id, url FROM u JOIN events ON event_id = src_page_id
WHERE epoch({NOW_SQL}) - floor(epoch(ts)) < 31 * 86400""")
def recent_links(t: Tables) -> DataFrame:
    """Links whose page carries a date younger than 31 days (the date is the event's, as text)."""
    at = t.events.select(F.col("event_id").alias("src_page_id"), F.date_format("ts", "yyyy年M月d日 HH:mm:ss").alias("day"),
                         F.unix_seconds("ts").alias("s"))
    links = extract_links(t.pages, [LinkRule("all")]).join(at, "src_page_id")
    recent = dates.is_recent(F.col("day"), "utc", 31 * 86400, F.lit(NOW))
    return links.filter(recent & dates.is_recent_epoch(F.col("s"), 31 * 86400, F.lit(NOW))).select("src_page_id", "url")


# --- macros -----------------------------------------------------------------------------------------

@query("""SELECT page_id, 'see ' || url || ' $x $$ ' || split_part(url, '/', 3) || ' ' || split_part(url, '/', 4)
|| ' ' || url || ' ${NONE}' AS line FROM pages""")
def macro_row(t: Tables) -> DataFrame:
    """The page's URL and the columns of its keyword (here the URL cut at ``/``)."""
    env = macros.job_macros(F.lit(NOW), url=F.col("url"), keyword=F.col("url"), sep="/")
    return t.pages.select("page_id", env.expand("see $URL $x $$$$ ${COL3} ${COL4} ${COL0} ${NONE}").alias("line"))


@query("""SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S')
|| '|' || strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d|%Y %m %d %H %M %S|%-d.%-m.%Y %-H %-M %-S|')
|| year(ts + INTERVAL 8 HOUR) || '-' || month(ts + INTERVAL 8 HOUR) || '-' || day(ts + INTERVAL 8 HOUR) || '|'
|| CAST(floor(epoch(ts)) AS BIGINT) || ' ' || (CAST(epoch(date_trunc('day', ts + INTERVAL 8 HOUR)) AS BIGINT) - 28800)
|| ' ' || (CAST(epoch(date_trunc('day', ts + INTERVAL 8 HOUR)) AS BIGINT) - 28800 + 86399) AS line FROM events""")
def macro_clock_fixed(t: Tables) -> DataFrame:
    """All clock names, at the time of each event."""
    env = macros.Macros(macros.clock(F.col("ts"), "+08:00"))
    line = ("$NOW|$UTCNOW|$TODAY|$YEAR $MONTH $DAY $HOUR $MINUTE $SECOND|$IDAY.$IMONTH.$IYEAR $IHOUR $IMINUTE $ISECOND|"
            "$ITODAY|$UNOW $UTODAY $UENDDAY")
    return t.events.select("event_id", env.expand(line).alias("line"))
