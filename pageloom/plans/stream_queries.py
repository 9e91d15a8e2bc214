"""The streaming forms, run over the whole tables until nothing is left to read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.urls import url_sha1
from ..operators.items import extract_html_items
from ..operators.links import extract_links
from ..operators.seeds import seed_urls
from ..session import scratch_folder
from ..sinks.buckets import read_buckets
from ..sources.keywords import clean_lines
from ..sources.pages import PAGE_SCHEMA
from ..streaming import streams
from .item_queries import H1, TITLE
from .link_queries import ANCHORS, ENCODED, FIRST, canonical
from .registry import Tables, query

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(t: Tables, name: str, schema: str) -> DataFrame:
    # A pattern stands for a file as for a folder of files; a plain path is taken as a folder only.
    return streams.page_stream(t.spark, f"{t.folder}/{name}.parque[t]", schema)


def _drain(writer: DataStreamWriter, folder: str) -> None:
    writer.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").start().awaitTermination()


def _rows(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    folder = scratch_folder(t.spark, name)
    _drain(stream.writeStream.format("parquet").option("path", f"{folder}/rows"), folder)
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query(f"WITH {ANCHORS} SELECT src_page_id, url, text FROM anchors QUALIFY {FIRST}")
def stream_links(t: Tables) -> DataFrame:
    found = extract_links(_stream(t, "pages", PAGE_SCHEMA))
    return _rows(t, found.select("src_page_id", "url", "text"), "links")


@query(f"SELECT page_id, trim({TITLE}) AS title FROM pages WHERE {TITLE} <> '' AND {H1} <> ''")
def stream_items(t: Tables) -> DataFrame:
    fields = {"title": {"xpath": "//title/text()", "parse": "trim"}, "h1": {"xpath": "//h1"}}
    return _rows(t, extract_html_items(_stream(t, "pages", PAGE_SCHEMA), fields).select("page_id", "title"), "items")


@query(f"""SELECT doc_id, 'http://x.example/?q=' || {ENCODED.format('line')} AS url FROM (
SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
WHERE line <> '' AND NOT starts_with(line, '#')""")
def stream_seeds(t: Tables) -> DataFrame:
    """Document lines as an endless keyword queue."""
    lines = _stream(t, "documents", "doc_id bigint, text string")
    words = clean_lines(lines.select("doc_id", F.explode(F.split("text", "\n")).alias("value")))
    return _rows(t, seed_urls(words, "http://x.example/", "q").select("doc_id", "url"), "seeds")


@query(f"""WITH RECURSIVE v AS (
  SELECT sha1({canonical("'http://s.example/' || user_id || '?e=' || event_type")}) AS url_sha1, ts FROM events),
kept AS (SELECT url_sha1, min(ts) AS ts FROM v GROUP BY url_sha1 UNION ALL
  SELECT v.url_sha1, min(v.ts) FROM v JOIN kept ON v.url_sha1 = kept.url_sha1 AND v.ts >= kept.ts + INTERVAL 7 DAY GROUP BY v.url_sha1)
SELECT url_sha1, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at FROM kept""")
def stream_seen(t: Tables) -> DataFrame:
    """Events as page visits: the first of an address, and the first seven days or more after the one before.

    A second run reads all visits again, older than what it remembers: none passes.
    """
    def visits(events: DataFrame) -> DataFrame:
        url = F.concat(F.lit("http://s.example/"), "user_id", F.lit("?e="), "event_type")
        return streams.drop_seen_stream(events.select(url.alias("url"), F.col("ts").cast("timestamp").alias("fetched_at")))

    folder = scratch_folder(t.spark, "seen")
    events = t.spark.read.schema(EVENTS).parquet(f"{t.folder}/events.parquet")
    # Addresses cost more than their bytes tell: files for all cores, whatever the table's are.
    events.repartition(max(events.rdd.getNumPartitions(), t.spark.sparkContext.defaultParallelism)).write.parquet(f"{folder}/in")
    for again in (False, True):
        if again:
            events.filter("ts < timestamp_ntz'2024-01-08'").write.mode(
                "append").parquet(f"{folder}/in")
        stream = visits(streams.page_stream(t.spark, f"{folder}/in", EVENTS))
        out = stream.select(url_sha1(F.col("url")).alias("url_sha1"), F.unix_seconds("fetched_at").alias("at"))
        _drain(out.writeStream.format("parquet").option("path", f"{folder}/rows"), folder)
    return t.spark.read.parquet(f"{folder}/rows")


@query("""SELECT user_id, event_id, event_type, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def stream_upsert(t: Tables) -> DataFrame:
    events = _stream(t, "events", EVENTS).select("user_id", "event_id", "event_type", "props")
    folder = scratch_folder(t.spark, "upsert")
    _drain(streams.upsert_stream(events, f"{folder}/table", ["user_id"], ["event_id"], buckets=16), folder)
    return read_buckets(t.spark, f"{folder}/table")


@query("""SELECT sha1(CAST(event_id AS VARCHAR)) AS key, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}'
AS value FROM events""")
def stream_messages(t: Tables) -> DataFrame:
    events = _stream(t, "events", EVENTS).select("event_id", "event_type")
    folder = scratch_folder(t.spark, "messages")
    _drain(streams.message_stream(events, lambda rows: rows.write.mode("append").parquet(f"{folder}/sent"),
                                  ["event_id"]), folder)
    return t.spark.read.parquet(f"{folder}/sent")
