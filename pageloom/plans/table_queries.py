"""Sinks, run statistics, and table-level views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality
from ..session import scratch_folder
from ..sinks import buckets, write
from .registry import Tables, query


@query("""WITH old AS (SELECT user_id, event_id, event_type, props FROM events WHERE ts < TIMESTAMP '2024-01-15'
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1),
new AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'click' THEN NULL ELSE props END AS props
  FROM events WHERE ts >= TIMESTAMP '2024-01-15'
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE NOT EXISTS (
  SELECT 1 FROM new WHERE new.user_id = old.user_id AND new.event_type = old.event_type)""")
def upsert_latest(t: Tables) -> DataFrame:
    """Old table and a new batch; the last new row replaces the old one fully, nulls too."""
    events = t.events.select("user_id", "event_id", "event_type", "props", "ts")
    keys = ["user_id", "event_type"]
    cut = F.lit(datetime(2024, 1, 15))
    old = events.filter(F.col("ts") < cut).withColumn("first", -F.col("event_id"))
    old = write.latest_rows(old, keys, ["first"]).drop("first", "ts")
    new = events.filter(F.col("ts") >= cut).drop("ts")
    new = new.withColumn("props", F.when(F.col("event_type") != "click", F.col("props")))
    return write.upsert_rows(old, new, keys, ["event_id"])


@query("""WITH old AS (SELECT user_id, event_type, event_id, props FROM events WHERE ts < TIMESTAMP '2024-01-15'
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1),
new AS (SELECT user_id, event_type, event_id, props FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type = 'click'
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE NOT EXISTS (
  SELECT 1 FROM new WHERE new.user_id = old.user_id AND new.event_type = old.event_type)""")
def upsert_buckets(t: Tables) -> DataFrame:
    """Two batches into a table of hash buckets; the second holds one event type only."""
    events, cut = t.events.select("user_id", "event_type", "event_id", "props", "ts"), F.lit(datetime(2024, 1, 15))
    path, keys = f"{scratch_folder(t.spark, 'buckets')}/table", ["user_id", "event_type"]
    buckets.upsert_buckets(events.filter(F.col("ts") < cut).drop("ts"), path, keys, ["event_id"], buckets=32)
    buckets.upsert_buckets(events.filter((F.col("ts") >= cut) & (F.col("event_type") == "click")).drop("ts"), path, keys, ["event_id"])
    return buckets.read_buckets(t.spark, path)


@query("""SELECT event_id, user_id, event_type, props FROM events""")
def write_append(t: Tables) -> DataFrame:
    """Two appends to one target, partitioned, in text form; together they are the table."""
    events, path = t.events.select("event_id", "user_id", "event_type", "props"), f"{scratch_folder(t.spark, 'append')}/table"
    for half in (F.col("event_type") == "click", F.col("event_type") != "click"):
        write.write_items(events.filter(half), path, fmt="json", partition_by=["event_type"])
    return t.spark.read.schema(events.schema).json(path)


@query("""SELECT user_id, event_type, event_id, props, true AS by_table, false AS by_dry_run FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def write_routes(t: Tables) -> DataFrame:
    """The kind of target decides: rows with keys become a snapshot, a dry run gives the rows back and writes nothing."""
    events, path = t.events.select("user_id", "event_type", "event_id", "props"), scratch_folder(t.spark, "routes")
    keyed = dict(keys=["user_id", "event_type"], arrival=["event_id"])
    write.write_items(events, f"{path}/dry", dry_run=True, **keyed)
    write.write_items(events, f"{path}/kept", **keyed)
    written = [write.latest_snapshot(t.spark, f"{path}/{name}") is not None for name in ("kept", "dry")]
    return write.read_snapshot(t.spark, f"{path}/kept").withColumns(
        {"by_table": F.lit(written[0]), "by_dry_run": F.lit(written[1])})


@query("""SELECT event_id, value, '2024-03-04' AS day, '1709514000' AS at, 32 AS random_letters FROM events""")
def output_location(t: Tables) -> DataFrame:
    """Events in the location that a template gives, whose parts are read back from its name."""
    template = f"{scratch_folder(t.spark, 'located')}/${{date}}/${{job}}-${{epoch}}-${{random}}"
    location = write.write_located(t.events.select("event_id", "value"), template, datetime(2024, 3, 4, 1), {"job": "events"})
    day, last = location.split("/")[-2:]
    _, at, letters = last.split("-")
    return t.spark.read.parquet(location).select(
        "event_id", "value", F.lit(day).alias("day"), F.lit(at).alias("at"), F.lit(len(letters)).alias("random_letters"))


@query("""SELECT sha1(CAST(o_orderkey AS VARCHAR)) AS key, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' ||
o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}' AS value FROM orders""")
def message_payload(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return write.message_payload(rows, ["o_orderkey"])


@query("""SELECT doc_id AS item_id, CAST(p - 1 AS INTEGER) AS pos, words[p] AS image_url, source AS referer FROM (
  SELECT doc_id, source, words, unnest(range(1, len(words) + 1)) AS p FROM (
    SELECT doc_id, source, regexp_extract_all(text, '[A-Z]\\w+[.]') AS words FROM documents))
QUALIFY row_number() OVER (PARTITION BY words[p] ORDER BY doc_id, p) = 1""")
def media_manifest(t: Tables) -> DataFrame:
    """Sentence ends as media addresses: each once, first document and place."""
    words = F.regexp_extract_all("text", F.lit(r"[A-Z]\w+[.]"), F.lit(0))
    rows = t.documents.select("doc_id", F.col("source").alias("url"), words.alias("image_urls"))
    return write.media_manifest(rows, "doc_id")


@query("""SELECT CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS start_time,
CAST(epoch(date_trunc('second', max(ts))) AS BIGINT) AS finish_time,
CAST(epoch(date_trunc('second', max(ts))) AS BIGINT) - CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS elapsed_seconds,
count(*) AS item_count, count(*) FILTER (event_type = 'error') AS item_error_count, 'finished' AS finish_reason,
'events' AS job FROM events""")
def run_stats(t: Tables) -> DataFrame:
    return quality.run_stats(t.events, F.min("ts"), F.max("ts"), job="events",
                             counters={"item.error.count": F.count_if(F.col("event_type") == "error")})


@query("""SELECT event_id, strftime(TIMESTAMP '2024-03-04', '%Y-%m-%d') AS date,
CAST(1709510400 AS BIGINT) AS epoch, 'r1' AS run FROM events""")
def output_parts(t: Tables) -> DataFrame:
    """Columns an output is partitioned by, fixed once per run."""
    return write.with_output_parts(t.events.select("event_id"), F.lit(datetime(2024, 3, 4)), "r1")
