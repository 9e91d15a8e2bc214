"""The same column code on streams: keyword queue, page stream, seen set, sinks."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from ..operators.dedup import KEEP_DAYS, with_fingerprint
from ..sinks.buckets import upsert_buckets
from ..sinks.write import message_payload, write_snapshot
from ..sources.keywords import clean_lines

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for a null time, and comes after all others.
NO_TIME = 2**63 - 1

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def keyword_stream(spark: SparkSession, path: str, fmt: str = "text", **options) -> DataFrame:
    """An endless keyword queue; ``seed_urls`` takes it like a table."""
    return clean_lines(spark.readStream.format(fmt).options(**options).load(path))


def page_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """A stream of captured pages for ``extract_html_items`` and ``extract_links``."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


class FirstVisits(StatefulProcessor):
    """Rows of a URL that come first, or a memory's length after the last one that was let through.

    A key is a bucket of URLs, so state calls and data frames are counted by buckets, not by
    URLs. A bucket's list has one entry for each batch that let rows through, with the times of
    the last of each URL; an entry is dropped by its own time to live, so there is no
    watermark and no row is too late: an older row of a known URL repeats it, one of an
    unknown URL is new. Rows of one batch are taken by their times, null ones last.
    """

    def __init__(self, at: str, columns: Sequence[str], days: int):
        self.at, self.columns, self.days = at, list(columns), days

    def init(self, handle) -> None:
        self.seen = handle.getListState("seen", "visits string", ttlDurationMs=self.days * 86_400_000)

    def handleInputRows(self, key, rows, timerValues):
        held = None
        for part in rows:  # of rows with one URL and time none but the first can pass
            part = part.set_axis([*self.columns, self.at, "bucket"], axis=1)
            held = (part if held is None else pd.concat([held, part])).drop_duplicates(["url_sha1", self.at])
        held = held.sort_values(["url_sha1", self.at], kind="stable")
        last: dict[str | None, int] = {}
        for visits, in self.seen.get():
            for url, at in json.loads(visits):
                last[url] = max(at, last.get(url, at))
        memory, new, changed = self.days * 86_400_000_000, [], {}
        for url, at in zip(held["url_sha1"].tolist(), held[self.at].tolist(), strict=True):
            url = url if isinstance(url, str) else None
            new.append(url not in last or (at != NO_TIME and at - last[url] >= memory))
            if new[-1]:
                last[url] = at
                if at != NO_TIME:
                    changed[url] = at
        yield held.loc[np.array(new, bool), self.columns]
        if changed:
            self.seen.appendValue((json.dumps(list(changed.items())),))

    def close(self) -> None:
        pass


def drop_seen_stream(pages: DataFrame, at: str = "fetched_at", days: int = KEEP_DAYS, buckets: int = 8192) -> DataFrame:
    """First row of each URL; ``days`` after it the URL counts as new again.

    Memory is a list for each of ``buckets`` hash buckets of fingerprints, kept in RocksDB, whose
    entries are dropped ``days`` after they were written. A batch reads the lists of the buckets
    its rows fall into, and holds a bucket's rows of different times together: with small batches over
    very many URLs take more buckets, and bound batches at their source. The number is fixed with the checkpoint. All
    columns of ``pages`` go through Python workers: leave out the page source where it is not needed.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    # Memory is cleared along with the next rows: a batch without any would follow another without end.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = with_fingerprint(pages)
    time, bucket = "visit_micros", "visit_bucket"
    keyed = rows.withColumns({time: F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(NO_TIME)),
                              bucket: F.pmod(F.xxhash64("url_sha1"), F.lit(buckets)).cast("int")})
    return keyed.groupBy(bucket).transformWithStateInPandas(FirstVisits(time, rows.columns, days), rows.schema, "Append", "ProcessingTime")


def upsert_stream(items: DataFrame, path: str, keys: Sequence[str], arrival: Sequence[str], buckets: int | None = None) -> DataStreamWriter:
    """Each micro-batch is one upsert; running a batch again gives the same rows.

    With ``buckets`` a batch rewrites only those its keys fall into (``read_buckets``), without
    them the whole table (``read_snapshot``).
    """
    if buckets:
        return items.writeStream.foreachBatch(lambda batch, _: upsert_buckets(batch, path, keys, arrival, buckets))
    return items.writeStream.foreachBatch(lambda batch, _: write_snapshot(batch, path, keys, arrival))


def message_stream(items: DataFrame, send: Callable[[DataFrame], None],
                   keys: Sequence[str] = ()) -> DataStreamWriter:
    """Each micro-batch as ``key, value`` messages, handed to ``send`` (a batch writer)."""
    return items.writeStream.foreachBatch(lambda batch, _: send(message_payload(batch, keys)))


def count_dropped(stream: DataFrame, name: str = "dedup") -> DataFrame:
    """Row counts per micro-batch for a ``StreamingQueryListener``."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"))
