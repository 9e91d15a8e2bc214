"""Where items go: append, keyed upsert, messages, media manifest."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import best_per_key
from .folder import Folder

# Fixed value: the referer that goes with a media address without one.
DEFAULT_REFERER = "http://www.google.com"


def latest_rows(rows: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """The last arrival of each key. The rank limit of 1 is applied before the shuffle."""
    if not arrival:
        raise ValueError("an upsert needs arrival columns that say which row of a key is the last")
    order = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in arrival])
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def upsert_rows(existing: DataFrame | None, new: DataFrame, keys: Sequence[str],
                arrival: Sequence[str]) -> DataFrame:
    """Full replacement by key: the last new row per key, and old rows whose key is not new.

    Keys compare null-safe. Old rows are only filtered, never sorted.
    """
    last = latest_rows(new, keys, arrival)
    if existing is None:
        return last
    fresh = last.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
    same = [existing[k].eqNullSafe(fresh[f"_new_{k}"]) for k in keys]
    return existing.join(fresh, same, "left_anti").unionByName(last, allowMissingColumns=True)


def write_items(items: DataFrame, target: str | None = None, fmt: str = "parquet", mode: str = "append",
                keys: Sequence[str] = (), arrival: Sequence[str] = (), partition_by: Sequence[str] = (),
                dry_run: bool = False, **options) -> DataFrame:
    """Write to any ``DataFrameWriter`` format (files, jdbc, kafka, a table format).

    With ``keys`` the write is an upsert: ``fmt="table"`` merges into the table ``target``;
    files get a new snapshot next to the old ones. ``dry_run`` writes nothing. Errors
    fail the job, no row is lost silently.
    """
    if dry_run:
        return items
    if keys and fmt == "table":
        merge_table(items, target, keys, arrival)
        return items
    if keys:
        write_snapshot(items, target, keys, arrival, fmt)
        return items
    writer = items.write.format(fmt).mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(target) if target else writer.save()
    return items


def merge_table(new: DataFrame, table: str, keys: Sequence[str], arrival: Sequence[str]) -> None:
    """Upsert into a table whose format has row-level merge."""
    source = latest_rows(new, keys, arrival).alias("source")
    same = [F.col(f"{table}.{k}").eqNullSafe(F.col(f"source.{k}")) for k in keys]
    condition = same[0]
    for test in same[1:]:
        condition = condition & test
    source.mergeInto(table, condition).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def write_snapshot(new: DataFrame, path: str, keys: Sequence[str], arrival: Sequence[str],
                   fmt: str = "parquet", keep: int = 3) -> int:
    """Upsert for plain files: the merged rows become ``snapshot=<n+1>``; returns its number.

    Rows are written under a name of their own and then renamed. If another writer took
    the number meanwhile, the merge starts again from its snapshot, so no batch is lost.
    The newest ``keep`` snapshots stay, for readers of the one before.
    """
    spark = new.sparkSession
    jvm = spark._jvm
    file_path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    files = file_path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while True:
        number = latest_snapshot(spark, path)
        existing = None if number is None else spark.read.format(fmt).load(f"{path}/snapshot={number}")
        following, own = 0 if number is None else number + 1, f"_writing-{uuid.uuid4().hex}"
        upsert_rows(existing, new, keys, arrival).write.format(fmt).save(f"{path}/{own}")
        if latest_snapshot(spark, path) == number:
            left = file_path(f"snapshot={following}")
            if files.exists(left) and not files.exists(file_path(f"snapshot={following}/_SUCCESS")):
                files.delete(left, True)  # what a writer left that was cut off
            # A rename onto a folder that has just come to be would go into it.
            if files.rename(file_path(own), left) and not files.exists(file_path(f"snapshot={following}/{own}")):
                break
            files.delete(file_path(f"snapshot={following}/{own}"), True)
        files.delete(file_path(own), True)
    if following - keep >= 0:
        files.delete(file_path(f"snapshot={following - keep}"), True)
    return following


def latest_snapshot(spark, path: str) -> int | None:
    """Number of the newest finished snapshot; one that was cut off has no ``_SUCCESS``."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/snapshot=*/_SUCCESS")
    found = folder.getFileSystem(conf).globStatus(folder)
    numbers = [int(s.getPath().getParent().getName().split("=")[1]) for s in (found or [])]
    return max(numbers, default=None)


def read_snapshot(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """The newest snapshot of ``write_snapshot``."""
    return spark.read.format(fmt).load(f"{path}/snapshot={latest_snapshot(spark, path)}")


def with_output_parts(items: DataFrame, now: Column, run_id: str) -> DataFrame:
    """Columns ``date`` and ``epoch`` and ``run`` to partition an output by."""
    return items.withColumns({"date": F.date_format(now, "yyyy-MM-dd"), "epoch": F.unix_seconds(now),
                              "run": F.lit(run_id)})


def message_payload(items: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``key, value`` rows for a message sink: each item as one JSON object."""
    key = F.sha1(F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    key = key if keys else F.lit(None).cast("string")
    return items.select(key.alias("key"), F.to_json(F.struct(*items.columns)).alias("value"))


def media_manifest(items: DataFrame, item_id: str, media: str = "image_urls", url: str | None = "url",
                   options: Mapping[str, str] | None = None) -> DataFrame:
    """One row per media address: the first item that names it, and the referer to send."""
    default = F.lit((options or {}).get("referer", DEFAULT_REFERER))
    referer = F.coalesce(F.col(url), default) if url else default
    every = items.select(F.col(item_id).alias("item_id"), referer.alias("referer"),
                         F.posexplode(media).alias("pos", "image_url"))
    first = best_per_key(every, ["image_url"], "item_id", [F.col("pos"), F.col("referer")], least=True)
    return first.select("item_id", "pos", "image_url", "referer")


_LOCATION = re.compile(r"\$\{(\w+)\}")


def output_location(template: str, now: datetime, names: Mapping[str, str] | None = None, random: str | None = None) -> str:
    """``template`` with ``${date}``, ``${epoch}``, ``${random}`` and ``names`` filled in; unknown names raise.

    Expanded once, on the driver: all tasks of a job write below one location. ``random`` is made
    up unless it is given, for a run that goes on with the location of an earlier one.
    """
    moment = now.replace(tzinfo=now.tzinfo or timezone.utc)
    known = {"date": moment.strftime("%Y-%m-%d"), "epoch": str(int(moment.timestamp())),
             "random": random or uuid.uuid4().hex, **(names or {})}

    def value(m: re.Match) -> str:
        if m[1] not in known:
            raise ValueError(f"unknown name {m[0]} in {template!r}")
        return known[m[1]]

    return _LOCATION.sub(value, template)


def write_located(items: DataFrame, template: str, now: datetime, names: Mapping[str, str] | None = None,
                  fmt: str = "parquet", random: str | None = None, **options) -> str:
    """Write to the location that ``template`` gives, as a whole or not at all; returns the location.

    Rows are written beside it under a name that readers skip and renamed when all are there. A
    location that exists raises ``FileExistsError``, before anything is written and at the end.
    """
    location = output_location(template, now, names, random)
    parent, _, last = location.rstrip("/").rpartition("/")
    folder = Folder(items.sparkSession, parent)
    if folder.names(last):
        raise FileExistsError(location)
    own = f"_writing-{uuid.uuid4().hex}"
    items.write.format(fmt).options(**options).save(f"{parent}/{own}")
    if not folder.rename(own, last):
        folder.delete(own)
        raise FileExistsError(location)
    return location
