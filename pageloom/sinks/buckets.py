"""Keyed upsert of plain files in hash buckets: a batch rewrites the buckets its keys fall into, and no others.

A table is a folder with ``data/<batch>/_bucket=<k>`` folders and numbered manifests, each of
which names, for every bucket, the folder that holds its rows. A batch merges its rows with
those of the buckets that it touches, writes these anew and then takes the next manifest
number by a rename that fails where the number is taken, so that of two writers one starts
again from what the other wrote.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .folder import Folder
from .write import latest_rows, upsert_rows


def _manifest_name(number: int) -> str:
    return f"manifest-{number:010d}.json"


def latest_manifest(folder: Folder) -> tuple[int, dict] | None:
    """Number and content of the newest manifest."""
    names = folder.names("manifest-*.json")
    return (int(names[-1][9:-5]), json.loads(folder.read(names[-1]))) if names else None


def _rows_of(spark: SparkSession, path: str, manifest: dict, buckets: Sequence[str], fmt: str) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    paths = [f"{path}/{manifest['files'][b]}" for b in buckets]
    return spark.read.format(fmt).schema(schema).load(paths) if paths else spark.createDataFrame([], schema)


def read_buckets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The table as its newest manifest says."""
    found = latest_manifest(Folder(spark, path))
    if found is None:
        raise FileNotFoundError(f"no manifest in {path}")
    return _rows_of(spark, path, found[1], list(found[1]["files"]), fmt)


def upsert_buckets(new: DataFrame, path: str, keys: Sequence[str], arrival: Sequence[str], buckets: int = 64,
                   fmt: str = "parquet", keep: int = 3) -> int:
    """Upsert a batch; the number of the manifest that has it.

    ``buckets`` counts when the table is made, later batches keep its number. Keys compare
    null-safe, the last row of a key by ``arrival`` wins; a batch that comes again gives the same
    rows. What only manifests older than the newest ``keep`` name is deleted.
    """
    spark = new.sparkSession
    folder = Folder(spark, path)
    own = uuid.uuid4().hex
    found = latest_manifest(folder)
    count = found[1]["buckets"] if found else buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")
    # The batch is evaluated once; its folders tell which buckets it touches.
    staged = f"_batch-{own}"
    latest_rows(new, keys, arrival).withColumn("_bucket", bucket).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{staged}")
    touched = [n.split("=")[1] for n in folder.names(f"{staged}/_bucket=*")]
    batch = spark.read.schema(new.schema).parquet(*[f"{path}/{staged}/_bucket={b}" for b in touched]) if touched else new.limit(0)
    while True:
        found = latest_manifest(folder)
        number, manifest = found or (-1, {"buckets": count, "schema": json.loads(new.schema.json()), "files": {}})
        if manifest["buckets"] != count:
            raise RuntimeError(f"{path} was made with {manifest['buckets']} buckets meanwhile")
        data = f"data/{uuid.uuid4().hex}"
        old = [b for b in touched if b in manifest["files"]]
        merged = upsert_rows(_rows_of(spark, path, manifest, old, fmt) if found else None, batch, keys, arrival)
        merged.withColumn("_bucket", bucket).hint("rebalance", "_bucket").write.partitionBy("_bucket").format(fmt).save(f"{path}/{data}")
        files = manifest["files"] | {b: f"{data}/_bucket={b}" for b in touched}
        folder.create(f"_manifest-{own}", json.dumps({"buckets": count, "schema": json.loads(merged.schema.json()), "files": files}))
        if folder.rename(f"_manifest-{own}", _manifest_name(number + 1)):
            break
        folder.delete(data)
    folder.delete(staged)
    _forget(folder, keep)
    return number + 1


def _forget(folder: Folder, keep: int) -> None:
    """Delete manifests before the newest ``keep``, and the folders that only they name."""
    names = folder.names("manifest-*.json")
    used = {f for n in names[-keep:] for f in json.loads(folder.read(n))["files"].values()}
    for name in names[:-keep]:
        for file in set(json.loads(folder.read(name))["files"].values()) - used:
            folder.delete(file)
        folder.delete(name)
