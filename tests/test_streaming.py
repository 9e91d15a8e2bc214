"""Streams give the same rows as tables; the seen set forgets."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pageloom.operators.items import extract_html_items
from pageloom.operators.links import extract_links
from pageloom.operators.seeds import seed_urls
from pageloom.sinks.write import read_snapshot
from pageloom.streaming import streams

SCHEMA = "page_id bigint, url string, html string, fetched_at timestamp"
DAY0 = datetime(2024, 1, 1)


def run(query, tmp_path, name):
    stream = query.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    stream.awaitTermination()


def to_table(df, spark, tmp_path, name):
    out = str(tmp_path / f"out-{name}")
    run(df.writeStream.format("parquet").option("path", out), tmp_path, name)
    return spark.read.parquet(out)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, f"<h1>{u}</h1><a href='n{i}'>x</a>", DAY0 + timedelta(days=d))
                                  for i, (u, d) in enumerate(rows)], SCHEMA)


def test_page_stream_equals_batch(spark, tmp_path):
    table = pages(spark, [(f"http://s/{i}", i) for i in range(6)])
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.page_stream(spark, str(tmp_path / "in"), SCHEMA, maxFilesPerTrigger=1)
    fields = {"h": {"xpath": "//h1", "parse": "text"}}
    items = to_table(extract_html_items(stream, fields), spark, tmp_path, "items")
    assert sorted(map(str, items.collect())) == sorted(map(str, extract_html_items(table, fields).collect()))
    links = to_table(extract_links(stream), spark, tmp_path, "links")
    assert sorted(map(str, links.collect())) == sorted(map(str, extract_links(table).collect()))


def test_keyword_stream(spark, tmp_path):
    (tmp_path / "kw").mkdir()
    (tmp_path / "kw" / "a.txt").write_text("a b\n#no\n\nc\n")
    seeds = seed_urls(streams.keyword_stream(spark, str(tmp_path / "kw")), "http://h/", "q")
    got = to_table(seeds, spark, tmp_path, "kw")
    assert {r.url for r in got.collect()} == {"http://h/?q=a+b", "http://h/?q=c"}


def test_seen_stream_forgets_after_seven_days(spark, tmp_path):
    folder = str(tmp_path / "in")
    days = [[("http://s/a", 0), ("http://s/b", 0), ("http://S/a#f", 0)], [("http://s/a", 2), ("http://s/c", 2)],
            [("http://s/z", 20)], [("http://s/a", 21), ("http://s/z", 21)]]
    kept = []
    for i, batch in enumerate(days):
        pages(spark, batch).coalesce(1).write.mode("append").parquet(folder)
        stream = streams.page_stream(spark, folder, SCHEMA)
        df = to_table(streams.drop_seen_stream(stream).select("url", "fetched_at"), spark, tmp_path, "seen")
        kept.append(sorted((r.url, (r.fetched_at - DAY0).days) for r in df.collect()))
    assert len([u for u, d in kept[0] if u.lower().startswith("http://s/a")]) == 1 and len(kept[0]) == 2
    assert ("http://s/a", 2) not in kept[1] and ("http://s/c", 2) in kept[1]
    assert ("http://s/a", 21) in kept[3] and ("http://s/z", 21) not in kept[3]


def test_upsert_and_message_streams(spark, tmp_path):
    for i, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(1, "c", 2)], [(2, None, 3), (3, "d", 3)]]):
        spark.createDataFrame(rows, "id int, v string, at int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id int, v string, at int").parquet(str(tmp_path / "in"))
        run(streams.upsert_stream(stream, str(tmp_path / "t"), ["id"], ["at"]), tmp_path, "up")
    assert {tuple(r) for r in read_snapshot(spark, str(tmp_path / "t")).collect()} == {(1, "c", 2), (2, None, 3), (3, "d", 3)}
    out = str(tmp_path / "m")
    run(streams.message_stream(stream, lambda b: b.write.mode("append").parquet(out), ["id"]), tmp_path, "msg")
    assert spark.read.parquet(out).select(F.count_distinct("key")).first()[0] == 3
    assert spark.read.parquet(out).count() == 5


def test_seen_stream_loses_no_late_row(spark, tmp_path):
    folder = str(tmp_path / "in")
    days = [[("http://s/a", 0), ("http://s/z", 30)], [("http://s/late", 1), ("http://s/a", 1), ("http://s/a", 8)], [("http://s/late", 3), ("http://s/old", 2)]]
    for batch in days:
        pages(spark, batch).coalesce(1).write.mode("append").parquet(folder)
        df = to_table(streams.drop_seen_stream(streams.page_stream(spark, folder, SCHEMA)).select("url", "fetched_at"), spark, tmp_path, "late")
    got = sorted((r.url[-4:], (r.fetched_at - DAY0).days) for r in df.collect())
    assert got == sorted([("/s/a", 0), ("/s/z", 30), ("late", 1), ("/s/a", 8), ("/old", 2)])


def test_upsert_in_buckets_leaves_other_buckets_alone(spark, tmp_path):
    from pageloom.sinks.buckets import Folder, latest_manifest, read_buckets, upsert_buckets
    path, kinds = str(tmp_path / "t"), "id int, v string, at int"
    rows = spark.createDataFrame([(i if i else None, "a", 1) for i in range(100)], kinds)
    assert upsert_buckets(rows, path, ["id"], ["at"], buckets=8) == 0
    before = latest_manifest(Folder(spark, path))[1]["files"]
    assert len(before) == 8
    one = spark.createDataFrame([(7, "old", 2), (7, "b", 3)], kinds)
    for number in (1, 2):  # the same batch again changes nothing
        assert upsert_buckets(one, path, ["id"], ["at"]) == number
        after = latest_manifest(Folder(spark, path))[1]["files"]
        assert sum(before[b] != after[b] for b in before) == 1
        got = {r.id: r.v for r in read_buckets(spark, path).collect()}
        assert len(got) == 100 and got[7] == "b" and got[None] == "a"
    for i in range(4):  # older manifests go, and the folders that only they name
        upsert_buckets(spark.createDataFrame([(None, f"n{i}", 9 + i)], kinds), path, ["id"], ["at"])
    folder = Folder(spark, path)
    assert len(folder.names("manifest-*")) == 3 and not folder.names("_batch*")
    assert {r.id: r.v for r in read_buckets(spark, path).collect()}[None] == "n3"


def test_two_writers_of_buckets_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from pageloom.sinks.buckets import read_buckets, upsert_buckets
    path, kinds = str(tmp_path / "t"), "id int, v string, at int"
    upsert_buckets(spark.createDataFrame([(0, "x", 0)], kinds), path, ["id"], ["at"], buckets=2)

    def write(k):
        return upsert_buckets(spark.createDataFrame([(10 * k + i, f"w{k}", 1) for i in range(5)], kinds), path, ["id"], ["at"])
    with ThreadPoolExecutor(3) as pool:
        assert sorted(pool.map(write, range(1, 4))) == [1, 2, 3]
    assert read_buckets(spark, path).count() == 16


def test_located_output_is_whole_or_not_there(spark, tmp_path):
    import pytest

    from pageloom.sinks.write import output_location, write_located
    now = datetime(2024, 3, 4)
    assert output_location("s3://b/${date}/${site}-${epoch}-${random}", now, {"site": "x"}, "r") == "s3://b/2024-03-04/x-1709510400-r"
    with pytest.raises(ValueError):
        output_location("${none}", now)
    rows = spark.range(5)
    place = write_located(rows, f"{tmp_path}/${{date}}/out", now)
    assert place == f"{tmp_path}/2024-03-04/out" and spark.read.parquet(place).count() == 5
    with pytest.raises(FileExistsError):
        write_located(rows, f"{tmp_path}/${{date}}/out", now)
    with pytest.raises(Exception):
        write_located(rows.selectExpr("raise_error('x') as x"), f"{tmp_path}/${{date}}/bad", now)
    assert not (tmp_path / "2024-03-04" / "bad").exists()


def test_stream_queries_read_tables_that_are_folders_of_files(spark, tmp_path):
    from pageloom.plans import stream_queries as q
    from pageloom.plans.registry import Tables
    html = "<html><head><title> t </title></head><body><h1>h</h1><a href='/n'>x</a></body></html>"
    made = {
        "pages": spark.createDataFrame([(i, f"http://s/{i}", html, DAY0) for i in range(4)], SCHEMA),
        "documents": spark.createDataFrame([(i, f"a{i} b\n#no\nc") for i in range(4)], "doc_id bigint, text string"),
        "events": spark.createDataFrame([(i, DAY0, i % 2, "view", 1.0, "{}") for i in range(4)],
                                        q.EVENTS.replace("timestamp_ntz", "timestamp")).withColumn("ts", F.col("ts").cast("timestamp_ntz")),
    }
    for name, df in made.items():
        df.repartition(2).write.parquet(str(tmp_path / "dir" / f"{name}.parquet"))
        df.coalesce(1).write.parquet(str(tmp_path / "one" / name))
        part, = (tmp_path / "one" / name).glob("part-*.parquet")
        (tmp_path / "file").mkdir(exist_ok=True)
        (tmp_path / "file" / f"{name}.parquet").write_bytes(part.read_bytes())
    counts = {"stream_items": 4, "stream_links": 4, "stream_seeds": 8, "stream_upsert": 2, "stream_messages": 4}
    for kind in ("dir", "file"):
        assert {n: getattr(q, n)(Tables(spark, str(tmp_path / kind))).count() for n in counts} == counts


def test_seen_stream_takes_rows_of_a_batch_by_time_and_state_by_buckets(spark, tmp_path):
    for part in (3, 2, 1, 0):  # later files have earlier rows, and more than one data frame of them
        rows = spark.range(30_000).select((F.col("id") % 3).alias("u"), (F.lit(part) * 30_000 + 29_999 - F.col("id")).alias("second"))
        rows.select(F.concat(F.lit("http://s/"), "u").alias("url"), (F.lit(DAY0).cast("timestamp") + F.make_dt_interval(secs=F.col("second") * 10)).alias(
            "fetched_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("http://s/none", None), ("http://s/none", None), (None, DAY0), (None, DAY0)], "url string, fetched_at timestamp").coalesce(
        1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.drop_seen_stream(streams.page_stream(spark, str(tmp_path / "in"), "url string, fetched_at timestamp"), buckets=2)
    got = sorted((str(r.url), str(r.fetched_at)) for r in to_table(stream.select("url", "fetched_at"), spark, tmp_path, "order").collect())
    first = {u: DAY0 + timedelta(seconds=10 * ((2 - u) % 3)) for u in range(3)}
    again = {u: at + timedelta(days=7) for u, at in first.items()}
    wanted = [(f"http://s/{u}", str(at)) for times in (first, again) for u, at in times.items()]
    assert got == sorted([*wanted, ("http://s/none", "None"), ("None", str(DAY0))])
