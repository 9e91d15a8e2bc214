"""Keywords, collections, ranks, seen set, sinks: small fixtures against plain Python."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pageloom.operators import dedup, quality, ranks
from pageloom.operators.items import follow_redirects
from pageloom.operators.seeds import bind_keywords, seed_list, seed_url, seed_urls
from pageloom.functions.macros import Macros
from pageloom.sinks import write
from pageloom.sources import collections, keywords

NOW = datetime(2024, 1, 15)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- keywords ------------------------------------------------------------------------------

@pytest.fixture()
def keyword_files(tmp_path):
    (tmp_path / "inc.txt").write_text("# words\n\n b \na\nb\n　c\td\n7\n", encoding="utf-8")
    (tmp_path / "exc.txt").write_text("a\n#b\n9\n")
    return str(tmp_path / "inc.txt"), str(tmp_path / "exc.txt")


def test_keyword_sources_in_order(spark, keyword_files):
    inc, exc = (keywords.keyword_file(spark, f) for f in keyword_files)
    got = keywords.combine_keywords(
        [inc, keywords.keyword_range(spark, 5, 11, 2), keywords.keyword_list(spark, ["z", "b", "a"])], exc)
    assert [(r.keyword, r.source) for r in got.orderBy("source", "ord").collect()] == [
        ("b", 0), ("c\td", 0), ("7", 0), ("5", 1), ("z", 2)]


def test_range_down(spark):
    assert [r.keyword for r in keywords.keyword_range(spark, 5, 0, -2).orderBy("ord").collect()] == ["5", "3", "1"]


@pytest.mark.parametrize("address, expected", [("k", ("k", 0, None)), ("k[2:5]", ("k", 2, 5)), ("k[:3]", ("k", 0, 3)),
                                               ("k[4:]", ("k", 4, None))])
def test_slices(address, expected):
    assert collections.parse_slice(address) == expected


def hot_scores():
    """Two thirds of the rows under one key, many equal scores."""
    random.seed(1)
    return [("hot" if i % 3 else f"k{i % 7}", f"m{i}", float(random.randrange(20))) for i in range(6000)]


@pytest.mark.parametrize("start, stop", [(0, 9), (5, None), (100, 2500), (0, 0), (3999, 5000)])
def test_rank_slice_against_python(spark, start, stop):
    rows = hot_scores()
    df = spark.createDataFrame(rows, "key string, member string, score double").repartition(5)
    got = {(r.key, r.member): r.rank for r in ranks.rank_slice(df, ["key"], ["score", "member"], start, stop).collect()}
    expected = {}
    for key in {r[0] for r in rows}:
        order = sorted((s, m) for k, m, s in rows if k == key)
        for i, (_, m) in enumerate(order):
            if i >= start and (stop is None or i <= stop):
                expected[(key, m)] = i
    assert got == expected


@pytest.mark.parametrize("stop", [9, 1500, None])
def test_slices_keep_rows_of_a_null_key(spark, stop):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "k").alias("key"), F.col("id").alias("score"))
    got = ranks.rank_slice(df, ["key"], ["score"], 0, stop).groupBy("key").count().collect()
    assert {r.key: r["count"] for r in got} == dict.fromkeys([None, "k"], 2000 if stop is None else stop + 1)


def test_ranks_split_a_hot_key_over_tasks(spark):
    df = spark.createDataFrame(hot_scores(), "key string, member string, score double")
    placed = df.repartitionByRange(8, "key", "score", "member").withColumn("p", F.spark_partition_id())
    assert placed.filter("key = 'hot'").select("p").distinct().count() > 4
    assert "WindowGroupLimit" in plan_of(ranks.rank_slice(df, ["key"], ["score"], 0, 9))


@pytest.mark.parametrize("start, stop", [(0, -1), (10, 19), (10, -1), (2000, 4000)])
def test_document_slice(spark, start, stop):
    df = spark.range(5000).select((F.lit(4999) - F.col("id")).alias("ord"), (F.col("id") % 700).alias("w")).repartition(4)
    address = "w" if (start, stop) == (0, -1) else f"w[{start}:{'' if stop < 0 else stop}]"
    got = {r.keyword for r in collections.document_keywords(df, address, "ord").collect()}
    end = 5000 if stop < 0 else stop + 1
    assert got == {str((4999 - o) % 700) for o in range(start, min(end, 5000))}


def test_collections(spark):
    rows = [("z", "b", 2.0), ("z", "a", 2.0), ("z", "c", 1.0), ("s", "x", None), ("s", "x", None), ("other", "q", 0.0)]
    df = spark.createDataFrame(rows, "key string, member string, score double")
    pick = lambda address, kind: {r.keyword for r in collections.collection_keywords(df, address, kind).collect()}
    assert pick("z[0:1]", "zset") == {"c", "a"} and pick("z[1:]", "zset") == {"a", "b"} and pick("s", "set") == {"x"}
    with pytest.raises(ValueError):
        pick("z", "tree")


# --- seeds ----------------------------------------------------------------------------------------

def test_seeds(spark):
    words = spark.createDataFrame([("a b,c", 1), ("é,d", 2)], "keyword string, ord int")
    env = Macros({"SITE": F.lit("s")})
    urls = lambda **kw: [r.url for r in seed_urls(words, name="K", macros=env, **kw).orderBy("ord").collect()]
    assert urls(base="http://h/?x=1&K=0&$SITE=2", query={"x": "${SITE}", "n": 5}) == [
        "http://h/?K=a+b%2Cc&n=5&s=2&x=s", "http://h/?K=%C3%A9%2Cd&n=5&s=2&x=s"]
    assert urls(base="http://h/K", as_query=False, col=2, sep=",") == ["http://h/c?", "http://h/d?"]
    assert urls(base="http://h/", sub={"from": "^(.).*", "to": r"<\1>"}) == ["http://h/?K=%3Ca%3E", "http://h/?K=%3C%C3%A9%3E"]
    assert spark.range(1).select(seed_url(F.lit("http://h/a?b=1"), {"b": 2}).alias("u")).first().u == "http://h/a?b=2"
    assert [r.url for r in seed_list(spark, ["http://h/$SITE", "x"], env).collect()] == ["http://h/s", "x"]


def test_binding_takes_the_last_keyword(spark):
    seeds = spark.createDataFrame([("u", "a", 2), ("u", "b", 1), ("v", "c", 3)], "url string, keyword string, ord int")
    pages = spark.createDataFrame([("u",), ("w",)], "url string")
    assert {(r.url, r.keyword) for r in bind_keywords(pages, seeds).collect()} == {("u", "a"), ("w", "")}


# --- seen set -----------------------------------------------------------------------------------------

def test_seen_set(spark):
    urls = [f"http://s/{i if i % 3 else 'hot'}" for i in range(300)]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    old = spark.createDataFrame([("http://s/hot", NOW - timedelta(days=6)), ("http://s/1", NOW - timedelta(days=8)),
                                 ("http://s/2#x", NOW - timedelta(days=7))], "url string, at timestamp")
    seen = dedup.record_seen(None, old, F.col("at"))
    kept = dedup.purge_seen(seen, F.lit(NOW))
    assert dedup.purge_counts(seen, F.lit(NOW)).first().asDict() == {"removed": 1, "total": 3}
    new = dedup.drop_seen(rows, kept)
    assert sorted(r.url for r in new.collect()) == sorted(u for u in urls if u not in ("http://s/hot", "http://s/2"))
    assert dedup.seen_counts(rows, kept).first().asDict() == {"item_duplicated_count": 101, "total": 300}
    assert dedup.drop_seen(rows, None).count() == 300
    again = dedup.record_seen(kept, rows, F.lit(NOW))
    first = {r.url_sha1: r.seen_at for r in again.collect()}
    assert len(first) == 201 and min(first.values()) == NOW - timedelta(days=7)
    assert dedup.drop_seen(rows, again).count() == 0


def test_hot_fingerprint_is_split(spark):
    """A third of the rows is one URL: adaptive execution splits that partition of the anti join."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 60000, 1, 8).select(
            F.sha1(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(-1).cast("string")).alias("url_sha1"),
            F.sha1(F.col("id").cast("string")).alias("payload"))
        seen = spark.range(0, 30000, 1, 4).select(F.sha1(F.col("id").cast("string")).alias("url_sha1"))
        new = dedup.drop_seen(rows, seen)
        assert len(new.collect()) == 60000 - 20000
        assert "skew=true" in plan_of(new)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# --- sinks ----------------------------------------------------------------------------------------------

BATCHES = [
    [(1, "a", "x", 1), (2, "b", None, 1), (1, "a2", None, 2)],
    [(2, "c", "y", 3), (None, "n", "n", 3), (3, "d", "d", 3), (2, "c2", "z", 4)],
    [(None, "n2", None, 5), (3, None, "e", 5)],
]
SCHEMA = "id int, a string, b string, at int"


def test_upsert_snapshots(spark, tmp_path):
    path, state = str(tmp_path / "t"), {}
    assert write.latest_snapshot(spark, path) is None
    for i, batch in enumerate(BATCHES):
        for row in sorted(batch, key=lambda r: r[3]):
            state[row[0]] = row
        df = spark.createDataFrame(batch, SCHEMA)
        write.write_items(df, path, keys=["id"], arrival=["at"])
        assert sorted(map(str, write.read_snapshot(spark, path).collect())) == sorted(
            str(r) for r in spark.createDataFrame(list(state.values()), SCHEMA).collect())
        assert write.latest_snapshot(spark, path) == i
    write.write_items(df, path, keys=["id"], arrival=["at"])  # the same batch again changes nothing
    assert {tuple(r) for r in write.read_snapshot(spark, path).collect()} == set(state.values())


def test_writers_at_the_same_time_lose_no_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    write_one = lambda i: write.write_snapshot(spark.createDataFrame([(i, "a", "b", i)], SCHEMA), path, ["id"], ["at"])
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(write_one, range(6)))
    assert sorted(numbers) == list(range(6))
    assert {r.id for r in write.read_snapshot(spark, path).collect()} == set(range(6))
    assert len(list((tmp_path / "t").glob("snapshot=*"))) == 3
    with pytest.raises(ValueError):
        write.write_items(spark.createDataFrame(BATCHES[0], SCHEMA), path, keys=["id"])


def test_merge_is_resolved_up_to_the_table_format(spark, tmp_path):
    """No format here merges rows, so Spark must refuse the format and nothing else."""
    df = spark.createDataFrame(BATCHES[0], SCHEMA)
    df.write.option("path", str(tmp_path / "m")).saveAsTable("merge_target")
    try:
        with pytest.raises(Exception, match="MERGE INTO TABLE"):
            write.write_items(df, "merge_target", fmt="table", keys=["id"], arrival=["at"])
    finally:
        spark.sql("DROP TABLE merge_target")


def test_append_partitioned_and_dry_run(spark, tmp_path):
    df = write.with_output_parts(spark.createDataFrame(BATCHES[0], SCHEMA), F.lit(NOW), "r")
    path = str(tmp_path / "a")
    assert write.write_items(df, path, dry_run=True) is df and not (tmp_path / "a").exists()
    for _ in range(2):
        write.write_items(df, path, fmt="json", partition_by=["date"])
    assert (tmp_path / "a" / "date=2024-01-15").is_dir()
    assert spark.read.json(path).count() == 6


def test_messages_and_manifest(spark):
    df = spark.createDataFrame([(1, "u1", ["a", "b"]), (2, None, ["b", "c"]), (3, "u3", [])],
                               "id int, url string, image_urls array<string>")
    rows = {r.image_url: (r.item_id, r.pos, r.referer) for r in write.media_manifest(df, "id").collect()}
    assert rows == {"a": (1, 0, "u1"), "b": (1, 1, "u1"), "c": (2, 1, write.DEFAULT_REFERER)}
    message = write.message_payload(df, ["id"]).orderBy("value").first()
    assert message.value == '{"id":1,"url":"u1","image_urls":["a","b"]}' and len(message.key) == 40


def test_skewed_upsert_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3 > 0).alias("id"), F.col("id").alias("at"))
    latest = write.latest_rows(df, ["id"], ["at"])
    assert {r["at"] for r in latest.collect()} == {998, 999} and "WindowGroupLimit" in plan_of(latest)


def test_run_stats(spark):
    df = spark.range(5).select(F.col("id"), F.timestamp_seconds(F.col("id") * 10 + 0.5).alias("t"))
    row = quality.run_stats(df, F.min("t"), F.max("t"), counters={"a.b": F.max("id")}, job="j").first().asDict()
    assert row == {"start_time": 0, "finish_time": 40, "elapsed_seconds": 40, "item_count": 5, "a_b": 4,
                   "finish_reason": "finished", "job": "j"}
    seen, counts = quality.observe_run(df, top=F.max("id"))
    seen.write.format("noop").mode("overwrite").save()
    assert counts.get == {"item_count": 5, "top": 4}


def test_redirects(spark):
    pages = spark.createDataFrame([(1, "http://a", "A", None), (2, "http://b", "B", "http://A#x"), (3, "http://c", "C", "http://z")],
                                  "page_id int, url string, html string, redirect_url string")
    got = follow_redirects(pages, pages.select("page_id", "url", "html"))
    assert {(r.page_id, r.url, r.html) for r in got.collect()} == {(1, "http://a", "A"), (2, "http://a", "A")}


def test_first_rows_need_no_sorted_aggregate_and_domains_one_pass(spark, tmp_path):
    from pageloom.operators.links import extract_links, keep_domains
    from pageloom.operators.seeds import bind_keywords
    from pageloom.sinks.write import media_manifest
    items = spark.createDataFrame([(2, "u", ["a", "b"]), (1, "v", ["b", "b"]), (1, "a", ["b"])], "item_id int, url string, image_urls array<string>")
    seeds = spark.createDataFrame([("u", "k1", 1), ("u", "k3", 2), ("u", "k2", 2), ("w", "k", 1)], "url string, keyword string, ord int")
    media, bound = media_manifest(items, "item_id"), bind_keywords(items, seeds)
    assert {tuple(r) for r in media.collect()} == {(2, 0, "a", "u"), (1, 0, "b", "a")}
    assert {(r.url, r.keyword) for r in bound.collect()} == {("u", "k3"), ("v", ""), ("a", "")}
    assert {r.keyword for r in bind_keywords(items, seeds.drop("ord")).collect()} == {"k3", ""}
    for df in (media, bound, bind_keywords(items, seeds.drop("ord"))):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    html = "".join(f"<a href='http://{h}/'>x</a>" for h in ("a.com", "x.a.com", "y.x.a.com", "b.com", "com", "aa.com"))
    spark.createDataFrame([(1, "http://s/", html)], "page_id int, url string, html string").write.parquet(f"{tmp_path}/pages")
    domains = spark.createDataFrame([("x.a.com",), ("A.com",), ("A.com",), (None,)], "domain string")
    kept = keep_domains(extract_links(spark.read.parquet(f"{tmp_path}/pages")), domains)
    assert sorted(r.url for r in kept.collect()) == ["http://a.com/", "http://x.a.com/", "http://y.x.a.com/"]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
