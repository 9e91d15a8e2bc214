"""Secret scan with corpus-wide ownership frequency; DataFrame functions only.

Patterns find candidates in whole texts. Every candidate value is hashed and counted over
the whole corpus: in how many repositories and with how many owners it occurs. A value
that several owners have is a copied example, a value of one owner that looks random is
live. Spans of the fixed kinds are reported whatever the count says; further long random
strings (kind ``owned``) only where one owner has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))

#: Kind, pattern, group of the secret itself, its least length. Runs of one character class with
#: a least length are what is left of the shorter runs' matches after the length test.
KINDS = (
    ("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("owned", r"[A-Za-z0-9+/_-]{24,}", 0, 24),
)
BASE = ("assign", "access", "hex")


def _matches(text: Column, no: int) -> Column:
    """Array of ``no, nth, gap, taken, value``: all matches of a kind, and the characters between one and the next."""
    kind, pattern, group, least = KINDS[no]
    found, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("taken"), values.alias("value"))
    listed = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p, i: F.struct(
        F.lit(no).alias("no"), i.alias("nth"), p["gap"].alias("gap"), p["taken"].alias("taken"), p["value"].alias("value")))
    return F.when(text.rlike(pattern), listed).otherwise(F.array().cast("array<struct<no:int,nth:int,gap:int,taken:int,value:string>>"))


def _placed(matches: DataFrame) -> DataFrame:
    """Matches with ``start`` and ``end``, sums of the gaps and matches before them; those whose value is too short are dropped.

    A running sum over the matches of one kind in one text, which Spark sorts and spills: a
    list of many thousands costs as much for each as a short one.
    """
    before = Window.partitionBy("uid", "no").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("taken")).over(before).cast("int")
    least = F.array(*(F.lit(n) for *_, n in KINDS))
    return matches.withColumn("end", end).withColumn("start", F.col("end") - F.col("taken")).filter(
        F.length("value") >= least[F.col("no")]).drop("nth", "gap", "taken")


def _random_looking(value: Column) -> Column:
    """Digits, letters and at least a third of the characters different: not a word, not a filler."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (different * 3 >= F.least(F.length(value), F.lit(30)))


def scan_secrets(docs: DataFrame, owner_col: str = "source", repository_col: str = "doc_id", id_col: str = "doc_id",
                 text_col: str = "text", example_owners: int = 2) -> tuple[DataFrame, DataFrame]:
    """``(rows, findings)`` of every whole text.

    ``findings``: ``uid, doc_id, kind, start, end, value, owners, repositories, verdict`` with
    verdict ``example`` (at least ``example_owners`` owners), ``live`` (fewer, looks random) or
    ``weak``. Places count code points, the end is exclusive. ``rows``: one per input row with
    ``uid, doc_id, found`` (its findings as structs, by start and kind).

    Null and empty texts have no findings. A null owner or repository counts as one of its
    own. Repeated rows are scanned each; their value counts once per owner and repository.
    An empty table gives empty results. Other columns are not read. A value in a third of
    all rows is first counted where it is found, then per owner; the join that brings counts
    back has one row per value on its small side, and Spark splits its hot partitions.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*(_matches(text, i) for i in range(len(KINDS))))
    rows = scratch.keep(docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"),
        F.col(repository_col).alias("repository"), found.alias("found")), "found")
    each = _placed(rows.filter(F.size("found") > 0).select("uid", "doc_id", "owner", "repository", F.inline("found"))).withColumn(
        "hash", F.sha2("value", 256))
    counted = (
        each.select("hash", "owner", "repository").distinct()
        .groupBy("hash", "owner").agg(F.count("*").alias("n"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories")))
    judged = each.join(counted, "hash").withColumn(
        "verdict", F.when(F.col("owners") >= example_owners, "example").when(_random_looking(F.col("value")), "live").otherwise("weak"))
    owned = len(BASE)
    judged = judged.filter((F.col("no") < owned) | (F.col("verdict") == "live"))
    names = F.array(*(F.lit(k) for k, *_ in KINDS))
    findings = judged.select("uid", "doc_id", names[F.col("no")].alias("kind"), "start", "end", "no", "value",
                             "owners", "repositories", "verdict")
    per_row = findings.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(
        "start", "no", "end", "kind", "value", "owners", "repositories", "verdict"))).alias("judged"))
    out = rows.select("uid", "doc_id").join(per_row, "uid", "left").select(
        "uid", "doc_id", F.coalesce("judged", F.array()).alias("found"))
    return out, findings.drop("no")


def secret_digest(rows: DataFrame) -> DataFrame:
    """Counts per kind, digest of the fixed kinds' spans, all spans, and how many are live or examples."""
    def count(test) -> Column:
        return F.size(F.filter("found", test)).cast("long")

    def listed(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def kind_is(kind: str):
        return lambda s: s["kind"] == kind

    base = F.filter("found", lambda s: s["no"] < len(BASE))
    return rows.select(
        "doc_id", *(F.size(F.filter("found", kind_is(k))).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"), count(lambda s: s["verdict"] == "example").alias("n_example"))
