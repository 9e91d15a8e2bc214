"""URL filter: host and path rules first, then boosted trees on lexical features for the rest."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, boost
from .common import least_hashed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Numbers that describe a URL.
WIDTH = 22
Rule = tuple[str, str]
RULES: tuple[Rule, ...] = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def matching_rule(host: Column, path: Column, rules: Sequence[Rule], most: int = 1000) -> Column:
    """``verdict, rule`` of the longest rule that fits (of equally long ones the first), else null."""
    if len(rules) > most:
        raise ValueError(f"more than {most} rules")
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules[::-1], key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def suffixes(url: str) -> list[str]:
    """Top-level name, last two names and first path part: what counts are kept for."""
    host, path = split_url(url)
    names = host.split(".")
    return ["." + names[-1], ".".join(names[-2:]), "/" + path.strip("/").split("/")[0]]


def split_url(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(str.maketrans(UPPER, LOWER)), re.match(r"[^?#]*", rest[len(host):])[0]


def features(url: str | None, shares: dict[str, tuple[float, float]], prior: float) -> list[float]:
    """Length, depth, digits, entropy, parameters, and the share of blocked URLs among those of equal suffixes."""
    url = url or ""
    host, path = split_url(url)
    query = url.partition("#")[0].partition("?")[2]
    counts = Counter(url)
    entropy = -sum(n / len(url) * math.log2(n / len(url)) for n in counts.values()) if url else 0.0
    names = host.split(".")
    parts = [p for p in path.split("/") if p]
    out = [
        float(len(url)), float(len(host)), float(len(path)), float(len(parts)), float(len(names)),
        sum(c.isdigit() for c in url) / max(1, len(url)), sum(c.isdigit() for c in host) / max(1, len(host)), entropy,
        float(len([p for p in query.split("&") if p])), float(len(query)), float("#" in url), float(host.count("-")),
        float(url.startswith("https:")), float(len(names[0])), float(max(map(len, parts), default=0)), float("." in (parts[-1] if parts else "")),
    ]
    for s in suffixes(url):
        blocked, n = shares.get(s, (0.0, 0.0))
        out += [(blocked + 4 * prior) / (n + 4), math.log1p(n)]
    return out


def fit_urls(labelled: DataFrame, bound: int = 20_000, most_suffixes: int = 10_000, seed: int = 5) -> tuple[Trees, dict, float]:
    """Trees from at most ``bound`` rows ``url, blocked`` (0 or 1), those of least hash.

    Every second row counts suffixes, the others train the trees, so a share says nothing
    of the label it helps to predict. The ``most_suffixes`` most frequent suffixes are kept.
    """
    able = labelled.filter(F.col("blocked").isin(0, 1) & F.col("url").isNotNull()).select(
        "url", F.col("blocked").cast("int").alias("blocked"), F.xxhash64(F.lit(seed), "url").alias("_at"))
    rows = least_hashed(able, bound, "_at", "url", "blocked").toPandas()
    y = rows.blocked.to_numpy(float)
    prior = float((y.sum() + 1) / (len(y) + 2))
    blocked, total = Counter(), Counter()
    for url, b in zip(rows.url[::2], y[::2], strict=True):
        for s in suffixes(url):
            blocked[s] += b
            total[s] += 1
    shares = {s: (blocked[s], float(n)) for s, n in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most_suffixes]}
    x = np.array([features(url, shares, prior) for url in rows.url[1::2]], float).reshape(len(y) // 2, WIDTH)
    return boost(x, y[1::2], trees=80, depth=4), shares, prior


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 0.5,
                id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages``.

    ``score`` is the trees' probability of being blocked; it decides where no rule fits. Null
    and empty URLs and those without ``://`` have an empty host and path, which no rule
    fits. Repeated rows are judged alike. Without labels of both classes the score is the
    smoothed share of blocked ones. Other columns are not read; an empty table gives no rows.
    """
    model, shares, prior = fit_urls(labelled, **options)

    @F.pandas_udf("double")
    def scored(url: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.array([features(u, shares, prior) for u in url], float).reshape(len(url), WIDTH)))

    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), scored(url).alias("score"))
    rows = rows.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    return rows.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def labelled_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``url, blocked`` of the pages that a rule judges or whose document has a quality label.

    The number in a page's path names the document it was made from; a document of quality
    0 makes its URL one to block, where no rule says otherwise.
    """
    url = F.col("url")
    rows = pages.select("url", host_of(url).alias("host"), path_of(url).alias("path"))
    fit = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("url", fit["verdict"].alias("verdict"), F.expr(r"try_cast(regexp_extract(path, '/([0-9]{1,18})', 1) as bigint)").alias("_doc"))
    known = labels.select(F.col("doc_id").alias("_doc"), F.col("quality").cast("int").alias("quality")).groupBy("_doc").agg(
        F.min("quality").alias("quality"))
    return rows.join(known, "_doc", "left").select(
        "url", F.when(F.col("verdict").isNotNull(), (F.col("verdict") == "block").cast("int")).otherwise(1 - F.col("quality")).alias("blocked"))
