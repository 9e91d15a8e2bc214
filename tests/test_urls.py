"""URL functions against the standard library and fixed cases."""

from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.functions.macros import Macros, job_macros


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


CANON = {
    "HTTP://Www.Example.COM": "http://www.example.com/",
    "http://a.b/c?z=1&a=2&a=1#f": "http://a.b/c?a=1&a=2&z=1",
    "http://a.b/?a-b=1&a=1": "http://a.b/?a=1&a-b=1",
    "http://a.b:8080/%7e%c3?": "http://a.b:8080/%7E%C3",
    "http://a.b/für x?q=é": "http://a.b/f%C3%BCr%20x?q=%C3%A9",
    "http://a.b/?b=&a": "http://a.b/?a&b=",
}


@pytest.mark.parametrize("url", CANON)
def test_canonical(spark, url):
    assert one(spark, urls.canonical_url(F.lit(url))) == CANON[url]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.text("xyz%é ", max_size=3)), max_size=4))
def test_canonical_properties(spark, pairs):
    query = "&".join(f"{k}={v}" for k, v in pairs)
    turned = "&".join(f"{k}={v}" for k, v in reversed(pairs))
    first = one(spark, urls.canonical_url(F.lit("http://h/p?" + query)))
    assert one(spark, urls.canonical_url(F.lit("http://h/p?" + turned + "#frag"))) == first
    assert one(spark, urls.canonical_url(F.lit(first))) == first


REFS = ["/a", "b", "../b", "./c/./d", "?q=1", "#f", "//h2/x", "https://h3/y?z#w", "", "../../..", "/x/../y/", "d/..",
        "mailto:a@b", "/a?b=/../c", " x "]


@pytest.mark.parametrize("base", ["http://h/p/q/r?s=1#t", "https://h", "http://h/p/"])
def test_resolve_as_the_standard_library(spark, base):
    df = spark.createDataFrame([(r,) for r in REFS], "r string")
    got = {r.r: r.x for r in df.select("r", urls.resolve(urls.base_parts(F.lit(base)), F.col("r")).alias("x")).collect()}
    for ref in REFS:
        expected = urljoin(base, ref.strip())
        if ref == "":
            expected = expected.split("#")[0]
        assert got[ref] == expected, ref


def test_host_and_domains(spark):
    assert one(spark, urls.host(F.lit("http://u:p@Www.A.com:80/x"))) == "www.a.com"
    assert one(spark, urls.host_suffixes(F.lit("a.b.c"))) == ["a.b.c", "b.c", "c"]
    for host, inside in {"a.com": True, "x.a.com": True, "ba.com": False}.items():
        assert one(spark, urls.in_domains(F.lit(host), ["a.com"])) is inside


def test_page_range(spark):
    url = F.lit("http://h/f?pn=4")
    assert one(spark, urls.in_page_range(url, r"pn=(\d+)")) is True
    assert one(spark, urls.in_page_range(url, r"pn=(\d+)", 1, 4)) is False
    assert one(spark, urls.in_page_range(url, r"page=(\d+)")) is False


def test_split_and_build(spark):
    row = one(spark, urls.split_url(F.lit("http://h/p?a=1&b=&a=2+3&c=%C3%A9#f")))
    assert row.base == "http://h/p#f" and row["query"] == {"a": "2 3", "c": "é"}
    built = one(spark, urls.query_string(urls.string_map({"b": "x y*~", "a": "é"})))
    assert built == "a=%C3%A9&b=x+y%2A%7E"


def test_decode(spark):
    assert one(spark, urls.decode_percent(F.lit("http://h/%E4%BB%8A+%2B"))) == "http://h/今++"
    assert one(spark, urls.decode_percent(F.lit("http://h/%zz"))) == "http://h/%zz"


MACROS = [
    ("$A ${A}x $$ $B ${", "1 1x $ $B ${"),
    ("${COL0}/${COL2}", "k1,k2/k2"),
    ("${FOO} ${low} ${A}", "page ${low} 1"),
    ("plain", "plain"),
    ("", ""),
]


@pytest.mark.parametrize("template, expected", MACROS)
def test_macros(spark, template, expected):
    page_vars = urls.string_map({"FOO": "page", "A": "hidden", "low": "no"})
    env = Macros({"A": F.lit("1")}, F.lit("k1,k2"), ",", page_vars)
    assert one(spark, env.expand(template)) == expected


def test_macro_values_that_are_no_text(spark):
    env = job_macros(F.current_timestamp())
    assert one(spark, env.expand(5)) == 5
    assert one(spark, env.expand("${keyword}")) == "${keyword}"
