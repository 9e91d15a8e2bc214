"""Links, rules, walk on a small site."""

import pytest
from pyspark.sql import functions as F

from pageloom.operators import links
from pageloom.operators.items import choose_item_pages, extract_html_items
from pageloom.operators.links import LinkRule, extract_links
from pageloom.operators.walk import walk, walked_pages

HUB = """<html><head><base href="http://s/root/"></head><body><div class=dir><a href="n1?x=1&amp;y=2"> One </a>
<A HREF='n2'>Two<b>!</b></A><a href="n2">Two!</a></div><!-- <a href="hidden">h</a> -->
<script>document.write('<a href="script">s</a>')</script>
<area href="/map"><a name="x">no</a><a href="mailto:a@b">m</a><a href="javascript:go()">j</a><a href=http://other.org/>o</a>
</body></html>"""


def site(spark, pages):
    rows = [(i, u, "<html>" + "".join(f'<a href="{h}">{h}</a>' for h in hrefs)) for i, (u, hrefs) in enumerate(pages.items())]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


@pytest.fixture(scope="module")
def hub(spark):
    return spark.createDataFrame([(1, "http://s/list", HUB)], "page_id bigint, url string, html string")


def found(df):
    return [(r.rule, r.url, r.text) for r in df.orderBy("rule_idx", "pos").collect()]


def test_anchors_and_base(hub):
    assert found(extract_links(hub)) == [
        ("all", "http://s/root/n1?x=1&y=2", "One"), ("all", "http://s/root/n2", "Two!"), ("all", "http://s/map", ""),
        ("all", "http://other.org/", "o")]


@pytest.mark.parametrize("tag, url", [
    ('<a href="/l?a=1&region=eu&section=2&param=x&copy=1">', "/l?a=1&region=eu&section=2&param=x&copy=1"),
    ('<a href="/l?x=1&amp;amp;y">', "/l?x=1&amp;y"), ('<a title="a > b" href="/one">', "/one"),
    ('<a data-note="see href=/wrong" href=\'/right\'>', "/right"), ("<a data-href=/wrong hreflang=en href=/right/>", "/right/"),
    ('<a title=\'"\' class=a/b HREF = "/x y">', "/x%20y"), ('<a title="t"href="/near">', "/near"), ("<a name=n>", None)])
def test_anchor_attributes(spark, tag, url):
    pages = spark.createDataFrame([(1, "http://s/p", f"<html><body>{tag}go</a></body></html>")], "page_id bigint, url string, html string")
    plain, region = ([(r.url, r.text) for r in extract_links(pages, [LinkRule("r", css=css)]).collect()] for css in (None, "body"))
    assert plain == region
    assert [u.replace(" ", "%20") for u, _ in plain] == ([] if url is None else ["http://s" + url])


def test_region_gives_the_same_as_plain_reading(hub):
    plain = extract_links(hub).drop("rule", "pos")
    region = extract_links(hub, [LinkRule("all", xpath="//body")]).drop("rule", "pos")
    assert sorted(map(str, plain.collect())) == sorted(map(str, region.collect()))
    assert [u for _, u, _ in found(extract_links(hub, [LinkRule("r", css="div.dir")]))] == [
        "http://s/root/n1?x=1&y=2", "http://s/root/n2"]
    assert [u for _, u, _ in found(extract_links(hub, [LinkRule("r", xpath="//div[@class='dir']/a[last()-1]")]))] == [
        "http://s/root/n2"]


def test_rules(hub):
    rules = [LinkRule("n", regex=r"/n(\d)", follow=False), LinkRule("rest", follow=None), LinkRule("off", match="nowhere")]
    rows = extract_links(hub, rules).orderBy("rule_idx", "pos").collect()
    assert [(r.rule, r.do_follow, r.do_parse) for r in rows] == [
        ("n", False, True), ("n", False, True), ("rest", True, True), ("rest", True, True)]
    assert extract_links(hub, [LinkRule("off", match="nowhere")]).count() == 0
    assert [u for _, u, _ in found(extract_links(hub, domains=["other.org"]))] == ["http://other.org/"]


def test_page_range_sub_and_order_of_steps(spark):
    pages = site(spark, {"http://s/f": [f"?pn={i}" for i in (0, 1, 4, 5, "x")]})
    rule = dict(name="p", regex=r"pn=(\d+)", pages={"start": 1, "stop": 5}, sub={"from": r"\?pn=(\d)", "to": r"/p\1"})
    assert [u for _, u, _ in found(extract_links(pages, [rule]))] == ["http://s/f/p1", "http://s/f/p4"]
    late = {**rule, "regex": r"/p(\d+)"}
    assert [u for _, u, _ in found(extract_links(pages, [late], sub_first=True))] == ["http://s/f/p1", "http://s/f/p4"]
    assert extract_links(pages, [late]).count() == 0
    with pytest.raises(ValueError):
        extract_links(pages, [{"name": "p", "pages": {"stop": 3}}])


def test_vars_and_keyword_go_with_the_links(spark):
    pages = spark.createDataFrame(
        [(1, "http://s/", "<title>T</title><a href=a>a</a>", "kw", {"OLD": "1", "low": "2", "FOO": "old"})],
        "page_id bigint, url string, html string, keyword string, vars map<string,string>")
    row = extract_links(pages, [LinkRule("r", vars={"FOO": "//title/text()", "BAR": "//h1/text()", "x": "//h1"})]).first()
    assert row.keyword == "kw" and row.vars == {"OLD": "1", "FOO": "T", "BAR": ""}
    pages2 = pages.select("page_id", "url", "html", "vars")
    assert extract_html_items(pages2, {"x": {"value": "${OLD}-${low}"}}).first().x == "1-${low}"


def test_walk(spark):
    pages = site(spark, {
        "http://s/": ["/a", "/b", "http://other/x"], "http://s/a": ["/c", "/", "/a#top"], "http://s/b": ["/c?y=2&x=1", "/item1"],
        "http://s/c": ["/d"], "http://s/c?x=1&y=2": ["/e"], "http://s/d": [], "http://s/lost": ["/"], "http://s/item1": ["/far"]})
    rules = [LinkRule("items", regex="item", follow=False), LinkRule("dirs")]
    seeds = spark.createDataFrame([("http://s/",)], "url string")
    reached = walk(pages, seeds, rules, max_depth=9, domains=["s"])
    assert {r.url: r.depth for r in reached.collect()} == {
        "http://s/": 0, "http://s/a": 1, "http://s/b": 1, "http://s/c": 2, "http://s/c?y=2&x=1": 2, "http://s/item1": 2,
        "http://s/d": 3, "http://s/e": 3}
    assert {r.url for r in walked_pages(pages, walk(pages, seeds, rules, 1, ["s"])).collect()} == {
        "http://s/", "http://s/a", "http://s/b"}
    every = extract_links(pages, rules, domains=["s"])
    assert {r.url for r in choose_item_pages(pages, every).collect()} == {"http://s/item1"}
    assert choose_item_pages(pages, every, seeds).count() == 2


def test_next_pages_and_bad_urls(spark):
    pages = site(spark, {"http://s/f": ["?pn=1", "?pn=9", "http://0.0.0.0/"]})
    assert [r.url for r in links.next_page_links(pages, r"pn=(\d+)").collect()] == ["http://s/f?pn=1"]
    assert links.drop_bad_urls(extract_links(pages)).count() == 2


def test_is_html(spark):
    rows = [("<html>", {"content-type": "text/html"}), ("x", {"Content-Type": "TEXT/HTML; a"}), ("<html>", {"a": "b"})]
    df = spark.createDataFrame(rows, "html string, headers map<string,string>")
    assert df.filter(links.is_html(df)).count() == 2
    bare = spark.createDataFrame([(" <!DOCTYPE html>",), ("<!-- c --><HTML>",), ("{}",)], "html string")
    assert bare.filter(links.is_html(bare)).count() == 2


def test_links_need_no_shuffle_and_no_python(spark, hub):
    plan = extract_links(hub, [LinkRule("a", regex="n"), LinkRule("b")])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    region = extract_links(hub, [LinkRule("a", css="div.dir"), LinkRule("b", xpath="//body", vars={"T": "//title"})])
    plan = region._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_keep_domains_has_no_cross_join(spark, hub):
    domains = spark.createDataFrame([("org",), ("nope.s",)], "domain string")
    kept = links.keep_domains(extract_links(hub), domains)
    assert [r.url for r in kept.collect()] == ["http://other.org/"]
    assert "NestedLoop" not in kept._jdf.queryExecution().executedPlan().toString()


def test_first_wins_table(spark):
    rows = [(1, 0, 1, "u", "a"), (1, 0, 0, "u", "a"), (1, 1, 0, "u", "a"), (1, 1, 0, "u", "b"), (2, 5, 5, "u", "a")]
    df = spark.createDataFrame(rows, "src_page_id int, rule_idx int, pos int, url string, text string")
    got = sorted((r.src_page_id, r.rule_idx, r.pos, r.text) for r in links.first_wins(df).collect())
    assert got == [(1, 0, 0, "a"), (1, 1, 0, "b"), (2, 5, 5, "a")]
    assert "WindowGroupLimit" in links.first_wins(df)._jdf.queryExecution().executedPlan().toString()


def test_long_page_of_one_anchor_text(spark):
    """No deep recursion in the patterns: a megabyte in one anchor."""
    big = "<html><a href=x>" + "y " * 500_000 + "</a>" + "<" * 1000
    pages = spark.createDataFrame([(1, "http://s/", big)], "page_id bigint, url string, html string")
    assert extract_links(pages).select(F.length("text").alias("n")).first().n == 999_999


def test_rules_name_the_site_and_the_clock(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from pageloom.functions.macros import fixed_columns
    from pageloom.operators.links import LinkRule, extract_links
    html = "<div id=y2020><a href='/a2020'>in</a></div><a href='/shop/1$'>out</a>"
    pages = spark.createDataFrame([(1, "http://m/2020", html)], "page_id int, url string, html string")
    names = fixed_columns(F.lit(datetime(2020, 2, 28)), site="shop")

    def texts(**rule):
        return [r.text for r in extract_links(pages, [LinkRule("r", **rule)], names=names).collect()]
    assert texts(regex="/${SITE}/\\d") == ["out"] and texts(xpath="//div[@id='y${YEAR}']") == ["in"] and texts(css="#y$YEAR") == ["in"]
    assert texts(match="m/${YEAR}$") == ["in", "out"] and texts(match="m/${MONTH}$") == [] and texts(regex="a(?:2020$|b)") == ["in"]
    for bad in ({"regex": "${URL}"}, {"xpath": "//a[@id='${keyword}']"}, {"match": "${COL1}"}):
        with pytest.raises(ValueError):
            texts(**bad)
