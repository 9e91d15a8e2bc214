"""Item extraction on small pages."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pageloom.operators import items, quality
from pageloom.operators.items import Field, Job, extract_html_items, extract_json_items, store_columns, upsert_keys
from pageloom.operators.page_reader import read_nodes
from pageloom.operators.selectors import parse_selector

SHOP = """<!DOCTYPE html><html><head><title>Tea &amp; 茶</title></head><body>
<h1> Green  pot (9 cups) </h1><section class="facts"><h3>facts</h3>holds <b>much<br></section>
<div id=shots><a><img src="/front.png"></a><img src='/back.png'/></div>
<table><tr class="offer"><td><a href=7>tin</a></td><td>350</td></tr>
<tr class="offer sale"><td><a href="8">bag</a><td>90<tr class="note"><td>tax</table>
<div id="voices"><p> fine </p><p>dear<p>again</div><script>if (a < b) { "</p><h1>no</h1>" }</script></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://m/1", SHOP), (2, "http://m/2", "<p>empty"), (3, "http://m/3", None), (4, "http://m/4", "")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def first(pages, fields, **kw):
    rows = extract_html_items(pages.filter("page_id = 1"), fields, **kw).collect()
    return rows[0].asDict() if rows else None


SELECTORS = {
    "//h1": ["<h1> Green  pot (9 cups) </h1>"],
    "//title/text()": ["Tea & 茶"],
    "//tr[@class='offer']/td[1]/a/@href": ["7"],
    "//tr/td[1]/a/@href": ["7", "8"],
    "//table/tr[last()]/td/text()": ["tax"],
    "//table/tr[last()-1]/td[2]/text()": ["90"],
    "//tr[contains(@class, 'offer')][2]/td/a/text()": ["bag"],
    "(//td)[2]/text()": ["350"],
    "//div[@id='shots']//img/@src": ["/front.png", "/back.png"],
    "//div[@id='voices']/p/text()": [" fine ", "dear", "again"],
    "//div[@id='voices']/*[2]/text()": ["dear"],
    "/html/body/h1/text()": [" Green  pot (9 cups) "],
    "//div[@id]/@id": ["shots", "voices"],
    "//section[not(@id)]/@class": ["facts"],
    "//*[@id='shots' or @class='facts']/@class": ["facts"],
    "//tr[starts-with(@class,'offer') and @class!='offer']/@class": ["offer sale"],
    "css:tr.offer td:first-child > a::attr(href)": ["7", "8"],
    "css:div#shots img[src$=png]::attr(src)": ["/front.png", "/back.png"],
    "css:p:last-child::text": ["again"],
    "css:section.facts b::text": ["much"],
    "css:p:nth-child(2)::text": ["dear"],
    "//nothing": [],
}


@pytest.mark.parametrize("selector", SELECTORS)
def test_selector(pages, selector):
    field = {"css": selector[4:]} if selector.startswith("css:") else {"xpath": selector}
    assert first(pages, {"x": {**field, "multi": True}})["x"] == SELECTORS[selector]


@pytest.mark.parametrize("bad", ["//a[position()<3]", "//a/following::b", "count(//a)", "//a[text()='x']", "a b", "css:a,b",
                                 "css:a:hover", "//@href", "css:"])
def test_unsupported_selectors_fail_at_plan_time(bad):
    with pytest.raises(ValueError):
        parse_selector(bad)


def test_offsets_are_bytes():
    source = SHOP.encode()
    everything = frozenset(["*"])
    for n in read_nodes(source, everything, frozenset(), frozenset()):
        cut = source[n[10]:n[11]]
        assert cut.lower().startswith(b"<" + n[3].encode())
    numbers = [n[0] for n in read_nodes(source, everything, frozenset(), everything)]
    assert numbers == list(range(len(numbers)))


@pytest.mark.parametrize("soup", [b"", b"<", b"<<<>>", b"</p></p>", b"<a href='x", b"<p <b>", b"<!-- x", b"<script>x", b"<p>" * 50,
                                  "<é ü=1>".encode(), b"\xff\xfe<p>\xff", b"<li><ul><li></ul></li>", b"text only"])
def test_any_bytes_can_be_read(soup):
    read_nodes(soup, frozenset(["*"]), frozenset(["href"]), frozenset(["*"]))


def test_job_with_every_kind_of_field(pages):
    fields = {
        "page": {"value": "${URL}#top"},
        "cups": {"xpath": "//h1/text()", "parse": [{"type": "grep", "pattern": r"(\d+) cups"}, "int"]},
        "facts": {"css": "section.facts", "opt": True, "parse": [{"type": "purge", "query": "h3"}, "text", "upper"]},
        "prices": {"xpath": "//tr/td[2]/text()", "parse": "int", "multi": True},
    }
    rows = extract_html_items(pages, fields).collect()
    assert [r.asDict() for r in rows] == [{
        "page_id": 1, "page": "http://m/1#top", "cups": 9, "facts": "HOLDS MUCH", "prices": [350, 90]}]


def test_loop_rows_and_absolute_paths(pages):
    rows = extract_html_items(pages, {"cell": {"xpath": "td[1]/a/text()"}, "head": {"xpath": "//h1/text()", "parse": "trim"},
                                      "second": {"xpath": "./td[2]/text()", "parse": "int", "default": -1}}, loop="//table/tr")
    assert [(r.cell, r["head"], r.second) for r in rows.collect()] == [("tin", "Green  pot (9 cups)", 350), ("bag", "Green  pot (9 cups)", 90)]
    css = extract_html_items(pages, {"cell": {"css": "td::text", "default": "none"}}, loop="css:table tr.offer")
    assert [r.cell for r in css.collect()] == ["350", "90"]


def test_text_before_the_root_is_not_the_root(spark):
    pages = spark.createDataFrame([(1, "u", "\n <html><p>a</p> b</html>")], "page_id int, url string, html string")
    row = extract_html_items(pages, {"all": {"xpath": ".//text()", "multi": True}, "p": {"xpath": "p/text()"}}).first()
    assert row["all"] == ["a", " b"] and row.p == "a"


def test_required_optional_multi_default(pages):
    assert first(pages, {"x": {"xpath": "//none"}}) is None
    got = first(pages, {"o": {"xpath": "//none", "opt": True}, "m": {"xpath": "//none", "multi": True},
                        "d": {"xpath": "//none", "default": "on ${TODAY}"}, "n": {"xpath": "//p", "parse": "len"},
                        "r": {"xpath": "//h1", "regex": r"\((\d+) cups", "parse": "int"}},
                job=Job(now=F.lit(datetime(2020, 2, 28, 20)), tz="+08:00"))
    assert got == {"page_id": 1, "o": None, "m": [], "d": "on 2020-02-29", "n": 3, "r": 9}
    assert first(pages, {"n": {"xpath": "//none", "parse": "len"}}) is None


def test_spec_errors():
    with pytest.raises(ValueError):
        Field(xpath="//a[").selector()
    with pytest.raises(TypeError):
        items.as_fields({"x": {"nope": 1}})


def test_field_without_selector_or_with_wrong_default(pages):
    for bad in ({"x": {"parse": "int"}}, {"x": {"xpath": "//p", "parse": "int", "default": "a"}}):
        with pytest.raises(ValueError):
            extract_html_items(pages, bad)


def test_store_columns(pages):
    fields = {"a": {"value": 1, "name": "n", "upsert": True}, "b": {"value": "x"}}
    stored = store_columns(extract_html_items(pages, fields), fields, keep=["page_id"])
    assert stored.columns == ["page_id", "n"] and upsert_keys(fields) == ["n"]
    with pytest.raises(ValueError):
        store_columns(stored, {"a": {"value": 1, "name": "n"}, "b": {"value": 1, "name": "n"}})


def test_json_pages(spark):
    rows = [(1, "u", b'{"r": [{"a": 1, "b": {"c": "x"}}, {"a": null}]}'), (2, "u", b'cb({"r": [{"a": "7", "b": {}}]});'),
            (3, "u", b"{broken"), (4, "u", b"none"), (5, "u", b'{"r": {}}')]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, body binary")
    fields = {"a": {"jpath": "$.a", "parse": "int"}, "c": {"jpath": "$.b.c", "opt": True}, "u": {"value": "${URL}"}}
    got = extract_json_items(pages, fields, loop="$.r[*]").orderBy("page_id").collect()
    assert [(r.page_id, r.a, r.c, r.u) for r in got] == [(1, 1, "x", "u"), (2, 7, None, "u")]
    text = pages.withColumn("body", F.col("body").cast("string"))
    assert {r.page_id for r in items.broken_json(text).collect()} == {3, 4}


def test_quality_counts_what_is_dropped(pages):
    fields = {"h": {"xpath": "//h1"}, "p": {"xpath": "//p"}}
    parsed = extract_html_items(pages, fields, drop_incomplete=False)
    got = {r.field: (r.missing, r.total) for r in quality.field_quality(parsed, fields).collect()}
    assert got == {"h": (1, 2), "p": (0, 2)}
    assert {r.page_id for r in items.broken_pages(pages).collect()} == {3, 4}


def python_stages(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_one_python_stage_for_ten_fields(pages):
    fields = {f"f{i}": {"xpath": f"//div[{i + 1}]/p/text()", "parse": "norm", "opt": True} for i in range(10)}
    df = extract_html_items(pages, fields)
    assert python_stages(df) == 1
    assert python_stages(df.filter("f1 is null").select("page_id")) == 1
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_filter_on_address_goes_below_the_page_reader(pages):
    df = extract_html_items(pages, {"h": {"xpath": "//h1"}}).filter("page_id = 2")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("page_id#" if "Filter" not in plan else "Filter")


def test_constants_need_no_python(pages):
    assert python_stages(extract_html_items(pages, {"u": {"value": "${URL}"}})) == 0


def wide_page(n):
    return "<table>" + "".join(f"<tr class='c{i % 3}'><td>{i}</td><td><b>{i * 2}</b><i>x</i></td></tr>" for i in range(n)) + "</table>"


def test_wide_loop_costs_by_the_row(spark):
    import time
    fields = {"a": {"xpath": "td[1]/text()", "parse": "int"}, "b": {"css": "td b::text"}, "k": {"xpath": "./@class"}}

    def seconds(n):
        pages = spark.createDataFrame([(1, "u", wide_page(n))], "page_id int, url string, html string")
        df = extract_html_items(pages, fields, loop="//table//tr[@class!='c0']")
        best = 1e9
        for _ in range(3):
            start = time.time()
            rows = df.collect()
            best = min(best, time.time() - start)
        assert [(r.a, r.b, r.k) for r in rows] == [(i, str(2 * i), f"c{i % 3}") for i in range(n) if i % 3]
        return best
    seconds(500)
    assert seconds(8000) < 3 * seconds(4000) + 0.5


NESTED = "<div><p class=x>1<div id=in><p>2</p><p class=x>3</p><div><p class=x>4</p></div></div><p class=x>5</p></div><p class=x>6</p>"


@pytest.mark.parametrize("selector, want", [
    ("//div//p/text()", ["1", "2", "3", "4", "5"]), ("//div//p[@class='x'][2]/text()", ["5"]),
    ("//div//p[@class='x'][last()]/text()", ["3", "4", "5"]), ("//div/div//p[@class='x'][last()-0]/text()", ["3", "4"]),
    ("//div//div//p/text()", ["2", "3", "4"]), ("(//p[@class='x'])[3]/text()", ["4"]), ("css:div div p.x::text", ["4"]),
    ("css:div > p:last-child::text", ["4"])])
def test_nested_contexts_give_each_node_once_in_order(spark, selector, want):
    pages = spark.createDataFrame([(1, "u", NESTED)], "page_id int, url string, html string")
    field = {"css": selector[4:]} if selector.startswith("css:") else {"xpath": selector}
    assert extract_html_items(pages, {"x": {**field, "multi": True}}).first().x == want


def test_end_is_the_place_of_the_last_returned_descendant():
    nodes = read_nodes(NESTED.encode(), frozenset(["p", "div"]), frozenset(), frozenset(["p"]))
    for at, n in enumerate(nodes):
        inside = [k for k, m in enumerate(nodes) if n[0] < m[0] <= n[1]]
        assert n[12] == max(inside, default=at) and inside == list(range(at + 1, n[12] + 1))


def test_selectors_name_the_job_and_the_page(spark):
    html = "<p id=k1>one</p><p id='http://m/1'>two</p><p id=v>three</p><p id='$x'>four</p><p id=2020>five</p>"
    pages = spark.createDataFrame([(1, "http://m/1", html, "k0 k1", {"VAR": "v"})],
                                  "page_id int, url string, html string, keyword string, vars map<string,string>")
    job = Job(now=F.lit(datetime(2020, 2, 28)), site="p")

    def value(xpath, **more):
        return extract_html_items(pages, {"x": {"xpath": xpath}}, job=job, **more).first().x
    assert value("//p[@id='${COL2}']/text()") == "one"
    assert value("//${SITE}[@id='${URL}']/text()") == "two"
    assert value("//p[contains(@id, '$VAR')]/text()") == "three"
    assert value("//p[@id='$$x']/text()") == value("//p[@id='$x']/text()") == "four"
    assert value("text()", loop="//${SITE}[@id='${YEAR}']") == "five"
    for field, more in (({"xpath": "//p[@id='${NAME}']"}, {}), ({"css": "${lower}"}, {}), ({"xpath": "//p"}, {"loop": "//p[@id='${URL}']"})):
        with pytest.raises(ValueError):
            extract_html_items(pages.drop("vars"), {"x": field}, job=job, **more)


def test_json_paths_name_the_job(spark):
    pages = spark.createDataFrame([(1, "u", '{"shop": [{"a2020": 5}]}')], "page_id int, url string, body string")
    job = Job(now=F.lit(datetime(2020, 2, 28)), site="shop")
    assert extract_json_items(pages, {"x": {"jpath": "$.a${YEAR}"}}, loop="$.${SITE}[*]", job=job).first().x == "5"
    with pytest.raises(ValueError):
        extract_json_items(pages, {"x": {"jpath": "$.${URL}"}}, job=job)


def test_pages_that_cannot_be_read_tell_why(pages, spark):
    deep = spark.createDataFrame([(5, "u", "<b>" * 5000)], "page_id bigint, url string, html string")
    for fields in ({"h": {"xpath": "//h1"}}, {"h": {"xpath": "//h1", "parse": [{"type": "xpath", "query": "."}, {"type": "purge", "query": "b"}]}},
                   {"h": {"value": "x", "multi": True}}):
        rows = extract_html_items(pages.union(deep), fields, errors="why")
        good, bad = items.split_errors(rows, "why")
        reasons = {r.page_id: r.why for r in bad.collect()}
        assert reasons.items() >= {3: "empty page", 4: "empty page"}.items() and "h" in good.columns
        assert ("value" in fields["h"]) or "nested deeper" in reasons[5] and {r.page_id for r in good.collect()} == {1}
        assert {r.page_id for r in extract_html_items(pages.union(deep), fields).collect()} >= {1}
    json = spark.createDataFrame([(1, "u", '{"a": 1}'), (2, "u", "{a")], "page_id int, url string, body string")
    rows = extract_json_items(json, {"a": {"jpath": "$.a", "parse": "int"}}, errors="why").collect()
    assert sorted((r.page_id, r.a, r.why) for r in rows) == [(1, 1, None), (2, None, "no JSON")]


def test_markup_steps_one_after_the_other_and_in_branches(spark):
    html = "<ul><li><a>x<b>1</b></a></li><li>y<a></a></li><li></li></ul><ul></ul>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")
    chain = [{"type": "xpath", "query": "//li"}, {"type": "purge", "query": "b"}, {"type": "xpath", "query": "a/text()"}, "upper"]
    row = extract_html_items(pages, {
        "chain": {"xpath": "//ul", "parse": chain, "multi": True}, "count": {"xpath": "//ul", "parse": [chain[0], "len"], "multi": True},
        "plain": {"xpath": "//b/text()", "parse": "int"}}).first()
    assert row.chain == ["X"] and row["count"] == [3] and row.plain == 1
    per_entry = {"type": "tee", "tee": [{"type": "xpath", "query": "//a"}, ["text", "upper"]]}
    row = extract_html_items(pages, {"x": {"xpath": "//li", "parse": [per_entry], "multi": True}}).first()
    assert row.x == ["<a>x<b>1</b></a>", "X1", "<a></a>", "Y", ""]
    nested = {"type": "tee", "tee": [{"type": "tee", "tee": [{"type": "purge", "query": "a"}, "text"]}, "len"]}
    with pytest.raises(ValueError):
        extract_html_items(pages, {"x": {"xpath": "//li", "parse": [{"type": "tee", "tee": [chain]}], "multi": True}})
    with pytest.raises(ValueError):
        extract_html_items(pages, {"x": {"xpath": "//li", "parse": [nested], "multi": True}})  # text beside numbers


def test_wide_loop_reads_the_page_once_for_absolute_selectors_and_in_many_tasks(spark):
    from time import perf_counter

    from pageloom.plans.item_queries import wide_pages
    from pageloom.plans.registry import Tables
    fields = {"id": {"xpath": "./td[1]/text()"}, "last": {"xpath": "//tr[@class != 'de'][last()]/td[1]/text()"}}
    pages = spark.createDataFrame([(n, "u", wide_page(n)) for n in (0, 3, 6000)], "page_id int, url string, html string")
    began = perf_counter()
    rows = extract_html_items(pages, fields, loop="//table//tr").collect()
    assert perf_counter() - began < 60  # 6000 times the page's nodes take minutes
    assert {n: len([r for r in rows if r.page_id == n]) for n in (0, 3, 6000)} == {0: 0, 3: 3, 6000: 6000}
    assert all(r.last == str(r.page_id - 1) for r in rows)

    class Documents(Tables):
        documents = spark.range(5000).selectExpr("id as doc_id", "'en' as lang", "'s' as source", "1 as n_chars")
    assert wide_pages(Documents(spark, "")).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
