"""Parser cases: spec, input values, expected values."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.functions.base import java_regex, java_replacement
from pageloom.functions.parse import compile_parser, parse_array, register_parser

CASES = [
    ("str", [" a ", "　b "], ["a", "b"]),
    ({}, [" a "], [" a "]),
    ("text", ["<p>a <b>b</b></p> ", "a < b > c"], ["a b", "a < b > c"]),
    ("norm", ["  a \n\t b  "], ["a b"]),
    ("trim", ["\x1c x  "], ["x"]),
    ("unesc", ["salt&amp;pepper", "&#9731;&#x41;&bogus;&apos;&", "&amp;lt;", "&#00000065;&#x0000041;&#99999999999999999999;&#xFFFFFFFFFFFFFFFFFF;"],
     ["salt&pepper", "☃A&bogus;'&", "&lt;", "AA&#99999999999999999999;&#xFFFFFFFFFFFFFFFFFF;"]),
    ("int", ["1,234", "no -5 x", "- 5", "x", "EUR  7", "99999999999999999999"], [1234, -5, 0, 0, 7, 0]),
    ("float", ["1.5x", "1.2.3", "-2,000.25", "", "EUR 6.5"], [1.5, 0.0, -2000.25, 0.0, 6.5]),
    ("head", ["a", "b"], ["a"]),
    ("tail", ["a", "b", "c"], ["b", "c"]),
    ("tail", [], []),
    ("last", ["a", "b"], ["b"]),
    ("last", [], []),
    ("len", ["a", "b"], [2]),
    ("len", [], [0]),
    ("join", ["a", "b"], ["a b"]),
    ({"type": "join", "sep": ", "}, [], [""]),
    ({"type": "list", "sep": "|"}, ["<i> a </i>", " b"], ["a|b"]),
    ({"type": "grep", "pattern": r"\d+"}, ["a1b22", "c"], ["1", "22"]),
    ({"type": "grep", "pattern": r"(\w)=(\d)"}, ["a=1 b=2"], ["a", "1", "b", "2"]),
    ("grep", ["x\ny"], ["x", "y"]),
    ({"type": "sub", "from": r"(\w+)@(\w+)", "to": "\\g<2>:\\g<1>"}, ["at box@shelf now"], ["at shelf:box now"]),
    ({"type": "sub", "from": "SIDE", "to": ["left", "right"]}, ["shoe_SIDE"], ["shoe_left", "shoe_right"]),
    ({"type": "sub", "from": "a", "to": "$"}, ["a1"], ["$1"]),
    ({"type": "sub", "from": "(?P<x_y>b)", "to": r"[\g<x_y>\g<1>0]"}, ["abc"], ["a[bb0]c"]),
    ({"type": "tee", "tee": ["upper", "lower"]}, ["oNe", "y"], ["ONE", "one", "Y", "y"]),
    ({"type": "default", "value": "none"}, ["", "a"], ["none", "a"]),
    (["int", {"type": "default", "value": 9}], ["0", "3"], [9, 3]),
    ({"type": "map", "map": {"^a": "A", "b$": "B"}, "default": "?"}, ["ax", "xb", "xx"], ["A", "B", "?"]),
    ({"type": "map", "map": {"(b)": r"<\1>"}}, ["abc", "x"], ["<b>"]),
    ({"type": "jpath", "query": "$.a.b[1]"}, ['cb({"a": {"b": [1, 2]}});'], ["2"]),
    ({"type": "jpath", "query": "$[*].a", "container": "list"}, ['x = [{"a": 1}, {"b": 2}, {"a": "z"}];'], ["1", "z"]),
    ({"type": "jpath", "query": "$.none"}, ['{"a": 1}', "broken {", "{]}"], []),
    ("base64", ["aGk=", "*"], ["hi"]),
    ("clean", ["<p onclick='x'>a<script>b</script><style>c</style><link rel=x><!-- d --></p>"], ["<p>a</p>"]),
    ({"type": "filter", "$gt": "b", "$lt": "d"}, ["a", "b", "c", "d"], ["c"]),
    ({"type": "filter", "$eq": "a", "$gt": "c", "not": True}, ["a", "b", "d"], ["b"]),
    ({"type": "filter", "$in": "abc"}, ["ab", "x"], ["ab"]),
    ({"type": "filter", "$in": "b", "swap": True}, ["ab", "x"], ["ab"]),
    ({"type": "filter", "string": "endswith", "args": ["(2014)"], "not": True}, ["x (2014)", "y"], ["y"]),
    (["int", {"type": "filter", "$gte": 3}], ["1", "3"], [3]),
    ("join", ["a", "b"], ["a b"]),
    ("upper", ["straße"], ["STRAßE"]),
    ("title", ["it's a-b"], ["It'S A-B"]),
    ("swapcase", ["aBc"], ["AbC"]),
    ("capitalize", ["aBC"], ["Abc"]),
    ("split", [" a  b ", ""], ["a", "b"]),
    ({"type": "string", "method": "split", "args": ["."]}, ["a.b."], ["a", "b", ""]),
    ("splitlines", ["a\r\nb\n", ""], ["a", "b"]),
    ({"type": "string", "method": "zfill", "args": [4]}, ["7", "-7", "12345"], ["0007", "-007", "12345"]),
    ({"type": "string", "method": "count", "args": ["a"]}, ["banana"], [3]),
    ({"type": "string", "method": "find", "args": ["n"]}, ["banana", "x"], [2, -1]),
    ({"type": "string", "method": "istitle"}, ["Ab Cd", "aB"], [True, False]),
    (["text", "norm", {"type": "xpath", "query": "//i"}], ["<b>x</b>"], []),
    ({"type": "xpath", "query": "//h2/text()"}, ["<div><h2>a</h2><p><h2>b</h2></p></div>"], ["a", "b"]),
    ({"type": "purge", "query": "//h2"}, ["<div>a<h2>x</h2>é<p>q<h2>y</h2></p>c</div>"], ["<div>aé<p>q</p>c</div>"]),
    ({"type": "purge", "query": "//x"}, ["<div>a</div>"], ["<div>a</div>"]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_case(spark, case):
    spec, values, expected = CASES[case]
    df = spark.createDataFrame([(values,)], "v array<string>").repartition(1)
    assert df.select(parse_array(F.col("v"), spec).alias("v")).first().v == expected


@pytest.mark.parametrize("spec", ["nope", {"type": "nope"}, {"type": "filter", "min": 3},
                                  {"type": "jpath", "query": "$..a"}, {"type": "filter", "string": "nope"}])
def test_bad_specs_fail_at_plan_time(spark, spec):
    with pytest.raises(ValueError):
        df = spark.createDataFrame([(["{}"],)], "v array<string>")
        df.select(parse_array(F.col("v"), spec))


def test_register_parser(spark):
    register_parser("twice", lambda x: F.concat(x, x))
    df = spark.createDataFrame([(["a"],)], "v array<string>")
    assert df.select(parse_array(F.col("v"), ["twice", "upper"]).alias("v")).first().v == ["AA"]


def test_regex_dialect():
    assert java_regex(r"(?P<a_b>x)(?P=a_b)") == r"(?<au95b>x)\k<au95b>"
    assert java_replacement(r"\g<1>0$\n") == "$1\\0\\$\n"


TEXTS = st.lists(st.text(max_size=12), min_size=1, max_size=6)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_properties(spark, values):
    values = [v.replace("\x00", "") for v in values]
    df = spark.createDataFrame([(values,)], "v array<string>")
    v = F.col("v")
    row = df.select(
        parse_array(v, "trim").alias("trim"), parse_array(v, ["norm"]).alias("norm"),
        parse_array(v, ["norm", "norm"]).alias("norm2"),
        F.concat(parse_array(v, "head"), parse_array(v, "tail")).alias("both"),
        F.concat(parse_array(v, {"type": "filter", "$lt": "m"}),
                 parse_array(v, {"type": "filter", "$lt": "m", "not": True})).alias("parts")).first()
    assert row.trim == [x.strip() for x in values]
    assert row.norm == row.norm2
    assert row.both == values
    assert sorted(row.parts) == sorted(values)


def test_plain_chain_stays_scalar(spark):
    """One value in, one value out: no array function in the plan."""
    from pageloom.functions.parse import Values, run
    out = run(compile_parser(["text", "norm", "lower", "head", "int"]), Values(F.col("x")))
    assert not out.many and out.dtype == "bigint"
    plan = spark.createDataFrame([("1",)], "x string").select(out.column)._jdf.queryExecution().toString()
    assert "lambda" not in plan
