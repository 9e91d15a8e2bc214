"""XPath and CSS subsets, read at plan time and evaluated as array functions.

A selector becomes ``filter``/``transform`` over a page's ``nodes`` array, so it
runs inside the JVM next to the data and needs no shuffle. What the subset
cannot express raises ``ValueError`` on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.base import let

Test = Callable[[Column], Column]
#: What a quoted value in a test stands for: itself, or a Column where it names something of the row.
Bind = Callable[[str], "str | Column"]

_STEP = re.compile(r"(//|/)?(\*|@?[\w-]+(?::[\w-]+)?(?:\(\))?|\.)((?:\[(?:[^\]\"']|\"[^\"]*\"|'[^']*')*\])*)")
_PREDICATE = re.compile(r"\[((?:[^\]\"']|\"[^\"]*\"|'[^']*')*)\]")
_ATOM = re.compile(
    r"""\s*(?:(not)\()?\s*(?:
        (contains|starts-with)\(\s*@([\w:-]+)\s*,\s*("[^"]*"|'[^']*')\s*\)
      | @([\w:-]+)(?:\s*(!?=)\s*("[^"]*"|'[^']*'))?
    )\s*(\))?\s*""", re.X)
_CSS_PART = re.compile(
    r"""(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)
      |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]
      |:(?P<pseudo>first-child|last-child|nth-child\((?P<n>\d+)\))
      |::(?P<out>text|attr\((?P<oattr>[\w:-]+)\))
      |(?P<comb>\s*>\s*|\s+)""", re.X)


@dataclass(frozen=True)
class Position:
    """Place among siblings: from the front (``at`` > 0) or the back (``at`` <= 0)."""

    at: int
    of_tag: bool = True


@dataclass(frozen=True)
class Step:
    descend: bool
    tag: str
    tests: tuple = ()               # Test or Position, in written order
    attrs: frozenset = frozenset()  # attribute names the tests read


@dataclass(frozen=True)
class Selector:
    steps: tuple[Step, ...]
    absolute: bool
    attr: str | None = None         # read this attribute of the last step's nodes
    index: int | None = None        # ``(...)[n]``: the n-th match of
    grouped: int = 0                # the first ``grouped`` steps

    @property
    def gives_text(self) -> bool:
        return bool(self.steps) and self.steps[-1].tag == "#text"


def parse_selector(text: str, bind: Bind = str) -> Selector:
    """``css:...`` is CSS, anything else XPath. ``bind`` is asked for each quoted value."""
    return parse_css(text[4:], bind) if text.startswith("css:") else parse_xpath(text, bind)


def parse_xpath(text: str, bind: Bind = str) -> Selector:
    path = text.strip()
    group = re.fullmatch(r"\((/[^()]*(?:\([^()]*\)[^()]*)*)\)\[(\d+)\](/.*)?", path)
    if group:
        head, tail = parse_xpath(group[1], bind), parse_xpath("." + group[3], bind) if group[3] else None
        if head.attr or head.gives_text or head.index:
            raise ValueError(f"unsupported XPath {text!r}")
        steps = head.steps + (tail.steps if tail else ())
        return Selector(steps, True, tail.attr if tail else None, int(group[2]), len(head.steps))
    steps, attr, end = [], None, 0
    for m in _STEP.finditer(path):
        slash, name, tests = m.groups()
        if m.start() != end or attr or (steps and not slash):
            raise ValueError(f"unsupported XPath {text!r}")
        end = m.end()
        if name == ".":
            if slash or tests or steps:
                raise ValueError(f"unsupported XPath {text!r}")
        elif name.startswith("@"):
            if slash == "//" or tests:
                raise ValueError(f"unsupported XPath {text!r}")
            attr = name[1:].lower()
        elif name == "text()":
            steps.append(_step(slash == "//", "#text", tests, text, bind))
        elif name.endswith(")"):
            raise ValueError(f"unsupported XPath {text!r}")
        else:
            steps.append(_step(slash == "//", name.lower(), tests, text, bind))
    if end != len(path) or not (steps or attr or path == "."):
        raise ValueError(f"unsupported XPath {text!r}")
    if any(s.tag == "#text" for s in steps[:-1]) or (attr and steps and steps[-1].tag == "#text"):
        raise ValueError(f"unsupported XPath {text!r}")
    return Selector(tuple(steps), path.startswith("/"), attr)


def _step(descend: bool, tag: str, predicates: str, source: str, bind: Bind) -> Step:
    tests, attrs = [], set()
    for body in _PREDICATE.findall(predicates):
        place = re.fullmatch(r"\s*(?:(\d+)|last\(\)\s*(?:-\s*(\d+))?)\s*", body)
        if place:
            at = int(place[1]) if place[1] else -int(place[2] or 0)
            tests.append(Position(at, of_tag=tag != "*"))
            continue
        tests.append(_any(re.split(r"\s+or\s+", body), attrs, source, bind))
    return Step(descend, tag, tuple(tests), frozenset(attrs))


def _any(alternatives: list[str], attrs: set, source: str, bind: Bind) -> Test:
    groups = [[_atom(a, attrs, source, bind) for a in re.split(r"\s+and\s+", alt)] for alt in alternatives]

    def test(n: Column) -> Column:
        out = None
        for group in groups:
            every = group[0](n)
            for one in group[1:]:
                every = every & one(n)
            out = every if out is None else out | every
        return out

    return test


def _atom(body: str, attrs: set, source: str, bind: Bind) -> Test:
    m = _ATOM.fullmatch(body)
    if not m or bool(m[1]) != bool(m[8]):
        raise ValueError(f"unsupported predicate [{body}] in {source!r}")
    name = (m[3] or m[5]).lower()
    attrs.add(name)
    value = bind((m[4] or m[7] or "''")[1:-1])
    op = m[2] or m[6] or "has"
    return _attribute_test(name, {"=": "=", "!=": "!=", "has": "has", "contains": "*=", "starts-with": "^="}[op],
                           value, negate=bool(m[1]))


def _attribute_test(name: str, op: str, value: str | Column, negate: bool = False) -> Test:
    def test(n: Column) -> Column:
        a = F.try_element_at(n["attrs"], F.lit(name))
        hit = {
            "has": lambda: a.isNotNull(),
            "=": lambda: a == value,
            "!=": lambda: a != value,
            "*=": lambda: a.contains(value),
            "^=": lambda: a.startswith(value),
            "$=": lambda: a.endswith(value),
            "|=": lambda: (a == value) | a.startswith(F.concat(F.lit(value), F.lit("-"))),
            "~=": lambda: F.array_contains(F.split(a, r"\s+", -1), value),
        }[op]()
        hit = F.coalesce(hit, F.lit(False))
        return ~hit if negate else hit
    return test


def parse_css(text: str, bind: Bind = str) -> Selector:
    """Compound selectors joined by blank or ``>``; ``::text`` and ``::attr(x)`` at the end."""
    steps, attr, end = [], None, 0
    tag, tests, attrs, descend, seen = "*", [], set(), True, False

    def close():
        steps.append(Step(descend, tag, tuple(tests), frozenset(attrs)))

    source = text.strip()
    for m in _CSS_PART.finditer(source):
        if m.start() != end or attr or (steps and steps[-1].tag == "#text"):
            raise ValueError(f"unsupported CSS {text!r}")
        end = m.end()
        if m["comb"]:
            close()
            tag, tests, attrs, descend, seen = "*", [], set(), ">" not in m["comb"], False
            continue
        if m["tag"]:
            tag = m["tag"].lower()
        elif m["id"] or m["cls"] or m["attr"]:
            name, op, value = ("id", "=", m["id"]) if m["id"] else ("class", "~=", m["cls"]) if m["cls"] else \
                (m["attr"].lower(), m["op"] or "has", bind((m["val"] or "").strip("\"'")))
            attrs.add(name)
            tests.append(_attribute_test(name, op, value))
        elif m["pseudo"]:
            at = {"f": 1, "l": 0}.get(m["pseudo"][0], int(m["n"] or 0))
            tests.append(Position(at, of_tag=False))
        elif m["oattr"]:
            attr = m["oattr"].lower()
        else:
            close()
            tag, tests, attrs, descend = "#text", [], set(), False
        seen = True
    if end != len(source) or not seen:
        raise ValueError(f"unsupported CSS {text!r}")
    close()
    return Selector(tuple(steps), True, attr)


def relative(selector: Selector) -> Selector:
    """CSS selectors are evaluated below the row's node, never from the page root."""
    return replace(selector, absolute=False)


# --- evaluation -----------------------------------------------------------------
#
# Found nodes are their places in the page's ``nodes`` array, in document order. What lies
# below a node is the run of places up to its ``end``, so a step reads that run and no more,
# and a loop over many rows reads the page once, not once a row.

def node_at(nodes: Column, at: Column) -> Column:
    return F.get(nodes, at)


def span(nodes: Column, at: Column | None) -> Column:
    """The places below the node at ``at``; null or -1 is the page."""
    first, last = (F.lit(0), F.size(nodes) - 1) if at is None else (
        at + 1, F.when(at >= 0, node_at(nodes, at)["end"]).otherwise(F.size(nodes) - 1))
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def select_nodes(nodes: Column, selector: Selector, context: Column | None = None) -> Column:
    """Places of matching nodes in document order; ``context`` is the place of one node, null or -1 the document."""
    if selector.absolute:
        context = None
    if not selector.steps:
        top = F.filter(span(nodes, None), lambda i: node_at(nodes, i)["parent"] == -1)
        return top if context is None else F.when(context >= 0, F.array(context)).otherwise(top)
    out = _one_step(nodes, selector.steps[0], context)
    for i, step in enumerate(selector.steps[1:], 1):
        out = _next_step(nodes, step, out if selector.grouped != i else F.slice(out, selector.index, 1))
    return F.slice(out, selector.index, 1) if selector.grouped == len(selector.steps) else out


def _next_step(nodes: Column, step: Step, found: Column) -> Column:
    """From every node found; those below nested ones are met more than once."""
    out = F.flatten(F.transform(found, lambda c: _one_step(nodes, step, c)))
    return F.sort_array(F.array_distinct(out) if step.descend else out)


def _one_step(nodes: Column, step: Step, context: Column | None) -> Column:
    head, rest = _leading_tests(step.tests)

    def base(i: Column) -> Column:
        n = node_at(nodes, i)
        out = (n["tag"] != "#text") if step.tag == "*" else (n["tag"] == step.tag)
        if not step.descend:
            out = out & (n["parent"] == (F.lit(-1) if context is None else F.coalesce(node_at(nodes, context)["pre"], F.lit(-1))))
        for test in head:
            out = out & (_place(n, test) if isinstance(test, Position) else test(n))
        return out

    found = F.filter(span(nodes, context), base)
    for test in rest:
        found = _keep_place(nodes, found, test.at) if isinstance(test, Position) else F.filter(found, lambda i, t=test: t(node_at(nodes, i)))
    return found


def _leading_tests(tests: tuple) -> tuple[list, list]:
    """A position right after the tag is a stored number; later ones are counted."""
    if tests and isinstance(tests[0], Position):
        head = [tests[0]]
        for i, t in enumerate(tests[1:], 1):
            if isinstance(t, Position):
                return head, list(tests[i:])
            head.append(t)
        return head, []
    split = next((i for i, t in enumerate(tests) if isinstance(t, Position) and t.of_tag), len(tests))
    return list(tests[:split]), list(tests[split:])


def _place(n: Column, p: Position) -> Column:
    front, back = ("nth", "nth_last") if p.of_tag else ("pos", "pos_last")
    return n[front] == p.at if p.at > 0 else n[back] == 1 - p.at


def _keep_place(nodes: Column, found: Column, at: int) -> Column:
    """The ``at``-th of the nodes found below each parent (from the back if not above 0).

    Sorted by parent, a node is the ``at``-th if the one ``at - 1`` before it has its parent and the one before that has not.
    """
    near, far = (1 - at, -at) if at > 0 else (-at, 1 - at)

    def kept(same: Column) -> Column:
        parent = lambda k: F.get(same, k)["p"]
        return F.filter(same, lambda x, k: (parent(k + near) == x["p"]) & F.coalesce(parent(k + far) != x["p"], F.lit(True)))

    by_parent = F.sort_array(F.transform(found, lambda i: F.struct(node_at(nodes, i)["parent"].alias("p"), i.alias("i"))))
    return F.sort_array(F.transform(let(by_parent, kept), lambda x: x["i"]))


def read_values(nodes: Column, found: Column, selector: Selector, source: Column) -> Column:
    """Text of the selected nodes: attribute, text node, or the source of the element.

    ``source`` is the page as binary: offsets are bytes, so a slice costs its own length.
    """
    if selector.attr:
        values = F.transform(found, lambda i: F.try_element_at(node_at(nodes, i)["attrs"], F.lit(selector.attr)))
        return F.filter(values, lambda v: v.isNotNull())
    if selector.gives_text:
        return F.transform(found, lambda i: node_at(nodes, i)["text"])
    return F.transform(offsets(nodes, found), lambda n: outer_html(n, source))


def offsets(nodes: Column, found: Column) -> Column:
    """``struct<start,stop>`` of found nodes. Taken before the source is cut: Spark leaves a Python reader in the
    plan, unevaluated, when one lambda over another reader's result needs both its nodes and its source.
    """
    return F.transform(found, lambda i: F.struct(node_at(nodes, i)["start"].alias("start"), node_at(nodes, i)["stop"].alias("stop")))


def outer_html(n: Column, source: Column) -> Column:
    return F.substr(source, n["start"] + 1, n["stop"] - n["start"]).cast("string")


def select_values(nodes: Column, selector: Selector, source: Column, context: Column | None = None) -> Column:
    return read_values(nodes, select_nodes(nodes, selector, context), selector, source)


@dataclass(frozen=True)
class Wanted:
    """What the page reader must emit for a set of selectors."""

    tags: frozenset = frozenset()
    attrs: frozenset = frozenset()
    text_of: frozenset = frozenset()  # parents whose text is read; '*' is all
    places: bool = False              # positions among siblings are tested

    @staticmethod
    def of(selectors, tags=(), attrs=()) -> "Wanted":
        tags, attrs, text_of, places = set(tags), set(attrs), set(), False
        for s in selectors:
            for i, step in enumerate(s.steps):
                tags.add(step.tag)
                attrs |= step.attrs
                places |= any(isinstance(t, Position) for t in step.tests)
                if step.tag == "#text":
                    parent = s.steps[i - 1].tag if i and not step.descend else "*"
                    text_of.add(parent)
            if s.attr:
                attrs.add(s.attr)
                if not s.steps:
                    tags.add("*")
        return Wanted(frozenset(tags), frozenset(attrs), frozenset(text_of), places)
