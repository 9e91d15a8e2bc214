"""Field cleaning: a parser spec becomes Column expressions at plan time.

A field value is a list. Two forms are carried:

* scalar: one nullable Column; null is the empty list. Stays in generated code.
* array: ``array<T>``; used as soon as a step can give several values.

Steps that map one value to one value are plain functions, and neighbours are
fused into one ``transform``; executors never see the spec.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates, text
from .base import all_matches, let, strip
from .jsonpath import cut_json, json_values


@dataclass(frozen=True)
class Values:
    """A list of values of one type, as a scalar or as an array Column."""

    column: Column
    dtype: str = "string"
    many: bool = False

    def array(self) -> Column:
        if self.many:
            return self.column
        empty = F.array().cast(f"array<{self.dtype}>")
        return F.when(self.column.isNotNull(), F.array(self.column)).otherwise(empty)

    def first(self) -> Column:
        return F.get(self.column, F.lit(0)) if self.many else self.column

    def size(self) -> Column:
        return F.size(self.column) if self.many else self.column.isNotNull().cast("int")

    def is_empty(self) -> Column:
        return (F.size(self.column) == 0) if self.many else self.column.isNull()


@dataclass(frozen=True)
class Each:
    """Value -> value step. ``may_drop`` marks steps that can give null."""

    fn: Callable[[Column], Column]
    dtype: str | None = None      # None keeps the type
    may_drop: bool = False


@dataclass(frozen=True)
class Spread:
    """Value -> array of values step."""

    fn: Callable[[Column], Column]
    dtype: str = "string"


@dataclass(frozen=True)
class Whole:
    """Step over the whole list."""

    fn: Callable[[Values], Values]


@dataclass(frozen=True)
class Markup:
    """Step over whole lists that reads markup: from a list of lists to one. Its reader runs in Python, so it is never inside a lambda."""

    fn: Callable[[Column], Column]


@dataclass(frozen=True)
class Branches:
    """The results of several chains of steps, for each value in turn, where one of them reads markup."""

    chains: tuple[Sequence[Step], ...]
    dtype: str


Step = Each | Spread | Whole | Markup | Branches


def run_groups(steps: Sequence[Step], groups: Column, dtype: str) -> tuple[Column, str]:
    """The steps on each list of a list of lists, and the type of the values.

    Steps in the JVM are applied in a lambda; markup steps get all lists at once.
    """
    native: list[Step] = []

    def applied(done: list[Step]) -> tuple[Column, str]:
        kind = run(done, Values(F.lit(None).cast(f"array<{dtype}>"), dtype, True)).dtype
        return F.transform(groups, lambda g: run(done, Values(g, dtype, True)).array()), kind

    def regrouped(values: Column, found: Column) -> Column:
        """Each value is a list of its own; what comes of it goes back to its list by the number of values before."""
        return let(F.struct(values.alias("v"), found.alias("f")), lambda both: F.transform(both["v"], lambda g, i: F.flatten(
            F.slice(both["f"], F.size(F.flatten(F.slice(both["v"], F.lit(1), i))) + 1, F.size(g)))))

    for step in (*steps, None):
        if isinstance(step, (Each, Spread, Whole)):
            native.append(step)
            continue
        if native:
            groups, dtype = applied(native)
            native = []
        if isinstance(step, Markup):
            groups, dtype = step.fn(groups.cast("array<array<string>>")), "string"
        elif isinstance(step, Branches):
            groups, dtype = regrouped(groups, _branch_values(step, F.flatten(groups), dtype)), step.dtype
    return groups, dtype


def _branch_values(step: Branches, values: Column, dtype: str) -> Column:
    """For each value the results of all chains, one after the other."""
    alone = F.transform(values, lambda x: F.array(x))
    found = [run_groups(chain, alone, dtype)[0] for chain in step.chains]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), found)


def run(steps: Sequence[Step], values: Values) -> Values:
    pending: list[Each] = []
    for step in steps:
        if isinstance(step, Each):
            pending.append(step)
            if not step.may_drop:
                continue
        values, pending = _map_each(values, pending), []
        if isinstance(step, Spread):
            values = _spread(values, step)
        elif isinstance(step, Whole):
            values = step.fn(values)
        elif isinstance(step, (Markup, Branches)):
            groups, dtype = run_groups([step], F.array(values.array()), values.dtype)
            values = Values(F.get(groups, F.lit(0)), dtype, True)
    return _map_each(values, pending)


def _map_each(values: Values, steps: list[Each]) -> Values:
    if not steps:
        return values
    dtype = next((s.dtype for s in reversed(steps) if s.dtype), values.dtype)

    def fn(x: Column) -> Column:
        return reduce(lambda acc, s: s.fn(acc), steps, x)

    if not values.many:
        return Values(F.when(values.column.isNotNull(), fn(values.column)), dtype)
    out = F.transform(values.column, fn)
    if any(s.may_drop for s in steps):
        out = F.filter(out, lambda x: x.isNotNull())
    return Values(out, dtype, True)


def _spread(values: Values, step: Spread) -> Values:
    if values.many:
        out = F.flatten(F.transform(values.column, step.fn))
    else:
        out = F.coalesce(F.when(values.column.isNotNull(), step.fn(values.column)),
                         F.array().cast(f"array<{step.dtype}>"))
    return Values(F.filter(out, lambda x: x.isNotNull()), step.dtype, True)


# --- list steps -------------------------------------------------------------

def _head(v: Values) -> Values:
    return Values(F.slice(v.column, 1, 1), v.dtype, True) if v.many else v


def _tail(v: Values) -> Values:
    a = v.array()
    return Values(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), v.dtype, True)


def _last(v: Values) -> Values:
    if not v.many:
        return v
    return Values(F.slice(v.column, F.greatest(F.size(v.column), F.lit(1)), F.lit(1)), v.dtype, True)


def _len(v: Values) -> Values:
    return Values(v.size().cast("bigint"), "bigint")


def _join(sep: str) -> Callable[[Values], Values]:
    def fn(v: Values) -> Values:
        if v.many:
            return Values(F.array_join(v.column.cast("array<string>"), sep))
        return Values(F.coalesce(v.column.cast("string"), F.lit("")))
    return fn


# --- filter -----------------------------------------------------------------

_COMPARE = {
    "$eq": lambda x, y: x == y,
    "$ne": lambda x, y: x != y,
    "$lt": lambda x, y: x < y,
    "$lte": lambda x, y: x <= y,
    "$gt": lambda x, y: x > y,
    "$gte": lambda x, y: x >= y,
}
_NOT_PREDICATES = ("type", "args", "kwargs", "not", "swap")


def _predicates(spec: Mapping, now: Column) -> Callable[[Column], Column]:
    swap = bool(spec.get("swap"))
    tests: list[Callable[[Column], Column]] = []
    for op, arg in spec.items():
        if op in _NOT_PREDICATES:
            continue
        if op == "delta":
            tests.append(lambda x, a=arg: (dates.seconds(now) - dates.seconds(x)) < F.lit(a))
        elif op == "string":
            fn, kind = text.string_method(arg, spec.get("args", ()), spec.get("kwargs"))
            tests.append(fn if kind == "boolean" else lambda x, f=fn: f(x) != F.lit(0))
        elif op in ("$in", "$nin"):
            test = _membership(arg, swap)
            tests.append(test if op == "$in" else lambda x, t=test: ~t(x))
        elif op == "$regex":
            if swap:
                tests.append(lambda x, a=arg: F.regexp_like(F.lit(a), x))
            else:
                tests.append(lambda x, a=arg: x.rlike(text.java_regex(a)))
        elif op in _COMPARE:
            fn = _COMPARE[op]
            tests.append(lambda x, f=fn, a=F.lit(arg): f(a, x) if swap else f(x, a))
        else:
            raise ValueError(f"unknown filter operator {op!r}")
    if spec.get("not"):  # negates each predicate, so "not" with several means "none holds"
        tests = [lambda x, t=t: ~t(x) for t in tests]
    return lambda x: reduce(lambda a, b: a & b, [t(x) for t in tests], F.lit(True))


def _membership(arg, swap: bool):
    if isinstance(arg, str):
        return (lambda x: x.contains(arg)) if swap else (lambda x: F.lit(arg).contains(x))
    if swap:
        raise ValueError("'$in' with 'swap' needs a text operand")
    return lambda x: x.isin(list(arg))


# --- parsers by name ----------------------------------------------------------

_FALSY = {
    "string": lambda x: x == "",
    "bigint": lambda x: x == 0,
    "double": lambda x: x == 0.0,
    "boolean": lambda x: ~x,
}


def _default(value) -> Callable[[Values], Values]:
    def fn(v: Values) -> Values:
        falsy = _FALSY.get(v.dtype, lambda x: F.lit(False))
        other = F.lit(value).cast(v.dtype)
        return _map_each(v, [Each(lambda x: F.when(falsy(x), other).otherwise(x))])
    return fn


def _date(spec: Mapping, now: Column, tz: str | None = None) -> Each:
    tz = tz or spec.get("tz", "+00:00")
    fmt, on_error = spec.get("fmt", "auto"), spec.get("on_error", "epoch")
    return Each(lambda x: dates.parse_date(x.cast("string"), fmt, tz, now, on_error), "timestamp", on_error == "null")


def _string(spec: Mapping) -> Step:
    fn, kind = text.string_method(spec["method"], spec.get("args", ()), spec.get("kwargs"))
    return Spread(fn) if kind == "array" else Each(fn, kind)


def _sub(spec: Mapping) -> Step:
    targets = spec["to"] if isinstance(spec["to"], (list, tuple)) else [spec["to"]]
    if len(targets) == 1:
        return Each(lambda x: text.substitute(x, spec["from"], targets[0]), "string")
    return Spread(lambda x: F.array(*[text.substitute(x, spec["from"], t) for t in targets]))


def _list(spec: Mapping, now: Column) -> list[Step]:
    return [Each(lambda x: strip(text.strip_tags(x)), "string"), Whole(_join(spec.get("sep", " ")))]


def _tee(spec: Mapping, now: Column) -> Step:
    branches = [compile_parser(s, now) for s in spec["tee"]]
    probe = [run(b, Values(F.lit("x"))).dtype for b in branches]
    if len(set(probe)) > 1:
        raise ValueError(f"tee branches give different types: {probe}")
    if reads_markup(spec["tee"]):
        if max(map(_markup_steps, branches)) > 1:
            raise ValueError("a tee branch reads markup once at most; put the first selection before the tee")
        return Branches(tuple(branches), probe[0])
    return Spread(lambda x: F.concat(*[run(b, Values(x)).array() for b in branches]), probe[0])


def _jpath(spec: Mapping) -> Step:
    container = spec.get("container", "object")
    return Spread(lambda x: json_values(cut_json(x, container), spec["query"]))


def _fragment(kind: str) -> Callable:
    def build(spec: Mapping, now: Column) -> Step:
        from ..operators import dom  # the only parsers that read markup
        fn = dom.select_in_fragments if kind == "xpath" else dom.purge_fragments
        return Markup(lambda groups: fn(groups, spec["query"]))
    return build


_PARSERS: dict[str, Callable[[Mapping, Column], Step | list[Step]]] = {
    "identity": lambda s, now: [],
    "grep": lambda s, now: Spread(lambda x: all_matches(x, s.get("pattern", ".+"))),
    "head": lambda s, now: Whole(_head),
    "tail": lambda s, now: Whole(_tail),
    "last": lambda s, now: Whole(_last),
    "len": lambda s, now: Whole(_len),
    "join": lambda s, now: Whole(_join(s.get("sep", " "))),
    "list": _list,
    "map": lambda s, now: Each(lambda x: text.map_first(x, s["map"], s.get("default")), "string", True),
    "xpath": _fragment("xpath"),
    "purge": _fragment("purge"),
    "jpath": lambda s, now: _jpath(s),
    "int": lambda s, now: Each(text.to_int, "bigint"),
    "float": lambda s, now: Each(text.to_float, "double"),
    "epoch": lambda s, now: Each(lambda x: F.coalesce(dates.seconds(x), F.lit(0)).cast("bigint"), "bigint"),
    "default": lambda s, now: Whole(_default(s["value"])),
    "unesc": lambda s, now: Each(lambda x: let(x, text.unescape), "string"),
    "text": lambda s, now: Each(lambda x: strip(text.strip_tags(x.cast("string"))), "string"),
    "str": lambda s, now: Each(lambda x: strip(x.cast("string")), "string"),
    "trim": lambda s, now: Each(strip, "string"),
    "norm": lambda s, now: Each(text.normalize_space, "string"),
    "sub": lambda s, now: _sub(s),
    "clean": lambda s, now: Each(text.clean_markup, "string"),
    "base64": lambda s, now: Each(text.base64_text, "string", True),
    "date": lambda s, now: _date(s, now),
    "cst": lambda s, now: _date(s, now, "+08:00"),
    "string": lambda s, now: _string(s),
    "filter": lambda s, now: Each(lambda x, p=_predicates(s, now): F.when(p(x), x), None, True),
    "tee": _tee,
}


def register_parser(name: str, fn: Callable[[Column], Column], dtype: str = "string",
                    many: bool = False) -> None:
    """Add a parser: ``fn`` maps one value to one value, or to an array if ``many``."""
    step = Spread(fn, dtype) if many else Each(fn, dtype, may_drop=True)
    _PARSERS[name] = lambda spec, now: step


def compile_parser(spec, now: Column | None = None) -> list[Step]:
    """A parser spec (name, dict, or list of them) as a list of steps."""
    now = F.current_timestamp() if now is None else now
    if not spec:
        return []
    if isinstance(spec, (list, tuple)):
        return [step for part in spec for step in compile_parser(part, now)]
    if isinstance(spec, str):  # parser names win over string methods of the same name
        spec = {"type": spec} if spec in _PARSERS else {"type": "string", "method": spec}
    kind = spec.get("type", "identity")
    if kind not in _PARSERS:
        raise ValueError(f"unknown parser {kind!r}")
    built = _PARSERS[kind](spec, now)
    return built if isinstance(built, list) else [built]


def markup_stages(steps: Sequence[Step]) -> list[list[Step]]:
    """The steps, cut behind each that reads markup: Spark takes one such reader per value and projection."""
    stages: list[list[Step]] = [[]]
    for step in steps:
        stages[-1].append(step)
        if isinstance(step, (Markup, Branches)):
            stages.append([])
    return stages


def _markup_steps(steps: Sequence[Step]) -> int:
    return sum(max(map(_markup_steps, s.chains)) if isinstance(s, Branches) else isinstance(s, Markup) for s in steps)


def reads_markup(spec) -> bool:
    """The spec holds a step that selects inside fragments."""
    if isinstance(spec, (list, tuple)):
        return any(reads_markup(part) for part in spec)
    if isinstance(spec, Mapping):
        return spec.get("type") in ("xpath", "purge") or reads_markup(spec.get("tee", ()))
    return spec in ("xpath", "purge")


def parser(spec, now: Column | None = None) -> Callable[[Values], Values]:
    """Compile once, apply to any number of fields. Item extraction takes more than one markup step, a single expression does not."""
    steps = compile_parser(spec, now)
    if _markup_steps(steps) > 1:
        raise ValueError("one expression reads markup once at most; select again in a further column")
    return lambda values: run(steps, values)


def parse_array(column: Column, spec, now: Column | None = None, dtype: str = "string") -> Column:
    """Apply a spec to an ``array`` Column."""
    return parser(spec, now)(Values(column, dtype, True)).array()


def parse_value(column: Column, spec, now: Column | None = None, dtype: str = "string") -> Column:
    """Apply a spec to one value per row; the result is the array of values."""
    return parser(spec, now)(Values(column, dtype)).array()
