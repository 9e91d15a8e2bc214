"""Rows out of pages: loop, fields, cleaning, required-field rule, storage names.

The whole extraction is one generator expression over the page row: it gives the
finished rows of a page, incomplete ones left out, so the page is read once, no
page source or node array is copied per row and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import all_matches, empty_strings, let
from ..functions.jsonpath import cut_json, variant_text, variant_values
from ..functions.macros import Macros, fill, fixed_columns, fixed_values, job_macros
from ..functions.parse import Step, Values, compile_parser, markup_stages, parser, reads_markup, run
from ..functions.urls import url_sha1
from .dom import read_page
from .selectors import Bind, Selector, Wanted, node_at, parse_selector, relative, select_nodes, select_values, span

Hook = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Field:
    """One output column. ``value`` wins over ``css``, ``css`` over ``xpath``."""

    value: object = None
    css: str | None = None
    xpath: str | None = None
    jpath: str | None = None
    regex: str | None = None
    parse: object = None
    default: object = None
    name: str | None = None      # storage name; without one the field is not stored
    multi: bool = False
    opt: bool = False
    upsert: bool = False

    def selector(self, bind: Bind = str) -> Selector | None:
        if self.value is not None:
            return None
        if self.css:
            return relative(parse_selector("css:" + self.css, bind))
        return parse_selector(self.xpath, bind) if self.xpath else None


Fields = Mapping[str, Field | Mapping]


def as_fields(fields: Fields) -> dict[str, Field]:
    out = {k: f if isinstance(f, Field) else Field(**f) for k, f in fields.items()}
    if "image_urls" in out:  # media fields always hold several values
        out["image_urls"] = Field(**{**out["image_urls"].__dict__, "multi": True})
    return out


@dataclass(frozen=True)
class Job:
    """What templates may name: the clock, the site, the keyword separator."""

    now: Column | None = None
    tz: str = "+00:00"
    site: str = ""
    conf: str = ""
    sep: str | None = None

    def clock(self) -> Column:
        return F.current_timestamp() if self.now is None else self.now

    def fixed(self, spark: SparkSession, templates: Iterable) -> dict[str, str]:
        """Values, at plan time, of the names in ``templates`` that no page changes."""
        return fixed_values(spark, fixed_columns(self.clock(), self.tz, self.site, self.conf), templates)

    def macros(self, pages: DataFrame) -> Macros:
        keyword = F.coalesce(F.col("keyword"), F.lit("")) if "keyword" in pages.columns else F.lit("")
        page_vars = F.col("vars") if "vars" in pages.columns else None
        return job_macros(self.clock(), self.tz, F.col("url"), keyword, self.sep, self.site, self.conf, page_vars)


def _filled(fields: dict[str, Field], loop: str | None, spark: SparkSession, job: Job) -> tuple[dict[str, Field], str | None]:
    """Selectors and paths with the job's own names filled in; the loop may have no others."""
    fixed = job.fixed(spark, [loop, *(getattr(f, part) for f in fields.values() for part in ("css", "xpath", "jpath"))])
    fields = {k: replace(f, css=fill(f.css, fixed), xpath=fill(f.xpath, fixed), jpath=fill(f.jpath, fixed, last=True)) for k, f in fields.items()}
    return fields, fill(loop, fixed, last=True)


def extract_html_items(pages: DataFrame, fields: Fields, loop: str | None = None, job: Job = Job(),
                       keep: Iterable[str] = ("page_id",), page_hook: Hook | None = None,
                       drop_incomplete: bool = True, errors: str | None = None) -> DataFrame:
    """Items of HTML pages; one per node matched by ``loop`` (default: one per page).

    Selectors may name what the job has (clock, ``SITE``, ``CONF``), and in quoted values what the page
    has (``URL``, ``keyword``, ``COLn``, page variables). Pages that are empty or that the reader cannot
    take give no items; with ``errors``, the name of one more column, each gives a row without field
    values that says there what was wrong (see ``split_errors``).
    """
    pages = pages.transform(page_hook) if page_hook else pages
    macros = job.macros(pages)
    fields, loop = _filled(as_fields(fields), loop, pages.sparkSession, job)
    selectors = {k: f.selector(macros.bind) for k, f in fields.items()}
    for key, f in fields.items():
        if f.value is None and selectors[key] is None:
            raise ValueError(f"field {key!r} needs value, css or xpath")
    row = parse_selector(loop) if loop else None
    named = [s for s in (*selectors.values(), row) if s]

    # Within a loop, what is read from the page's root is read once a page, not once a row.
    of_page = [k for k, s in selectors.items() if row and s and s.absolute]

    def raw(key: str, nodes: Column, source: Column, context: Column, page: Column | None) -> Values:
        if selectors[key] is None:
            return _constant(fields[key], macros)
        return Values(page[key] if key in of_page else select_values(nodes, selectors[key], source, context), many=True)

    def per_context(row_of: Callable[[Callable[[str], Values]], Column]) -> Column:
        nodes = F.col("_nodes")
        contexts = select_nodes(nodes, row) if row else F.slice(F.filter(span(nodes, None), lambda i: node_at(nodes, i)["tag"] != "#text"), 1, 1)

        def rows_of(source: Column, page: Column | None = None) -> Column:
            return F.flatten(F.transform(contexts, lambda c: row_of(lambda k: raw(k, nodes, source, c, page))))

        def read_once(source: Column) -> Column:
            page = F.struct(*[select_values(nodes, selectors[k], source).alias(k) for k in of_page])
            return let(page, lambda p: rows_of(source, p))

        return let(F.col("html").cast("binary"), read_once if of_page else rows_of)

    error = F.when(F.col("html").isNull() | (F.trim("html") == ""), "empty page")
    if not named:
        pages = pages.withColumn("_error", error)
        return _rows(pages, keep, _finish(fields, lambda k: _constant(fields[k], macros), macros, job, drop_incomplete), errors)
    pages = pages.withColumn("_read", read_page(F.col("html"), Wanted.of(named))).withColumns(
        {"_nodes": F.col("_read.nodes"), "_error": F.coalesce(error, F.col("_read.error"))})
    return _finished_rows(pages, fields, [k for k, s in selectors.items() if s], per_context, keep, macros, job, drop_incomplete, errors)


def _finished_rows(pages: DataFrame, fields: dict[str, Field], found: list[str],
                   per_context: Callable[[Callable[[Callable[[str], Values]], Column]], Column], keep: Iterable[str],
                   macros: Macros, job: Job, drop_incomplete: bool, errors: str | None) -> DataFrame:
    """Rows of all contexts, the fields in ``found`` read there.

    Where a parser reads markup, a second page reader works on what was selected, so that is made rows
    first, and again before each further one.
    """
    def finished(raw_of: Callable[[str], Values], steps: Mapping[str, list[Step]] | None = None) -> Column:
        return _finish(fields, raw_of, macros, job, drop_incomplete, steps)

    if not any(reads_markup(f.parse) for f in fields.values()):
        return _rows(pages, keep, per_context(finished), errors)
    others = [c for c in ("url", "keyword", "vars") if c in pages.columns and c not in keep]
    stages = {k: markup_stages(compile_parser(fields[k].parse, job.clock())) for k in found}

    def raw(raw_of: Callable[[str], Values]) -> Column:
        return F.array(F.struct(*[_grep(raw_of(k), fields[k].regex).array().alias(f"_raw_{k}") for k in found]))

    rows, dtypes = _rows(pages, [*keep, *others], per_context(raw), "_error" if errors else None), dict.fromkeys(found, "string")
    for i in range(max(map(len, stages.values())) - 1):
        done = {k: run(stages[k][i], Values(F.col(f"_raw_{k}"), dtypes[k], True)) if i < len(stages[k]) - 1 else
                Values(F.col(f"_raw_{k}"), dtypes[k], True) for k in found}
        dtypes = {k: v.dtype for k, v in done.items()}
        held = [*keep, *others, *(["_error"] if errors else [])]
        rows = rows.select(*held, F.inline(F.array(F.struct(*[v.array().alias(f"_raw_{k}") for k, v in done.items()]))))
    return _rows(rows, keep, finished(
        lambda k: Values(F.col(f"_raw_{k}"), dtypes[k], True) if k in found else _constant(fields[k], macros),
        {k: s[-1] for k, s in stages.items()}), errors)


def _rows(pages: DataFrame, keep: Iterable[str], items: Column, errors: str | None) -> DataFrame:
    """One row per item; with ``errors``, also one for each page with an ``_error``, in which all else is null."""
    if errors is None:
        return pages.select(*keep, F.inline(items))
    kind = pages.select(items.alias("items")).schema["items"].dataType.elementType
    failed = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields], F.col("_error").alias(errors))
    good = F.transform(items, lambda r: F.struct(*[r[f.name].alias(f.name) for f in kind.fields], F.lit(None).cast("string").alias(errors)))
    return pages.select(*keep, F.inline(F.when(F.col("_error").isNull(), good).otherwise(F.array(failed))))


def split_errors(rows: DataFrame, errors: str, keep: Iterable[str] = ("page_id",)) -> tuple[DataFrame, DataFrame]:
    """``(items, quarantine)`` of rows that were extracted with ``errors``.

    Both are filters on the same rows: write the rows, or cut their lineage, first, and pages are read once.
    """
    return rows.filter(F.col(errors).isNull()).drop(errors), rows.filter(F.col(errors).isNotNull()).select(*keep, errors)


def extract_json_items(pages: DataFrame, fields: Fields, loop: str = "$[]", job: Job = Job(),
                       container: str = "object", body: str = "body", keep: Iterable[str] = ("page_id",),
                       page_hook: Hook | None = None, drop_incomplete: bool = True, errors: str | None = None) -> DataFrame:
    """Items of JSON pages (also JSONP); one per match of ``loop``.

    ``loop`` and ``jpath`` may name what the job has. Pages without JSON give no items; ``errors`` is as for HTML.
    """
    pages = pages.transform(page_hook) if page_hook else pages
    macros = job.macros(pages)
    fields, loop = _filled(as_fields(fields), loop, pages.sparkSession, job)
    for key, f in fields.items():
        if f.value is None and f.jpath is None:
            raise ValueError(f"field {key!r} needs value or jpath")

    def raw(key: str, element: Column) -> Values:
        f = fields[key]
        if f.value is not None:
            return _constant(f, macros)
        texts = F.transform(variant_values(element, f.jpath), variant_text)
        return Values(F.filter(texts, lambda x: x.isNotNull()), many=True)

    text = F.col(body)
    if dict(pages.dtypes)[body] == "binary":
        text = F.make_valid_utf8(text.cast("string"))
    document = F.try_parse_json(cut_json(text, container))
    pages = pages.withColumn("_error", F.when(document.isNull(), "no JSON") if errors else F.lit(None).cast("string"))

    def per_context(row_of: Callable[[Callable[[str], Values]], Column]) -> Column:
        return F.flatten(F.transform(variant_values(document, loop), lambda e: row_of(lambda k: raw(k, e))))

    found = [k for k, f in fields.items() if f.value is None]
    return _finished_rows(pages, fields, found, per_context, keep, macros, job, drop_incomplete, errors)


def _constant(f: Field, macros: Macros) -> Values:
    dtype = {bool: "boolean", int: "bigint", float: "double"}.get(type(f.value), "string")
    return Values(macros.expand(f.value).cast(dtype), dtype)


def _finish(fields: dict[str, Field], raw: Callable[[str], Values], macros: Macros, job: Job,
            drop_incomplete: bool, steps: Mapping[str, list[Step]] | None = None) -> Column:
    """Array of no or one finished row: regex, parse, default, required rule, scalarise.

    ``steps`` are what is left of the parsers of fields that were begun before.
    """
    lists, dtypes, needed = [], {}, []
    for key, f in fields.items():
        values = raw(key)
        if steps and key in steps:
            values = run(steps[key], values)
        else:
            values = parser(f.parse, job.clock())(_grep(values, f.regex))
        dtypes[key] = values.dtype
        lists.append(_with_default(key, f, values, macros).alias(key))
        if not (f.multi or f.opt):
            needed.append(key)

    def scalar(row: Column, key: str) -> Column:
        return row[key] if fields[key].multi or not drop_incomplete else F.get(row[key], F.lit(0))

    def finish(row: Column) -> Column:
        done = F.array(F.struct(*[scalar(row, k).alias(k) for k in fields]))
        if not (drop_incomplete and needed):
            return done
        complete = F.size(row[needed[0]]) > 0
        for key in needed[1:]:
            complete = complete & (F.size(row[key]) > 0)
        return F.when(complete, done).otherwise(F.slice(done, 1, 0))

    return let(F.struct(*lists), finish)


def _grep(values: Values, regex: str | None) -> Values:
    if not regex:
        return values
    if not values.many:
        return Values(F.coalesce(all_matches(values.column, regex), empty_strings()), many=True)
    return Values(F.flatten(F.transform(values.column, lambda x: all_matches(x, regex))), many=True)


def _with_default(key: str, f: Field, values: Values, macros: Macros) -> Column:
    array = values.array()
    if f.parse in ("len",) or (isinstance(f.parse, (list, tuple)) and f.parse and f.parse[-1] == "len"):
        array = F.filter(array, lambda n: n != 0)  # a count of nothing is empty
    if f.default is None:
        return array
    literal = macros.expand(f.default)
    if isinstance(f.default, (int, float)) and values.dtype == "string":
        raise ValueError(f"default of {key!r} must be text")
    if isinstance(f.default, str) and values.dtype in ("bigint", "double"):
        raise ValueError(f"default of {key!r} must be a number")
    return F.when(F.size(array) == 0, F.array(literal.cast(values.dtype))).otherwise(array)


def store_columns(items: DataFrame, fields: Fields, keep: Iterable[str] = ()) -> DataFrame:
    """Only fields with a storage ``name``, under that name."""
    named = {k: f.name for k, f in as_fields(fields).items() if f.name}
    if len(set(named.values())) < len(named):
        raise ValueError(f"two fields share a storage name: {sorted(named.values())}")
    return items.select(*keep, *[F.col(k).alias(n) for k, n in named.items()])


def upsert_keys(fields: Fields) -> list[str]:
    return [f.name for f in as_fields(fields).values() if f.name and f.upsert]


def broken_pages(pages: DataFrame, source: str = "html") -> DataFrame:
    """Pages without a body, for a quarantine table; ``errors`` of ``extract_html_items`` also tells of those the reader cannot take."""
    return pages.filter(F.col(source).isNull() | (F.trim(source) == ""))


def broken_json(pages: DataFrame, body: str = "body", container: str = "object") -> DataFrame:
    parsed = F.try_parse_json(cut_json(F.col(body), container))
    return pages.filter(parsed.isNull())


def follow_redirects(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """A hook may set ``redirect_url``: such a row is replaced by the captured target page.

    Target pages are parsed as they are; the hook does not run on them again. Of several
    captures of one address the lowest ``page_id`` counts; it is found on the narrow
    columns, so page sources are shuffled only for the pages asked for.
    """
    content = [c for c in ("url", "html", "body") if c in targets.columns]
    stay = pages.filter(F.col("redirect_url").isNull()).drop("redirect_url")
    moved = pages.filter(F.col("redirect_url").isNotNull()).select(
        url_sha1(F.col("redirect_url")).alias("_sha1"), *[c for c in pages.columns if c not in ("redirect_url", *content)])
    first = targets.groupBy(url_sha1(F.col("url")).alias("_sha1")).agg(F.min("page_id").alias("_target"))
    source = targets.select(F.col("page_id").alias("_target"), *content)
    found = moved.join(first, "_sha1").join(source, "_target").drop("_sha1", "_target")
    return stay.unionByName(found)


def choose_item_pages(pages: DataFrame, links: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Pages that give items: targets of links to be parsed, and the seeds if given."""
    wanted = links.filter("do_parse").select("url")
    if seeds is not None:
        wanted = wanted.union(seeds.select("url"))
    return pages.join(wanted.distinct(), "url", "left_semi")
