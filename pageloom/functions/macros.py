"""``${NAME}`` templates, read once on the driver and turned into ``concat``."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .base import strip
from .dates import shift, tz_offset
from .text import java_quote

_TEMPLATE = re.compile(r"\$(?:(\$)|([_a-zA-Z]\w*)|\{([_a-zA-Z]\w*)\})", re.ASCII)
_COLUMN = re.compile(r"COL(\d+)$")

# The clock names and how each is written.
CLOCK_FORMATS = {
    "NOW": "yyyy-MM-dd HH:mm:ss", "TODAY": "yyyy-MM-dd", "ITODAY": "yyyy-M-d",
    "YEAR": "yyyy", "MONTH": "MM", "DAY": "dd", "HOUR": "HH", "MINUTE": "mm", "SECOND": "ss",
    "IYEAR": "y", "IMONTH": "M", "IDAY": "d", "IHOUR": "H", "IMINUTE": "m", "ISECOND": "s",
}


def clock(now: Column, tz: str = "+00:00") -> dict[str, Column]:
    """Clock names at one fixed time; ``tz`` is the local zone of all but the U names."""
    offset = tz_offset(tz)
    local = shift(now, offset)
    midnight = F.unix_seconds(F.date_trunc("DAY", local)) - offset
    out = {name: F.date_format(local, fmt) for name, fmt in CLOCK_FORMATS.items()}
    return out | {
        "UTCNOW": F.date_format(now, "yyyy-MM-dd HH:mm:ss"),
        "UNOW": F.unix_seconds(now).cast("string"),
        "UTODAY": midnight.cast("string"),
        "UENDDAY": (midnight + 86399).cast("string"),
    }


def fixed_columns(now: Column, tz: str = "+00:00", site: str = "", conf: str = "") -> dict[str, Column]:
    """Names that are the same for all pages of a job."""
    return clock(now, tz) | {"SITE": F.lit(site), "CONF": F.lit(conf)}


def fixed_values(spark: SparkSession, names: Mapping[str, Column], templates: Iterable) -> dict[str, str]:
    """The values of those ``names`` that ``templates`` use, read once, when the job is planned."""
    named = {m[2] or m[3] for t in templates if isinstance(t, str) for m in _TEMPLATE.finditer(t)}
    used = sorted(named & names.keys())
    return spark.range(1).select(*[names[n].cast("string").alias(n) for n in used]).first().asDict() if used else {}


def fill(template, values: Mapping[str, str], last: bool = False):
    """``template`` with the names in ``values`` replaced. ``last`` says that nobody else will fill the rest.

    Then ``$$`` becomes ``$``, ``$NAME`` stays as written, as in regular expressions a ``$`` may stand
    before letters, and an unknown ``${NAME}`` raises ``ValueError``.
    """
    def replace(m: re.Match) -> str:
        name = m[2] or m[3]
        if name in values:
            return values[name]
        if last and m[3]:
            raise ValueError(f"unknown name {m[0]} in {template!r}")
        return "$" if last and m[1] else m[0]

    return _TEMPLATE.sub(replace, template) if isinstance(template, str) else template


@dataclass(frozen=True)
class Macros:
    """What a template may name.

    ``built_in`` wins over page variables; ``page_vars`` is a map column that is
    asked for names nobody else knows.
    """

    built_in: Mapping[str, Column] = field(default_factory=dict)
    keyword: Column | None = None
    sep: str | None = None
    page_vars: Column | None = None

    def lookup(self, name: str, written: str) -> Column:
        if name in self.built_in:
            return self.built_in[name]
        column = _COLUMN.match(name)
        if column and self.keyword is not None:
            return keyword_column(self.keyword, int(column[1]), self.sep)
        if self.page_vars is not None and name.isupper():
            return F.coalesce(F.try_element_at(self.page_vars, F.lit(name)), F.lit(written))
        return F.lit(written)

    def knows(self, name: str) -> bool:
        return name in self.built_in or bool(_COLUMN.match(name) and self.keyword is not None) \
            or self.page_vars is not None and name.isupper()

    def bind(self, value: str) -> str | Column:
        """A value in a selector: plain text, or a Column where it names something of the page. An unknown ``${NAME}`` raises."""
        found = list(_TEMPLATE.finditer(value))
        for m in found:
            if m[3] and not self.knows(m[3]):
                raise ValueError(f"unknown name {m[0]} in {value!r}")
        return self.expand(value) if any(m[1] or self.knows(m[2] or m[3]) for m in found) else value

    def expand(self, template) -> Column:
        """A template as a Column; anything that is not text is a plain literal."""
        if isinstance(template, Column):
            return template
        if not isinstance(template, str):
            return F.lit(template)
        pieces, end = [], 0
        for m in _TEMPLATE.finditer(template):
            if m.start() > end:
                pieces.append(F.lit(template[end:m.start()]))
            end = m.end()
            pieces.append(F.lit("$") if m[1] else self.lookup(m[2] or m[3], m[0]))
        if end < len(template) or not pieces:
            pieces.append(F.lit(template[end:]))
        return pieces[0] if len(pieces) == 1 else F.concat(*pieces)


def job_macros(now: Column, tz: str = "+00:00", url: Column | None = None, keyword: Column | None = None,
               sep: str | None = None, site: str = "", conf: str = "", page_vars: Column | None = None) -> Macros:
    names = fixed_columns(now, tz, site, conf)
    if url is not None:
        names["URL"] = url
    if keyword is not None:
        names["keyword"] = keyword
    return Macros(names, keyword, sep, page_vars)


def keyword_column(keyword: Column, col: int, sep: str | None = None) -> Column:
    """1-based column of a keyword cut at ``sep`` (blanks when null); 0 is the whole keyword."""
    if col == 0:
        return keyword
    parts = F.split(strip(keyword), r"(?U)\s+", -1) if sep is None else F.split(keyword, java_quote(sep), -1)
    return F.get(parts, F.lit(col - 1))
