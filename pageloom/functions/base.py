"""Small Column helpers shared by every function module."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's text ``strip`` removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def as_column(value: Column | str) -> Column:
    """A column name or a Column, as a Column."""
    return value if isinstance(value, Column) else F.col(value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use the result several times in ``body``.

    A plain Python variable would repeat the whole expression tree at each use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def strip(text: Column) -> Column:
    """Python ``strip``: linear time, no regex, removes all Unicode blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    """``regexp_extract`` gives '' for "no match"; make that null."""
    return F.nullif(text, F.lit(""))


def java_regex(pattern: str) -> str:
    """Rewrite the Python-only parts of a regex for Spark's Java engine."""
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{_group(m[1])}>", pattern)
    return re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{_group(m[1])}>", pattern)


def java_replacement(replacement: str) -> str:
    r"""Rewrite ``\1``, ``\g<1>`` and ``\g<name>`` for Spark; quote a plain ``$``."""
    out, end = [], 0
    for m in re.finditer(r"\\g<(\w+)>|\\(\d{1,2})|\\(.)|(\$)", replacement):
        out.append(replacement[end:m.start()])
        end = m.end()
        named, number, escaped, dollar = m.groups()
        if dollar:
            out.append(r"\$")
        elif escaped is not None:
            out.append({"n": "\n", "t": "\t", "r": "\r"}.get(escaped, "\\" + escaped))
        else:
            key = named or number
            out.append(f"${int(key)}" if key.isdigit() else "${" + _group(key) + "}")
            if key.isdigit() and replacement[end:end + 1].isdigit():
                out.append("\\")  # keep a digit that follows out of the group number
    return "".join(out) + replacement[end:]


def _group(name: str) -> str:
    return name.replace("_", "u95")  # Java group names take letters and digits only


def group_count(pattern: str) -> int:
    """Number of capturing groups, read from the pattern text."""
    plain = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "", pattern)
    return len(re.findall(r"\((?!\?)|\(\?P?<(?![=!])", plain))


def all_matches(text: Column, pattern: str) -> Column:
    """Every match as in ``findall``: the match, its group, or all groups in turn."""
    java, groups = F.lit(java_regex(pattern)), group_count(pattern)
    if groups < 2:
        return F.regexp_extract_all(text, java, F.lit(groups))
    columns = [F.regexp_extract_all(text, java, F.lit(g + 1)).alias(f"g{g}") for g in range(groups)]
    return F.flatten(F.transform(
        F.arrays_zip(*columns), lambda m: F.array(*[m[f"g{g}"] for g in range(groups)])))


def retext(text: Column, tokens: str, rewrite: Callable[[Column], Column]) -> Column:
    """Cut ``text`` into ``tokens``, rewrite each and join them again."""
    parts = F.regexp_extract_all(text, F.lit(tokens), F.lit(0))
    return F.array_join(F.transform(parts, rewrite), "")
