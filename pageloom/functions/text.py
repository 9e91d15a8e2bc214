"""Text functions: tags, entities, markup clean-up, string methods."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import WHITESPACE, all_matches, empty_strings, java_regex, java_replacement, let, retext, strip

# What counts as a tag, as an entity and as active markup.
TAG = r"(?s)</?[^ >/][^>]*>"
ENTITY = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
COMMENT = r"(?s)<!--.*?-->"
NAMED_ENTITIES = "\x01".join(f"{name}\x02{chr(point)}" for name, point in [*name2codepoint.items(), ("apos", 39)])
# Letters without a one-character upper case; they stay, as in Python's own rule of one for one.
NO_UPPER = "ßŉǰΐΰևẖẗẘẙẚ\ufb00-\ufb06\ufb13-\ufb17"
ACTIVE_MARKUP = (
    r"(?is)<script\b.*?</script\s*>",
    r"(?is)<style\b.*?</style\s*>",
    r"(?is)</?(link|meta)\b[^>]*>",
    r"""(?i)\s+on[a-z]+\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)(?=[^<>]*>)""",
)


def strip_tags(text: Column) -> Column:
    return F.when(text.contains("<"), F.regexp_replace(text, TAG, "")).otherwise(text)


def normalize_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def clean_markup(text: Column) -> Column:
    """Remove comments, scripts, styles, links, metas and event handlers."""
    text = F.regexp_replace(text, COMMENT, "")
    for pattern in ACTIVE_MARKUP:
        text = F.regexp_replace(text, pattern, "")
    return text


def code_point(number: Column) -> Column:
    """The character with this code point; null outside Unicode."""
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def unescape(text: Column) -> Column:
    """HTML entities to text; unknown entities stay as they are."""
    table = F.str_to_map(F.lit(NAMED_ENTITIES), F.lit("\x01"), F.lit("\x02"))  # folded to one map literal

    def read(body: Column) -> Column:
        """What stands between ``&`` and ``;``."""
        sixteens = F.ltrim(F.substr(body, F.lit(3)), F.lit("0"))
        sixteens = F.conv(F.when(F.length(sixteens) <= 8, sixteens), 16, 10)  # longer ones are beyond all characters
        digits = F.when(body.rlike("^#[xX]"), sixteens).otherwise(F.substr(body, F.lit(2)))
        return F.when(body.startswith("#"), let(digits.try_cast("bigint"), code_point)).otherwise(
            F.try_element_at(table, body))

    def decode(token: Column) -> Column:
        is_entity = token.startswith("&") & token.endswith(";")
        char = let(F.substring(token, F.lit(2), F.char_length(token) - 2), read)
        return F.when(is_entity, F.coalesce(char, token)).otherwise(token)

    return F.when(text.contains("&"), retext(text, ENTITY + "|[^&]+|&", decode)).otherwise(text)


def base64_text(text: Column) -> Column:
    return F.make_valid_utf8(F.try_to_binary(text, F.lit("base64")).cast("string"))


def grep(text: Column, pattern: str = ".+") -> Column:
    return all_matches(text, pattern)


def substitute(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, java_regex(pattern), java_replacement(replacement))


def to_int(text: Column) -> Column:
    """First whole number in the text, commas dropped; 0 when there is none."""
    digits = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"[+-]?\s*[0-9]+", 0)
    return F.coalesce(_number(digits).try_cast("bigint"), F.lit(0).cast("bigint"))


def to_float(text: Column) -> Column:
    digits = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"[+-]?\s*[.0-9]+", 0)
    return F.coalesce(_number(digits).try_cast("double"), F.lit(0.0))


def _number(digits: Column) -> Column:
    """Blanks before the number are fine, between sign and number they are not."""
    return F.when(~digits.rlike(r"^[+-]\s"), strip(digits))


def map_first(text: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Value of the first regex key that matches; groups may be used in values."""
    out = None
    for key, value in table.items():
        whole = ("" if key.startswith("^") else ".*") + key + ("" if key.endswith("$") else ".*")
        hit = text.rlike(java_regex(whole))
        out = (F if out is None else out).when(hit, substitute(text, whole, value))
    default = F.lit(default).cast("string")
    return default if out is None else out.otherwise(default)


# --- string methods ---------------------------------------------------------

def upper(text: Column) -> Column:
    kept = retext(text, f"[{NO_UPPER}]+|[^{NO_UPPER}]+",
                  lambda t: F.when(t.rlike(f"^[{NO_UPPER}]"), t).otherwise(F.upper(t)))
    return F.when(text.rlike(f"[{NO_UPPER}]"), kept).otherwise(F.upper(text))


def capitalize(text: Column) -> Column:
    return F.concat(upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def title(text: Column) -> Column:
    return retext(text, r"\p{L}+|[^\p{L}]+", capitalize)


def swapcase(text: Column) -> Column:
    return retext(text, r"\p{Lu}+|\P{Lu}+",
                  lambda t: F.when(t.rlike(r"^\p{Lu}"), F.lower(t)).otherwise(upper(t)))


def _trimmer(trim):
    return lambda x, chars=WHITESPACE: trim(x, F.lit(chars))


def split(text: Column, sep: str | None = None) -> Column:
    """Python ``split``: a literal separator, or runs of blanks when there is none."""
    if sep is None:
        bare = strip(text)
        return F.when(bare == "", empty_strings()).otherwise(F.split(bare, r"(?U)\s+", -1))
    return F.split(text, java_quote(sep), -1)


def splitlines(text: Column) -> Column:
    lines = F.split(F.regexp_replace(text, r"(\r\n|\n|\r)\z", ""), r"\r\n|\n|\r", -1)
    return F.when(text == "", empty_strings()).otherwise(lines)


def java_quote(literal: str) -> str:
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def _pad(x: Column, width: int, fill: str, left: bool) -> Column:
    padded = (F.lpad if left else F.rpad)(x, width, fill)
    return F.when(F.char_length(x) < width, padded).otherwise(x)  # Spark's pads also cut


def zfill(x: Column, width: int) -> Column:
    sign = F.regexp_extract(x, r"^[+-]", 0)
    rest = F.regexp_replace(x, r"^[+-]", "")
    padded = F.concat(sign, F.lpad(rest, F.lit(width) - F.char_length(sign), F.lit("0")))
    return F.when(F.char_length(x) < width, padded).otherwise(x)


def count(x: Column, part: str) -> Column:
    gone = F.char_length(F.replace(x, F.lit(part), F.lit("")))
    return F.floor((F.char_length(x) - gone) / F.lit(len(part))).cast("bigint")


def _any_of(parts, test):
    parts = parts if isinstance(parts, (list, tuple)) else [parts]
    out = test(parts[0])
    for part in parts[1:]:
        out = out | test(part)
    return out


def is_title(x: Column) -> Column:
    return (x == title(x)) & x.rlike(r"\p{L}")


# name -> (function, type of one result); "array" results are flattened
STRING_METHODS = {
    "lower": (F.lower, "string"),
    "upper": (upper, "string"),
    "title": (title, "string"),
    "capitalize": (capitalize, "string"),
    "swapcase": (swapcase, "string"),
    "strip": (_trimmer(F.btrim), "string"),
    "lstrip": (_trimmer(F.ltrim), "string"),
    "rstrip": (_trimmer(F.rtrim), "string"),
    "replace": (lambda x, a, b: F.replace(x, F.lit(a), F.lit(b)), "string"),
    "zfill": (zfill, "string"),
    "ljust": (lambda x, n, fill=" ": _pad(x, n, fill, left=False), "string"),
    "rjust": (lambda x, n, fill=" ": _pad(x, n, fill, left=True), "string"),
    "split": (split, "array"),
    "splitlines": (splitlines, "array"),
    "find": (lambda x, part: (F.locate(part, x) - 1).cast("bigint"), "bigint"),
    "count": (count, "bigint"),
    "startswith": (lambda x, p: _any_of(p, x.startswith), "boolean"),
    "endswith": (lambda x, p: _any_of(p, x.endswith), "boolean"),
    "isalpha": (lambda x: x.rlike(r"^\p{L}+\z"), "boolean"),
    "isdigit": (lambda x: x.rlike(r"^\p{Nd}+\z"), "boolean"),
    "isalnum": (lambda x: x.rlike(r"^[\p{L}\p{N}]+\z"), "boolean"),
    "isspace": (lambda x: x.rlike(r"^(?U)\s+\z"), "boolean"),
    "isupper": (lambda x: (x == upper(x)) & x.rlike(r"\p{L}"), "boolean"),
    "islower": (lambda x: (x == F.lower(x)) & x.rlike(r"\p{L}"), "boolean"),
    "istitle": (is_title, "boolean"),
}


def string_method(name: str, args=(), kwargs=None):
    """(Column -> Column, result type) for a named string method."""
    if name not in STRING_METHODS:
        raise ValueError(f"unknown string method {name!r}")
    fn, kind = STRING_METHODS[name]
    return (lambda x: fn(x, *args, **(kwargs or {}))), kind
