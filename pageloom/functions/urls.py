"""URL parts, canonical form, fingerprint, query building, page ranges."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import blank_to_null, java_regex, java_replacement, let, retext

# Fixed value: the URI pattern of RFC 3986, appendix B.
URI = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
_GROUP = {"scheme": 2, "slashed": 3, "authority": 4, "path": 5, "asked": 6, "query": 7}
BAD_PREFIX = "http://0.0.0.0"


def part(url: Column, name: str) -> Column:
    return F.regexp_extract(url, URI, _GROUP[name])


def host(url: Column) -> Column:
    """Lower-case host name without user and port."""
    bare = F.regexp_extract(part(url, "authority"), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)
    return F.lower(bare)


def host_suffixes(name: Column) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``."""
    labels = F.split(name, r"\.", -1)
    return F.transform(labels, lambda _, i: F.array_join(
        F.slice(labels, i + 1, F.size(labels)), "."))


def in_domains(name: Column, domains: list[str]) -> Column:
    """The host is one of ``domains`` or below one; an empty list allows all."""
    if not domains:
        return F.lit(True)
    allowed = "|".join(re.escape(d.lower()) for d in domains)
    return name.rlike(rf"(^|\.)(?:{allowed})\z")


def _normal_escapes(x: Column) -> Column:
    """Upper-case ``%xx`` and percent-encode what may not stand in a URL."""
    upper = F.when(
        x.rlike(r"%[0-9A-F]?[a-f]"),
        retext(x, r"%[0-9a-fA-F]{2}|[^%]+|%", lambda t: F.when(t.rlike(r"^%[0-9a-fA-F]{2}\z"), F.upper(t)).otherwise(t)),
    ).otherwise(x)
    return F.when(x.rlike(r"[^\x21-\x7e]"), retext(
        upper, r"[\x21-\x7e]+|[^\x21-\x7e]+",
        lambda t: F.when(t.rlike(r"^[\x21-\x7e]"), t).otherwise(F.replace(F.url_encode(t), F.lit("+"), F.lit("%20"))),
    )).otherwise(upper)


def _sorted_query(query: Column) -> Column:
    def fields(pairs: Column) -> Column:
        keyed = F.transform(pairs, lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("k"), p.alias("p")))
        return F.array_join(F.transform(F.sort_array(keyed), lambda s: s["p"]), "&")

    pairs = F.filter(F.split(query, "&", -1), lambda p: p != "")
    return F.when(query.contains("&"), fields(pairs)).otherwise(query)


def canonical_url(url: Column) -> Column:
    """Sorted query, no fragment, lower-case scheme and host, normal escapes."""
    def build(u: Column) -> Column:
        scheme, authority = F.lower(part(u, "scheme")), F.lower(part(u, "authority"))
        path, query = _normal_escapes(part(u, "path")), _sorted_query(_normal_escapes(part(u, "query")))
        return F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
            F.when(part(u, "slashed") != "", F.concat(F.lit("//"), authority)).otherwise(""),
            F.when(path == "", "/").otherwise(path),
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))

    return build(url)


def url_sha1(url: Column) -> Column:
    """Fingerprint of a URL: sha1 of its canonical form."""
    return F.sha1(canonical_url(url))


def _remove_dots(path: Column) -> Column:
    def step(acc: Column, s: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
        return F.when(s == ".", acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    def clean(parts: Column) -> Column:
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        tail = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
        return F.concat(F.array_join(kept, "/"), tail)

    return F.when(path.contains(".") & path.rlike(r"(^|/)\.\.?(/|\z)"), let(F.split(path, "/", -1), clean)).otherwise(path)


def base_parts(base: Column) -> Column:
    """What ``resolve`` needs of a page's address; compute it once per page."""
    directory = F.regexp_extract(part(base, "path"), r"^.*/", 0)
    return F.struct(
        F.regexp_extract(base, r"^[^#]*", 0).alias("whole"),
        F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*", 0).alias("root"),
        part(base, "scheme").alias("scheme"), part(base, "path").alias("path"),
        F.when(directory == "", "/").otherwise(directory).alias("directory"))


def resolve(base: Column, ref: Column) -> Column:
    """Absolute form of a reference; ``base`` is a ``base_parts`` struct."""
    def absolute(ref: Column) -> Column:
        path, rest = part(ref, "path"), F.regexp_extract(ref, r"[?#].*$", 0)
        rooted = ref.startswith("/")
        merged = F.when(rooted, path).otherwise(F.concat(base["directory"], path))
        return (
            F.when(ref.startswith("//"), F.concat(base["scheme"], F.lit(":"), ref))
            .when(rooted & ~ref.contains("/."), F.concat(base["root"], ref))
            .when(ref == "", base["whole"])
            .when(ref.startswith("#"), F.concat(base["whole"], ref))
            .when(ref.startswith("?"), F.concat(base["root"], base["path"], ref))
            .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
            .otherwise(F.concat(base["root"], _remove_dots(merged), rest)))

    return let(F.trim(ref), absolute)


def rewrite(url: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(url, java_regex(pattern), java_replacement(replacement))


def page_number(url: Column, regex: str, group: int = 1) -> Column:
    return blank_to_null(F.regexp_extract(url, java_regex(regex), group)).try_cast("bigint")


def in_page_range(url: Column, regex: str, start: int = 1, stop: int = 5, group: int = 1) -> Column:
    """The page number in the URL lies in ``[start, stop)``."""
    number = page_number(url, regex, group)
    return F.coalesce((number >= start) & (number < stop), F.lit(False))


def decode_percent(url: Column) -> Column:
    """Readable form: percent escapes as UTF-8; a broken escape leaves the URL as it is."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def encode_query_value(value: Column) -> Column:
    """Form encoding: blank to ``+``, everything but letters, digits and ``_.-`` escaped."""
    return F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A"))


def split_url(url: Column) -> Column:
    """``struct<base, query: map>``; blank values are dropped, the last of repeated keys stays."""
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    fields = F.transform(
        F.filter(F.split(part(url, "query"), "[&;]", -1), lambda p: p.rlike("^[^=]*=.")),
        lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"),
                           decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)", 1)).alias("v")))
    return F.struct(F.regexp_replace(url, r"\?[^#]*", "").alias("base"), last_wins(fields).alias("query"))


def last_wins(pairs: Column) -> Column:
    """Map from ``array<struct<k,v>>`` where a later pair replaces an earlier one."""
    numbered = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))

    def newest(rows: Column) -> Column:
        # sorted by key and place: a row is the newest if the next row has another key
        keep = F.filter(rows, lambda r, i: F.coalesce(F.get(rows, i + 1)["k"] != r["k"], F.lit(True)))
        return F.map_from_entries(F.transform(keep, lambda r: F.struct(r["k"], r["v"])))

    return let(F.sort_array(numbered), newest)


def merge_maps(base: Column, new: Column) -> Column:
    """Both maps in one; values of ``new`` win."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def query_string(fields: Column) -> Column:
    """Encoded ``k=v&..`` with the keys in order."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(fields)), lambda e: F.concat(
        encode_query_value(e["key"]), F.lit("="), encode_query_value(e["value"]))), "&")


def string_map(values: Mapping[str, Column | str]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[c for k, v in values.items()
                          for c in (F.lit(k), (v if isinstance(v, Column) else F.lit(str(v))).cast("string"))])
