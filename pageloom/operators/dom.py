"""The one Python stage: page source to an array of nodes.

HTML as found on the web is no XML and no built-in reader takes it. A scalar
Arrow UDF reads the source once, as bytes, and returns node numbers and byte
offsets. It is a plain column expression, so Catalyst still pushes filters and
prunes columns around it, and only the page source travels to Python.

``pre`` and ``last`` number the nodes so that "inside" is a range test (Grust,
Accelerating XPath Location Steps, SIGMOD 2002). Only nodes, attributes and text
that the job's selectors name are sent back.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.base import let
from . import page_reader
from .selectors import Selector, Wanted, node_at, offsets, parse_selector, relative, select_nodes, select_values, span

NODES = ("array<struct<pre:int,last:int,parent:int,tag:string,nth:int,nth_last:int,pos:int,pos_last:int,"
         "attrs:map<string,string>,text:string,start:int,stop:int,end:int>>")

cloudpickle.register_pickle_by_value(page_reader)


def read_page(source: Column, wanted: Wanted) -> Column:
    """``struct<nodes,error>`` of a page: no nodes for a null page, an error and no nodes for one that cannot be read."""
    names = (wanted.tags, wanted.attrs, wanted.text_of, wanted.places)

    @F.arrow_udf(f"struct<nodes:{NODES},error:string>")
    def nodes_of(pages: pa.Array) -> pa.Array:
        nodes, errors = page_reader.read_pages((page.as_py() for page in pages.cast(pa.binary())), names)
        return pa.StructArray.from_arrays([page_reader.to_arrow(nodes), pa.array(errors, pa.string())], ["nodes", "error"])

    return nodes_of(source)


def page_nodes(source: Column, wanted: Wanted) -> Column:
    """``nodes`` of a page; null for a null or unreadable page."""
    return read_page(source, wanted)["nodes"]


def read_fragments(groups: Column, wanted: Wanted) -> Column:
    """``struct<f,n>``, text and nodes, of every fragment in groups of fragments (``array<array<string>>``): one reader call for all.

    A fragment that cannot be read has no nodes.
    """
    names = (wanted.tags, wanted.attrs, wanted.text_of, wanted.places)

    @F.arrow_udf(f"array<array<struct<f:string,n:{NODES}>>>")
    def read(rows: pa.Array) -> pa.Array:
        inner = rows.values
        nodes, _ = page_reader.read_pages((f.as_py() for f in inner.values.cast(pa.binary())), names)
        both = pa.StructArray.from_arrays([inner.values, page_reader.to_arrow([n or [] for n in nodes])], ["f", "n"])
        return pa.ListArray.from_arrays(rows.offsets, pa.ListArray.from_arrays(inner.offsets, both))

    return read(F.coalesce(groups, F.array().cast("array<array<string>>")))


def _fragment_context(nodes: Column) -> Column:
    """The root of a fragment: its one top element, or (-1) the fragment itself."""
    def root(tops: Column) -> Column:
        return F.when(F.size(tops) == 1, F.get(tops, F.lit(0))).otherwise(-1)
    return let(F.filter(span(nodes, None), lambda i: node_at(nodes, i)["parent"] == -1), root)


def _per_fragment(groups: Column, query: str, fn) -> Column:
    selector = parse_selector(query)
    selector = relative(selector) if query.startswith("css:") else selector
    read = read_fragments(groups, Wanted.of([selector], tags=["*"]))
    return F.transform(read, lambda g: F.transform(g, lambda z: fn(z["f"], z["n"], selector)))


def select_in_fragments(groups: Column, query: str) -> Column:
    """Select again inside each fragment; all matches of a group in one list."""
    def fn(f: Column, nodes: Column, selector: Selector) -> Column:
        return let(_fragment_context(nodes), lambda c: select_values(nodes, selector, f.cast("binary"), c))
    return F.transform(_per_fragment(groups, query, fn), lambda found: F.flatten(found))


def purge_fragments(groups: Column, query: str) -> Column:
    """Each fragment without the nodes that match, at any depth; text after them stays."""
    def fn(f: Column, nodes: Column, selector: Selector) -> Column:
        source = f.cast("binary")

        def rebuild(cuts: Column) -> Column:
            before = F.transform(cuts, lambda n, k: _between(source, _stop(cuts, k - 1), n["start"]))
            rest = _between(source, _stop(cuts, F.size(cuts) - 1), F.octet_length(source))
            return F.concat(F.array_join(before, ""), rest)

        def outermost(found: Column) -> Column:
            return F.array_except(found, F.flatten(F.transform(found, lambda i: span(nodes, i))))

        found = let(_fragment_context(nodes), lambda c: select_nodes(nodes, selector, c))
        return let(offsets(nodes, let(found, outermost)), rebuild)
    return _per_fragment(groups, query, fn)


def _stop(cuts: Column, k: Column) -> Column:
    return F.coalesce(F.when(k >= 0, F.get(cuts, k)["stop"]), F.lit(0))


def _between(source: Column, start: Column, stop: Column) -> Column:
    return F.substr(source, start + 1, stop - start).cast("string")
