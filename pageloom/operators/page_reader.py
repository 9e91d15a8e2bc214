"""Read one page's source into node rows; the code that runs in Python workers.

Plain functions over bytes, no Spark in here. Sent to the workers by value, so a
cluster needs no installed copy of this package.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

import pyarrow as pa

_TOKEN = re.compile(
    rb"""<!--.*?(?:-->|\Z)|<[!?][^>]*>
       |<(/?)([A-Za-z][^\s/>]*)((?:[^>"'=]+|=\s*(?:"[^"]*"|'[^']*')?|["'])*+)>""", re.S | re.X)
_ATTR = re.compile(rb"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

_ENTITY = re.compile("&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", re.A)
_NAMED = {**name2codepoint, "apos": 39}

# Fixed values of HTML: elements without content, with raw content, and implied ends.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title".split())
_BLOCK = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split())
_CELL = frozenset(["td", "th"])
_ENDS = {tag: (frozenset(["p"]), frozenset(["table", "td", "th", "button"])) for tag in _BLOCK}
_NOTHING = ((), ())
_ENDS |= {
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "td": (_CELL, frozenset(["table", "tr"])),
    "th": (_CELL, frozenset(["table", "tr"])),
    "tr": (_CELL | {"tr"}, frozenset(["table"])),
    "tbody": (_CELL | {"tr", "thead", "tbody", "tfoot"}, frozenset(["table"])),
    "tfoot": (_CELL | {"tr", "thead", "tbody"}, frozenset(["table"])),
}


def _decode(raw: bytes) -> str:
    text = raw.decode("utf-8", "replace")
    return _ENTITY.sub(_character, text) if "&" in text else text


def _character(m: re.Match) -> str:
    """What an entity stands for; an unknown one stays. Without its ``;`` it is none."""
    name = m[1]
    if name[0] != "#":
        return chr(_NAMED[name]) if name in _NAMED else m[0]
    digits = name[2:].lstrip("0") if name[1] in "xX" else name[1:].lstrip("0")
    point = int(digits[:9] or "0", 16 if name[1] in "xX" else 10)  # nine digits are beyond all characters
    return chr(point) if 0 < point < 0xD800 or 0xE000 <= point <= 0x10FFFF else m[0]


#: Elements inside one another, at most: markup nested deeper is made to stall readers.
DEEPEST = 4096


def read_nodes(source: bytes, tags, attrs, text_of, places: bool = True) -> list[list]:
    """Nodes of one page as rows in ``_ORDER``.

    Only elements in ``tags`` ('*' is all) and the first element, attributes in ``attrs``
    and text below ``text_of`` are returned; numbers count every element. ``end`` is the place, among the
    returned nodes, of a node's last descendant. ``places`` asks for the positions among
    siblings. A page nested deeper than ``DEEPEST`` raises ``ValueError``.
    """
    every, all_text = "*" in tags, "*" in text_of
    kept, stack, open_count, siblings, names = [], [], {}, {}, {}
    counter, size, at, first = 0, len(source), 0, True
    search = _TOKEN.search

    def add_text(start: int, stop: int, raw: bool) -> None:
        nonlocal counter
        if all_text or (stack and stack[-1][1] in text_of):
            chunk = source[start:stop]
            kept.append([counter, counter, stack[-1][0] if stack else -1, "#text", 0, 0, 0, 0, {},
                         chunk.decode("utf-8", "replace") if raw else _decode(chunk), start, stop, len(kept)])
            counter += 1

    def close(count: int, stop: int) -> None:
        for _ in range(count):
            _, tag, node = stack.pop()
            open_count[tag] -= 1
            if node is not None:
                node[1], node[11], node[12] = counter - 1, stop, len(kept) - 1

    while at < size:
        m = search(source, at)
        if m is None:
            break
        begin, end = m.span()
        if begin > at and text_of:
            add_text(at, begin, False)
        at = end
        slash, written, rest = m.groups()
        if written is None:
            continue
        tag = names.get(written)
        if tag is None:
            tag = names[written] = written.decode("utf-8", "replace").lower()
        if slash:
            if open_count.get(tag):
                depth = 1
                while stack[-depth][1] != tag:
                    depth += 1
                close(depth - 1, begin)
                close(1, end)
            continue
        ends, limit = _ENDS.get(tag, _NOTHING)
        for other in ends:
            if open_count.get(other):
                close(_implied(stack, ends, limit), begin)
                break
        parent = stack[-1][0] if stack else -1
        here = back = 0
        if places:
            counts = siblings.setdefault(parent, {})
            here = counts[tag] = counts.get(tag, 0) + 1
            back = counts[""] = counts.get("", 0) + 1
        node = None
        if every or tag in tags or first:
            first = False
            found = {}
            if rest and attrs:
                for a in _ATTR.finditer(rest):
                    name = a[1].decode("utf-8", "replace").lower()
                    if name in attrs and name not in found:
                        found[name] = _decode(a[2] or a[3] or a[4] or b"")
            node = [counter, counter, parent, tag, here, 0, back, 0, found, None, begin, end, len(kept)]
            kept.append(node)
        counter += 1
        if tag in _VOID:
            continue
        if len(stack) == DEEPEST:
            raise ValueError(f"elements nested deeper than {DEEPEST}")
        stack.append((counter - 1, tag, node))
        open_count[tag] = open_count.get(tag, 0) + 1
        if tag in _RAW:
            tail = re.compile(rb"</" + re.escape(written) + rb"\s*>", re.I).search(source, at)
            stop = tail.start() if tail else size
            if stop > at and text_of:
                add_text(at, stop, tag in ("script", "style"))
            at = tail.end() if tail else size
            close(1, at)
    if at < size and text_of:
        add_text(at, size, False)
    close(len(stack), size)
    if places:
        for node in kept:
            if node[3] != "#text":
                counts = siblings[node[2]]
                node[5], node[7] = counts[node[3]] - node[4] + 1, counts[""] - node[6] + 1
    return kept


def _implied(stack: list, ends, limit) -> int:
    """How many open elements a start tag ends."""
    cut = 0
    for depth in range(1, len(stack) + 1):
        tag = stack[-depth][1]
        if tag in limit:
            break
        if tag in ends:
            cut = depth
    return cut


_INTS = {0: "pre", 1: "last", 2: "parent", 4: "nth", 5: "nth_last", 6: "pos", 7: "pos_last", 10: "start", 11: "stop", 12: "end"}
_ORDER = ["pre", "last", "parent", "tag", "nth", "nth_last", "pos", "pos_last", "attrs", "text", "start", "stop", "end"]


def read_pages(pages, names) -> tuple[list[list[list] | None], list[str | None]]:
    """Nodes of every page, and what went wrong: a page that cannot be read has none and does not stop the others."""
    nodes, errors = [], []
    for page in pages:
        found = error = None
        try:
            found = None if page is None else read_nodes(page, *names)
        except Exception as e:  # whatever one page of millions does to the reader, it goes to its own row
            error = f"{type(e).__name__}: {e}"
        nodes.append(found)
        errors.append(error)
    return nodes, errors


def to_arrow(pages: list[list[list] | None]) -> pa.Array:
    offsets, flat = [0], []
    for nodes in pages:
        flat.extend(nodes or ())
        offsets.append(len(flat))
    columns = {name: pa.array([n[i] for n in flat], pa.int32()) for i, name in _INTS.items()}
    columns["tag"] = pa.array([n[3] for n in flat], pa.string())
    columns["text"] = pa.array([n[9] for n in flat], pa.string())
    columns["attrs"] = pa.array([list(n[8].items()) for n in flat], pa.map_(pa.string(), pa.string()))
    struct = pa.StructArray.from_arrays([columns[c] for c in _ORDER], _ORDER)
    missing = pa.array([nodes is None for nodes in pages], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct, mask=missing)
