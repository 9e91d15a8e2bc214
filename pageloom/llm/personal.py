"""Personal data: wide generators propose spans, boosted trees on format and context choose among them.

Spans of the four fixed kinds are always reported. The trees learn from them and from copies
of them, in their places, that were written so that no fixed kind fits (``ann (at) host dot
org``, a phone without its plus), as positive rows, and from wide proposals that no fixed
span touches, other than addresses written out so, as negative ones, without seeing the
tests that define the fixed kinds. All proposals count, as cells of binned features with the
number of proposals in each; where the cells are too many for the driver, bins are made
wider, and no proposal is left out. The trees add what they hold to be personal data beyond a
threshold calibrated on the fifth of the proposals kept out of training. Wide proposals may overlap; the likelier one stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .boosting import Trees, boost
from .common import Scratch

KINDS = ("email", "ip", "card", "phone")

# Fixed kinds. The first looks for the part from the @ on; its local part is read backwards.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Wide generators: each starts only where a run of its characters starts, so long runs cost one pass.
WIDE_EMAIL = re.compile(
    r"(?<![\w.%+-])[\w.%+-]{1,64} ?(?:@|\(at\)|\[at\]| at ) ?[\w-]{1,64}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,24}){0,4}")
WIDE_NUMBER = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[ ().\-/]{0,2}[0-9]){4,25}(?![0-9A-Za-z])")
#: Numbers that describe a proposal: counts, but for the share of letters.
WIDTH, SHARE = 27, 6
COUNT_CUTS = np.array([*range(25), 28, 32, 40, 48, 64, 128], float)
SHARE_CUTS = np.arange(0, 1, 1 / 32)
CUES = (
    re.compile(r"mail|contact|write|@", re.I), re.compile(r"\bip\b|host|server|address", re.I),
    re.compile(r"card|visa|credit|iban|account|pay", re.I), re.compile(r"tel|phone|call|mobile|fax", re.I))


def passes_luhn(digits: str) -> bool:
    """Whether the digits, every second from the right doubled and its digits added, sum to a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """``kind, start, end`` of the four fixed kinds, by kind, then start."""
    out, free = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            free = m.end()
    for m in ADDRESS.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]  # leading zeros of any number
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and passes_luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(DIGIT.findall(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def described(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of the span and its surroundings."""
    span, before, after = text[start:end], text[max(0, start - 24):start], text[end:end + 12]
    runs = [len(r) for r in re.findall(r"[0-9]+", span)]
    letters = sum(c.isalpha() for c in span)
    gaps = [c for c in span if not c.isalnum()]
    return [
        float(kind), float(len(span)), float(sum(runs)), float(len(runs)), float(max(runs, default=0)), float(min(runs, default=0)),
        letters / len(span), float(len(gaps)), float(len(set(gaps))), float(span.count(".")), float(span.count("@")),
        float(span.count(" ")), float(span.count("-")), float(span.count("(")), float(span[0] == "+"), float(span[0].isdigit()),
        float(span.rpartition(".")[2].isalpha()), float(before[-1:].isspace() or not before), float(before[-1:].isalnum()),
        float(after[:1].isspace() or not after), float(after[:1].isalnum()), *(float(bool(c.search(before))) for c in CUES),
        float("dot" in span), float("(" in span or "[" in span)]


def altered(text: str, kind: int, start: int, end: int) -> tuple[str, int]:
    """The text with a fixed span written so that its kind does not fit, and the new end. How, is drawn by the span's hash."""
    span = text[start:end]
    draw = xxh32_intdigest(span.encode("utf-8", "surrogatepass"))
    if kind == 0:
        name, _, host = span.rpartition("@")
        host = host.replace(".", ("(dot)", " dot ", ".", "[dot]")[draw % 4])
        new = name + (" (at) ", " at ", "[at]", "(at)")[draw // 4 % 4] + host
    elif kind == 3:
        new = ("", "00")[draw % 2] + re.sub(r"[ .()-]+", ("-", " ", "/")[draw // 2 % 3], span[1:])
    else:
        new = re.sub(r"[ .-]", ("/", " - ", "_")[draw % 3], span)
    return text[:start] + new + text[end:], start + len(new)


def proposals(text: str | None) -> list[tuple[int, int, int, bool, bool, list[float]]]:
    """``kind, start, end, fixed, altered, features``: the fixed spans, wide ones that touch none of them, and altered copies to learn from."""
    if not text:
        return []
    fixed = fixed_spans(text)
    taken = sorted((s, e) for _, s, e in fixed)
    starts = np.array([s for s, _ in taken], np.int64)
    ends = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts
    out = [(k, s, e, True, False, described(text, k, s, e)) for k, s, e in fixed]
    for k, s, e in fixed:  # only the surroundings that features read are copied
        low, high = max(0, s - 24), min(len(text), e + 12)
        other, end = altered(text[low:high], k, s - low, e - low)
        out.append((k, s, e, False, True, described(other, k, s - low, end)))
    wide = [(0, m.start(), m.end()) for m in WIDE_EMAIL.finditer(text)] if "at" in text or "@" in text else []
    for m in WIDE_NUMBER.finditer(text):
        kind = 1 if m[0].count(".") == 3 and " " not in m[0] else 3 if m[0][0] in "+(" or len(DIGIT.findall(m[0])) < 13 else 2
        wide.append((kind, m.start(), m.end()))
    for k, s, e in wide:
        i = int(np.searchsorted(starts, e)) - 1
        if i < 0 or ends[i] <= s:
            out.append((k, s, e, False, False, described(text, k, s, e)))
    return out


def binned(x: np.ndarray) -> np.ndarray:
    """Bins of descriptions, as bytes."""
    out = np.searchsorted(COUNT_CUTS, x)
    out[:, SHARE] = np.searchsorted(SHARE_CUTS, x[:, SHARE])
    return out.astype(np.uint8)


@dataclass(frozen=True)
class Judge:
    """Trees over bins, ``step`` of which are one."""

    trees: Trees
    step: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.trees.probability((binned(x) // self.step).astype(float))


def calibrated(probability: np.ndarray, truth: np.ndarray, precision: float, times: np.ndarray | None = None) -> float:
    """The least threshold from which on at least ``precision`` of the chosen are true; above 1 if there is none.

    With ``times``, each stands for so many. Equal probabilities are chosen together, so a threshold counts all rows at it.
    """
    order = np.argsort(-probability, kind="stable")
    times = np.ones(len(order)) if times is None else times
    hits = (truth * times)[order].cumsum() / times[order].cumsum()
    ends = np.append(np.diff(probability[order]) != 0, True)[:len(order)]
    last = np.flatnonzero(ends & (hits >= precision))
    return float(probability[order[last[-1]]]) if len(last) else 2.0


def chosen_spans(model: Trees | Judge, thresholds: list[float], found: list) -> list[tuple[int, int, int]]:
    """Fixed spans, then added ones from the likeliest down as long as they touch nothing added before."""
    spans = [(f["kind"], f["start"], f["end"]) for f in found if f["fixed"]]
    wide = [f for f in found if not f["fixed"]]
    if wide:
        p = model.probability(np.array([f["x"] for f in wide], float))
        taken: list[tuple[int, int]] = []  # by start; none overlap, so only the neighbours of a new span matter
        for i in np.argsort(-p, kind="stable"):
            f = wide[i]
            if p[i] < thresholds[f["kind"]]:
                continue
            at = bisect_left(taken, (f["start"], f["end"]))
            if (at == 0 or taken[at - 1][1] <= f["start"]) and (at == len(taken) or taken[at][0] >= f["end"]):
                taken.insert(at, (f["start"], f["end"]))
                spans.append((f["kind"], f["start"], f["end"]))
    return sorted(spans)


FOUND = "array<struct<kind:int,start:int,end:int,fixed:boolean,altered:boolean,x:array<float>>>"


def _cells(each: DataFrame, most: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Proposals (``kind, fixed, kept_out, x``) counted by cell, and how many bins were made one to have at most ``most`` cells."""
    def cell(x: pd.Series) -> pd.Series:
        return pd.Series([c.tobytes() for c in binned(np.array(x.tolist(), float).reshape(-1, WIDTH))], dtype=object)

    def halved(cells: pd.Series) -> pd.Series:
        return cells.map(lambda c: (np.frombuffer(c, np.uint8) // 2).tobytes())

    groups, step = ["kind", "fixed", "kept_out", "cell"], 1
    rows = each.select(*groups[:3], F.pandas_udf(cell, "binary")("x").alias("cell"))
    found = scratch.keep(rows.groupBy(*groups).agg(F.count("*").alias("n")), "cells1")
    while found.count() > most:
        step *= 2
        rows = found.select(*groups[:3], F.pandas_udf(halved, "binary")("cell").alias("cell"), "n")
        found = scratch.keep(rows.groupBy(*groups).agg(F.sum("n").alias("n")), f"cells{step}")
    return found, step


def scan_personal(docs: DataFrame, most_cells: int = 200_000, precision: float = 0.99, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base, spans`` of every whole text.

    ``base`` and ``spans`` list ``kind:start:end`` by kind, then start, in code points with
    exclusive ends: the fixed kinds, and with them what the trees add. All proposals train the
    trees or (a fifth, by hash) set the thresholds, counted in at most ``most_cells`` cells
    (a few dozen bytes each on the driver; fewer cells mean wider bins); all are judged.

    Null and empty texts have no spans. Repeated rows are scanned each. Without both fixed
    and other proposals nothing is added. Other columns are not read; an empty table gives
    no rows.
    """
    scratch = Scratch(docs.sparkSession, "personal")

    @F.pandas_udf(FOUND)
    def proposed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [dict(zip(("kind", "start", "end", "fixed", "altered", "x"), p, strict=True)) for p in proposals(t)])

    rows = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), proposed(F.col(text_col)).alias("found")), "found")
    # A written-out address that nobody labelled is no evidence against such forms: it is judged, not learnt from.
    written_out = (F.col("kind") == 0) & ~F.col("fixed") & ~F.col("altered") & (F.col("x")[WIDTH - 2] + F.col("x")[WIDTH - 1] > 0)
    each = rows.filter(F.size("found") > 0).select("doc_id", F.inline("found")).filter(~written_out).select(
        "kind", (F.col("fixed") | F.col("altered")).alias("fixed"), "x",
        (F.pmod(F.xxhash64("doc_id", "kind", "start", "end", "altered"), F.lit(5)) == 4).alias("kept_out"))
    cells, step = _cells(each, most_cells, scratch)
    cells = cells.orderBy("cell", "kind", "fixed", "kept_out").toArrow()
    x = np.frombuffer(b"".join(cells["cell"].to_pylist()), np.uint8).reshape(-1, WIDTH).astype(float)
    kind, y, kept_out, n = (cells[c].to_numpy() for c in ("kind", "fixed", "kept_out", "n"))
    y, kept_out = y.astype(int), kept_out.astype(bool)
    model = Judge(boost(x[~kept_out], y[~kept_out], times=n[~kept_out]), step)
    p = model.trees.probability(x[kept_out])
    thresholds = []
    for k in range(len(KINDS)):
        own = kind[kept_out] == k
        thresholds.append(max(0.5, calibrated(p[own], y[kept_out][own], precision, n[kept_out][own])))

    @F.pandas_udf("struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base:string,spans:string>")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def listed(spans):
            return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)

        for part in parts:
            out = []
            for found in part:
                base = sorted((f["kind"], f["start"], f["end"]) for f in found if f["fixed"])
                counts = np.bincount([k for k, _, _ in base], minlength=4).tolist()
                out.append((*counts, listed(base), listed(chosen_spans(model, thresholds, [f for f in found if not f["altered"]]))))
            yield pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    # What is found is much smaller than the texts, so few tasks would read it; judging takes as many as finding.
    spread = rows.repartition(max(1, docs.rdd.getNumPartitions()))
    return spread.select("doc_id", judged("found").alias("j")).select("doc_id", "j.*")


def redact(text: str, spans: str, mask: str = "[{kind}]") -> str:
    """``text`` with the listed spans replaced by the mask of their kind; touching spans become one."""
    out, at = [], 0
    for kind, start, end in sorted((s.split(":") for s in spans.split(",") if s), key=lambda s: int(s[1])):
        if int(end) > at:
            if int(start) >= at:
                out += [text[at:int(start)], mask.format(kind=kind)]
            at = int(end)
    return "".join([*out, text[at:]])
