"""References of Markdown documents with exact byte spans."""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import encoding_style, is_remote, normalize_path, parent, percent_decode

REFERENCES = "doc_path string, syntax string, start long, end long, alt string, raw_destination string"

_INLINE = re.compile(r"!\[(?P<alt>(?:\\.|[^\]\\])*)\]\(\s*(?:<(?P<a>[^<>\n]*)>|(?P<b>(?:\\.|[^\s()\\]|\((?:\\.|[^\s()\\])*\))+))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")
_USE = re.compile(r"!\[(?P<alt>(?:\\.|[^\]\\])*)\](?:\[(?P<label>[^\]]*)\])?(?!\()")
_DEFINITION = re.compile(r"^ {0,3}\[(?P<label>[^\]\n]+)\]:[ \t]*(?:<(?P<a>[^<>\n]*)>|(?P<b>\S+))", re.M)
_IMG = re.compile(r"<img\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\ssrc\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s>\"']+))", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_FENCE = re.compile(r"^ {0,3}(?P<mark>`{3,}|~{3,})", re.M)
_TICKS = re.compile(r"`+")


def protected_ranges(text: str) -> list[tuple[int, int]]:
    """Code point ranges of fenced code, comments and inline code, in order."""
    out, at = [], 0
    while m := _FENCE.search(text, at):
        close = re.compile(rf"^ {{0,3}}{re.escape(m['mark'][0])}{{{len(m['mark'])},}}[ \t]*\r?$", re.M).search(text, text.find("\n", m.end()) + 1 or len(text))
        at = close.end() if close else len(text)
        out.append((m.start(), at))
    free = _outside(text, out)
    for a, b in free:
        out += [(a + m.start(), a + m.end()) for m in _COMMENT.finditer(text[a:b])]
    for a, b in _outside(text, sorted(out)):
        runs = list(_TICKS.finditer(text, a, b))
        last = {len(m[0]): i for i, m in enumerate(runs)}
        i = 0
        while i < len(runs):
            n = len(runs[i][0])
            j = next((j for j in range(i + 1, len(runs)) if len(runs[j][0]) == n), None) if last[n] > i else None
            if j is not None:
                out.append((runs[i].start(), runs[j].end()))
                i = j
            i += 1
    return sorted(out)


def _outside(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    edges = [0, *(x for r in sorted(ranges) for x in r), len(text)]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]


def find_references(text: str) -> list[tuple[str, int, int, str, str]]:
    """(syntax, start, end, alt, destination) in order of place; offsets are UTF-8 bytes."""
    blocked = protected_ranges(text)  # in order, without overlaps
    starts = [a for a, _ in blocked]

    def free(m: re.Match) -> bool:
        k = bisect_right(starts, m.start())
        return not k or m.start() >= blocked[k - 1][1]

    found = []
    for m in filter(free, _INLINE.finditer(text)):
        k = "a" if m["a"] is not None else "b"
        found.append(("markdown-inline", *m.span(k), m["alt"], m[k]))
    used = {" ".join((m["label"] or m["alt"]).split()).casefold(): m["alt"] for m in filter(free, _USE.finditer(text))}
    seen = set()
    for m in filter(free, _DEFINITION.finditer(text)):
        label = " ".join(m["label"].split()).casefold()
        k = "a" if m["a"] is not None else "b"
        if label in used and label not in seen:
            seen.add(label)
            found.append(("markdown-reference", *m.span(k), used[label], m[k]))
    for m in filter(free, _IMG.finditer(text)):
        k = next(k for k in "abc" if m[k] is not None)
        alt = re.search(r"\balt\s*=\s*[\"']([^\"']*)", text[m.start() : text.find(">", m.end()) + 1 or m.end()], re.I)
        found.append(("html-img", *m.span(k), alt[1] if alt else "", m[k]))
    # the byte at which each code point starts
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    return sorted([(s, int(at[a]), int(at[b]), alt, d) for s, a, b, alt, d in found], key=lambda f: f[1])


def scan_markdown(documents: DataFrame) -> DataFrame:
    """A row for each image reference of documents (path, content): REFERENCES, in UTF-8 bytes.

    Markdown needs a scanner with state, so this is a Python stage, one pass over each document."""

    def scan(batches):
        for pdf in batches:
            rows = [(path, *r) for path, content in zip(pdf["path"], pdf["content"], strict=True) for r in find_references(bytes(content).decode("utf-8"))]
            yield pd.DataFrame(rows, columns=["doc_path", "syntax", "start", "end", "alt", "raw_destination"])

    return documents.select("path", "content").mapInPandas(scan, REFERENCES)


def resolve(references: DataFrame) -> DataFrame:
    """Local references with decoded_destination, asset_path (relative to the root) and encoding_style;
    remote ones and those that leave the root go."""
    raw = F.col("raw_destination")
    local = references.where(~is_remote(raw) & (raw != "") & ~raw.startswith("#") & ~raw.startswith("//"))
    local = local.withColumn("decoded_destination", percent_decode(F.regexp_replace(raw, r"[?#].*$", "")))
    joined = F.when(F.col("decoded_destination").startswith("/"), F.lit("../" * 99)).otherwise(F.concat(parent(F.col("doc_path")), F.lit("/"))).alias("p")
    local = local.withColumn("asset_path", normalize_path(F.concat(joined, F.col("decoded_destination"))))
    return local.where("asset_path is not null").withColumn("encoding_style", encoding_style(raw))


def split_spans(pages: DataFrame, opener: str) -> DataFrame:
    """page_id, i, part and start_b (bytes) of what follows each opener, by one split and a running sum.

    The sum is over the parts of one row, so pages that share a page_id keep offsets of their own."""
    parts = pages.select("page_id", F.monotonically_increasing_id().alias("row"), F.split("html", re.escape(opener)).alias("parts"))
    parts = parts.select("page_id", "row", F.posexplode("parts").alias("i", "part"))
    before = F.sum(F.octet_length("part")).over(Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    spans = parts.withColumn("start_b", (before + len(opener.encode()) * F.col("i")).cast("long"))
    return spans.where("i > 0").select("page_id", F.col("i").cast("long").alias("i"), "part", "start_b")


def link_spans(pages: DataFrame) -> DataFrame:
    """page_id, i, dest and start_b (bytes) of each <a href="..."> of pages."""
    spans = split_spans(pages, '<a href="')
    return spans.select("page_id", "i", F.substring_index("part", '"', 1).alias("dest"), "start_b")
