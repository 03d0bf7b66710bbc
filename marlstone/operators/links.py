"""Ordinary links of Markdown, the anchors of headings, and links held against both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_remote, normalize_path, parent, percent_decode
from . import scans
from .trees import folders_above

# Patterns repeat single characters only, possessively: groups that repeat would overflow the stack on long lines.
_DESTINATION = r"\(\s*+(?:<([^<>]*+)>|([^\s()<]*+))(?:\s++(?:\"[^\"]*+\"|'[^']*+'))?+\s*+\)"
_LINK = r"\[[^\[\]]*+\]" + _DESTINATION
_CODE = r"(?<!`)(`++).*?(?<!`)\1(?!`)|<!--.*?(?:-->|$)"
#: Noncharacters, which no text should hold, and what they stand for.
_STAND_INS = {"﷐": "\\\\", "﷑": "\\[", "﷒": "\\]", "﷓": "(", "﷔": ")", "﷕": "[", "﷖": "]", "﷗": ""}


def _simple(text: Column) -> Column:
    """text whose brackets are those of links: escaped ones, ones inside destinations or texts, and images
    are written by stand-ins."""
    for pattern, to in (
        (r"\\\\", "﷐"),
        (r"\\\[", "﷑"),
        (r"\\\]", "﷒"),
        (r"(?<!\])\(([^\s()]*+)\)", "﷓$1﷔"),
        (r"!" + _LINK, "﷗"),
        (r"\[([^\[\]]*+)\](?!\()", "﷕$1﷖"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return text


def _destinations(text: Column) -> Column:
    def one(link: Column) -> Column:
        out = F.concat(F.regexp_extract(link, _LINK, 1), F.regexp_extract(link, _LINK, 2))
        for sign, was in _STAND_INS.items():
            out = F.replace(out, F.lit(sign), F.lit(was))
        return out

    return F.transform(F.regexp_extract_all(text, F.lit(_LINK), F.lit(0)), one)


def ordinary_links(lines: DataFrame) -> DataFrame:
    """doc_path, line, k (place in the line, from 0), raw_destination and in_code of each [text](destination)
    of lines (doc_path, line, text, protected, as of blocks.structure).

    Links in fences, comments and code spans of one line are in_code; images are no links, but a linked
    image is one. Links and code spans that go over lines are not seen (a rule of our own). Null text has none."""
    tokens = F.when(F.col("protected"), F.array("_simple")).otherwise(F.regexp_extract_all("_simple", F.lit(rf"{_CODE}|{_LINK}"), F.lit(0)))
    found = F.transform(tokens, lambda t: F.struct((F.col("protected") | t.startswith("`") | t.startswith("<!--")).alias("in_code"), _destinations(t).alias("all")))
    flat = F.flatten(F.transform(found, lambda x: F.transform(x["all"], lambda d: F.struct(d.alias("raw_destination"), x["in_code"].alias("in_code")))))
    some = lines.where(F.contains("text", F.lit("]("))).withColumn("_simple", _simple(F.col("text")))
    return some.select("doc_path", "line", F.posexplode(flat).alias("k", "link")).select("doc_path", "line", "k", "link.raw_destination", "link.in_code")


def heading_anchors(lines: DataFrame) -> DataFrame:
    """doc_path, line, heading and anchor of each heading of lines (as of blocks.structure): lower case
    without punctuation, spaces as hyphens; a repeat gets the number of those before it ("a", "a-1")."""
    heads = lines.where(F.col("heading").isNotNull()).select("doc_path", "line", "heading")
    plain = F.regexp_replace(F.lower(F.trim("heading")), r"[^\p{L}\p{M}\p{N}\p{Pc} -]", "")
    heads = heads.withColumn("slug", F.replace(plain, F.lit(" "), F.lit("-")))
    numbered = scans.segmented(heads, ["doc_path", "slug"], ["line"], n=scans.row_number())
    anchor = F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), (F.col("n") - 1).cast("string")))
    return numbered.select("doc_path", "line", "heading", anchor.alias("anchor"))


def link_status(links: DataFrame, files: DataFrame, anchors: DataFrame) -> DataFrame:
    """Local links with target, fragment and status: ok, outside (of the root), no file, or no heading (a
    document of anchors has none of that name). Files (path) stand for the folders above them too.

    Destinations with a scheme or // are left out. One that starts with / is taken from the root. Targets
    and anchors are made unique first, so no link is doubled."""
    raw = F.col("raw_destination")
    local = links.where(~is_remote(raw) & ~raw.startswith("//"))
    name = percent_decode(F.regexp_replace(raw, r"[?#].*$", ""))
    local = local.withColumns({"_name": name, "fragment": F.nullif(percent_decode(F.regexp_extract(raw, "#(.*)$", 1)), F.lit(""))})
    at = F.when(F.col("_name").startswith("/"), F.col("_name").substr(F.lit(2), F.length("_name"))).otherwise(F.concat_ws("/", F.nullif(parent(F.col("doc_path")), F.lit("")), "_name"))
    target = F.when(F.col("_name") == "", F.col("doc_path")).otherwise(normalize_path(at))
    local = local.withColumn("target", target).drop("_name")
    known = files.select("path").union(folders_above(files)).distinct().select(F.col("path").alias("target"), F.lit(True).alias("_file"))
    heads = anchors.select(F.col("doc_path").alias("target"), F.col("anchor").alias("fragment"), F.lit(True).alias("_heading")).distinct()
    titled = F.col("target").endswith(".md") & F.col("fragment").isNotNull()
    status = F.when(F.col("target").isNull(), "outside").when(F.col("_file").isNull(), "no file").when(titled & F.col("_heading").isNull(), "no heading").otherwise("ok")
    out = local.join(known, "target", "left").join(heads, ["target", "fragment"], "left")
    return out.select(*links.columns, "target", "fragment", status.alias("status"))
