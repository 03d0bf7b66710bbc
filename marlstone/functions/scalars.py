"""Scalar functions of the engine as Column expressions (and plain versions where the driver needs them)."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names that no file may bear, image extensions, schemes, type prefixes, and the
# credential pattern of single lines ([[:space:]] spelt out, as Java has no such class).
RESERVED = ("con", "prn", "aux", "nul", "com1", "com2", "com3", "com4", "com5", "com6", "com7", "com8", "com9", "lpt1", "lpt2", "lpt3", "lpt4", "lpt5", "lpt6", "lpt7", "lpt8", "lpt9")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "tiff", "svg")
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
PREFIXES = {"image": "fig", "table": "table", "chart": "chart"}
LABEL = r"^\s*(figure|fig\.?|图|table|表|chart)\s*\.?\s*([0-9]+)\s*[.:：]?\s*"
CREDENTIAL = r"""(?i)(api[_-]?key|secret|token|password)[[:space:]]*[:=][[:space:]]*['"][^$<{][^'"]+""".replace("[[:space:]]", r"[ \t\r\f\x0B]")
LIMIT = 120


@lru_cache(maxsize=1)
def nfkd_ascii() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition leaves of code points outside ASCII when all but ASCII goes:
    two equally long strings for those that leave one character, and a table for those that leave more.

    Decomposition moves no ASCII character, so that of a text is that of its code points in a row."""
    left = {}
    for i in range(0x80, sys.maxunicode + 1):
        plain = unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode() if not 0xD800 <= i <= 0xDFFF else ""
        if plain:
            left[chr(i)] = plain
    single = [c for c, p in left.items() if len(p) == 1]
    return "".join(single), "".join(left[c] for c in single), {c: p for c, p in left.items() if len(p) > 1}


def _ranges(chars, gap: int = 512) -> str:
    """A few ranges of a character class that hold all of chars, and what lies in gaps between them."""
    out: list[list[int]] = []
    for i in sorted(map(ord, chars)):
        if out and i - out[-1][1] <= gap:
            out[-1][1] = i
        else:
            out.append([i, i])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


def ascii_nfkd(value: Column) -> Column:
    """Compatibility decomposition with every character outside ASCII deleted, by tables made at plan
    time; only a text with a character outside ASCII is translated, and only one with a character near
    those that leave several is taken apart. A class of few ranges goes first: Java tries the members
    of a class one after the other, for every character of the text."""
    source, target, several = nfkd_ascii()
    other = r"[^\x00-\x7F]"
    short = F.regexp_replace(F.translate(value, source, target), rf"[^\x00-\x7F{_ranges(several)}]", "")
    table = F.map_from_arrays(F.array(*map(F.lit, several)), F.array(*map(F.lit, several.values())))
    runs = F.regexp_extract_all(short, F.lit(r"[^\x00-\x7F]|[\x00-\x7F]+"), F.lit(0))
    whole = F.array_join(F.transform(runs, lambda c: F.when(c.rlike(r"^[\x00-\x7F]"), c).otherwise(F.try_element_at(table, c))), "")
    return F.when(~value.rlike(other), value).when(short.rlike(other), whole).otherwise(short)


def ascii_slug(value: Column) -> Column:
    """Slug of a text whose characters outside ASCII are deleted first."""
    plain = F.regexp_replace(value, r"[^\x00-\x7F]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slugify(value: Column) -> Column:
    return ascii_slug(ascii_nfkd(value))


def safe_filename(stem: Column, suffix: Column, hash8: Column, limit: int = LIMIT) -> Column:
    """<slug>-<hash8><suffix>, at most limit characters where the tail leaves room for one."""
    base = slugify(stem)
    base = F.when((base == "") | base.isin(*RESERVED), "asset").otherwise(base)
    tail = F.concat(F.lit("-"), hash8, F.lower(suffix))
    room = F.greatest(F.lit(1), F.lit(limit) - F.char_length(tail))
    return F.concat(F.regexp_replace(F.substring(base, F.lit(1), room), "-+$", ""), tail)


def cache_key(sha: Column, model: Column, version: Column) -> Column:
    zero = F.char(F.lit(0))
    return F.sha2(F.concat(sha, zero, model, zero, version), 256)


def hash8(content: Column) -> Column:
    return F.left(F.sha2(content, 256), F.lit(8))


def percent_decode(value: Column) -> Column:
    """Percent escapes decoded, + left alone; a malformed text stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def percent_encode(path: Column) -> Column:
    """Each segment escaped as a URL path, slashes kept."""
    coded = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    for a, b in (("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return coded


def encoding_style(raw: Column) -> Column:
    return F.when(raw.rlike("%[0-9A-Fa-f]{2}"), "percent").otherwise("raw")


def restyle(path: str, style: str) -> str:
    return quote(path) if style == "percent" else path


def label_number(caption: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(caption), LABEL, 2), F.lit("")).try_cast("int")


def strip_label(caption: Column) -> Column:
    return F.regexp_replace(caption, "(?i)" + LABEL, "")


def type_prefix(visual_type: Column) -> Column:
    out = F.when(visual_type == "image", PREFIXES["image"])
    for name in ("table", "chart"):
        out = out.when(visual_type == name, PREFIXES[name])
    return out.otherwise(PREFIXES["image"])


def two_digits(n: Column) -> Column:
    text = n.cast("string")
    return F.when(F.char_length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def semantic_slug(text: Column) -> Column:
    """Slug of a caption without its label; "x of the y" turns into "y x" (a rule of our own)."""
    turned = F.regexp_replace(strip_label(text), r"(?i)^(.+?) of (?:the |a |an )?(.+)$", "$2 $1")
    return slugify(turned)


def asset_name(doc_slug: Column, visual_type: Column, number: Column, semantic: Column, digest8: Column, extension: Column, limit: int = LIMIT) -> Column:
    stem = F.concat_ws("-", F.nullif(doc_slug, F.lit("")), F.concat(type_prefix(visual_type), two_digits(number)), F.nullif(semantic, F.lit("")))
    return safe_filename(stem, F.concat(F.lit("."), extension), digest8, limit)


def normalize_path(path: Column) -> Column:
    """Lexical resolution of . and .. ; null where the path leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        up = p == ".."
        return F.struct(
            F.when(up, F.slice(acc["at"], F.lit(1), F.greatest(F.lit(0), F.size(acc["at"]) - 1))).otherwise(F.concat(acc["at"], F.array(p))).alias("at"),
            (acc["out"] | (up & (F.size(acc["at"]) == 0))).alias("out"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(~acc["out"], F.array_join(acc["at"], "/")))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_remote(destination: Column) -> Column:
    return destination.rlike(SCHEME)


def heading_text(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"^#{1,6}\s+(.*?)\s*#*\s*$", 1), F.lit(""))


def frontmatter_name(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?s)^---\r?\n(?:(?!---).)*?^?name:[ \t]*([^\r\n]+)", 1)), F.lit(""))


def is_text(content: Column) -> Column:
    """Valid UTF-8 without a replacement character."""
    text = content.cast("string")
    return F.is_valid_utf8(text) & ~F.contains(text, F.lit("�"))


def decode_strict(content: Column) -> Column:
    return F.decode(content, "UTF-8")


def endpoint_class(url: str | None) -> str:
    """Name of an endpoint's kind for reports; the address itself is never shown."""
    return "default" if not url or re.match(r"https://api\.openai\.com(/|$)", url) else "OpenAI-compatible"


def staging_name(name: str, transaction: str) -> str:
    return f".{name}.asset-rename-{transaction}.tmp"


def rewrite_bytes(content: Column, replacements: Column) -> Column:
    """content with byte spans (start, end, value) replaced: each value after the bytes since the span
    before it, and the rest after the last, joined once."""
    spans = F.array_sort(replacements)
    ends = F.transform(spans, lambda x: x["end"])
    gap = lambda a, b: F.substring(content, (a + 1).cast("int"), (b - a).cast("int"))
    pieces = F.transform(spans, lambda x, i: F.concat(gap(F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0)), x["start"]), x["value"]))
    last = F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0))
    rest = gap(last, F.octet_length(content).cast("long"))
    joined = F.array_join(F.transform(F.concat(pieces, F.array(rest)), lambda b: F.hex(b)), "")
    return F.unhex(joined)
