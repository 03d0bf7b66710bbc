"""Block structure of Markdown lines: what stands in fenced code or comments, and what is a heading.

A line is a function on the state at its start: outside all blocks, in a comment, or in a fence of
some mark and length. Functions of lines compose to functions of parts of a document, and these are
scanned over the parts; so a document's parts are read by tasks of their own."""

from __future__ import annotations

import json
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scalars import heading_text
from . import scans

#: Lines of a part.
PART_LINES = 4096
#: Rows that a task hands on at once.
BATCH = 10000
#: States: outside blocks, in a comment; in a fence the state is its mark and length, as in "~3".
FREE, COMMENT = "", "!"

_FENCE = r"^ {0,3}(`{3,}|~{3,})"


def document_lines(documents: DataFrame) -> DataFrame:
    """doc_path, line (from 0), first (byte) and text of each line of documents (path, content)."""
    lines = documents.select(F.col("path").alias("doc_path"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line", "text"))
    lines = lines.withColumn("line", F.col("line").cast("long"))
    lines = scans.segmented(lines, ["doc_path"], ["line"], first=scans.sum_before(F.octet_length("text") + 1))
    return lines.withColumn("first", F.coalesce("first", F.lit(0)).cast("long"))


def step(state: str, mark: str | None, size: int, bare: bool, opens: bool, stays: bool) -> str:
    """The state after a line. mark, size, bare: of a fence, and whether it can close one; opens, stays:
    whether a comment is open at the end, if none or one is open at the start. A fence ends a comment."""
    if mark:
        if state in (FREE, COMMENT):
            return f"{mark}{size}"
        return FREE if bare and state[0] == mark and size >= int(state[1:]) else state
    return {FREE: COMMENT if opens else FREE, COMMENT: COMMENT if stays else FREE}.get(state, state)


class Effect:
    """What a run of lines does to any state: where it leads from outside and from a comment, and for
    each mark the closing fences that are longer than all before, with the state that each leads to."""

    def __init__(self, free: str = FREE, comment: str = COMMENT, closers: dict | None = None):
        self.free, self.comment = free, comment
        self.closers = {m: [(int(n), s) for n, s in (closers or {}).get(m, [])] for m in "`~"}

    def __call__(self, state: str) -> str:
        if state in (FREE, COMMENT):
            return self.free if state == FREE else self.comment
        return next((s for n, s in self.closers[state[0]] if n >= int(state[1:])), state)

    def line(self, mark, size, bare, opens, stays) -> Effect:
        """The effect with one more line at its end."""
        on = lambda s: step(s, mark, size, bare, opens, stays)
        closers = {m: [(n, on(s)) for n, s in got] for m, got in self.closers.items()}
        if mark and bare and size > max((n for n, _ in self.closers[mark]), default=0):
            closers[mark].append((size, FREE))
        return Effect(on(self.free), on(self.comment), closers)

    def then(self, after: Effect) -> Effect:
        """This effect and then another; associative."""
        closers = {m: [(n, after(s)) for n, s in got] for m, got in self.closers.items()}
        for m, got in after.closers.items():
            most = max((n for n, _ in self.closers[m]), default=0)
            closers[m] += [(n, s) for n, s in got if n > most]
        return Effect(after(self.free), after(self.comment), closers)

    def text(self) -> str:
        return json.dumps([self.free, self.comment, self.closers])


def _events(lines: DataFrame) -> DataFrame:
    """The lines that can change a state, and how."""
    text = F.col("text")
    mark = F.regexp_extract(text, _FENCE, 1)
    whole = r"<!--.*?-->"
    opened = lambda t: F.contains(F.regexp_replace(t, whole, ""), F.lit("<!--"))
    rest = F.expr("substr(text, instr(text, '-->') + 3)")
    rows = lines.where((mark != "") | F.contains(text, F.lit("<!--")) | F.contains(text, F.lit("-->"))).select(
        "doc_path",
        "line",
        F.nullif(F.left(mark, F.lit(1)), F.lit("")).alias("mark"),
        F.char_length(mark).alias("size"),
        text.rlike(r"^ {0,3}(`{3,}|~{3,})[ \t]*\r?$").alias("bare"),
        opened(text).alias("opens"),
        F.when(F.contains(text, F.lit("-->")), opened(rest)).otherwise(F.lit(True)).alias("stays"),
    )
    return rows.withColumn("part", F.expr(f"line div {PART_LINES}"))


def _in_runs(rows: DataFrame, keys: list[str], order: list[str], work, schema: str) -> DataFrame:
    """What work gives for each run of rows of equal keys, in the given order: rows of schema.

    A task streams over its sorted rows, whatever its number of keys, and holds no run whole."""
    names = [*keys, *order, *(c for c in rows.columns if c not in (*keys, *order))]
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def stream(batches):
        values = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        made = (out for _, run in groupby(values, key=lambda row: row[: len(keys)]) for out in work(run))
        while block := list(islice(made, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block, strict=True), fields, strict=True)], schema=fields)

    return rows.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(stream, schema)


def _effect(run):
    """(doc_path, part, effect) of the events of a part."""
    out = Effect()
    for doc_path, part, _, *event in run:
        out = out.line(*event)
    yield doc_path, part, out.text()


def _entries(run):
    """(doc_path, part, entry): the state at the start of each part of a document that has events."""
    so_far = Effect()
    for doc_path, part, effect in run:
        yield doc_path, part, so_far.free
        so_far = so_far.then(Effect(*json.loads(effect)))


def _changes(run):
    """(doc_path, line, after): the state after each event of a part."""
    state = None
    for doc_path, _, line, entry, *event in run:
        state = step(entry if state is None else state, *event)
        yield doc_path, line, state


def line_states(lines: DataFrame) -> DataFrame:
    """lines (doc_path, line, text, ...) with state, the state at the start of each, and after, the state
    after it where it can change one.

    Only lines with a fence or a comment's mark are looked at one by one, part by part; what the parts
    do is scanned over each document's parts. Lines are told apart by doc_path and line."""
    events = _events(lines)
    event = ["mark", "size", "bare", "opens", "stays"]
    effects = _in_runs(events.select("doc_path", "part", "line", *event), ["doc_path", "part"], ["line"], _effect, "doc_path string, part long, effect string")
    entries = _in_runs(effects, ["doc_path"], ["part"], _entries, "doc_path string, part long, entry string")
    met = events.join(entries, ["doc_path", "part"]).select("doc_path", "part", "line", "entry", *event)
    changes = _in_runs(met, ["doc_path", "part"], ["line"], _changes, "doc_path string, line long, after string")
    marked = lines.join(changes, ["doc_path", "line"], "left").select(*lines.columns, "after")
    out = scans.segmented(marked, ["doc_path"], ["line"], state=scans.last_before(F.col("after")))
    return out.withColumn("state", F.coalesce("state", F.lit(FREE)))


def structure(lines: DataFrame) -> DataFrame:
    """lines (doc_path, line, text, ...) with protected (in a fence or comment, its fences included),
    heading (the text of a heading, else null) and underline (the second line of a heading).

    A heading is a line of one to six # or a line of a paragraph above a line of = or -. Nothing in a
    block counts. Of a paragraph of several lines the last is the heading's text (a rule of our own)."""
    states = line_states(lines)
    fence = F.coalesce(F.col("after").rlike("^[`~]"), F.lit(False))
    states = states.withColumn("protected", (F.col("state") != FREE) | fence)
    paragraph = ~F.col("protected") & ~F.col("text").rlike(r"^\s*$|^( {4}|\t)|^ {0,3}(#{1,6}(\s|$)|>|[-*+]\s|\d{1,9}[.)]\s|\||<|(=+|-+|_+|\*+)\s*$)")
    rule = ~F.col("protected") & F.col("text").rlike(r"^ {0,3}(=+|-+)[ \t]*\r?$")
    near = scans.segmented(states, ["doc_path"], ["line"], _above=scans.lag(paragraph), _below=scans.lead(rule))
    underline = rule & F.coalesce("_above", F.lit(False))
    atx = F.when(~F.col("protected"), heading_text(F.col("text")))
    setext = F.when(paragraph & F.coalesce("_below", F.lit(False)), F.trim(F.regexp_replace("text", r"[\r\t]", " ")))
    return near.withColumns({"heading": F.coalesce(atx, setext), "underline": underline}).drop("state", "after", "_above", "_below")
