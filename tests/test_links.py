"""Ordinary links and anchors of headings, held against files."""

import pytest

from marlstone.operators import blocks, links

GUIDE = """# Guide
[Start](#guide) [again](#guide-1) [third](#guide-2) ![image](missing.png)
## Guide
[![badge](pic.png)](docs/a.md) [site](https://e.org/x) [same](//e.org)
`[code](open.md)` ``[more](`open`.md)`` [angle](<docs/two words.md>) [titled](docs/a.md "A")
~~~
[fenced](open.md)
## Fenced
~~~
[folder](docs/) [root](/docs/a.md#part-one) [lost](docs/a.md#part-two) [out](../x.md) \\[not](a.md)
[brackets [in] text](docs/b(1).md) [query](docs/a.md?raw=1) [coded](docs/two%20words.md)
"""


@pytest.fixture
def checked(spark):
    files = {"guide.md": GUIDE, "docs/a.md": "Part, One!\n===\n[up](../guide.md#guide-1) [me](#part-one)\n", "docs/two words.md": "", "docs/b(1).md": "[](nothing.md)"}
    documents = spark.createDataFrame([(p, t.encode()) for p, t in files.items()], "path string, content binary")
    lines = blocks.structure(blocks.document_lines(documents))
    anchors = links.heading_anchors(lines)
    found = links.link_status(links.ordinary_links(lines), documents, anchors)
    return {(r["doc_path"], r["anchor"]) for r in anchors.collect()}, [r.asDict() for r in found.collect()]


def test_links_and_anchors(checked):
    anchors, found = checked
    assert anchors == {("guide.md", "guide"), ("guide.md", "guide-1"), ("docs/a.md", "part-one")}
    got = sorted((r["line"], r["k"], r["raw_destination"], r["in_code"], r["status"]) for r in found if r["doc_path"] == "guide.md")
    assert [g[2:] for g in got] == [
        ("#guide", False, "ok"),
        ("#guide-1", False, "ok"),
        ("#guide-2", False, "no heading"),
        ("docs/a.md", False, "ok"),
        ("open.md", True, "no file"),
        ("`open`.md", True, "no file"),
        ("docs/two words.md", False, "ok"),
        ("docs/a.md", False, "ok"),
        ("open.md", True, "no file"),
        ("docs/", False, "ok"),
        ("/docs/a.md#part-one", False, "ok"),
        ("docs/a.md#part-two", False, "no heading"),
        ("../x.md", False, "outside"),
        ("docs/b(1).md", False, "ok"),
        ("docs/a.md?raw=1", False, "ok"),
        ("docs/two%20words.md", False, "ok"),
    ]
    assert {(r["raw_destination"], r["status"]) for r in found if r["doc_path"] != "guide.md"} == {("../guide.md#guide-1", "ok"), ("#part-one", "ok"), ("nothing.md", "no file")}


def test_long_lines_and_empty_tables(spark):
    rows = [("d.md", i, t, False, None) for i, t in enumerate(["[" * 200_000, "[a](b" * 40_000, "`" * 100_001 + "[x](y.md)", "[a](b.md) " * 20_000, "[x" + "\\]" * 50_000, None])]
    lines = spark.createDataFrame(rows, "doc_path string, line long, text string, protected boolean, heading string")
    found = links.ordinary_links(lines)
    assert {r["line"]: r["count"] for r in found.groupBy("line").count().collect()} == {2: 1, 3: 20_000}
    none = lines.where("line < 0")
    assert links.link_status(links.ordinary_links(none), none.selectExpr("doc_path AS path"), links.heading_anchors(none)).count() == 0
