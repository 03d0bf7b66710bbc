"""Block structure against a line by line version; context and links of a corpus."""

import random

import pytest

from marlstone.operators import blocks
from marlstone.operators.scan import protected_ranges


def lines_of(spark, texts):
    rows = [(name, i, t) for name, text in texts.items() for i, t in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "doc_path string, line long, text string")


def random_event(rnd):
    if rnd.random() < 0.6:
        return rnd.choice("`~"), rnd.randrange(3, 8), rnd.random() < 0.7, False, False
    return None, 0, False, rnd.random() < 0.5, rnd.random() < 0.5


def test_effects_compose():
    rnd = random.Random(4)
    states = [blocks.FREE, blocks.COMMENT, *[f"{m}{n}" for m in "`~" for n in range(3, 9)]]
    for _ in range(300):
        runs = [[random_event(rnd) for _ in range(rnd.randrange(6))] for _ in range(3)]
        effects = []
        for run in runs:
            e = blocks.Effect()
            for x in run:
                e = e.line(*x)
            effects.append(e)
        a, b, c = effects
        for s in states:
            want = s
            for x in sum(runs, []):
                want = blocks.step(want, *x)
            assert a.then(b).then(c)(s) == a.then(b.then(c))(s) == c(b(a(s))) == want


@pytest.mark.parametrize("part_lines", [2, 4096])
def test_structure(spark, monkeypatch, part_lines):
    monkeypatch.setattr(blocks, "PART_LINES", part_lines)
    texts = {
        "a": "# Real\n```\n# install the tool first\n~~~\n```` x\n````\nafter\n---\n<!-- open\n# hidden\nend --> # not either\n## Two ##\n~~~~\n~~~\n# no\n~~~~\nSetext one\r\n===\r\n\n---\n- item\n---\n",
        "b": "<!-- a --> <!-- b\n```\n-->\n# in a fence\n```\n# Out\n",
        "c": "",
    }
    got = {(r["doc_path"], r["line"]): r for r in blocks.structure(lines_of(spark, texts)).collect()}
    heads = lambda name: [(k[1], r["heading"]) for k, r in sorted(got.items()) if k[0] == name and r["heading"]]
    assert heads("a") == [(0, "Real"), (6, "after"), (11, "Two"), (16, "Setext one")]
    assert heads("b") == [(5, "Out")]
    assert [k[1] for k, r in sorted(got.items()) if k[0] == "a" and r["underline"]] == [7, 17]


def test_states_against_the_scanner(spark):
    rnd = random.Random(7)
    kinds = ["```", "````", "~~~", "~~~~ x", "text", "# head", "<!-- open", "close -->", "<!-- a --> b", "``` py", "", "   ```", "--> <!--"]
    texts = {f"d{i}": "\n".join(rnd.choice(kinds) for _ in range(30)) for i in range(40)}
    got = {(r["doc_path"], r["line"]): r["protected"] for r in blocks.structure(lines_of(spark, texts)).collect()}
    for name, text in texts.items():
        at = 0
        ranges = protected_ranges(text)
        for i, line in enumerate(text.split("\n")):
            want = any(a <= at < b for a, b in ranges)
            if line and not line.startswith("<!--"):
                assert got[name, i] == want, (name, i, line)
            at += len(line) + 1


def test_states_stream_over_documents(spark):
    """Many small documents are no groups of their own in Python, and keep their states across batches."""
    rows = [(f"d{i}", k, t) for i in range(300) for k, t in enumerate(["# A", "~~~", "# B", "~~~", f"# C{i}"])]
    lines = spark.createDataFrame(rows, "doc_path string, line long, text string").repartition(7)
    states = blocks.line_states(lines)
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
    got = {(r["doc_path"], r["line"]): r["state"] for r in states.collect()}
    assert got == {(f"d{i}", k): s for i in range(300) for k, s in enumerate(["", "", "~3", "~3", ""])}
