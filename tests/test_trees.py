"""Counts over paths, comparison of trees by hashes, and tables of Markdown."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.operators import graph, tables, trees

# What a corpus of the kind declares and holds: twenty categories, 241 in all.
DECLARED = {
    "search and citation": ("research/search", 13), "writing": ("research/writing", 13), "figures": ("research/figures", 20), "data analysis": ("research/data", 27),
    "biology": ("research/biology", 49), "chemistry": ("research/chemistry", 12), "environment": ("research/environment", 2), "materials": ("research/materials", 1),
    "office tools": ("research/office", 24), "ideation": ("research/ideas", 7), "review": ("research/review", 7), "references": ("research/references", 13),
    "physics": ("research/physics", 5), "economics": ("research/economics", 1), "computing": ("research/computing", 2), "frontend": ("development/frontend", 17),
    "agents": ("development/agents", 7), "knowledge": ("development/knowledge", 4), "trends": ("content/trends", 1), "perspectives": ("content/perspectives", 16),
}


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, sha256 string")


def lines(spark, **documents):
    return spark.createDataFrame([(p, i, t) for p, text in documents.items() for i, t in enumerate(text.split("\n"))], "doc_path string, line long, text string")


def held(missing=""):
    return [(f"{folder}/source/s{i}/SKILL.md", "x") for name, (folder, n) in DECLARED.items() for i in range(n - (name == missing))]


def test_path_counts(spark):
    got = {r["folder"]: (r["depth"], r["n"]) for r in trees.path_counts(files(spark, [("a/b/x", "1"), ("a/b/x", "1"), ("a/y", "2"), ("z", "3"), (None, "4")])).collect()}
    assert got == {"": (0, 4), "a": (1, 3), "a/b": (2, 2)}
    assert trees.path_counts(files(spark, [])).count() == 0
    got = {r["folder"]: r["n"] for r in trees.path_counts(files(spark, held())).collect()}
    assert got[""] == 241 and all(got[folder] == n for folder, n in DECLARED.values())


def test_declared_counts(spark):
    table = "# Categories\n\n| Category | Main focus | Count |\n|---|---|---:|\n" + "\n".join(f"| {k} | a \\| b | **{n}** |" for k, (_, n) in DECLARED.items())
    counted = tables.declared_counts(lines(spark, readme=table + "\n\n| no | table | 7 |\n"), "category", "count")
    assert {r["name"]: r["n"] for r in counted.collect()} == {k: n for k, (_, n) in DECLARED.items()}
    names = spark.createDataFrame([(k, folder) for k, (folder, _) in DECLARED.items()], "name string, folder string")
    assert tables.count_mismatches(counted, trees.path_counts(files(spark, held())), names).count() == 0
    wrong = tables.count_mismatches(counted, trees.path_counts(files(spark, held("materials"))), names)
    assert [tuple(r) for r in wrong.collect()] == [("materials", "research/materials", 1, 0)]


def test_table_rows(spark):
    text = "\n".join(["a | b", "--- | ---", "1 | 2 | 3", "x | y", "- | -", "4", "", "| c |", "|---|---|", "| 5 |", "", "```", "| h |", "|---|", "| 6 |", "```", "p | q", "| h |", "|:-:|", "| 7 |\r", "|---|", "| 8 | \t"])
    got = [(r["line"], r["header"], r["cells"]) for r in tables.table_rows(lines(spark, d=text)).orderBy("line").collect()]
    assert got == [(2, ["a", "b"], ["1", "2", "3"]), (3, ["a", "b"], ["x", "y"]), (4, ["a", "b"], ["-", "-"]), (19, ["h"], ["7"]), (20, ["h"], ["---"]), (21, ["h"], ["8"])]
    assert tables.table_rows(lines(spark, d="")).count() == 0
    assert tables.declared_counts(lines(spark, d="| n | c |\n|-|-|\n| a | 1,234 |\n| b | few |\n| c |"), "N", "C").collect() == [("d", "a", 1234)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trees_differ(spark, seed):
    rnd = random.Random(seed)
    before = [("/".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) + rnd.choice("xyz"), str(rnd.randrange(3))) for _ in range(80)]
    after = [r for r in before if rnd.random() > 0.1] + [("a/new", "1"), (before[0][0], "9")]
    a, b = files(spark, before), files(spark, after)
    want = Counter(map(tuple, graph.tree_difference(a, b).collect()))
    assert Counter(map(tuple, trees.changed_files(a, b).collect())) == want
    below = lambda rows, f: Counter((p, s) for p, s in rows if p.startswith(f + "/" if f else ""))
    folders = {"/".join(p.split("/")[:k]) for p, _ in before + after for k in range(p.count("/") + 1)}
    got = {r["folder"]: (r["n_before"], r["n_after"]) for r in trees.folder_changes(a, b).collect()}
    assert got == {f: (below(before, f).total(), below(after, f).total()) for f in folders if below(before, f) != below(after, f)}


def test_moved_folder(spark):
    before = files(spark, [("a/b/x", "1"), ("a/b/c/y", "2"), ("k/z", "3"), (None, "4")])
    after = before.withColumn("path", F.regexp_replace("path", "^a/b/", "n/"))
    got = {r["folder"]: r["status"] for r in trees.folder_changes(before, after).collect()}
    assert got == {"": "changed", "a": "removed", "a/b": "removed", "a/b/c": "removed", "n": "moved", "n/c": "moved"}
    assert trees.folder_changes(before, before).count() == 0 and trees.changed_files(before, before).count() == 0
