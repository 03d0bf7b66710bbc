"""The sink of new versions: whole files, attempts that run again, manifest on commit."""

import json
import os
import random

import pytest

from marlstone.sources import corpus, versions
from marlstone.sources.tree import CHUNK


def row(path, target=None, renamed=False, link=None, spans=None):
    return {"path": path, "target": target or path, "renamed": renamed, "link": link, "spans": spans}


def writer(tmp_path, **more):
    options = {"root": str(tmp_path / "root"), "stage": str(tmp_path / "stage"), "parts": str(tmp_path / "parts"), **more}
    os.makedirs(options["parts"], exist_ok=True)
    return versions.VersionWriter(options)


@pytest.fixture
def root(tmp_path):
    (tmp_path / "root/a").mkdir(parents=True)
    (tmp_path / "root/a/x.png").write_bytes(b"image")
    (tmp_path / "root/d.md").write_bytes(b"see old here")
    (tmp_path / "root/plain").write_bytes(b"")
    return tmp_path / "root"


ROWS = [row("a/x.png", "a/new.png", True), row("d.md", spans=[{"start": 4, "end": 7, "value": b"newer"}]), row("plain"), row("up", link="../out"), row("none/")]


def test_splice_equals_plain_version(tmp_path):
    rng = random.Random(3)
    for size in (0, 1, 50, CHUNK + 3, 2 * CHUNK + 7):
        data = rng.randbytes(size)
        cuts = sorted(rng.sample(range(size + 1), min(size, 8) // 2 * 2))
        spans = [{"start": a, "end": b, "value": rng.randbytes(rng.randrange(5))} for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        want = data
        for s in reversed(spans):
            want = want[: s["start"]] + s["value"] + want[s["end"] :]
        (tmp_path / "in").write_bytes(data)
        rng.shuffle(spans)
        versions.splice(str(tmp_path / "in"), str(tmp_path / "out"), spans)
        assert (tmp_path / "out").read_bytes() == want


def test_two_attempts_of_a_task(root, tmp_path):
    w = writer(tmp_path)
    lost, counted = w.write(iter(ROWS)), w.write(iter(ROWS))
    assert lost.part != counted.part and not (tmp_path / "parts/manifest.json").exists()
    w.commit([counted, None])
    assert json.loads((tmp_path / "parts/manifest.json").read_text()) == [
        {"kind": "rename", "source": "a/x.png", "target": "a/new.png"},
        {"kind": "replace", "source": "d.md", "target": "d.md"},
    ]
    stage = tmp_path / "stage"
    assert {str(p.relative_to(stage)) for p in stage.rglob("*")} == {"a", "a/new.png", "d.md", "plain", "up", "none"}
    assert (stage / "a/new.png").read_bytes() == b"image" and (stage / "d.md").read_bytes() == b"see newer here"
    assert os.readlink(stage / "up") == "../out" and (root / "d.md").read_bytes() == b"see old here"


def test_failed_attempt_leaves_no_part_of_a_file(root, tmp_path):
    with pytest.raises(RuntimeError, match="first-rename"):
        writer(tmp_path, fail_after="first-rename").write(iter(ROWS))
    with pytest.raises(FileNotFoundError):
        writer(tmp_path).write(iter([row("gone.png")]))
    assert os.listdir(tmp_path / "parts") == []
    w = writer(tmp_path)
    w.abort([None])
    assert not (tmp_path / "stage").exists()


def test_version_of_a_tree(spark, tmp_path, root):
    (root / "none").mkdir()
    (root / "node_modules").mkdir()
    (root / "node_modules/x").write_text("x")
    (root / ".hidden").write_text("h")
    renames = spark.createDataFrame([("a/x.png", "b/y.png")], "path string, target string")
    spans = spark.createDataFrame([("d.md", 0, 3, b"look at"), ("d.md", 12, 12, b"!")], "path string, start long, end long, value binary")
    done = versions.write_version(corpus.version_files(spark, str(root)), renames, spans, str(root), str(tmp_path / "new"), str(tmp_path / "parts"))
    new = tmp_path / "new"
    assert [(o["kind"], o["target"]) for o in done] == [("rename", "b/y.png"), ("replace", "d.md")]
    assert {str(p.relative_to(new)) for p in new.rglob("*")} == {"b", "b/y.png", "d.md", "plain", ".hidden", "none"}
    assert (new / "d.md").read_bytes() == b"look at old here!"
