"""Scalars, scanner, graph, plan and apply on small corpora."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import graph
from marlstone.operators.scan import find_references, resolve, scan_markdown
from marlstone.plans import plan as P
from marlstone.sources import corpus


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_names(spark):
    assert one(spark, S.slugify(F.col("v")), v="Figure 1: First Reactor Temperature Profile") == "figure-1-first-reactor-temperature-profile"
    assert one(spark, S.slugify(F.col("v")), v="Éther ﬁlm: ½ ß") == "ether-film-12"
    assert one(spark, S.safe_filename(F.col("v"), F.lit(".jpg"), F.lit("12345678")), v="CON") == "asset-12345678.jpg"
    long = one(spark, S.safe_filename(F.col("v"), F.lit(".png"), F.lit("89abcdef"), 80), v="a" * 300)
    assert len(long) == 80 and long.endswith("-89abcdef.png")
    assert one(spark, S.safe_filename(F.col("v"), F.lit(".png"), F.lit("89abcdef"), 5), v="abc") == "a-89abcdef.png"
    assert one(spark, S.cache_key(F.col("v"), F.lit("m"), F.lit("1")), v="x") == hashlib.sha256(b"x\0m\x001").hexdigest()


def test_paths(spark):
    assert one(spark, S.percent_decode(F.col("v")), v="a%20b+c") == "a b+c"
    assert one(spark, S.percent_decode(F.col("v")), v="a%zz") == "a%zz"
    assert one(spark, S.percent_encode(F.col("v")), v="a b/~*图") == "a%20b/~%2A%E5%9B%BE"
    assert one(spark, S.normalize_path(F.col("v")), v="a/./b/../c") == "a/c"
    assert one(spark, S.normalize_path(F.col("v")), v="a/../../c") is None
    assert one(spark, S.label_number(F.col("v")), v="Fig. 12: x") == 12
    assert one(spark, S.label_number(F.col("v")), v="图 3 温度") == 3
    assert one(spark, S.label_number(F.col("v")), v="x") is None
    assert one(spark, S.two_digits(F.col("v")), v=7) == "07" and one(spark, S.two_digits(F.col("v")), v=123) == "123"
    assert one(spark, S.semantic_slug(F.col("v")), v="Figure 1. Temperature profile of the first reactor") == "first-reactor-temperature-profile"
    assert one(spark, S.is_text(F.col("v")), v=bytearray(b"\xff")) is False


def test_scanner():
    text = '![a](images/one.png)\r\n![图 b][ref]\n\n[ref]: <images/图 二.png> "t"\n<table><img alt="z" src="images/three.png"></table>\n'
    found = find_references(text)
    assert [(f[0], f[4]) for f in found] == [("markdown-inline", "images/one.png"), ("markdown-reference", "images/图 二.png"), ("html-img", "images/three.png")]
    raw = text.encode()
    assert all(raw[a:b].decode() == d for _, a, b, _, d in found)
    blocked = "`![a](b.png)`\n```\n![a](b.png)\n```\n<!-- ![a](b.png) -->\n~~~\n![a](c.png)\n"
    assert find_references(blocked) == []


def write(root, files):
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "corpus"
    write(root, {
        "a.md": "# Top\r\n\r\nFigure 1. Temperature profile of the first reactor\r\n\r\n![](images/p%20one.png)\r\n![x](https://e.org/y.png)\r\n",
        "sub/b.md": "## Second\n![shared view](../images/p%20one.png) ![gone](../images/none.png)\n`![code](../images/loose.png)`\n",
        "images/p one.png": b"one",
        "images/loose.png": b"two",
        "far/other.png": b"three",
    })
    return root


def test_graph_and_plan(spark, tree, tmp_path):
    docs = corpus.markdown_files(spark, str(tree))
    refs = resolve(scan_markdown(docs))
    edges, records, warnings = graph.build_graph(refs, corpus.assets(spark, str(tree)))
    assert [len(r["references"]) for r in records.collect()] == [2]
    assert {(w["code"], w["path"]) for w in warnings.collect()} == {("missing-asset", "images/none.png"), ("unreferenced-asset", "images/loose.png")}
    assert graph.shared_assets(edges).first()["n_docs"] == 2
    before = {p: p.read_bytes() for p in tree.rglob("*") if p.is_file()}
    saved = []
    for k in (1, 2):
        plan, _, summary = P.create_plan(spark, str(tree))
        path, table = P.save_plan(plan, summary, str(tmp_path / f"plan{k}"))
        saved.append((open(path, "rb").read(), open(table, "rb").read()))
    assert saved[0] == saved[1] and saved[0][1].startswith(b"\xef\xbb\xbf")
    got = json.loads(saved[0][0])
    assert got["schema"] == 1 and got["summary"] == {"documents": 2, "unique_references": 2, "eligible": 1, "missing": 1, "unreferenced": 1, "vision_needed": 0, "vision_calls": 0, "warnings": 2}
    assert before == {p: p.read_bytes() for p in tree.rglob("*") if p.is_file()}

    journal = P.apply_plan(spark, str(tree), path, str(tmp_path / "new"))
    new = got["assets"][0]["new_path"]
    assert (tmp_path / "new" / new).read_bytes() == b"one"
    assert (tmp_path / "new" / "a.md").read_bytes() == before[tree / "a.md"].replace(b"images/p%20one.png", new.encode())
    assert P.validate_plan(spark, str(tmp_path / "new"), path) == []
    assert P.rollback(journal) == [] and not (tmp_path / "new").exists()

    for stage in P.STAGES:
        with pytest.raises(RuntimeError):
            P.apply_plan(spark, str(tree), path, str(tmp_path / "no"), fail_after=stage)
        assert not (tmp_path / "no").exists()
    (tree / "images/p one.png").write_bytes(b"changed")
    with pytest.raises(ValueError, match="source hash changed"):
        P.apply_plan(spark, str(tree), path, str(tmp_path / "no"))


def test_metadata_names(spark, tree):
    write(tree, {"content_list.json": json.dumps([{"img_path": "images/p one.png", "image_caption": ["Figure 1. Temperature profile of the first reactor"], "type": "image", "page_idx": 2, "bbox": [1, 2, 3, 4]}])})
    row = corpus.metadata(spark, str(tree)).first()
    assert (row["path"], row["page_idx"], row["visual_type"], row["bbox"]) == ("images/p one.png", 2, "image", [1.0, 2.0, 3.0, 4.0])
    plan = P.create_plan(spark, str(tree))[0].first()
    assert "fig01-first-reactor-temperature-profile" in plan["new_path"] and plan["reason"] == "mineru-caption"


@pytest.mark.parametrize(("confidence", "status"), [(0.92, "used"), (0.2, "rejected"), (None, "failed")])
def test_vision(spark, tmp_path, confidence, status):
    write(tmp_path, {"a.md": "![](x.png)\n", "x.png": b"x"})

    def analyzer(path, context, config):
        return {"description": "blue pump", "keywords": [], "confidence": confidence + 0.0}

    row = P.create_plan(spark, str(tmp_path), analyzer)[0].first()
    assert row["vision_status"] == status and ("blue-pump" in row["new_path"]) == (status == "used")


def test_checks(spark, tmp_path):
    write(tmp_path, {"ok.md": 'token = "abc"\nplain\n', "bad.md": b"\xff\xfe", "__pycache__/x.txt": "y"})
    files = corpus.read_files(spark, str(tmp_path))
    assert [(r["path"], r["line"]) for r in corpus.credential_lines(files).collect()] == [("ok.md", 1)]
    assert [r["path"] for r in corpus.invalid_text(files).collect()] == ["bad.md"]
    assert corpus.large_files(files, 10).count() == 1


def test_stream(spark, tmp_path):
    from marlstone.streaming.arrivals import flag_credentials, read_arrivals

    spark.createDataFrame([(1, 'password = "x1"'), (2, "no")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = flag_credentials(read_arrivals(spark, str(tmp_path / "in"), "doc_id long, text string")).writeStream.format("memory").queryName("flags").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["doc_id"] for r in spark.sql("select * from flags").collect()] == [1]


def test_roots_of_any_name(spark, tmp_path):
    for root in ("r", "it's", "a b"):
        for inner in ("", f"tmp/{root}/", f"{root}/"):
            folder = tmp_path / root / inner
            folder.mkdir(parents=True, exist_ok=True)
            (folder / "a.md").write_text("x")
        got = sorted(r["path"] for r in corpus.read_files(spark, str(tmp_path / root), "*.md").collect())
        assert got == sorted(["a.md", f"tmp/{root}/a.md", f"{root}/a.md"])


def test_slugs_against_plain_version(spark):
    import re
    import unicodedata

    texts = ["Éther ﬁlm: ½ ß", "a’b", "图 1 温度", "", "  --x--  ", "Ångström № ２", None, "⑩ ㎏ ﬃ x", "𝐁old 𝟙 🄐 \U0001f600", "가 각", "e\u0301\u0323", "“q” ¨ ´", "x" * 500 + "㏒"]
    texts += ["".join(map(chr, range(i, i + 512))) for i in range(0x80, 0x11000, 512) if not 0xD600 <= i <= 0xDFFF] + ["".join(map(chr, range(0x1D400, 0x1F400)))]
    plain = lambda t: None if t is None else re.sub("[^a-z0-9]+", "-", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()).strip("-")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(S.slugify(F.col("t"))).collect()] == [plain(t) for t in texts]


def test_rewrite_of_many_spans(spark):
    raw = "图 a\r\nb ".encode() * 500
    spans = [(i * 9 + 3, i * 9 + 3 + i % 3, b"\xff" * (i % 4)) for i in range(500)]
    want, at = b"", 0
    for a, b, v in spans:
        want, at = want + raw[at:a] + v, b
    df = spark.createDataFrame([(bytearray(raw), spans[::-1]), (bytearray(b"x"), []), (bytearray(b""), [(0, 0, bytearray(b"y"))])], "content binary, spans array<struct<start:long,end:long,value:binary>>")
    assert [bytes(r[0]) for r in df.select(S.rewrite_bytes(F.col("content"), F.col("spans"))).collect()] == [want + raw[at:], b"x", b"y"]


def test_command_line(spark, tmp_path, capsys):
    import json

    from marlstone import cli

    root, out = tmp_path / "docs", tmp_path / "out"
    (root / "images").mkdir(parents=True)
    (root / "a.md").write_text("# Title\n\n![Figure 1. First reactor](images/x.png)\n")
    (root / "images" / "x.png").write_bytes(b"png")
    assert cli.main(["plan", str(root), str(out), "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["documents"] == 1
    plan = next(str(p) for p in [out, *out.rglob("*")] if str(p).endswith(".json")) if out.is_dir() else str(out)
    (root / "images" / "x.png").write_bytes(b"other")
    assert cli.main(["apply", str(root), plan, str(tmp_path / "new")], spark) == 2
    assert "source hash changed" in capsys.readouterr().err and not (tmp_path / "new").exists()


def test_documents_since_planning(spark, tree, tmp_path):
    plan, _, summary = P.create_plan(spark, str(tree))
    path, _ = P.save_plan(plan, summary, str(tmp_path / "plan"), corpus.document_hashes(spark, str(tree)))
    saved = corpus.read_plan(path)
    assert P.preflight(spark, str(tree), saved) == []
    before = (tree / "a.md").read_bytes()
    (tree / "a.md").write_bytes(before + b"more")
    (tree / "c.md").write_text("new")
    (tree / "sub/b.md").unlink()
    assert P.preflight(spark, str(tree), saved) == ["document added: c.md", "source hash changed: a.md", "source hash changed: sub/b.md"]


def test_journal_of_a_stopped_run(spark, tree, tmp_path):
    plan, _, summary = P.create_plan(spark, str(tree))
    path, _ = P.save_plan(plan, summary, str(tmp_path / "plan"))
    with pytest.raises(RuntimeError):
        P.apply_plan(spark, str(tree), path, str(tmp_path / "no"), fail_after="documents")
    journal = json.loads((tmp_path / "no.journal.json").read_text())
    assert journal["state"] == "rolled-back" and [o["kind"] for o in journal["operations"]] == ["rename", "replace", "replace"]
    # a run that ended without its cleanup
    stage = tmp_path / S.staging_name("no", "1")
    stage.mkdir()
    corpus.write_json(str(tmp_path / "no.journal.json"), {**journal, "state": "staging"})
    assert P.rollback(str(tmp_path / "no.journal.json")) == [] and not stage.exists()


def test_reference_not_in_plan(spark, tree, tmp_path):
    plan, _, summary = P.create_plan(spark, str(tree))
    path, _ = P.save_plan(plan, summary, str(tmp_path / "plan"))
    P.apply_plan(spark, str(tree), path, str(tmp_path / "new"))
    (tmp_path / "new/c.md").write_text("![](images/loose.png) ![](images/nowhere.png)")
    assert P.validate_plan(spark, str(tmp_path / "new"), path) == ["reference not in plan: images/loose.png"]


def test_vision_cache_and_counts(spark, tmp_path):
    write(tmp_path, {"a.md": "![](x.png) ![](y.png) ![A blue pump on a wall](z.png)\n", "x.png": b"x", "y.png": b"y", "z.png": b"z"})

    def analyzer(path, context, config):
        return {"description": "green valve", "keywords": [], "confidence": 0.9}

    key = hashlib.sha256(hashlib.sha256(b"x").hexdigest().encode() + b"\0\x001").hexdigest()
    cache = spark.createDataFrame([(key, ("red motor", ["k"], 0.9))], "cache_key string, response struct<description:string,keywords:array<string>,confidence:double>")
    for cached, calls, first in ((None, 2, "green-valve"), (cache, 1, "red-motor")):
        plan, _, summary = P.create_plan(spark, str(tmp_path), analyzer, None, cached)
        got = {r["old_path"]: r["new_path"] for r in plan.collect()}
        assert first in got["x.png"] and "green-valve" in got["y.png"]
        assert (summary.first()["vision_needed"], summary.first()["vision_calls"]) == (2, calls)
    summary = P.create_plan(spark, str(tmp_path))[2].first()
    assert (summary["vision_needed"], summary["vision_calls"]) == (2, 0)


@pytest.mark.parametrize("got", [{}, {"description": 1, "keywords": [], "confidence": 0.5}, {"description": "a", "keywords": "a", "confidence": 0.5}, {"description": "a", "keywords": [1], "confidence": 0.5}, {"description": "a", "keywords": [], "confidence": True}, {"description": "a", "keywords": [], "confidence": 2}])
def test_response_shape(got):
    with pytest.raises(ValueError):
        P.response_fields(got)


def test_no_secret_in_artifacts(spark, tree, tmp_path, capsys, monkeypatch):
    from marlstone import cli

    secret = "SENTINEL-not-to-be-written"
    monkeypatch.setenv("VISION_API_KEY", secret)
    assert cli.main(["check-vision", "--json"], spark) == 0
    assert cli.main(["plan", str(tree), str(tmp_path / "out"), "--json"], spark) == 0
    shown = capsys.readouterr()
    assert secret not in shown.out + shown.err
    assert corpus.holding(corpus.read_files(spark, str(tmp_path / "out")), secret).count() == 0
    write(tmp_path, {"out/leak.txt": f"x {secret} y"})
    assert [r["path"] for r in corpus.holding(corpus.read_files(spark, str(tmp_path / "out")), secret).collect()] == ["leak.txt"]


def test_projects_without_copy(spark):
    upstream = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "project string")
    copies = spark.createDataFrame([("a",), ("other-b",)], "name string")
    names = spark.createDataFrame([("b", "other-b"), ("c", "lost")], "project string, name string")
    assert sorted(r[0] for r in graph.without_copy(upstream, copies, names).collect()) == ["c", "d"]


def test_rollback_can_be_tried_again(tmp_path, monkeypatch):
    journal, target = str(tmp_path / "new.journal.json"), tmp_path / "new"
    for state, left in (("committed", target), ("staging", tmp_path / S.staging_name("new", "1"))):
        left.mkdir()
        corpus.write_json(journal, {"schema": 1, "state": state, "operations": [{"seq": 0}, {"seq": 1}]})
        with monkeypatch.context() as m:
            m.setattr(P.shutil, "rmtree", lambda *a, **k: None)
            assert P.rollback(journal) == [str(left)]
        assert json.loads(open(journal).read())["state"] == "rollback-incomplete"
        assert P.rollback(journal) == [] and not left.exists()
        got = json.loads(open(journal).read())
        assert got["state"] == "rolled-back" and [o["seq"] for o in got["operations"]] == [1, 0]


def test_hidden_names_and_large_files(spark, tmp_path):
    write(tmp_path, {"_index.md": "![a](.pics/_one.png)\n", ".hidden/x.md": "# x\n", ".pics/_one.png": b"1", "U.MD": "no", "a b/ü#1.md": "y"})
    assert sorted(r["path"] for r in corpus.markdown_files(spark, str(tmp_path)).collect()) == [".hidden/x.md", "_index.md", "a b/ü#1.md"]
    plan, warnings, _ = P.create_plan(spark, str(tmp_path))
    assert [r["old_path"] for r in plan.collect()] == [".pics/_one.png"] and warnings.count() == 0
    # above what a row can hold: hashed a megabyte at a time
    with open(tmp_path / "big.png", "wb") as f:
        f.truncate((1 << 31) + 5)
    digest = hashlib.sha256()
    for _ in range(1 << 11):
        digest.update(bytes(1 << 20))
    digest.update(bytes(5))
    assert {r["path"]: r["sha256"] for r in corpus.assets(spark, str(tmp_path)).collect()}["big.png"] == digest.hexdigest()
    assert corpus.large_files(corpus.read_files(spark, str(tmp_path), content=False)).count() == 1


def test_links_are_warnings(spark, tmp_path):
    root = tmp_path / "root"
    write(root, {"a.md": "![](images/real.png) ![](images/out.png) ![](images/chain.png) ![](dir/x.png) ![](images/in.png)\n", "images/real.png": b"1"})
    write(tmp_path, {"secret.png": b"secret", "rooted/x.png": b"beside"})
    for name, target in {"images/out.png": tmp_path / "secret.png", "images/chain.png": root / "images/out.png", "images/in.png": root / "images/real.png", "images/cycle.png": root / "images/cycle2.png", "images/cycle2.png": root / "images/cycle.png", "dir": tmp_path / "rooted", "up": root}.items():
        (root / name).symlink_to(target)
    found = {(r["code"], r["path"]) for r in corpus.links(spark, str(root)).collect()}
    assert found == {("linked-outside", "images/out.png"), ("linked-outside", "images/chain.png"), ("linked", "images/in.png"), ("linked-nowhere", "images/cycle.png"), ("linked-nowhere", "images/cycle2.png"), ("linked-outside", "dir"), ("linked", "up")}
    plan, warnings, _ = P.create_plan(spark, str(root))
    assert [r["old_path"] for r in plan.collect()] == ["images/real.png"]
    assert found < {(r["code"], r["path"]) for r in warnings.collect()}
    path, _ = P.save_plan(*[P.create_plan(spark, str(root))[i] for i in (0, 2)], str(tmp_path / "plan"))
    P.apply_plan(spark, str(root), path, str(tmp_path / "new"))
    assert (tmp_path / "new/images/out.png").is_symlink()


def test_heading_outside_of_blocks(spark, tmp_path):
    write(tmp_path, {"d.md": "# Real heading here\n\n```sh\n# install the tool first\n```\n\n![](x.png)\n", "e.md": "Second pump\n===========\n<!--\nFigure 3. hidden caption\n-->\n![](y.png)\n~~~\nFigure 4. not this one\n~~~\n", "x.png": b"x", "y.png": b"y"})
    got = {r["old_path"]: r["new_path"] for r in P.create_plan(spark, str(tmp_path))[0].collect()}
    assert got["x.png"].startswith("d-fig01-real-heading-here-") and got["y.png"].startswith("e-fig01-second-pump-")


def test_metadata_of_both_layouts(spark, tmp_path):
    write(tmp_path, {
        "d.md": "![](images/a.png) ![](images/b.png)\n", "images/a.png": b"a", "images/b.png": b"b",
        "content_list.json": json.dumps([{"img_path": "./images/a.png", "image_caption": ["Figure 2. Blue pump"], "type": "image", "page_idx": 1}]),
        "x/content_list_v2.json": json.dumps([{"type": "table", "page_idx": 4, "content": {"img_path": "../images/b.png", "table_caption": "Table 7. Red valve", "bbox": [0, 1, 2, 3]}}]),
        "content_list_old.json": json.dumps([{"img_path": "images/a.png", "image_caption": "Figure 9. A much longer caption of something else"}]),
    })
    rows = {r["path"]: r for r in corpus.metadata(spark, str(tmp_path)).collect()}
    assert (rows["images/b.png"]["visual_type"], rows["images/b.png"]["page_idx"], rows["images/b.png"]["bbox"], rows["images/b.png"]["source"]) == ("table", 4, [0.0, 1.0, 2.0, 3.0], "metadata-v2")
    got = {r["old_path"]: (r["new_path"], r["reason"]) for r in P.create_plan(spark, str(tmp_path))[0].collect()}
    assert got["images/a.png"][0].startswith("images/d-fig02-blue-pump-") and got["images/b.png"][0].startswith("images/d-table07-red-valve-")
    assert {reason for _, reason in got.values()} == {"mineru-caption"}


def test_pages_of_one_id_keep_their_offsets(spark):
    from marlstone.operators.scan import link_spans

    pages = ['<p><a href="x">1</a> <a href="yy">', '<div> <a href="zzz">']
    df = spark.createDataFrame([(1, p) for p in pages], "page_id long, html string").repartition(2)
    got = sorted((r["start_b"], r["dest"]) for r in link_spans(df).collect())
    assert got == sorted((p.index(d), d) for p, d in ((pages[0], "x"), (pages[0], "yy"), (pages[1], "zzz")))


def test_plan_without_assets_checks_documents(spark, tmp_path):
    root = tmp_path / "root"
    write(root, {"a.md": "text\n"})
    plan, _, summary = P.create_plan(spark, str(root))
    path, _ = P.save_plan(plan, summary, str(tmp_path / "plan"), corpus.document_hashes(spark, str(root)))
    (root / "a.md").write_text("other\n")
    assert P.preflight(spark, str(root), corpus.read_plan(path)) == ["source hash changed: a.md"]


def test_response_log(spark, tmp_path):
    root, log, asked = tmp_path / "root", str(tmp_path / "log"), tmp_path / "asked"
    write(root, {"a.md": "![](x.png) ![](y.png)\n", "x.png": b"x", "y.png": b"y"})
    asked.mkdir()

    def analyzer(path, context, config):
        (asked / f"{path}-{len(list(asked.iterdir()))}").write_text("")
        return {"description": "green valve", "keywords": ["k"], "confidence": 0.9}

    for calls in (2, 0):
        plan, _, summary = P.create_plan(spark, str(root), analyzer, cache_path=log)
        assert all("green-valve" in r["new_path"] for r in plan.collect())
        assert (summary.first()["vision_calls"], len(list(asked.iterdir()))) == (calls, 2)
    # of two versions of a key the later counts, in any order of the rows
    keys = [r["cache_key"] for r in corpus.read_cache(spark, log).collect()]
    shape = "cache_key string, response struct<description:string,keywords:array<string>,confidence:double>"
    corpus.write_cache(spark.createDataFrame([(k, ("red motor", [], 0.8)) for k in keys], shape), log)
    corpus.write_cache(spark.createDataFrame([(k, ("old motor", [], 0.8)) for k in keys], shape), log, version=1)
    assert all("red-motor" in r["new_path"] for r in P.create_plan(spark, str(root), analyzer, cache_path=log)[0].collect())
    corpus.compact_cache(spark, log, str(tmp_path / "compact"))
    assert [r["response"]["description"] for r in corpus.read_cache(spark, str(tmp_path / "compact")).collect()] == ["red motor"] * 2
    ties = spark.createDataFrame([("k", ("a", [], 0.5)), ("k", ("b", [], 0.5))], shape)
    assert [r["response"]["description"] for r in corpus.latest(ties).collect()] == ["b"]


def test_scanner_runs_once(spark, tree):
    from marlstone.operators import scan

    plan, warnings, summary = P.create_plan(spark, str(tree))
    for df in (plan, warnings, summary):
        assert "MapInPandas" not in df._jdf.queryExecution().toString()
    assert "MapInPandas" in scan.scan_markdown(corpus.markdown_files(spark, str(tree)))._jdf.queryExecution().toString()


def test_small_helpers(spark, tmp_path):
    write(tmp_path, {"a/SKILL.md": "---\nname: pump\nx: 1\n---\n", "b/SKILL.md": "", "c/node_modules/x.js": "", "a/run.sh": "1", "b/run.sh": "2"})
    assert corpus.skill_count(spark, str(tmp_path)).first()["n"] == 2
    assert [r["path"] for r in corpus.cache_files(corpus.read_files(spark, str(tmp_path))).collect()] == ["c/node_modules/x.js"]
    text = corpus.read_files(spark, str(tmp_path), "SKILL.md").select("path", S.frontmatter_name(S.decode_strict(F.col("content"))).alias("name"))
    assert {r["path"]: r["name"] for r in text.collect()} == {"a/SKILL.md": "pump", "b/SKILL.md": None}
    files = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "2"), ("x", "3")], "path string, sha256 string")
    assert [(r["n"], r["paths"]) for r in graph.equal_content(files).collect()] == [(2, ["x", "y"])]
    assert [r["path"] for r in graph.same_everywhere(files).collect()] == ["x"]
    links = spark.createDataFrame([("x",), ("gone",)], "asset_path string")
    assert [r["asset_path"] for r in graph.broken_links(links, files.select("path").distinct()).collect()] == ["gone"]
    assert one(spark, S.hash8(F.col("v")), v=bytearray(b"x")) == hashlib.sha256(b"x").hexdigest()[:8]
