"""Vectors, archives, pieces, tool calls and the pipeline against plain versions and round trips."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import neighbours, pieces, queries, toolcalls, warc

SF = "/root/testdata/sf0.001"


def test_neighbours_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = neighbours.nearest_neighbours(rows, lambda i: i % 20 == 0).collect()
    data = sorted((r["vec_id"], r["embedding"]) for r in rows.collect())
    ids, x = np.array([r[0] for r in data]), np.array([r[1] for r in data], dtype=float)
    hit = n = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]])
        mine = [r for r in got if r["query_id"] == q]
        assert sorted(r["rank"] for r in mine) == list(range(1, 21))
        hit, n = hit + len(best & {r["vec_id"] for r in mine}), n + 20
        assert all(abs(r["score"] - x[ids == q][0] @ x[ids == r["vec_id"]][0]) < 1e-12 for r in mine)
    assert hit / n >= 0.9


def test_neighbours_cases(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist(), "x") for i in range(60)] + [(i, [1.0] + [0.0] * 7, "x") for i in range(60, 140)]
    rows += [(200, None, "x"), (220, [0.0] * 8, "x"), (240, [float("nan")] + [1.0] * 7, "x"), (260, [None] + [1.0] * 7, "x"), (280, [], "x"), (300, [1.0, 2.0], "x"), (320, [2.0, 1.0], "x"), (301, [1e200, 1e-200], "x"), (321, [1e-170, 0.0], "x"), (60, [1.0] + [0.0] * 7, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string")
    got = neighbours.nearest_neighbours(df, lambda i: i % 20 == 0, k=5, recall=1.0).collect()
    x = {i: np.array(v) for i, v, _ in rows[:140]}
    for q in (0, 20, 40, 60, 80, 100, 120):
        want = sorted(((-float(x[q] @ x[i]), i) for i in x if i != q))[:5]
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [i for _, i in mine] == [i for _, i in want]
    # vectors meet those of their own dimension, however long or short they are
    assert {r["query_id"] for r in got} == {0, 20, 40, 60, 80, 100, 120, 300, 320}
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 300] == [301, 320, 321]
    assert neighbours.nearest_neighbours(df.limit(0), lambda i: i % 20 == 0).count() == 0


@pytest.mark.parametrize("spread", ["even", "lognormal"])
def test_neighbours_recall_of_unequal_lengths(spark, spread):
    rng = np.random.default_rng(1)
    given = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect())
    x = np.array([v for _, v in given], dtype=float)
    x *= (rng.uniform(0.72, 1.4, len(x)) if spread == "even" else np.exp(rng.normal(0, 0.5, len(x))))[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest_neighbours(rows, lambda i: i % 20 == 0).collect()}
    best = {(q, int(i)) for q in range(0, len(x), 20) for i in np.argsort(-np.where(np.arange(len(x)) == q, -np.inf, x @ x[q]))[:20]}
    assert len(got & best) / len(best) >= 0.9


def test_neighbours_ties_and_clusters(spark):
    # clusters of near-equal vectors, and vectors of equal products that are not equal
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=16) + rng.normal(scale=s, size=(150, 16)) for s in (1e-4, 1e-2, 0.3, 1.0)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest_neighbours(rows, lambda i: i % 20 == 0).collect()}
    best = {(q, int(i)) for q in range(0, len(x), 20) for i in np.argsort(-np.where(np.arange(len(x)) == q, -np.inf, x @ x[q]), kind="stable")[:20]}
    assert len(got & best) / len(best) >= 0.9
    even = spark.createDataFrame([(i, [1.0, float(i), 0.0]) for i in range(40)] + [(40, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    tied = neighbours.nearest_neighbours(even, lambda i: i == 40, recall=1.0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(tied, key=lambda r: r["rank"])] == [(i + 1, i, 1.0) for i in range(20)]


@pytest.mark.parametrize("n", [15, 30])
def test_neighbours_short_lists(spark, n):
    x = np.random.default_rng(2).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(rows, lambda i: i % 5 == 0).collect()
    for q in range(0, n, 5):
        assert sorted(r["rank"] for r in got if r["query_id"] == q) == list(range(1, min(20, n - 1) + 1))


@pytest.mark.parametrize("least", [0, 3])
def test_warc(spark, least, tmp_path):
    rows = [(3, "u", "same", 1), (1, "u", "same", 1), (2, None, None, 1), (4, "http://x/ y", "", 1), (5, "x", "b", 1), (None, "n", "null id", 1), (7, "long", "é" * 200_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, archive long")
    got = {r["page_id"]: r for r in warc.page_records(df, least=least, archive_bytes=1000).collect()}
    assert len(got) == len(rows)
    for page, _, html, _ in rows:
        body = (html or "").encode()
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(body), warc.payload_digest(body))
    assert (got[3]["record_type"], got[3]["refers_to"]) == ("revisit", 1)
    assert (got[4]["record_type"], got[4]["refers_to"]) == (("revisit", 2) if least == 0 else ("response", None))
    folder = f"file://{tmp_path}/warc"
    warc.write_archives(df, folder, archive_bytes=1000)
    heads = [(h["WARC-Type"], p, h["WARC-Record-ID"]) for r in warc.read_archives(spark, folder).collect() for h, p in warc.read_archive(r["content"])]
    assert Counter(p for k, p, _ in heads if k == "response") == Counter([b"same", b"", b"b", b"null id", ("é" * 200_000).encode()])
    assert len({i for *_, i in heads}) == len(rows)
    assert warc.page_records(df.limit(0)).count() == 0


def test_warc_repeated_rows(spark, tmp_path):
    rows = [(1, "u", "twice"), (1, "u", "twice"), (1, "v", "twice"), (None, None, "lost"), (None, None, "lost"), (None, "n", "late"), (9, "n", "late")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.page_records(df).collect())
    assert got == Counter([(1, "response", None), (1, "revisit", 1), (1, "revisit", 1), (None, "response", None), (None, "revisit", None), (None, "revisit", 9), (9, "response", None)])
    warc.write_archives(df, f"file://{tmp_path}/warc")
    ids = [h["WARC-Record-ID"] for r in warc.read_archives(spark, f"file://{tmp_path}/warc").collect() for h, _ in warc.read_archive(r["content"])]
    assert len(set(ids)) == len(ids) == len(rows)


def test_warc_dictionary_is_trained():
    # one way for all archives: a trained dictionary has an id of its own, however few the records
    rnd = random.Random(2)
    for records in ([], [b""], [b"x"] * 3, [rnd.randbytes(2_000_000)], [rnd.randbytes(rnd.randrange(5000)) for _ in range(400)]):
        assert warc.build_dictionary(records).dict_id() > 0
    record = warc.build_record(1, "u", "<urn:uuid:x>", 3, warc.payload_digest(b"abc"), b"abc")
    assert [(h["X-Page-ID"], p) for h, p in warc.read_archive(warc.build_archive([record]))] == [("1", b"abc")]
    assert list(warc.read_archive(warc.build_archive([]))) == []


TEXTS = ["the cat", "", "a", "héllo  wörld\nx\t", "ﬁ½ 日本語 😀 z", "  lead", "a" * 40, None]


def test_pieces_round_trip(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    out = pieces.sample_segmentations(df, k=4, with_ids=True).collect()
    again = pieces.sample_segmentations(df.repartition(3), k=4, with_ids=True).collect()
    assert Counter(map(str, out)) == Counter(map(str, again))
    sp = pieces.vocabulary().processor
    for i, t in enumerate(TEXTS):
        mine = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["sample"])
        assert [r["sample"] for r in mine] == list(range(1, len(mine) + 1))
        assert len({tuple(r["ids"]) for r in mine}) == len(mine) >= 1
        assert all(sp.decode(r["ids"]) == (t or "") and r["n_pieces"] == len(r["ids"]) for r in mine)
        assert all(a["perturbed"] >= b["perturbed"] for a, b in zip(mine, mine[1:], strict=False))
    best = pieces.decode_ids(pieces.encode_texts(df)).collect()
    assert {r["doc_id"]: r["text"] for r in best} == dict(enumerate(TEXTS))
    assert pieces.sample_segmentations(df.limit(0)).count() == 0


def test_pieces_distribution():
    voc = pieces.vocabulary()

    def all_of(s):
        if not s:
            return [((), 0.0)]
        return [((i, *a), voc.log_p[i] + b) for k in range(1, len(s) + 1) if (i := voc.processor.piece_to_id(s[:k])) != voc.processor.unk_id() for a, b in all_of(s[k:])]

    known = all_of("▁cats")
    total = np.logaddexp.reduce([b for _, b in known])
    p = {a: float(np.exp(b - total)) for a, b in known}
    n = 6000
    rows = list(pieces.sample_texts(["cats"] * n, np.arange(n), 2, with_ids=True))
    first = Counter(tuple(r[7]) for r in rows if r[1] == 1)
    second = Counter(tuple(r[7]) for r in rows if r[1] == 2)
    for a in p:
        after = sum(p[b] * p[a] / (1 - p[b]) for b in p if b != a)
        assert abs(first[a] / n - p[a]) < 0.03 and abs(second[a] / n - after) < 0.03
    # inclusion scores weigh samples to unbiased sums
    estimate = sum(np.exp(r[3] - r[5]) * r[2] for r in rows) / n
    assert abs(estimate - sum(p[a] * len(a) for a in p)) < 0.05


def test_pieces_long_word():
    # no cut at any length: pieces, sums and texts are those of the whole word
    voc, rnd = pieces.vocabulary(), random.Random(6)
    word = "".join(rnd.choice(["the", "cat", "ing", "z", "é", "日"]) for _ in range(4000))
    text = "▁" + word
    id_of = {p: i for i in range(voc.processor.vocab_size()) if len(p := voc.processor.id_to_piece(i)) <= voc.longest and not (voc.processor.is_byte(i) or voc.processor.is_unknown(i) or voc.processor.is_control(i) or voc.processor.is_unused(i))}
    total = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        ways = [total[j - k] + voc.log_p[id_of[text[j - k : j]]] for k in range(1, min(j, voc.longest) + 1) if text[j - k : j] in id_of]
        if text[j - 1] not in id_of:
            ways.append(total[j - 1] + len(text[j - 1].encode()) * voc.log_p[voc.byte_ids[0]])
        total[j] = np.logaddexp.reduce(ways)
    rows = list(pieces.sample_texts([word, "the cat", word + " end"], np.array([5, 6, 7]), 2, with_ids=True))
    assert [(r[0], r[1]) for r in sorted(rows, key=lambda r: r[:2])] == [(d, s) for d in range(3) for s in (1, 2)]
    for r in rows:
        assert voc.processor.decode(r[7]) == [word, "the cat", word + " end"][r[0]] and r[2] == len(r[7])
        if r[0] == 0:
            assert abs(r[3] - (sum(voc.log_p[i] for i in r[7]) - total[-1])) < 1e-6


def test_pieces_do_not_depend_on_other_texts():
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["stone", "rivers", "under", "winterlamp", "fields"]) for _ in range(rnd.randrange(1, 60))) for _ in range(80)]
    counts = np.arange(pieces.vocabulary().processor.vocab_size())[::-1]
    together = sorted(pieces.sample_texts(texts, np.arange(80), 3, counts=counts))
    alone = [(i, *r[1:]) for i, t in enumerate(texts) for r in sorted(pieces.sample_texts([t], np.array([i]), 3, counts=counts))]
    assert together == alone


def test_pieces_split_all_texts_at_once(monkeypatch):
    """Second samples take as many steps for ten times the texts: none is worked out text by text."""
    rnd, calls, mix = random.Random(4), [], pieces.mix
    texts = [" ".join(rnd.choice(["stone", "rivers", "under", "winterlamp"]) for _ in range(60)) for _ in range(200)]
    sp = pieces.vocabulary(pieces.MODEL, pieces.POWER).processor
    monkeypatch.setattr(pieces, "mix", lambda h: calls.append(1) or mix(h))
    n = []
    for size in (20, 200):
        calls.clear()
        rows = sorted(pieces.sample_texts(texts[:size], np.arange(size), 2, with_ids=True))
        n.append(len(calls))
        assert [(r[0], r[1]) for r in rows] == [(d, s) for d in range(size) for s in (1, 2)]
        assert all(sp.decode(r[7]) == texts[r[0]] for r in rows) and all(a[7] != b[7] for a, b in zip(rows[::2], rows[1::2], strict=True))
    assert n[1] < 2 * n[0]


def test_pieces_units_are_counted_together():
    """Each different unit of a task is encoded once, in whatever slices its texts are read."""
    texts = pa.array(["the cats sat", " the  cats ", "cats", None, "", "日本 cats\tx", " ", "the cats "] * 5)
    sp = pieces.processor(pieces.MODEL)
    units = pieces._merged([pieces.unit_counts(texts.drop_null().slice(i, 7)) for i in range(0, 35, 7)])
    assert units.num_rows == len(set(units.column("unit").to_pylist()))
    n = pieces.encoded_counts(units, sp)
    plain = Counter(i for t in texts.to_pylist() for i in sp.encode(t or ""))
    assert {i: int(n[i]) for i in np.flatnonzero(n).tolist()} == plain
    assert pieces.vocabulary(pieces.MODEL, pieces.POWER).processor is sp


def test_pieces_probabilities_from_the_documents(spark, monkeypatch):
    """Pieces have the probabilities that the model's own encodings of all texts give them, and samples are drawn by these."""
    texts = ["the cats sat", " the  cats ", "cats", None, "", "日本 cats\tx", " ", "the cats "] * 3 + ["zebra " * 40 + "zebra"]
    monkeypatch.setattr(pieces, "UNITS", 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    voc = pieces.vocabulary()
    sp, size = voc.processor, voc.processor.vocab_size()
    plain = Counter(i for t in texts for i in sp.encode(t or ""))
    assert {r["piece"]: r["n"] for r in pieces.count_pieces(docs).collect()} == plain
    law = [(i + pieces.SHIFT) ** -pieces.POWER for i in range(size)]
    n = [plain[i] + size * law[i] / sum(law) for i in range(size)]
    bytes_ = [i for i in range(size) if sp.is_byte(i)]
    for i in bytes_:
        n[i] = sum(plain[j] + size * law[j] / sum(law) for j in bytes_) / len(bytes_)
    log_p = [pieces.ALPHA * math.log(x / sum(n)) for x in n]
    id_of = {sp.id_to_piece(i): i for i in range(size) if not (sp.is_byte(i) or sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i))}
    for r in pieces.sample_segmentations(docs, with_ids=True).collect():
        if t := texts[r["doc_id"]]:
            t = "▁" + t.replace(" ", "▁")
            total = [0.0] + [-math.inf] * len(t)
            for j in range(1, len(t) + 1):
                # no piece crosses units
                ways = [total[j - k] + log_p[id_of[w]] for k in range(1, j + 1) if (w := t[j - k : j]) in id_of and not re.search("[^▁]▁", w)]
                if t[j - 1] not in id_of:
                    ways.append(total[j - 1] + len(t[j - 1].encode()) * log_p[bytes_[0]])
                total[j] = np.logaddexp.reduce(ways)
            assert sp.decode(r["ids"]) == texts[r["doc_id"]]
            assert abs(r["log_p"] - (sum(log_p[i] for i in r["ids"]) - total[-1])) < 1e-6


SCHEMAS = {"add": {"properties": {"a": {"type": "integer", "maximum": 9}, "b": {"type": ["number", "null"]}, "op": {"enum": ["x", "y"]}}, "required": ["a"], "additionalProperties": False}}


def test_tool_calls(spark):
    calls = [
        (1, "c1", "add", '{"b": 1.5, "a": 2}', 5, ["c2"]), (1, "c2", "add", '{"a": 10}', 6, []), (1, "c3", "add", '{"a": "2", "z": 1}', 7, ["c1", "c2", "none"]),
        (2, "k1", "add", "not json", 1, ["k2"]), (2, "k2", "add", "[1]", 2, ["k1"]), (2, "k3", "mul", "{}", 3, None), (3, "d", "add", '{"a": 1, "op": "z"}', 1, []), (3, "d", "add", '{"b": null}', 2, []), (None, None, "add", None, None, None),
    ]
    results = [(1, "c1", "r1"), (1, "c2", "r2"), (2, "k3", None), (2, "zz", "lost"), (2, None, "null id")]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, name string, arguments string, seq long, waits_for array<string>")
    r = spark.createDataFrame(results, "conv_id long, call_id string, content string")
    out = toolcalls.link_tool_calls(c, r, SCHEMAS).collect()
    by = {(x["conv_id"], x["call_id"]): x for x in out if x["call_id"] != "d"}
    assert [by[1, k]["position"] for k in ("c2", "c1", "c3")] == [0, 1, 2] and [by[1, k]["level"] for k in ("c2", "c1", "c3")] == [0, 1, 2]
    assert {k: x["status"] for k, x in by.items()} == {(1, "c1"): "linked", (1, "c2"): "linked", (1, "c3"): "no result", (2, "k1"): "cycle", (2, "k2"): "cycle", (2, "k3"): "linked", (2, "zz"): "no call", (2, None): "no call", (None, None): "no result"}
    assert by[1, "c1"]["errors"] == [] and by[1, "c2"]["errors"] == ["a is above 9"]
    assert by[1, "c3"]["errors"] == ["z not known", "a is not integer"]
    assert by[2, "k1"]["errors"] == ["arguments are not JSON"] and by[2, "k2"]["errors"] == ["arguments are not an object"] and by[2, "k3"]["errors"] == ["tool is not known"]
    assert sorted(x["errors"] for x in out if x["call_id"] == "d") == [["a is missing"], ["op is not one of its values"]]
    assert by[1, "c1"]["json"] == '{"arguments":{"a":2,"b":1.5},"id":"c1","name":"add","result":"r1"}'
    assert all(json.loads(x["json"]) for x in out)
    assert toolcalls.link_tool_calls(c.limit(0), r.limit(0), SCHEMAS).count() == 0


def test_tool_calls_of_null_conversation(spark):
    for conv in (None, 1):
        c = spark.createDataFrame([(conv, "a", "add", '{"a": 1}', 1, ["b"]), (conv, "b", "add", '{"a": 1}', 2, ["a"]), (conv, "c", "add", '{"a": 1}', 3, ["d"]), (conv, "d", "add", '{"a": 1}', 4, [])], "conv_id long, call_id string, name string, arguments string, seq long, waits_for array<string>")
        r = spark.createDataFrame([(conv, "c", "x" * 100_000)], "conv_id long, call_id string, content string")
        out = {x["call_id"]: (x["status"], x["level"], x["position"]) for x in toolcalls.link_tool_calls(c.withColumn("json", F.lit(1)).withColumn("part", F.lit(1)), r, SCHEMAS).collect()}
        assert out == {"a": ("cycle", None, 2), "b": ("cycle", None, 3), "c": ("linked", 1, 1), "d": ("no result", 0, 0)}


def test_tool_call_chain(spark):
    # a chain of 300 calls, met by calls that wait for two others; each waits for one before it
    calls = [(1, f"c{k}", "add", "{}", k, [f"c{k - 1}"] if k else []) for k in range(300)] + [(1, "x", "add", "{}", 1, ["c10", "c250"]), (1, "y", "add", "{}", 1, ["x", "c3"]), (1, "z", "add", "{}", 1, ["y"])]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, name string, arguments string, seq long, waits_for array<string>")
    r = spark.createDataFrame([], "conv_id long, call_id string, content string")
    level = {x["call_id"]: x["level"] for x in toolcalls.link_tool_calls(c, r, SCHEMAS).collect()}
    assert level == {f"c{k}": k for k in range(300)} | {"x": 251, "y": 252, "z": 253}


def test_canonical_json(spark):
    texts = {"100": "100", "1e2": "100", "100.0": "100", "1.50": "1.5", "15e-1": "1.5", '{"b": [1.0, "1.0e5 \\\\\\" 2.0"], "a": -0.0}': '{"a":0,"b":[1,"1.0e5 \\\\\\" 2.0"]}', "12345678901234567890": "12345678901234567890", "0.00001": "0.00001", "1e-5": "0.00001", "[": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", toolcalls.canonical(F.col("t")).alias("c"))
    assert {r["t"]: r["c"] for r in df.collect()} == texts
    whole = {"type": "integer"}
    rows = spark.createDataFrame([(t,) for t in ("1.0", "1e2", "12345678901234567890", "1.5", '"1"')], "t string")
    bad = rows.select("t", toolcalls.violations(F.lit("f"), F.concat(F.lit('{"a":'), "t", F.lit("}")), {"f": {"properties": {"a": whole}}}).alias("e")).collect()
    assert {r["t"] for r in bad if r["e"]} == {"1.5", '"1"'}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
