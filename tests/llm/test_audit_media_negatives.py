"""Filter audits, media columns and hard negatives against plain versions."""

import hashlib
import io
import math
import re
import wave
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import audit, media, negatives, queries

SF = "/root/testdata/sf0.001"


def plain_audit(docs, labels):
    """(part, order, step) -> counts, filter by filter over lists of documents."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and t in least and least[t] < i
        rows.append((part or "", {f for f in "ABCDE" if fails[f]}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, failed = mine, lambda f: [r for r in mine if f in r[1]]
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                before = len(failed(f)) - len(gone)
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = (len(left), len(gone), before, sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))
        for (p, order, k), v in list(out.items()):
            if p == part:
                out[p, order, k] = (*v, shapley[order[k - 1]])
    return out


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*audit.COUNTS, "shapley")) for r in df.collect()}


def test_audit_against_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = queries.op11_filter_audit(spark, SF)
    assert got.count() == 600 * docs.select("lang").distinct().count()
    want = plain_audit([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
    assert audited(got) == want


def test_audit_cases(spark, monkeypatch):
    many = " ".join(f"word{i}" for i in range(150))
    docs = [(1, many, "en"), (2, many, "en"), (2, many, "en"), (3, None, None), (4, "", ""), (None, many, "en"), (None, None, None), (5, "x " * 200, "de"), (6, "SHOUT ÄÖ " + many, "de"), (7, "a|b", "de"), (8, "　".join(["图"] * 9), "zh"), (9, many.replace(" ", "\v"), "en")]
    docs += [(100 + i, many, f"part{i % 70}") for i in range(90)]
    labels = [(1, 1, 0), (2, None, 1), (2, 1, None), (5, 0, 1), (7, 1, 1), (None, 1, 1), (3, None, None), (999, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"bits": F.lit("x"), "part": F.lit("y"), "first": F.lit(0)}).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("marks", F.lit("z"))
    assert audited(audit.audit_filters(df, marks)) == plain_audit(docs, labels)
    assert audited(audit.audit_filters(df, marks, block_rows=1)) == plain_audit(docs, labels)
    assert audit.audit_filters(df.limit(0), marks).count() == 0
    assert {r["good_lost"] for r in audit.audit_filters(df, marks.limit(0)).collect()} == {0}
    monkeypatch.setattr(audit, "SLICE", 40)
    assert audit._words((many + " word1").encode()) == (151, 150)


def test_bitmap_index_counts_every_part():
    rng = np.random.default_rng(0)
    bits, part = rng.integers(0, 128, 3000), rng.integers(0, 37, 3000)
    index = audit.BitmapIndex(bits, part, 37)
    for b in range(7):
        assert index.count(index.sets[b]).tolist() == [int(((part == p) & (bits >> b & 1 == 1)).sum()) for p in range(37)]


def plain_peaks(payload):
    """Peaks by a transform written as sums, for short payloads."""
    total = max(1, math.ceil((len(payload) - 256) / 128) + 1)
    x = list(payload) + [payload[-1]] * ((total - 1) * 128 + 256 - len(payload))
    n = np.arange(256)
    basis = np.exp(-2j * np.pi * np.outer(np.arange(129), n) / 256)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * n / 256)
    power = []
    for t in range(total):
        frame = np.array(x[t * 128 : t * 128 + 256], dtype=float)
        power.append(np.rint(np.abs(basis @ ((frame - frame.mean()) * hann)) ** 2))
    at = lambda t, k: power[t][k] if 0 <= t < total and 0 <= k < 129 else -1.0
    out = []
    for t in range(total):
        found = [k for k in range(129) if at(t, k) > 6 * max(power[t].mean(), 1) and all(at(t, k) > at(t, k - d) and at(t, k) >= at(t, k + d) for d in (1, 2, 3)) and at(t, k) > at(t - 1, k) and at(t, k) >= at(t + 1, k)]
        out += [(t, k) for k in sorted(sorted(found, key=lambda k: (-power[t][k], k))[:2])]
    return out


def plain_pairs(peaks):
    out = []
    for i, (t, k) in enumerate(peaks):
        later = [j for j in range(len(peaks)) if peaks[j][0] > t][:3]
        out += [(t, (k * 129 + peaks[j][1]) * 32 + peaks[j][0] - t - 1, j) for j in later if peaks[j][0] - t <= 32]
    return [(t, c) for t, c, _ in sorted(out)]


def test_media_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    made = {r["doc_id"]: r for r in media.fingerprint_documents(docs).collect()}
    stored = {r["doc_id"]: r for r in media.media_column(docs).collect()}
    digest = {r["doc_id"]: r for r in queries.op12_wav_fingerprints(spark, SF).collect()}
    assert made.keys() == text.keys() == digest.keys()
    n_pairs = 0
    for i, t in text.items():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        with wave.open(io.BytesIO(stored[i]["media"])) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
        r, d = made[i], digest[i]
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored[i]["media"]), hashlib.sha256(stored[i]["media"]).hexdigest())
        for row in (r, d):
            assert tuple(row[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")) == want
        if len(payload) < 20000:
            peaks = plain_peaks(payload)
            assert r["peaks"] == len(peaks)
            assert list(zip(r["times"], r["codes"], strict=True)) == plain_pairs(peaks)
        assert d["feature"] == f"{r['frames']}:{r['peaks']}:{len(r['times'])}:" + hashlib.md5(f"{','.join(map(str, r['times']))};{','.join(map(str, r['codes']))}".encode()).hexdigest()
        n_pairs += len(r["times"])
    assert n_pairs > 1000


def test_media_cases(spark, monkeypatch):
    tone = bytes(int(round(64 + 40 * math.sin(2 * math.pi * 20 * n / 256))) for n in range(256 * 8)).decode("latin-1")
    texts = [(1, None), (2, ""), (3, "x" * 64), (4, "x" * 65), (5, "图表" * 400), (5, "图表" * 400), (None, "a b"), (7, "abc" * 70000), (8, tone)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"media": F.lit("clash"), "n_bytes": F.lit(1)}).coalesce(1)
    rows = media.fingerprint_documents(df).collect()
    assert len(rows) == len(texts)
    by = {r["doc_id"]: r for r in rows}
    assert (by[1]["n_bytes"], by[1]["payload_bytes"], by[1]["peaks"], by[1]["times"]) == (0, 64, 0, [])
    assert by[2]["media_sha256"] == by[1]["media_sha256"]
    assert (by[3]["payload_bytes"], by[4]["payload_bytes"]) == (64, 128)
    assert len({str(r.asDict()) for r in rows if r["doc_id"] == 5}) == 1
    # a tone of 20 cycles a frame: its first frame is a peak at bin 20, later ones are as loud
    t, k = media.spectral_peaks(np.frombuffer(tone.encode("latin-1"), dtype=np.uint8))
    assert (t[0], k[0]) == (0, 20)
    # in blocks of few frames the peaks of a long text are the same
    monkeypatch.setattr(media, "BLOCK", 7)
    long = np.frombuffer(media.payload_of((" ".join(str(i * i) for i in range(9000))).encode()), dtype=np.uint8)
    few = media.spectral_peaks(long)
    monkeypatch.setattr(media, "BLOCK", 1 << 20)
    assert all((a == b).all() for a, b in zip(few, media.spectral_peaks(long), strict=True)) and len(few[0]) > 100
    assert media.fingerprint_documents(df.limit(0)).count() == 0


def test_fingerprints_find_a_passage_elsewhere():
    """A passage that starts a whole number of steps later has its codes, so many frames later."""
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(900)]
    passage, other = " ".join(words[:600]).encode(), " ".join(words[600:]).encode()[: 128 * 9]
    prints = [dict.fromkeys(zip(*(a.tolist() for a in media.peak_pairs(*media.spectral_peaks(np.frombuffer(raw, dtype=np.uint8)))), strict=True)) for raw in (passage, other + passage)]
    moved = {(t + len(other) // 128, c) for t, c in prints[0]}
    assert len(moved & set(prints[1])) > 0.9 * len(moved) > 40


def test_media_refuses_other_forms():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(bytes(16))
    with pytest.raises(ValueError, match="one channel"):
        media.read_wav(out.getvalue())


def plain_negatives(rows, anchor, positives=5, kept=10, low=30, high=90):
    valid, seen = [], set()
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = tuple(math.floor(256 * c) for c in x)
        if (i, v, label) not in seen:
            seen.add((i, v, label))
            valid.append((i, v, label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, v, label in valid:
        if not anchor(i):
            continue
        same = sorted((-dot(v, w), j) for j, w, other in valid if j != i and other == label and len(w) == len(v))[:positives]
        unlike = sorted((-dot(v, w), j) for j, w, other in valid if other != label and len(w) == len(v))
        for p, j in same:
            fit = [(s, n) for s, n in unlike if low * -p <= 100 * -s <= high * -p][:kept]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(fit)]
    return sorted(out)


def mined(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def test_negatives_of_a_table(spark):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = mined(queries.op13_hard_negatives(spark, SF))
    assert got == plain_negatives(rows, lambda i: i % 100 == 0) and got


@pytest.mark.parametrize("bucket, block", [(4, 3), (64, 16)])
def test_negatives_cases(spark, bucket, block):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * rng.lognormal(0, 0.7)).tolist(), int(rng.integers(0, 4))) for i in range(150)]
    rows += [(i, [0.5] * 6, i % 2) for i in range(150, 230)]  # equal vectors in many buckets
    rows += [(1000, None, 1), (1010, [0.0] * 6, 1), (1020, [float("nan")] + [1.0] * 5, 1), (1030, [None] + [1.0] * 5, 1), (1040, [1.0] * 6, None), (None, [1.0] * 6, 1), (1050, [], 1), (1060, [1.0, 2.0], 1), (1061, [2.0, 1.0], 1), (1062, [1.0, 1.0], 2), (1070, [float("inf")] * 6, 0)]
    rows += [rows[0], rows[10], (20, [1.0] * 6, 2), (30, rows[30][1], 3)]
    rows += [(1080, [3e9, 1.0, 1.0], 1), (1081, [2e9, 1.0, 1.0], 1), (1082, [1e9, 1.0, 0.0], 2)]  # beyond what doubles add exactly
    rows = [(i, x if x is None or len(x) != 3 else [c / 256 for c in x], label) for i, x, label in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"dim": F.lit("a"), "norm": F.lit("b"), "windows": F.lit("c")}).repartition(5)
    anchor = lambda i: i % 10 == 0
    got = mined(negatives.mine_negatives(df, anchor, bucket=bucket, block=block))
    assert got == plain_negatives(rows, anchor)
    assert any(a == 1060 for a, *_ in got) and any(a == 1080 for a, *_ in got)
    assert mined(negatives.mine_negatives(df.limit(0), anchor)) == []
    assert mined(negatives.mine_negatives(df, anchor, positives=2, negatives=3, low=0, high=100, bucket=bucket, block=block)) == plain_negatives(rows, anchor, 2, 3, 0, 100)


def test_buckets_out_of_reach_are_not_multiplied(spark, monkeypatch):
    """Pruning: small rows can't reach the window of a large positive."""
    rows = [(0, [4.0, 0.0], 0), (1, [4.0, 1.0], 0), (2, [3.0, 1.0], 1)] + [(10 + i, [0.25, 0.25], 1) for i in range(64)]
    asked = []
    whole = negatives.products
    monkeypatch.setattr(negatives, "products", lambda a, b: asked.append(len(b)) or whole(a, b))
    top, small = 4.0 * 256, 0.36 * 256
    block = negatives.Block({"dim": 2, "same": False, "ids": np.array([0]).tobytes(), "marks": np.array([0]).tobytes(), "labels": np.array([0]).tobytes(), "width": 8, "vectors": np.array([1024.0, 0.0]).tobytes(), "of": [0], "name": [1], "low": [30 * 1024 * 1024 // 100], "high": [90 * 1024 * 1024 // 100], "kth": [-(1 << 63)], "kth_id": [(1 << 63) - 1]}, 10)
    bucket = lambda top: {"top": top, "ids": np.arange(8).tobytes(), "marks": np.zeros(8, np.int64).tobytes(), "labels": np.ones(8, np.int64).tobytes(), "width": 8, "vectors": np.full((8, 2), top / 2**0.5).tobytes()}
    block.meet(bucket(top))
    block.meet(bucket(small))
    assert asked == [8]
    assert mined(negatives.mine_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), lambda i: i == 0)) == plain_negatives(rows, lambda i: i == 0)


def test_products_beyond_64_bits_are_an_error():
    with pytest.raises(OverflowError):
        negatives.products(np.array([[2.0**40]]), np.array([[2.0**40]]))
    assert negatives.products(np.array([[2.0**30, 1.0]]), np.array([[2.0**31, 3.0]])).tolist() == [[2**61 + 3]]
