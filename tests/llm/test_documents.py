"""Operators over documents against plain versions, with nulls, empty and repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import common, jaccard, mixing, pii, quality, repeats, sharding
from marlstone.llm.common import Tables

import private_lines  # beside this file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, part long, sha string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(n=160, seed=5):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    passage = " ".join(rnd.choice(vocab) for _ in range(80))
    rows = []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 3, 5, 40, 90, 200]))]
        text = "".join(w + rnd.choice([" ", " ", "\n", "\t ", ", "]) for w in words)
        if i % 7 == 1:
            text += passage
        if i % 5 == 2 and rows:
            base = rows[rnd.randrange(len(rows))][1] or ""
            text = base.replace(" ", "  ", 1) if i % 2 else base + " tail"
        rows.append((i, text, rnd.choice(["en", None]), rnd.choice(["b", "a", None, "ü"])))
    rows += [(900, None, None, None), (901, "", "en", "a"), (3, "same row", "en", "a"), (3, "same row", "en", "a"), (None, "no id", None, "a"), (902, "x" * 70_000 + " " + "word " * 3000, "en", "b"), (903, "a" * 250, "en", "b")]
    return [(*r, 0, "r", "k", 1, "s") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(docs, rows, empty):
    got = mixing.mixed_counts(docs, block=16).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    total, open_, target = 1.5 * sum(sizes.values()), list(range(len(names))), {}
    while open_:
        w = sum((3, 1, 2)[i % 3] for i in open_)
        over = [i for i in open_ if total * (3, 1, 2)[i % 3] / w > 2 * sizes[names[i]] + 1e-9]
        for i in over or open_:
            target[names[i]] = 2.0 * sizes[names[i]] if over else total * (3, 1, 2)[i % 3] / w
        total -= sum(target[names[i]] for i in over)
        open_ = [i for i in open_ if i not in over] if over else []
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    taken = Counter()
    for r in got:
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert taken == Counter({(sizes[s], round(target[s], 6)): math.floor(target[s] + 0.5) for s in names})
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mixed_counts(docs.repartition(2), block=16).collect()))
    assert mixing.mixed_counts(empty).count() == 0


def test_schedule_is_even(spark):
    plan = spark.createDataFrame([(0, 1000, 1500), (1, 500, 500)], "src long, source_size long, words long")
    slots = mixing.schedule(plan, Tables(spark, "test"), block=10, chunk=64).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(200))
    for k in range(20, 200):
        assert abs(sum(r["src"] == 0 for r in slots[:k]) - 0.75 * k) < 3


def plain_quality(text):
    words = WORD.findall(text or "")
    tri = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = set()
    for i in range(len(words) - 2):
        if tri[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked), n < 50 or 100 * len(marked) > 50 * n


def test_quality(spark, docs, rows, empty):
    got = quality.judge_quality(docs).collect()
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in cols) for r in got) == Counter((r[0], *plain_quality(r[1])) for r in rows)
    assert all(r["kept"] != r["base_failed"] for r in got if r["class_distance"] is None)
    assert all((r["class_distance"] is None) == r["base_failed"] for r in got if r["n_words"] >= 100)
    assert quality.judge_quality(empty).count() == 0
    # junk among clean documents is told by its characters
    rnd = random.Random(1)
    clean = [(i, prose(rnd, "en"), "en") for i in range(60)]
    junk = [(100 + i, " ".join(f"{rnd.choice('QXZ')}{rnd.randrange(99999)}$$%%" for _ in range(120)), "en") for i in range(5)]
    judged = quality.judge_quality(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"] for r in judged if not r["kept"] and not r["base_failed"]} == {r[0] for r in junk}


FILLERS = {"en": "stone river under winter lamp field morning letter".split(), "de": "stein fluss winter lampe straße größe morgen brief".split(), "fr": "pierre rivière hiver lampe forêt lettre été matin".split(), "it": "pietra fiume inverno lampada città lettera mattina campo".split(), "pt": "pedra rio inverno lâmpada manhã coração carta campo".split()}


def prose(rnd, lang, n=150, common=True):
    """Words of a language, the commonest as often as Zipf's law has it."""
    words, _ = quality.LANGUAGES[lang]
    out = []
    for k in range(n):
        w = rnd.choices([*words, ""], quality.WORD_SHARES)[0] if common else ""
        w = w or rnd.choice(FILLERS[lang])
        out.append((w.capitalize() if k % 12 == 0 else w) + (rnd.choice(",.") if k % 12 == 11 else ""))
    return " ".join(out)


def test_quality_function_words(spark):
    # the same characters and punctuation as the clean documents, but no function words
    rnd = random.Random(4)
    clean = [(i, prose(rnd, "en"), "en") for i in range(60)]
    junk = [(100 + i, prose(rnd, "en", common=False), "en") for i in range(5)]
    judged = quality.judge_quality(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()
    assert not any(r["base_failed"] for r in judged) and {r["doc_id"] for r in judged if not r["kept"]} == {r[0] for r in junk}
    assert all(r["class_distance"] < 0.15 for r in judged)


def test_quality_languages(spark):
    # a language that is null or has no reference is held against the nearest one; verdicts don't depend on other rows
    rnd = random.Random(9)
    rows = [(k, prose(rnd, lang), tag) for k, (lang, tag) in enumerate([(lang, tag) for lang in FILLERS for tag in (lang, None, "xx")])]
    rows += [(100 + k, prose(rnd, lang, common=False), tag) for k, (lang, tag) in enumerate([("en", None), ("it", "xx"), ("pt", "pt")])]
    long_ = " ".join(w if w in quality.LANGUAGES["en"][0] else "".join(rnd.choices("aeionrst", k=8)) for w in prose(rnd, "en", 40_000).split())
    rows += [(200, prose(rnd, "en", 40), None), (201, long_, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    judged = {r["doc_id"]: r for r in quality.judge_quality(docs).collect()}
    assert {i for i, r in judged.items() if not r["kept"]} == {100, 101, 102, 200}
    alone = quality.judge_quality(docs.where("doc_id = 100"), with_row=True).collect()[0]
    assert alone["word_distance"] == judged[100]["word_distance"] and alone["row"]["doc_id"] == 100


def test_quality_labels(spark):
    sf = "/root/testdata/sf0.01"
    judged = quality.judge_quality(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    kept = {r["quality"]: (r["kept"], r["n"]) for r in judged.groupBy("quality").agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("n")).collect()}
    assert kept[1][0] >= 0.99 * kept[1][1] and kept[0][0] <= 0.25 * kept[0][1]


# openings of three books of the public domain
TOLSTOY = """Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.
Все смешалось в доме Облонских. Жена узнала, что муж был в связи с бывшею в их доме француженкою-гувернанткой, и объявила мужу,
что не может жить с ним в одном доме. Положение это продолжалось уже третий день и мучительно чувствовалось и самими супругами,
и всеми членами семьи, и домочадцами. Все члены семьи и домочадцы чувствовали, что нет смысла в их сожительстве и что на каждом
постоялом дворе случайно сошедшиеся люди более связаны между собой, чем они, члены семьи и домочадцы Облонских."""
MICKIEWICZ = """Litwo! Ojczyzno moja! ty jesteś jak zdrowie. Ile cię trzeba cenić, ten tylko się dowie, kto cię stracił.
Dziś piękność twą w całej ozdobie widzę i opisuję, bo tęsknię po tobie. Panno święta, co Jasnej bronisz Częstochowy
i w Ostrej świecisz Bramie! Ty, co gród zamkowy nowogródzki ochraniasz z jego wiernym ludem! Jak mnie dziecko do zdrowia
powróciłaś cudem, gdy od płaczącej matki pod Twoją opiekę ofiarowany, martwą podniosłem powiekę i zaraz mogłem pieszo
do Twych świątyń progu iść za wrócone życie podziękować Bogu."""
AUSTEN = """It is a truth universally acknowledged, that a single man in possession of a good fortune, must be in want of a wife.
However little known the feelings or views of such a man may be on his first entering a neighbourhood, this truth is so well
fixed in the minds of the surrounding families, that he is considered as the rightful property of some one or other of their daughters."""


def test_quality_scripts(spark):
    rnd = random.Random(3)
    greek = " ".join("".join(rnd.choices("αβγδεηικλμνορστυ", k=rnd.randint(2, 8))) for _ in range(120))
    kept = [(TOLSTOY, "ru"), (TOLSTOY, None), (MICKIEWICZ, "pl"), (MICKIEWICZ, None), (AUSTEN, "en"), (AUSTEN.upper(), "en"), (AUSTEN.upper(), "xx"), (greek, "el"), (greek, None)]
    gone = [(TOLSTOY, "en"), (greek, "en"), (TOLSTOY, "pl")]
    rows = [(i, *r) for i, r in enumerate(kept + gone)]
    got = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert [got[i]["kept"] for i in range(len(rows))] == [True] * len(kept) + [False] * len(gone), [(i, r["class_distance"], r["word_distance"]) for i, r in got.items()]
    assert [i for i, r in got.items() if r["class_distance"] is None] == [7, 8]


def groups(rows):
    out = defaultdict(int)
    for r in rows:
        out[r[1]] += len((r[1] or "").encode()) + 1
    return out


def least_capacity(sizes, shards):
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        cap, n, at = (low + high) // 2, 1, 0
        for s in sizes:
            n, at = (n + 1, s) if at + s > cap else (n, at + s)
        low, high = (low, cap) if n <= shards else (cap + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_sharding(docs, rows, shards):
    got = sharding.shard_documents(docs, shards).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    of = defaultdict(set)
    for r in got:
        of[r["size"], r["text_crc32"]].add(r["shard"])
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    by = groups(rows)
    order = sorted(by, key=lambda t: hashlib.sha256(t.encode()).hexdigest() if t is not None else "")
    assert max(load.values()) == least_capacity([by[t] for t in order], shards)


def test_sharding_empty(empty):
    assert sharding.shard_documents(empty).count() == 0


def plain_repeats(rows):
    n = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        n.update(b[k : k + 200] for k in range(len(b) - 199))
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if n[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((r[0], len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("most", [4096, 3])
def test_repeats(docs, rows, most, monkeypatch):
    monkeypatch.setattr(repeats, "MOST", most)
    assert Counter(tuple(r) for r in repeats.remove_repeats(docs).collect()) == plain_repeats(rows)


def test_repeats_of_a_common_passage(spark, monkeypatch):
    """Ranges of large buckets: nothing goes by way of the driver, and cores held alone go no further."""
    rnd = random.Random(7)
    words = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, longer = words(150), words(230)
    rows = [(i, words(150) + (longer if i % 4 == 0 else passage) + words(150)) for i in range(24)]
    plans, tables = [], {}
    save = Tables.save

    def saved(self, df, name):
        if name in ("large", "halves", "alike", "told", "todo", "found"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = save(self, df, name)
        if name in ("large", "halves"):
            tables.setdefault(name, []).append([r.asDict() for r in out.collect()])
        return out

    monkeypatch.setattr(Tables, "save", saved)
    monkeypatch.setattr(repeats, "MOST", 3)
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert Counter(tuple(r) for r in got.collect()) == plain_repeats(rows)
    assert any(tables["large"]) and not any("BroadcastHashJoin" in p for p in plans)
    for halves in tables["halves"]:
        assert min(Counter(r["bucket"] for r in halves).values(), default=2) > 1


def test_repeats_empty(empty):
    assert repeats.remove_repeats(empty).count() == 0


def plain_components(rows):
    sets = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        low[root(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return Counter((r[0], len(sets[i]), least[root(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("long_list", [64, 1])
def test_jaccard(docs, rows, empty, long_list, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard, "COMMON", long_list + 1)
    assert Counter(tuple(r) for r in jaccard.jaccard_components(docs).collect()) == plain_components(rows)
    if long_list == 1:
        assert jaccard.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("bits", [6, 14])
def test_jaccard_counts_all_shingles(bits):
    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 63, 30, dtype=np.uint64) * np.uint64(2)
    slices = [np.concatenate((rng.integers(0, 1 << 63, 500, dtype=np.uint64), *[common[: i % 30] for _ in range(3)])) for i in range(60)]
    dealt = [x for tokens in slices for x in jaccard.deal_counts(tokens, bits)]
    n, low = Counter(t for tokens in slices for t in tokens.tolist()), {}
    for b in {b for b, *_ in dealt}:
        cls, level = jaccard.bucket_levels([o for k, o, _ in dealt if k == b], [m for k, _, m in dealt if k == b], 64)
        low |= dict(zip(cls.tolist(), level.tolist(), strict=True))
    want = {(t >> jaccard.LEVEL_BITS) % (1 << jaccard.LEVEL_BITS): c.bit_length() - 1 for t, c in n.items() if c >= 64}
    assert low == want and len(want) > 10
    levels = np.zeros(1 << jaccard.LEVEL_BITS, dtype=np.uint8)
    levels[list(want)] = list(want.values())
    ordered = jaccard.in_order(np.sort(slices[29][:530]), levels).tolist()
    assert ordered == sorted(ordered, key=lambda t: (want.get((t >> jaccard.LEVEL_BITS) % (1 << jaccard.LEVEL_BITS), 0), t))


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15],
    }


def test_base_spans():
    rnd = random.Random(2)
    bits = ["a", "@", ".", "1", "25", "+", "-", " ", "(", ")", "b.c", "4111 1111 1111 1111", ".co", "é", "300"]
    for _ in range(4000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_private(spark, empty):
    rnd = random.Random(3)

    def card():
        d = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
        return d + next(c for c in "0123456789" if pii.luhn(d + c))

    made = [(i, f"text of x{i}@mail.org and +1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)} or {card()} at 10.2.{i % 250}.7 end") for i in range(300)]
    made += [(500, None), (501, ""), (501, ""), (502, "write jim [at] mail3.example [dot] com soon"), (503, "nothing here but 12 apples in 2024"), (504, "ab " * 30_000)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_private(docs).collect()}
    for i, t in made:
        base = plain_spans(t or "")
        line = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [len(base[k]) for k in pii.KINDS]
        assert set(filter(None, line.split(","))) <= set(got[i]["spans"].split(","))
    assert got[502]["spans"].startswith("email:6:") and got[503]["spans"] == "" and got[504]["spans"] == ""
    red = {r["doc_id"]: r["text"] for r in pii.redact_documents(docs).collect()}
    assert red[0].startswith("text of [EMAIL] and [PHONE] or [CARD] at [IP]") and red[500] is None and red[503] == made[-2][1]
    assert pii.find_private(empty).count() == 0


SIDE_BY_SIDE = [
    ("7536784127813050 4845168114407329", [("card", "7536784127813050"), ("card", "4845168114407329")]),
    ("+1 (826) 555-4081 190.137.223.204", [("ip", "190.137.223.204"), ("phone", "+1 (826) 555-4081")]),
]


def test_masked_hosts():
    for text, want in (
        ("jo [at] uni.net. Then we", ["jo [at] uni.net"]),
        ("m (at) a [dot] b (dot) c", ["m (at) a [dot] b (dot) c"]),
        ("q[at]post.fr.", ["q[at]post.fr"]),
        ("a at b", []),
        ("j.smith @ firm.co.uk", ["j.smith @ firm.co.uk"]),
        ("ask jo dot doe at cs dot uni dot edu now", ["jo dot doe at cs dot uni dot edu"]),
        # parts of any length
        (f"to {'l' * 100} [at] {'h' * 90}.{'.'.join(['x' * 9] * 60)}.org!", [f"{'l' * 100} [at] {'h' * 90}.{'.'.join(['x' * 9] * 60)}.org"]),
    ):
        assert [text[a:b] for a, b in pii.masked_spans(text)] == want
    for text, n in (("10[.]0[.]14.2", 1), ("1 . 2 . 3 . 4", 1), ("10.0.14.2", 0), ("1[.]2[.]3", 0), ("1[.]2[.]3[.]4[.]5", 0)):
        assert len(pii.masked_numbers(text)) == n
    # linear in the length, whatever the text
    for text in ("x(at)" + "a. " * 100_000, "a dot " * 100_000, "a at b dot " * 50_000, "1[.]" * 100_000, "a" * 500_000 + "@"):
        assert len(pii.masked_spans(text)) <= 50_000 and not pii.masked_numbers(text)
    assert len(pii.features("call 0123 now", 5, 9)) == len(pii.FEATURES)


@pytest.mark.parametrize("lines", [private_lines.LINES, private_lines.LATER])
def test_lines_written_by_hand(private_models, lines):
    cases = private_lines.cases(lines)
    found = [set(spans) for _, spans in pii.find_spans([t for t, _ in cases], private_models)]
    hits = sum(len(f & set(truth)) for f, (_, truth) in zip(found, cases, strict=True))
    assert hits >= 0.9 * sum(len(truth) for _, truth in cases) and hits >= 0.95 * sum(map(len, found))
    assert all(m.trees for m in private_models.values())


@pytest.fixture(scope="module")
def private_models(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_numbers_side_by_side(spark):
    rnd = random.Random(6)
    for run, want in SIDE_BY_SIDE:
        text = f"pay {run} 2nd time"
        assert set(want) <= {(k, text[a:b]) for k, a, b in pii.candidates(text)}
    # linear in the number of groups
    assert len(pii.candidates("1 2 " * 5000)) < 20 * 2 * 10_000

    def card():
        d = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
        return d + next(c for c in "0123456789" if pii.luhn(d + c))

    made = [(i, f"text of +1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)} or {card()} at 10.{rnd.randint(0, 255)}.{i % 250}.7 end") for i in range(300)]
    made += [(900 + i, f"some text with {run} in it") for i, (run, _) in enumerate(SIDE_BY_SIDE)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_private(docs).collect()}
    for i, (_, want) in enumerate(SIDE_BY_SIDE):
        text = made[300 + i][1]
        spans = [s.split(":") for s in got[900 + i].split(",")]
        assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == want


def test_crowds_join_components_across_blocks(spark, monkeypatch):
    """Blocks give one link for each component they join, and later turns deal members anew."""
    sets = spark.createDataFrame([(i, [*range(100), 1000 + i]) for i in range(60)], "sig long, tokens array<long>")

    def joined(comp, turn):
        rows = [(t, i, 101, comp[i], 60) for i in range(60) for t in (5, 7)]
        lists = spark.createDataFrame(rows, "tok long, sig long, n long, comp long, length long")
        links = [tuple(r) for r in jaccard._crowds(lists, sets, 80, turn).collect()]
        out = dict(comp)
        for a, b in links:
            old, new = max(out[a], out[b]), min(out[a], out[b])
            out = {k: new if c == old else c for k, c in out.items()}
        assert len(links) >= len(set(comp.values())) - len(set(out.values()))
        return links, out

    links, comp = joined({i: i % 2 for i in range(60)}, 0)
    assert len(links) == 1 and set(comp.values()) == {0}
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    _, first = joined({i: i for i in range(60)}, 0)
    _, second = joined(first, 1)
    assert 1 < len(set(first.values())) and set(second.values()) == {0}


@pytest.mark.parametrize("fold", [1 << 16, 40])
def test_components_in_few_jobs(spark, monkeypatch, fold):
    """Edges that one task holds are joined there, without a shuffle; more of them round by round, with the same result."""
    monkeypatch.setattr(common, "FOLD", fold)
    rnd = random.Random(4)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)] + [(900, k) for k in range(901, 980)] + [(7, 7)]
    low = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in low:
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    tables = Tables(spark, "test")
    saved = tables.save(spark.createDataFrame(edges, "a long, b long").repartition(5), "given")
    shuffles, save = [], Tables.save
    monkeypatch.setattr(Tables, "save", lambda self, df, name: shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange")) or save(self, df, name))
    got = common.components(saved, tables)
    assert Counter(map(tuple, got.collect())) == Counter(low.items())
    assert (sum(shuffles) == 0) == (fold > 1000)
    assert common.components(saved.limit(0), tables).count() == 0
