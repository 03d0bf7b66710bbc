"""N-gram Jaccard self-join by T-occurrence search with DivideSkip."""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Tables, cleaning, components, skew_join
from .hashing import byte_column, mix, pieces, prefix_sums, range_hashes

#: Words in a shingle, and the similarity from which documents link, in hundredths.
WORDS, PERCENT = 5, 80
#: Shingles of COMMON documents or more come later in the global order, by the power of two of their number.
#: Levels are kept for 2 ** LEVEL_BITS classes of shingles, the largest of each, so that the table has
#: this many bytes whatever the input; any such order gives the same links.
COMMON, LEVEL_BITS = 64, 22
#: Shingles are counted in buckets of about so many, dealt by their first bits.
COUNTED = 1 << 20
#: Lists of more than LONG_LIST sets are skipped and probed where the overlap asked for allows.
LONG_LIST = 64
#: Sets searched in one index: at most BLOCK, and of about BLOCK_TOKENS shingles in all.
BLOCK, BLOCK_TOKENS = 512, 1 << 20
SKIP_WEIGHT = 0.01
#: Members of a long list that meet in one task are dealt into parts of about so many.
LIST_PART = 1024
#: How often the members of long lists are dealt into blocks, as long as that joins any.
TURNS = 3
#: Bytes of one text that are hashed at once; longer texts are cut between words.
SLICE = 2 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row, A-Z lower-cased, and the number of words before each row."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    bound = np.zeros(len(data) + 1, dtype=bool)
    bound[offsets] = True
    starts = np.flatnonzero(inside & (bound[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (bound[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return range_hashes(prefix_sums(low), starts, ends), np.searchsorted(starts, offsets)


def _long_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text, SLICE bytes at a time, each slice ending at white space."""
    raw, at, out = data.tobytes(), 0, []
    while at < len(raw):
        space = _SPACE.search(raw, at + SLICE)
        end = space.end() if space else len(raw)
        out.append(_word_hashes(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct word shingles as sorted 64-bit hashes, A-Z lower-cased.

    A text of fewer words is one shingle; one without words has none."""
    n_rows = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, dtype=np.uint64)] * n_rows
    if n_rows == 1 and len(data) > SLICE:
        h = _long_hashes(data)
        first = np.array([0, len(h)])
    else:
        h, first = _word_hashes(data, offsets)
    scale = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    whole = np.zeros(max(0, len(h) - words + 1), dtype=np.uint64)
    for k in range(words):
        whole += h[k : k + len(whole)] * scale[k]
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            t = np.sort(whole[a : b - words + 1])
            out.append(t[np.concatenate(([True], t[1:] != t[:-1]))])
        elif b > a:
            out.append(mix(np.array([(h[a:b] * scale[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(h[:0])
    return out


def _signature(tokens: np.ndarray, seed: int = 0) -> int:
    salt = mix(np.array([seed + 1], dtype=np.uint64))
    return int(mix(mix(tokens ^ salt).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(tokens))).view(np.int64)[0])


def need(a: Column, b: Column, percent: int) -> Column:
    """Least overlap of linked sets of a and b members."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100.0 + percent) - 1e-9).cast("long")


def divide_skip(query: np.ndarray, owners: np.ndarray, tokens: np.ndarray, wanted: dict[int, int]) -> list[int]:
    """Owners of at least wanted[owner] of query's tokens, by T-occurrence search.

    (tokens, owners) is an inverted index sorted by token then owner. The lists of the query's
    tokens are ordered by length; the longest are set aside (fewer than the least overlap asked
    for), the others heap-merged; owners that may still reach the overlap are looked up in the long
    lists by binary search, and dropped as soon as they can't reach it."""
    low, high = np.searchsorted(tokens, query, side="left"), np.searchsorted(tokens, query, side="right")
    lists = sorted((owners[a:b].tolist() for a, b in zip(low.tolist(), high.tolist(), strict=True) if b > a), key=len)
    least = min(wanted.values(), default=1)
    if len(lists) < least:
        return []
    longest = len(lists[-1])
    n_long = min(least - 1, int(least / (SKIP_WEIGHT * np.log2(longest + 1) + 1)))
    short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    found = []
    for owner, run in groupby(heapq.merge(*short)):
        got, left = sum(1 for _ in run), len(long_)
        for probe in reversed(long_):
            if got >= wanted[owner] or got + left < wanted[owner]:
                break
            k = bisect_left(probe, owner)
            got += k < len(probe) and probe[k] == owner
            left -= 1
        if got >= wanted[owner]:
            found.append(owner)
    return found


def _in_pieces(batches, text: str, work):
    """work(batch slice, its shingle sets) for slices of bounded bytes."""
    for batch in batches:
        data, at = byte_column(batch.column(text))
        for i, j in pieces(at):
            yield from work(batch.slice(i, j - i), shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i]))


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _flat(lists: list[np.ndarray]) -> pa.ListArray:
    at = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64)))


def shingle_rows(docs: DataFrame, text: str, doc_id: str, seed: int = 0) -> DataFrame:
    """key (of the row), doc_id, n (shingles), sig and check (two hashes of the set)."""

    def rows(batch, sets):
        marks = [pa.array([_signature(t, 2 * seed + k) for t in sets], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("doc_id"), pa.array([len(t) for t in sets], pa.int64()), *marks], ["key", "doc_id", "n", "sig", "check"])

    return _keyed(docs, text, doc_id).mapInArrow(lambda it: _in_pieces(it, "t", rows), "key long, doc_id long, n long, sig long, check long")


def _counting_bits(total: int) -> int:
    return min(20, max(6, (total // COUNTED).bit_length()))


def deal_counts(tokens: np.ndarray, bits: int) -> list[tuple[int, bytes, bytes]]:
    """(bucket, 32 bits of each shingle met once, 32 bits and count of each met more often).

    The bucket is a shingle's first bits. Shingles that agree in the bucket and in bits 22 to 53 are
    counted as one, which only moves both in the order."""
    tok, n = np.unique(tokens, return_counts=True)
    low, bucket = (tok >> np.uint64(LEVEL_BITS)).astype(np.uint32), (tok >> np.uint64(64 - bits)).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(tok)]
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            once = n[a:b] == 1
            often = np.stack((low[a:b][~once], n[a:b][~once].astype(np.uint32)), axis=1)
            out.append((int(bucket[a]), low[a:b][once].tobytes(), often.tobytes()))
    return out


def bucket_levels(once: list[bytes], often: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, level) of the shingles of one bucket that at least so many documents hold."""
    single = np.frombuffer(b"".join(once), dtype=np.uint32)
    several = np.frombuffer(b"".join(often), dtype=np.uint32).reshape(-1, 2)
    key, at = np.unique(np.concatenate((single, several[:, 0])), return_inverse=True)
    n = np.bincount(at, np.concatenate((np.ones(len(single)), several[:, 1])), minlength=len(key))
    common = n >= least
    return key[common] & np.uint32((1 << LEVEL_BITS) - 1), np.floor(np.log2(n[common])).astype(np.int8)


def _levels(docs: DataFrame, text: str, doc_id: str, total: int) -> np.ndarray:
    """The level of each class of shingles: the power of two of the documents that hold its commonest one.

    All shingles of all documents are counted, copies included, four bytes of each; a bucket is
    counted when all of it has come, in the order of buckets, so a task holds one at a time."""
    bits, least = _counting_bits(total), COMMON

    def deal(batch, sets):
        cols = list(zip(*deal_counts(np.concatenate(sets), bits), strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["bucket", "once", "often"])

    def count(batches):
        bucket, held = None, ([], [])

        def levels():
            cls, level = bucket_levels(*held, least)
            return pa.RecordBatch.from_arrays([pa.array(cls.astype(np.int32)), pa.array(level)], ["class", "level"])

        for batch in batches:
            for b, *parts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "once", "often")), strict=True):
                if b != bucket:
                    if held[0]:
                        yield levels()
                    bucket, held = b, ([], [])
                for mine, part in zip(held, parts, strict=True):
                    mine.append(part)
        if held[0]:
            yield levels()

    dealt = _keyed(docs, text, doc_id).select("t").mapInArrow(lambda it: _in_pieces(it, "t", deal), "bucket int, once binary, often binary")
    counted = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "class int, level byte")
    with cleaning(docs.sparkSession):
        got = counted.groupBy("class").agg(F.max("level").alias("level")).toArrow()
    levels = np.zeros(1 << LEVEL_BITS, dtype=np.uint8)
    levels[got.column("class").to_numpy()] = got.column("level").to_numpy()
    return levels


def in_order(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Sorted shingles in the global order: by level, then by hash."""
    return tokens[np.argsort(levels[(tokens >> np.uint64(LEVEL_BITS)).astype(np.int64) & ((1 << LEVEL_BITS) - 1)], kind="stable")]


def prefix_rows(docs: DataFrame, text: str, doc_id: str, percent: int, levels: np.ndarray, seed: int) -> DataFrame:
    """sig, n and prefix of each row with shingles: the first ones in the global order, so many that
    linked sets share one."""

    def rows(batch, sets):
        sets = [t for t in sets if len(t)]
        prefix = [in_order(t, levels)[: _prefix_length(len(t), percent)] for t in sets]
        sig = pa.array([_signature(t, 2 * seed) for t in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([sig, pa.array([len(t) for t in sets], pa.int64()), _flat(prefix)], ["sig", "n", "prefix"])

    return _keyed(docs, text, doc_id).select("t").mapInArrow(lambda it: _in_pieces(it, "t", rows), "sig long, n long, prefix array<long>")


def _entries(prefixes: DataFrame) -> DataFrame:
    return prefixes.select(F.posexplode("prefix").alias("pos", "tok"), "sig", "n")


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    i, t = F.col(doc_id).cast("long"), F.col(text)
    return docs.select(F.xxhash64(i, t).alias("rep"), i.alias("doc_id"), t.alias("t"))


def _sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, text: str, doc_id: str, tables: Tables, seed: int) -> DataFrame:
    """(sig, tokens) of the given sets, read again from a row of each, found by its key; more than
    once where rows are equal, which gives the same links more than once."""
    wanted = nodes.join(classes, "sig").select("rep", "sig")
    texts = _keyed(docs, text, doc_id).select("rep", "t").join(wanted, "rep")

    def rows(batch, sets):
        own = np.array([_signature(t, 2 * seed) for t in sets], dtype=np.int64)
        keep = np.flatnonzero(own == batch.column("sig").to_numpy())  # other rows may bear the same key
        yield pa.RecordBatch.from_arrays([pa.array(own[keep]), _flat([sets[k] for k in keep])], ["sig", "tokens"])

    got = texts.select("sig", "t").mapInArrow(lambda it: _in_pieces(it, "t", rows), "sig long, tokens array<long>")
    return tables.save(got, "sets")


def _dealt(sig: str, crowd: Column) -> Column:
    """The part that a member of a crowd is dealt to by its hash, so that parts hold about BLOCK sets
    and BLOCK_TOKENS shingles, n_ being the size of one set: a struct of the number of parts, a power of four, and the part."""
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"{BLOCK_TOKENS} div greatest(1, n_)")))
    parts = F.pow(F.lit(4), F.ceil(F.log(F.greatest(F.lit(1.0), crowd / room)) / math.log(4))).cast("long")
    return F.struct(parts.alias("parts"), F.pmod(F.xxhash64(sig), parts).alias("part"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets link, found by divide_skip of a in indexes of its partners.

    pairs also hold a_n, the size of a, and crowd, at least the number of a's partners."""
    dealt = pairs.withColumn("n_", F.col("a_n")).withColumn("block", _dealt("b", F.col("crowd")))
    index = dealt.join(sets.select(F.col("sig").alias("b"), "tokens"), "b").groupBy("a", "block").agg(F.collect_list(F.struct("b", "tokens")).alias("others"))
    both = index.join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("own")), "a").select("a", "own", "others")

    def search(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                own = np.sort(np.asarray(batch.column("own")[k].values).view(np.uint64))
                inner = batch.column("others")[k].values
                ids, lists = np.asarray(inner.field("b")), inner.field("tokens")
                at = np.asarray(lists.offsets)
                sizes = np.diff(at)
                tokens = np.asarray(lists.values).view(np.uint64)[at[0] : at[-1]]
                owner = np.repeat(np.arange(len(ids)), sizes)
                order = np.lexsort((owner, tokens))
                wanted = {i: -(-percent * (len(own) + n) // (100 + percent)) for i, n in enumerate(sizes.tolist())}
                hit = divide_skip(own, owner[order], tokens[order], wanted)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("a")[k].as_py()] * len(hit), pa.int64()), pa.array(ids[hit] if hit else [], pa.int64())], ["a", "b"])

    return both.mapInArrow(search, "a long, b long")


def _crowds(lists: DataFrame, sets: DataFrame, percent: int, turn: int = 0) -> DataFrame:
    """Pairs of components (a, b) that links join within blocks of the members of long lists.

    Each member goes to its longest list, on later turns to another that is at least half as long,
    the same for all that have it; lists are dealt into blocks, anew on each turn, so that what the
    blocks of one turn left apart meets in the next. In a block a walk over links searches from each
    member reached among those of components not reached yet."""
    by = F.struct("length", "tok", "n")
    if turn:
        longest = F.max("length").over(Window.partitionBy("sig"))
        by = F.struct(F.when(2 * F.col("length") >= F.col("longest"), F.xxhash64(F.lit(turn), "tok")).alias("at"), "length", "tok", "n")
        lists = lists.withColumn("longest", longest)
    chosen = lists.groupBy("sig", "comp").agg(F.max(by).alias("m")).select("sig", "comp", "m.tok", "m.length", F.col("m.n").alias("n_"))
    if turn:
        chosen = chosen.withColumn("_turn", F.xxhash64(F.lit(turn), "sig"))
    dealt = chosen.withColumn("block", _dealt("_turn" if turn else "sig", F.col("length"))).select("sig", "comp", "tok", "block")
    members = dealt.join(sets, "sig").groupBy("tok", "block").agg(F.collect_list(F.struct("sig", "comp", "tokens")).alias("members"))

    def walk(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                inner = batch.column("members")[k].values
                lists_ = inner.field("tokens")
                at = np.asarray(lists_.offsets)
                own = [np.sort(np.asarray(lists_.values).view(np.uint64)[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                tokens, owner = np.concatenate(own), np.repeat(np.arange(len(own)), np.diff(at))
                order = np.lexsort((owner, tokens))
                tokens, owner = tokens[order], owner[order]
                names, comp = np.unique(np.asarray(inner.field("comp")), return_inverse=True)
                of = [np.flatnonzero(comp == c) for c in range(comp.max() + 1)] if len(own) else []
                free, a, b = np.ones(len(own), dtype=bool), [], []
                for seed in range(len(own)):
                    queue = of[comp[seed]].tolist() if free[seed] else []
                    free[queue] = False
                    while queue:
                        x = queue.pop()
                        rest = free[owner]
                        tokens, owner = tokens[rest], owner[rest]
                        n = len(own[x])
                        wanted = {i: -(-percent * (n + len(own[i])) // (100 + percent)) for i in np.flatnonzero(free).tolist()}
                        hit = divide_skip(own[x], owner, tokens, wanted) if wanted else []
                        for y in hit:
                            if free[y]:  # its whole component is reached with it
                                free[of[comp[y]]] = False
                                queue += of[comp[y]].tolist()
                                a.append(names[comp[x]])
                                b.append(names[comp[y]])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return members.mapInArrow(walk, "a long, b long")


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id.

    Two documents link if 100 * |A & B| >= percent * |A | B| for their sets of five-word shingles;
    component_id is the smallest doc_id that links reach. Shingles are told apart by 64-bit hashes;
    sets by a 64-bit hash, drawn anew if a second one shows that it holds two sets for one.

    1. Equal sets are one class. Shingles get a global order, those of many documents last, by their
       counts over the whole table (_levels). Each class puts its prefix in an inverted index;
       prefixes of linked sets share at least T - ceil(percent * n) + 1 shingles, T the overlap asked for.
    2. In each list the smallest class leads. Pairs of a leader and a member with enough lists in
       common are searched (T-occurrence with DivideSkip, on whole sets) and linked.
    3. Members of long lists that still hold several components are walked over in blocks, which
       joins large groups of near copies; other blocks then join what the first left apart.
    4. Lists then hold few components. Only pairs across components go on: those that short lists
       bring together often enough, at places early enough in both sets for their sizes, long lists
       counting as shared until probed; a long list itself brings pairs together only where the
       short ones could miss them. They are searched too.

    Every link between different sets either is found in steps 2 to 4 or lies inside a component that
    is already joined. A null or empty text has no shingles and its own doc_id as component; a
    null doc_id links as others do and is never the smallest while there is another. Equal rows are
    in one component; rows that share a doc_id are separate documents. Very long texts are hashed in
    slices cut between words, so memory grows with their words only. An empty table gives no rows.
    Other columns are ignored, whatever their names."""
    tables = Tables(docs.sparkSession, "jaccard")
    for seed in range(8):
        rows = tables.save(shingle_rows(docs, text, doc_id, seed), "rows")
        classes = rows.where("n > 0").groupBy("sig").agg(F.min("key").alias("rep"), F.min("doc_id").alias("low"), F.first("n").alias("n"), F.min("check").alias("c0"), F.max("check").alias("c1"))
        classes = tables.save(classes, "classes")
        if classes.where("c0 <> c1").isEmpty():
            break
        tables.drop(rows, classes)
    else:
        raise RuntimeError("no hash tells the sets apart")

    total = rows.agg(F.sum("n")).first()[0] or 0
    levels = _levels(docs, text, doc_id, total) if total else np.zeros(1 << LEVEL_BITS, dtype=np.uint8)
    prefixes = tables.save(prefix_rows(docs, text, doc_id, percent, levels, seed).dropDuplicates(["sig"]), "prefixes")
    # a list holds one shingle, narrow rows only; common shingles have left most prefixes
    of_list, by_sig = Window.partitionBy("tok"), Window.partitionBy("tok").orderBy("sig")
    led = _entries(prefixes).withColumns({"leader": F.first("sig").over(by_sig), "leader_n": F.first("n").over(by_sig), "after": F.lead("sig").over(by_sig)})
    led = led.where("sig <> leader or after is not null").drop("after").withColumn("length", F.count(F.lit(1)).over(of_list))
    led = tables.save(led, "lists")
    tables.drop(prefixes)

    def sizes_fit(a: str, b: str) -> Column:
        return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)

    def enough(a: str, b: str) -> Column:
        return need(F.col(a), F.col(b), percent) - F.ceil(F.lit(percent) * F.greatest(a, b) / 100.0 - 1e-9).cast("long") + 1

    def links(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
        sets = _sets_of(docs, classes, nodes, text, doc_id, tables, seed)
        out = tables.save(_verified(pairs, sets, percent), "links")
        tables.drop(sets)
        return out

    stars = led.where((F.col("sig") != F.col("leader")) & sizes_fit("n", "leader_n")).groupBy("leader", "leader_n", "sig", "n").agg(F.count(F.lit(1)).alias("c"), F.max("length").alias("crowd"))
    stars = tables.save(stars.where(F.col("c") >= enough("n", "leader_n")).select(F.col("leader").alias("a"), F.col("sig").alias("b"), F.col("leader_n").alias("a_n"), "crowd"), "stars")
    first = links(stars)
    tables.drop(stars)
    joined = components(first, tables)

    def open_lists(lists: DataFrame) -> DataFrame:
        """Those that still hold several components, with their lengths."""
        several = lists.groupBy("tok").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("length")).where("c0 < c1").select("tok", "length")
        return tables.save(lists.join(several, "tok").select("tok", "sig", "n", "pos", "comp", "length"), "open")

    lists = led.select("tok", "sig", "n", "pos").join(joined.select(F.col("node").alias("sig"), "component"), "sig", "left")
    lists = open_lists(lists.withColumn("comp", F.coalesce("component", "sig")))
    tables.drop(led)
    known, sets = joined, None
    # later turns join what blocks left apart, so that large components do not meet pair by pair
    for turn in range(TURNS):
        crowded = lists.where(F.col("length") > LONG_LIST)
        if crowded.isEmpty():
            break
        sets = sets or _sets_of(docs, classes, crowded.select("sig").distinct(), text, doc_id, tables, seed)
        crowd = tables.save(_crowds(crowded, sets, percent, turn), "crowds")
        if crowd.isEmpty():
            break
        up = components(crowd, tables)
        known = known.union(up)
        before, lists = lists, open_lists(lists.drop("length").join(up.withColumnRenamed("node", "comp"), "comp", "left").withColumn("comp", F.coalesce("component", "comp")))
        tables.drop(before)
    if sets:
        tables.drop(sets)
    lists = lists.withColumn("long", F.col("length") > LONG_LIST)
    of_sig = lists.groupBy("sig").agg(F.count_if("long").alias("n_long"), F.sum("length").alias("reach"))
    lists = lists.join(of_sig, "sig").withColumn("at", F.row_number().over(Window.partitionBy("sig", "long").orderBy("tok")))
    lists = lists.withColumn("parts", F.expr(f"1 + length div {LIST_PART}"))
    # the members of a long list meet part by part
    a = lists.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    b = lists.withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")))
    a, b = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]), b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    skipped = F.least("a_n_long", "b_n_long")
    # of so many shared lists, the first stands no later than this among the long ones of either
    early = (F.col("a_at") <= F.col("a_n_long") - enough("a_n", "b_n") + 1) & (F.col("b_at") <= F.col("b_n_long") - enough("a_n", "b_n") + 1)
    pair = (F.col("a_tok") == F.col("b_tok")) & (F.col("a_part") == F.col("b_part")) & (F.col("a_sig") < F.col("b_sig")) & (F.col("a_comp") != F.col("b_comp")) & sizes_fit("a_n", "b_n")
    # linked sets share so many shingles in their first ones, counted from their own sizes
    shared = need(F.col("a_n"), F.col("b_n"), percent) - enough("a_n", "b_n")
    placed = (F.col("a_pos") < F.col("a_n") - shared) & (F.col("b_pos") < F.col("b_n") - shared)
    pairs = a.join(b, pair & placed & (~F.col("a_long") | early))
    pairs = pairs.groupBy("a_sig", "b_sig", "a_n", "b_n", "a_reach", skipped.alias("skipped")).agg(F.count_if(~F.col("a_long")).alias("c"))
    pairs = pairs.where(F.col("c") + F.col("skipped") >= enough("a_n", "b_n")).select(F.col("a_sig").alias("a"), F.col("b_sig").alias("b"), "a_n", F.col("a_reach").alias("crowd"))
    across = links(tables.save(pairs, "pairs"))
    known = known.select(F.col("node").alias("a"), F.col("component").alias("b"))
    comp = components(known.union(across), tables)

    class_of = classes.select("sig", "low").join(comp.select(F.col("node").alias("sig"), "component"), "sig", "left")
    class_of = tables.save(class_of.select("sig", "low", F.coalesce("component", "sig").alias("class")), "members")
    lowest = skew_join(class_of.drop("low"), class_of.groupBy("class").agg(F.min("low").alias("low")), "class").select("sig", "low")
    some = rows.where("n > 0").select("doc_id", "n", "sig")
    found = skew_join(some, tables.save(lowest, "lowest"), "sig").select("doc_id", F.col("n").alias("n_shingles"), F.col("low").alias("component_id"))
    own = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return tables.keep(found.union(own), "found")
