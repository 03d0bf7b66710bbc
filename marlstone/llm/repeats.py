"""Removal of long repeated byte strings: sampled suffixes, enhanced suffix arrays, LCP-interval trees."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHARES, Tables, skew_join
from .hashing import byte_column, mix, pieces, prefix_sums, range_hashes

#: Least bytes of a repeat; a window of LENGTH bytes holds SPREAD grams of GRAM bytes.
LENGTH, SPREAD = 200, 128
GRAM = LENGTH - SPREAD + 1
LEFT, RIGHT = LENGTH - GRAM, LENGTH
#: Contexts sorted together in one task; buckets above it are split by longer cores.
MOST = 1024
#: Bytes of one text that are sampled at once, and how far a slice reaches beyond them on either side.
SLICE, BEYOND = 2 << 20, 2 * (LENGTH + GRAM + SPREAD)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sampled suffixes: (row, pos, left, right, gram hash, context hash).

    The rightmost least gram hash of every run of SPREAD gram positions is taken, so that each
    LENGTH-byte string holds a sampled gram, at the same place wherever the string occurs."""
    n = len(data)
    empty = np.zeros(0, dtype=np.int64)
    if n < LENGTH:
        return empty, empty, empty, empty, empty, empty
    sums = prefix_sums(data)
    at = np.arange(n - GRAM + 1)
    h = range_hashes(sums, at, at + GRAM)
    # least of each run: high bits of the hash, then the rightmost position
    key = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    width = 1
    while width < SPREAD:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    chosen = (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64)
    chosen = np.unique(chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))])
    row = np.searchsorted(offsets, chosen, side="right") - 1
    start, end = offsets[row], offsets[row + 1]
    ok = (chosen + GRAM <= end) & (end - start >= LENGTH)
    row, chosen, start, end = row[ok], chosen[ok], start[ok], end[ok]
    left, right = np.minimum(LEFT, chosen - start), np.minimum(RIGHT, end - chosen)
    context = mix(range_hashes(sums, chosen - left, chosen + right) + left.astype(np.uint64))
    return row, chosen - start, left, right, h[chosen].view(np.int64), context.view(np.int64)


def sampled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchors(), a single long text slice by slice: each slice reaches far enough beyond its own
    positions to hold every window and context of theirs, so the anchors are the same."""
    n = len(data)
    if len(offsets) > 2 or n <= SLICE:
        return anchors(data, offsets)
    out = []
    for own in range(0, n, SLICE):
        first, last = max(0, own - BEYOND), min(n, own + SLICE + BEYOND)
        row, pos, *rest = anchors(data[first:last], np.array([0, last - first]))
        mine = (pos + first >= own) & (pos + first < own + SLICE)
        out.append((row[mine], pos[mine] + first, *(x[mine] for x in rest)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common start of each row of a and b, at most most."""
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), most)


def _matrix(values: list[bytes], width: int, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(v) for v in values], dtype=np.int64)
    rows = [(v[::-1] if reverse else v).ljust(width, b"\0") for v in values]
    return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(values), width), size


def intervals(lcp: np.ndarray):
    """The LCP-interval tree by one stack scan, children first: (depth, first, last) of each node.

    lcp[i] is the common prefix of suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, x in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > x:
            depth, first = stack.pop()
            yield depth, first, i
        if x >= 0 and (not stack or stack[-1][0] < x):
            stack.append((x, first))


def repeats(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, least: int = LENGTH):
    """Maximal repeats of suffixes sorted by right context: (members, left extension of each, depth).

    A node of the interval tree holds suffixes with depth bytes in common to the right. Its members
    are ordered by what stands to their left, last byte first; neighbours in that order show how far
    each extends to the left together with another. Where all extend alike the node repeats what an
    earlier suffix shows; where they differ (left diversity) each class of members that extends far
    enough is a maximal repeat, all its occurrences given."""
    lcp = _common(right[:-1], right[1:], np.minimum(n_right[:-1], n_right[1:]))
    for depth, first, last in intervals(lcp):
        if depth + LEFT < least:
            continue
        of = np.arange(first, last + 1)
        if len(of) > 2:
            of = of[np.lexsort(left[of].T[::-1])]
        same = _common(left[of[:-1]], left[of[1:]], np.minimum(n_left[of[:-1]], n_left[of[1:]]))
        reach = np.maximum(np.concatenate(([0], same)), np.concatenate((same, [0])))
        hit = reach + depth >= least
        if hit.any():
            yield of[hit], reach[hit], depth


def _scan(batches):
    """(bucket, h, c, left, right) rows sorted by bucket and right context -> (h, c, l, r) in repeats."""

    def flush(rows):
        bucket = np.array([r[0] for r in rows])
        left, n_left = _matrix([r[3] for r in rows], LEFT, True)
        right, n_right = _matrix([r[4] for r in rows], RIGHT, False)
        l, r = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        pair = cut[:-1][np.diff(cut) == 2]
        if len(pair):
            a = _common(left[pair], left[pair + 1], np.minimum(n_left[pair], n_left[pair + 1]))
            b = _common(right[pair], right[pair + 1], np.minimum(n_right[pair], n_right[pair + 1]))
            hit = a + b >= LENGTH
            for k in (0, 1):
                l[pair[hit] + k], r[pair[hit] + k] = a[hit], b[hit]
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if j - i > 2:
                for of, reach, depth in repeats(left[i:j], n_left[i:j], right[i:j], n_right[i:j]):
                    l[of + i] = np.maximum(l[of + i], reach)
                    r[of + i] = np.maximum(r[of + i], depth)
        hit = np.flatnonzero(r)
        return pa.RecordBatch.from_arrays([pa.array([rows[k][1] for k in hit], pa.int64()), pa.array([rows[k][2] for k in hit], pa.int64()), pa.array(l[hit]), pa.array(r[hit])], ["h", "c", "l", "r"])

    held: list[tuple] = []
    for batch in batches:
        held += zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
        if len(held) >= 2 * MOST:
            k = next((k for k in range(len(held) - 1, 0, -1) if held[k][0] != held[k - 1][0]), 0)
            if k:
                yield flush(held[:k])
                held = held[k:]
    if held:
        yield flush(held)


def _found(contexts: DataFrame, tables: Tables) -> DataFrame:
    """(h, c, l, r): contexts (h, c, left, right) that lie in repeats with others, how far each way.

    Buckets start as equal grams. One with more than MOST contexts is split: a window with o bytes
    left of the gram, o from lo to hi, holds lo bytes of left and LENGTH - hi of right; each half of
    the range makes buckets of its longer core, until they are small, or one window is left and
    all members have it in common. Contexts equal in all windows of a half are settled at once."""
    todo = contexts.select(F.col("h").alias("bucket"), "h", "c", "left", "right", F.lit(0).alias("lo"), F.lit(LEFT).alias("hi"))
    found = []
    for _ in range(LEFT.bit_length() + 1):
        # what is joined grows with the input: by shuffles, never by way of the driver
        n = todo.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = todo.join(n.hint("merge"), "bucket")
        ready = sized.where((F.col("n") <= MOST) & (F.col("lo") < F.col("hi"))).select("bucket", "h", "c", "left", "right")
        scanned = ready.repartition("bucket").sortWithinPartitions("bucket", "right").mapInArrow(_scan, "h long, c long, l long, r long")
        equal = sized.where("lo = hi").select("h", "c", F.col("lo").cast("long").alias("l"), (F.lit(LENGTH) - F.col("hi")).cast("long").alias("r"))
        found.append(tables.save(scanned.union(equal), "found"))
        large = sized.where((F.col("n") > MOST) & (F.col("lo") < F.col("hi")))
        large = tables.save(large, "large")
        if large.isEmpty():
            break
        middle = F.expr("(lo + hi) div 2").cast("int")
        halves = large.withColumn("half", F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi")))))
        halves = halves.select("h", "c", "left", "right", F.col("lo").alias("at"), "half.lo", "half.hi").where((F.octet_length("left") >= F.col("lo")) & (F.octet_length("right") >= F.lit(LENGTH) - F.col("hi")))
        # the hull: all bytes of the range's windows; equal hulls repeat every window, and one goes on for all
        whole = (F.octet_length("left") >= F.col("hi")) & (F.octet_length("right") >= F.lit(LENGTH) - F.col("lo"))
        hull = F.xxhash64("h", "lo", "hi", F.expr("right(hex(left), 2 * hi)"), F.expr(f"substring(right, 1, {LENGTH} - lo)"))
        core = F.xxhash64("h", "lo", "hi", F.expr("right(hex(left), 2 * lo)"), F.expr(f"substring(right, 1, {LENGTH} - hi)"))
        halves = halves.select("h", "c", "at", "lo", "hi", F.when(whole, hull).otherwise(F.xxhash64("h", "c", "lo", "hi")).alias("hull"), core.alias("bucket"))
        # narrow rows: a core that one context holds alone repeats nothing there, and the bytes of others are read again
        shared = halves.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
        halves = tables.save(halves.join(shared.hint("merge"), "bucket"), "halves")
        alike = halves.groupBy("hull").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("c", "h", "bucket", "at", "lo", "hi")).alias("one"))
        alike = tables.save(alike.select("hull", "n", "one.*"), "alike")
        told = halves.select("h", "c", "hull").join(alike.where("n > 1").select("hull", "lo", "hi").hint("merge"), "hull")
        found.append(tables.save(told.select("h", "c", F.col("hi").cast("long").alias("l"), (F.lit(LENGTH) - F.col("lo")).cast("long").alias("r")), "told"))
        # a range's row lends its bytes to both halves
        bytes_ = large.select("h", "c", F.col("lo").alias("at"), "left", "right")
        todo = bytes_.join(alike.drop("hull", "n").hint("merge"), ["h", "c", "at"]).select("bucket", "h", "c", "left", "right", "lo", "hi")
        todo = tables.save(todo, "todo")
        tables.drop(large, halves, alike)
    out = reduce(DataFrame.union, found)
    return out.groupBy("h", "c").agg(F.max("l").alias("l"), F.max("r").alias("r"))


def repeated_spans(docs: DataFrame, tables: Tables) -> DataFrame:
    """(key, start, end) of bytes in repeats, overlapping, for docs (key, text)."""

    def sample(batches):
        for batch in batches:
            key = batch.column("key").to_numpy()
            data, at = byte_column(batch.column("text"))
            for i, j in pieces(at):
                row, pos, _, right, h, c = sampled(data[at[i] : at[j]], at[i : j + 1] - at[i])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(key[i + row]), pa.array(pos), pa.array(right.astype(np.int32))], ["h", "c", "key", "pos", "right"])

    all_ = tables.save(docs.mapInArrow(sample, "h long, c long, key long, pos long, right int"), "anchors")
    twice = all_.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1")
    twice = tables.save(twice.select("h", "n", (F.col("c0") < F.col("c1")).alias("several")), "grams")
    hot = twice.where(F.col("n") * SHARES > all_.count()).select("h").collect()
    some = tables.save(skew_join(all_, twice.drop("n"), "h", hot=hot, grows=True), "candidates")
    tables.drop(all_, twice)
    kinds = some.groupBy("h", "c", "several").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos")).alias("at"))
    kinds = tables.save(kinds, "contexts")
    hot = kinds.where(F.col("n") * SHARES > some.count()).select("h", "c").collect()
    wanted = kinds.where("several").groupBy(F.col("at.key").alias("key")).agg(F.collect_list(F.struct("at.pos", "h", "c")).alias("at"))

    def cut(batches):
        for batch in batches:
            data, offsets = byte_column(batch.column("text"))
            out: tuple[list, ...] = ([], [], [], [])
            for k, places in enumerate(batch.column("at").to_pylist()):
                t = data[offsets[k] : offsets[k + 1]].tobytes()
                for x in places:
                    p = x["pos"]
                    for to, v in zip(out, (x["h"], x["c"], t[max(0, p - LEFT) : p], t[p : p + RIGHT]), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["h", "c", "left", "right"])

    # a key stands for equal rows: one of them will do
    texts = docs.join(wanted.hint("merge"), "key").select("text", "at")
    contexts = tables.save(texts.mapInArrow(cut, "h long, c long, left binary, right binary").dropDuplicates(["h", "c"]), "bytes")
    whole = kinds.where("n > 1").select("h", "c", F.lit(LEFT).cast("long").alias("l"), F.lit(RIGHT).cast("long").alias("r"))
    reach = tables.save(_found(contexts, tables).union(whole).groupBy("h", "c").agg(F.max("l").alias("l"), F.max("r").alias("r")), "reach")
    spans = skew_join(some, reach, ["h", "c"], hot=hot, grows=True).select("key", F.greatest(F.lit(0), F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.least("right", "r")).alias("end"))
    return spans.where(F.col("end") - F.col("start") >= LENGTH)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept).

    Removed is each UTF-8 byte covered by a LENGTH-byte string that also starts anywhere else in the
    table, in the same document too, judged on the input. Texts that occur more than once are
    removed whole where they have LENGTH bytes. For the others: positions are sampled so that each
    window holds one (anchors); equal grams bring occurrences together; equal contexts are a repeat
    at once; different ones are sorted into an enhanced suffix array whose interval tree gives the
    maximal repeats (repeats). Grams are told apart by a 64-bit hash, contexts by two; rows by one of
    doc_id and text, drawn anew if the texts' SHA-256 shows that it holds two rows for one.

    A null or empty text has no bytes; texts of any length are sampled slice by slice, with the same
    result; an empty table gives no rows; equal rows remove each other. Other columns are ignored,
    whatever their names."""
    tables = Tables(docs.sparkSession, "repeats")
    raw = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    plain = docs.select(F.col(doc_id).alias("doc_id"), raw.alias("text"))
    for seed in range(8):
        docs = plain.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text"))
        rows = tables.save(docs.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
        if rows.groupBy("key").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b").isEmpty():
            break
        tables.drop(rows)
    else:
        raise RuntimeError("no hash tells the rows apart")
    copies = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    rows = skew_join(rows, copies, "sha", "left", grows=True).withColumn("gone", F.col("copies").isNotNull() & (F.col("n_bytes") >= LENGTH))
    rows = tables.save(rows.select("doc_id", "key", "n_bytes", "sha", "gone"), "rows")
    spans = repeated_spans(docs.select("key", "text"), tables).join(rows.where("gone").select("key").distinct().hint("merge"), "key", "left_anti")
    spans = tables.save(spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")

    def strip(batches):
        for batch in batches:
            data, at = byte_column(batch.column("text"))
            out: list[tuple] = []
            for k, found in enumerate(batch.column("spans").to_pylist()):
                t = data[at[k] : at[k + 1]].tobytes()
                runs: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in found):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                kept = b"".join(t[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(t)], strict=True))
                out.append((sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary())], ["key", "removed", "runs", "kept_sha", "bytes"])

    stripped = docs.join(spans.hint("merge"), "key").mapInArrow(strip, "key long, removed long, runs long, kept_sha string, bytes binary")
    stripped = stripped.dropDuplicates(["key"])
    gone = F.col("gone")
    out = rows.join(stripped.hint("merge"), "key", "left").select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        *([F.when(gone, F.lit(b"")).otherwise(F.col("bytes")).alias("kept")] if with_text else []),
    )
    return tables.keep(out, "out")
