"""Long exact spans shared between records, by super-k-mer partitioning.

A window is a stretch of `length` code points. Its minimiser is the smallest hash of the `grain`-character stretches
in it. Consecutive windows of a record that share a minimiser form a super-k-mer; it goes, as one packed string, to the
bucket of its minimiser, where the windows are sorted and counted. Equal windows have equal minimisers, so all copies of
a window meet in one bucket. A bucket with too many different strings is cut again by a further minimiser, and only what
hardly any minimiser can part is counted window by window, as text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import staged
from .chars import code_points, powers, rolling_hash, segments, sliding_min
from .sieve import sifted

#: Windows of one packed string at most, so that strings stay short in texts that repeat one stretch for ever.
MAX_WINDOWS = 1024
#: Distinct strings that a bucket may hold to be sorted in one piece; larger buckets are cut again.
MAX_STRINGS = 2048
#: Places per window where windows are counted one by one.
SALTS = 16
#: Grains of the further minimisers, and a factor each that puts hashes into another order.
FURTHER = ((48, 0x9E3779B97F4A7C15), (32, 0xC2B2AE3D27D4EB4F))
#: Records of one share that meet in one task when pairs are formed; more are spread.
PAIR_BLOCK = 512


@dataclass
class SharedSpans:
    """members: which record has which packed string where (bucket, string, record_type, id, owner, version, at).
    links: the strings of a bucket that have a window in common (bucket, share, string).
    covered: the stretches of a packed string that are shared (bucket, string, first, last window)."""

    length: int
    members: DataFrame
    links: DataFrame
    covered: DataFrame


def _super_kmers(length: int, grain: int, factor: int = 1, kept: tuple[str, ...] = ("record_type", "id", "owner_hash", "version")):
    """The kept columns and (bucket, at, windows) of all super-k-mers of a column of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = None
        for b in batches:
            codes, starts = code_points(b.column("text"))
            row, bucket, at, count = [], [], [], []
            for part in segments(starts, length):
                x = np.concatenate([codes[a:e] for _, a, e in part])
                if p is None or len(p[0]) < len(x):
                    p = powers(max(len(x), 1 << 20))
                least = sliding_min(rolling_hash(x, grain, p) * np.uint64(factor), length - grain + 1)
                sizes = np.array([e - a for _, a, e in part])
                ends = np.cumsum(sizes)
                begins = ends - sizes
                n = len(least)
                new = np.empty(n, bool)
                new[0] = True
                np.not_equal(least[1:], least[:-1], out=new[1:])
                new[begins[begins < n]] = True
                invalid = np.minimum(ends - length + 1, n)  # first position whose window leaves the segment
                new[invalid[invalid < n]] = True
                first = np.flatnonzero(new)
                seg = np.searchsorted(ends, first, "right")
                last = np.r_[first[1:], n]
                ok = first <= ends[seg] - length
                first, last, seg = first[ok], last[ok], seg[ok]
                if len(first) and (last - first).max() > MAX_WINDOWS:
                    pieces = -(-(last - first) // MAX_WINDOWS)
                    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    first = np.repeat(first, pieces) + nth * MAX_WINDOWS
                    last, seg = np.minimum(np.repeat(last, pieces), first + MAX_WINDOWS), np.repeat(seg, pieces)
                rows = np.array([r for r, _, _ in part])[seg]
                offset = np.array([a for _, a, _ in part])[seg] - starts[rows]
                row.append(rows)
                bucket.append(least[first].view(np.int64))
                at.append(first - begins[seg] + offset)
                count.append(last - first)
            if row:
                rows = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in kept), *(pa.array(np.concatenate(v)) for v in (bucket, at, count))], names=[*kept, "bucket", "at", "windows"])

    return run


def _pack(length: int):
    """Cut the packed strings out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, size = [], 0
            for i, (text, kmers) in enumerate(zip(b.column("text").to_pylist(), b.column("kmers").to_pylist())):
                parts += [(i, k["bucket"], k["at"], k["windows"], text[k["at"] : k["at"] + k["windows"] + length - 1]) for k in kmers]
                size += sum(k["windows"] + length for k in kmers)
                if size > 4_000_000:
                    yield batch(b, parts)
                    parts, size = [], 0
            if parts:
                yield batch(b, parts)

    def batch(b: pa.RecordBatch, parts: list[tuple]) -> pa.RecordBatch:
        rows, bucket, at, windows, packed = zip(*parts)
        rows = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [*(b.column(c).take(rows) for c in ("record_type", "id", "owner", "owner_hash", "version")), pa.array(bucket, pa.int64()), pa.array(at, pa.int64()), pa.array(windows, pa.int64()), pa.array(packed, pa.string())],
            names=["record_type", "id", "owner", "owner_hash", "version", "bucket", "at", "windows", "packed"],
        )

    return run


def _count_windows(length: int):
    """Sort the windows of whole buckets; yield (bucket, string, share, first, last): share >= 0 a set of strings with a
    window in common, else -1 with a shared stretch of a string."""

    def solve(bucket, string, low, high, packed) -> pa.RecordBatch:
        codes, starts = code_points(packed)
        p = powers(len(codes))
        h = rolling_hash(codes, length, p)
        counts = np.diff(starts) - length + 1
        owner = np.repeat(np.arange(len(counts)), counts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = starts[owner] + offset
        h, of = h[place], np.unique(bucket, return_inverse=True)[1][owner]
        o = np.lexsort((owner, h, of))
        h, of, owner, offset = h[o], of[o], owner[o], offset[o]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
        size = np.diff(np.r_[first, len(h)])
        shared = np.minimum.reduceat(low[owner], first) != np.maximum.reduceat(high[owner], first)
        texts = packed.to_pylist()
        flags = np.zeros(len(h), bool)
        sets: dict[tuple, None] = {}
        for a, n in zip(first[shared].tolist(), size[shared].tolist()):
            groups: dict[str, list[int]] = {}
            for i in range(a, a + n):  # compared as text: a hash decides nothing
                groups.setdefault(texts[owner[i]][offset[i] : offset[i] + length], []).append(i)
            for same in groups.values():
                who = sorted({int(owner[i]) for i in same})
                if len(groups) == 1 or min(low[w] for w in who) != max(high[w] for w in who):
                    flags[same] = True
                    sets[tuple(who)] = None
        out = [[], [], [], [], []]

        def add(s, share, a, b):
            for v, x in zip(out, (bucket[s], string[s], share, a, b)):
                v.append(int(x))

        for share, who in enumerate(sets):
            for s in who:
                add(s, share, 0, 0)
        at = o[flags]  # back in the order of strings and offsets
        at.sort()
        if len(at):
            s_of, off = np.repeat(np.arange(len(counts)), counts)[at], (np.arange(len(flags)) - np.repeat(np.cumsum(counts) - counts, counts))[at]
            cut = np.r_[True, (s_of[1:] != s_of[:-1]) | (off[1:] != off[:-1] + 1)]
            begin, end = np.flatnonzero(cut), np.r_[np.flatnonzero(cut)[1:], len(at)] - 1
            for a, b in zip(begin.tolist(), end.tolist()):
                add(s_of[a], -1, off[a], off[b])
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["bucket", "string", "share", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(whole: pa.Table):
            cols = [whole[c].combine_chunks() for c in ("bucket", "string", "low", "high", "packed")]
            bucket = cols[0].to_numpy()
            edge = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
            chars = np.r_[0, np.cumsum(pc.utf8_length(cols[4]).to_numpy())]
            a = 0
            for b, e in zip(edge[:-1].tolist(), edge[1:].tolist()):  # some whole buckets at a time
                if chars[e] - chars[a] > 1_000_000 or e == len(bucket):
                    part = [c.slice(a, e - a) for c in cols]
                    yield solve(*(c.to_numpy() for c in part[:4]), part[4])
                    a = e

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            bucket = t["bucket"].to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield from flush(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def find_shared(records: DataFrame, length: int = 200, grain: int = 64, max_strings: int = MAX_STRINGS) -> SharedSpans:
    """records: record_type, id, owner, text. Stretches of at least `length` code points that stand word for word in
    records of one record_type with different owners.

    Rows with a null id, owner or text, and texts shorter than length, share nothing. Repeated rows have one owner and
    so don't count as sharing; versions of one id with different texts are kept apart by a hash of the text. Other
    columns are not read.

    First only the minimisers travel, once: buckets with a single owner are dropped where they stand, by a filter of the
    others, and so are texts without a bucket that is left, before either is moved. What is left is
    cut out of the texts and sent to its bucket, copies of one string once. Buckets with up to max_strings different
    strings are sorted in one piece; larger ones are cut by the FURTHER minimisers into smaller ones, where copies
    of a string fall together again. What is too large even then is counted window by window, spread over all tasks and
    combined before the shuffle. Windows are compared as text everywhere.
    """
    texts = records.select("record_type", "id", "owner", "text").where(F.col("id").isNotNull() & F.col("owner").isNotNull() & (F.length("text") >= length))
    texts = texts.withColumn("owner_hash", F.xxhash64("owner")).withColumn("version", F.xxhash64("text")).withColumn("record", F.xxhash64("record_type", "id", "version"))
    kmers = staged(
        texts.select("record_type", "record", "owner_hash", "version", "text")
        .mapInArrow(_super_kmers(length, grain, kept=("record_type", "record", "owner_hash", "version")), "record_type string, record long, owner_hash long, version long, bucket long, at long, windows long")
        .withColumn("bucket", F.col("bucket").bitwiseXOR(F.xxhash64("record_type")))
        .drop("record_type"),
        "spans-kmers",
    )
    buckets = staged(kmers.groupBy("bucket").agg(F.min("owner_hash").alias("low"), F.max("owner_hash").alias("high")).where("low <> high").select("bucket"), "spans-buckets")
    shared = sifted(kmers.select("record", "version", "bucket", "at", "windows"), "bucket", buckets).join(buckets, "bucket", "left_semi")
    wanted = staged(shared.groupBy("record", "version").agg(F.collect_set(F.struct("bucket", "at", "windows")).alias("kmers")), "spans-wanted")
    held = sifted(texts, "record", wanted.select("record"))
    packed = held.join(wanted, ["record", "version"]).mapInArrow(_pack(length), "record_type string, id string, owner string, owner_hash long, version long, bucket long, at long, windows long, packed string")
    packed = staged(packed.withColumn("string", F.xxhash64("packed")), "spans-packed")

    found = _counted(packed.select("bucket", "string", "packed", F.col("owner_hash").alias("low"), F.col("owner_hash").alias("high")), length, max_strings, FURTHER)
    links = found.where("share IS NOT NULL").select("bucket", "share", "string")
    covered = found.where("share IS NULL").select("bucket", "string", "first", "last")
    members = packed.select("bucket", "string", "record_type", "id", "owner", "version", "at").distinct()
    return SharedSpans(length, members, links, covered)


_FOUND = ("bucket", "string", "share", "first", "last")


def _counted(rows: DataFrame, length: int, max_strings: int, further: tuple[tuple[int, int], ...]) -> DataFrame:
    """The _FOUND of strings (bucket, string, packed, low, high; any number of rows each): a share for each set of strings with a window in common, a null
    share for each shared stretch of a string."""
    sizes = rows.groupBy("bucket").agg(F.approx_count_distinct("string").alias("n"), F.min("low").alias("a"), F.max("high").alias("b")).where("a <> b")
    strings = rows.groupBy("bucket", "string", "packed").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    strings = staged(strings.join(sizes.select("bucket", "n"), "bucket"), "spans-strings")
    whole = strings.where(F.col("n") <= max_strings).select("bucket", "string", "low", "high", "packed").repartition("bucket").sortWithinPartitions("bucket")
    found = staged(whole.mapInArrow(_count_windows(length), "bucket long, string long, share long, first long, last long"), "spans-found")
    found = found.withColumn("share", F.when(F.col("share") >= 0, F.col("share").cast("string"))).select(*_FOUND)
    large = strings.where(F.col("n") > max_strings).drop("n")
    if large.isEmpty():
        return found
    if not further:
        return found.unionByName(_count_apart(large, length))
    # The same windows in smaller buckets; what is found there is told of the strings the new ones were cut from.
    grain, factor = further[0]
    cut = large.select("bucket", "string", F.col("packed").alias("text"), "low", "high").withColumnsRenamed({"bucket": "from_bucket", "string": "from_string"})
    cut = cut.mapInArrow(_super_kmers(length, grain, factor, ("from_bucket", "from_string", "low", "high", "text")), "from_bucket long, from_string long, low long, high long, text string, bucket long, at long, windows long")
    cut = cut.withColumn("packed", F.expr(f"substring(text, at + 1, windows + {length - 1})")).withColumn("bucket", F.xxhash64("from_bucket", "bucket")).withColumn("string", F.xxhash64("packed"))
    cut = staged(cut.drop("text", "windows"), "spans-cut")
    inner = _counted(cut.select("bucket", "string", "packed", "low", "high"), length, max_strings, further[1:])
    back = inner.join(cut.select("bucket", "string", "from_bucket", "from_string", "at"), ["bucket", "string"])
    share = F.when(F.col("share").isNotNull(), F.concat_ws("/", F.col("bucket").cast("string"), "share"))
    back = back.select(F.col("from_bucket").alias("bucket"), F.col("from_string").alias("string"), share.alias("share"), (F.col("first") + F.col("at")).alias("first"), (F.col("last") + F.col("at")).alias("last"))
    return found.unionByName(back)


def _count_apart(strings: DataFrame, length: int) -> DataFrame:
    """The _FOUND of strings in buckets that stay large, window by window: each window with its text, spread over SALTS places."""
    each = strings.select("bucket", "string", "low", "high", F.posexplode(F.expr(f"transform(sequence(1, length(packed) - {length - 1}), i -> substring(packed, i, {length}))")).alias("first", "window"))
    shared = each.groupBy("bucket", "window").agg(F.min("low").alias("a"), F.max("high").alias("b")).where("a <> b").select("bucket", "window", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hits = each.withColumn("salt", F.pmod(F.xxhash64("string"), F.lit(SALTS)).cast("int")).join(shared, ["bucket", "window", "salt"])
    first = F.col("first").cast("long")
    links = hits.select("bucket", "string", F.concat(F.lit("w"), F.sha2("window", 256)).alias("share"), first.alias("first"), first.alias("last"))
    return links.unionByName(links.withColumn("share", F.lit(None).cast("string")))


def shared_pairs(s: SharedSpans) -> DataFrame:
    """Pairs of records with a common span: record_type, id_a < id_b, of different owners (distinct). All pairs of a share are rows
    of the result, so a share of many records is spread in blocks of PAIR_BLOCK of them, each block against all."""
    groups = s.links.join(s.members, ["bucket", "string"]).select("bucket", "share", "record_type", "id", "owner").distinct()
    groups = staged(groups, "spans-groups")
    hot = groups.groupBy("bucket", "share").agg((F.count("*") / PAIR_BLOCK).cast("int").alias("more")).where("more > 0")
    sized = groups.join(hot, ["bucket", "share"], "left").withColumn("blocks", F.coalesce(F.col("more"), F.lit(0)) + 1).drop("more")
    a = sized.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks").withColumnsRenamed({"id": "id_a", "owner": "owner_a"})
    b = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").withColumnsRenamed({"id": "id_b", "owner": "owner_b"})
    return a.join(b, ["bucket", "share", "record_type", "block"]).where("id_a < id_b AND owner_a <> owner_b").select("record_type", "id_a", "id_b").distinct()


def shared_stretches(s: SharedSpans) -> DataFrame:
    """The shared stretches of each record, merged: record_type, id, version, span_start, span_end (half open)."""
    rows = s.covered.join(s.members, ["bucket", "string"]).select("record_type", "id", "version", (F.col("at") + F.col("first")).alias("a"), (F.col("at") + F.col("last") + s.length).alias("b")).distinct()
    w = W.partitionBy("record_type", "id", "version").orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(before >= F.col("a"), 0).otherwise(1)).withColumn("span", F.sum("new").over(w))
    return rows.groupBy("record_type", "id", "version", "span").agg(F.min("a").alias("span_start"), F.max("b").alias("span_end")).drop("span")


def shared_amounts(records: DataFrame, s: SharedSpans) -> DataFrame:
    """For each record with a text: record_type, id, n_chars, shared_chars, n_spans, longest_span; zeros if it shares nothing.
    An id with several texts is reported with the one that shares most (then the longest)."""
    spans = shared_stretches(s).withColumn("n", F.col("span_end") - F.col("span_start"))
    sums = spans.groupBy("record_type", "id", "version").agg(F.sum("n").alias("shared_chars"), F.count("*").alias("n_spans"), F.max("n").alias("longest_span"))
    all_ = records.where("id IS NOT NULL AND owner IS NOT NULL AND text IS NOT NULL").select("record_type", "id", F.xxhash64("text").alias("version"), F.length("text").cast("long").alias("n_chars")).distinct()
    joined = all_.join(sums, ["record_type", "id", "version"], "left").fillna(0, ["shared_chars", "n_spans", "longest_span"])
    best = F.max(F.struct("shared_chars", "n_chars", "n_spans", "longest_span")).alias("x")
    return joined.groupBy("record_type", "id").agg(best).select("record_type", "id", "x.n_chars", "x.shared_chars", "x.n_spans", "x.longest_span")
