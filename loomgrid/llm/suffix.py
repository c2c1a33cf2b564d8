"""Exact removal of repeated passages by a distributed, common-prefix-aware merge sort of suffixes.

A start p is repeated if the ``length`` bytes from p on also start anywhere else; every byte that a repeated start covers
is removed. Only suffixes at content-defined anchors are sorted: the anchor of p is the position with the least hash
of 32 bytes among the first starts of its window, so equal windows have equal anchors at equal offsets.

1. Equal texts become one text with a count (every byte of a repeated text is repeated).
2. Anchors whose next ``Shape.prefix`` bytes occur only once (by a hash, so some more may stay in) are left out: no other
   suffix shares what a repeat would need.
3. Each task sorts the suffixes of its anchors into runs. Runs are cut at common splitters, front-coded (prefix shared
   with the string before, then the rest) and exchanged; the bytes to the left of an anchor travel with its suffix.
4. Each range is merged by a loser tree whose comparisons start behind the known common prefix, which also yields the
   common prefix of all neighbours in the merged order.
5. The start at offset o before an anchor is repeated if another suffix shares ``length - o`` bytes, which the common
   prefixes tell, and the o bytes to its left, which are compared byte by byte, from right to left, among those not yet told apart.

Nothing is capped, and no hash decides a match. The number of ranges follows from the bytes of the suffixes that are left
after step 2, RANGE_BYTES each, and splitters from all of them; suffixes whose first eight bytes alone would fill several
ranges are dealt over as many by the hash of their next ``Shape.prefix`` bytes, which all partners share. So a task holds
one run, one range or one text, whatever the size of the input; only suffixes that agree in all those bytes must meet,
and of these equal ones of one run are one entry.

Cases: null and empty texts have nothing to remove; texts shorter than ``length`` never match; repeated rows are equal
texts; text of one repeated byte makes every position an anchor and stays exact; extra columns are ignored or kept.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import at_exit, drop, parallelism, shared_dir, sheltered, spill, table

LENGTH = 200
GRAM = 32
CHUNK = 1 << 19  # starts of one text that are handled at a time
RUN_BYTES = 16 << 20  # suffix bytes that a task sorts at a time
RANGE_BYTES = 32 << 20  # suffix bytes that a task merges at a time
MERGE_TASKS = 10_000  # a task merges its ranges one after the other
MAX_ACCURACY = 1_000_000  # of the splitters, which only balance the ranges
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
POWER = {k: np.uint64(pow(int(BASE), k, 1 << 64)) for k in (1, 2, 4, 8, 16, 32, 64)}


class Shape:
    """The lengths that follow from the length of a match."""

    def __init__(self, length: int):
        if length < 2 * GRAM:
            raise ValueError(f"length must be at least {2 * GRAM}")
        self.length = length
        self.prefix = max(min(96, length // 2), length - 250)  # bytes after an anchor that any repeat shares; offsets fit a byte
        self.window = length - self.prefix + 1  # starts an anchor is chosen from, and so possible offsets
        self.row = length + self.window - 1 + 2  # suffix, left bytes, least and largest offset


def as_bytes(text: bytes) -> np.ndarray:
    """Byte values; zero becomes 255, which UTF-8 never uses, so that zero can mark ends."""
    t = np.frombuffer(text, np.uint8)
    return np.where(t == 0, np.uint8(255), t) if b"\0" in text else t


def anchors_of_starts(t: np.ndarray, a: int, b: int, s: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each start in [a, b), and the 32-byte hashes from a on."""
    h = t[a : b + s.length - 1].astype(np.uint64) + np.uint64(1)
    for k in (1, 2, 4, 8, 16):
        h = h[:-k] * POWER[k] + h[k:]
    n = b - a + s.window - 1
    packed = (h[:n] * MIX) & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
    k = 1
    while 2 * k <= s.window:
        packed = np.minimum(packed[:-k], packed[k:])
        k *= 2
    if k < s.window:
        packed = np.minimum(packed[: -(s.window - k)], packed[s.window - k :])
    return (packed & np.uint64(0xFFFFFFFF)).astype(np.int64) + a, h


def chunks(n: int, s: Shape) -> Iterator[tuple[int, int]]:
    starts = n - s.length + 1
    for a in range(0, max(starts, 0), CHUNK):
        yield a, min(a + CHUNK, starts)


def anchors(t: np.ndarray, s: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text with the least and largest offset of their starts (in one number), a hash of the ``prefix``
    bytes from each on, and its first eight bytes as an ordered number. An anchor can come twice, at a chunk's border,
    for different offsets."""
    pos, span, key = [], [], []
    for a, b in chunks(len(t), s):
        x, h = anchors_of_starts(t, a, b, s)
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        last = np.append(first[1:], len(x)) - 1
        x = x[first]
        i, g = x - a, np.zeros(len(x), np.uint64)
        for at in [*range(0, s.prefix - GRAM + 1, GRAM), s.prefix - GRAM]:
            g = (g ^ h[i + at]) * MIX
            g ^= g >> np.uint64(29)
        pos.append(x)
        span.append((i - last) | (i - first) << 16)
        key.append(g)
    if not pos:
        return (np.empty(0, np.int64),) * 4
    x = np.concatenate(pos)
    return x, np.concatenate(span), np.concatenate(key).view(np.int64), leading(np.stack([t[x + k] for k in range(8)], 1))


def leading(rows: np.ndarray) -> np.ndarray:
    """The first eight bytes of each row as an ordered number."""
    lead = np.zeros(len(rows), np.uint64)
    for k in range(8):
        lead = lead << np.uint64(8) | rows[:, k]
    return (lead >> np.uint64(1)).view(np.int64)


# ---- runs -------------------------------------------------------------------------------------------------------------

RUNS = "run long, rng int, n int, lcp binary, len binary, twice binary, tails binary, side binary, m_entry binary, m_pos binary, m_tid binary"


def rows_of(t: np.ndarray, x: np.ndarray, span: np.ndarray, s: Shape) -> np.ndarray:
    """One row of bytes for each anchor: its suffix, the bytes to its left from right to left, its offsets; 0 fills."""
    lo, hi = span & 0xFFFF, span >> 16
    right = x[:, None] + np.arange(s.length)
    left = x[:, None] - 1 - np.arange(s.window - 1)
    out = np.zeros((len(x), s.row), np.uint8)
    out[:, : s.length] = np.where(right < len(t), t[np.minimum(right, len(t) - 1)], 0)
    out[:, s.length : -2] = np.where(np.arange(s.window - 1) < hi[:, None], t[np.maximum(left, 0)], 0)
    out[:, -2], out[:, -1] = lo, hi
    return out


class Ranges:
    """Borders between ranges: values of ``leading``, in order. A value that is listed several times has as many ranges of its
    own, dealt by a hash."""

    def __init__(self, cut: list[int]):
        self.border, ways = np.unique(np.array(cut, np.int64), return_counts=True)
        self.ways = np.where(ways > 1, ways, 0)
        self.first = len(self.border) + 1 + np.cumsum(self.ways) - self.ways

    def of(self, lead: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """The range of each suffix; ``shared`` are the bytes that all its partners have too."""
        rng = np.searchsorted(self.border, lead, side="right")
        if self.ways.any():
            i = np.maximum(rng - 1, 0)
            own = np.flatnonzero((rng > 0) & (self.border[i] == lead) & (self.ways[i] > 0))
            key = np.zeros(len(own), np.uint64)
            for k in range(shared.shape[1]):
                key = (key ^ shared[own, k]) * MIX
                key ^= key >> np.uint64(29)
            rng[own] = self.first[i[own]] + (key % self.ways[i[own]].astype(np.uint64)).astype(np.int64)
        return rng


def make_run(mat: np.ndarray, length: np.ndarray, pos: np.ndarray, tid: np.ndarray, ranges: Ranges, s: Shape) -> Iterator[tuple]:
    """Sorts one run and cuts it into its ranges; equal rows become one entry with several members."""
    order = np.argsort(np.ascontiguousarray(mat).view(f"V{s.row}").ravel(), kind="stable")
    rng = ranges.of(leading(mat), mat[:, : s.prefix])[order]
    if ranges.ways.any():
        again = np.argsort(rng, kind="stable")
        order, rng = order[again], rng[again]
    mat, length, pos, tid = mat[order], length[order], pos[order], tid[order]
    differ = mat[1:] != mat[:-1]
    new = np.append(True, differ.any(1))
    lcp = np.append(0, np.where(differ[:, : s.length].any(1), differ[:, : s.length].argmax(1), s.length))
    entry = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(mat)))
    mat, length, lcp, rng = mat[first], length[first], np.minimum(lcp[first], length[first]), rng[first]
    cuts = np.append(np.flatnonzero(np.append(True, rng[1:] != rng[:-1])), len(rng))
    col = np.arange(s.length)
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = lcp[a:b].copy()
        own[0] = 0
        tails = mat[a:b, : s.length][(col >= own[:, None]) & (col < length[a:b, None])].tobytes()
        m = slice(np.searchsorted(entry, a), np.searchsorted(entry, b))
        yield (
            int(rng[a]), int(b - a), own.astype("<u2").tobytes(), length[a:b].astype("<u2").tobytes(), (count[a:b] > 1).astype(np.uint8).tobytes(), tails,
            pack_side(mat[a:b, s.length :]), (entry[m] - a).astype("<u4").tobytes(), pos[m].astype("<u4").tobytes(), tid[m].tobytes(),
        )


def pack_side(side: np.ndarray) -> bytes:
    """Offsets of all entries, then only the left bytes that they need."""
    left = side[:, :-2][np.arange(side.shape[1] - 2) < side[:, -1:]]
    return side[:, -2:].tobytes() + left.tobytes()


def unpack_side(data: bytes, n: int, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((n, width + 2), np.uint8)
    out[:, -2:] = raw[: 2 * n].reshape(n, 2)
    out[:, :-2][np.arange(width) < out[:, -1:]] = raw[2 * n :]
    return out


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, of which ``at`` bytes are known."""
    while True:
        x, y = a[at : at + 32], b[at : at + 32]
        if x != y:
            k = min(len(x), len(y))
            if x[:k] == y[:k]:
                return at + k
            d = int.from_bytes(x[:k], "big") ^ int.from_bytes(y[:k], "big")
            return at + k - (d.bit_length() + 7) // 8
        if len(x) < 32:
            return at + len(x)
        at += 32


def decode_run(lcp: bytes, length: bytes, tails: bytes) -> Iterator[tuple[bytes, int]]:
    """Strings of a front-coded run, each with the prefix it shares with the one before."""
    s, at = b"", 0
    for h, n in zip(np.frombuffer(lcp, "<u2").tolist(), np.frombuffer(length, "<u2").tolist()):
        s = s[:h] + tails[at : at + n - h]
        at += n - h
        yield s, h


def merge_runs(runs: list[tuple[bytes, bytes, bytes]]) -> list[tuple[int, int]]:
    """Merges front-coded runs; for each string in order: its run, and the prefix it shares with the string before.

    A loser tree over the runs. Every stored string carries the length of the prefix it shares with the last string
    that left through its node, so strings with different lengths need no comparison at all, and strings with equal
    lengths are compared from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    streams = [decode_run(*r) for r in runs]
    head: list[bytes | None] = [None] * k
    known = [0] * k
    for i, st in enumerate(streams):
        head[i] = next(st, (None, 0))[0]
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows the prefix it shares with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = known[a], known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        h = common_prefix(x, y, p)
        if h == len(x) or h < len(y) and x[h] < y[h]:
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], loser[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    out = []
    while head[best] is not None:
        out.append((best, known[best]))
        head[best], known[best] = next(streams[best], (None, 0))
        node = (best + k) >> 1
        while node:
            x, y = head[best], head[other := loser[node]]
            if y is not None:
                p, q = known[best], known[other]
                if x is None or p < q:
                    best, loser[node] = other, best
                elif p == q:
                    h = common_prefix(x, y, p)
                    if h == len(x) or h < len(y) and x[h] < y[h]:
                        known[other] = h
                    else:
                        known[best] = h
                        best, loser[node] = other, best
            node >>= 1
    return out


def repeated_offsets(runs: list[tuple[bytes, bytes, bytes, bytes, bytes]], s: Shape) -> list[np.ndarray]:
    """For each entry of each run, the offsets before its anchor that start a repeat, as packed bits."""
    merged = merge_runs([r[:3] for r in runs])
    perm = np.argsort(np.array([m[0] for m in merged], np.int64), kind="stable")  # where the entries of run 0, 1, ... went
    shared = np.array([m[1] for m in merged], np.int64)
    n = len(merged)
    side, twice = np.empty((n, s.row - s.length), np.uint8), np.empty(n, bool)
    twice[perm] = np.concatenate([np.frombuffer(r[3], np.uint8) for r in runs]) > 0
    side[perm] = np.concatenate([unpack_side(r[4], len(r[3]), s.window - 1) for r in runs])
    lo, hi = side[:, -2], side[:, -1]
    offset = np.arange(s.window)
    bits = twice[:, None] & (lo[:, None] <= offset) & (offset <= hi[:, None])  # several members: a repeat at every offset
    left, same_left = np.arange(n), np.zeros(n, np.int64)  # entries that may still have a partner; equal numbers: the same bytes to the left
    for o in range(s.window):
        if o:
            stay = hi[left] >= o
            left, same_left = left[stay], same_left[stay]
            _, same_left, times = np.unique(same_left * 256 + side[left, o - 1], return_inverse=True, return_counts=True)
            stay = times[same_left] > 1
            left, same_left = left[stay], same_left[stay]
        if not len(left):
            break
        now = lo[left] <= o
        at = left[now]
        same_right = np.cumsum(shared < s.length - o)[at]
        key = same_left[now] * (n + 1) + same_right
        order = np.argsort(key)
        eq = key[order][1:] == key[order][:-1]
        bits[at[order[1:][eq]], o] = True
        bits[at[order[:-1][eq]], o] = True
    packed = np.packbits(bits, axis=1)[perm]
    return np.split(packed, np.cumsum([len(r[3]) for r in runs])[:-1])


# ---- the whole plan -----------------------------------------------------------------------------------------------------


def text_key(text: Column) -> Column:
    """16 bytes of SHA-256: the identity of a text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def distinct_texts(rows: DataFrame, n: int) -> DataFrame:
    """(tid, text, copies, n) as a table bucketed by tid, so that later joins with it never move the texts again."""
    spark = rows.sparkSession
    one = rows.groupBy("tid").agg(F.first("text").alias("text"), F.count("*").alias("copies")).withColumn("n", F.octet_length("text"))
    name = f"loomgrid_texts_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    one.write.bucketBy(n, "tid").option("path", path).option("compression", "zstd").saveAsTable(name)
    at_exit(spark, path)
    out = spark.table(name)
    out._spill_path = path
    return out


def _binary(b: pa.RecordBatch, i: int) -> pa.Array:
    return b.column(i).cast(pa.binary())


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """tid, starts array<int>, ends array<int>: the maximal removed runs of each text of ``distinct_texts``."""
    s = Shape(length)
    spark = texts.sparkSession
    n_parts = parallelism(spark)

    # One anchor per hash and batch stands for the others of its batch, which are known to be repeated (w = 2) and are
    # dealt by a salt; so a hash that fills a third of all rows meets in one task only once per batch.
    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = np.random.default_rng(1)
        for b in batches:
            text, held, size = _binary(b, 1), [], 0
            for i in range(b.num_rows):
                x, span, h, lead = anchors(as_bytes(text[i].as_py()), s)
                held.append((h, np.full(len(x), np.void(b.column(0)[i].as_py())), x.astype(np.int32), span.astype(np.int32), lead))
                size += len(x)
                if size > 100_000 or i == b.num_rows - 1:
                    h, tid, x, span, lead = (np.concatenate(c) for c in zip(*held))
                    _, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                    salt = spread.integers(1, 1 << 31, len(h), dtype=np.int32)
                    salt[first] = 0
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(salt), pa.array(np.minimum(n, 2)[back].astype(np.int32)), ids16(tid.tobytes()), pa.array(x), pa.array(span), pa.array(lead)], ["h", "salt", "w", "tid", "pos", "span", "lead"])
                    held, size = [], 0

    found = texts.select("tid", "text").mapInArrow(find_anchors, "h long, salt int, w int, tid binary, pos int, span int, lead long")
    of_hash = Window.partitionBy("h", "salt")
    shared = found.withColumn("c", F.sum("w").over(of_hash)).where("c > 1").select("tid", "pos", "span", "lead")
    anchor = F.struct("pos", "span", "lead")
    per_text = spill(shared.groupBy("tid").agg(F.sort_array(F.collect_list(anchor)).alias("a")).select("tid", *[F.col(f"a.{c}").alias(c) for c in ("pos", "span", "lead")]), "anchors")

    n_ranges = max(n_parts, -(-(per_text.agg(F.sum(F.size("pos"))).first()[0] or 0) * s.row // RANGE_BYTES))
    q = [k / n_ranges for k in range(1, n_ranges)]
    cut = per_text.select(F.explode("lead").alias("lead")).agg(F.percentile_approx("lead", F.array(*[F.lit(x) for x in q]), F.lit(max(1_000, min(20 * n_ranges, MAX_ACCURACY)))).alias("q")).first()["q"] if q else None
    ranges = Ranges(cut or [])
    step = max(1, RUN_BYTES // s.row)

    def build_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n_run, task = [], 0, 0, TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, n_run
            if held:
                rows = [((task << 24) + n_run, *r) for r in make_run(*(np.concatenate(c) for c in zip(*held)), ranges, s)]
                n_run, held, size = n_run + 1, [], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 8)], [x.split()[0] for x in RUNS.split(", ")])

        for b in batches:
            text = _binary(b, 1)
            for i in range(b.num_rows):
                t = as_bytes(text[i].as_py())
                pos, span = (b.column(k)[i].values.to_numpy().astype(np.int64) for k in (2, 3))
                for a in range(0, len(pos), step):
                    x = pos[a : a + step]
                    held.append((rows_of(t, x, span[a : a + step], s), np.minimum(len(t) - x, s.length), x, np.full(len(x), np.void(b.column(0)[i].as_py()))))
                    size += len(x) * s.row
                    if size >= RUN_BYTES:
                        yield from flush()
        yield from flush()

    runs = spill(texts.select("tid", "text").join(per_text.drop("lead"), "tid").mapInArrow(build_runs, RUNS), "runs")

    def merge(t: pa.Table) -> pa.Table:
        found = repeated_offsets(list(zip(*(t[c].to_pylist() for c in ("lcp", "len", "tails", "twice", "side")))), s)
        return pa.table({"run": t["run"], "rng": t["rng"], "mask": pa.array([x.tobytes() for x in found], pa.binary())})

    masks = runs.select("run", "rng", "lcp", "len", "tails", "twice", "side").repartition(min(n_ranges, max(n_parts, MERGE_TASKS)), "rng").groupBy("rng").applyInArrow(merge, "run long, rng int, mask binary")
    width = (s.window + 7) // 8

    def to_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for e, p, t, m in zip(*(b.column(k).to_pylist() for k in range(4))):
                mask = np.frombuffer(m, np.uint8).reshape(-1, width)[np.frombuffer(e, "<u4")]
                some = mask.any(1)
                tid = np.frombuffer(t, "V16")[some]
                flat = pa.Array.from_buffers(pa.binary(width), len(tid), [None, pa.py_buffer(mask[some].tobytes())])
                yield pa.RecordBatch.from_arrays([ids16(tid.tobytes()), pa.array(np.frombuffer(p, "<u4")[some].astype(np.int32)), flat.cast(pa.binary())], ["tid", "pos", "mask"])

    members = runs.select("run", "rng", "m_entry", "m_pos", "m_tid").join(masks, ["run", "rng"]).select("m_entry", "m_pos", "m_tid", "mask").mapInArrow(to_starts, "tid binary, pos int, mask binary")
    proofs = members.groupBy("tid").agg(F.collect_list(F.struct("pos", "mask")).alias("p")).select("tid", F.col("p.pos").alias("pos"), F.col("p.mask").alias("mask"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for copies, n, pos, mask in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
                if copies > 1:
                    rows.append(([0], [n]))
                elif pos:
                    bits = np.unpackbits(np.frombuffer(b"".join(mask), np.uint8).reshape(-1, width), axis=1)
                    at, o = np.nonzero(bits)
                    rows.append(covered(np.array(pos, np.int64)[at] - o, s.length))
                else:
                    rows.append(([], []))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.list_(pa.int32())) for c in (zip(*rows) if rows else ((), ())))], ["tid", "starts", "ends"])

    sized = texts.select("tid", "copies", "n")
    out = spill(sized.join(proofs, "tid", "left").select("tid", "copies", "n", "pos", "mask").mapInArrow(spans, "tid binary, starts array<int>, ends array<int>"), "spans")
    drop(per_text, runs)
    return out


def ids16(raw: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(raw) // 16, [None, pa.py_buffer(raw)]).cast(pa.binary())


def covered(starts: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Maximal runs of bytes covered by windows at ``starts``."""
    p = np.unique(starts)
    if not len(p):
        return [], []
    gap = np.flatnonzero(np.diff(p) > length)
    return p[np.append(0, gap + 1)].tolist(), (p[np.append(gap, len(p) - 1)] + length).tolist()


def keep_rest(raw: bytes, starts: list[int], ends: list[int]) -> bytes:
    at, parts = 0, []
    for a, b in zip(starts, ends):
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def clean_texts(docs: DataFrame, text_col: str, length: int = LENGTH, as_text: bool = False) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Keyed input rows (with ``__raw``, ``__n`` and ``__tid``), per distinct text tid: kept, n_removed, n_spans, and the
    written tables behind these, to be dropped after use.

    ``kept`` is binary, or with ``as_text`` a string without the characters that a cut has broken.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.withColumn("__raw", raw).withColumn("__n", F.octet_length("__raw").cast("long")).withColumn("__tid", text_key(F.col("__raw")))
    texts = distinct_texts(keyed.where(F.col("__n") >= length).select(F.col("__tid").alias("tid"), F.col("__raw").alias("text")), parallelism(docs.sparkSession))
    spans = repeated_spans(texts, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n_removed = [], []
            for i in range(b.num_rows):
                t = b.column(1)[i].as_py()
                k = keep_rest(t, b.column(2)[i].as_py() or [], b.column(3)[i].as_py() or [])
                kept.append(k.decode("utf-8", "ignore") if as_text else k)
                n_removed.append(len(t) - len(k))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(n_removed, pa.int64()), pa.array([len(x) if x else 0 for x in b.column(2).to_pylist()], pa.int64())], ["tid", "kept", "n_removed", "n_spans"])

    rest = texts.select("tid", "text").join(spans, "tid").select("tid", "text", "starts", "ends").mapInArrow(cut, f"tid binary, kept {'string' if as_text else 'binary'}, n_removed long, n_spans long")
    return keyed, rest, [texts, spans]


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed, rest, written = clean_texts(docs, "text")
    digest = rest.select(F.col("tid").alias("__tid"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    rows = keyed.select("doc_id", "__tid", F.col("__n").alias("n_bytes"), F.when(F.col("__n") < LENGTH, F.sha2("__raw", 256)).alias("__own"))
    out = spill(
        rows.join(digest, "__tid", "left").select(
            "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
            F.coalesce("kept_sha256", "__own").alias("kept_sha256"),
        ), "kept",
    )
    drop(*written)
    return out


def without_repeats(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The documents with repeated passages cut out of their texts; those of which nothing is left go."""
    docs, back = sheltered(docs, (text_col, size_col))
    keyed, rest, _ = clean_texts(docs, text_col, as_text=True)  # the result reads the written tables: they go at the end of the application
    short = F.col("__n") < LENGTH
    rows = keyed.select(*docs.columns, "__n", "__tid").withColumn(text_col, F.when(short, F.col(text_col)))
    cut = rest.select(F.col("tid").alias("__tid"), F.col("kept").alias("__kept"))
    out = rows.join(cut, "__tid", "left").withColumn(text_col, F.when(short, F.col(text_col)).otherwise(F.col("__kept"))).where(short | (F.col(text_col) != ""))
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.when(short, F.col(size_col)).otherwise(F.length(text_col)).cast(docs.schema[size_col].dataType))
    return back(out)


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Removed runs by definition, for tests and small inputs."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        hit = [p for p in range(len(t) - length + 1) if seen[t[p : p + length]] > 1]
        out.append(list(zip(*covered(np.array(hit, np.int64), length))))
    return out


def sha256(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()
