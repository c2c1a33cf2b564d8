"""SimHash fingerprints and near-duplicate groups found by pigeonring filtering.

A fingerprint bit is set if it is set in over half of the XXH64 values of a text's word shingles. If two fingerprints
of m ring segments differ in at most t bits, some segment starts a chain of consecutive segments whose cumulative
differences stay within l * t / m for every length l. For 64 bits, 4 segments and t = 3 the chain starts with an equal
segment, then at most 1 differing bit in two segments, at most 2 in three. ``ring_keys`` puts the first condition and part
of the second into a key of 28 bits (an equal segment, and three equal quarters of the next), so candidates meet only if
they can start a chain; inside a bucket the chain is followed segment by segment, a candidate is out as soon as a length
exceeds its budget, and only what is left after three segments gets the full Hamming check.

Buckets are searched for a spanning forest, not for all pairs: a search from each fingerprint looks only at those not yet
reached, so a dense group of near copies costs one pass. Components of all buckets are then joined.

Cases: a text with fewer words than a shingle is one shingle; one without words, or null, has fingerprint zero; repeated
rows share a fingerprint; a null id joins its group but is never its least id unless all are null; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.common import drop, parallelism, sheltered, spill, table
from loomgrid.llm.components import components, with_least

SEED = 42
SHINGLE = 3
MAX_BITS = 3
SEGMENTS = 4


def shingle_hashes(text: bytes, k: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the space-joined k-word shingles of the lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(n + 1) - 1
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], seed) for a, b in zip((end - n).tolist(), end[k - 1 :].tolist())), np.uint64, len(words) - k + 1)


def majority(h: np.ndarray) -> int:
    """The word whose bits are set in over half of the values."""
    if not len(h):
        return 0
    count = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):
            count += np.add.reduce(bits[b : b + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, k))


def fingerprints(df: DataFrame, text_col: str, keep: list[str], k: int = SHINGLE) -> DataFrame:
    """``keep`` columns plus f0, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.num_columns - 1)
            f = np.array([fingerprint(text[i].as_py() or b"", k) for i in range(b.num_rows)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(f)], names)

    rows = df.select(*keep, F.col(text_col).cast("binary").alias("__raw"))
    names = [*rows.columns[:-1], "f0"]
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, head + "f0 long")


def ring_keys(f: np.ndarray) -> np.ndarray:
    """16 keys of each 64-bit fingerprint (columns): an equal segment, and three of four quarters of the next."""
    seg = [(f >> np.uint64(16 * i)) & np.uint64(0xFFFF) for i in range(SEGMENTS)]
    keys = []
    for i in range(SEGMENTS):
        for q in range(4):
            rest = seg[(i + 1) % SEGMENTS] & np.uint64(0xFFFF ^ (0xF << 4 * q))
            keys.append(np.uint64(i * 4 + q) << np.uint64(32) | seg[i] << np.uint64(16) | rest)
    return np.stack(keys, 1)


def near(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which XORs of two fingerprints have at most MAX_BITS bits and a chain from segment ``start`` on within its budgets.

    The chain grows by one segment at a time over those still in it; the full Hamming distance comes last, for the rest.
    """
    left, total = np.arange(len(x)), np.zeros(len(x), np.int64)
    for n in range(1, SEGMENTS):
        shift = (16 * ((start[left] + (n - 1)) % SEGMENTS)).astype(np.uint64)
        total = total + np.bitwise_count((x[left] >> shift) & np.uint64(0xFFFF))
        ok = total * SEGMENTS <= n * MAX_BITS
        left, total = left[ok], total[ok]
    return left[np.bitwise_count(x[left]) <= MAX_BITS]


def starts_of(keys: np.ndarray) -> np.ndarray:
    """The segment at which the chains of a key of ``ring_keys`` start."""
    return (keys >> 32) // 4


def forest(start: int, f: np.ndarray) -> list[tuple[int, int]]:
    """Edges (member, root) that connect what is linked, directly or not, inside one bucket."""
    open_ = np.arange(len(f))
    edges = []
    while len(open_):
        root, open_ = open_[0], open_[1:]
        todo = [root]
        while todo and len(open_):
            hit = near(f[open_] ^ f[todo.pop()], np.full(len(open_), start))
            if len(hit):
                reached = open_[hit]
                edges += [(int(r), int(root)) for r in reached]
                todo += reached.tolist()
                open_ = np.delete(open_, hit)
    return edges


def bucket_edges(keys: np.ndarray, node: np.ndarray, f: np.ndarray) -> list[tuple[int, int]]:
    """Edges between nodes of whole buckets; ``keys`` is sorted."""
    out = []
    size = np.diff(np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)))
    start = np.cumsum(size) - size
    sizes, times = np.unique(size, return_counts=True)
    at_once = {n for n, t in zip(sizes.tolist(), times.tolist()) if 1 < n <= 4 or n <= 24 and t > 64}
    for n in at_once - {1}:  # the many small buckets, all at once
        first = start[size == n]
        for i in range(n):
            for j in range(i):
                p, q = first + i, first + j
                k = near(f[p] ^ f[q], starts_of(keys[p]))
                out += zip(node[p[k]].tolist(), node[q[k]].tolist())
    for a, n in zip(start.tolist(), size.tolist()):
        if n > 4 and n not in at_once:
            out += [(int(node[a + x]), int(node[a + y])) for x, y in forest(int(starts_of(keys[a])), f[a : a + n])]
    return out


def link(prints: DataFrame) -> DataFrame:
    """Edges (u, v) between node ids of ``prints`` (node long, f0 long) that share a key and are near.

    Rows are dealt by key and sorted, and a task reads them as a stream: it holds one bucket at a time.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                keys = ring_keys(part.column(1).to_numpy().view(np.uint64))
                n = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *(pa.array(np.repeat(part.column(i).to_numpy(), n)) for i in (0, 1))], ["key", "node", "f0"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last bucket so far, which may go on
        for b in batches:
            rows = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            if not len(rows):
                continue
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if cut or held and held[-1][-1, 0] != rows[0, 0]:
                yield from emit(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
        if held:
            yield from emit(np.concatenate(held))

    def emit(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            e = bucket_edges(rows[:, 0], rows[:, 1], np.ascontiguousarray(rows[:, 2]).view(np.uint64))
            if e:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in e], pa.int64()), pa.array([x[1] for x in e], pa.int64())], ["u", "v"])

    dealt = prints.select("node", "f0").mapInArrow(spread, "key long, node long, f0 long").repartition(parallelism(prints.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(search, "u long, v long")


def op3_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    docs = spill(fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"]), "prints")
    nodes = docs.groupBy(F.col("f0").alias("node")).agg(F.min("doc_id").alias("least"))
    prints = nodes.select("node", F.col("node").alias("f0"))
    comp = components(link(prints))
    rooted = nodes.join(comp, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    of_print = with_least(rooted, "root", "least", "component_id", docs.count()).select(F.col("node").alias("f0"), "component_id")
    return docs.join(of_print, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


# ---- groups of similar documents (the pipeline's stage) -------------------------------------------------------------------
#
# Two documents are linked if the Jaccard similarity of their distinct five-word shingles is at least 4 / 5; nothing is
# estimated. A radius of fingerprint bits that holds all such pairs would hold most others too, so the ring is laid over
# the shingle sets themselves, whose difference is exact.
#
# Screening: of n shingles, any partner shares o = ceil(4n / 5) or more. In one order of all shingles (their hashes), the
# first n - o + k of both hold at least k shared ones. So a document with fewer than k such shingles that occur in another
# document has no partner.
#
# Pigeonring: sets of s and at most s shingles that are similar differ in at most d = 2s / 9 of them. Hashing deals
# shingles over a ring of m = d + 1 segments, so some segment starts a chain in which every first l segments
# differ in at most l * d / m, that is l - 1, shingles: the first is equal, two differ in at most one, and so on.
# ``chain_keys`` follows every chain until it has CHAIN_LEAST shingles in common, and leaves out, in every way the budgets
# allow, shingles that a partner may lack; what is left is a key. Similar documents share a key, and those that share
# one passage hardly ever do, since a key says that its segments hold nothing else.
#
# Sharing a key joins documents into candidate groups; inside each, the exact similarity decides, in cells of bounded size.

STAGE_SHINGLE = 5
CHAIN_LEAST = 2  # shingles in common that end a chain
SHINGLE_MIX, SEGMENT_MIX, PLACE_MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))  # odd multipliers
CELL_SHINGLES = 1 << 22  # shingles of one block of a candidate group; a task holds two blocks


def least_shared(n: int) -> int:
    """Shingles that a set of n has in common with any set of similarity 4 / 5 or more."""
    return -(-4 * n // 5)


def least_in_prefix(n: int) -> int:
    return -(-n // 10)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, STAGE_SHINGLE))


def prefix(h: np.ndarray) -> np.ndarray:
    """Shingles of a sorted set that hold ``least_in_prefix`` of those it shares with any similar set of its size."""
    return h[: len(h) - least_shared(len(h)) + least_in_prefix(len(h))]


def size_class(n: int) -> int:
    """Sizes of one class differ by a factor of less than 3 / 2; ``class_end`` is the first size beyond."""
    j = 0
    while class_end(j) <= n:
        j += 1
    return j


@lru_cache(None)
def class_end(j: int) -> int:
    return 2 if j == 0 else max(class_end(j - 1) + 1, 3 * class_end(j - 1) // 2)


def mixed(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * by
    return x ^ x >> np.uint64(29)


def chain_keys(h: np.ndarray) -> np.ndarray:
    """Keys of a set of shingle hashes, one of which it shares with every set of similarity 4 / 5 or more."""
    n = len(h)
    if not n:
        return np.empty(0, np.uint64)
    value = mixed(h, SHINGLE_MIX)
    out = []
    for j in range(size_class(n), size_class(5 * n // 4) + 1):  # the classes of the larger set of a pair
        m = 2 * (class_end(j) - 1) // 9 + 1
        seg = ((mixed(h, SEGMENT_MIX) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        size = np.bincount(seg, minlength=m)
        end = np.cumsum(size)
        held = value[order]
        running = np.append(np.uint64(0), np.cumsum(held, dtype=np.uint64))
        sums = running[end] - running[end - size]
        full = np.flatnonzero((size >= CHAIN_LEAST) | (m == 1))
        at, total = [full], [sums[full]]
        more_at: list[int] = []
        more: list[int] = []
        for i in np.flatnonzero(size < CHAIN_LEAST).tolist() if m > 1 else ():
            grow(i, 1, int(size[i]), int(sums[i]), 0, m, held, end, size, more)
            more_at += [i] * (len(more) - len(more_at))
        at.append(np.array(more_at, np.int64))
        total.append(np.array([x & 0xFFFFFFFFFFFFFFFF for x in more], np.uint64))
        out.append(mixed(np.concatenate(total) + mixed(np.concatenate(at).astype(np.uint64) + np.uint64(j << 40), PLACE_MIX), SHINGLE_MIX))
    return np.unique(np.concatenate(out))


def grow(i: int, length: int, common: int, total: int, dropped: int, m: int, held: np.ndarray, end: np.ndarray, size: np.ndarray, out: list[int]) -> None:
    """Follows the chain from segment ``i``, of which ``length`` segments are taken; sums of what it keeps go to ``out``."""
    if common >= CHAIN_LEAST or length == m:
        out.append(total)
        return
    k = (i + length) % m
    own = held[end[k] - size[k] : end[k]].tolist()
    whole = sum(own)
    for less in range(min(len(own), length - dropped) + 1):  # length + 1 segments may differ in ``length`` shingles
        for gone in combinations(own, less):
            grow(i, length + 1, common + len(own) - less, total + whole - sum(gone), dropped + less, m, held, end, size, out)


def shingle_sets(df: DataFrame, text_col: str, keep: list[str], whole: bool) -> DataFrame:
    """``keep`` columns plus node (a hash of the set), n and the set's prefix; or plus the whole set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                b = batch.slice(a, 1024)
                text = b.column(b.num_columns - 1)
                sets = [shingle_set(text[i].as_py() or b"") for i in range(b.num_rows)]
                if whole:
                    more = [pa.array([h.tobytes() for h in sets], pa.binary())]
                else:
                    node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
                    first = [prefix(h).view(np.int64) for h in sets]
                    ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
                    more = [pa.array(node), pa.array([len(h) for h in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first) if first else np.empty(0, np.int64)))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names)

    rows = df.select(*keep, F.col(text_col).cast("binary").alias("__raw"))
    names = [*rows.columns[:-1], *(["shingles"] if whole else ["node", "n", "first"])]
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, head + ("shingles binary" if whole else "node long, n long, first array<long>"))


def _rows3(*cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["w", "key", "node"])


def prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """w, key, node from (node, first): shingles of one node of the batch (w = 1), one row for those of several (w = 2), and
    for each node the number of its shingles of the latter kind (w = 0: key is the node, node the number). So a shingle of a
    third of all documents gives one row per batch."""
    for b in batches:
        first = b.column(1)
        node = np.repeat(b.column(0).to_numpy(), first.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        rows = np.stack([first.flatten().to_numpy(zero_copy_only=False), node], 1)
        if not len(rows):
            continue
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(1))]
        start = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
        times = np.diff(np.append(start, len(rows)))
        yield _rows3(np.minimum(times, 2), rows[start, 0], rows[start, 1])
        known, n = np.unique(rows[np.repeat(times > 1, times), 1], return_counts=True)
        if len(known):
            yield _rows3(np.zeros(len(known)), known, n)


def shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, c: numbers, to be added up, of a node's shingles that other nodes have too; ``batches`` (w, key, node) are sorted by key.

    Of each key, only its first row and whether it is known to be shared stay in memory.
    """
    key, waiting, known = None, None, False  # the key at the end of the last batch, its only node so far, shared or not
    for b in batches:
        if not b.num_rows:
            continue
        w, k, v = (b.column(i).to_numpy() for i in range(3))
        ready = w == 0
        nodes, counts = [k[ready]], [v[ready]]
        w, k, v = w[~ready], k[~ready], v[~ready]
        if len(k):
            if waiting is not None and k[0] == key:
                w, k, v = np.append(1, w), np.append(key, k), np.append(waiting, v)
            start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            times = np.diff(np.append(start, len(k)))
            several = (np.maximum.reduceat(w, start) > 1) | (np.minimum.reduceat(v, start) != np.maximum.reduceat(v, start))
            several[0] |= known and k[0] == key
            waiting = None if several[-1] else v[-1]  # one node so far: it waits for the rest of the key
            known, key = bool(several[-1]), k[-1]
            hit = np.repeat(several, times) & (w == 1)
            nodes.append(v[hit])
            counts.append(np.ones(int(hit.sum()), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(counts).astype(np.int64))], ["node", "c"])


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """w, key, node from (node, shingles): the least node of each key of the batch (w = 1), and an edge from every other to it
    (w = 0: key is u, node v). So a key of a third of all documents gives one row per batch."""

    def emit() -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([k for k, _ in held]).view(np.int64)
        node = np.repeat(np.array([v for _, v in held], np.int64), [len(k) for k, _ in held])
        order = np.lexsort((node, keys))
        keys, node = keys[order], node[order]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        root = np.repeat(node[start], np.diff(np.append(start, len(keys))))
        edges = np.unique(np.stack([root, node], 1)[root != node], axis=0)
        yield _rows3(np.ones(len(start)), keys[start], node[start])
        if len(edges):
            yield _rows3(np.zeros(len(edges)), edges[:, 1], edges[:, 0])

    held: list[tuple[np.ndarray, int]] = []
    size = 0
    for b in batches:
        for i in range(b.num_rows):
            k = chain_keys(np.frombuffer(b.column(1)[i].as_buffer(), np.uint64))
            held.append((k, b.column(0)[i].as_py()))
            size += len(k)
            if size > 1 << 20:
                yield from emit()
                held, size = [], 0
    if size:
        yield from emit()


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v): those of ``key_rows``, and from each node of a key to the least; ``batches`` (w, key, node) are sorted by key, then node."""
    key, least = None, None
    for b in batches:
        w, k, v = (b.column(i).to_numpy() for i in range(3))
        ready = w == 0
        u_, v_ = [k[ready]], [v[ready]]
        k, v = k[~ready], v[~ready]
        if len(k):
            new = np.append(k[0] != key, k[1:] != k[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            root = np.where(at < 0, least if least is not None else 0, v[at])
            key, least = k[-1], root[-1]
            out = root != v
            u_.append(v[out])
            v_.append(root[out])
        if sum(map(len, u_)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u_)), pa.array(np.concatenate(v_))], ["u", "v"])


def similar(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges (member, root) that connect all sets linked by similarity, directly or not; each search looks at sets not yet reached."""
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    own = [token[e - n : e] for e, n in zip(ends.tolist(), size.tolist())]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    open_ = np.ones(len(sets), bool)
    left = listed = len(sets)
    edges = []
    for root in range(len(sets)):
        if not open_[root]:
            continue
        open_[root], todo = False, [root]
        left -= 1
        while todo and left:
            if left * 2 <= listed:
                live = open_[owner]
                token, owner, listed = token[live], owner[live], left
            one = todo.pop()
            a, b = np.searchsorted(token, own[one]), np.searchsorted(token, own[one], "right")
            n = b - a
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            hit = np.flatnonzero(open_ & (both > 0) & (9 * both >= 4 * (size + size[one])))
            edges += [(int(x), root) for x in hit]
            todo += hit.tolist()
            open_[hit] = False
            left -= len(hit)
    return edges


def cell_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of similar sets of one cell; ``batches`` (root, lo, hi, node, shingles) are sorted."""
    cell, nodes, sets = None, [], []

    def emit() -> Iterator[pa.RecordBatch]:
        e = similar(sets) if len(sets) > 1 else []
        if e:
            yield pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in e], pa.int64()), pa.array([nodes[y] for _, y in e], pa.int64())], ["u", "v"])

    for b in batches:
        root, lo, hi, node = (b.column(i).to_pylist() for i in range(4))
        for i in range(b.num_rows):
            if (root[i], lo[i], hi[i]) != cell:
                yield from emit()
                cell, nodes, sets = (root[i], lo[i], hi[i]), [], []
            if not nodes or nodes[-1] != node[i]:
                nodes.append(node[i])
                sets.append(np.frombuffer(b.column(4)[i].as_buffer(), np.uint64).copy())
    yield from emit()


def similar_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, id, group: documents linked, directly or not, by a similarity of their 5-word shingles of 0.8 or more. ``rid`` is a hash of id and text."""
    parts = parallelism(docs.sparkSession)
    rid = row_id(id_col, text_col)
    prints = spill(shingle_sets(docs.withColumn("__rid", rid), text_col, ["__rid", id_col], False), "sets")
    deal = lambda rows: rows.repartition(parts, "key").sortWithinPartitions("key", "node")
    counts = deal(prints.select("node", "first").mapInArrow(prefix_rows, "w long, key long, node long")).mapInArrow(shared_counts, "node long, c long").groupBy("node").agg(F.sum("c").alias("c"))
    nodes = prints.groupBy("node").agg(F.first("n").alias("n"), F.min("__rid").alias("__rid"))
    alive = spill(counts.join(nodes, "node").where(F.col("c") >= F.ceil(F.ceil(F.col("n") * 4 / 5) / 10)).select("node", "n", "__rid"), "alive")
    rows = spill(prints.select("__rid", id_col, "node"), "rows")
    drop(prints)
    texts = docs.select(rid.alias("__rid"), F.col(text_col).alias("__text")).join(alive.hint("merge"), "__rid").dropDuplicates(["__rid"])
    sets = spill(shingle_sets(texts, "__text", ["node", "n"], True), "alive-sets")
    comp = components(deal(sets.select("node", "shingles").mapInArrow(key_rows, "w long, key long, node long")).mapInArrow(stars, "u long, v long"))
    cand = spill(comp.join(sets.select("node", "n"), "node"), "candidates")
    blocks = cand.groupBy("root").agg(F.ceil(F.sum("n") / CELL_SHINGLES).cast("int").alias("b"))
    asked = sets.select("node", "shingles").join(cand.join(blocks, "root").select("node", "root", "b"), "node")
    own, other = F.pmod(F.col("node"), F.col("b")).cast("int"), F.col("o")
    copies = asked.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).select("root", F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi"), "node", "shingles")
    cells = copies.repartition(parts, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "node")
    linked = components(cells.mapInArrow(cell_edges, "u long, v long"))
    out = spill(rows.join(linked, "node", "left").select(F.col("__rid").alias("rid"), F.col(id_col).alias("id"), F.coalesce("root", "node").alias("group")), "groups")
    drop(alive, rows, sets, cand)
    return out


def row_id(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col), F.isnull(text_col))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one document of each group of similar documents: the one with the least id (nulls last)."""
    docs, back = sheltered(docs, (id_col, text_col))
    groups = similar_groups(docs, id_col, text_col)
    best = groups.groupBy("group").agg(F.min(F.struct(F.isnull("id").alias("no"), "id", "rid")).alias("b"))
    of_row = groups.groupBy("rid").agg(F.count("*").alias("n"))
    chosen = spill(best.select(F.col("b.rid").alias("rid")).join(of_row, "rid").select(F.col("rid").alias("__rid"), "n"), "chosen")
    drop(groups)
    rows = docs.withColumn("__rid", row_id(id_col, text_col))
    single = rows.join(chosen.where("n = 1").select("__rid").hint("merge"), "__rid", "left_semi")
    repeated = rows.join(chosen.where("n > 1").select("__rid").hint("merge"), "__rid", "left_semi").dropDuplicates(["__rid"])
    return back(single.unionByName(repeated))
