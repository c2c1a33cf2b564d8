"""Exact top-k search over binary codes by incremental multi-index hashing.

A code has one bit per component of its vector, in as many 64-bit words as that takes. A block of codes is indexed by m
segments. For a query, segments are searched at radius 0, 1, 2, ...: the values that differ from the query's segment in
exactly r bits are enumerated and looked up, or, where there are fewer values in the block than such neighbours, picked
from the segment's list of values. After segment j at radius r, every code within m * r + j bits has been met, so the
search ends as soon as the kth verified distance is no larger. Each block is searched exactly, and the k best of all
blocks are kept; ties go to the smaller id.

Cases: null vectors are neither queries nor answers; a vector shorter than the longest of the table is padded with zero
bits; null and NaN components count as not positive; a query does not find itself; rows that repeat an id are one row,
with the least code; equal codes are ordered by id and at most k + 1 rows of one code enter the index, which are all that
can be answers; fewer than k rows give fewer answers; empty tables give none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import drop, spill, table

K = 10
BLOCK = 262_144  # codes that one search task indexes; each query is sent to codes / BLOCK tasks
SLICE = 65_536  # queries that one search task answers; each code is sent to queries / SLICE tasks
QUERY_EVERY = 100
SEGMENT_BITS = 16  # at most: a segment's values index a table of 2 ** 16 places


def sign_codes(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, code (binary, little-endian 64-bit words of equal number in all rows): bit i is set if component i is positive."""
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    words = max(1, -(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // 64))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(1)
            n = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vec.flatten().fill_null(0).to_numpy(zero_copy_only=False) > 0
            row = np.repeat(np.arange(len(n)), n)
            bits = np.zeros((len(n), 64 * words), bool)
            bits[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
            raw = np.packbits(bits, axis=1, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.Array.from_buffers(pa.binary(8 * words), len(n), [None, pa.py_buffer(raw)]).cast(pa.binary())], ["id", "code"])

    return rows.mapInArrow(pack, "id long, code binary").groupBy("id").agg(F.min("code").alias("code"))


def as_words(codes: pa.ChunkedArray) -> np.ndarray:
    """Codes as rows of 64-bit words."""
    raw = codes.to_pylist()
    return np.frombuffer(b"".join(raw), "<u8").reshape(len(raw), -1)


@lru_cache(None)
def ball(width: int, r: int) -> np.ndarray:
    """All numbers of ``width`` bits of which r are set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), r)], np.int64)


class MultiIndex:
    """Segment tables of one block of codes."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.codes = ids[order], codes[order]
        bits = 64 * codes.shape[1]
        width = int(np.clip(np.log2(max(len(ids), 2)), 8, SEGMENT_BITS))
        self.m = -(-bits // width)
        self.cuts = np.linspace(0, bits, self.m + 1).astype(int).tolist()
        self.segments = []
        for j in range(self.m):
            value = self.segment(self.codes, j)
            by = np.argsort(value, kind="stable")
            places = np.zeros((1 << self.cuts[j + 1] - self.cuts[j]) + 1, np.int64)
            np.cumsum(np.bincount(value, minlength=len(places) - 1), out=places[1:])
            self.segments.append((places, by, np.unique(value)))
        self.seen, self.turn = np.zeros(len(ids), np.int32), 0  # the turn in which a code was last met
        self.verified = 0

    def segment(self, codes: np.ndarray, j: int) -> np.ndarray:
        lo, hi = self.cuts[j], self.cuts[j + 1]
        x = codes[:, lo // 64] >> np.uint64(lo % 64)
        if hi > (lo // 64 + 1) * 64:
            x = x | codes[:, lo // 64 + 1] << np.uint64(64 - lo % 64)
        return (x & np.uint64((1 << hi - lo) - 1)).astype(np.int64)

    def values_at(self, j: int, value: int, r: int) -> np.ndarray:
        """Values of segment j that differ from ``value`` in r bits: by enumeration, or from the block's list if that is shorter."""
        width, held = self.cuts[j + 1] - self.cuts[j], self.segments[j][2]
        if r > width:
            return np.empty(0, np.int64)
        n = 1
        for i in range(r):
            n = n * (width - i) // (i + 1)
        return ball(width, r) ^ value if n <= len(held) else held[np.bitwise_count(held ^ value) == r]

    def top_k(self, query_id: int, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        self.turn += 1
        own = [int(self.segment(code[None, :], j)[0]) for j in range(self.m)]
        rows, dist, met = np.empty(0, np.int64), np.empty(0, np.int64), 0
        for r in range(SEGMENT_BITS + 1):
            for j, (places, by, _) in enumerate(self.segments):
                v = self.values_at(j, own[j], r)
                n = places[v + 1] - places[v]
                v, n = v[n > 0], n[n > 0]
                if len(v):
                    new = by[np.repeat(places[v] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    new = new[self.seen[new] != self.turn]
                    self.seen[new] = self.turn
                    met += len(new)
                    new = new[self.ids[new] != query_id]
                    rows = np.concatenate([rows, new])
                    dist = np.concatenate([dist, np.bitwise_count(self.codes[new] ^ code).astype(np.int64).sum(1)])
                    if len(rows) > k:
                        best = np.lexsort((rows, dist))[:k]
                        rows, dist = rows[best], dist[best]
                if met == len(self.ids) or len(rows) >= k and dist.max() <= self.m * r + j:
                    break
            else:
                continue
            break
        self.verified += met
        best = np.lexsort((rows, dist))[:k]
        return self.ids[rows[best]], dist[best]


def search(codes: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """query_id, vec_id, distance, rank, for all queries (id, code) against all codes (id, code) of equal width."""
    same_code = Window.partitionBy("code").orderBy("id")
    pruned = spill(codes.withColumn("__n", F.row_number().over(same_code)).where(F.col("__n") <= k + 1).drop("__n"), "codes")
    queries = spill(queries, "queries")
    n_blocks = -(-max(1, pruned.count()) // block)
    n_slices = -(-max(1, queries.count()) // slice_)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = pruned.select("id", "code", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("b"), every(n_slices).alias("s"))
    asked = queries.select("id", "code", F.pmod(F.xxhash64("id"), F.lit(n_slices)).cast("int").alias("s"), every(n_blocks).alias("b"))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            mi = MultiIndex(left["id"].to_numpy(), as_words(left["code"]))
            for q, c in zip(right["id"].to_pylist(), as_words(right["code"])):
                ids, dist = mi.top_k(q, c, k)
                out[0] += [q] * len(ids)
                out[1] += ids.tolist()
                out[2] += dist.tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "distance": pa.array(out[2], pa.int32())})

    found = index.groupBy("b", "s").cogroup(asked.groupBy("b", "s")).applyInArrow(answer, "query_id long, vec_id long, distance int")
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    out = spill(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "answers")
    drop(pruned, queries)
    return out


def op9_incremental_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(codes, codes.where(F.col("id") % QUERY_EVERY == 0))


OP9_SQL = """
WITH bits AS (SELECT vec_id, unnest(embedding) > 0 AS on_, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE embedding IS NOT NULL),
codes AS (SELECT vec_id, CAST(sum(CASE WHEN on_ THEN CAST(pow(2, i) AS HUGEINT) ELSE 0 END) AS UBIGINT) AS code FROM bits GROUP BY vec_id),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT * FROM ranked WHERE rank <= 10
"""
