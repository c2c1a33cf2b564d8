"""Hierarchical multi-length packing of tokenised documents; texts and ids are never shuffled.

Every task packs the documents of its own input partition. Whole windows of the longest tier are cut off a document
first; its rest goes to the smallest context-size tier that holds it. Tiers are packed from the longest down: a sequence
opens with the largest rest of its tier, its gap is filled with whole rests of the same or shorter tiers (largest
fit), and what no whole rest fits is filled with a cut of one. So only the last sequence of a task can be short; it is
split at powers of two, which need no padding. Sequences of one length form step groups of STEP_TOKENS tokens: they are
numbered over all tasks, from the number of each task's sequences of that length, so of every length all groups but the
last are full and a training step can take any of them.

Cases: a null or empty text is one end token; null and repeated ids are packed like others (a piece belongs to its row);
a text of any length is cut as needed; an empty table gives no sequences; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.llm.bpe import codec, tokenizer_path
from loomgrid.llm.common import spill, table

TIERS = (256, 512, 1024)
STEP_TOKENS = 32_768
WINDOW_TOKENS = 1 << 19  # tokens that wait in a task before they are packed: bounds its memory
END_ID = 0


@dataclass(frozen=True, slots=True)
class Rest:
    """Tokens start..end of one document."""

    doc: int
    start: int
    end: int

    def __len__(self) -> int:
        return self.end - self.start


class Pools:
    """Waiting rests by tier, each tier ordered by length."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.by = {t: [] for t in tiers}

    def add(self, r: Rest) -> None:
        insort(self.by[next(t for t in self.tiers if len(r) <= t)], r, key=len)

    def largest_fit(self, gap: int, tier: int) -> Rest | None:
        for t in reversed([t for t in self.tiers if t <= tier]):
            if k := bisect_right(self.by[t], gap, key=len):
                return self.by[t].pop(k - 1)
        return None

    def to_cut(self, tier: int) -> Rest | None:
        """The longest rest of the shortest tier that has one, up to the given tier."""
        return next((self.by[t].pop() for t in self.tiers if t <= tier and self.by[t]), None)


class Packer:
    """Packs rests; ``emit(tier, rests)`` is called for each finished sequence."""

    def __init__(self, emit, tiers: tuple[int, ...] = TIERS):
        self.emit, self.tiers, self.pools = emit, tuple(sorted(tiers)), Pools(tuple(sorted(tiers)))

    def add(self, doc: int, n: int) -> None:
        top, at = self.tiers[-1], 0
        while n - at >= top:
            self.emit(top, [Rest(doc, at, at + top)])
            at += top
        if at < n:
            self.pools.add(Rest(doc, at, n))

    def pack(self) -> None:
        """Packs what waits; the rests of the one sequence that stays short wait again."""
        for tier in reversed(self.tiers):
            while self.pools.by[tier]:
                seq, gap = [], tier
                while gap:
                    r = self.pools.largest_fit(gap, tier)
                    if r is None and (r := self.pools.to_cut(tier)) is not None:
                        self.pools.add(Rest(r.doc, r.start + gap, r.end))
                        r = Rest(r.doc, r.start, r.start + gap)
                    if r is None:
                        break
                    seq.append(r)
                    gap -= len(r)
                if gap:
                    for r in seq:
                        self.pools.add(r)
                    return
                self.emit(tier, seq)

    def finish(self) -> None:
        """The last short sequence, split at powers of two."""
        self.pack()
        left = [r for t in reversed(self.tiers) for r in self.pools.by[t]]
        self.pools = Pools(self.tiers)
        total = sum(map(len, left))
        while total:
            size = 1 << total.bit_length() - 1
            seq, gap = [], size
            while gap:
                r = left.pop(0)
                if len(r) > gap:
                    left.insert(0, Rest(r.doc, r.start + gap, r.end))
                    r = Rest(r.doc, r.start, r.start + gap)
                seq.append(r)
                gap -= len(r)
            self.emit(size, seq)
            total -= size


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
PLACED = SCHEMA.replace("step_group long", "__task int, __k long")


def pack(docs: DataFrame, id_col: str, text_col: str, path: str | None = None, tiers: tuple[int, ...] = TIERS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with SCHEMA, and their ``ids`` if asked for."""
    path = path or tokenizer_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, task = codec(path), TaskContext.get().partitionId()
        held: dict[int, list] = {}  # document number in this task: id, ids, tokens not yet emitted
        out: list[tuple] = []
        n_seq, filled, waiting, id_type = 0, defaultdict(int), 0, pa.int64()

        def emit(tier: int, seq: list[Rest]) -> None:
            nonlocal n_seq
            k = filled[tier]
            filled[tier] += 1
            at = 0
            for r in seq:
                doc = held[r.doc]
                ids = doc[1][r.start : r.end]
                out.append((doc[0], r.start, len(r), zlib.crc32(ids.tobytes()), len(doc[1]), (task << 32) + n_seq, at, tier, task, k, *([ids.tolist()] if with_ids else [])))
                at += len(r)
                doc[2] -= len(r)
                if not doc[2]:
                    del held[r.doc]
            n_seq += 1

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal out
            if len(out) > least:
                cols = list(zip(*out))
                kinds = [id_type, *[pa.int64()] * 6, pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names)
                out = []

        packer, doc = Packer(emit, tiers), 0
        for b in batches:
            id_type = b.column(0).type
            for i in range(b.num_rows):
                ids = np.append(c.encode(b.column(1)[i].as_py() or ""), np.uint32(END_ID)).astype("<u4")
                held[doc] = [b.column(0)[i].as_py(), ids, len(ids)]
                packer.add(doc, len(ids))
                waiting += len(ids) % packer.tiers[-1]
                doc += 1
                if waiting >= WINDOW_TOKENS:
                    packer.pack()
                    waiting = 0
                    yield from flush(5_000)
        packer.finish()
        yield from flush(0)

    names = ["__doc", *(x.split()[0] for x in PLACED.split(", ")), *(["ids"] if with_ids else [])]
    pieces = spill(docs.select(id_col, text_col).mapInArrow(run, f"__doc {kind}, {PLACED}" + ", ids array<long>" * with_ids), "pieces")
    before = Window.partitionBy("tier").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of each length
    counts = pieces.where("offset = 0").groupBy("tier", "__task").agg(F.count("*").alias("__n"))
    starts = counts.select("tier", "__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    group = F.shiftleft(F.col("tier").cast("long"), 40) + F.floor((F.col("__start") + F.col("__k")) * F.col("tier") / STEP_TOKENS).cast("long")
    out = pieces.join(starts, ["tier", "__task"]).withColumn("step_group", group)
    return out.select(F.col("__doc").alias(id_col), *(x.split()[0] for x in SCHEMA.split(", ")), *(["ids"] if with_ids else []))


def op4_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text")
