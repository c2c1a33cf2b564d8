"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, read by its task as a stream; each round is written to the shared folder, and
no task or driver ever holds a component. The minimum of a node is taken over HUB_PARTS parts of its neighbours and comes
back to each of them, so that the edges of a node with very many neighbours are dealt over as many tasks. Rounds end when
the edges no longer change (about log n rounds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import drop, spill

HUB_PARTS = 32  # parts that the neighbours of a node are dealt over
HOT_SHARE = 2_000  # a group of over 1 / HOT_SHARE of all rows is hot, so fewer than HOT_SHARE groups are broadcast
HOT_LEAST = 1_000  # rows of a group that are never hot


def with_least(rows: DataFrame, key: str, value: str, name: str, total: int) -> DataFrame:
    """``rows`` plus ``name``, the least ``value`` of their ``key``'s rows; ``total`` bounds the number of rows.

    Keys are not null; a group of null values only has a null least. The minimum is pre-aggregated in each task. It comes back to hot groups by a broadcast of fewer than HOT_SHARE rows, so
    their rows stay where they are, and to the others by a join on the key.
    """
    got = rows.groupBy(key).agg(F.min(value).alias(name), F.count("*").alias("__k"))
    hot = F.col("__k") > max(HOT_LEAST, total // HOT_SHARE)
    marked = rows.join(F.broadcast(got.where(hot).select(key, name, F.lit(True).alias("__hot"))), key, "left")
    near = marked.where("__hot").drop("__hot")
    far = marked.where("__hot IS NULL").drop("__hot", name).join(got.where(~hot).select(key, name), key)
    return near.unionByName(far)


def _part():
    return F.pmod(F.xxhash64("v"), F.lit(HUB_PARTS)).cast("int")


def _least(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, s, m) for every part of the neighbours of u, and (u, m): m is the least neighbour of u."""
    own = rows.groupBy("u", _part().alias("s")).agg(F.min("v").alias("p"))
    of_node = own.groupBy("u").agg(F.min("p").alias("m"))
    return own.select("u", "s").join(of_node, "u"), of_node


def _large(e: DataFrame) -> DataFrame:
    """Larger neighbours of u move to the least neighbour of u."""
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least, _ = _least(both)
    moved = both.where("v > u").withColumn("s", _part()).join(least, ["u", "s"])
    return moved.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Smaller neighbours of u, and u, move to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least, of_node = _least(down)
    moved = down.withColumn("s", _part()).join(least, ["u", "s"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(of_node.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long): root is the least node of its component."""
    mark = lambda x: x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    cur = spill(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = mark(cur)
    while state[0]:
        nxt = spill(_small(_large(cur)), "edges")
        new = mark(nxt)
        # equal marks only suggest that nothing has changed; the edges themselves prove it
        done = new == state and nxt.join(cur, ["u", "v"], "left_anti").isEmpty()
        drop(cur)
        cur, state = nxt, new
        if done:
            break
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.unionAll(out.select(F.col("root").alias("node"), "root").distinct())
