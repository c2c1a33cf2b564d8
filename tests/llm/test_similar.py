"""The pipeline's near-duplicate stage against the exact Jaccard similarity of distinct five-word shingles."""

import random

import numpy as np
import pytest

from loomgrid.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    """Single linkage at 0.8 by brute force: the least index of each group."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and 5 * len(a & b) >= 4 * len(a | b):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


def stage(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in simhash.keep_one(df).collect())


def say(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def edges_of_threshold(rnd):
    """Pairs just above and just below 0.8, of many sizes: a new tail takes the place of the last words."""
    out = []
    for n in (10, 14, 24, 50, 104, 304, 904):
        for _ in range(12):
            base, m = say(rnd, n), n - 4
            for cut in (m // 9, m // 9 + 1):
                out += [" ".join(base), " ".join(base[: n - cut] + say(rnd, cut))]
                base = say(rnd, n)
    return out


def test_every_pair_at_the_threshold_is_found_and_none_below(spark):
    texts = edges_of_threshold(random.Random(3))
    want = sorted(set(groups(texts)))
    assert len(texts) / 2 < len(want) < len(texts)
    assert stage(spark, texts) == want


@pytest.mark.parametrize("cell", [None, 700])
def test_dense_group_in_cells(spark, monkeypatch, cell):
    """A chain of edits of one text, in one cell and cut into many."""
    if cell:
        monkeypatch.setattr(simhash, "CELL_SHINGLES", cell)
    rnd = random.Random(4)
    base, texts = say(rnd, 60), []
    for _ in range(60):
        copy = list(base)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(60)] = f"w{rnd.randrange(10**6)}"
        texts.append(" ".join(copy))
        if rnd.random() < 0.2:
            base = copy
    assert stage(spark, texts) == sorted(set(groups(texts)))


def batches(rows, names, size):
    import pyarrow as pa

    return [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + size]], pa.int64()) for k in range(len(names))], names) for i in range(0, len(rows), size)]


def test_shared_counts_over_batch_borders():
    """Numbers of shingles that other nodes have too, whatever the batches before and after the exchange."""
    import pyarrow as pa
    from collections import Counter

    rnd = random.Random(5)
    docs = [(rnd.randrange(12), sorted(rnd.sample(range(40), 6))) for _ in range(40)]
    docs = [(n, next(f for m, f in docs if m == n)) for n, _ in docs]  # copies of a node have equal shingles
    owners = {}
    for n, f in docs:
        for k in f:
            owners.setdefault(k, set()).add(n)
    for before, after in ((1, 3), (5, 2), (40, 1), (7, 1000)):
        sent = []
        for i in range(0, len(docs), before):
            part = docs[i : i + before]
            b = pa.RecordBatch.from_arrays([pa.array([n for n, _ in part]), pa.array([f for _, f in part], pa.list_(pa.int64()))], ["node", "first"])
            sent += [r for x in simhash.prefix_rows(iter([b])) for r in zip(*(c.to_pylist() for c in x.columns))]
        sent.sort(key=lambda r: r[1:])
        got = Counter()
        for x in simhash.shared_counts(iter(batches(sent, ["w", "key", "node"], after))):
            for n, c in zip(*(c.to_pylist() for c in x.columns)):
                got[n] += c
        for n, f in docs:
            want = sum(len(owners[k]) > 1 for k in f)
            assert got[n] >= want and (got[n] > 0) == (want > 0)  # copies of a node in several batches may count twice


def test_stars_over_batch_borders():
    rows = [(1, 1, n) for n in (3, 5, 9)] + [(0, 2, 77)] + [(1, 4, 6)] + [(1, 5, 1), (1, 5, 6)]
    for size in (1, 2, 3, 100):
        got = [(u, v) for b in simhash.stars(iter(batches(rows, ["w", "key", "node"], size))) for u, v in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(got) == [(2, 77), (5, 3), (6, 1), (9, 3)]


def test_similar_sets_share_a_chain():
    """Pairs at exactly 0.8 and above, of all small and some large sizes: the ring loses none."""
    rnd = np.random.RandomState(2)
    for n in [*range(1, 60), 100, 333, 1200]:
        for _ in range(6 if n < 400 else 1):
            both = -(-4 * n // 5)
            cut = rnd.randint(0, n - both + 1)
            h = rnd.randint(0, 2**63, 2 * n).astype(np.uint64)
            x = h[:n]
            spare = 5 * (n - cut) // 4 - n  # shingles that the other may have besides, for a similarity of 0.8
            y = np.append(x[cut:], h[n : n + max(0, spare)])
            x, y = np.unique(x), np.unique(y)
            common = len(np.intersect1d(x, y))
            assert 5 * common >= 4 * (len(x) + len(y) - common)
            assert len(np.intersect1d(simhash.chain_keys(x), simhash.chain_keys(y))), n


def test_a_shared_passage_is_no_chain():
    """Sets that have a tenth in common hardly ever share a key."""
    rnd = np.random.RandomState(3)
    part = rnd.randint(0, 2**63, 20).astype(np.uint64)
    keys = [set(simhash.chain_keys(np.unique(np.append(part, rnd.randint(0, 2**63, 180).astype(np.uint64)))).tolist()) for _ in range(40)]
    assert sum(bool(a & b) for i, a in enumerate(keys) for b in keys[:i]) <= 8


def test_prefix_rule():
    for n in range(1, 400):
        h = np.arange(n)
        assert len(simhash.prefix(h)) <= n and simhash.least_shared(n) >= 0.8 * n


def test_one_repeated_line_does_not_link_different_documents(spark):
    """Most of their words are one line, repeated; their distinct shingles share next to nothing."""
    rnd = random.Random(6)
    line = say(rnd, 12)
    assert stage(spark, [" ".join(say(rnd, 300) + line * 60) for _ in range(2)]) == [0, 1]
