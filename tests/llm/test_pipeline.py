"""The stages against brute force on the small table of hard cases and on a test table."""

import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from loomgrid.llm import langid, suffix

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", params=["small", "table"])
def stages(request, spark, small, tmp_path_factory):
    d = small if request.param == "small" else SF
    out, docs = [spark.read.parquet(f"{d}/documents.parquet")], None
    folder = tmp_path_factory.mktemp("stages")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        docs = f(spark, out[-1], d)
        docs.write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns_and_language(stages):
    for df in stages[1:4]:
        assert df.columns == stages[0].columns
    key = lambda r: (r["doc_id"], r["text"])
    want = Counter(key(r) for r in rows(stages[0]) if r["text"] and langid.has_letter(r["text"]))
    assert Counter(key(r) for r in rows(stages[1])) == want


def test_near_duplicates(stages):
    """Single linkage by the exact similarity of five-word shingles: of every group the row with the least id stays."""
    before, after = rows(stages[1]), rows(stages[2])
    sets = []
    for r in before:
        w = (r["text"] or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    owners = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            owners[x].add(i)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in owners[x] if j < i)
        for j, c in common.items():
            if 5 * c >= 4 * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(before):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        best[find(i)] = min(best.get(find(i), key), key)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after) == sorted(best.values())
    assert not Counter((r["doc_id"], r["text"]) for r in after) - Counter((r["doc_id"], r["text"]) for r in before)


def test_repeated_passages(stages):
    before, after = rows(stages[2]), {(r["doc_id"], r["source"]): r for r in rows(stages[3])}
    texts = [(r["text"] or "").encode() for r in before]
    for r, t, sp in zip(before, texts, suffix.brute_force(texts)):
        kept = suffix.keep_rest(t, [a for a, _ in sp], [b for _, b in sp])
        got = after.get((r["doc_id"], r["source"]))
        if t and not kept:
            assert got is None or got["text"] != r["text"]
        elif got is not None and sum(x["doc_id"] == r["doc_id"] for x in before) == 1:
            assert got["text"] == kept.decode("utf-8", "ignore") and (not sp or got["n_chars"] == len(got["text"]))


def test_packing(stages):
    from tokenizers import Tokenizer

    from loomgrid.llm.bpe import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    docs, pieces = rows(stages[3]), rows(stages[4])
    want = sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs)
    assert sum(p["length"] for p in pieces) == want
    fill = defaultdict(int)
    for p in pieces:
        fill[p["sequence_id"]] += p["length"]
    assert max(fill.values()) <= 1024 and zlib.crc32(b"") == 0


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_keep_columns_with_clashing_names(spark):
    """Extra columns come through untouched, whatever their names, and change no decision."""
    extra = "tid kept node group key f0 n rid id root u v start copies __n __tid __kept __rid __raw __score __lang_pred __text __in_0 a.b".split()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wide = docs.select("*", *[F.lit("x").alias(c) for c in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, got = stage(spark, docs, ""), stage(spark, wide, "")
        assert got.columns == wide.columns, name
        rows = [tuple(r) for r in got.collect()]
        n = len(docs.columns)
        assert {r[n:] for r in rows} == {("x",) * len(extra)}, name
        assert sorted((r[:n] for r in rows), key=str) == sorted(map(tuple, plain.collect()), key=str), name
