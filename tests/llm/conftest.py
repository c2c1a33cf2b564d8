import os
import random
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def make_documents() -> pa.Table:
    """Nulls in every column, empty, wordless and very long texts, copies, near copies, shared passages, repeated rows, clashing columns."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefgehiäßé") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage = say(60)
    texts = [None, "", " \t\n", "!!! 123 ...", "a", "One two", "Zero\0byte " * 40, "a" * 3000, "日本語の文章です。" * 60, "<|endoftext|> x <|endoftext|>", "x" * 199, "y" * 200]
    texts += [say(rnd.randint(20, 300)) for _ in range(25)]
    base = say(120).split()
    for _ in range(6):
        copy = list(base)
        copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
        texts.append(" ".join(copy))
    texts += [texts[20], texts[20].upper(), texts[21] + "\n", say(30) + " " + passage + " " + say(20), passage + " " + say(40), passage, say(8000)]
    n = len(texts)
    ids = list(range(n))
    ids[3] = None
    lang = [rnd.choice(["en", "de", "fr", "es", None]) for _ in range(n)]
    rows = {"doc_id": [*ids, 15, None], "text": [*texts, texts[15], "null id"], "lang": [*lang, lang[15], None], "source": ["s"] * n + [None, None], "n_chars": [len(t or "") for t in texts] + [len(texts[15]), None]}
    extra = {"shard": [1] * (n + 2), "score": ["x"] * (n + 2), "node": [1.5] * (n + 2), "tid": [b"t"] * (n + 2), "pos": [None] * (n + 2)}
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("shard", pa.int32()), ("score", pa.string()), ("node", pa.float64()), ("tid", pa.binary()), ("pos", pa.int32())])
    return pa.table(rows | extra, schema=schema)


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    d = tmp_path_factory.mktemp("small")
    t = make_documents()
    pq.write_table(t, d / "documents.parquet", row_group_size=20)
    return str(d)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    pq.write_table(make_documents().slice(0, 0), d / "documents.parquet")
    pq.write_table(pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string())}), d / "pages.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32()))}), d / "embeddings.parquet")
    return str(d)


@pytest.fixture(scope="session")
def docs(small):
    return pq.read_table(f"{small}/documents.parquet").to_pylist()
