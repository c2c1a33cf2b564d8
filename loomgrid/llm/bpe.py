"""Byte-level BPE encoding by tree concatenation, and decoding.

A long text is halved down to leaves, the leaves are encoded on a few threads, and neighbours are joined: a window
around the join is encoded again and grows until its first tokens agree with the left side and its last with the right
side. Agreement is exact in two cases, and only those are accepted:

- the window begins and ends at positions where the pre-tokenizer must split whatever stands beyond (a letter before
  a non-letter, or a digit before a non-digit), and its first and last tokens are those of the left and right side there; or
- the window lies within one run of letters or of digits, so within one pre-token. A sequence of BPE tokens is the
  encoding of its text if and only if each adjacent pair is the encoding of the pair's text, so one agreed token on
  either side proves the whole.

The vocabulary comes from a tokenizers file (a parameter); its byte-level ids are those the tokenizers library gives.

Cases: null is encoded as the empty text, which has no tokens; the special token's string in a text becomes its id, as
in the library; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomgrid.llm.common import table

# Fixed value: the pre-tokenizer pattern of byte-level BPE, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_CHARS = 16_384
THREADS = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """One vocabulary: encode and decode whole texts."""

    def __init__(self, path: str, leaf: int = LEAF_CHARS, threads: int = THREADS):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _byte_of_char()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._enc = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.bytes_of = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, i in [*ranks.items(), *((k.encode(), i) for k, i in special.items())]:
            self.bytes_of[i] = token
        self.length = np.array([len(x) for x in self.bytes_of], np.int64)
        self.leaf = leaf
        self._pool = ThreadPoolExecutor(threads) if threads > 1 else None

    def _base(self, text: str) -> np.ndarray:
        return np.array(self._enc.encode_ordinary(text), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text, as uint32."""
        for mark, i in self.special.items():  # special strings are cut out first, as the library does
            if mark in text:
                parts = [self._tree(p) for p in text.split(mark)]
                glue = np.array([i], np.uint32)
                return np.concatenate([x for p in parts for x in (p, glue)][:-1])
        return self._tree(text)

    def _tree(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return self._base(text)
        cuts = [0, len(text)]
        while max(b - a for a, b in zip(cuts, cuts[1:])) > self.leaf:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:]))})
        leaves = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        done = list(self._pool.map(self._base, leaves) if self._pool and len(leaves) > 4 else map(self._base, leaves))
        parts = [(a, b, x) for a, b, x in zip(cuts, cuts[1:], done)]
        while len(parts) > 1:
            parts = [self._join(text, *parts[i], *parts[i + 1][1:]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0][2]

    def _join(self, text: str, lo: int, mid: int, left: np.ndarray, hi: int, right: np.ndarray) -> tuple[int, int, np.ndarray]:
        """Encoding of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        span = 32
        while True:
            a0, b0 = max(lo, mid - span), min(hi, mid + span)
            a, b = _edge(text, a0, mid, lo, back=True), _edge(text, mid, b0, hi, back=False)
            a, b = lo if a0 == lo else a, hi if b0 == hi else b
            if a is not None and b is not None:
                if a == lo and b == hi:
                    return lo, hi, self._base(text[lo:hi])  # the window has grown to both whole sides
                cut_l = self._before(left, len(text[a:mid].encode()))
                cut_r = self._after(right, len(text[mid:b].encode()))
                if cut_l is not None and cut_r is not None:
                    mine = self._base(text[a:b])
                    if (a == lo or mine[0] == left[cut_l]) and (b == hi or mine[-1] == right[cut_r - 1]):
                        return lo, hi, np.concatenate([left[:cut_l], mine, right[cut_r:]])
            elif (out := self._within(text, a0, mid, b0, left, right)) is not None:
                return lo, hi, out
            span *= 2

    def _before(self, left: np.ndarray, tail: int) -> int | None:
        """Number of left tokens before its last ``tail`` bytes, if a token starts there."""
        if tail == 0:
            return len(left)
        back = np.cumsum(self.length[left[::-1][: tail + 1]])
        k = int(np.searchsorted(back, tail))
        return len(left) - k - 1 if k < len(back) and back[k] == tail else None

    def _after(self, right: np.ndarray, head: int) -> int | None:
        if head == 0:
            return 0
        ahead = np.cumsum(self.length[right[: head + 1]])
        k = int(np.searchsorted(ahead, head))
        return k + 1 if k < len(ahead) and ahead[k] == head else None

    def _within(self, text: str, a: int, mid: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
        """A splice inside one run of letters or digits, if the window's outer tokens agree with both sides."""
        window = text[a:b]
        if not (window.isascii() and (window.isalpha() or window.isdigit()) or all(_class(c) == "L" for c in window)):
            return None
        if (cut_l := self._before(left, len(text[a:mid].encode()))) is None or (cut_r := self._after(right, len(text[mid:b].encode()))) is None:
            return self._slide(text, a, mid, b, left, right)
        return self._splice(window, left, cut_l, right, cut_r)

    def _slide(self, text: str, a: int, mid: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
        """The same with the window's ends moved inwards to token borders that are character borders."""
        for a2 in range(a, mid):
            if (cut_l := self._before(left, len(text[a2:mid].encode()))) is not None:
                break
        else:
            return None
        for b2 in range(b, mid, -1):
            if (cut_r := self._after(right, len(text[mid:b2].encode()))) is not None:
                return self._splice(text[a2:b2], left, cut_l, right, cut_r)
        return None

    def _splice(self, window: str, left: np.ndarray, cut_l: int, right: np.ndarray, cut_r: int) -> np.ndarray | None:
        # A window in the middle of a run starts a pre-token of its own: no space or apostrophe can precede it inside the run.
        mine = self._base(window)
        if len(mine) >= 2 and cut_l < len(left) and cut_r > 0 and mine[0] == left[cut_l] and mine[-1] == right[cut_r - 1]:
            return np.concatenate([left[:cut_l], mine, right[cut_r:]])
        return None

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def _class(c: str) -> str:
    return unicodedata.category(c)[0]


def _forced(text: str, i: int) -> bool:
    """Whether a pre-token must start at i: a letter or digit before it that what follows cannot continue."""
    k = _class(text[i - 1])
    return k in "LN" and _class(text[i]) != k


def _edge(text: str, a: int, b: int, limit: int, back: bool) -> int | None:
    """The forced split nearest to the outer end of [a, b]."""
    for i in range(a, b) if back else range(b, a, -1):
        if 0 < i < len(text) and i != limit and _forced(text, i):
            return i
    return None


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def decimal(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def op5_tree_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            text, n, ids_sha, out_sha = b.column(1), [], [], []
            for i in range(len(text)):
                ids = c.encode(text[i].as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(decimal(ids)).hexdigest())
                out_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(out_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
