"""Language identification by hierarchical discrimination.

Hashed byte 3-grams and 4-grams of the lower-cased whole text (square roots of counts, unit length) feed linear support
vector machines: one-versus-one between language families first, then one-versus-one between the languages of the
chosen family. They are trained by one task from a bounded sample: PER_LANG labelled texts of each language; only the
machines, one row of weights each, come to the driver.

Cases: a text that is null or has no letter is ``und`` with score 0, as is every text when nothing was learned; one
learned language is predicted with score 1; unknown language codes are families of their own; repeated rows get equal
predictions; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import sheltered, table

PER_LANG = 250  # labelled texts of each language in the training sample
DIM = 1 << 14
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
    "indic": "hi bn ur pa mr gu ne",
    "turkic": "tr az kk uz",
    "baltic": "lt lv",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
UND = "und"


def family(lang: str) -> str:
    return FAMILY_OF.get(lang, lang)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """DIM features of a whole text."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    tri = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    quad = tri[:-1] | b[3:] << np.uint32(24)
    half = np.uint32(32 - (DIM.bit_length() - 2))
    x = np.bincount((tri * np.uint32(2654435761)) >> half, minlength=DIM // 2)
    y = np.bincount((quad * np.uint32(2246822519)) >> half, minlength=DIM // 2)
    v = np.sqrt(np.concatenate([x, y]).astype(np.float32))
    return v / max(float(np.sqrt(v @ v)), 1e-9)


def train_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, rounds: int = 60) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, by accelerated gradient descent; y is +1 or -1."""
    n = len(x)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb, t = w.copy(), 0.0, 1.0
    step = 1.0 / (4.0 + reg)  # rows have unit length and the row weights sum to 1
    for _ in range(rounds if n else 0):
        g = 2 * weight * np.maximum(0, 1 - y * (x @ vw + vb)) * y
        nw, nb = vw * (1 - step * reg) + step * (g @ x), vb + step * float(g.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    return np.append(w, np.float32(b))


@dataclass
class Sample:
    """Feature rows kept sparse; a machine gets only its own rows as a matrix."""

    at: list[np.ndarray]
    value: list[np.ndarray]

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), DIM), np.float32)
        for i, r in enumerate(rows.tolist()):
            x[i, self.at[r]] = self.value[r]
        return x


@dataclass
class Duel:
    """One-versus-one machines between a few classes."""

    classes: list[str]
    weights: np.ndarray  # one row of weights and bias per pair of classes, in the order of combinations()

    @classmethod
    def fit(cls, sample: Sample, rows: np.ndarray, labels: np.ndarray) -> Duel:
        """``labels`` of the sample's ``rows``."""
        classes = sorted(set(labels))
        machines = []
        for a, b in combinations(classes, 2):
            m = (labels == a) | (labels == b)
            machines.append(train_svm(sample.matrix(rows[m]), np.where(labels[m] == a, 1.0, -1.0).astype(np.float32)))
        return cls(classes, np.array(machines, np.float32).reshape(len(machines), DIM + 1))

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        """The class with most wins (then the larger sum of margins), and its least confident win as a probability."""
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        margin = self.weights[:, :-1] @ v + self.weights[:, -1]
        wins, total = dict.fromkeys(self.classes, 0), dict.fromkeys(self.classes, 0.0)
        for (a, b), m in zip(combinations(self.classes, 2), margin):
            wins[a if m >= 0 else b] += 1
            total[a] += float(m)
            total[b] -= float(m)
        best = max(self.classes, key=lambda c: (wins[c], total[c]))
        own = [m if a == best else -m for (a, b), m in zip(combinations(self.classes, 2), margin) if best in (a, b)]
        return best, float(1 / (1 + np.exp(-2 * np.clip(min(own), -20, 20))))


@dataclass
class LanguageModel:
    families: Duel | None = None
    within: dict[str, Duel] = field(default_factory=dict)

    @classmethod
    def fit(cls, sample: Sample, langs: list[str]) -> LanguageModel:
        if not langs:
            return cls()
        lang, every = np.array(langs, object), np.arange(len(langs))
        fam = np.array([family(a) for a in langs], object)
        return cls(Duel.fit(sample, every, fam), {f: Duel.fit(sample, every[fam == f], lang[fam == f]) for f in sorted(set(fam))})

    def predict(self, text: str | None) -> tuple[str, float]:
        if self.families is None or not text or not has_letter(text):
            return UND, 0.0
        v = grams(text)
        fam, p = self.families.predict(v)
        lang, q = self.within[fam].predict(v)
        return lang, p * q


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> LanguageModel:
    """Learns from rows that are not held out; at most ``per_lang`` texts of a language reach the training task, as features."""

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, val = [], []
            for i in range(b.num_rows):
                v = grams(b.column(2)[i].as_py())
                k = np.flatnonzero(v)
                at.append(k.astype(np.int32))
                val.append(v[k])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["lang", "o", "at", "val"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}") & ~held_out("i"))
    keyed = rows.select("l", "t", F.xxhash64("i", F.lit("sample")).alias("o"))
    order = Window.partitionBy("l").orderBy("o")
    # ids first, then the texts of the chosen ones only: at most per_lang rows of each language
    chosen = keyed.select("l", "o").withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_lang).groupBy("l").agg(F.max("o").alias("last"))
    limits = {r["l"]: r["last"] for r in chosen.collect()}
    if not limits:
        return LanguageModel()
    last = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
    sample = keyed.where(F.col("o") <= F.try_element_at(last, F.col("l"))).select("l", "o", "t")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches, schema)
        got = got.sort_by([("lang", "ascending"), ("o", "ascending")])  # the same model whatever order rows arrive in
        col = lambda c: [v.values.to_numpy() for v in got[c]]
        model = LanguageModel.fit(Sample(col("at"), col("val")), got["lang"].to_pylist())
        duels = [] if model.families is None else [(None, model.families), *model.within.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in duels], pa.string()), pa.array([d.classes for _, d in duels], pa.list_(pa.string())), pa.array([d.weights.tobytes() for _, d in duels], pa.binary())], ["family", "classes", "weights"]
        )

    schema = pa.schema([("lang", pa.string()), ("o", pa.int64()), ("at", pa.list_(pa.int32())), ("val", pa.list_(pa.float32()))])
    features = sample.mapInArrow(sparse, "lang string, o long, at array<int>, val array<float>")
    duels = {r["family"]: Duel(list(r["classes"]), np.frombuffer(r["weights"], np.float32).reshape(-1, DIM + 1)) for r in features.repartition(1).mapInArrow(train, "family string, classes array<string>, weights binary").collect()}
    return LanguageModel(duels.pop(None, None), duels)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns plus lang_pred and score. The text is sent once, whether it is kept or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(at)
            got = [model.predict(text[i].as_py()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names)

    rows = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).alias("__text"))
    at = keep.index(text_col) if text_col in keep else len(keep)
    fields = rows.schema.fields[: len(keep)]
    names = [*(f.name for f in fields), "__lang_pred", "__score"]
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return rows.mapInArrow(run, head + "__lang_pred string, __score double")


def reject_unknown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language can be told, all columns; a missing label is filled with the prediction."""
    docs, back = sheltered(docs, (id_col, text_col, lang_col))
    got = predict(docs, fit(docs, id_col, text_col, lang_col), docs.columns, text_col)
    return back(got.where(F.col("__lang_pred") != UND).withColumn(lang_col, F.coalesce(lang_col, "__lang_pred")))


def op6_hierarchical_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = predict(docs, fit(docs), ["doc_id"])
    return got.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))
