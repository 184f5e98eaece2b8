"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import frugal, portions, small_batches

#: Labelled rows that training takes at most, over all languages; the documented bound on what reaches the driver.
TRAIN_ROWS = 6000
#: Buckets of the hashed byte n-grams.
DIM = 4096
EPOCHS, L2 = 30, 1e-4

# Language codes by family. A code that is not here is a family of its own.
FAMILIES = {
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "germanic": ("af", "da", "de", "en", "nl", "no", "sv"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
}

_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes), lang)


def features(text: str, dim: int = DIM) -> np.ndarray:
    """Unit vector of square-rooted counts of the hashed byte 1-, 2- and 3-grams of the whole, lower-cased text."""
    out = np.zeros(dim, np.float32)
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)
    for at in range(0, len(data), 1 << 20):  # parts overlap by two bytes, so each n-gram counts once and memory is bounded
        b = data[at : at + (1 << 20) + 2].astype(np.uint32)
        n = min(len(b), 1 << 20)
        two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] + b[2:] * np.uint32(0xC2B2AE35)
        for grams in (b[:n] * np.uint32(0x27D4EB2F), two[:n], three[:n]):
            mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out += np.bincount((mixed >> np.uint32(12)) % np.uint32(dim), minlength=dim)
    out = np.sqrt(out)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def _svm(parts: list[tuple[np.ndarray, float]], epochs: int = EPOCHS, l2: float = L2) -> np.ndarray:
    """Linear SVM (weights, then bias) by subgradient descent with momentum on the squared hinge loss; both sides weigh alike.

    parts: (feature rows, +1 or -1), views of one matrix, which is never copied.
    """
    n = {side: sum(len(x) for x, y in parts if y == side) for side in (1.0, -1.0)}
    w = np.zeros(parts[0][0].shape[1] + 1, np.float32)
    velocity = np.zeros_like(w)
    for _ in range(epochs * 10):
        gradient = np.float32(l2) * w
        for x, y in parts:
            pull = np.maximum(0, 1 - np.float32(y) * (x @ w[:-1] + w[-1])) * np.float32(y / max(1, n[y]))  # twice half a side's share
            gradient[:-1] -= pull @ x
            gradient[-1] -= pull.sum()
        velocity = np.float32(0.9) * velocity - np.float32(0.2) * gradient
        w = w + velocity
    return w


@dataclass
class LanguageModel:
    families: list[str]
    family_w: np.ndarray  # one-versus-rest rows
    langs: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int, np.ndarray]]]

    @classmethod
    def fit(cls, x: np.ndarray, lang: list[str]) -> LanguageModel:
        """x: feature rows, those of a language one after the other (lang ascends)."""
        labels = np.array(lang)
        of = {v: x[np.searchsorted(labels, v) : np.searchsorted(labels, v, "right")] for v in sorted(set(lang))}
        families = sorted(set(map(family_of, of)))
        langs = {f: [v for v in of if family_of(v) == f] for f in families}
        family_w = np.zeros((len(families), x.shape[1] + 1), np.float32)
        if len(families) > 1:
            family_w = np.stack([_svm([(rows, 1.0 if v in langs[f] else -1.0) for v, rows in of.items()]) for f in families])
        pairs = {f: [(i, j, _svm([(of[own[i]], 1.0), (of[own[j]], -1.0)])) for i, j in combinations(range(len(own)), 2)] for f, own in langs.items()}
        return cls(families, family_w, langs, pairs)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """Language and score: the family's share (a logistic of its margin over the best other) times the winner's mean duel."""
        margins = x @ self.family_w[:, :-1].T + self.family_w[:, -1]
        out = []
        for row, m in zip(x, margins):
            best = int(m.argmax())
            others = np.delete(m, best)
            sure = 1 / (1 + np.exp(-2.0 * float(m[best] - others.max()))) if len(others) else 1.0
            family = self.families[best]
            own = self.langs[family]
            duels = np.zeros(len(own))
            wins = np.zeros(len(own))
            for i, j, w in self.pairs[family]:
                d = float(row @ w[:-1] + w[-1])
                p = 1 / (1 + np.exp(-4.0 * d))
                duels[i] += p
                duels[j] += 1 - p
                wins[i if d >= 0 else j] += 1
            k = max(range(len(own)), key=lambda i: (wins[i], duels[i], -i))
            out.append((own[k], float(min(1.0, max(0.0, sure * (duels[k] / (len(own) - 1) if len(own) > 1 else 1.0))))))
        return out


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> LanguageModel | None:
    """Fits on at most `rows` labelled rows: languages share them alike, chosen by a hash of id and text, whole texts.

    One task fits the model, so it holds `rows` feature vectors of 4 * DIM bytes and no more; only the weights reach the driver.
    Null texts and languages teach nothing; None if no row is left.
    """
    ok = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    small_batches(labelled.sparkSession)
    counts = ok.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()  # a language needs a row, so no more than `rows` can be learned
    if not counts:
        return None
    each = max(1, rows // len(counts))
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 1.2 * each / r["count"]))) for r in counts], F.lit(0.0))
    keyed = ok.select(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text").alias("k"), "text", "lang")
    picked = keyed.where(F.pmod("k", F.lit(1 << 20)) < share * (1 << 20))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in portions(pc.binary_length(batch.column(1)).to_pylist()):
                keys, texts, langs = (batch.column(i).slice(a, b - a).to_pylist() for i in range(3))
                own = [(k, v, features(t).astype(np.float16).tobytes()) for k, t, v in zip(keys, texts, langs) if _LETTER.search(t)]
                for at in range(0, len(own), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own[at : at + 500]), (pa.int64(), pa.string(), pa.binary()))], names=["k", "lang", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, langs, parts = [], [], []
        for batch in batches:
            keys += batch.column(0).to_pylist()
            langs += batch.column(1).to_pylist()
            parts.append(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float16).reshape(-1, DIM))
        if keys:
            order = sorted(range(len(keys)), key=lambda i: (langs[i], keys[i]))
            x = np.concatenate(parts)[order].astype(np.float32)
            parts.clear()
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(LanguageModel.fit(x, [langs[i] for i in order]))], pa.binary())], names=["model"])

    sample = picked.mapInArrow(frugal(describe), "k long, lang string, x binary")
    fitted = sample.orderBy("k", "lang").limit(rows).mapInArrow(frugal(fit), "model binary").first()  # the limit leaves one partition
    return pickle.loads(fitted["model"]) if fitted else None


def language_of(model: LanguageModel | None, spark: SparkSession):
    """A function of a text column to struct<lang_pred, score>; only texts go to Python and only answers come back.

    `und` with score 0 if the text is null, empty or has no letter, or if nothing was learned. Texts are read whole.
    """
    small_batches(spark)
    model_b = spark.sparkContext.broadcast(model)  # its size follows the number of languages, not the rows

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def language(texts: pa.Array) -> pa.Array:
        own, n = model_b.value, len(texts)
        pred, score = ["und"] * n, [0.0] * n
        for a in range(0, n, 256):
            known = [(i, t) for i, t in enumerate(texts.slice(a, 256).to_pylist(), a) if own is not None and t and _LETTER.search(t)]
            if known:
                for (i, _), (lang, p) in zip(known, own.predict(np.stack([features(t) for _, t in known]))):
                    pred[i], score[i] = lang, p
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return language.asNondeterministic()  # or a filter on the answer would ask twice


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, lang_pred, score): the language of each whole text; keep names columns that pass through unread.

    See language_of. Repeated rows give repeated rows, an empty table an empty result.
    """
    language = language_of(model, docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_keep"), language(F.col(text_col)).alias("_language"))
    return rows.select("_keep.*", "_language.*")
