"""Operator 2, language ID: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, id_crc, prepare, slices, table

#: Rows of each language that the model is fitted on at most, and landmarks of each language.
PER_LANGUAGE, LANDMARKS = 600, 48
RIDGE, SHARPNESS = 1e-3, 6.0


def _classes() -> np.ndarray:
    """Byte -> class of 64: 0 for what separates words, letters without case, and bytes above 127 by their low bits."""
    c = np.zeros(256, np.uint8)
    for b in range(256):
        ch = chr(b)
        if b < 128:
            c[b] = ord(ch.lower()) - 96 if ch.isalpha() else 0
        elif b < 192:
            c[b] = 27 + (b & 63) % 32  # the second byte: capitals and small letters of Latin-1 are 32 apart
        else:
            c[b] = 59 + (b & 3)
    return c


CLASS = _classes()
SIZES = (64, 64**2, 64**3)
BASE = np.cumsum([0, *SIZES])  # codes of 1-, 2- and 3-grams follow each other


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: (code of the n-gram at each byte, row of that byte), n-grams that leave their row left out."""
    c = CLASS[data].astype(np.int32)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    code = c
    for n in (1, 2, 3):
        if n > 1:
            code = code[:-1] * 64 + c[n - 1 :]
        if len(code) <= 0:
            return
        inside = row[: len(code)] == row[n - 1 :]
        yield code[inside] + int(BASE[n - 1]), row[: len(code)][inside]


def presence(data: np.ndarray, offsets: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """rows x width, 1 where the row has the n-gram whose place in the vocabulary is that column."""
    out = np.zeros((len(offsets) - 1, width), np.float32)
    for code, row in grams(data, offsets):
        at = place[code]
        known = at >= 0
        out[row[known], at[known]] = 1
    return out


@dataclass
class LanguageModel:
    """place: n-gram -> column or -1; landmarks: columns x landmarks, each of length one; weights: landmarks x languages."""

    languages: list[str]
    place: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def kernel(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Normalised presence kernel of each row with each landmark: shared n-grams over the root of both counts."""
        p = presence(data, offsets, self.place, len(self.landmarks))
        return (p @ self.landmarks) / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = SHARPNESS * (self.kernel(data, offsets) @ self.weights + self.offset)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Kernel ridge regression on the Nyström features of the given texts; the first `landmarks` texts of each language are its landmarks."""
    languages = sorted(set(langs))
    y = np.array([languages.index(x) for x in langs])
    chosen = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(languages))])
    data = pa.array([texts[i] for i in chosen], pa.large_string())
    seen = np.zeros(BASE[-1], bool)
    for _, _, d, o in slices(data):
        for code, _ in grams(d, o):
            seen[code] = True
    place = np.full(BASE[-1], -1, np.int32)
    place[seen] = np.arange(seen.sum())
    marks = np.concatenate([presence(d, o, place, int(seen.sum())) for _, _, d, o in slices(data)])
    marks = (marks / np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))).T.copy()
    model = LanguageModel(languages, place, marks, np.zeros((len(chosen), len(languages)), np.float32), np.zeros(len(languages), np.float32))
    k = np.concatenate([model.kernel(d, o) for _, _, d, o in slices(pa.array(texts, pa.large_string()))]).astype(np.float64)
    target = np.where(np.arange(len(languages)) == y[:, None], 1.0, -1.0)
    counts = np.bincount(y, minlength=len(languages))
    w = (1 / counts[y])[:, None] * len(y) / len(languages)  # every language weighs the same
    offset = (w * target).sum(axis=0) / w.sum()
    mm = (marks.T @ marks).astype(np.float64)
    a = k.T @ (w * k) + ridge * len(y) * mm + 1e-8 * np.eye(len(chosen))
    model.weights = np.linalg.solve(a, k.T @ (w * (target - offset))).astype(np.float32)
    model.offset = offset.astype(np.float32)
    return model


def sample(docs: DataFrame, most: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """About `most` rows of each language, chosen by a hash of the id, whole texts; in the order of that hash.

    Only the languages' counts and these rows come to the driver: the bound is `most` times the number of labels.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL AND length(text) > 0").where(id_crc() % 3 != 1).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.15 * most / n))])
    unit = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 20)) / (1 << 20)
    got = sorted((r for r in rows.withColumn("u", unit).where(F.col("u") < share[F.col("lang")]).collect()), key=lambda r: (r["u"], r["doc_id"], r["text"]))
    by: dict[str, list[str]] = {}
    seen: set[str] = set()
    for r in got:
        if len(by.setdefault(r["lang"], [])) < most and r["text"] not in seen:
            by[r["lang"]].append(r["text"])
            seen.add(r["text"])
    return [t for lang in sorted(by) for t in by[lang]], [lang for lang in sorted(by) for _ in by[lang]]


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs with lang_pred and lang_score added: `und` (score 0) if the text is null, has no letter, or nothing was learned.

    Columns that are already called so keep their names, and the new ones get underscores before theirs.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept, new = docs.columns, [free_name(docs, n) for n in ("lang_pred", "lang_score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*(model.languages if model else []), "und"], object)
        for b in batches:
            text = b.column(kept.index("text")) if "text" in kept else None
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False), bool)
            best, score = np.full(b.num_rows, len(names) - 1), np.zeros(b.num_rows)
            for lo, hi, data, offsets in slices(text) if model else ():
                p = model.probabilities(data, offsets)
                best[lo:hi], score[lo:hi] = p.argmax(axis=1), p.max(axis=1)
            best[~letters], score[~letters] = len(names) - 1, 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[best], pa.string()), pa.array(score)], [*b.schema.names, *new])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, `{new[0]}` string, `{new[1]}` double")


def learn(docs: DataFrame) -> LanguageModel | None:
    """The model of docs' own labelled rows; None if there are none."""
    texts, langs = sample(docs)
    return fit(texts, langs) if texts else None


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", F.col("text").cast("string").alias("text")), learn(docs))
    return found.select("doc_id", (F.coalesce(id_crc() % 3, F.lit(0)) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is in some language, that is, has a letter: `und` goes; the columns stay as they are.

    Rows with a null text go. The model is learned from the labelled rows of docs; if they hold none that can be learned
    from, the letters alone decide, which no model is needed for. Columns named lang_pred or lang_score keep their own values.
    """
    prepare(docs.sparkSession)
    model = learn(docs)
    if model is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    if "lang_pred" not in {c.lower() for c in docs.columns} and "lang_score" not in {c.lower() for c in docs.columns}:
        return predict(docs, model).where("lang_pred <> 'und'").select(*docs.columns)
    names = docs.columns
    plain = docs.toDF(*[f"c{k}__{n}" if n != "text" else n for k, n in enumerate(names)])
    return predict(plain, model).where("lang_pred <> 'und'").select(*plain.columns).toDF(*names)
