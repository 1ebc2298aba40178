"""Language identification by string kernels.

A text is the set of its n-grams of one to four bytes (blended spectrum, presence only) of lower-cased letters. The
kernel of two texts is the cosine of their sets. A bounded sample of labelled rows, the same number for each language,
gives landmarks (Nystroem) and trains one-versus-rest kernel ridge regression. All texts are then scored by batches:
sets times landmarks, times weights, as two matrix products.

Sets are bit vectors of 2^15 hashed n-grams; n-grams that share a bit count as one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import freeing, utf8, written

BITS = 15
ORDERS = (1, 2, 3, 4)
#: Labelled rows of each language that are learned from, landmarks among them, and the ridge.
SAMPLE, LANDMARKS, RIDGE = 300, 32, 1e-2
#: Landmarks of all languages together; more than 64 languages share them out evenly, but each has one at least.
MARKS = 64 * LANDMARKS
UNKNOWN = "und"
FOLDS = 5

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_CHUNK = 1 << 20


def presence(text: np.ndarray, flags: np.ndarray) -> None:
    """Mark the n-grams of a text's UTF-8 bytes in ``flags``, a row of 2^BITS; runs of other than letters are a space."""
    for i in range(0, len(text), _CHUNK):
        x = _FOLD[text[max(0, i - ORDERS[-1]) : i + _CHUNK]]
        space = x == 0x20
        x = x[~(space & np.r_[False, space[:-1]])].astype(np.uint32)
        code = np.zeros(len(x), np.uint32)
        for n in range(1, ORDERS[-1] + 1):
            if len(x) < n:
                break
            code = code[: len(x) - n + 1] * np.uint32(256) + x[n - 1 :]
            if n in ORDERS:
                h = (code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                flags[(h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)] = 1


def sets(texts: pa.Array, i: int, j: int) -> np.ndarray:
    """Unit rows of the presence sets of texts i..j-1."""
    data, bounds = utf8(texts.slice(i, j - i))
    x = np.zeros((j - i, 1 << BITS), np.float32)
    for row, a, b in zip(x, bounds[:-1], bounds[1:], strict=True):
        if b > a:
            presence(data[a:b], row)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def has_letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _unit(packed: np.ndarray) -> np.ndarray:
    x = np.unpackbits(packed, axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


class Model:
    """Landmarks and weights: scores of a batch are ``(sets @ landmarks) @ weights``."""

    def __init__(self, marks: np.ndarray, langs: list[str], samples: Iterable[tuple[str, bytes]], ridge: float = RIDGE) -> None:
        """``marks``: the landmarks' sets as packed bits; ``samples``: languages and sets of all rows, gone through once."""
        self.langs = sorted(langs)
        number = {lang: i for i, lang in enumerate(self.langs)}
        self.landmarks = np.empty((1 << BITS, len(marks)), np.float32)
        for i in range(0, len(marks), 64):
            self.landmarks[:, i : i + 64] = _unit(marks[i : i + 64]).T
        k = np.concatenate([_unit(marks[i : i + 64]) @ self.landmarks for i in range(0, len(marks), 64)]).astype(np.float64)
        values, vectors = np.linalg.eigh(k)
        good = values > values.max() * 1e-6
        self.map = vectors[:, good] / np.sqrt(values[good])  # k(x, landmarks) @ map: Nystroem features
        size, n = self.map.shape[1] + 1, 0
        left, right = np.zeros((size, size)), np.zeros((size, len(self.langs)))
        for block in itertools.batched(samples, 64):
            x = _unit(np.stack([np.frombuffer(bits, np.uint8) for _, bits in block]))
            phi = np.c_[(x @ self.landmarks).astype(np.float64) @ self.map, np.ones(len(block))]
            y = np.full((len(block), len(self.langs)), -1.0)
            y[np.arange(len(block)), [number[lang] for lang, _ in block]] = 1.0
            left += phi.T @ phi
            right += phi.T @ y
            n += len(block)
        penalty = np.diag(np.r_[np.full(size - 1, ridge * n), 1e-9])
        w = np.linalg.solve(left + penalty, right)
        self.weights, self.bias = (self.map @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.landmarks) @ self.weights + self.bias


def held_out(doc_id, folds: int = FOLDS):
    """Column: whether crc32 of the id as text is divisible by ``folds``; a null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Learn from at most ``sample`` rows of each language, none of them held out; every label is learned.

    The sample is the rows of least hash of id and text, so it is the same however the table is dealt out. Each
    language's rows are counted first; only those with a hash among the least ``2 * sample`` or so are ranked, so no
    task sees all of a language. Repeated rows are learned from once. The sample's bit vectors of 4 KB are written in
    the shared folder; the driver holds the landmarks and reads the others a part at a time. None if no row has both a
    label and letters.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = written(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "sizes")
    below = F.lit(-(2.0**63)) + F.lit(2.0**64) * 2 * sample / F.col("n")
    few = rows.select("lang", "h").join(sizes, "lang").filter((F.col("n") <= sample) | (F.col("h") < below)).select("lang", "h").distinct()
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    keys = written(ranked.filter(F.col("rank") <= sample).select("lang", "h"), "sample")  # its size tells whether it can be broadcast
    chosen = rows.join(keys, ["lang", "h"], "left_semi")

    def f(batches):
        for b in batches:
            packed = [np.packbits(sets(b.column(0), i, i + 1) > 0).tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(packed, pa.binary())], ["lang", "h", "bits"])

    got = written(chosen.select("text", "lang", "h").mapInArrow(freeing(f), "lang string, h long, bits binary").distinct(), "bits")
    langs = [r.lang for r in got.select("lang").distinct().collect()]
    if not langs:
        return None
    share = max(1, min(LANDMARKS, MARKS // len(langs)))
    ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "bits"))).filter(F.col("rank") <= share)
    marks = ranked.orderBy("lang", "rank").select("bits").collect()
    samples = ((r.lang, bytes(r.bits)) for r in got.orderBy("lang", "h", "bits").select("lang", "bits").toLocalIterator())
    return Model(np.stack([np.frombuffer(r.bits, np.uint8) for r in marks]), langs, samples)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The input's columns, ``lang_pred`` and ``score`` (0 to 1); input columns of those names are replaced.

    A null text, or one of no letters, is ``und`` with score 0, as is every text where nothing was learned. The score
    is the winner's share after a softmax of four times the margins. Each row is judged by its whole text alone.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text = keep.index(text_col)

    def f(batches):
        m = sent.value
        for b in batches:
            texts = b.column(text)
            langs, scores = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            known = np.array([m is not None and has_letters(t.as_py()) for t in texts], bool)
            for i in range(0, b.num_rows, 128):
                j = min(b.num_rows, i + 128)
                if known[i:j].any():
                    s = m.scores(sets(texts, i, j)).astype(np.float64)
                    e = np.exp(4 * (s - s.max(1, keepdims=True)))
                    best = s.argmax(1)
                    for k in np.flatnonzero(known[i:j]):
                        langs[i + k], scores[i + k] = m.langs[best[k]], e[k, best[k]] / e[k].sum()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores)], [*b.schema.names, "lang_pred", "score"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(freeing(f), schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
