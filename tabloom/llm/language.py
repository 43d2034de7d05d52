"""Language identification with a blended-spectrum string kernel and Nyström landmarks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import in_fold, ship
from tabloom.llm.linear import scored, trained
from tabloom.llm.textbatch import _LOWER, joined, ngram_hash

#: Training rows and landmarks of each language, all landmarks together, lengths of the
#: n-grams (in bytes) and places of the presence vector.
SAMPLE_ROWS, LANDMARKS, ALL_LANDMARKS = 250, 24, 512
LENGTHS = (1, 2, 3, 4)
DIMENSIONS = 1 << 14
RIDGE = 1e-3
UNDETERMINED = "und"
SCHEMA = "lang_pred string, score double"
_ROWS = 128


def presence(texts: pa.Array) -> np.ndarray:
    """Which hashed n-grams each text has, as rows of zeros and ones; A-Z count as a-z."""
    data, edges = joined(texts)
    data = _LOWER[data]
    found = np.zeros((len(texts), DIMENSIONS), np.float32)
    flat = found.reshape(-1)
    owner = np.repeat(np.arange(len(texts)) * DIMENSIONS, np.diff(edges))
    ends = np.repeat(edges[1:], np.diff(edges))
    for length in LENGTHS:
        grams = ngram_hash(data, length) + np.uint32(length * 0x3C6EF35F & 0xFFFFFFFF)
        places = owner[:len(grams)] + (grams % np.uint32(DIMENSIONS))
        flat[places[np.arange(length, len(grams) + length) <= ends[:len(grams)]]] = 1
    return found


def _prepared(texts: pa.Array) -> list[bytes]:
    return [np.packbits(presence(texts.slice(k, 1))[0] > 0).tobytes() for k in range(len(texts))]


def _kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared n-grams over the geometric mean of the numbers of n-grams."""
    norms = np.sqrt(np.maximum(left.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(right.sum(axis=1), 1))[None, :]
    return (left @ right.T) / norms


def _fit(features: list[bytes], labels: list[str]) -> dict:
    """One-versus-rest kernel ridge regression on Nyström features."""
    x = np.unpackbits(np.frombuffer(b"".join(features), np.uint8).reshape(len(features), -1), axis=1).astype(np.float32)
    classes = sorted(set(labels))
    y = np.array(labels)
    each = max(1, min(LANDMARKS, ALL_LANDMARKS // len(classes)))
    picked = []
    for c in classes:
        own = np.flatnonzero(y == c)
        picked.append(own[np.unique(np.linspace(0, len(own) - 1, min(each, len(own))).astype(int))])
    landmarks = x[np.concatenate(picked)]
    values, vectors = np.linalg.eigh(_kernel(landmarks, landmarks).astype(float))
    whiten = vectors * (1 / np.sqrt(np.maximum(values, 1e-6)))
    phi = np.concatenate([_kernel(x[k:k + 512], landmarks) for k in range(0, len(x), 512)]) @ whiten
    phi = np.concatenate([phi, np.ones((len(phi), 1))], axis=1)
    target = np.where(y[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    # Every language weighs the same, however many rows it has.
    weight = np.sqrt(1 / np.array([(y == label).sum() for label in y]))[:, None]
    a, b = phi * weight, target * weight
    beta = np.linalg.solve(a.T @ a + RIDGE * np.eye(a.shape[1]), a.T @ b)
    sizes = np.sqrt(np.maximum(landmarks.sum(axis=1), 1))
    return {
        "classes": classes, "landmarks": np.packbits(landmarks > 0, axis=1), "sizes": sizes.astype(np.float32),
        "project": (whiten @ beta[:-1]).astype(np.float32), "bias": beta[-1].astype(np.float32),
    }


def predict(model: dict | None, texts: pa.Array) -> dict:
    """The language with the largest regression value, which maps -1 .. 1 to the score's 0 .. 1."""
    lettered = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False))
    if model is None:
        return {"lang_pred": pa.array([UNDETERMINED] * len(texts), pa.string()), "score": np.zeros(len(texts))}
    if "dense" not in model:
        model["dense"] = np.unpackbits(model["landmarks"], axis=1).astype(np.float32).T.copy()
    best, score = np.zeros(len(texts), int), np.zeros(len(texts))
    for k in range(0, len(texts), _ROWS):
        x = presence(texts.slice(k, _ROWS))
        kernel = (x @ model["dense"]) / (np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * model["sizes"])
        values = kernel @ model["project"] + model["bias"]
        best[k:k + _ROWS] = values.argmax(axis=1)
        score[k:k + _ROWS] = np.round(np.clip((values.max(axis=1) + 1) / 2, 0, 1), 4)
    names = np.array(model["classes"], object)[best]
    names[~lettered] = UNDETERMINED
    return {"lang_pred": pa.array(names.tolist(), pa.string()), "score": np.where(lettered, score, 0.0)}


def fit_language(docs: DataFrame, rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> dict | None:
    """The model, from at most `rows` texts of each language, chosen by a hash of their id."""
    known = docs.select(F.col(id_column).cast("string").alias("_id"), F.col(text_column).alias("text"), F.col(label_column).alias("label")).where(
        F.col("label").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("label").orderBy(F.xxhash64("_id"), "_id")
    # Bounded by `rows` for each language; ranks are cut before rows move.
    ranked = known.select("_id", "label").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows)
    chosen = ranked.select(F.col("_id").alias("_chosen"), F.col("label").alias("_label")).distinct()
    sample = known.join(F.broadcast(chosen), (F.col("_id") == F.col("_chosen")) & (F.col("label") == F.col("_label"))).select("text", "label")
    return trained(sample, _prepared, _fit)


def languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", modulus: int = 3, remainder: int = 1, **sample) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    Learns from text and language of the rows whose crc32 of the id as text leaves another
    remainder; a prediction reads the text only. Null texts and those without a letter are
    `und` with score 0, as are all if no language is known. Repeated rows are predicted alike;
    a null id counts as empty text for the fold; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    model = fit_language(docs.where(~in_fold(id_column, modulus, remainder)), id_column=id_column, text_column=text_column, label_column=label_column, **sample)
    return docs.select(
        F.col(id_column), in_fold(id_column, modulus, remainder).alias("held_out"), scored(model, predict, SCHEMA, text_column).alias("_r"),
    ).select(id_column, "held_out", "_r.*")
