"""Toxicity by multiple-instance learning: sentences score, documents are labelled."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import in_fold, ship
from tabloom.llm.linear import STEPS, Adagrad, each, fixed, per_document, probability, sampled, scored, sigmoid, trained
from tabloom.llm.textbatch import LETTERS, ngram_hash, spans_hash, words

#: Labelled rows of each class that the model is fitted on.
SAMPLE_ROWS = 2000
DIMENSIONS = 1 << 18
#: Bytes of the parts of words that are features beside the words: stems with many endings.
PART = 5
#: Documents of the more frequent class that a word's weight must be worth.
MIN_DOCUMENTS = 2
THRESHOLD = 0.7
SCHEMA = "score double, predicted int, sentences array<struct<start: int, length: int, score: double>>"
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


def _sentences(texts: pa.Array):
    """Feature numbers, the first of each sentence, the first sentence of each text, spans.

    A sentence is a run of words of a text without a full stop, exclamation or question mark or
    line break between them. Its features are its words and the parts of its words.
    """
    found = words(texts, lower=True, inside=LETTERS)
    ids = (spans_hash(found.bytes, found.start, found.end) % np.uint64(DIMENSIONS)).astype(np.int64)
    stops = np.concatenate([[0], np.cumsum(_STOP[found.bytes])])
    begins = np.ones(len(ids), bool)
    if len(ids) > 1:
        begins[1:] = stops[found.start[1:]] > stops[found.end[:-1]]
        begins[found.first[(found.first > 0) & (found.first < len(ids))]] = True
    numbers = np.cumsum(begins)
    firsts = np.flatnonzero(begins)
    lasts = np.append(firsts[1:], len(ids)) - 1
    spans = found.start[firsts], found.end[lasts]
    of_texts = np.concatenate([[0], numbers])[found.first]
    parts = np.maximum(found.end - found.start - PART + 1, 0)
    place = np.arange(parts.sum()) + np.repeat(found.start - np.cumsum(parts) + parts, parts)
    grams = (ngram_hash(found.bytes, PART)[place] % np.uint32(DIMENSIONS)).astype(np.int64)
    # A word's features stand together: the word, then its parts.
    at = np.arange(len(ids)) + np.cumsum(parts) - parts
    features = np.empty(len(ids) + len(grams), np.int64)
    own = np.zeros(len(features), bool)
    own[at] = True
    features[own], features[~own] = ids, grams
    return features, np.append(at[firsts], len(features)), of_texts, spans, found.edges


def _prepared(texts: pa.Array) -> list[bytes]:
    """For each text, its sentences' features; the top bit marks a sentence's first."""
    result = []
    for text in texts:
        ids, firsts, _, _, _ = _sentences(pa.array([text.as_py() or ""]))
        marked = ids.astype("<u4")
        marked[firsts[:-1]] |= np.uint32(1 << 31)
        result.append(marked.tobytes())
    return result


def _fit(features: list[bytes], labels: list[int]) -> dict:
    """Minimise the log loss of noisy-or documents over the feature weights of sentence scores."""
    toxic = np.array(labels, float)
    parts = [np.frombuffer(f, "<u4") for f in features]
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    sentence = np.cumsum(flat >> np.uint32(31)).astype(np.int64) - 1
    count = int(sentence[-1]) + 1 if len(sentence) else 0
    column = (flat & np.uint32((1 << 31) - 1)).astype(np.int64)
    document = np.zeros(count, np.int64)
    document[sentence] = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    share = max(toxic.mean(), 1e-9)
    weight = np.where(toxic > 0, 0.5 / share, 0.5 / max(1 - share, 1e-9)) / max(len(toxic), 1)
    # A word must help in as many documents as the penalty is worth, or it keeps no weight.
    model, bias = Adagrad(DIMENSIONS, 0.5, MIN_DOCUMENTS * weight.min()), Adagrad(1, 0.2)
    bias.weights[0] = -4.0
    for _ in range(300):
        p = sigmoid(np.bincount(sentence, model.weights[column], count) + bias.weights[0])
        none = np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-9)), len(toxic))
        any_one = np.maximum(-np.expm1(none), 1e-9)
        pull = np.where(toxic > 0, -np.exp(none) / any_one, 1.0) * weight
        error = p * pull[document]
        model.step(np.bincount(column, error[sentence], DIMENSIONS))
        bias.step(np.array([error.sum()]))
    return {"weights": model.weights.astype(np.float32), "bias": float(bias.weights[0])}


def score_texts(model: dict | None, texts: pa.Array) -> dict:
    """The columns of SCHEMA: noisy-or of the sentences, and the sentences of 0.5 or more."""
    if model is None:
        empty = pa.array([[]] * len(texts), _SPANS)
        return {"score": np.zeros(len(texts)), "predicted": np.zeros(len(texts), np.int32), "sentences": empty}
    ids, firsts, of_texts, (start, end), edges = _sentences(texts)
    p = probability(per_document(fixed(model["weights"][ids]), firsts) / STEPS + model["bias"])
    score = -each(math.expm1, per_document(each(math.log1p, -np.minimum(p, 1 - 1e-9)), of_texts))
    score = np.clip(score, 0, 1)
    bad = np.flatnonzero(p >= 0.5)
    offsets = np.searchsorted(bad, of_texts).astype(np.int32)
    base = edges[np.searchsorted(of_texts, bad, "right") - 1] if len(bad) else bad
    spans = pa.StructArray.from_arrays(
        [pa.array((start[bad] - base).astype(np.int32)), pa.array((end[bad] - start[bad]).astype(np.int32)), pa.array(p[bad])],
        fields=list(_SPANS.value_type))
    return {"score": score, "predicted": (score >= THRESHOLD).astype(np.int32), "sentences": pa.ListArray.from_arrays(pa.array(offsets), spans, type=_SPANS)}


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> dict | None:
    """The model, from at most `rows` labelled documents of each class; None without both."""
    known = labels.where(F.col(label_column).isNotNull()).select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("label"))
    chosen = sampled(known.where("label = 1"), "_id", rows).unionByName(sampled(known.where("label = 0"), "_id", rows))
    # Bounded by twice `rows`.
    texts = docs.select(F.col(id_column).alias("_doc"), F.col(text_column).alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("text", "label")
    return trained(sample, _prepared, _fit)


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", modulus: int = 3, remainder: int = 1, **sample) -> DataFrame:
    """One row per document: id, held_out, score, predicted and the offending sentences.

    Labels are learned only from rows whose crc32 of the id as text leaves another remainder.
    The score is the noisy-or of sentence probabilities, each a logistic function of the words;
    predicted is 1 from 0.7. `sentences` has byte offset, length and probability of the
    sentences of 0.5 or more. Texts without words score 0; so do all without labels to learn
    from. Repeated rows score alike; a null id counts as empty text for the fold; an empty table
    gives an empty result. Other columns are not read, least of all the labels, in scoring.
    """
    ship(docs.sparkSession)
    model = fit_toxicity(docs, labels.where(~in_fold(id_column, modulus, remainder)), id_column=id_column, text_column=text_column, **sample)
    return docs.select(
        F.col(id_column), in_fold(id_column, modulus, remainder).alias("held_out"), scored(model, score_texts, SCHEMA, text_column).alias("_r"),
    ).select(id_column, "held_out", "_r.*")
