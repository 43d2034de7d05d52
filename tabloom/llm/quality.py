"""Quality rules: counted base rules, then a calibrated n-gram logistic regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import ship
from tabloom.llm.linear import STEPS, Adagrad, fixed, per_document, probability, sampled, scored, sigmoid, trained
from tabloom.llm.textbatch import Words, mixed, ngram_hash, runs_hash, spans_hash, words

#: Labelled rows the classifier is fitted on (every fifth for calibration), and its size.
SAMPLE_ROWS = 6000
DIMENSIONS = 1 << 16
CHARACTERS = (3, 4)
#: Features of labelled rows whose gradients are added up before they join the others', and
#: those that are unpacked at a time in the fit.
BLOCK, PIECE = 1 << 20, 1 << 16
#: Fixed thresholds: words a text needs, its share of repeated words in per cent, and the
#: calibrated probability of good quality below which it is rejected.
MIN_WORDS, MAX_REPEAT, MIN_PROBABILITY = 10, 20, 0.5
REPEAT_WINDOW = 5

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, quality double"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _feature_ids(found: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Feature numbers, the first of each text, and those to leave out (grams that run into the
    next text): words, then character n-grams."""
    groups = [((spans_hash(found.bytes, found.start, found.end) % np.uint64(DIMENSIONS)).astype(np.int64), found.first, np.zeros(0, int))]
    for k, length in enumerate(CHARACTERS, 1):
        grams = (ngram_hash(found.bytes, length) % np.uint32(DIMENSIONS)).astype(np.int64) + k * DIMENSIONS
        tails = np.unique(np.maximum(found.edges[1:, None] - np.arange(1, length), found.edges[:-1, None]))
        groups.append((grams, np.minimum(found.edges, len(grams)), tails[tails < len(grams)]))
    return groups


def _prepared(texts: pa.Array) -> list[bytes]:
    """Feature numbers and their shares of a text, for each text."""
    result = []
    for text in texts:
        ids, shares = [], []
        for numbers, _, _ in _feature_ids(words(pa.array([text.as_py() or ""]))):
            unique, counts = np.unique(numbers, return_counts=True)
            ids.append(unique.astype("<u4"))
            shares.append((counts / max(len(numbers), 1)).astype("<f4"))
        result.append(np.concatenate(ids).tobytes() + np.concatenate(shares).tobytes())
    return result


def _parts(features: list[bytes], documents: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The documents in runs of about so many features."""
    sizes = np.array([len(features[k]) // 8 for k in documents], np.int64)
    for part in np.split(documents, np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1):
        if len(part):
            yield part


def _unpacked(features: list[bytes], documents: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The documents in pieces of about PIECE features: their numbers, and of each feature the
    place in the piece, number and share. Only one piece's features are unpacked at a time."""
    for part in _parts(features, documents, PIECE):
        ids = [np.frombuffer(features[k], "<u4", len(features[k]) // 8) for k in part]
        shares = [np.frombuffer(features[k], "<f4", len(features[k]) // 8, len(features[k]) // 2) for k in part]
        yield part, np.repeat(np.arange(len(part)), [len(i) for i in ids]), np.concatenate(ids).astype(np.int64), np.concatenate(shares)


def _sums(features: list[bytes], documents: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each document, its shares times the weights."""
    return np.concatenate([np.zeros(0)] + [
        np.bincount(row, value * weights[column], len(part)) for part, row, column, value in _unpacked(features, documents)
    ])


def _fit(features: list[bytes], labels: list[int]) -> dict:
    """Logistic regression on four fifths of the rows, Platt scaling on the rest."""
    good = np.array(labels, float)
    calibrating = np.arange(len(good)) % 5 == 4
    size = (1 + len(CHARACTERS)) * DIMENSIONS

    model, bias = Adagrad(size, 4.0), Adagrad(1, 0.3)
    # Rows for calibration weigh nothing in the fit.
    weight = np.where(calibrating, 0, np.where(good > 0, 0.5 / max(good[~calibrating].mean(), 1e-9), 0.5 / max(1 - good[~calibrating].mean(), 1e-9)))
    for _ in range(60):
        # The gradient of all rows, added up by blocks.
        gradient, pull = 1e-8 * model.weights, 0.0
        for block in _parts(features, np.flatnonzero(~calibrating), BLOCK):
            error = np.zeros(len(good))
            z = _sums(features, block, model.weights) + bias.weights[0]
            error[block] = (sigmoid(z) - good[block]) * weight[block] / max(weight.sum(), 1)
            change = np.zeros(size)
            for part, row, column, value in _unpacked(features, block):
                np.add.at(change, column, value * error[part][row])
            gradient += change
            pull += error[block].sum()
        model.step(gradient)
        bias.step(np.array([pull]))
    z = _sums(features, np.flatnonzero(calibrating), model.weights) + bias.weights[0]
    slope, offset = _platt(z, good[calibrating])
    return {"weights": model.weights.astype(np.float32), "bias": float(bias.weights[0]), "slope": slope, "offset": offset}


def _platt(z: np.ndarray, good: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve from scores to probabilities, by Newton's method."""
    if not len(z) or good.min() == good.max():
        return 1.0, 0.0
    positive, negative = good.sum(), (1 - good).sum()
    target = np.where(good > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([z, np.ones_like(z)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ beta)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        change = np.linalg.solve(hessian, x.T @ (p - target) + 1e-6 * (beta - [1, 0]))
        beta = beta - np.clip(change, -2, 2)
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> dict | None:
    """The classifier, from at most `rows` labelled documents; None without any."""
    chosen = sampled(labels.where(F.col(label_column).isNotNull()).select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("label")), "_id", rows)
    # Bounded by `rows`.
    texts = docs.select(F.col(id_column).alias("_doc"), F.col(text_column).alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("text", "label")
    return trained(sample, _prepared, _fit)


def repeated_words(found: Words, hashes: np.ndarray, length: int = REPEAT_WINDOW) -> np.ndarray:
    """For each word, whether it is in a window of `length` words that its text holds twice or more."""
    runs, document = runs_hash(hashes, length), found.document
    starts = np.arange(len(runs))
    starts = starts[starts + length <= found.first[1:][document[:len(runs)]]] if len(runs) else starts
    keys = mixed(runs[starts] + document[starts].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    steps = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(steps, starts[twice], 1)
    np.add.at(steps, starts[twice] + length, -1)
    return np.cumsum(steps[:-1]) > 0


def _duplicate_lines(found: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, by text."""
    data, edges = found.bytes, found.edges
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([edges[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(len(edges) - 1, np.int64)
    ends = np.append(starts[1:], len(data))
    ends = np.where(data[ends - 1] == 10, ends - 1, ends)
    worded = np.searchsorted(found.start, ends) > np.searchsorted(found.start, starts)
    starts, ends = starts[worded], ends[worded]
    document = np.searchsorted(edges, starts, "right") - 1
    keys = mixed(spans_hash(data, starts, ends) + document.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    again = np.concatenate([[False], keys[order][1:] == keys[order][:-1]]) if len(keys) else np.zeros(0, bool)
    return np.bincount(document[order[again]], minlength=len(edges) - 1)


def judge(model: dict | None, texts: pa.Array) -> dict:
    """The columns of SCHEMA for a batch of texts."""
    found = words(texts)
    data, edges, n_words = found.bytes, found.edges, found.counts
    hashes = spans_hash(data, found.start, found.end)
    inside = np.zeros(len(data) + 1, np.int64)
    inside[1:] = np.cumsum((data & 0xC0) != 0x80)
    points = inside[found.end] - inside[found.start]
    repeats = per_document(repeated_words(found, hashes), found.first).astype(np.int64)
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT * n_words)
    if model is None:
        quality = np.ones(len(texts))
    else:
        z = np.full(len(texts), model["bias"])
        for ids, first, left_out in _feature_ids(found):
            weights, used = fixed(model["weights"][ids]), np.ones(len(ids), bool)
            weights[left_out], used[left_out] = 0, False
            z += per_document(weights, first) / STEPS / np.maximum(per_document(used, first), 1)
        quality = probability(model["slope"] * z + model["offset"])
    return {
        "n_words": n_words.astype(np.int64), "word_chars": per_document(points, found.first).astype(np.int64),
        "n_symbols": per_document(_SYMBOL[data], edges).astype(np.int64), "n_dup_lines": _duplicate_lines(found).astype(np.int64),
        "n_repeat_words": repeats, "base_failed": failed, "kept": ~failed & (quality >= MIN_PROBABILITY), "quality": quality,
    }


def quality_column(docs: DataFrame, model: dict | None, text_column: str = "text") -> Column:
    """A struct of the columns of SCHEMA for the text of each row."""
    ship(docs.sparkSession)
    return scored(model, judge, SCHEMA, text_column)


def quality_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **sample) -> DataFrame:
    """One row per document: id, counts, base_failed, kept and the calibrated probability.

    Words are runs of bytes other than ASCII white space. A text fails the base rules with
    fewer than 10 words or over 20 % of them repeated; the others are kept if the probability
    of good quality is at least 0.5. The classifier is fitted on at most SAMPLE_ROWS labelled
    rows, chosen by a hash of their id; without labelled rows the base rules decide alone.

    Null and empty texts have no words and fail; repeated rows are judged alike; ids may be
    null; an empty table gives an empty result. Other columns are not read. Equal windows and
    lines are found by 64-bit hashes within one text.
    """
    model = fit_quality(docs, labels, id_column=id_column, text_column=text_column, **sample)
    return docs.select(F.col(id_column), quality_column(docs, model, text_column).alias("_r")).select(id_column, "_r.*")
