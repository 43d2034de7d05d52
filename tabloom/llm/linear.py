"""What the classifiers share: bounded samples, training in one task, scoring by Arrow batches."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import give_back, ship, text_or_empty
from tabloom.llm.encoding import forget
from tabloom.llm.textbatch import slices


#: Bytes of an Arrow batch in the fit. Spark's own limit is 64 MB, which the executor's JVM and its worker hold at once.
BATCH_BYTES = 4 << 20


def sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most so many rows, those with the smallest hashes of the key: the same rows each time."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string")), *[F.col(c) for c in rows.columns]).limit(most)


def trained(sample: DataFrame, prepare: Callable, fit: Callable):
    """Fit a model on a bounded sample with columns text and label; returns what `fit` returns.

    `prepare(texts)` gives one bytes object of features per text, in parallel and without the
    texts moving on; `fit(features, labels)` gets them as buffers in one task, on sorted rows, so the model is
    the same whatever the partitions. Spark sorts the rows, on disk if need be, and they come in
    small batches, so the task holds the features once.
    """
    ship(sample.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        give_back()
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([pa.array(prepare(part.column(0)), pa.binary()), part.column(1)], names=["features", "label"])
        give_back()

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        give_back()
        known, labels = [], []
        for batch in batches:
            known += [value.as_buffer() for value in batch.column(0)]  # no copies
            labels += batch.column(1).to_pylist()
        if known:
            made = pickle.dumps(fit(known, labels))
            known.clear()
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["model"])

    kind = dict(sample.dtypes)["label"]
    rows = sample.select("text", "label").mapInArrow(features, f"features binary, label {kind}")
    ordered = rows.repartition(1).sortWithinPartitions("label", "features")  # bounded, as the sample is
    with _small_batches(sample.sparkSession):
        found = ordered.mapInArrow(model, "model binary").collect()  # one row of a fixed size
    return pickle.loads(bytes(found[0][0])) if found else None


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES for the queries that run meanwhile."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def scored(model, score: Callable, schema: str, text_column: str = "text") -> Column:
    """A struct column of `score(model, texts)`, a mapping of arrays, for whole texts in slices."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def run(texts: pa.Array) -> pa.Array:
        forget()
        parts = [score(model, texts.slice(start, stop - start)) for start, stop in slices(texts)] or [score(model, texts)]
        arrays = [pa.concat_arrays([_arrow(part[name]) for part in parts]) for name in names]
        give_back()
        return pa.StructArray.from_arrays(arrays, names=names)

    return F.arrow_udf(run, schema)(text_or_empty(text_column))


def _arrow(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def each(function, x: np.ndarray) -> np.ndarray:
    """A function of the math module at each value. numpy's own may round the last digit of a
    value otherwise at another place of an array."""
    return np.fromiter(map(function, x.tolist()), np.float64, len(x))


def probability(x: np.ndarray) -> np.ndarray:
    """The sigmoid, alike wherever a value stands."""
    return 1 / (1 + each(math.exp, -np.clip(x, -40, 40)))


#: Steps of a unit in which weights are summed up: whole numbers, whose sums are exact in any order.
STEPS = float(1 << 24)


def fixed(weights: np.ndarray) -> np.ndarray:
    return np.rint(weights.astype(np.float64) * STEPS)


class Adagrad:
    """Steps that shrink with the squared gradients so far, then a pull to zero (the proximal
    step of an L1 penalty): a weight whose gradient stays below the penalty stays zero."""

    def __init__(self, size: int, rate: float, penalty: float = 0.0):
        self.weights, self.rate, self.penalty = np.zeros(size), rate, penalty
        self.squares = np.full(size, max(penalty, 1e-5) ** 2)

    def step(self, gradient: np.ndarray) -> None:
        self.squares += gradient * gradient
        pace = self.rate / np.sqrt(self.squares)
        moved = self.weights - pace * gradient
        self.weights = np.sign(moved) * np.maximum(np.abs(moved) - pace * self.penalty, 0)


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of values; run i is first[i] .. first[i + 1] - 1. A run's sum depends on
    its values only, not on what stands around it in a batch."""
    sums, filled = np.zeros(max(len(first) - 1, 0)), np.diff(first) > 0
    if filled.any():
        sums[filled] = np.add.reduceat(values[:first[-1]].astype(np.float64), first[:-1][filled])
    return sums
