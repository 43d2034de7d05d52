"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import text_or_empty, written

#: Words of a shared span that must be found, of a gram, and the grams of a winnowing window:
#: every span of WINDOW words holds the smallest of GRAMS consecutive grams.
WINDOW, GRAM = 10, 5
GRAMS = WINDOW - GRAM + 1

#: What stands between words, before letters are lowered: all of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INSIDE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII only take the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def item_words(text: Column) -> Column:
    return F.filter(F.split(lowered(text), BETWEEN), lambda word: word != "")


def _grams(words: Column, length: int) -> Column:
    """Hashes of the runs of `length` words, in order; none for shorter texts."""
    last = F.size(words) - length
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(length)]),
    )).otherwise(F.array().cast("array<bigint>"))


def winnowed(rows: DataFrame, words: str, name: str) -> DataFrame:
    """Add the distinct smallest gram hashes of all winnowing windows."""
    last = F.size("_grams") - GRAMS + 1
    return rows.withColumn("_grams", _grams(F.col(words), GRAM)).withColumn(name, F.when(last >= 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), last), lambda i: F.array_min(F.slice("_grams", i, GRAMS)),
    ))).otherwise(F.array().cast("array<bigint>"))).drop("_grams")


def _run_text(words: Column, start: Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text")).withColumn("digest", F.xxhash64("text"))


class _Look(NamedTuple):
    """What one pass over the documents gives: a row per document, and the fingerprints it shares."""

    documents: DataFrame
    hits: DataFrame
    short: list[int]
    windows: DataFrame


def _look(docs: DataFrame, benchmark: DataFrame, id_column: str, text_column: str, item_column: str, item_text: str) -> _Look:
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), item_words(text_or_empty(item_text)).alias("words")).where(
        F.col("item").isNotNull() & (F.size("words") > 0))
    short = sorted(r[0] for r in items.where(F.size("words") < WINDOW).select(F.size("words")).distinct().collect())  # of 1 to 9
    windows = items.select("item", F.explode(F.when(F.size("words") < WINDOW, F.array(F.array_join("words", " "))).otherwise(F.transform(
        F.sequence(F.lit(1), F.size("words") - WINDOW + 1), lambda i: _run_text(F.col("words"), i, WINDOW)))).alias("window"))
    whole = F.array().cast("array<bigint>")
    for length in short:
        whole = F.when(F.size("words") == length, _grams(F.col("words"), length)).otherwise(whole)
    fingerprints = winnowed(items, "words", "marks").select(F.explode(F.concat("marks", whole)).alias("gram")).distinct()

    # Words are split once, for their number and their fingerprints. Each document also has a row
    # of its own, under its digest, that passes the join whether it meets a fingerprint or not.
    # Written tables have a known size, by which the join is planned.
    worded = _keyed(docs, id_column, text_column).select("id", "digest", item_words(F.col("text")).alias("words"))
    marks = F.concat("marks", *[_grams(F.col("words"), length) for length in short])
    rows = winnowed(worded, "words", "marks").select(
        "id", "digest", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array("digest"), marks)).alias("at", "gram"))
    known = written(fingerprints).withColumn("known", F.lit(True))
    met = written(rows.join(known, "gram", "left").where("at = 0 or known").select(
        "id", "digest", "n_words", F.when(F.col("at") > 0, F.col("gram")).alias("gram")))
    hits = written(met.where("gram is not null").groupBy("id", "digest").agg(F.collect_set("gram").alias("hits")))
    shared = windows.groupBy("window").agg(F.collect_set("item").alias("items"))
    return _Look(met.where("gram is null").drop("gram"), hits, short, written(shared))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents with hits only: _id, _digest (of the text), n_hit, n_items, items_sha256."""
    return _judged(docs, _look(docs, benchmark, id_column, text_column, item_column, item_text), id_column, text_column)


def _judged(docs: DataFrame, look: _Look, id_column: str, text_column: str) -> DataFrame:
    # Only documents with hits are taken apart again; their hits say where to look.
    near = _keyed(docs, id_column, text_column).alias("k").join(
        look.hits.alias("h"), F.col("k.id").eqNullSafe(F.col("h.id")) & (F.col("k.digest") == F.col("h.digest"))
    ).select("k.id", "k.digest", item_words(F.col("text")).alias("words"), "hits")
    spans = near.select("id", "digest", "words", F.explode(F.array_distinct(F.concat(
        _around(F.col("words"), F.col("hits"), GRAM, GRAMS - 1, WINDOW),
        *[_around(F.col("words"), F.col("hits"), length, 0, length) for length in look.short],
    ))).alias("span")).select(
        "id", "digest", "span", _run_text(F.col("words"), F.col("span.start"), F.col("span.length")).alias("window"))
    found = spans.join(look.windows, "window").groupBy("id", "digest").agg(
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merged = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda done, span: F.struct(
            F.greatest(done["end"], span["start"] + span["length"]).alias("end"),
            (done["total"] + F.greatest(F.lit(0), span["start"] + span["length"] - F.greatest(done["end"], span["start"]))).alias("total")),
        lambda done: done["total"])
    return found.select(
        F.col("id").alias("_id"), F.col("digest").alias("_digest"), merged.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of a-z, digits and non-ASCII after A-Z is lowered. A window is 10 consecutive
    words of an item, or all words of a shorter item; a document word inside any occurrence of a
    window is hit. Winnowing keeps the smallest 5-gram hash of every 6 grams on both sides, so
    each shared span of 10 words shares a fingerprint; shorter items are looked up by the hash of
    all their words. Hits are extended to the windows around them, which are compared as text.

    A null text has no words; rows equal in id and text are judged once and returned as often as
    they occur; null ids are kept. Empty tables, on either side, give no hits. Items with equal
    windows all count; null item ids are left out. Other columns are not read.
    """
    look = _look(docs, benchmark, id_column, text_column, item_column, item_text)
    judged = _judged(docs, look, id_column, text_column)
    joined = look.documents.join(judged, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select(
        F.col("id").alias(id_column), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **columns: str) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no window of the benchmark."""
    judged = contaminated(docs, benchmark, id_column, text_column, **columns).select("_id", "_digest")
    same = F.col(id_column).eqNullSafe(F.col("_id")) & (F.xxhash64(text_or_empty(text_column)) == F.col("_digest"))
    return docs.join(judged, same, "left_anti")


def _around(words: Column, hits: Column, gram: int, before: int, length: int) -> Column:
    """Starts (from 1) of the spans of `length` words that hold a gram among the hits."""
    positions = F.filter(F.transform(_grams(words, gram), lambda h, i: F.when(F.array_contains(hits, h), i + 1)), lambda p: p.isNotNull())
    last = F.size(words) - length + 1
    starts = F.array_distinct(F.flatten(F.transform(positions, lambda p: F.filter(
        F.sequence(F.greatest(p - before, F.lit(1)), F.greatest(p, F.lit(1))), lambda s: s <= last))))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(length).alias("length")))
