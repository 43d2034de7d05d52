"""Line dedup by levelled sorted runs of line digests, in DataFrame functions only."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import delete, folders, text_or_empty, written
from tabloom.llm.decontaminate import lowered
from tabloom.storage import scratch_dir

#: Code points that a key must have for its lines to be judged.
MIN_KEY = 10
#: Runs of a level that are compacted into one of the next, and batches of a whole table.
FANOUT, BATCHES = 3, 6
STRIPPED = "\t\n\x0b\x0c\r "

_RUN = re.compile(r"level-(\d+)-run-(\d+)-buckets-(\d+)$")


class LineRuns:
    """Runs of (digest, owner), each sorted by digest in the same buckets, below one folder.

    A run holds the keys that a batch brought and no run had before, with the smallest id that
    holds them. `fanout` runs of one level are compacted into a run of the next, so a batch meets
    few runs however many came before. Runs have equal buckets, so that a batch, which is
    aggregated into the same ones, is merged with them without moving a run. A folder with runs
    is opened again as it was left; a run counts once its writer has committed it. A compaction
    that was cut short leaves both its result and its sources, which hold the same keys.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        found = (_RUN.match(name) for name in folders(spark, self.folder))
        self.runs = sorted(tuple(map(int, m.groups())) for m in found if m)
        self.buckets = self.runs[0][2] if self.runs else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _path(self, run: tuple[int, int, int]) -> str:
        return f"{self.folder}/level-{run[0]}-run-{run[1]}-buckets-{run[2]}"

    def read(self, run: tuple[int, int, int]) -> DataFrame:
        name = f"tabloom_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (digest BINARY, owner BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {run[2]} BUCKETS LOCATION '{self._path(run)}'")
        table = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the entry only; the files stay for the frame
        return table

    def _write(self, keys: DataFrame, level: int) -> tuple[int, int, int]:
        run = (level, 1 + max((r[1] for r in self.runs), default=0), self.buckets)
        name = f"tabloom_{uuid.uuid4().hex}"
        writer = keys.select("digest", "owner").write.bucketBy(self.buckets, "digest").sortBy("digest")
        writer.option("path", self._path(run)).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        self.runs = sorted([*self.runs, run])
        return run

    def add(self, keys: DataFrame) -> None:
        """Merge-anti-join distinct (digest, owner) with every run, and keep the rest as a run."""
        for run in self.runs:
            keys = keys.join(self.read(run), "digest", "left_anti")
        self._write(keys, 0)
        self._compact()

    def _compact(self) -> None:
        for level in range(1 + max(r[0] for r in self.runs)):
            full = [r for r in self.runs if r[0] == level]
            if len(full) >= self.fanout:
                keys = self.read(full[0])
                for run in full[1:]:
                    keys = keys.unionByName(self.read(run))
                self._write(keys.repartition(self.buckets, "digest"), level + 1)
                self.runs = [r for r in self.runs if r not in full]
                for run in full:
                    delete(self.spark, self._path(run))

    def owners(self) -> DataFrame:
        """Every key and the smallest id that held it when it came."""
        frames = [self.read(run) for run in self.runs]
        result = frames[0]
        for frame in frames[1:]:
            result = result.unionByName(frame)
        return result


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lowered."""
    return lowered(F.btrim(line, F.lit(STRIPPED)))


def _digest(key: Column) -> Column:
    return F.unhex(F.substring(F.sha2(key.cast("binary"), 256), 1, 32))


def _lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text digest, place, key digest) of every line whose key is long enough."""
    text = text_or_empty(text_column)
    exploded = docs.select(
        F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    keyed = exploded.select("id", "row", "place", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= MIN_KEY)
    return keyed.select("id", "row", "place", _digest(F.col("key")).alias("digest"))


def _batch_of(docs: DataFrame, id_column: str, batches: int) -> Column:
    """The batch of an id: ranges of ids with about equally many rows; null ids are in the last."""
    shares = [(k + 1) / batches for k in range(batches - 1)]
    cuts = docs.agg(F.percentile_approx(F.col(id_column).cast("long"), shares, 1000)).first()[0] if shares else None
    number = F.lit(0)
    for cut in cuts or []:
        number = number + (F.col("id") > cut).cast("int")
    return F.coalesce(number, F.lit(batches - 1))


def without_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", runs: LineRuns | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, kept_text.

    A text is split at \\n; a null or empty text is one empty line. A line's key is the line
    without ASCII white space at its ends, A-Z lowered. All lines of a key of 10 code points or
    more go but those in the smallest id that holds it; a key in one document keeps its lines,
    repeated or not. kept_text has the other lines, joined by \\n.

    The documents are dealt into batches by ranges of ids, the smallest ids first. Each batch
    reduces its lines to distinct keys (a key in a third of all lines is one row a task before
    anything moves), merge-anti-joins them with the runs there are and adds what is new as its
    own run. With `runs` (a LineRuns of an earlier call) keys of earlier tables count as held by
    smaller ids, unless the id is the same; its runs stay and grow, and the same table once more
    gives the same result. Keys are told apart by 128 bits of SHA-256.

    Ids must be integers; a null id is later than all others and all rows without one are one
    document, as are rows with the same id. Rows equal in id and text are returned as often as
    they occur. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_column} is {kind}; an integer is needed to tell which document is earlier")
    runs = LineRuns(spark, scratch_dir(spark)) if runs is None else runs
    lines = _lines(docs, id_column, text_column).withColumn("batch", _batch_of(docs, id_column, batches))
    lines = written(lines, partition_by="batch")
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch).groupBy("digest").agg(F.min("id").alias("owner")))
    kept = runs.owners()
    stays = (lines["digest"] == kept["digest"]) & lines["id"].eqNullSafe(kept["owner"])
    gone = lines.join(kept, stays, "left_anti").groupBy("id", "row").agg(F.collect_set("place").alias("places"))
    gone = gone.select(F.col("id").alias("_id"), F.col("row").alias("_row"), "places")

    text = text_or_empty(text_column)
    keyed = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    joined = keyed.join(gone, F.col("id").cast("long").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    split = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), F.col("places"))
    rest = F.array_join(F.transform(stay, lambda k: F.get(F.col("split"), k)), "\n")
    return joined.withColumn("split", split).select(
        F.col("id").alias(id_column), F.size("split").cast("long").alias("n_lines"),
        F.coalesce(F.size(F.when(F.col("places").isNotNull(), F.col("places"))), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(rest).alias("kept_text"))
