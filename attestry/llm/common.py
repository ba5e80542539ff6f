"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of the data folder with Spark, whatever store it lies in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors can reach.

    Where the session names none a local run gets a temporary folder, which is also
    registered as the checkpoint folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        base = context.getCheckpointDir()
    if not base and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="attestry-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage safely."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(batch: pa.RecordBatch, column: int = 1) -> Iterator[str]:
    """The texts of a batch one by one; null reads as the empty text."""
    for value in batch.column(column):
        yield value.as_py() or ""


def to_batch(schema: pa.Schema, columns: Iterable[Iterable]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(columns, schema.types, strict=True)],
        schema=schema,
    )


def crc32_of_id(column: str = "doc_id") -> F.Column:
    """Unsigned crc32 of the id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def bounded_labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, limit: int, keep: F.Column | None = None, only: int | None = None
) -> DataFrame:
    """At most ``limit`` labelled documents as (doc_id, text, y), chosen by a hash of the id.

    The chosen ids are at most ``limit`` small rows, so broadcasting them is bounded by
    that parameter.  Null labels and null ids do not take part; of repeated label rows for
    one document the larger label counts, and of repeated documents of one id the text that
    sorts first.  ``keep`` is a condition on doc_id; ``only`` asks for one label.
    """
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    if keep is not None:
        chosen = chosen.where(keep)
    chosen = chosen.groupBy("doc_id").agg(F.max("y").alias("y"))
    if only is not None:
        chosen = chosen.where(F.col("y") == only)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


class Memo:
    """Values of runs of text, of bounded size: what the last ``limit`` new runs did not
    touch is forgotten, so frequent runs stay and rare ones go."""

    def __init__(self, learn, limit: int):
        self.learn, self.limit = learn, limit
        self.young: dict = {}
        self.old: dict = {}

    def recall(self, runs: list) -> list:
        """The value of each run; ``learn`` maps a set of new runs to theirs."""
        young = self.young
        found = list(map(young.get, runs))
        if None in found:
            new = set()
            for run, value in zip(runs, found, strict=True):
                if value is None:
                    kept = self.old.get(run)
                    if kept is None:
                        new.add(run)
                    else:
                        young[run] = kept
            if new:
                young.update(self.learn(new))
            found = list(map(young.__getitem__, runs))
            if len(young) > self.limit:
                self.old, self.young = young, {}
        return found


_HELD: dict = {}


def held_in_stage(key, make):
    """An object that the tasks of one stage share in a Python worker.

    It is made by the first of them; ``tidy`` lets it go when the worker gets a task of
    another stage, so that no operator's tables stay while others run.
    """
    at = _stage(), key
    if at not in _HELD:
        _HELD[at] = make()
    return _HELD[at]


def _stage() -> int:
    context = TaskContext.get()
    return -1 if context is None else context.stageId()


def tidy(run):
    """A function for ``mapInArrow`` that lets go of what other stages held, and gives freed
    memory back when its task ends.

    Python workers live on between tasks; without this, what one operator needed for a
    moment would stay with the process while others run.
    """

    def wrapped(batches):
        stage = _stage()
        for at in [at for at in _HELD if at[0] != stage]:
            del _HELD[at]
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Hand rows to Python in batches of at most so many while an action runs, for wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions_for(df: DataFrame) -> int:
    """Partitions of a shuffle that must follow the data: as many as are read, or the session's default."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
