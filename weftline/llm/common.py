"""What the training-data operators share: inputs, shared-folder tables, Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of text that a Python worker holds at once are cut to about this many bytes.
CHUNK_BYTES = 4 << 20
#: Rows of an Arrow batch between Spark and Python, as texts can be long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in a local session alone, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def small_batches(spark: SparkSession) -> None:
    """Lower Spark's Arrow batches to BATCH_ROWS rows unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written for one query in the shared folder, so that a lost executor costs no lineage.

    `put` writes and reads again; `drop` removes a table whose readers have all run. What is left goes
    when the driver ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/weftline/{uuid.uuid4().hex}"
        self.n = 0
        small_batches(spark)
        atexit.register(self._end)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weftline_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, df._weftline_path)

    def release(self) -> None:
        """Let Spark remove the shuffle files of jobs that are over."""
        self.spark.sparkContext._jvm.System.gc()

    def _end(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session may have ended first
            pass


def numbered(rows: DataFrame, by: list[Column], within: list[Column], scratch: Scratch) -> DataFrame:
    """rows as a table with _at, their places (from 0) in the order of `by`, then `within`.

    Rows are dealt by ranges of `by`, so that no task holds more than one range, and rows that agree in it stay together;
    what is collected into one place is a count per range.
    """
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by, *within)
    held = scratch.put(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))  # a row per range
    at = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)
    return held.join(F.broadcast(starts), part == F.col("_part")).withColumn("_at", at).drop("_id", "_part", "_start")


_owner: list = [None, None]


def claim(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Called by an operator's function in a Python worker: a worker serves one stage after another, and what an earlier
    operator keeps in it (a tokenizer's caches, freed memory) goes back when another one begins."""
    if _owner[0] != owner:
        if _owner[1] is not None:
            _owner[1]()
        if _owner[0] is not None:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)
        _owner[:] = [owner, clear]


def by_batch(fn: Callable[..., pa.RecordBatch | None], text_at: int) -> Callable:
    """A mapInArrow function that calls fn on slices whose texts (column text_at) sum to about CHUNK_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_at):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return run


def gathered(batches: Iterator[pa.RecordBatch], text_at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts come to about `most` bytes, and cut where one has more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch, text_at, most):
            held.append(part)
            size += part.column(text_at).nbytes
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def slices(batch: pa.RecordBatch, text_at: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if not n:
        return
    col = batch.column(text_at)
    if col.nbytes <= most:
        yield batch
        return
    import pyarrow.compute as pc

    start = size = 0
    for i, b in enumerate(pc.fill_null(pc.binary_length(col), 0).to_pylist()):
        if size + b > most and i > start:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += b
    yield batch.slice(start)


def texts(column: pa.Array) -> list[str]:
    """Texts with null as empty."""
    return [t or "" for t in column.to_pylist()]
