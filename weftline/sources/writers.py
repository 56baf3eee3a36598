"""Sinks: Spark's commit protocol makes each write atomic."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that move at once.
MOVERS = 8


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_document(rows: DataFrame, path: str, key: str, value: str) -> None:
    """Rows as members of JSON objects, one object a part file, so that the write stays parallel; `json_map` reads them
    back. Characters other than ASCII stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "{"
        for batch in batches:
            lines = []
            for k, v in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append(f"{lead}{json.dumps(k, ensure_ascii=False)}: {v if v is not None else 'null'}")
                lead = ","
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["{}" if lead == "{" else "}"], pa.string())], names=["value"])

    members = rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(F.col(value).alias("v"))).alias("value"))
    members = members.select("key", F.regexp_extract("value", r'(?s)^\{"v":(.*)\}$', 1).alias("value")).withColumn("value", F.nullif("value", F.lit("")))
    members.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_partitioned(rows: DataFrame, path: str, *by: str) -> None:
    """Variants or splits of one scan in one write."""
    rows.write.mode("overwrite").partitionBy(*by).json(path)


def write_versioned(rows: DataFrame, root: str) -> int:
    """rows as the table's next version, whoever else writes one; older versions stay."""
    from weftline.sources.versions import Versions

    return Versions(rows.sparkSession, root).commit(rows)


def write_quarantined(rows: DataFrame, valid: str, path: str, failed: str) -> None:
    """Valid rows to path, the others to failed, which goes if there are none. The input runs once, into a folder a
    verdict, and the folders are moved."""
    spark, both = rows.sparkSession, f"{path}.parts"
    verdict = F.coalesce(F.col(valid), F.lit(False)).alias("_verdict")
    rows.select(verdict, *[c for c in rows.columns if c != valid]).write.mode("overwrite").partitionBy("_verdict").json(both)
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = name(both).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for to, part in ((path, "true"), (failed, "false")):
        fs.delete(name(to), True)
        found = name(f"{both}/_verdict={part}")
        if fs.exists(found):
            fs.rename(found, name(to))
        elif part == "true":
            fs.mkdirs(name(to))
    fs.delete(name(both), True)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_checkpoints(rows: DataFrame, name: str, root: str) -> None:
    """rows under root in a folder for each name. Names are dealt to a fixed number of tasks, as a folder costs time however
    few its bytes are, by which adaptive execution would put all into one; folders move in threads."""
    from weftline.sources.readers import children

    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(tasks, name).write.mode("overwrite").partitionBy(name).parquet(f"{root}/.parts")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with ThreadPoolExecutor(MOVERS) as pool:
        moved = pool.map(lambda s: fs.rename(path(s), path(f"{root}/{s.rsplit('=', 1)[1]}")), [s for s in children(spark, f"{root}/.parts") if "=" in s.rsplit("/", 1)[1]])
        for _ in moved:  # a move that failed is an error here
            pass
    delete(spark, f"{root}/.parts")


def write_named(rows: DataFrame, name: str, text: str, root: str) -> None:
    """A folder under root for each name, with its text as a file."""
    rows.select(name, text).repartition(name).write.mode("append").partitionBy(name).text(root)


def empty_artefacts(spark: SparkSession, root: str, remove: bool = False) -> DataFrame:
    """(path, name) of files under root with nothing in them or an empty list, name being the folder's value where there
    is one, else the file's; removed unless this is a dry run. Small files are read on the executors; files of no length,
    which Spark does not scan, come from the store's listing."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    none, listed = [], fs.listFiles(at, True) if fs.exists(at) else None
    while listed is not None and listed.hasNext():
        s = listed.next()
        if not s.getLen() and s.getPath().getName()[:1] not in "._":
            none.append((s.getPath().toString(),))
    small = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter("length <= 4")
    found = small.filter(F.regexp_replace(F.col("content").cast("string"), r"\s", "").isin("[]", "")).select("path")
    found = found.unionByName(spark.createDataFrame(none, "path string"))
    folder = F.regexp_extract("path", r"/[^/=]+=([^/]+)/[^/]*$", 1)
    out = found.select("path", F.when(folder != "", folder).otherwise(F.regexp_extract("path", "([^/]+)$", 1)).alias("name"))
    if remove:
        from weftline.operators.folds import written

        out = written(out)
        for r in out.select("path").toLocalIterator():
            delete(spark, r.path)
    return out


def checkpoint_state(state: DataFrame, path: str, user: str = "user_id") -> None:
    """A step's state of every user, appended with its time; readers take each user's latest."""
    state.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)


def summary(results: list[DataFrame], path: str) -> None:
    """Results of several checkpoints in one table."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    write_json(out, path)


def report(rows: DataFrame, title: str, limit: int = 50) -> str:
    """A report table as text, also printed; limit is the report's length."""
    text = f"{title}\n{rows._show_string(limit, False)}"
    print(text)
    return text
