"""Sources: every reader takes an explicit schema, so that no pass over the data infers one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import clean


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path names a file or folder that is not empty, in whatever store it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getContentSummary(at).getLength() > 0


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def optional(spark: SparkSession, path: str, schema: str, read) -> DataFrame:
    """read(path), or no rows where there is nothing."""
    return read(path) if exists(spark, path) else empty(spark, schema)


def json_map(spark: SparkSession, path: str, value: str, nan_as_null: bool = True) -> DataFrame:
    """JSON objects of objects, one a file, to rows (pos, key, value), pos being the place in the file. Bare NaN is read as
    a number."""
    text = spark.read.text(path, wholetext=True)
    kind = f"map<string,{value}>"
    entries = F.map_entries(F.from_json("value", kind, {"allowNonNumericNumbers": "true"}))
    rows = text.select(F.posexplode(entries).alias("pos", "e")).select("pos", F.col("e.key").alias("key"), F.col("e.value").alias("value"))
    return without_nan(rows, "value") if nan_as_null else rows


def without_nan(rows: DataFrame, column: str) -> DataFrame:
    """NaN to null in doubles, at any depth of structs and arrays."""

    def walk(c, t):
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c), c)
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c.getField(f.name), f.dataType).alias(f.name) for f in t]))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: walk(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda k, v: walk(v, t.valueType))
        return c

    return rows.withColumn(column, walk(F.col(column), rows.schema[column].dataType))


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Strict: a malformed line fails the job with its file's name; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def malformed(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(path, line, text) of the lines that are no JSON object of this schema, numbered from 1 in their file.

    Files are split; a line's number is its place in its split and the lines of the splits before, which are counted for
    the files with such lines alone.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id")
    )
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = lines.filter((F.trim("value") != "") & parsed.getField("_bad").isNotNull())
    files = bad.select("path").distinct()
    splits = lines.join(files, "path", "left_semi").groupBy("path", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start")) - F.col("n")
    met = bad.join(splits.select("path", "start", "first", before.alias("before")), ["path", "start"])
    return met.select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))


def jsonl_checked(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Strict, with the place of the fault: every line is read once before; the first malformed one is an error that names
    its path and line."""
    first = malformed(spark, path, schema).orderBy("path", "line").limit(1).collect()
    if first:
        raise ValueError(f"{first[0].path}:{first[0].line}: malformed line {first[0].text[:80]!r}")
    return jsonl(spark, path, schema)


def jsonl_lenient(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Lines that cannot be read are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def processed_ids(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    read = lambda p: jsonl_lenient(spark, p, f"{key} string")
    return optional(spark, path, f"{key} string", read).filter(F.col(key).isNotNull()).distinct()


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array; missing or empty files give no rows."""
    return optional(spark, path, schema, lambda p: spark.read.schema(schema).option("multiLine", True).json(p))


def catalogue(spark: SparkSession, path: str, key: str = "item_id") -> DataFrame:
    """CSV with a header; rows without a key, or with a spelt-out null for one, are skipped, a header without it is an error."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if key not in rows.columns:
        raise ValueError(f"{path}: no column {key}")
    return rows.filter(clean(F.col(key)).isNotNull())


def numbered(spark: SparkSession, paths: str | list[str], schema: str, word: str = "retry") -> DataFrame:
    """Files, or folders of part files, whose names hold a number after word, as rows with source_rank (0 without a
    number) and seq, their order within the file's split."""
    rows = spark.read.schema(schema).json(paths).select("*", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("seq"))
    rank = F.coalesce(F.regexp_extract("_f", "^.*" + word + r"[-_]?(\d+)", 1).try_cast("int"), F.lit(0))
    return rows.withColumn("source_rank", rank).drop("_f")


def tagged(spark: SparkSession, path: str, schema: str, tag: str) -> DataFrame:
    """Rows of an optional source with its dataset_type."""
    return json_array(spark, path, schema).withColumn("dataset_type", F.lit(tag))


def children(spark: SparkSession, root: str) -> list[str]:
    """Paths of what lies in a folder, handed over in one call; none where there is no folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(at)) if fs.exists(at) else []
    if not len(found):
        return []
    lead = found[0].getParent().toString().rstrip("/") + "/"
    text = jvm.org.apache.commons.lang3.ArrayUtils.toString(found)  # {lead..,lead..}; no name holds a slash
    return [lead + n for n in text[1 + len(lead) : -1].split("," + lead)]


def checkpoints(spark: SparkSession, root: str, stride: int = 1, low: int | None = None, high: int | None = None) -> DataFrame:
    """Folders checkpoint-N under root as (step, path), filtered by stride and bounds, in order."""
    names = [(p.rsplit("/", 1)[1], p) for p in children(spark, root)]
    rows = spark.createDataFrame(names, "name string, path string") if names else empty(spark, "name string, path string")
    step = F.regexp_extract("name", r"^checkpoint-(\d+)$", 1).try_cast("int")
    rows = rows.select(step.alias("step"), "path").filter("step is not null").filter(F.col("step") % stride == 0)
    if low is not None:
        rows = rows.filter(F.col("step") >= low)
    if high is not None:
        rows = rows.filter(F.col("step") <= high)
    return rows.orderBy("step")


def checkpoint_rows(spark: SparkSession, found: DataFrame, schema: str) -> DataFrame:
    """The rows of listed checkpoints, each with its step: a name a folder reaches the driver."""
    paths = [r.path for r in found.select("path").collect()]
    if not paths:
        return empty(spark, f"{schema}, step int")
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))  # else a task a folder, up to 10,000
    try:
        rows = spark.read.schema(schema).parquet(*paths)  # lists the folders
    finally:
        spark.conf.set(name, before)
    return rows.withColumn("step", F.regexp_extract(F.col("_metadata.file_path"), r"/checkpoint-(\d+)/", 1).cast("int"))


def templates(spark: SparkSession, rows: dict[str, str]) -> DataFrame:
    """A literal table of prompt templates by name."""
    return spark.createDataFrame(sorted(rows.items()), "name string, template string")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, "query string, item string")
